import random
from itertools import combinations

import pytest

from vecloom.llm import jaccard as J


def words(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    """(class, links) of each row number."""
    sets = [words(t) for _, t in rows]
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) * 10 >= 8 * len(a | b):
            links[i] += 1
            links[j] += 1
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))], links


def corpus(n_groups, size, seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choice(vocab) for _ in range(12))
    out = []
    for _ in range(n_groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(rng.choice([1, 1, 2, size])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w) + (" " + common if rng.random() < 0.3 else ""))
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


def check(spark, rows):
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    classes, links = brute(rows)
    for (i, _), c, n in zip(rows, classes, links, strict=True):
        assert (by[i].class_id, by[i].n_links) == (rows[c][0], n), i
    kept = [r.class_id for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(set(classes))


def test_links_and_classes_equal_brute_force(spark):
    check(spark, corpus(60, 12) + [(10_000, ""), (10_001, None), (10_002, "Two Words"), (10_003, "two  words")])


def test_large_groups_take_every_path(spark, monkeypatch):
    """Nodes above SMALL recurse to the last level and components span several blocks."""
    monkeypatch.setattr(J, "SMALL", 6)
    monkeypatch.setattr(J, "BLOCK", 16)
    check(spark, corpus(4, 90, seed=5))


@pytest.mark.parametrize("small", [16, 64])
def test_excerpts_of_a_large_group_meet(spark, monkeypatch, small):
    """Short excerpts are linked to longer ones only, and those to a group of copies above SMALL."""
    monkeypatch.setattr(J, "SMALL", small)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    out = []
    for _ in range(300):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    out += [" ".join(w) for w in (base[:382], base[:308], base[18:], base[92:])]
    rows = list(enumerate(out))
    classes, links = brute(rows)
    assert set(classes) == {0} and links[301] == links[303] == 1
    check(spark, rows)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "A b c d e f"), (7, "A b c d e f")], "doc_id long, text string")
    got = J.join(df.select("doc_id", "text", df.doc_id.alias("TEXT"))).collect()
    assert [(r.class_id, r.n_links, r.n_copies) for r in got] == [(7, 3, 4)] * 4
    assert sum(r.kept for r in got) == 1 and next(r.doc_id for r in got if r.kept) == 7
    assert J.join(df.limit(0)).count() == 0


def test_recall_at_the_threshold_with_production_constants(spark):
    """Pairs of similarity 0.8 to 0.86, each alone in the table, beside a group of 700 copies that differ by a word."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, want = [], {}
    while len(want) < 400:
        base = [word() for _ in range(150)]
        other = list(base)
        for at in rng.sample(range(150), rng.choice([2, 3])):
            other[at] = word()
        a, b = words(" ".join(base)), words(" ".join(other))
        if 8 * len(a | b) <= 10 * len(a & b) <= 8.6 * len(a | b):
            want[len(rows)] = len(rows) + 1
            rows += [" ".join(base), " ".join(other)]
    base = [word() for _ in range(200)]
    first = len(rows)
    for _ in range(700):
        w = list(base)
        w[rng.randrange(200)] = word()
        rows.append(" ".join(w))
    got = {r.doc_id: r for r in J.join(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    found = sum(got[a].class_id == got[b].class_id and got[a].n_links == got[b].n_links == 1 for a, b in want.items())
    assert found >= 0.99 * len(want)
    assert {(got[i].class_id, got[i].n_links) for i in range(first, len(rows))} == {(first, 699)}


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    rows = [(1, long, "x"), (2, long + " and an end", "y"), (3, None, None), (4, "", ""), (5, "short", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").selectExpr("*", "text AS TEXT", "doc_id AS th", "doc_id AS node")
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0)}


def test_runs_reach_the_target_recall():
    """Against a simulation of the chosen paths that two sets of similarity 0.8 share."""
    assert J.RUNS == 16 and J.runs_for(0.9) < J.runs_for(0.999) < J.RUNS
    rng = random.Random(1)

    def meets(level):
        if level == J.LEVELS:
            return True
        paths = 1 + (rng.random() < 1 / J.THRESHOLD - 1)
        return any([rng.random() < 0.8 and meets(level + 1) for _ in range(paths)])

    runs = J.runs_for(0.9)
    assert sum(any(meets(0) for _ in range(runs)) for _ in range(4000)) / 4000 >= 0.89
