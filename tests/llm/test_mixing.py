import random
import re

import pytest
from vecloom.llm import mixing as M

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """The stated process: deal by weight, stop the full ones, deal the excess again."""
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while open_ and left > 1e-9:
        per = left / sum(w[s] for s in open_)
        full = {s for s in open_ if out[s] + per * w[s] >= most * sizes[s]}
        if not full:
            for s in open_:
                out[s] += per * w[s]
            break
        for s in full:
            left -= most * sizes[s] - out[s]
            out[s] = most * sizes[s]
        open_ -= full
    return out


def corpus(n=900):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["b", "c", "ç", "Z", "z", None])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 80, 400])), source))
    return rows + [(7, "equal row here", "a")] * 5 + [(None, "x y z", "b"), (8000, None, "c"), (8001, "  \x0b", None)]


def test_targets_are_met_and_reruns_agree(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = M.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rates_solve_the_dual(spark):
    """Rates are exp(multiplier * size), stopped at 2, and spend the target."""
    rows = [(i, "w " * (1 + i % 30), "ab"[i % 5 == 0]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = {}
    for r in M.mix(df, share=1.2).collect():
        by.setdefault(r.source, []).append(r)
    import math

    for rs in by.values():
        assert sum(r.size * r.rate for r in rs) == pytest.approx(rs[0].target, rel=1e-6)
        free = [(math.log(r.rate) / r.size) for r in rs if 0 < r.rate < 2]
        assert not free or max(free) - min(free) < 1e-9


def test_the_mix_itself(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    mixed = M.resample(df)
    assert mixed.columns == df.columns
    words = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(WORD.findall(r.text or ""))
    for r in M.mix(df).groupBy("source").agg({"target": "max"}).collect():
        assert abs(words.get(r[0], 0) - r[1]) <= 401


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in M.mix(df).collect()] == [(0, 0.0, 0)] * 2
    assert M.mix(df.limit(0)).count() == 0 and M.resample(df.limit(0)).count() == 0
    clash = df.select("doc_id", "text", "source", df.doc_id.alias("SIZE"), df.doc_id.alias("Source"))
    assert M.mix(clash).count() == 2


def test_the_draw_equals_brute_force(spark):
    """Whole copies, then fractions in the order of u / fraction until the source's words are used up."""
    rows = [(i, t, s) for i, (_, t, s) in enumerate(corpus(400))] + [(5000, "long " * 30_000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    u = {r.doc_id: r.u for r in M.sized(df).collect()}
    by = {}
    for r in M.mix(df).collect():
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        left = round(rs[0].target) - sum(int(r.rate) * r.size for r in rs)
        for r in sorted((r for r in rs if r.rate > int(r.rate)), key=lambda r: (u[r.doc_id] / (r.rate - int(r.rate)), r.doc_id)):
            extra = max(0, min(r.size, left))
            assert r.taken == int(r.rate) * r.size + extra, r
            left -= r.size
        assert all(r.taken == int(r.rate) * r.size for r in rs if r.rate == int(r.rate))


def test_a_source_stopped_at_its_most_is_taken_whole(spark):
    rows = [(i, "w " * (1 + i % 9), "a" if i % 3 else "b") for i in range(600)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1000), share=1.5).collect()
    assert {r.taken / r.size for r in got if r.source == "b"} == {2.0}
    assert abs(sum(r.taken for r in got) - 1.5 * sum(r.size for r in got)) <= 1


def test_an_unsolved_dual_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_ITERATIONS", 1)
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(50)], "doc_id long, text string, source string")
    with pytest.raises(RuntimeError, match="not converged"):
        M.mix(df).count()
