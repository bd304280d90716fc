import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from vecloom.llm import repeats as R

SMALL = R.Lengths(20, 7)


def brute(rows, length):
    """Each text's result, straight from the contract."""
    raws = [(t or "").encode() for t in rows]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(rows, length, words):
    """(runs of more than ``words`` words that repeat, their words) of each text."""
    raws = [(t or "").encode() for t in rows]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        held = [sum(m.start() <= w.start() and w.end() <= m.end() for w in re.finditer(rb"\S+", r)) for m in re.finditer(b"\1+", gone)]
        out.append((sum(n > words for n in held), sum(n for n in held if n > words)))
    return out


def corpus(seed, n=60, letters="ab cdé"):
    rng = random.Random(seed)
    some = ["".join(rng.choice(letters) for _ in range(rng.choice([10, 19, 20, 21, 40, 90]))) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = [rng.choice(some) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6))]
        out.append("".join(parts))
    return [*out, "", None, "a" * 500, "ab" * 300, out[3], "x" * 19, "y" * 20, "z" * 21]


def check(spark, texts, of):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = R.remove(df, of, passage=R.Lengths(12, 5), words=2).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert {r.doc_id: (r.n_passages, r.passage_words) for r in rows} == dict(enumerate(brute_passages(texts, 12, 2)))
    want = brute(texts, of.length)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i])


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    check(spark, corpus(seed), SMALL)


def test_hot_buckets_and_many_batches(spark, monkeypatch):
    monkeypatch.setattr(R, "LIMIT", 3)
    monkeypatch.setattr(R, "BATCH", 5)
    check(spark, corpus(7), SMALL)


def test_production_lengths(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [word(399), word(400), word(401), word(1500)]
    texts = [word(rng.randrange(700)) + s + word(rng.randrange(700)) for s in shared for _ in range(6)]
    near = texts[-1]
    texts += [near[:900] + "#" + near[900:], near + word(50), "é" * 900, word(5000)]
    check(spark, texts, R.Lengths())


def test_passages_of_over_50_words_are_reported(spark):
    """Shorter than what is removed: caught in each document that holds one, and in no other."""
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    some, less = words(51), words(50)
    texts = [f"{words(30)}. {some}. {words(20)}" for _ in range(5)] + [f"{words(30)}. {less}. {words(20)}" for _ in range(5)] + [words(90) for _ in range(20)]
    rows = R.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows if r.n_passages} == set(range(5)) and not any(r.n_removed for r in rows)
    assert all(51 <= r.passage_words <= 53 for r in rows if r.n_passages)


def test_column_transform_alone():
    rng = random.Random(1)
    of = R.Lengths(12, 4)
    anchor = "WXYZ"
    rows, groups, places = [], [], []
    for g in range(30):
        have = set()
        for _ in range(rng.randrange(2, 9)):
            place = rng.randrange(0, of.window)
            after = rng.randrange(of.length - place, of.length + 1) - len(anchor)
            have.add(("".join(rng.choice("ab") for _ in range(place)) + anchor + "".join(rng.choice("ab") for _ in range(max(0, after))), place))
        for r, p in sorted(have):
            rows.append(r.encode())
            groups.append(g)
            places.append(p)
    got = R.column_transform(np.array(groups), rows, np.array(places), of)
    for i, r in enumerate(rows):
        for w in range(len(r) - of.length + 1):
            same = any(j != i and groups[j] == groups[i] and 0 <= (q := w - places[i] + places[j]) and rows[j][q : q + of.length] == r[w : w + of.length] for j in range(len(rows)))
            assert got[i, of.window - 1 - places[i] + w] == same


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "q" * 450), (None, "q" * 450), (1, None)], "doc_id long, text string")
    got = R.remove(df.select("doc_id", "text", df.doc_id.alias("TEXT"))).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in got) == [("1", 0, 0, 0), ("None", 450, 450, 1), ("None", 450, 450, 1)]
    assert R.remove(df.limit(0)).count() == 0
