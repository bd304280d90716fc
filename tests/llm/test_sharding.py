import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from vecloom.llm.sharding import shard


def check(rows, got, n, law):
    size = lambda t: 8 + len((t or "").encode())
    want = sorted((str(i), size(t), str(None if t is None else zlib.crc32(t.encode()))) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, str(r.text_crc32)) for r in got) == want
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < n and r.law == law and r.grown_shard is None
        by[r.shard].append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    return by


def test_sizes_are_near_equal_with_a_hot_text_and_long_ones(spark):
    rows = [(i, f"{i} " * (i % 50)) for i in range(3000)] + [(5000 + i, "the same text " * 10) for i in range(1500)] + [(9000, "long " * 2000), (None, None), (None, ""), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = check(rows, shard(df, 24).collect(), 24, "bytes")
    total = sum(8 + len((t or "").encode()) for _, t in rows)
    sums = {s: sum(r.size for r in rs) for s, rs in by.items()}
    assert len(sums) == 24 and max(sums.values()) - total / 24 < 10_000 + 0.01 * total / 24
    hot = {s for s, rs in by.items() for r in rs if r.text_crc32 == zlib.crc32(("the same text " * 10).encode())}
    assert len(hot) <= 24 * 1500 * 148 / total + 2, "equal texts are neighbours"


def test_groups_of_equal_texts_stay_whole_and_splitters_are_nearest(spark):
    """Against brute force over the sorted rows: every splitter is at the edge nearest to its target, of a group or, where
    that is as large as a shard, of a row."""
    rng = random.Random(5)
    texts = [f"{rng.random()} " * rng.randrange(1, 60) for _ in range(500)]
    rows = [(i, t) for i, t in enumerate(t for t in texts for _ in range(rng.choice([1, 1, 2, 5])))] + [(9000 + i, "one very hot text " * 20) for i in range(400)] + [(9500, None), (9501, "")]
    got = {r.doc_id: r for r in shard(spark.createDataFrame(rows, "doc_id long, text string"), 12, tolerance=0.0).collect()}
    check(rows, list(got.values()), 12, "bytes")
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    order = sorted((md5(t)[:15] if t is not None else "0" * 15, md5(str(i))[:10], i, 8 + len((t or "").encode())) for i, t in rows)
    total = sum(x[3] for x in order)
    held = defaultdict(int)
    for key, _, _, size in order:
        held[key] += size
    edges, seen, starts = [0], 0, {}
    for at, (key, _, i, size) in enumerate(order):
        starts[i] = seen
        seen += size
        if at + 1 == len(order) or order[at + 1][0] != key or held[key] >= total / 12:
            edges.append(seen)
    cuts = [min(edges, key=lambda e: (abs(e - total * j / 12), e)) for j in range(1, 12)]
    assert {i: got[i].shard for i in starts} == {i: sum(c <= start for c in cuts) for i, start in starts.items()}
    cut = {t for t in {t for _, t in rows} if len({got[i].shard for i, x in rows if x == t}) > 1}
    assert cut == {"one very hot text " * 20}


def test_counts_are_at_most_one_apart(spark):
    rows = [(i % 7, "x" * (i % 11)) for i in range(1003)]
    by = check(rows, shard(spark.createDataFrame(rows, "doc_id long, text string"), 10, law="rows").collect(), 10, "rows")
    counts = [len(rs) for rs in by.values()]
    assert len(counts) == 10 and max(counts) - min(counts) <= 1


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a", 5)], "doc_id long, text string, size int")
    one = shard(df, 24, carry=("size",)).collect()
    assert len(one) == 1 and one[0].slot == 0
    assert shard(df.limit(0), 24).count() == 0
    clash = df.select("doc_id", "text", df.doc_id.alias("TEXT"))
    assert shard(clash, 3).first().text_crc32 == zlib.crc32(b"a")
    with pytest.raises(ValueError, match="unknown law"):
        shard(df, 3, law="x")
