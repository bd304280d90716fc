import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from vecloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts(n, seed):
    rng = random.Random(seed)
    letters = ["a", "s", "t", "re", "ve", "ll", "d", "m", "'", "'", " ", " ", "  ", "\n", "\t", "1", "22", "!", "#", "é", "ß", " ", "日", "　", "٣", "😀", "'s", "x's", "\r\n", "́", "|"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_boundaries_and_ids_equal_the_library(reference):
    c = bpe.codec(PATH)
    texts = [*_texts(4000, 1), "", " ", "\n\n", "'s", " 's", "a'rest", "''s's", "a" * 5000, "ab " * 3000, "don't  we'll\n\n 'tis  "]
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        for t, ids in zip(part, c.encode(part), strict=True):
            assert ids == reference.encode_ordinary(t), repr(t)
            assert c.decode(ids) == t.encode()


def test_scan_equals_a_sequential_product():
    import numpy as np

    of_class, times, _ = bpe._monoid()
    e = of_class[np.random.default_rng(0).integers(0, 8, 70_001)]
    got, acc = bpe.scan(e, times), 0
    for i, x in enumerate(e):
        acc = times[acc, x]
        assert got[i] == acc


def test_operator_on_odd_rows(spark, reference):
    long = "The cat's 12 hats.\n" * 60_000
    rows = [(1, "it's", "x"), (None, None, "y"), (2, "", "z"), (1, "it's", "x"), (3, long, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT2 string").withColumnRenamed("TEXT2", "Text")
    got = bpe.digests(df, PATH).collect()
    want = []
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    enc = bpe.encode(df, PATH)
    assert {(r.doc_id, bytes(r.bytes)) for r in bpe.decode(enc, PATH).collect()} == {(i, (t or "").encode()) for i, t, _ in rows}
    one = enc.where("doc_id = 2").first()
    assert (one.ids, one.offsets) == ([], [0])
    assert bpe.digests(df.limit(0), PATH).count() == 0
