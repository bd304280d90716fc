"""Each stage against a brute-force version of what it should do to its own input."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as C
from brute_pipeline import classes, redacted, word_count


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    parts = {"en": ["the", "tion", "ing", "and", "of"], "de": ["der", "ung", "sch", "keit", "ü"]}
    rows = []
    for i in range(220):
        lang = rng.choice(["en", "de"])
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(8, 60)))
        rows.append((i, text, lang, rng.choice(["s1", "s2", "s3", None]), len(text)))
    for i in range(60):  # copies, near copies, personal data, texts without letters
        _, text, lang, source, n = rng.choice(rows[:220])
        rows.append((300 + i, text + (" end." if i % 2 else ""), lang, source, n))
    rows += [(400 + i, f"Write to me{i}@mail.example.com or +1 (499) 555-65{i:02d}, " + rows[i][1], "en", "s1", 0) for i in range(20)]
    rows += [(500, "12 34 !!", "en", "s1", 8), (501, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    names, out = docs.columns, docs.cache()
    seen = [sorted(map(tuple, docs.collect()), key=str)]
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, out, "").cache()
        assert out.columns == names
        seen.append(sorted(map(tuple, out.collect()), key=str))
    start, language, unique, clean, mixed = seen
    gone = {r[0] for r in start} - {r[0] for r in language}
    assert {500, 501} <= gone and len(gone) <= 4
    want = classes([(r[0], r[1]) for r in language])
    assert {r[0] for r in unique} == {min(c) for c in want}
    assert sorted((r[0], redacted(r[1])) for r in unique) == sorted((r[0], r[1]) for r in clean)
    assert all(r[4] == len(r[1]) for r in clean)
    allowed = set(clean)
    assert set(mixed) <= allowed and max(mixed.count(r) for r in set(mixed)) <= 2
    total = sum(word_count(r[1]) for r in clean)
    assert abs(sum(word_count(r[1]) for r in mixed) - 1.5 * total) < 4 * 70
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = C.STAGES[-1][1](spark, out, "").collect()
    assert sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in last) == sorted((r[0], len(i := enc.encode_ordinary(r[1])), tuple(i)) for r in mixed)
    assert all(r.exact for r in last)


def test_run_equals_the_stages(spark, docs, tmp_path):
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    whole = C.run(spark, str(tmp_path))
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in C.STAGES:
        out = stage(spark, out, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, out.collect()))


def test_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


EXTRA = ["TEXT", "N_CHARS", "Source", "did", "th", "id", "email", "more", "score", "rejected", "c0", "kind"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and further columns that clash."""
    rng = random.Random(8)
    words = ["the", "station", "winter", "and", "of", "garden", "letters", "walking", "over", "quiet"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "s", "ed"]) for _ in range(40)), "en", "ab"[i % 2], 9) for i in range(60)]
    rows += [rows[3], rows[3], (None, rows[4][1], "en", "a", 1), (None, None, None, None, None), (70, "", "en", "a", 0), (71, "one two", None, None, None)]
    rows += [(80, " ".join(rng.choice(words) for _ in range(60_000)) + " write to me@mail.example.com", "en", "b", 5)]
    return spark.createDataFrame([(*r, *(f"{e}:{r[0]}" for e in EXTRA)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{e} string" for e in EXTRA))


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_each_stage_on_odd_tables(spark, odd, name, stage):
    out = stage(spark, odd, "")
    rows = out.collect()
    if name == "tokenised":
        assert len(rows) == odd.count() and all(r.exact for r in rows)
        assert {r.doc_id for r in rows if r.n_tokens == 0} == {None, 70} and max(r.n_tokens for r in rows) > 60_000
    else:
        assert out.columns == odd.columns
        have = {(r[0], e) for r in odd.collect() for e in r[5:]}
        assert rows and all((r[0], e) in have for r in rows for e in r[5:]), "further columns stay with their rows"
        assert {r[0] for r in rows} >= {0, 80}, "ordinary and long texts stay"
    if name == "personal_data":
        assert len(rows) == odd.count()
        assert all(r[4] == len(r[1] or "") for r in rows) and next(r[1] for r in rows if r[0] == 80).endswith("write to <EMAIL>")
    if name == "near_duplicates":
        kept = [r[0] for r in rows]
        assert kept.count(3) == 1 and kept.count(4) == 1 and kept.count(None) == 1
    assert stage(spark, odd.limit(0), "").count() == 0
