import random

from vecloom.llm import quality as Q


def brute(text):
    import re

    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(2)
    parts = ["a", "b", "the", " ", "\x1c", "é", "#", "*", "\n", "\n\n", " ", "\t", "\x0b", "日本", "| x"]
    return ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 70))) for _ in range(300)] + ["", None, "a b c d e f g " * 3, "THE LOUD " * 30, "word " * 4]


def test_ledger_equals_brute_force(spark):
    rows = [*enumerate(texts()), (None, "x")]
    got = Q.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, t in rows:
        r = by[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert bool(r.rule_bits & Q.BASE.mask) == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_policies_and_ablations(spark):
    rows = list(enumerate(texts()))
    ledger = Q.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    policy = Q.POLICIES["2"]
    bits = [r.rule_bits & policy.mask for r in ledger.collect()]
    kept = Q.apply_policy(ledger, policy).where("kept").count()
    assert kept == sum(b == 0 for b in bits)
    for r in Q.ablations(ledger, policy).collect():
        bit = 1 << list(Q.RULES).index(r.rule)
        assert (r.n_failed, r.n_only, r.n_documents) == (sum(b & bit != 0 for b in bits), sum(b == bit for b in bits), len(bits))


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert Q.ledger(df.limit(0)).count() == 0
    assert Q.ledger(df.select("doc_id", "text", df.doc_id.alias("N_WORDS"), df.doc_id.alias("Text"))).first().n_words == 1


def test_very_long_texts(spark):
    text = "one two three four five six\n" * 20_000 + "#" * 1000
    got = Q.stored(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, rule_bits string")).first()
    assert (got.n_words, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (120_001, 1000, 19_999, 120_000)
