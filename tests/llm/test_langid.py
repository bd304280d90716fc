import random
import unicodedata

import numpy as np
from pyspark.sql import functions as F
from vecloom.llm import langid

PARTS = {"en": ["the", "tion", "ing", "and", "of", "sh"], "de": ["der", "ung", "sch", "keit", "ü", "ein"], "fr": ["le", "eau", "tion", "é", "que", "aux"], "ру": ["при", "ость", "ть", "ый", "на", "в"]}


def corpus(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        out.append((i, " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(900)
    odd = [(5001, None, "en"), (5002, "", "en"), (5003, "12 !! 3", "de"), (None, "der und die ung keit schung", "de"), (5004, "the of and ing", None), (7, "the and ing", "fr")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: (t, lang) for i, t, lang in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert sum(r.lang_pred == truth[r.doc_id][1] for r in held) / len(held) > 0.98
    by = {r.doc_id: r for r in got}
    for i in (5001, 5002, 5003):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[None].held_out is False and by[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 and r.lang_pred in (*PARTS, "und") for r in got)
    assert sum(r.rejected for r in got if r.doc_id in truth) < 0.02 * len(rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)


def test_filter_keeps_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in corpus(200)] + [(999, "...", "en", "s")], "doc_id long, text string, lang string, score string")
    kept = langid.known(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 999 not in ids and len(ids) > 190
    assert langid.identify(df.limit(0)).count() == 0
    bare = df.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    assert {r.lang_pred for r in langid.identify(bare).collect()} == {"und"}


def test_a_text_counts_whole(spark):
    """The end of a long text outweighs its beginning."""
    rows = corpus(400)
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    pred, _, _ = model.predict(["the of and ing " * 10 + "der ungkeit schein " * 5000])
    assert pred == ["de"]


def brute(model, text):
    """The prediction from n-grams one by one: mean of their rows, softmax, best."""
    p = [ord(c) if unicodedata.category(c)[0] == "L" else 0 for c in f" {text.lower()} "]
    if not any(p):
        return "und", 0.0
    rows = []
    for i in range(len(p)):
        for n in range(1, 5):
            gram = p[i : i + n]
            ok = {1: lambda: p[i], 2: lambda: any(gram), 3: lambda: len(gram) > 1 and gram[1], 4: lambda: len(gram) > 2 and gram[1] and gram[2]}[n]()
            if not ok:
                continue
            gram += [0] * (n - len(gram))
            h = n
            for j, c in enumerate(gram):
                h = (h * 31 + c) * int(langid._PRIMES[j]) % 2**64
            rows.append(model.table[(h * int(langid._SPREAD) % 2**64) >> 49])
    z = (np.mean(np.array(rows, float), axis=0) + model.bias) / model.temperature
    e = np.exp(z - z.max())
    best = int(e.argmax())
    return model.languages[best], e[best] / e.sum()


def test_predictions_equal_brute_force_however_texts_are_batched(spark):
    rows = corpus(300) + [(9000 + i, t, "en") for i, t in enumerate(["a", "é", "x 1 y", "  ", "7", "ÜBER straße", "日本 go", "the", "the", "in-the", "word " * 3000])]
    df = spark.createDataFrame([(*r, str(r[0])) for r in rows], "doc_id long, text string, lang string, TEXT string")
    model = langid.train(df)
    for parts in (1, 7):
        got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df.repartition(parts), model).collect()}
        for i, t, _ in rows:
            lang, score = brute(model, t)
            assert got[i][0] == lang and abs(got[i][1] - score) < 1e-5, (t[:50], got[i], lang, score)
