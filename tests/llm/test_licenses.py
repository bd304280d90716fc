import random
import re

from vecloom.llm import licenses as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places, labels = [], []
    for label, phrase in L.BASE_PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        labels += [label] * bool(at)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def texts():
    rng = random.Random(4)
    parts = ["MIT", "License", "license", "mit", "Apache", "general", "PUBLIC", "licence", "x", "é", "K", "1", "{", "-", "日", "the"]
    out = ["".join(rng.choice(parts) + rng.choice([" ", "-", "\n", "", ", "]) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    return [*out, "", None, "mit license " * 4000, "word " * 50_000 + "Apache License"]


def test_base_equals_brute_force(spark):
    rows = [*enumerate(texts()), (None, "MIT License"), (None, "MIT License")]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), repr(t)[:200]
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_templates_are_found_by_position(spark):
    filler = "Plain prose about a permission slip and the public domain. " * 3
    want = {t: label for label, t, _ in L.TEMPLATES}
    rows = [(i, f"{filler}\n{t.upper()}. {filler}") for i, t in enumerate(want)]
    rows += [(900, filler), (901, "granted hereby is permission charge of free"), (902, "Licensed under the sun, by all rights"), (903, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(want.values()):
        assert label in got[i].labels.split(","), (i, label, got[i].labels)
    assert [got[i].labels for i in (900, 901, 902, 903)] == ["", "", "", "cc-by-nc"]
    assert got[903].score == 1.0 and got[900].score == 0.0


def test_a_file_of_many_licences_keeps_every_label(spark):
    """Rarer words of other licences take no template's place."""
    filler = "Plain prose about an ordinary day. "
    rows = [(0, f". {filler}".join(t for _, t, _ in L.TEMPLATES)), *((i, f"permission to license {i}") for i in range(1, 40))]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].labels == ",".join(sorted({label for label, _, _ in L.TEMPLATES}))
    assert {got[i].labels for i in range(1, 40)} == {""}


def test_every_key_phrase_opens_the_gate(spark):
    """A key phrase by itself is found, whatever else the text lacks."""
    rows = [*enumerate(f"See: {k.upper()}." for _, _, k in L.TEMPLATES), (50, "This work is under CC BY-NC 4.0"), (51, "success by accident")]
    got = {r.doc_id: r.labels for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(L.TEMPLATES):
        assert label in got[i].split(","), L.TEMPLATES[i]
    assert (got[50], got[51]) == ("cc-by-nc", "")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, TEXT string")
    assert L.scan(df).count() == 0


def test_labels_equal_brute_force(spark):
    """A label for every template whose key phrase stands anywhere, word by word, and no other."""
    rng = random.Random(6)
    keys = [k for _, _, k in L.TEMPLATES]
    rows = []
    for i in range(300):
        parts = []
        for _ in range(rng.randrange(0, 7)):
            k = rng.choice(keys).split()
            if rng.random() < 0.4:  # broken: a word less, or two the other way round
                at = rng.randrange(len(k))
                k = k[:at] + k[at + 1 :] if rng.random() < 0.5 else k[:at] + k[at:][::-1]
            parts.append(rng.choice([" ", "-", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in k))
        rows.append((i, rng.choice([" filler ", ". ", " x "]).join(parts)))
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        words = f" {' '.join(WORD.findall(t.lower()))} "
        want = {label for label, _, k in L.TEMPLATES if f" {k} " in words} | {label for label, k in L.BASE_PHRASES.items() if f" {k} " in words}
        assert set(filter(None, got[i].labels.split(","))) == want, t
