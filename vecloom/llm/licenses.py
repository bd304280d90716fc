"""License scan with a positional rare-token index, DataFrame functions only.

The templates are indexed once: word -> (template, position). A document keeps its occurrences of
the templates' words with their positions. Document frequencies of those words over all documents
give IDFs; each template is looked up by the RARE highest-IDF words of its mandatory key phrase; postings
and occurrences intersect by relative position (a template may be there if those words stand at one
common offset); and at that offset the key phrase is verified word by word. As the looked-up words are
part of the phrase, IDFs decide what the search costs and never what it finds.

Base labels are the places where a stated phrase's words stand consecutively; every phrase word is
an indexed word, so those places are found among the occurrences too, and base labels always stay.

Defined cases: a null or empty text has no words, no labels and score 0; null doc_ids are rows like
others; repeated rows are scanned one by one; an empty table gives no rows; further columns are
ignored; whole texts are scanned. Only words of the fixed templates are ever shuffled, and IDFs are
one number for each such word, whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, pick

RARE = 2
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
"""A word of a text whose A-Z are lower case."""
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
"""The same word before lower-casing."""

BASE_PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Label -> (wording, its mandatory key phrase), as words of the public licence texts.
TEMPLATES: list[tuple[str, str, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "licensed under the mit license", "the mit license"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("proprietary", "copyright all rights reserved", "all rights reserved"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products derived from this software"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", "distributed in the hope that it will be useful"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "all copies or substantial portions of the software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source versions must be plainly marked"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("cddl", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("eupl", "licensed under the european union public licence", "european union public licence"),
    ("artistic", "under the terms of the artistic license 2 0", "the artistic license"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("odbl", "made available under the open database license", "open database license"),
    ("postgresql", "without fee and without a written agreement is hereby granted", "without a written agreement is hereby granted"),
    ("psf", "python software foundation license version 2", "python software foundation license"),
    ("sspl", "under the terms of the server side public license version 1", "server side public license"),
    ("busl", "licensed under the business source license 1 1", "business source license"),
    ("wtfpl", "do what the fuck you want to public license", "do what the fuck you want to"),
]

VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in t.split()} | {w for p in BASE_PHRASES.values() for w in p.split()})
_COMMON = {"a", "and", "any", "are", "by", "can", "for", "in", "into", "is", "it", "of", "or", "that", "the", "this", "to", "with", "you"}


_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _gate() -> Column:
    """Whether the lower-case text ``low`` may hold a key or base phrase: true wherever one stands. A phrase asks for
    its longest word, or for "license" if it has it; one of short words for its first two, side by side."""
    phrases = sorted({k for _, _, k in TEMPLATES} | set(BASE_PHRASES.values()))
    words = {max(p.split(), key=lambda w: (w == "license", len(w))): p.split()[:2] for p in phrases}
    out = F.lit(False)
    for w in sorted(words, key=lambda w: (len(w) < 5, w)):
        out = out | (F.contains(F.col("low"), F.lit(w)) if len(w) >= 5 else F.col("low").rlike(_GAP.join(words[w])))
    return out


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def occurrences(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, occ array<struct<w int, p int>>: places of the vocabulary's words, in order."""
    d = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low = F.lower("text")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    index = F.create_map(*[x for i, w in enumerate(VOCABULARY) for x in (F.lit(w), F.lit(i))])
    words = F.regexp_extract_all(F.translate("text", upper, lower), F.lit(WORDS), F.lit(0))
    placed = F.filter(F.transform(words, lambda w, i: F.struct(F.when(w.isin(VOCABULARY), F.element_at(index, w)).alias("w"), i.alias("p"))), lambda s: s["w"].isNotNull())
    kind = "array<struct<w:int,p:int>>"
    d = d.withColumn("low", low).withColumn("hit", _gate()).drop("low")
    return d.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.regexp_count("text", F.lit(ANY_CASE)).cast("long").alias("n_words"),
        F.when(F.col("hit"), placed).otherwise(F.array().cast(kind)).cast(kind).alias("occ"),
    )


def _phrase_places(phrase: str) -> Column:
    """First-word places of a phrase whose words stand consecutively, from ``occ``."""
    ids = [VOCABULARY.index(w) for w in phrase.split()]

    def at(occ: Column) -> Column:
        def here(s: Column, i: Column) -> Column:
            ok = s["w"] == ids[0]
            for k, w in enumerate(ids[1:], 1):
                t = F.try_element_at(occ, i + 1 + k)
                ok = ok & F.coalesce((t["w"] == w) & (t["p"] == s["p"] + k), F.lit(False))
            return ok

        return F.transform(F.filter(occ, here), lambda s: s["p"].cast("long"))

    return _let(F.col("occ"), at)


def _idf(occ: DataFrame) -> dict[int, float]:
    n = occ.count()
    rows = occ.where(F.size("occ") > 0).select(F.explode(F.array_distinct(F.transform("occ", lambda s: s["w"]))).alias("w")).groupBy("w").count().collect()
    have = {r["w"]: r["count"] for r in rows}  # at most len(VOCABULARY)
    return {i: math.log((n + 1) / (have.get(i, 0) + 1)) for i in range(len(VOCABULARY)) if VOCABULARY[i] not in _COMMON}


def _values(spark, rows: list[tuple], names: str) -> DataFrame:
    """A small fixed table as a local relation, broadcast."""
    said = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {said} AS v({names})"))


def _found_templates(occ: DataFrame) -> DataFrame:
    """rid, label, share: the templates whose looked-up words and key phrase stand at one offset."""
    spark = occ.sparkSession
    idf = _idf(occ)
    some = occ.where(F.size("occ") > 0).select("rid", "occ")
    postings, keys, sizes, looked_up = [], [], [], []
    for t, (label, wording, phrase) in enumerate(TEMPLATES):
        ws, key = wording.split(), phrase.split()
        start = next((i for i in range(len(ws)) if ws[i : i + len(key)] == key), None)
        postings += [(t, VOCABULARY.index(w), i) for i, w in enumerate(ws)]
        if start is None:  # a phrase of its own right: indexed after the wording
            start = len(ws) + 1
            postings += [(t, VOCABULARY.index(w), start + i) for i, w in enumerate(key)]
        keys += [(t, start + i) for i in range(len(key))]
        rare = sorted({VOCABULARY.index(w) for w in key} & set(idf), key=lambda w: (-idf[w], w))[:RARE]
        looked_up += [(t, VOCABULARY.index(w), start + i) for i, w in enumerate(key) if VOCABULARY.index(w) in rare]
        sizes.append((t, label, len(ws), len(key), len(rare)))
    index = _values(spark, postings, "t, w, tp")  # the templates: fixed
    key_index = _values(spark, [(*k, 1) for k in keys], "t, tp, key")
    size_index = _values(spark, sizes, "t, label, n, n_key, n_rare")
    # Look up each template's rarest words and intersect with the occurrences by relative position.
    rare_index = _values(spark, looked_up, "t, w, tp")
    every = some.select("rid", F.explode("occ").alias("s")).select("rid", F.col("s.w").alias("w"), F.col("s.p").alias("p"))
    aligned = every.join(rare_index, "w").groupBy("rid", "t", (F.col("p") - F.col("tp")).alias("offset")).agg(F.count_distinct("w").alias("hits"))
    sure = aligned.join(size_index, "t").where(F.col("hits") == F.col("n_rare")).select("rid", "t", "offset")
    # Verify every word of the key phrase at that offset, with all occurrences.
    placed = every.join(index, "w").withColumn("offset", F.col("p") - F.col("tp"))
    checked = (
        placed.join(sure, ["rid", "t", "offset"], "left_semi")
        .join(key_index, ["t", "tp"], "left")
        .groupBy("rid", "t", "offset")
        .agg(F.count_distinct("tp").alias("got"), F.sum("key").alias("got_key"))
        .join(size_index, "t")
        .where(F.col("got_key") == F.col("n_key"))
    )
    return checked.groupBy("rid", "label").agg(F.max(F.least(F.lit(1.0), F.col("got") / F.col("n"))).alias("share"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a found template's words that stand in place, at least 0.5
    where a base phrase stands and 0 without a label.
    """
    occ = Table(occurrences(docs), "licenses").df
    found = _found_templates(occ).groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))  # at most one row for each label
    places = F.concat(*[_phrase_places(p) for p in BASE_PHRASES.values()])
    by_label = [F.when(F.size(_phrase_places(p)) > 0, F.lit(label)) for label, p in BASE_PHRASES.items()]
    some = occ.where(F.size("occ") > 0).select("rid", places.alias("places"), F.array_compact(F.array(*by_label)).alias("base"))
    known = some.join(found, "rid", "left").withColumnRenamed("rid", "rid2")
    none = F.array().cast("array<string>")
    base, more, at = F.coalesce("base", none), F.coalesce("more", none), F.coalesce("places", F.array().cast("array<bigint>"))
    return (
        occ.select("rid", "doc_id", "n_words")
        .join(known, F.col("rid") == F.col("rid2"), "left")
        .select(
            "doc_id",
            "n_words",
            F.size(at).cast("long").alias("n_base"),
            F.array_min(at).alias("first_word"),
            F.array_max(at).alias("last_word"),
            F.array_join(F.array_sort(base), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
            F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size(base) > 0, 0.5).otherwise(0.0)).alias("score"),
        )
    )
