"""The queries opN_<name> and pipeline, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_docs(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_docs(spark, sf_dir), n_shards=24, law="bytes", tolerance=0.0)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join

    return join(_docs(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_docs(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find, summarise

    return summarise(find(_docs(spark, sf_dir)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import BASE, POLICIES, apply_policy, stored

    rows = apply_policy(stored(_docs(spark, sf_dir)), POLICIES["2"])
    failed = F.col("rule_bits").bitwiseAND(F.lit(BASE.mask)) != 0
    return rows.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_bits"
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both policy versions over one stored ledger: what each rule drops, and what it alone drops."""
    from .quality import POLICIES, ablations, stored

    rows = stored(_docs(spark, sf_dir))
    return ablations(rows, POLICIES["base"]).union(ablations(rows, POLICIES["2"]))


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove

    return remove(_docs(spark, sf_dir), keep_bytes=False).drop("kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_docs(spark, sf_dir), weights=(5, 2, 1), share=1.5, most=2.0).withColumn("rate", F.round("rate", 6))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import integer_vectors, top_k

    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_mixing": op2_mixing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_language_id": op4_language_id,
    "op5_sharding": op5_sharding,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_license_scan": op7_license_scan,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
    "quality_ablations": quality_ablations,
}

_LEDGER = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT k, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5
), h AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, ws[i:i+4]) AS c FROM g
), r AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM h WHERE c > 1) GROUP BY k
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
         length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower
  FROM w LEFT JOIN r USING (k)
), f AS (
  SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words AND n_words > 0)::INT
            + 8 * (word_chars < 2 * n_words)::INT + 16 * (word_chars > 20 * n_words)::INT + 32 * (100 * n_dup_lines > 50 * n_lines)::INT
            + 64 * (10 * n_upper > 6 * (n_upper + n_lower) AND n_upper + n_lower > 20)::INT)::BIGINT AS rule_bits FROM m
)"""
"""One row for each document, with the bits of its failed rules."""

_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT k, doc_id, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))) END AS sh
  FROM w WHERE len(ws) > 0
), sets AS (
  SELECT row_number() OVER () AS sid, sh, len(sh) AS n, min(doc_id) AS low, count(*) AS copies, list(k) AS ks FROM s GROUP BY sh
), x AS (
  SELECT sid, n, unnest(sh) AS t FROM sets
), p AS (
  SELECT a.sid AS u, b.sid AS v FROM x a JOIN x b ON a.t = b.t AND a.sid < b.sid GROUP BY a.sid, b.sid, a.n, b.n
  HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))
), e AS (
  SELECT u, v FROM p UNION ALL SELECT v, u FROM p
), r(sid, root) AS (
  SELECT sid, sid FROM sets UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.sid
), c AS (
  SELECT r.sid, min(low) AS class_id FROM r JOIN sets ON sets.sid = r.root GROUP BY r.sid
), l AS (
  SELECT e.u AS sid, count(*) AS texts, sum(copies) AS docs FROM e JOIN sets ON sets.sid = e.v GROUP BY e.u
), m AS (
  SELECT unnest(ks) AS k, class_id, copies, coalesce(texts, 0) AS texts, coalesce(docs, 0) + copies - 1 AS links
  FROM sets JOIN c USING (sid) LEFT JOIN l USING (sid)
)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, coalesce(links, 0)::BIGINT AS n_links, coalesce(texts, 0)::BIGINT AS n_linked_texts,
       coalesce(copies, 1)::BIGINT AS n_copies, class_id IS NULL OR class_id = w.doc_id AS kept
FROM w LEFT JOIN m USING (k)
"""
"""Every pair that shares a shingle, and the closure of its links; doc_ids differ, so the smallest stays."""


def _license_sql() -> str:
    """Every place of every key phrase, and the words of its wording that stand around it."""
    from .licenses import BASE_PHRASES, TEMPLATES

    said = lambda phrase: "[" + ", ".join(f"'{w}'" for w in phrase.split()) + "]"
    before = lambda wording, key: len(f" {wording} ".split(f" {key} ", 1)[0].split())
    templates = ", ".join(f"('{label}', {said(wording)}, {said(key)}, {before(wording, key)})" for label, wording, key in TEMPLATES)
    phrases = ", ".join(f"('{label}', {said(p)})" for label, p in BASE_PHRASES.items())
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), j AS (
  SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM d
), b AS (
  SELECT k, label, unnest(range(1, len(ws) - len(kw) + 2)) AS p, ws, kw FROM j, (VALUES {phrases}) v(label, kw)
  WHERE contains(line, ' ' || array_to_string(kw, ' ') || ' ')
), base AS (
  SELECT k, count(*) AS n_base, min(p) - 1 AS first_word, max(p) - 1 AS last_word, list(DISTINCT label) AS labels
  FROM b WHERE ws[p:p + len(kw) - 1] = kw GROUP BY k
), t AS (
  SELECT k, label, unnest(range(1, len(ws) - len(kw) + 2)) AS p, ws, tw, kw, n FROM j, (VALUES {templates}) v(label, tw, kw, n)
  WHERE contains(line, ' ' || array_to_string(kw, ' ') || ' ')
), f AS (
  SELECT k, label, len(list_filter(range(1, len(tw) + 1), lambda i: p - n + i - 1 >= 1 AND ws[p - n + i - 1] = tw[i])) / len(tw) AS share
  FROM t WHERE ws[p:p + len(kw) - 1] = kw
), g AS (
  SELECT k, max(share) AS share, list(DISTINCT label) AS labels FROM f GROUP BY k
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(g.labels, [])))), ',') AS labels,
       greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN base USING (k) LEFT JOIN g USING (k)
"""


def _repeats_sql() -> str:
    """Every window of every text by hash, twice or more somewhere; runs are islands of such windows."""
    from .repeats import PASSAGE, PASSAGE_WORDS, Lengths

    def runs(name: str, length: int) -> str:
        return f"""{name}_w AS (
  SELECT k, unnest(range(0, n - {length} + 1)) AS p, raw FROM d WHERE n >= {length}
), {name}_h AS (
  SELECT k, p, md5(raw[p + 1:p + {length}]) AS h FROM {name}_w
), {name}_t AS (
  SELECT k, p, lag(p) OVER (PARTITION BY k ORDER BY p) AS before FROM {name}_h WHERE h IN (SELECT h FROM {name}_h GROUP BY h HAVING count(*) > 1)
), {name}_i AS (
  SELECT k, p, count(*) FILTER (WHERE before IS NULL OR p > before + {length}) OVER (PARTITION BY k ORDER BY p) AS run FROM {name}_t
), {name} AS (
  SELECT k, min(p) AS a, max(p) + {length} AS b FROM {name}_i GROUP BY k, run
)"""

    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, encode(coalesce(text, '')) AS raw, octet_length(raw) AS n FROM documents
), {runs("gone", Lengths().length)}, {runs("passage", PASSAGE.length)}, g AS (
  SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans FROM gone GROUP BY k
), edges AS (
  SELECT k, b AS low FROM gone UNION ALL SELECT k, 0 FROM d
), kept AS (
  SELECT e.k, string_agg(hex(d.raw[low + 1:coalesce((SELECT min(a) FROM gone WHERE gone.k = e.k AND a >= low), n)]), '' ORDER BY low) AS bytes
  FROM edges e JOIN d ON d.k = e.k GROUP BY e.k
), m AS (
  SELECT k, n, array_to_string(list_transform(regexp_extract_all(hex(raw), '..'), lambda x: CASE WHEN x IN ('09', '0A', '0B', '0C', '0D', '20') THEN ' ' ELSE 'x' END), '') AS mask
  FROM d WHERE k IN (SELECT k FROM passage)
), c AS (
  SELECT k, len(regexp_extract_all(substr(mask, a + 1, b - a), 'x+')) - (a > 0 AND substr(mask, a, 2) = 'xx')::INT - (b < n AND substr(mask, b, 2) = 'xx')::INT AS words
  FROM passage JOIN m USING (k)
), q AS (
  SELECT k, count(*) AS n_passages, sum(words) AS passage_words FROM c WHERE words > {PASSAGE_WORDS} GROUP BY k
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(n_passages, 0)::BIGINT AS n_passages,
       coalesce(passage_words, 0)::BIGINT AS passage_words, sha256(unhex(bytes)) AS kept_sha256
FROM d JOIN kept USING (k) LEFT JOIN g USING (k) LEFT JOIN q USING (k)
"""


_SHARDS = r"""
WITH tb AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl
), d AS (
  SELECT doc_id, text, (coalesce(strlen(text), 0) + 8)::BIGINT AS size, coalesce(md5(text), repeat('0', 32)) AS h, coalesce(md5(doc_id::VARCHAR), repeat('0', 32)) AS i,
         list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents
), o AS (
  SELECT *, substr(h, 1, 15) AS k1, substr(i, 1, 10) AS k2, sum(size) OVER (ORDER BY k1, k2 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total,
         sum(size) OVER (PARTITION BY k1) AS held, lead(k1) OVER (ORDER BY k1, k2) AS later FROM d
), edges AS (
  SELECT 0 AS edge UNION SELECT upto FROM o WHERE later IS NULL OR later <> k1 OR held >= total / 24.0
), near AS (
  SELECT j, edge, row_number() OVER (PARTITION BY j ORDER BY abs(edge - total * j / 24.0), edge) AS r FROM edges, range(1, 24) t(j), (SELECT max(total) AS total FROM o)
), placed AS (
  SELECT *, (SELECT count(*) FROM near WHERE r = 1 AND edge <= upto - size)::INTEGER AS shard FROM o
)
SELECT doc_id, size, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(h, 1, 3), substr(i, 1, 1), k1, k2) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM placed, tb
"""
"""Every row's place by running sums, splitters at the edges nearest to their targets; CRC-32 byte by byte."""

_MIX = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, greatest(sum(size)::DOUBLE / count(*), 1e-9::DOUBLE) AS mean, row_number() OVER (ORDER BY source NULLS LAST) AS sid,
         [5.0::DOUBLE, 2.0, 1.0][(sid - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM d GROUP BY source
), c AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT *, least(cap, coalesce((SELECT c2.level FROM c c2 WHERE c2.level * c2.weight <= c2.cap ORDER BY c2.cap / c2.weight, c2.sid LIMIT 1), 'inf'::DOUBLE) * weight) AS target FROM c
), z AS (
  SELECT t.sid, d.size, count(*) AS n FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY t.sid, d.size
), b(i, sid, lo, hi) AS (
  SELECT 0, sid, -60.0::DOUBLE * mean - 1, mean * ln(2.0::DOUBLE) + 1 FROM t WHERE target < cap * (1 - 1e-12)
  UNION ALL
  SELECT i + 1, sid, CASE WHEN got < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN got < target THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT b.i, b.sid, b.lo, b.hi, t.target, sum(z.n * z.size * least(2.0::DOUBLE, exp(least((b.lo + b.hi) / 2 * z.size / t.mean, 700.0::DOUBLE)))) AS got
        FROM b JOIN z USING (sid) JOIN t USING (sid) WHERE b.i < 120 GROUP BY b.i, b.sid, b.lo, b.hi, t.target)
), r AS (
  SELECT d.*, t.sid, t.source_size, t.target,
         CASE WHEN d.size = 0 THEN 0.0 WHEN b.lo IS NULL THEN 2.0 ELSE least(2.0, exp(least(round((b.lo + b.hi) / 2, 12) * d.size / t.mean, 700.0))) END::DOUBLE AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN b ON b.sid = t.sid AND b.i = 120
), f AS (
  SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part FROM r
), x AS (
  SELECT *, round(target)::BIGINT - sum(whole * size) OVER (PARTITION BY sid)
            - coalesce(sum(size) FILTER (WHERE part > 0) OVER (PARTITION BY sid ORDER BY CASE WHEN part > 0 THEN u / part END NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free FROM f
)
SELECT doc_id, source, size, source_size, target, round(rate, 6) AS rate,
       (whole * size + CASE WHEN part > 0 THEN greatest(0, least(size, free)) ELSE 0 END)::BIGINT AS taken
FROM x
"""
"""Targets by the sorted levels, multipliers by bisection, the draw by running sums."""

ORACLE: dict[str, str] = {
    "op2_mixing": _MIX,
    "op5_sharding": _SHARDS,
    "op1_repeats": _repeats_sql(),
    "op6_jaccard_join": _JACCARD,
    "op7_license_scan": _license_sql(),
    "op8_exact_top_k": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (
  SELECT *, row_number() OVER () AS rid FROM e
), p AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM n q, n c WHERE q.vec_id % 50 = 0 AND q.rid <> c.rid
), r AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op10_quality_rules": _LEDGER
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, rule_bits & 3 <> 0 AS base_failed, rule_bits = 0 AS kept, rule_bits FROM f
""",
    "quality_ablations": _LEDGER
    + """, rules AS (
  SELECT * FROM (VALUES ('few_words', 1), ('repeat_words', 2), ('symbols', 4), ('short_words', 8), ('long_words', 16), ('dup_lines', 32), ('shouting', 64)) r(rule, bit)
), p AS (
  SELECT * FROM (VALUES ('base', 3), ('2', 127)) p(version, mask)
)
SELECT version, rule, count(*) FILTER (WHERE rule_bits & bit <> 0) AS n_failed, count(*) FILTER (WHERE rule_bits & mask = bit) AS n_only,
       count(*) AS n_documents
FROM f, rules, p WHERE bit & mask <> 0 GROUP BY version, rule
""",
}
