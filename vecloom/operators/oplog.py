"""The mutation log's semantics as DataFrame aggregations.

A log row is (seq, op, doc_id, vector, meta...): upsert replaces the vector and merges the given
metadata, delete forgets the document, update_metadata merges into a document that exists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART_ROWS, LEAST_PARTS, MOST_PARTS = 250_000, 16, 4096
"""Rows that a range of ``numbered`` has, about; ranges at least and at most."""


def fold(ops: DataFrame, vector: str = "vector", fields: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """One row for each live document: doc_id, its vector, each field's latest value, birth and last seq.

    Narrow rows (doc_id, seq, which fields are set) are folded first, in aggregations that combine on the map side
    and joins that AQE may split; they name the ops that count, at most one for the vector and each field of a
    document. Those are then fetched by seq, so ops that later ones replace never travel with their vectors past that
    join, and a document's ops are never together, however many it has. ``carry`` columns keep the value they have
    on the birth row. An op with a smaller seq than 0 is possible; equal seqs are one document's, and only one of
    them an upsert's birth.
    """
    up = F.col("op") == "upsert"
    narrow = ops.select("doc_id", "seq", up.alias("up"), *[F.col(f"`{f}`").isNotNull().alias(f"has{i}") for i, f in enumerate(fields)])
    died = ops.where(F.col("op") == "delete").groupBy("doc_id").agg(F.max("seq").alias("died"))
    seen = narrow.join(died, "doc_id", "left").where(F.col("died").isNull() | (F.col("seq") > F.col("died"))).drop("died")
    births = seen.where("up").groupBy("doc_id").agg(F.min("seq").alias("birth"))
    latest = [F.max(F.when(F.col(f"has{i}"), F.col("seq"))).alias(f"s{i}") for i in range(len(fields))]
    won = (
        seen.join(births, "doc_id")
        .where(F.col("seq") >= F.col("birth"))
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("up"), F.col("seq"))).alias("sv"), *latest, F.first("birth").alias("birth"), F.max("seq").alias("last_seq"))
    )
    ends = ["birth", "sv", *[f"s{i}" for i in range(len(fields))]]
    wanted = won.withColumn("seq", F.explode(F.array_distinct(F.array_compact(F.array(*ends)))))
    got = ops.select("doc_id", "seq", "op", F.col(vector), *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).join(wanted, ["seq", "doc_id"])

    def at(value: str, place: str, of: Column | None = None) -> Column:
        here = F.col("seq") == F.col(place)
        return F.max_by(value, F.when(here if of is None else here & of, F.lit(1)))

    return got.groupBy("doc_id").agg(
        at(vector, "sv", up).alias(vector),
        *[at(f"f{i}", f"s{i}", F.col(f"f{i}").isNotNull()).alias(f) for i, f in enumerate(fields)],
        *[at(f"c{i}", "birth", up).alias(c) for i, c in enumerate(carry)],
        F.first("birth").alias("birth"),
        F.first("last_seq").alias("last_seq"),
    )


def ranged(rows: DataFrame, key: str, name: str, n: int | None = None) -> DataFrame:
    """``name``: a range of the key with about PART_ROWS rows, by splitters from a quantile sketch, so neither gaps nor
    crowds nor the width of a range matter; a single value is never cut. Rows that are known to be no more than
    PART_ROWS (``n``, at most) are one range, without a look at them."""
    if n is not None and n <= PART_ROWS:
        return rows.withColumn(name, F.lit(0))

    def sketch(parts: int) -> Row:
        at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        return rows.agg(F.count("*").alias("n"), F.percentile_approx(key, at, F.lit(10 * parts)).alias("e")).first()

    found = sketch(LEAST_PARTS)
    if found["n"] > LEAST_PARTS * PART_ROWS:
        found = sketch(min(MOST_PARTS, -(-found["n"] // PART_ROWS)))
    edges = found["e"] or []
    kind = rows.schema[key].dataType
    return rows.withColumn(name, sum(((F.col(key) >= F.lit(e).cast(kind)).cast("int") for e in sorted(set(edges))), F.lit(0)))


def births(ops: DataFrame, n: int | None = None) -> DataFrame:
    """doc_id, seq, doc_ord of every birth: an upsert of a document that did not exist. Ordinals count births in order
    of seq and are never used again. There are ``n`` ops at most, if that is known. An op is compared with the one before it of its document, which is looked up
    within a range of seq, or else is the last of an earlier range: no document's ops are sorted in one task."""
    moved = ranged(ops.where(F.col("op").isin("upsert", "delete")).select("doc_id", "seq", "op"), "seq", "_range", n)
    last = moved.groupBy("doc_id", "_range").agg(F.max_by("op", "seq").alias("last"))
    earlier = Window.partitionBy("doc_id").orderBy("_range")  # a row for each range at most
    carried = last.select("doc_id", "_range", F.lag("last").over(earlier).alias("carried"))
    within = Window.partitionBy("doc_id", "_range").orderBy("seq")
    known = moved.withColumn("before", F.lag("op").over(within)).join(carried, ["doc_id", "_range"])
    born = known.where((F.col("op") == "upsert") & (F.coalesce("before", "carried", F.lit("delete")) == "delete")).select("doc_id", "seq")
    return numbered(born, "seq", "doc_ord", n)


def numbered(rows: DataFrame, key: str, name: str, n: int | None = None) -> DataFrame:
    """``name``: the row's place, from 0, in the order of a numeric ``key`` whose values differ; ranges are counted,
    then numbered side by side."""
    cut = ranged(rows, key, "_part", n)
    if n is not None and n <= PART_ROWS:
        place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
        return cut.select(*rows.columns, place.cast("long").alias(name))
    counts = cut.groupBy("_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most MOST_PARTS rows
    starts = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return cut.withColumn("_place", place).join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_start") + F.col("_place")).cast("long").alias(name))


def cumulated(values: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """by, key, n, start: how often each value of a numeric ``key`` occurs and how many rows come before it in its
    group, whatever the ties: counts combine on the map side, ranges of distinct values are cumulated side by side."""
    counts = ranged(values.groupBy(*by, key).agg(F.count("*").alias("n")), key, "_part")
    parts = counts.groupBy(*by, "_part").agg(F.sum("n").alias("_n"))
    below = Window.partitionBy(*by, F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most MOST_PARTS rows a group
    starts = parts.select(*by, "_part", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_start") + F.coalesce("_before", F.lit(0))
    here = F.col("l._part") == F.col("r._part")
    for c in by:  # a null group is a group
        here = here & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    met = counts.withColumn("_before", F.sum("n").over(inside)).alias("l").join(starts.alias("r"), here)
    return met.select(*[F.col(f"l.{c}").alias(c) for c in by], key, "n", start.alias("start"))


def last_of_batch(batch: DataFrame, keys: Sequence[str] = ("doc_id",), position: str = "pos") -> DataFrame:
    """A batch's surviving entries: of equal ids the last, earlier ones dropped whole with their metadata.
    Several batches go at once if their number is one of the keys."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("row")).select(*keys, "row.*")
