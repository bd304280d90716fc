"""Evaluation of search results and latencies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits_to_ids(hits: DataFrame, query: str = "query_id", id: str = "id", rank: str = "rank") -> DataFrame:
    """query, ids: each query's ids in order of rank."""
    return hits.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, id))), lambda s: s[id]).alias("ids"))


def recall_at_k(truth: Column, result: Column, k: int) -> Column:
    """Common ids of the first k of each, over k (not over the truth's size)."""
    first = lambda xs: F.slice(xs, 1, k)
    return F.size(F.array_intersect(first(truth), first(result))) / F.lit(float(k))


def percentiles(samples: DataFrame, column: str, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, p, value: the sorted sample at round(p / 100 * (n - 1)), halves up, without interpolation; 0.0 where a group
    has no samples (or, without groups, there are none). Counts of distinct values are cumulated in ranges, so no
    group, whatever its size or ties, is gathered or sorted in one task."""
    from .oplog import cumulated

    xs = samples.select(*by, F.col(column).cast("double").alias("x"))
    sizes = xs.groupBy(*by).agg(F.count("x").alias("n"))
    wanted = sizes.select(*by, "n", F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p"))
    wanted = wanted.withColumn("place", F.floor(F.col("p") / 100.0 * (F.col("n") - 1) + 0.5))
    placed = cumulated(xs.where("x IS NOT NULL"), "x", by).withColumnsRenamed({"n": "ties", **{c: f"{c}_" for c in by}})
    return _looked_up(wanted, placed, by)


def _looked_up(wanted: DataFrame, placed: DataFrame, by: Sequence[str]) -> DataFrame:
    """The value whose rows cover each wanted place."""
    here = (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("ties"))
    for c in by:
        here = here & F.col(c).eqNullSafe(F.col(f"{c}_"))
    found = placed.join(wanted if by else F.broadcast(wanted), here).select(*by, "p", "x")
    keys = [*by, "p"]
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys]
    met = wanted.alias("w").join(found.alias("f"), reduce(lambda a, b: a & b, same), "left")
    return met.select(*[F.col(f"w.{c}").alias(c) for c in keys], F.coalesce("f.x", F.lit(0.0)).alias("value"))


def query_subset(queries: DataFrame, n: int, seed: int, id: str = "query_id") -> DataFrame:
    """n queries, chosen by a seeded hash, in order of id."""
    return queries.orderBy(F.xxhash64(F.lit(seed), id), id).limit(n).orderBy(id)


def multiplicity(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """vector, n: how often each vector occurs."""
    return vectors.groupBy(vector).agg(F.count("*").alias("n"))


def latency_summary(samples: DataFrame, column: str = "seconds", by: Sequence[str] = ()) -> DataFrame:
    """by, avg, p50, p95, p99 of latencies; 0.0 without samples."""
    spread = percentiles(samples, column, (50.0, 95.0, 99.0), by)
    wide = spread.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}") for p in (50, 95, 99)])
    means = samples.groupBy(*by).agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("avg"))
    if not by:
        return means.crossJoin(F.broadcast(wide)).select("avg", "p50", "p95", "p99")  # one row each
    same = reduce(lambda a, b: a & b, [F.col(f"m.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by])
    return means.alias("m").join(wide.alias("w"), same).select(*[F.col(f"m.{c}").alias(c) for c in by], "avg", "p50", "p95", "p99")
