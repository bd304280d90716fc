"""Segments: statistics, compaction triggers and candidate selection, as aggregations over segment rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..types import CompactionParams


def segment_stats(rows: DataFrame) -> DataFrame:
    """(seg_id, level, dead) rows -> seg_id, level, num_vectors, tombstones, live, ratio."""
    return with_ratio(rows.groupBy("seg_id", "level").agg(F.count("*").alias("num_vectors"), F.sum(F.col("dead").cast("long")).alias("tombstones")))


def with_ratio(stats: DataFrame) -> DataFrame:
    """Adds live (never below 0) and the share of tombstones (0 for an empty segment)."""
    ratio = F.when(F.col("num_vectors") > 0, F.col("tombstones") / F.col("num_vectors")).otherwise(F.lit(0.0))
    return stats.withColumn("live", F.greatest(F.col("num_vectors") - F.col("tombstones"), F.lit(0))).withColumn("ratio", ratio)


def _by_level(params: CompactionParams, of) -> Column:
    return F.element_at(F.array(*[F.lit(of(i)) for i in range(params.num_levels)]), F.col("level") + 1)


def eligible_levels(stats: DataFrame, params: CompactionParams) -> DataFrame:
    """level, segments, worst ratio of the levels to compact: enough segments (below the top), or one with
    more than the tolerated share of tombstones."""
    at = stats.where(F.col("level") < params.num_levels).groupBy("level").agg(F.count("*").alias("segments"), F.max("ratio").alias("worst"))
    many = ~_by_level(params, params.is_top) & (F.col("segments") >= _by_level(params, params.threshold))
    return at.where(many | (F.col("worst") > params.tombstone_threshold))


def candidates(stats: DataFrame, params: CompactionParams, base_capacity: int) -> DataFrame:
    """level, seg_id of the segments to merge on each eligible level: those of most tombstones first, until
    the live vectors fill the output; at least two, or one that has tombstones."""
    fill = lambda i: int(params.capacity(params.output(i), base_capacity) * (1.0 - params.tombstone_threshold))
    level = Window.partitionBy("level")
    before = level.orderBy(F.desc("ratio"), "seg_id").rowsBetween(Window.unboundedPreceding, -1)
    picked = (
        stats.join(eligible_levels(stats, params).select("level"), "level", "left_semi")
        .withColumn("before", F.coalesce(F.sum("live").over(before), F.lit(0)))
        .where((F.col("before") == 0) | (F.col("before") < _by_level(params, fill)))
    )
    first = F.row_number().over(level.orderBy(F.desc("ratio"), "seg_id"))
    picked = picked.withColumn("rank", first).where((F.col("before") < _by_level(params, fill)) | (F.col("rank") == 1))
    return picked.withColumn("n", F.count("*").over(level)).where((F.col("n") >= 2) | (F.col("ratio") > 0)).select("level", "seg_id")


def plan(segments: Iterable[tuple[int, int, int, int]], params: CompactionParams, base_capacity: int) -> dict[int, set[int]]:
    """Level -> segments to merge, of (seg_id, level, num_vectors, tombstones): what ``candidates`` picks of a level, and
    again of what it leaves, until the level is no longer eligible. So a level is merged at once, however many segments it has."""
    levels: dict[int, list[tuple[float, int, int]]] = {}
    for seg_id, level, num_vectors, tombstones in segments:
        levels.setdefault(level, []).append((-tombstones / num_vectors if num_vectors else 0.0, seg_id, max(0, num_vectors - tombstones)))
    chosen: dict[int, set[int]] = {}
    for level, left in levels.items():
        if level >= params.num_levels:
            continue
        fill = int(params.capacity(params.output(level), base_capacity) * (1.0 - params.tombstone_threshold))
        left.sort()
        at = 0
        while at < len(left) and ((not params.is_top(level) and len(left) - at >= params.threshold(level)) or -left[at][0] > params.tombstone_threshold):
            end, live = at + 1, left[at][2]
            while end < len(left) and live < fill:
                live += left[end][2]
                end += 1
            if end - at < 2 and not left[at][0]:
                break
            chosen.setdefault(level, set()).update(seg_id for _, seg_id, _ in left[at:end])
            at = end
    return chosen
