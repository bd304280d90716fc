"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r (expected copies) that stays as near as it can to one copy in relative
entropy while each source's expected words meet its target and no rate exceeds ``most``. The dual of
that problem has one multiplier per source, and r = min(most, exp(multiplier * x)), where x is the
document's size in units of its source's mean size: the tilt is exponential in the constrained
quantity. The multipliers are found by safeguarded Newton iterations; an iteration is one
aggregation over (source, size, count), a table pre-aggregated on the map side whose rows are the
distinct sizes of a source, and the state of an iteration is a table in the shared folder.

Rates become copies by sequential Poisson sampling: every document gets its whole copies, and the
fractional parts f are drawn in the order of u / f (u a hash of the document in [0, 1)) until the
source's words are used up; the last document drawn may be taken in part. The order is cut in 2,048
ranges per source, so no source, however hot, is sorted in one task, and documents whose rate has no
fraction (empty ones, all of a source stopped at ``most``) are not sorted at all.

Defined cases: a null text has size 0 and takes 0 words; a null source is a source of its own, last
in order; null doc_ids and repeated rows are rows like others (equal rows may share a partial take
in any order, the multiset of results is the same); an empty table gives no rows; if all sizes are 0
all targets are 0; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Table, allot, drop_all, pick

RANGES = 2048
MAX_ITERATIONS = 80


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), source, size in words, u in [0, 1)."""
    d = pick(docs, doc_id="doc_id", text="text", source="source")
    text = F.col("text").cast("string")
    named = F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    h = F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("long")  # 52 bits
    return d.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("th"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ((h + F.lit(0.5)) / F.lit(float(2**52))).alias("u"),
    )


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, mean) -> with sid and target: ``share`` of all sizes dealt by weight,
    each source stopped at ``most`` times its size and the excess dealt again among the others.

    The levels of that process are sorted once: a source is stopped iff its cap per weight is below
    the level at which the rest share what is left.
    """
    one = Window.partitionBy(F.lit(0))  # one row for each source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int") + 1)
    w = (
        sources.withColumn("sid", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("budget", F.sum("source_size").over(one) * F.lit(float(share)))
    )
    order = one.orderBy(F.col("cap") / F.col("weight"), "sid")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(after))
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    w = w.withColumn("level", F.coalesce(F.first(open_level, ignorenulls=True).over(one.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf"))))
    return w.select("sid", "source", "source_size", "mean", "cap", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def solve(sizes: DataFrame, wanted: DataFrame, most: float, tolerance: float = 1e-10) -> Table:
    """The multiplier of each source: (sid, multiplier), multiplier null where every rate is ``most``.

    ``sizes`` has (sid, size, n), ``wanted`` (sid, mean, cap, target).
    """
    full = F.col("target") >= F.col("cap") * (1 - 1e-12)
    state = Table(
        wanted.where(~full).select(
            "sid", "target", "mean", F.lit(0.0).alias("m"), (-60.0 * F.col("mean") - 1).alias("lo"), (F.col("mean") * F.log(F.lit(float(most))) + 1).alias("hi"), F.lit(False).alias("done")
        ),
        "newton",
    )
    for _ in range(MAX_ITERATIONS):
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("m") * x, F.lit(700.0)))
        words = F.col("n") * F.col("size")
        slopes = (
            sizes.join(state.df.where("NOT done"), "sid")
            .groupBy("sid")
            .agg(F.sum(words * F.least(rate, F.lit(float(most)))).alias("got"), F.sum(F.when(rate < most, words * x * rate).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("m")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("m")).otherwise(F.col("hi"))
        newton = F.col("m") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo2")) & (newton < F.col("hi2"))
        near = (F.abs(gap) <= tolerance * F.col("target")) | (F.col("hi") - F.col("lo") <= 1e-13 * F.abs(F.col("m")))
        moved = (
            state.df.join(slopes, "sid", "left")
            .withColumns({"lo2": lo, "hi2": hi})
            .withColumn("now", F.col("done") | F.coalesce(near, F.lit(True)))
            .select(
                "sid",
                "target",
                "mean",
                F.when(F.col("now"), F.col("m")).otherwise(F.when(inside, newton).otherwise((F.col("lo2") + F.col("hi2")) / 2)).alias("m"),
                F.when(F.col("now"), F.col("lo")).otherwise(F.col("lo2")).alias("lo"),
                F.when(F.col("now"), F.col("hi")).otherwise(F.col("hi2")).alias("hi"),
                F.col("now").alias("done"),
            )
        )
        last, state = state, Table(moved, "newton")
        last.drop()
        if state.df.where("NOT done").isEmpty():
            return state
    raise RuntimeError(f"the dual has not converged in {MAX_ITERATIONS} iterations")


def shares(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, th, source, size, source_size, target, rate, taken (words, repeats counted) of every document."""
    spark_docs = Table(sized(docs), "sized")
    d = spark_docs.df
    by_size = Table(d.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    sources = by_size.df.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    sources = sources.withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))).drop("docs")
    wanted = Table(targets(sources, weights, share, most), "targets")
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    sizes = by_size.df.alias("s").join(wanted.df.alias("t"), same).select("t.sid", "s.size", "s.n")
    solved = solve(sizes, wanted.df, most)
    multipliers = wanted.df.join(solved.df.select("sid", F.round("m", 12).alias("m")), "sid", "left")

    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("m").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("m") * F.col("size") / F.col("mean"), F.lit(700.0)))))
    rated = (
        d.alias("s")
        .join(multipliers.alias("t"), same)
        .select("s.doc_id", "s.th", "s.source", "s.size", "s.u", "t.sid", "t.source_size", "t.target", "t.mean", "t.m")
        .withColumn("rate", rate)
        .withColumn("whole", F.floor("rate"))
        .withColumn("part", F.col("rate") - F.col("whole"))
        .withColumn("turn", F.when(F.col("part") > 0, F.col("u") / F.col("part")))
        .withColumn("range", F.when(F.col("turn").isNull(), RANGES).otherwise(F.floor(F.col("turn") / (F.col("turn") + 1) * RANGES)).cast("int"))
        .select("doc_id", "th", "source", "size", "sid", "source_size", "target", "rate", "whole", "turn", "range")
    )
    rated = Table(rated, "rated").df
    ranges = rated.groupBy("sid", "range").agg(F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("held"), F.sum("size").alias("words"))
    each = Window.partitionBy("sid")
    before = each.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("sid").alias("sid2"),
        F.col("range").alias("range2"),
        (F.round("target").cast("long") - F.sum("held").over(each) - F.coalesce(F.sum("words").over(before), F.lit(0))).alias("left"),
    )
    turn = Window.partitionBy("sid", "range").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    held = ["doc_id", "th", "source", "size", "source_size", "target", "rate"]
    drawn = rated.where("turn IS NOT NULL").join(ranges, (F.col("sid") == F.col("sid2")) & (F.col("range") == F.col("range2")))
    left = F.col("left") - F.coalesce(F.sum("size").over(turn), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), left))
    out = drawn.select(*held, (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))
    # Rates without a fraction draw nothing: they stay out of the windows, else a source stopped at ``most`` were one of them.
    settled = rated.where("turn IS NULL").select(*held, (F.col("whole") * F.col("size")).cast("long").alias("taken"))
    out = out.union(settled)
    drop_all([spark_docs, by_size, solved])
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, taken (words, repeats counted) of every document."""
    return shares(docs, weights, share, most).drop("th")


def resample(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: the rows of ``docs``, with all their columns, each as often as it is taken; the one
    document of a source that is taken in part stays if at least half of it is."""
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    found = shares(docs, weights, share, most).select(F.coalesce("doc_id", F.lit(-1)).alias("did"), "th", copies.cast("long").alias("copies"))
    keys = Table(found.groupBy("did", "th").agg(F.count("*").alias("m"), F.sum("copies").alias("c")), "copies")
    return allot(docs, keys.df)
