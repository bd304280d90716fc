"""Sharding by histogram sort, DataFrame functions only.

Rows are ordered by a 120-bit key, the text's MD5 first, so equal texts are neighbours: one group. Splitters are
found without sorting: each pass counts the exact bytes below a grid of candidate boundaries (4,096 per
open splitter) in every partition, adds the partial counts up, and opens a finer grid only in the bin that holds a
target, until each splitter is within the tolerance or its bin holds one group only. That group stays whole, the
splitter going to its nearer edge, unless it is as large as a shard: then it is cut by the second half of the key,
from the doc_id's MD5 and a row number. With law
``rows``, where counts are at most one apart, groups are cut wherever a target falls. Then the rows are exchanged
once, to tasks that number them by shard and part of a shard.

Defined cases: null text has 0 bytes and a null checksum; null doc_ids are rows like others;
repeated rows are told apart by a row number frozen before the first count; an empty table gives no
rows; further columns are ignored unless listed in ``carry``; a text longer than a shard's share
makes that shard as large as the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Table, pick

BITS, LEVELS = 12, 5
"""Bits of the key that one pass resolves; passes that each of the two hashes can take."""
_TOP = -(2**63)
_KEPT = -(2 ** (64 - BITS * LEVELS))  # the lowest bits of a hash take no part


def _digest(value: Column) -> Column:
    """MD5 in hexadecimal; zeros for null."""
    return F.coalesce(F.md5(value.cast("binary")), F.lit("0" * 32))


def _key(digest: Column, digits: int, rest: Column) -> Column:
    """A long in the order of a digest's first digits, then of ``rest``: 60 bits in all, above 4 that are zero."""
    first = F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")
    return F.shiftleft(F.shiftleft(first, 60 - 4 * digits) + rest, 4).bitwiseXOR(F.lit(_TOP))


def _digit(level: int) -> Column:
    """Digit ``level`` (0 to 9) of the key, in unsigned order."""
    half, at = divmod(level, LEVELS)
    key = F.col(("k1", "k2")[half]).bitwiseXOR(F.lit(_TOP))
    return F.shiftrightunsigned(key, 64 - BITS * (at + 1)).bitwiseAND(F.lit(2**BITS - 1))


def _signed(digits: list[int]) -> int:
    value = 0
    for d in digits:
        value = (value << BITS) | d
    return ((value << (64 - BITS * len(digits))) if digits else 0) + _TOP


def _boundary(digits: tuple[int, ...]) -> tuple[int, int] | None:
    """The smallest key (k1, k2, as signed longs) with these leading digits; None above all keys."""
    digits = list(digits)
    while digits and digits[-1] == 2**BITS:  # carry
        digits.pop()
        if not digits:
            return None
        digits[-1] += 1
    return _signed(digits[:LEVELS]), _signed(digits[LEVELS:])


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float, whole: bool) -> list[tuple[int, int] | None]:
    """n_shards - 1 boundaries over (k1, k2, weight), each within ``tolerance`` (a share of a shard) of its target, or
    at the edge nearest to it: of a row or, if ``whole``, of a group of equal k1 smaller than a shard."""
    total = keys.agg(F.sum("weight")).first()[0] or 0
    slack = tolerance * total / n_shards
    open_ = {j: ((), 0) for j in range(1, n_shards)}  # splitter: leading digits, weight below them
    found: dict[int, tuple[int, int] | None] = {}
    for level in range(2 * LEVELS):
        if not open_ or not total:
            break
        prefixes = sorted({p for p, _ in open_.values()})
        which = F.lit(0) if level == 0 else None
        if level:
            near = keys.where(F.col("d0").isin([p[0] for p in prefixes]))
            for i, p in enumerate(prefixes):
                hit = F.lit(True)
                for at, d in enumerate(p):
                    hit = hit & (_digit(at) == d)
                which = F.when(hit, i) if which is None else which.when(hit, i)
            counted = near.withColumn("which", which).where("which is not null")
        else:
            counted = keys.withColumn("which", which)
        rows = counted.groupBy("which", _digit(level).alias("digit")).agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.min("k1").alias("low"), F.max("k1").alias("high")).collect()
        bins: dict[int, list] = {}
        for r in rows:  # at most 4,096 for each open splitter
            bins.setdefault(r["which"], []).append(r)
        for v in bins.values():
            v.sort(key=lambda r: r["digit"])
        for j, (prefix, below) in list(open_.items()):
            target = total * j / n_shards
            seen, choice = below, None
            for r in bins[prefixes.index(prefix)]:
                if seen + r["w"] >= target:
                    choice = r
                    break
                seen += r["w"]
            if choice is None:  # rounding: the target is the end of the prefix
                found[j] = _boundary((*prefix, 2**BITS))
                del open_[j]
                continue
            low, high = target - seen, seen + choice["w"] - target
            one = level < LEVELS and choice["low"] == choice["high"]
            if one and whole and choice["w"] < (1 - 2 * tolerance) * total / n_shards:
                edge = choice["low"] - (_KEPT if high < low else 0)  # the next key, or the group's own
                found[j] = (edge, _TOP) if edge < 2**63 else None
            elif min(low, high) <= slack or choice["n"] == 1 or level == 2 * LEVELS - 1:
                found[j] = _boundary((*prefix, choice["digit"] + (high < low)))
            else:
                open_[j] = ((*prefix, choice["digit"]), seen)
                continue
            del open_[j]
    return [found.get(j) for j in range(1, n_shards)]


def shard(
    docs: DataFrame,
    n_shards: int = 24,
    law: str = "bytes",
    tolerance: float = 0.001,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: these laws re-deal rows), and ``carry``.

    ``law`` is ``bytes`` (sizes near equal) or ``rows`` (counts at most one apart, tolerance 0).
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law: {law!r} (expected bytes or rows)")
    names = {f"x{i}": c for i, c in enumerate(carry)}
    base = pick(docs, doc_id="doc_id", text="text", **names)
    text = F.col("text").cast("string")
    slim = base.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _key(_digest(text), 15, F.lit(0)).alias("k1"),
        _key(_digest(F.col("doc_id").cast("long").cast("string")), 10, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))).alias("k2"),
        *names,
    )
    slim = slim.withColumn("weight", F.col("size") if law == "bytes" else F.lit(1).cast("long")).withColumn("d0", _digit(0))
    keys = Table(slim, "shard").df
    splitters = find_splitters(keys.select("k1", "k2", "weight", "d0"), n_shards, tolerance if law == "bytes" else 0.0, law == "bytes")
    place = F.lit(0)
    for at in splitters:
        if at is not None:
            b1, b2 = at
            place = place + F.when((F.col("k1") > b1) | ((F.col("k1") == b1) & (F.col("k2") >= b2)), 1).otherwise(0)
    # A shard's rows are numbered in parts: at most 16 * (4096 + n_shards) of them, whatever the rows.
    placed = keys.withColumn("shard", place.cast("int")).withColumn("part", F.col("d0") * 16 + F.shiftrightunsigned(F.col("k2").bitwiseXOR(F.lit(_TOP)), 60))
    parts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "part").orderBy("k1", "k2")
    return (
        placed.withColumn("at", F.row_number().over(order) - 1)
        .join(F.broadcast(starts), ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit(law).alias("law"),
            "shard",
            (F.col("start") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            *[F.col(k).alias(v) for k, v in names.items()],
        )
    )
