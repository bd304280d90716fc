"""Removal of byte strings that occur twice: a column-wise multi-document Burrows-Wheeler construction.

Every byte covered by a LENGTH-byte string that also starts anywhere else is removed. The collection
is never sorted suffix by suffix. Instead:

1. Each text is cut into pieces. The ANCHOR-byte string of smallest hash in a window of LENGTH bytes is
   the window's anchor; windows that share an anchor follow one another and make one piece. Equal
   windows have equal anchors at equal places, so they lie in pieces of one bucket, aligned.
2. Equal pieces are one row with a count (summed on the map side, so copies and shared passages, however
   hot, cost a row per task); all windows of a piece found twice are repeats. Buckets with a single
   piece have no others.
3. In the other buckets the collection's transform is built column by column, after Bauer, Cox and
   Rosone: each round inserts one symbol of every piece, from the last column to the first, moving the
   piece to its place among those that start with that symbol and updating the common prefixes of
   neighbours, that of a moved piece being the smallest between its old place and its new
   neighbour's, plus one. A window is a repeat if its common prefix with a neighbour reaches LENGTH.
   As equal windows are aligned, a round replaces the last one, and the work is linear in the length
   of the pieces, where one order of all suffixes takes its square. The pieces stream in from Spark's
   sorted shuffle files, some thousands at a time; none but the current batch is in memory.
4. Beyond LIMIT pieces, a bucket is not held by one task: its windows are counted by their hash, the
   counts summed on the map side.

The same construction with shorter strings finds passages: runs of bytes covered by strings of PASSAGE
that also start elsewhere, and that hold more than PASSAGE_WORDS words (what white space separates). They
are reported, not removed.

Pieces and windows are told apart by two 64-bit hashes (anchor and content). Defined cases: a null text
is empty; texts shorter than LENGTH keep everything; null doc_ids are rows like others; repeated rows
repeat each other; an empty table gives no rows; further columns are ignored; a run of one byte or a
short period costs one row, not one per byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, documents, drop_all
from .jaccard import _POWERS, _mixed, grouped

LIMIT = 20_000
BATCH = 4_000
"""Pieces that a bucket may have in one task; pieces whose columns are built together."""
_BLOCK = 1 << 23
_PLACE = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Lengths:
    """Of a repeat, and of its anchor (at most 2**16)."""

    length: int = 400
    anchor: int = 64

    @property
    def window(self) -> int:
        return self.length - self.anchor + 1


PASSAGE, PASSAGE_WORDS = Lengths(192, 32), 50


def _smallest(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    n, step = len(v) - width + 1, 1
    while 2 * step <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    return np.minimum(v[:n], v[width - step : width - step + n])


def pieces(raw: bytes, of: Lengths) -> tuple[np.ndarray, ...] | None:
    """(anchor hash, content hash, first window, last window, anchor's place in the piece, end, count)
    of a text's pieces; equal neighbours are one row."""
    n = len(raw)
    if n < of.length:
        return None
    up, down = _POWERS.upto(n + 1)
    with np.errstate(over="ignore"):
        b = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(b * up[:n], out=sums[1:])
        h = _mixed((sums[of.anchor :] - sums[: n - of.anchor + 1]) * down[: n - of.anchor + 1])
        windows = n - of.length + 1
        at = []
        for low in range(0, windows, _BLOCK):
            high = min(windows, low + _BLOCK)
            part = h[low : high + of.window - 1]
            v = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
            at.append((_smallest(v, of.window) & _PLACE).astype(np.int64) + low)
        anchor = at[0] if len(at) == 1 else np.concatenate(at)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [windows]]) - 1
        place = anchor[first]
        key = h[place]
        content = _mixed((sums[last + of.length] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    fresh = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])]))
    ends = np.concatenate([fresh[1:], [len(key)]]) - 1
    return key[fresh].view(np.int64), content[fresh].view(np.int64), first[fresh], last[fresh], (place - first)[fresh], last[ends] + of.length, ends - fresh + 1


_PIECES = "did long, th long, akey long, ckey long, s int, e int, place int, upto int, n long"


def _cut(of: Lengths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dids, ths, raws = (c for c in batch.columns)
            found, owner = [], []
            for i in range(batch.num_rows):
                p = pieces(raws[i].as_py(), of)
                if p is not None:
                    found.append(p)
                    owner.append(np.full(len(p[0]), i))
            if not found:
                continue
            key, content, s, e, place, upto, n = (np.concatenate(x) for x in zip(*found, strict=True))
            rows = pa.array(np.concatenate(owner))
            columns = [dids.take(rows), ths.take(rows), pa.array(key), pa.array(content), *(pa.array(x.astype(np.int32)) for x in (s, e, place, upto)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["did", "th", "akey", "ckey", "s", "e", "place", "upto", "n"])

    return run


def column_transform(groups: np.ndarray, rows: list[bytes], places: np.ndarray, of: Lengths) -> np.ndarray:
    """Which windows repeat: a matrix (piece x window start, the anchor's farthest place first).

    ``groups`` ascends; pieces of a group are distinct and aligned at their anchors. ``order`` lists the
    pieces by what follows the current column; ``common[i]`` is the common prefix of the i-th and the
    one before it, 0 where the group begins.
    """
    n, left = len(rows), of.window - 1
    wide = left + of.length
    text = np.full((n, wide), 256, np.int64)  # 256: no symbol
    for i, r in enumerate(rows):
        at = left - places[i]
        text[i, at : at + len(r)] = np.frombuffer(r, np.uint8)
    columns = np.ascontiguousarray(text.T)
    del text
    base = groups * 257
    order = np.arange(n)
    common = np.zeros(n, np.int64)
    again = np.zeros((left + 1, n), bool)
    for c in range(wide - 1, -1, -1):
        symbol = columns[c][order] + base[order]
        moved = np.argsort(symbol, kind="stable")
        key = symbol[moved]
        joins = np.zeros(n, bool)
        joins[1:] = (key[1:] == key[:-1]) & ((key[1:] - base[order[moved[1:]]]) != 256)
        now = np.zeros(n, np.int64)
        p = np.flatnonzero(joins)
        if len(p):
            a, b = moved[p - 1] + 1, moved[p] + 1
            near = common[moved[p]]
            far = np.flatnonzero(b - a > 1)
            if len(far):
                cuts = np.empty(2 * len(far), np.int64)
                cuts[0::2], cuts[1::2] = a[far], b[far]
                near[far] = np.minimum.reduceat(np.concatenate([common, [0]]), cuts)[0::2]
            now[p] = near + 1
        order, common = order[moved], now
        if c <= left:
            full = common >= of.length
            hit = full.copy()
            hit[:-1] |= full[1:]
            again[c][order] = hit
    return again.T


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _transform(of: Lengths):
    """(akey, ckey, n, place, did, th, s, bytes) sorted by akey -> (did, th, start, end) of repeats."""

    def batch_out(rows: list[tuple], groups: list[int]) -> pa.RecordBatch:
        again = column_transform(np.array(groups), [r[6] for r in rows], np.array([r[2] for r in rows]), of)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for r, flags in zip(rows, again, strict=True):
            if r[1] > 1:
                continue  # found twice as a whole: removed already
            offset = r[5] - (of.window - 1 - r[2])
            for a, b in zip(*_runs(flags), strict=True):
                for column, x in zip(out, (r[3], r[4], offset + int(a), offset + int(b) + of.length), strict=True):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["did", "th", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        groups: list[int] = []
        number = 0
        for table, first, end in grouped(batches):
            part = table.slice(first, end - first)
            seen: dict[int, tuple] = {}
            for r in zip(*(part.column(c).to_pylist() for c in range(1, 8)), strict=True):
                seen.setdefault(r[0], r)
            if len(seen) > 1:
                rows += seen.values()
                groups += [number] * len(seen)
                number += 1
            if len(rows) >= BATCH:
                yield batch_out(rows, groups)
                rows, groups, number = [], [], 0
        if rows:
            yield batch_out(rows, groups)

    return run


_ROW = "akey long, ckey long, n long, place int, did long, th long, s int, piece binary"


def _fetch(of: Lengths):
    """(did, th, z, wanted) -> the bytes of the wanted pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(8))
            for did, th, z, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = open_.decompress(z)
                for w in wanted:
                    for column, x in zip(out, (w["akey"], w["ckey"], w["n"], w["place"], did, th, w["s"], raw[w["s"] : w["e"] + of.length]), strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["akey", "ckey", "n", "place", "did", "th", "s", "piece"])

    return run


def _windows(of: Lengths):
    """_ROW -> (akey, w, n, did, th, start) of every window: its place from the anchor is part of w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for akey, _, n, place, did, th, s, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                up, down = _POWERS.upto(len(piece) + 1)
                m = len(piece) - of.length + 1
                with np.errstate(over="ignore"):
                    sums = np.zeros(len(piece) + 1, np.uint64)
                    np.cumsum((np.frombuffer(piece, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
                    h = _mixed((sums[of.length :] - sums[:m]) * down[:m] + (place - np.arange(m)).astype(np.uint64)).view(np.int64)
                fixed = [pa.array(np.full(m, x), pa.int64()) for x in (akey, n, did, th)]
                yield pa.RecordBatch.from_arrays([fixed[0], pa.array(h), fixed[1], fixed[2], fixed[3], pa.array(np.arange(s, s + m, dtype=np.int32))], ["akey", "w", "n", "did", "th", "start"])

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    c = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([c.compress(x) for x in batch.columns[-1].to_pylist()], pa.binary())], batch.schema.names)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, did, th (which name a text; rows equal in both are equal rows), raw bytes."""
    d = documents(docs)
    return d.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("did"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))


def repeats(docs: DataFrame, of: Lengths = Lengths()) -> DataFrame:
    """did, th, start, end: stretches of bytes to remove, overlapping as they come."""
    keyed = _keyed(docs)
    every = Table(keyed.select("did", "th", "raw").mapInArrow(_cut(of), _PIECES), "pieces")
    # Any of equal pieces stands for all. The firsts are of one row, as all are set and merged together.
    one = [F.first(c).alias(c) for c in ("did", "th", "s", "e", "place")]
    distinct = Table(every.df.groupBy("akey", "ckey").agg(F.sum("n").alias("n"), *one), "distinct")
    buckets = Table(distinct.df.groupBy("akey").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    whole = every.df.join(distinct.df.where("n > 1").select("akey", "ckey").hint("merge"), ["akey", "ckey"]).select("did", "th", F.col("s").alias("start"), F.col("upto").alias("end"))
    whole = Table(whole, "whole")
    every.drop()
    contested = distinct.df.join(buckets.df.hint("merge"), "akey")
    wanted = contested.groupBy("did", "th").agg(F.collect_list(F.struct("akey", "ckey", "n", "place", "s", "e", "size")).alias("wanted"))  # no more than a text has pieces
    wanted = Table(wanted, "wanted")
    hot = not buckets.df.where(F.col("size") > LIMIT).isEmpty()
    drop_all([distinct, buckets])
    squeezed = keyed.select("did", "th", "raw").where(F.octet_length("raw") >= of.length).mapInArrow(_squeeze, "did long, th long, z binary")
    met = squeezed.join(wanted.df.hint("merge"), ["did", "th"])

    def fetched(condition: str) -> DataFrame:
        some = met.select("did", "th", "z", F.expr(f"filter(wanted, w -> {condition})").alias("wanted")).where(F.size("wanted") > 0)
        return some.mapInArrow(_fetch(of), _ROW)

    small = fetched(f"w.size <= {LIMIT}").repartition("akey").sortWithinPartitions("akey")
    part = Table(small.mapInArrow(_transform(of), "did long, th long, start int, end int"), "parts")
    out = whole.df.union(part.df)
    if hot:
        seen = Table(fetched(f"w.size > {LIMIT}").mapInArrow(_windows(of), "akey long, w long, n long, did long, th long, start int"), "windows")
        twice = seen.df.groupBy("akey", "w").agg(F.count("*").alias("c")).where("c > 1")
        again = Table(seen.df.where("n = 1").join(Table(twice, "twice").df.hint("merge"), ["akey", "w"]).select("did", "th", "start", (F.col("start") + of.length).alias("end")), "parts")
        out = out.union(again.df)
        seen.drop()
    wanted.drop()
    return out


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _whole_words(raw: bytes, a: int, b: int) -> int:
    """Words that lie in raw[a:b] from end to end."""
    cut = lambda at: 0 < at < len(raw) and not raw[at - 1 : at].isspace() and not raw[at : at + 1].isspace()
    return max(0, len(raw[a:b].split()) - cut(a) - cut(b))


def _strip(keep_bytes: bool, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(7))
            for z, spans, runs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                raw, gone = open_.decompress(z), _merged(spans)
                edges = [0, *(x for span in gone for x in span), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
                long = [n for a, b in _merged(runs) if (n := _whole_words(raw, a, b)) > words]
                for column, x in zip(out, (len(raw), len(raw) - len(kept), len(gone), len(long), sum(long), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.string()), pa.array(out[6], pa.binary())], ["doc_id", *_COUNTS, "kept_sha256", "kept"])

    return run


_COUNTS = ("n_bytes", "n_removed", "n_spans", "n_passages", "passage_words")


def _by_text(spans: DataFrame, tag: str, name: str) -> DataFrame:
    return Table(spans.groupBy("did", "th").agg(F.collect_set(F.struct("start", "end")).alias(name)), tag).df


def remove(docs: DataFrame, of: Lengths = Lengths(), keep_bytes: bool = True, passage: Lengths = PASSAGE, words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_passages and passage_words (runs of more than ``words`` words that
    stand elsewhere too, and their words), kept_sha256, kept (the bytes that stay; null unless wanted)."""
    spans = _by_text(repeats(docs, of), "spans", "spans")
    runs = _by_text(repeats(docs, passage), "runs", "runs")
    squeezed = _keyed(docs).mapInArrow(_squeeze, "doc_id long, did long, th long, z binary")
    met = squeezed.join(spans.join(runs, ["did", "th"], "full").hint("merge"), ["did", "th"], "left").select("doc_id", "z", "spans", "runs")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return met.mapInArrow(_strip(keep_bytes, words), f"doc_id long, {counts}, kept_sha256 string, kept binary")
