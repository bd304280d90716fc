"""N-gram Jaccard join by chosen paths.

Documents are sets of WIDTH-word shingles. Equal sets are one class from the start, so copies cost
one row each. Every set is embedded as T minwise tokens (coordinate, smallest hash); two sets of
similarity J share each of them with probability J. RUNS trees of chosen paths split the sets: at a
node, one coordinate, or with probability 1/4 two, is sampled from the node's own hash (1/THRESHOLD
on average) and the sets go to the children named by their tokens there, so two sets at the
threshold share one child on average at any depth.

* A node of up to SMALL sets is compared by brute force on the embedded tokens.
* A larger node compares all its sets with one of its own, its leader, chosen by hash. Sets that the
  first level has linked meet whole later on, so only pairs across its components are left: a node
  without any has nothing to add; one of few enough, no more than a node of SMALL sets has, is
  compared at once; the others are split again with all their sets. On the last level such a
  node is cut in chunks of SMALL / 2 sets that meet cell by cell, each pair of chunks in one cell.

No set leaves a node before it has met, or is already linked with, every other set of it.

Comparisons on tokens only propose: a pair passes if at least LOOSE of the tokens agree, which a pair
at the threshold fails once in a million, and a node gives no more rows than it has sets. What
they link is settled exactly: the sets of a proposed component meet whole, in cells of at most two
blocks of BLOCK sets, every pair of a cell is counted from its true intersection, and the links of
similarity THRESHOLD or more are summed for each document and give the classes. A component of n
blocks takes n * (n + 1) / 2 cells in as many tasks; no pair of rows is ever emitted. Runs are repeated until a
pair at exactly the threshold is proposed with probability RECALL (``runs_for``); above it, with more.

Words are what white space separates in the lower-cased text; a text of 1 to WIDTH - 1 words is
one shingle. Defined cases: a text without words, or null, is linked to nothing; a null doc_id is
a row like others and takes the class of its text; repeated rows are copies; a class is named by its
smallest non-null doc_id; an empty table gives no rows; further columns are ignored; whole texts are
read. Sets are named by 64-bit hashes of all their shingles.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, allot, documents, drop_all
from .graph import components, roots, stars

WIDTH, THRESHOLD = 5, 0.8
T, LEVELS, RECALL = 64, 5, 0.99999
SMALL, BLOCK = 8192, 256
LOOSE = 35


def runs_for(recall: float, similarity: float = THRESHOLD, levels: int = LEVELS) -> int:
    """Runs until a pair of a similarity has met with probability ``recall``: its common nodes are a branching process, of
    one or two chosen coordinates a node, each shared with probability ``similarity``; the runs are independent."""
    two, dead = 1 / THRESHOLD - 1, 0.0
    for _ in range(levels):
        lost = 1 - similarity + similarity * dead
        dead = (1 - two) * lost + two * lost * lost
    return math.ceil(math.log(1 - recall) / math.log(dead))


RUNS = runs_for(RECALL)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


class _Powers:
    """Powers of the rolling hash's base and of its inverse, grown as texts need."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, _BASE, np.uint64))])
                self.down = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, _INVERSE, np.uint64))])
        return self.up, self.down


_POWERS = _Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    raw = b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split())
    if not raw:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(raw, np.uint8)
    up, down = _POWERS.upto(len(b) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
        gaps = np.flatnonzero(b == 32)
        starts = np.concatenate([[0], gaps + 1])
        ends = np.concatenate([gaps, [len(b)]])
        k = min(width, len(starts))
        first, last = starts[: len(starts) - k + 1], ends[k - 1 :]
        return np.unique(_mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))


def _first_paths() -> list[tuple[int, int]]:
    """(run, coordinate) of the roots' choices."""
    rng = random.Random(23)
    return [(run, at) for run in range(RUNS) for at in rng.sample(range(T), 1 + (rng.random() < 1 / THRESHOLD - 1))]


_RANDOM = random.Random(17)
_SEEDS = np.array([_RANDOM.getrandbits(64) | 1 for _ in range(2 * T)], np.uint64)
_FIRST = np.array([at for _, at in _first_paths()])
_SALTS = np.array([_RANDOM.getrandbits(64) for _ in _FIRST], np.uint64)


def embedding(tokens: np.ndarray) -> tuple[bytes, np.ndarray]:
    """T minwise tokens, 2 bytes each, which comparisons read, and the nodes below the roots, named by whole
    64-bit tokens: sets that share none do not meet by chance, however many there are."""
    out = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(tokens), 4096):
            part = tokens[at : at + 4096, None]
            h = (part ^ _SEEDS[None, T:]) * _SEEDS[None, :T]
            out = np.minimum(out, (h ^ (h >> np.uint64(29))).min(axis=0))
        mixed = _mixed(out)
        return (mixed >> np.uint64(48)).astype(np.uint16).tobytes(), _mixed(mixed[_FIRST] ^ _SALTS).view(np.int64)


def _embedded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, sketches, paths = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            sizes.append(len(s))
            ids.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
            sketch, nodes = embedding(s) if len(s) else (None, None)
            sketches.append(sketch)
            paths.append(nodes)
        columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(paths, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "th", "id", "n", "sketch", "paths"])


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int]]:
    """Runs of equal first columns of sorted batches, as (table, first row, end); a run may span batches."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        key = table.column(0).to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        edge = 0
        for cut in cuts.tolist():
            yield table, edge, cut
            edge = cut
        rest = table.slice(edge).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest, 0, rest.num_rows


def _forest(s: np.ndarray, n: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Links (members, their neighbour) that connect what agrees on LOOSE of the tokens ``s`` (T rows, a column a
    set) and in size ``n``; sets of one ``root`` are connected already. A set meets all that no path reaches yet."""
    if len(n) <= 32:  # all pairs at once
        same = (s[:, :, None] == s[:, None, :]).sum(axis=0, dtype=np.uint8) >= LOOSE
        a, b = np.nonzero(np.triu(same & (np.minimum(n[:, None], n) >= THRESHOLD * np.maximum(n[:, None], n)), 1))
        if len(a):
            low = roots(len(n), a, b)
            for at in np.unique(low[b]).tolist():
                yield np.flatnonzero((low == at) & (np.arange(len(n)) != at)), at
        return
    left = np.arange(len(n))
    while len(left) > 1:
        reached = left[root[left] == root[left[0]]].tolist()
        left = left[root[left] != root[left[0]]]
        tokens, sizes = np.ascontiguousarray(s[:, left]), n[left]
        while reached and len(left):
            at = reached.pop()
            same = (tokens == s[:, at, None]).sum(axis=0, dtype=np.uint8) >= LOOSE
            hit = same & (np.minimum(sizes, n[at]) >= THRESHOLD * np.maximum(sizes, n[at]))
            if hit.any():
                yield left[hit], at
                gone = np.isin(root[left], root[left[hit]])
                reached += left[gone].tolist()
                left, tokens, sizes = left[~gone], np.ascontiguousarray(tokens[:, ~gone]), sizes[~gone]


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, id, n, sketch, root) sorted by node -> links of each node's sets that agree, one per set at most."""
    us, vs = [], []
    for table, first, end in grouped(batches):
        if end - first < 2:
            continue
        ids = table.column(1).slice(first, end - first).to_numpy()
        n = table.column(2).slice(first, end - first).to_numpy().astype(float)
        s = np.frombuffer(b"".join(table.column(3).slice(first, end - first).to_pylist()), np.uint16).reshape(-1, T)
        root = table.column(4).slice(first, end - first).to_numpy()
        for some, at in _forest(np.ascontiguousarray(s.T), n, root):
            us += ids[some].tolist()
            vs += [int(ids[at])] * len(some)
        if len(us) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
            us, vs = [], []
    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _token(at: Column) -> Column:
    """The embedded token of a coordinate."""
    return F.substring("sketch", (at * 2 + 1).cast("int"), F.lit(2))


def _children(node: Column) -> Column:
    """The nodes that a set of ``node`` goes to."""
    one = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(T))
    two = F.pmod(F.xxhash64(node, F.lit(2)), F.lit(T))
    second = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(1000)) < round(1000 * (1 / THRESHOLD - 1))
    name = lambda at: F.xxhash64(node, at, _token(at))
    return F.when(second & (one != two), F.array(name(one), name(two))).otherwise(F.array(name(one)))


def _brute(rows: DataFrame) -> DataFrame:
    """Links of nodes of bounded work: (node, id, n, sketch, root); a task gives at most one for each set it holds."""
    return rows.repartition("node").sortWithinPartitions("node", "id").mapInArrow(lambda batches: stars(_propose(batches)), "u long, v long")


def proposals(sets: DataFrame) -> DataFrame:
    """(u, v): links proposed among ``sets`` (id, n, sketch, paths)."""
    rows = sets.select(F.explode("paths").alias("node"), "id")
    held: list[Table] = []
    sets = sets.select("id", "n", "sketch")
    out: DataFrame | None = None
    linked: Table | None = None
    for level in range(1, LEVELS + 1):
        nodes = Table(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "nodes")
        member = rows.join(nodes.df.hint("merge"), "node").join(sets.hint("merge"), "id")
        found = Table(_brute(member.where(F.col("size") <= SMALL).select("node", "id", "n", "sketch", F.col("id").alias("root"))), "links")
        out = found.df if out is None else out.union(found.df)
        if nodes.df.where(F.col("size") > SMALL).isEmpty():
            drop_all([nodes, *held])
            break
        large = Table(member.where(F.col("size") > SMALL).select("node", "id", "n", "sketch", "size"), "large")
        drop_all([nodes, *held])
        # A node's leader is its set of smallest hash; minima combine on the map side.
        heads = large.df.groupBy("node").agg(F.min(F.struct(F.xxhash64("node", "id").alias("h"), "id", "n", "sketch")).alias("m")).select("node", F.col("m.id").alias("leader"), F.col("m.n").alias("n2"), F.col("m.sketch").alias("sketch2"))
        led = large.df.join(heads.hint("merge"), "node").where("id <> leader")
        links = Table(led.select("id", "leader", "n", "n2", "sketch", "sketch2").mapInArrow(lambda batches: stars(_agreeing(batches)), "u long, v long"), "links")
        out = out.union(links.df)
        if linked is None:
            linked = components(out)
        # Sets that the first level has linked already meet whole later on: pairs across components are what is left.
        rooted = Table(large.df.join(linked.df.hint("merge"), "id", "left").select("node", "id", "n", "sketch", "size", F.coalesce("root", "id").alias("root")), "rooted")
        pairs = (F.pow(F.sum("c"), 2) - F.sum(F.col("c") * F.col("c"))) / 2
        open_ = rooted.df.groupBy("node", "root").agg(F.count("*").cast("double").alias("c")).groupBy("node").agg(pairs.alias("pairs")).where("pairs > 0")
        mixed = Table(rooted.df.join(open_.hint("merge"), "node").withColumn("few", (F.col("pairs") <= SMALL * SMALL // 2) & (F.col("size") <= 32 * SMALL)), "mixed")
        out = out.union(Table(_brute(mixed.df.where("few").select("node", "id", "n", "sketch", "root")), "links").df)
        split = mixed.df.where("NOT few")
        if split.isEmpty():
            drop_all([large, rooted, mixed])
            break
        if level == LEVELS:
            blocks = F.ceil(F.col("size") / max(1, SMALL // 2))
            placed = split.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "node"), F.col("blocks")))
            cells = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
            cell = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
            out = out.union(Table(_brute(cells.select(cell.alias("node"), "id", "n", "sketch", "root")), "links").df)
        else:
            held = [Table(split.select(F.explode(_children(F.col("node"))).alias("node"), "id"), "paths")]
            rows = held[0].df
        drop_all([large, rooted, mixed])
    if linked is not None:
        linked.drop()
    return out


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, leader, n, n2, sketch, sketch2) -> (id, leader) of those that agree on LOOSE tokens."""
    for batch in batches:
        n, n2 = (batch.column(c).to_numpy().astype(float) for c in (2, 3))
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, T) for c in (4, 5))
        keep = pa.array(((a == b).sum(axis=1) >= LOOSE) & (np.minimum(n, n2) >= THRESHOLD * np.maximum(n, n2)))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])


def _cell_links(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i in first, j in second, i < j) of similarity THRESHOLD or more, from true intersections."""
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = number[code[keep]], owner[keep]
    inter = np.zeros((len(first), len(second)), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    step = 4096
    for low in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(code, [low, low + step])
        m = np.zeros((len(sets), step), np.float32)
        m[owner[a:b], code[a:b] - low] = 1
        inter += m[first] @ m[second].T
    both = sizes[first][:, None] + sizes[second][None, :] - inter
    # in whole numbers: inter / union >= 0.8
    i, j = np.nonzero((inter * 10 >= both * round(THRESHOLD * 10)) & (first[:, None] < second[None, :]))
    return first[i], second[j]


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, block, pair, id, copies, text) sorted by cell -> (id, texts, docs, root): links of each
    set within the cell, and the smallest linked member."""
    for table, first, end in grouped(batches):
        t = table.slice(first, end - first)
        seen: dict[int, int] = {}
        for i, x in enumerate(t.column("id").to_pylist()):
            seen.setdefault(x, i)
        at = list(seen.values())
        ids = np.array(list(seen), np.int64)
        text = t.column("text")
        sets = [shingles(text[i].as_py()) for i in at]
        copies = t.column("copies").to_numpy()[at]
        block = t.column("block").to_numpy()[at]
        inside = t.column("same").to_numpy(zero_copy_only=False)[at[0]]
        every = np.arange(len(at))
        if inside:
            a, b = _cell_links(sets, every, every)
        else:
            low = block == block.min()
            x, y = every[low], every[~low]
            if not len(y):
                continue
            flip = np.concatenate([x, y])
            sets = [sets[i] for i in flip]
            ids, copies = ids[flip], copies[flip]
            a, b = _cell_links(sets, np.arange(len(x)), np.arange(len(x), len(flip)))
        if not len(a):
            continue
        n = len(ids)
        texts = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        docs = np.bincount(a, weights=copies[b], minlength=n) + np.bincount(b, weights=copies[a], minlength=n)
        root = roots(n, a, b)
        some = np.flatnonzero(texts)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(texts[some].astype(np.int64)), pa.array(docs[some].astype(np.int64)), pa.array(ids[root[some]])], ["id", "texts", "docs", "root"])


def settle(docs: DataFrame, reps: DataFrame, groups: DataFrame) -> Table:
    """(id, texts, docs, root) partial links from the cells of the proposed components ``groups`` (id, root)."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("members"))
    placed = groups.join(sizes, "root").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = placed.select("id", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cell = F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("cell")
    cells = cells.select(cell, "block", (F.col("block") == F.col("other")).alias("same"), "id")
    wanted = Table(cells.join(reps.hint("merge"), "id").select("cell", "block", "same", "id", "copies", "doc_id", "th"), "cells")
    texts = documents(docs).where(F.col("text").isNotNull()).withColumn("th", F.xxhash64("text"))
    named = wanted.df.withColumnRenamed("doc_id", "doc_id2").withColumnRenamed("th", "th2")
    met = texts.join(named.hint("merge"), (F.col("th") == F.col("th2")) & F.col("doc_id").eqNullSafe(F.col("doc_id2"))).select("cell", "block", "same", "id", "copies", "text")
    out = Table(met.repartition("cell").sortWithinPartitions("cell").mapInArrow(_exact, "id long, texts long, docs long, root long"), "settled")
    wanted.drop()
    return out


def classes(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, th (hash of its text), class_id, n_links, n_linked_texts, n_copies, kept."""
    hashed = documents(docs).withColumn("th", F.xxhash64("text"))
    every = Table(hashed.mapInArrow(_embedded, "doc_id long, th long, id long, n int, sketch binary, paths array<long>").withColumn("rid", F.monotonically_increasing_id()), "sets")
    named = every.df.where(F.col("id").isNotNull())
    reps = Table(
        named.groupBy("id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "th")).alias("m"), F.max(F.struct("n", "sketch", "paths")).alias("s")).select("id", "copies", "low", F.col("m.doc_id").alias("doc_id"), F.col("m.th").alias("th"), F.col("s.n").alias("n"), F.col("s.sketch").alias("sketch"), F.col("s.paths").alias("paths")),
        "reps",
    )
    groups = components(proposals(reps.df.select("id", "n", "sketch", "paths")))
    exact = settle(docs, reps.df.select("id", "copies", "doc_id", "th"), groups.df)
    true = components(exact.df.select(F.col("id").alias("u"), F.col("root").alias("v")))
    counts = exact.df.groupBy("id").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("linked"))
    each = reps.df.select("id", "copies", "low").join(true.df, "id", "left").join(counts, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = each.groupBy("root").agg(F.min("low").alias("class_id"))
    known = Table(each.join(lowest, "root").select("id", "root", "class_id", "copies", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("linked", F.lit(0)).alias("linked")), "classes").df
    rows = every.df.select("rid", "doc_id", "th", "id").join(known, "id", "left")
    # One row of a class stays: the one of smallest doc_id, then row number; minima combine on the map side.
    first = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("m")).select(F.col("m.rid").alias("rid"), F.lit(True).alias("first"))
    return rows.join(first, "rid", "left").select(
        "doc_id",
        "th",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce(F.col("linked") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.col("root").isNull() | F.coalesce("first", F.lit(False))).alias("kept"),
    )


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links (other documents of similarity THRESHOLD or more, copies included),
    n_linked_texts (distinct other sets among them), n_copies, kept (one row of each class)."""
    return classes(docs).drop("th")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each class, and all that are in none."""
    found = classes(docs).select(F.coalesce("doc_id", F.lit(-1)).alias("did"), "th", "kept")
    keys = Table(found.groupBy("did", "th").agg(F.count("*").alias("m"), F.sum(F.col("kept").cast("long")).alias("c")), "kept")
    return allot(docs, keys.df)
