"""Connected components of an edge table, without collecting links or labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, drop_all

ROUNDS = 60
CHUNK = 1 << 20
"""Links that a task contracts at once."""


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n members' components under links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) -> links that connect the same members, one less than a component of the chunk has."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def star() -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, code = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = roots(len(ids), code[: len(u)], code[len(u) :])
        leaf = root != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(ids[root[leaf]])], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(tuple(c.to_numpy() for c in batch.columns))
        if sum(len(u) for u, _ in held) >= CHUNK:
            yield star()
            held = []
    if held:
        yield star()


def forest(edges: DataFrame) -> DataFrame:
    """(u, v): what each task's share of the links connects, by one link for each member at most."""
    return edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").mapInArrow(stars, "u long, v long")


def components(edges: DataFrame) -> Table:
    """(id, root) for every end of the edges (u, v): root is the component's smallest id.

    Tasks contract their own links first, so a dense group, whatever its links, has one for each member and
    task. Then, each round, an id points to the first among its neighbours and itself, and the links are drawn
    anew between what their ends point to and contracted again; what has become one id goes. First is the smallest
    id, which draws the tasks' stars together, and in every other round the smallest of a hash that changes, by
    which ids fall by a constant factor on average whatever their order, in chains too. Minima are taken on the map
    side, so a hub costs one row a task; tables, not lineage, carry the state. Links that are left after ROUNDS
    rounds are an error.
    """
    links = Table(forest(edges).distinct(), "edges")
    steps: list[Table] = []
    while not links.df.isEmpty():
        if len(steps) == ROUNDS:
            raise RuntimeError(f"components have not come together in {ROUNDS} rounds")
        rank = lambda c: F.struct((F.xxhash64(F.lit(len(steps)), c) if len(steps) % 2 else F.lit(0)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = links.df.select("u", rank("v").alias("r")).union(links.df.select(F.col("v").alias("u"), rank("u").alias("r")))
        least = both.groupBy("u").agg(F.min("r").alias("r"))
        step = Table(least.select(F.col("u").alias("id"), F.least(rank("u"), F.col("r"))["id"].alias("to")), "step")
        to = lambda end, new: step.df.select(F.col("id").alias(end), F.col("to").alias(new))  # noqa: B023, E731
        drawn = links.df.join(to("u", "a"), "u").join(to("v", "b"), "v").where("a <> b")
        moved = Table(forest(drawn.select(F.col("a").alias("u"), F.col("b").alias("v"))).distinct(), "edges")
        links.drop()
        links = moved
        steps.append(step)
    if not steps:
        return Table(links.df.select(F.col("u").alias("id"), F.col("v").alias("root")), "labels")
    at = steps[-1].df
    for step in reversed(steps[:-1]):
        later = at.select(F.col("id").alias("to"), F.col("to").alias("last"))
        at = step.df.join(later, "to", "left").select("id", F.coalesce("last", "to").alias("to"))
    ends = Table(at, "ends")
    low = ends.df.groupBy("to").agg(F.min("id").alias("root"))
    out = Table(ends.df.join(low, "to").select("id", "root"), "labels")
    drop_all([links, ends, *steps])
    return out
