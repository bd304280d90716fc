"""Exact k-nearest-neighbour search and join.

Scoring runs over Arrow batches in numpy; each task gives back its k best rows, and a global
TakeOrderedAndProject or a window over k rows per task and query finishes. Ties go to the smaller
id, and ranks use unrounded scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distance import scores
from ..types import Metric

BROADCAST_BYTES = 64 << 20
"""Queries of a join up to this size go to every task; beyond it they meet the corpus block by block."""
BLOCK_ROWS, QUERY_ROWS, PART = 8192, 4096, 256
"""Corpus rows and queries of a cell, so often is either side sent; queries that a cell scores at once."""


def matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) != len(column) * dimension:
        raise ValueError(f"dimension mismatch: expected {dimension}, got vectors of other lengths")
    return values.reshape(len(column), dimension)


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores and of all that tie with the k-th."""
    if k <= 0:
        return np.zeros(0, np.int64)
    if len(score) <= k:
        return np.arange(len(score))
    s = np.where(np.isnan(score), np.inf, score)
    return np.flatnonzero(s <= np.partition(s, k - 1)[k - 1])


def nearest(corpus: DataFrame, query: Sequence[float], k: int, metric: Metric | str = Metric.L2, id: str = "doc_id", vector: str = "vector") -> DataFrame:
    """The k rows of ``corpus`` nearest to ``query``, all its columns and ``score``, in order."""
    metric = Metric.parse(metric)
    q = np.asarray(query, np.float64)[None, :]
    at = corpus.columns.index(vector)
    tie = corpus.columns.index(id)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in corpus.dtypes), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            s = scores(metric, matrix(batch.column(at), q.shape[1]), q)[0]
            keep = pa.array(best(s, k))
            part = pa.Table.from_batches([batch.take(keep)]).append_column("score", pa.array(s[keep.to_numpy()]))
            kept = part if kept is None else pa.concat_tables([kept, part])
            if kept.num_rows > 4 * k + 64:  # no more than k and their ties stay per task
                kept = kept.sort_by([("score", "ascending"), (kept.column_names[tie], "ascending")]).slice(0, k)
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    found = corpus.where(F.col(vector).isNotNull()).mapInArrow(run, schema)
    return found.orderBy(F.col("score").asc(), F.col(id).asc()).limit(max(0, k))


def _joined(metric: Metric, k: int, q_ids: list, q: np.ndarray, ids: pa.Array, x: np.ndarray) -> pa.Table:
    s = scores(metric, x, q)
    rows, cols = [], []
    for i in range(len(q)):
        b = best(s[i], k)
        rows.append(np.full(len(b), i))
        cols.append(b)
    r, c = np.concatenate(rows), np.concatenate(cols)
    return pa.table({"query_id": pa.array(q_ids).take(pa.array(r)), "id": ids.take(pa.array(c)), "score": pa.array(s[r, c])})


def _pruned(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query, ties to the smaller id."""
    found = found.sort_by([("query_id", "ascending"), ("score", "ascending"), ("id", "ascending")]).combine_chunks()
    q = found.column("query_id").combine_chunks()
    fresh = np.flatnonzero(np.concatenate([[True], pc.not_equal(q[1:], q[:-1]).to_numpy(zero_copy_only=False)])) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(fresh, np.diff([*fresh, len(q)]))
    return found.filter(pa.array(place < k))


def _task_best(k: int, n_queries: int, parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Of what a task finds, batch by batch, the k best for each query."""
    held: list[pa.Table] = []
    for part in parts:
        held.append(part)
        if sum(t.num_rows for t in held) > 4 * k * n_queries + 4096:
            held = [_pruned(pa.concat_tables(held), k)]
    if held:
        yield from _pruned(pa.concat_tables(held), k).to_batches()


def nearest_join(queries: DataFrame, corpus: DataFrame, k: int, metric: Metric | str = Metric.L2, id: str = "doc_id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """query_id, id, score, rank: the k nearest corpus rows of every query. Queries go to all tasks if
    they are under BROADCAST_BYTES, else both sides are packed in blocks that meet cell by cell."""
    metric = Metric.parse(metric)
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("q"))
    c = corpus.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("x")).where(F.col("x").isNotNull())
    kinds = dict(q.dtypes)["query_id"], dict(c.dtypes)["id"]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    size = q.agg(F.sum(F.size("q")) * 8).first()[0] or 0
    if size <= BROADCAST_BYTES:
        rows = q.collect()
        if not rows:
            return q.sparkSession.createDataFrame([], f"{schema}, rank int")
        shared = q.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], np.array([r["q"] for r in rows])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, qm = shared.value
            parts = (_joined(metric, k, ids, qm, b.column(0), matrix(b.column(1), qm.shape[1])) for b in batches if b.num_rows)
            yield from _task_best(k, len(ids), parts)

        found = c.mapInArrow(run, schema)
    else:
        n_q, n_c = (max(1, -(-d.count() // n)) for d, n in ((q, QUERY_ROWS), (c, BLOCK_ROWS)))
        left = packed(q, "qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q))).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))))
        right = packed(c, "cb", F.pmod(F.xxhash64("id"), F.lit(n_c))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))
        found = left.join(right, ["qb", "cb"]).select("qb_rows", "cb_rows").mapInArrow(cells(metric, k), schema)
    return ranked(found, k)


def packed(rows: DataFrame, name: str, block: Column, *more: str) -> DataFrame:
    """A row for each block (and ``more`` keys): an array of its rows; blocks are of bounded size."""
    return rows.withColumn(name, block).groupBy(*more, name).agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in more])).alias(f"{name}_rows"))


def cells(metric: Metric, k: int):
    """A mapInArrow function: (array of (query_id, q), array of (id, x)) -> each query's k best in the cell."""

    def vectors(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
        ids, lists = rows.flatten()
        return ids, matrix(lists, len(lists.flatten()) // max(1, len(lists)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (q_ids, q), (ids, x) = (vectors(batch.column(c)[i].values) for c in (0, 1))
                for low in range(0, len(q), PART):
                    yield from _joined(metric, k, q_ids[low : low + PART].to_pylist(), q[low : low + PART], ids, x).to_batches()

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def metadata_or_null(fields: Sequence[str], meta: str | None = None) -> Column:
    """The struct of metadata, or null if every field is missing."""
    cols = [F.col(f"{meta}.`{f}`" if meta else f"`{f}`") for f in fields]
    if not cols:
        return F.lit(None)
    some = sum((c.isNotNull().cast("int") for c in cols), F.lit(0)) > 0
    return F.when(some, F.struct(*[c.alias(f) for c, f in zip(cols, fields, strict=True)]))
