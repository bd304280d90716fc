"""An inverted-file index: k-means centroids, rows assigned to their nearest, exact re-ranking of what is probed."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import Metric
from .search import BLOCK_ROWS, QUERY_ROWS, cells, matrix, nearest_join, packed, ranked

TRAIN_ROWS = 100_000
"""Centroids are fitted on at most so many rows, chosen by a hash of the id; every row is indexed."""


def _placed(x: np.ndarray, metric: Metric, reach: float) -> np.ndarray:
    """Vectors in a space where L2 order is the metric's order: unit length for cosine, one more column for
    the inner product (which makes all rows equally long)."""
    x = x.astype(np.float64)
    if metric is Metric.COSINE:
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    if metric is Metric.DOT:
        return np.hstack([x, np.sqrt(np.maximum(0.0, reach * reach - (x * x).sum(1)))[:, None]])
    return x


@dataclass(frozen=True)
class Index:
    metric: Metric
    centroids: np.ndarray
    reach: float
    nprobe: int = 1

    def to_json(self) -> str:
        return json.dumps({"metric": self.metric.value, "reach": self.reach, "nprobe": self.nprobe, "centroids": self.centroids.tolist()})

    @classmethod
    def from_json(cls, text: str) -> Index:
        d = json.loads(text)
        return cls(Metric.parse(d["metric"]), np.array(d["centroids"]), d["reach"], d["nprobe"])

    def _gaps(self, placed: np.ndarray) -> np.ndarray:
        return (placed**2).sum(1)[:, None] + (self.centroids**2).sum(1)[None, :] - 2 * placed @ self.centroids.T

    def _query_order(self, queries: np.ndarray) -> np.ndarray:
        """Lists of each query, nearest first."""
        q = queries.astype(np.float64)
        placed = np.hstack([q, np.zeros((len(q), 1))]) if self.metric is Metric.DOT else _placed(q, self.metric, self.reach)
        return np.argsort(self._gaps(placed), axis=1, kind="stable").astype(np.int32)

    def probe(self, query: Sequence[float], n: int) -> list[int]:
        return self._query_order(np.asarray(query, float)[None, :])[0][:n].tolist()

    def _with(self, rows: DataFrame, vector: str, field: T.StructField, made) -> DataFrame:
        at = rows.columns.index(vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(at), len(b.column(at)[0].as_py()))
                    yield pa.RecordBatch.from_arrays([*b.columns, made(x)], [*b.schema.names, field.name])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, field]))

    def assign(self, rows: DataFrame, vector: str = "vector") -> DataFrame:
        """``rows`` with ``list``, the nearest centroid's number."""
        return self._with(rows, vector, T.StructField("list", T.IntegerType()), lambda x: pa.array(self._gaps(_placed(x, self.metric, self.reach)).argmin(1).astype(np.int32)))

    def probes(self, queries: DataFrame, n: int, vector: str = "vector") -> DataFrame:
        """``queries`` with ``lists``, the n lists nearest to each."""
        return self._with(queries, vector, T.StructField("lists", T.ArrayType(T.IntegerType())), lambda x: pa.array(list(self._query_order(x)[:, :n])))


def fit(rows: DataFrame, n_lists: int, metric: Metric | str = Metric.L2, seed: int = 1, id: str = "doc_id", vector: str = "vector", rounds: int = 15, per_list: int | None = None) -> Index:
    """Centroids of k-means on a sample of at most TRAIN_ROWS rows, or ``per_list`` for each list if that is less."""
    metric = Metric.parse(metric)
    x = F.col(vector).cast("array<double>")
    square = F.aggregate(x, F.lit(0.0), lambda s, t: s + t * t)
    stats = rows.agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("reach")).first()
    reach = float(stats["reach"] or 0.0)
    most = min(TRAIN_ROWS, per_list * n_lists) if per_list else TRAIN_ROWS
    train = rows.where(F.pmod(F.xxhash64(F.lit(seed), id), F.lit(max(1, -(-stats["n"] // most)))) == 0)
    if metric is Metric.COSINE:
        train = train.select(F.transform(x, lambda t: F.when(square > 0, t / F.sqrt(square)).otherwise(F.lit(0.0))).alias("x"))
    elif metric is Metric.DOT:
        train = train.select(F.concat(x, F.array(F.sqrt(F.greatest(F.lit(0.0), F.lit(reach * reach) - square)))).alias("x"))
    else:
        train = train.select(x.alias("x"))
    model = KMeans(k=n_lists, seed=seed, maxIter=max(1, rounds), featuresCol="features").fit(train.select(array_to_vector("x").alias("features")))
    return Index(metric, np.array(model.clusterCenters()), reach)


def search_many(index: Index, corpus: DataFrame, queries: DataFrame, k: int, nprobe: int, id: str = "doc_id", vector: str = "vector", query_id: str = "query_id") -> DataFrame:
    """query_id, id, score, rank: each query meets the rows of its nprobe nearest lists, scored exactly.

    A list's rows are packed in blocks, and so are the queries that probe it; blocks meet by list, and a cell gives
    each query's k best. A corpus with a column ``list`` is not assigned again. Nothing is collected or broadcast.
    """
    lists = (corpus if "list" in corpus.columns else index.assign(corpus.select(id, vector), vector)).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("x"), "list")
    asked = index.probes(queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("q")), nprobe, "q").select("query_id", "q", F.explode("lists").alias("list"))
    kinds = dict(asked.dtypes)["query_id"], dict(lists.dtypes)["id"]

    def blocks(rows: DataFrame, key: str, most: int, name: str) -> DataFrame:
        sizes = rows.groupBy("list").agg(F.count("*").alias("size"))
        placed = rows.join(sizes, "list").withColumn("size", F.ceil(F.col("size") / most))
        return packed(placed, name, F.pmod(F.xxhash64(key), F.col("size")), "list", "size").drop("size")

    met = blocks(asked, "query_id", QUERY_ROWS, "qb").join(blocks(lists, "id", BLOCK_ROWS, "cb"), "list")
    return ranked(met.select("qb_rows", "cb_rows").mapInArrow(cells(index.metric, k), f"query_id {kinds[0]}, id {kinds[1]}, score double"), k)


def recall(index: Index, corpus: DataFrame, queries: DataFrame, k: int, nprobe: int) -> float:
    """Share of the true k nearest that the index finds."""
    true = nearest_join(queries, corpus, k, index.metric).select("query_id", "id")
    found = search_many(index, corpus, queries, k, nprobe).select("query_id", "id")
    return true.join(found, ["query_id", "id"], "left_semi").count() / max(1, true.count())


def calibrated(index: Index, rows: DataFrame, least: float, k: int = 10, sample: int = 256, id: str = "doc_id", vector: str = "vector") -> Index:
    """``index`` with the least number of lists, by doubling, that finds ``least`` of the true k nearest of ``sample``
    rows (chosen by a hash of the id), measured against exact search over all rows."""
    queries = rows.orderBy(F.xxhash64(F.lit(3), id), id).limit(sample).select(F.col(id).alias("query_id"), F.col(vector).alias("vector"))
    corpus = index.assign(rows.select(F.col(id).alias("doc_id"), F.col(vector).alias("vector")))
    true = nearest_join(queries, corpus.select("doc_id", "vector"), k, index.metric).select("query_id", "id").persist()
    need, n = true.count() * least, 1
    while n < len(index.centroids):
        found = search_many(index, corpus, queries, k, n).select("query_id", "id")
        if true.join(found, ["query_id", "id"], "left_semi").count() >= need:
            break
        n *= 2
    true.unpersist()
    return replace(index, nprobe=min(n, len(index.centroids)))
