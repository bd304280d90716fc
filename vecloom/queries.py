"""Driver queries over the operators, each with the SQL that DuckDB runs on the same tables.

The corpus is ``embeddings`` with metadata from ``documents`` and ``labels``; the mutation log is
``events``: errors delete, views update metadata, the rest upsert; seq is event_id + 1.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import workloads
from .database import Collection, Database
from .fs import Files
from .fs import shared_folder as _shared_folder
from .functions.distance import distance, rounded
from .operators import ann, evaluate, maintenance, oplog, search
from .plans import planner
from .plans.filters import And, Eq, Exists, Filter, In, Range, compile
from .sources import vectorfiles
from .streaming import apply as stream
from .streaming.compactor import Compactor
from .types import CollectionSchema, CompactionParams, FieldSchema, FieldType, MetadataSchema, Metric, SegmentParams, WriteToken

Query = Callable[[SparkSession, str], DataFrame]

META = MetadataSchema(
    (
        FieldSchema(0, "lang", FieldType.STRING, True),
        FieldSchema(1, "source", FieldType.STRING, True),
        FieldSchema(2, "n_chars", FieldType.INT64, True),
        FieldSchema(3, "quality", FieldType.INT64, True),
        FieldSchema(4, "toxic", FieldType.INT64, True),
    )
)
K = 10
ASKED = "vec_id % 100 = 0"
"""The query set of joins and index searches, against all rows."""
CAPACITY = 256
COMPACTION = CompactionParams(num_levels=4, level_count_multiplier=2, tombstone_threshold=0.2)


# ---- tables ----


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding and the metadata fields, null where missing."""
    return _with_metadata(spark, sf_dir, _table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _with_metadata(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source", "n_chars")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    return rows.join(docs, "vec_id", "left").join(labels, "vec_id", "left")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mutation log: seq, op, doc_id, v, kind (every write), amount (purchases only)."""
    e = _table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        F.when(kind == "error", "delete").when(kind == "view", "update_metadata").otherwise("upsert").alias("op"),
        F.col("user_id").alias("doc_id"),
        F.when(~kind.isin("error", "view"), F.col("value")).alias("v"),
        F.when(kind != "error", kind).alias("kind"),
        F.when(kind == "purchase", F.col("value")).alias("amount"),
    )


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(_table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


# ---- search ----


def _knn(metric: Metric, zero: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        q = _query_vector(spark, sf_dir)
        hits = search.nearest(vectors, [0.0] * len(q) if zero else q, K, metric, "vec_id", "embedding")
        return hits.select("vec_id", rounded(F.col("score")).alias("score"))

    return run


def _knn_sql_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search in SQL expressions alone: a TakeOrderedAndProject over higher-order functions."""
    q = F.array(*[F.lit(x) for x in _query_vector(spark, sf_dir)])
    scored = _table(spark, sf_dir, "embeddings").select("vec_id", distance(Metric.L2, F.col("embedding"), q).alias("score"))
    return scored.orderBy("score", "vec_id").limit(K).select("vec_id", rounded(F.col("score")).alias("score"))


def knn_include_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K nearest first, then the metadata of those."""
    hits = search.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _query_vector(spark, sf_dir), K, Metric.L2, "vec_id", "embedding")
    return _with_metadata(spark, sf_dir, F.broadcast(hits.select("vec_id", "score"))).select("vec_id", rounded(F.col("score")).alias("score"), *[f.name for f in META.fields])


def knn_include_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _query_vector(spark, sf_dir), K, Metric.L2, "vec_id", "embedding")
    return hits.select("vec_id", F.posexplode("embedding").alias("pos", "val")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("val").cast("double").alias("val"))


def _filtered(expr: Filter) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = corpus(spark, sf_dir).where(compile(expr, META, None)).select("vec_id", "embedding")
        hits = search.nearest(base, _query_vector(spark, sf_dir), K, Metric.L2, "vec_id", "embedding")
        return hits.select("vec_id", rounded(F.col("score")).alias("score"))

    return run


FILTERS: dict[str, tuple[Filter, str]] = {
    "filter_eq": (Eq(0, "en"), "lang = 'en'"),
    "filter_in": (In(1, ("src1", "src2", "src3")), "source IN ('src1', 'src2', 'src3')"),
    "filter_range": (Range(2, 500, 1500), "n_chars BETWEEN 500 AND 1500"),
    "filter_range_open": (Range(2, gte=2000), "n_chars >= 2000"),
    "filter_exists": (Exists(3), "quality IS NOT NULL"),
    "filter_and": (And((Eq(0, "en"), Range(2, lte=3000), Exists(3))), "lang = 'en' AND n_chars <= 3000 AND quality IS NOT NULL"),
    "filter_and_empty": (And(()), "true"),
    "filter_type_mismatch": (Eq(2, "500"), "false"),
    "filter_unknown_field": (Exists(99), "false"),
}


def filter_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each filter, all counted in one pass, and the strategy the planner takes where there is an index."""
    counts = corpus(spark, sf_dir).drop("embedding").agg(*[F.count_if(compile(expr, META, None)).alias(name) for name, (expr, _) in FILTERS.items()])
    each = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n_matched")) for n in FILTERS])).alias("x")).select("x.*")
    return each.select("name", "n_matched", F.when(F.col("n_matched") <= planner.EXACT_LIMIT, "exact").otherwise("post_filter").alias("strategy"))


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where(ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _knn_join(metric: Metric) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        found = search.nearest_join(_queries(vectors), vectors, K, metric, "vec_id", "embedding")
        return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), rounded(F.col("score")).alias("score"))

    return run


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _table(spark, sf_dir, "embeddings").where(F.col("vec_id") == 7)
    return one.select("vec_id", F.posexplode("embedding").alias("pos", "val")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("val").cast("double").alias("val"))


def _indexed(spark: SparkSession, sf_dir: str, ef_search: int = 50) -> Collection:
    """A collection of all vectors with their metadata, and an index."""
    c = _filled(spark, sf_dir, SegmentParams(segment_capacity=300, ef_search=ef_search))
    c.build_index()
    return c


def ann_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index search of the join's queries, all lists probed and re-ranked: the exact neighbours."""
    c = _indexed(spark, sf_dir)
    index = c._index(c.manifest.index)
    queries = _queries(_table(spark, sf_dir, "embeddings"))
    found = ann.search_many(index, c.rows().select("doc_id", "vector", "list"), queries, 2 * K, len(index.centroids))
    placed = found.select("query_id", F.col("id").cast("long").alias("vec_id"), "score")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")  # ids of a collection are text: ties in order of number
    return placed.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= K).select("query_id", "vec_id", "rank", rounded(F.col("score")).alias("score"))


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the lists that the index chooses to probe find 0.9 of the true neighbours."""
    c = _indexed(spark, sf_dir)
    index, queries, rows = c._index(c.manifest.index), _queries(_table(spark, sf_dir, "embeddings")), c.rows()
    true = search.nearest_join(queries, rows.select("doc_id", "vector"), K, Metric.L2)
    found = ann.search_many(index, rows.select("doc_id", "vector", "list"), queries, K, index.nprobe)
    hits = found.select("query_id", "id", F.lit(1).alias("hit"))
    return true.join(hits, ["query_id", "id"], "left").agg(F.count_distinct("query_id").alias("n_queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_is_enough"))


def ann_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index candidates, over-fetched from all lists, of which those that match a filter stay."""
    c = _indexed(spark, sf_dir, ef_search=16 * 10**6)
    hits = c.search_df(_query_vector(spark, sf_dir), K, FILTERS["filter_eq"][0], strategy="post_filter")
    return hits.select(F.col("doc_id").cast("long").alias("vec_id"), rounded(F.col("score")).alias("score"))


def index_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a list of the index after an index build, merges and later writes: all of them."""
    c = _indexed(spark, sf_dir)
    rows = _table(spark, sf_dir, "embeddings").where("label % 2 = 0").select(F.concat(F.lit("again_"), F.col("vec_id")).alias("doc_id"), F.col("embedding").alias("vector"))
    c.ingest(rows)
    c.compact()
    c.ingest(rows)
    return c.rows().agg(F.count("*").alias("n_rows"), F.count("list").alias("n_listed"))


# ---- mutations ----


def live_state_after_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.fold(ops(spark, sf_dir), "v", ["kind", "amount"]).select("doc_id", "v", "kind", "amount", "birth")


def live_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.fold(ops(spark, sf_dir), "v").agg(F.count("*").alias("n_live"))


def deleted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ops(spark, sf_dir)
    return o.select("doc_id").distinct().join(oplog.fold(o, "v"), "doc_id", "left_anti").select("doc_id")


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose amount came from an earlier write than their kind."""
    return oplog.fold(ops(spark, sf_dir), "v", ["kind", "amount"]).where("amount IS NOT NULL AND kind <> 'purchase'").select("doc_id", "kind", "amount")


def batch_dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    batch = e.select(F.floor(F.col("event_id") / 500).cast("long").alias("batch"), F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), "value")
    return oplog.last_of_batch(batch, ("batch", "doc_id"), "pos")


def _live_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, embedding of live documents; an upsert's vector is that of event_id modulo the vectors."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    o = ops(spark, sf_dir).withColumn("v", F.when(F.col("op") == "upsert", (F.col("seq") - 1) % n))
    return oplog.fold(o, "v").select("doc_id", F.col("v").alias("vec_id")).join(vectors, "vec_id").select("doc_id", "vec_id", "embedding")


def knn_after_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.nearest(_live_vectors(spark, sf_dir), _query_vector(spark, sf_dir), K, Metric.L2, "doc_id", "embedding")
    return hits.select("doc_id", "vec_id", rounded(F.col("score")).alias("score"))


def doc_ord_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.births(ops(spark, sf_dir)).select("doc_id", "seq", "doc_ord")


# ---- maintenance: every upsert takes the next slot, CAPACITY slots make a segment ----


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ops(spark, sf_dir)
    up = oplog.numbered(o.where("op = 'upsert'").select("seq", "doc_id"), "seq", "slot")
    last = oplog.fold(o.withColumn("s", F.when(F.col("op") == "upsert", F.col("seq"))), "s").select("doc_id", F.col("s").alias("live_seq"))
    seg = F.floor(F.col("slot") / CAPACITY)
    return up.join(last, "doc_id", "left").select(
        seg.cast("int").alias("seg_id"), (F.col("slot") % CAPACITY).alias("internal_id"), (seg % COMPACTION.num_levels).cast("int").alias("level"), F.coalesce(F.col("seq") != F.col("live_seq"), F.lit(True)).alias("dead")
    )


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.segment_stats(_slots(spark, sf_dir))


def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("seg_id", "level", "num_vectors", "tombstones", "live", rounded(F.col("ratio")).alias("ratio"))


def tombstone_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).where("dead").select("seg_id", "internal_id")


def compaction_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.eligible_levels(_stats(spark, sf_dir), COMPACTION).select("level", "segments", rounded(F.col("worst")).alias("worst"))


def compaction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.candidates(_stats(spark, sf_dir), COMPACTION, 16)


# ---- evaluation ----


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of a search that a filter narrows, against the neighbours among all."""
    base = corpus(spark, sf_dir)
    expr, _ = FILTERS["filter_eq"]
    queries = _queries(base)
    found = [evaluate.hits_to_ids(search.nearest_join(queries, c, K, Metric.L2, "vec_id", "embedding")).withColumnRenamed("ids", n) for c, n in ((base, "truth"), (base.where(compile(expr, META, None)), "result"))]
    return found[0].join(found[1], "query_id", "left").select("query_id", F.round(evaluate.recall_at_k(F.col("truth"), F.coalesce("result", F.array().cast("array<bigint>")), K), 6).alias("recall"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.percentiles(_table(spark, sf_dir, "events"), "value", (50.0, 95.0, 99.0))


def latency_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return evaluate.latency_summary(e, "value", ("event_type",)).withColumn("avg", F.round("avg", 6))


def vector_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors are held by how many live documents."""
    return evaluate.multiplicity(_live_vectors(spark, sf_dir), "embedding").groupBy(F.col("n").alias("held_by")).agg(F.count("*").alias("n_vectors"))


# ---- end to end ----


def _long(rows: DataFrame, kind: str = "double") -> DataFrame:
    """idx, vector -> vec_id, pos, val."""
    return rows.select("idx", F.posexplode("vector").alias("pos", "val")).select(F.col("idx").alias("vec_id"), F.col("pos").cast("long").alias("pos"), F.col("val").cast(kind).alias("val"))


def _in_order(spark: SparkSession, sf_dir: str, vector: Column) -> DataFrame:
    """A column ``vector`` of all embeddings in order of vec_id: tasks write files in the order of ranges."""
    return _table(spark, sf_dir, "embeddings").select("vec_id", vector.alias("vector")).orderBy("vec_id")


def fvecs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_shared_folder(spark)}/x.fvecs"
    vectorfiles.write_vectors(_in_order(spark, sf_dir, F.col("embedding")), path, "fvecs")
    return _long(vectorfiles.load_vectors(spark, path))


def bvecs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components in steps of 1/100 as bytes, written and read by file name."""
    path = f"{_shared_folder(spark)}/x.bvecs"
    step = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 100).cast("int"))
    vectorfiles.write_vectors(_in_order(spark, sf_dir, step), path, "bvecs")
    return _long(vectorfiles.load_vectors(spark, path), "long")


def ivecs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_shared_folder(spark)}/x.ivecs"
    vectorfiles.write_vectors(_in_order(spark, sf_dir, F.array("vec_id", -F.col("vec_id"), "label").cast("array<int>")), path, "ivecs")
    return _long(vectorfiles.read_ivecs(spark, path), "long")


def raw_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headerless vectors, written twice: the second write's rows come after the first's."""
    path = _shared_folder(spark)
    rows = _in_order(spark, sf_dir, F.col("embedding"))
    for _ in range(2):
        vectorfiles.write_vectors(rows, path)
    return _long(vectorfiles.read_raw(spark, path, len(_query_vector(spark, sf_dir))))


def groundtruth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true neighbours of all queries as an ivecs file, of which the first five are read as document ids."""
    path = f"{_shared_folder(spark)}/x.ivecs"
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = evaluate.hits_to_ids(search.nearest_join(_queries(vectors), vectors, K, Metric.L2, "vec_id", "embedding"))
    vectorfiles.write_vectors(near.orderBy("query_id").select(F.col("ids").cast("array<int>").alias("vector")), path, "ivecs")
    return vectorfiles.load_groundtruth(spark, path, 5).select("query_id", F.posexplode("ids").alias("pos", "doc_id")).select("query_id", F.col("pos").cast("long").alias("pos"), "doc_id")


def query_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subset of queries by seed: as many as asked for, each one once, and the same again."""
    q = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"))
    one, two = (evaluate.query_subset(q, 50, 42) for _ in range(2))
    return one.join(two.withColumn("again", F.lit(1)), "query_id", "left").agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("n_distinct"), F.count("again").alias("n_again"))


def _collection(spark: SparkSession, dim: int, meta: MetadataSchema, base: str | None = None, **params) -> Collection:
    schema = CollectionSchema("c", dim, Metric.L2, **{"segment_params": SegmentParams(segment_capacity=300), "metadata_schema": meta, **params})
    return Database(spark, base or _shared_folder(spark)).create_collection(schema)


def _filled(spark: SparkSession, sf_dir: str, segments: SegmentParams | None = None, base: str | None = None) -> Collection:
    """All vectors with their metadata, in a new collection."""
    c = _collection(spark, len(_query_vector(spark, sf_dir)), META, base, segment_params=segments or SegmentParams(segment_capacity=300), compaction_params=CompactionParams(num_levels=3, level_count_multiplier=1))
    c.ingest(corpus(spark, sf_dir).withColumnRenamed("embedding", "vector").withColumn("doc_id", F.col("vec_id").cast("string")))
    return c


def _shown(c: Collection) -> DataFrame:
    """Live rows: doc_id, the vector's first component, metadata."""
    return c.rows().select("doc_id", F.col("vector")[0].cast("double").alias("v0"), *[f"meta.{f}" for f in c._fields])


def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection as another database object opens it."""
    base = _shared_folder(spark)
    _filled(spark, sf_dir, base=base)
    return _shown(Database(spark, base).collection("c")).select(F.col("doc_id").cast("long").alias("vec_id"), "v0", *[f.name for f in META.fields])


def ingested_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headerless file as documents doc_0, doc_1 and so on, searched."""
    path, q = _shared_folder(spark), _query_vector(spark, sf_dir)
    vectorfiles.write_vectors(_in_order(spark, sf_dir, F.col("embedding")), path)
    c = _collection(spark, len(q), META)
    c.ingest_file(path)
    return c.search_df(q, K).select("doc_id", rounded(F.col("score")).alias("score"))


NATIONS = MetadataSchema((FieldSchema(0, "name", FieldType.STRING), FieldSchema(1, "region", FieldType.INT64), FieldSchema(2, "size", FieldType.FLOAT64)))


def _nations(spark: SparkSession, sf_dir: str) -> list[Row]:
    return _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # a table of 25 rows


def _written(spark: SparkSession, sf_dir: str, base: str | None = None, **params) -> tuple[Collection, WriteToken]:
    """All nations upserted in one batch, then deleted (region 0), renamed (region 1) or written again (region 2) one by one."""
    c, rows = _collection(spark, 2, NATIONS, base, **params), _nations(spark, sf_dir)
    c.upsert_batch([(str(r.n_nationkey), [float(r.n_nationkey), 1.0], {"name": r.n_name, "region": int(r.n_regionkey)}) for r in rows])
    token = WriteToken(1)
    for r in rows:
        if r.n_regionkey == 0:
            token = c.delete(str(r.n_nationkey))
        elif r.n_regionkey == 1:
            token = c.update_metadata(str(r.n_nationkey), {"name": r.n_name.lower()})
        elif r.n_regionkey == 2:
            token = c.upsert(str(r.n_nationkey), [float(-r.n_nationkey), 2.0], {"size": 0.5})
    return c, token


def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as written, before anything is applied."""
    c, _ = _written(spark, sf_dir)
    return c.pending().select("seq", "op", F.col("doc_id").cast("long").alias("n_nationkey"), F.col("vector")[0].cast("long").alias("v0"), "meta.name", "meta.region", "meta.size")


def log_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations that were logged and never applied, replayed as the collection is opened again."""
    base = _shared_folder(spark)
    _written(spark, sf_dir, base)
    return _shown(Database(spark, base).collection("c")).select(F.col("doc_id").cast("long").alias("n_nationkey"), F.col("v0").cast("long").alias("v0"), "name", "region", "size")


def write_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write's token, and what is visible before and after waiting for it."""
    c, token = _written(spark, sf_dir)
    before = c.visible_seq
    c.wait_visible(token)
    return spark.createDataFrame([(token.value, before, c.visible_seq, c.count())], "token long, visible_before long, visible_after long, n_live long")


def log_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log segments of 512 bytes: several before applying, the open one after."""
    c, _ = _written(spark, sf_dir, wal_segment_bytes=512)
    before = c.wal_segment_count
    c.apply()
    return spark.createDataFrame([(before > 1, c.wal_segment_count, c.pending() is None)], "rotated boolean, n_after long, nothing_pending boolean")


def metadata_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the schema says of metadata in which, by region, the name is right, a number, beside an unknown field, not
    finite, or missing; and the ids of the names it knows."""
    def judged(r: Row) -> tuple[int, str, str]:
        meta: dict = {0: {"name": r.n_name}, 1: {"name": int(r.n_nationkey)}, 2: {"name": r.n_name, "nation": 1}, 3: {"size": float("nan")}}.get(r.n_regionkey, {})
        try:
            NATIONS.validate(meta)
            said = "ok"
        except (TypeError, ValueError) as e:
            said = type(e).__name__
        return r.n_nationkey, said, ",".join(str(i) for i in sorted(NATIONS.names_to_ids(meta)))

    return spark.createDataFrame([judged(r) for r in _nations(spark, sf_dir)], "n_nationkey int, said string, field_ids string")


def compaction_under_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows after merges during which documents were deleted and written again: no write is lost."""
    c = _filled(spark, sf_dir, SegmentParams(segment_capacity=64))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    n = c.next_seq
    meta = F.lit(None).cast(c._meta_type).alias("meta")
    rows = vectors.where("label IN (1, 2)").select((F.col("vec_id") + n).alias("seq"), F.when(F.col("label") == 1, "delete").otherwise("upsert").alias("op"), F.col("vec_id").cast("string").alias("doc_id"), F.when(F.col("label") == 2, F.transform("embedding", lambda x: -x)).alias("vector"), meta)
    merge = c._merge

    def late(chosen: set[int], level: int) -> bool:
        """The writes land between a merge's snapshot and its publication."""
        write, number = c._write, []

        def after(frame: DataFrame, path: str) -> None:
            write(frame, path)
            if not number:
                number.append(1)
                Database(spark, c.files.root.rpartition("/")[0]).collection("c").apply_ops(rows)

        c._write = after
        try:
            return merge(chosen, level)
        finally:
            c._write = write

    c._merge = late
    c.compact_once()
    c._merge = merge
    c.compact()
    return c.rows().select(F.col("doc_id").cast("long").alias("vec_id"), F.col("vector")[0].cast("double").alias("v0"))


def compaction_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after merging everything that is eligible, with a third of the labels deleted."""
    c = _filled(spark, sf_dir, SegmentParams(segment_capacity=64))
    gone = _table(spark, sf_dir, "embeddings").where("label < 4").select((F.col("vec_id") + c.next_seq).alias("seq"), F.lit("delete").alias("op"), F.col("vec_id").cast("string").alias("doc_id"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast(c._meta_type).alias("meta"))
    c.apply_ops(gone)
    before, segments = c.count(), len(c.manifest.segments)
    c.compact()
    fewer = len(c.manifest.segments) < segments
    worst = max(s.tombstones / max(1, s.num_vectors) for s in c.manifest.segments if s.sealed)
    return c.rows().agg(F.lit(before).cast("long").alias("n_before"), F.count("*").alias("n_after"), F.lit(c.count()).cast("long").alias("n_counted"), F.lit(fewer).alias("fewer_segments"), F.lit(worst <= c.schema.compaction_params.tombstone_threshold).alias("below_threshold"))


def background_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes while a background thread merges: what lives, and whether it merged without an error."""
    c = _filled(spark, sf_dir, SegmentParams(segment_capacity=64))
    gone = _table(spark, sf_dir, "embeddings").where("label < 4").select((F.col("vec_id") + c.next_seq).alias("seq"), F.lit("delete").alias("op"), F.col("vec_id").cast("string").alias("doc_id"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast(c._meta_type).alias("meta"))
    with Compactor(c, interval=0.05) as worker:
        c.apply_ops(gone)
        worker.wait_idle(300)
    return c.rows().agg(F.count("*").alias("n_live"), F.sum(F.col("doc_id").cast("long")).alias("sum_of_ids"), F.lit(worker.merges > 0).alias("merged"), F.lit(len(worker.errors)).cast("long").alias("n_errors"))


def _files(spark: SparkSession, sf_dir: str) -> tuple[str, list[str]]:
    """A folder with all vectors as base.fvecs, the queries' as query.fvecs, and their true neighbours as truth.ivecs."""
    folder = _shared_folder(spark)
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = evaluate.hits_to_ids(search.nearest_join(_queries(vectors), vectors, K, Metric.L2, "vec_id", "embedding"))
    for rows, name in ((vectors.orderBy("vec_id").select(F.col("embedding").alias("vector")), "base.fvecs"), (_queries(vectors).orderBy("query_id"), "query.fvecs"), (near.orderBy("query_id").select(F.col("ids").cast("array<int>").alias("vector")), "truth.ivecs")):
        vectorfiles.write_vectors(rows, f"{folder}/{name}", name.partition(".")[2])
    return folder, ["--base-file", f"{folder}/base.fvecs", "--query-file", f"{folder}/query.fvecs"]


def verify_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verification run against the ground truth: exact search is right, index search nearly."""
    folder, files = _files(spark, sf_dir)
    out = workloads.run(spark, ["verify", *files, "--ground-truth-file", f"{folder}/truth.ivecs", "--num-queries", "5", "--segment-capacity", "300"])
    return spark.createDataFrame([(out["exact_recall"], len(out["exact_below_one"]), out["index_recall"] >= 0.9)], "exact_recall double, n_below_one long, index_is_enough boolean")


def verify_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, updates and deletes of base vectors, ties among them, each checked by search."""
    _, files = _files(spark, sf_dir)
    out = workloads.run(spark, ["verify", "--mode", "mutation", *files, "--num-mutations", "60", "--concurrency", "4", "--segment-capacity", "300"])
    return spark.createDataFrame([(out["checked"], out["passed"])], "checked long, passed boolean")


def bench_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search and a write benchmark, with their summary read back from JSON."""
    _, files = _files(spark, sf_dir)
    rows = []
    for mode, more in (("search", ["--num-queries", "4", "--warmup-queries", "0"]), ("write", ["--num-writes", "20"])):
        kept = Files(spark, _shared_folder(spark))
        out = workloads.run(spark, ["bench", "--mode", mode, *files, *more, "--segment-capacity", "300", "--save-summary", kept.at("summary.json")])
        back = json.loads(kept.read(kept.at("summary.json")))
        rows.append((back["mode"], back["n"] if mode == "search" else back["write"]["n"], back == out, back.get("recall")))
    return spark.createDataFrame(rows, "mode string, n long, saved boolean, recall double")


def collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk ingest with metadata into segments, then a filtered search of the snapshot."""
    hits = _filled(spark, sf_dir).search_df(_query_vector(spark, sf_dir), K, FILTERS["filter_and"][0], include_metadata=True)
    return hits.select(F.col("doc_id").cast("long").alias("vec_id"), rounded(F.col("score")).alias("score"), "metadata.n_chars", "metadata.quality")


def streaming_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as a stream of three files and folded batch by batch into snapshots of a collection."""
    meta = MetadataSchema((FieldSchema(0, "kind", FieldType.STRING), FieldSchema(1, "amount", FieldType.FLOAT64)))
    c = _collection(spark, 1, meta)
    o = ops(spark, sf_dir)
    vector = F.when(F.col("op") == "upsert", F.array((F.col("seq") % 1000).cast("float")))
    typed = o.select("seq", "op", F.col("doc_id").cast("string").alias("doc_id"), vector.alias("vector"), F.struct("kind", "amount", F.lit(None).cast("boolean").alias("_")).alias("meta"))
    folder = _shared_folder(spark)
    last = o.agg(F.max("seq")).first()[0] or 0
    for i in range(3):
        typed.where((F.col("seq") > last * i // 3) & (F.col("seq") <= last * (i + 1) // 3)).coalesce(1).write.mode("append").parquet(f"{folder}/ops")
    source = spark.readStream.schema(typed.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/ops")
    query = stream.start(c, f"{folder}/progress", once=True, source=source)
    query.awaitTermination()
    return c.rows().select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vector")[0].cast("long").alias("v"), "meta.kind", "meta.amount")


QUERIES: dict[str, Query] = {
    "knn_l2": _knn(Metric.L2),
    "knn_cosine": _knn(Metric.COSINE),
    "knn_dot": _knn(Metric.DOT),
    "knn_cosine_zero_query": _knn(Metric.COSINE, zero=True),
    "knn_l2_sql": _knn_sql_engine,
    "knn_include_metadata": knn_include_metadata,
    "knn_include_vector": knn_include_vector,
    **{name: _filtered(expr) for name, (expr, _) in FILTERS.items()},
    "filter_match_count": filter_match_count,
    "knn_join_l2": _knn_join(Metric.L2),
    "knn_join_cosine": _knn_join(Metric.COSINE),
    "knn_join_dot": _knn_join(Metric.DOT),
    "point_lookup": point_lookup,
    "ann_ivf": ann_ivf,
    "ann_recall": ann_recall,
    "ann_post_filter": ann_post_filter,
    "index_after_compaction": index_after_compaction,
    "live_state_after_ops": live_state_after_ops,
    "live_count": live_count,
    "deleted_ids": deleted_ids,
    "metadata_merge": metadata_merge,
    "batch_dedup_last_wins": batch_dedup_last_wins,
    "knn_after_mutations": knn_after_mutations,
    "doc_ord_assignment": doc_ord_assignment,
    "segment_stats": segment_stats,
    "tombstone_set": tombstone_set,
    "compaction_triggers": compaction_triggers,
    "compaction_candidates": compaction_candidates,
    "recall_at_k": recall_at_k,
    "latency_percentiles": latency_percentiles,
    "latency_by_type": latency_by_type,
    "vector_multiplicity": vector_multiplicity,
    "fvecs_roundtrip": fvecs_roundtrip,
    "bvecs_roundtrip": bvecs_roundtrip,
    "ivecs_roundtrip": ivecs_roundtrip,
    "raw_append": raw_append,
    "groundtruth": groundtruth,
    "query_subset": query_subset,
    "collection_search": collection_search,
    "reopened": reopened,
    "ingested_file": ingested_file,
    "log_scan": log_scan,
    "log_recovery": log_recovery,
    "write_visibility": write_visibility,
    "log_truncation": log_truncation,
    "metadata_checks": metadata_checks,
    "compaction_under_writes": compaction_under_writes,
    "compaction_result": compaction_result,
    "background_compaction": background_compaction,
    "verify_recall": verify_recall,
    "verify_mutation": verify_mutation,
    "bench_modes": bench_modes,
    "streaming_apply": streaming_apply,
}


# ---- SQL ----

_E = "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings"
_SCORE = {
    Metric.L2: "list_distance(a.e, q.e)",
    Metric.COSINE: "CASE WHEN sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(q.e, q.e)) = 0 THEN 1.0 ELSE 1.0 - list_inner_product(a.e, q.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(q.e, q.e))) END",
    Metric.DOT: "0.0 - list_inner_product(a.e, q.e)",
}
_CORPUS = "SELECT v.vec_id, v.embedding::DOUBLE[] AS e, lang, source, n_chars, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id LEFT JOIN labels l ON l.doc_id = v.vec_id"
_OPS = """SELECT event_id + 1 AS seq, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'update_metadata' ELSE 'upsert' END AS op,
  user_id AS doc_id, CASE WHEN event_type NOT IN ('error', 'view') THEN value END AS v,
  CASE WHEN event_type <> 'error' THEN event_type END AS kind, CASE WHEN event_type = 'purchase' THEN value END AS amount FROM events"""


def _top(metric: Metric, base: str = _E, where: str = "true", query: str = "SELECT e FROM (" + _E + ") WHERE vec_id = 0", columns: str = "") -> str:
    return f"WITH a AS ({base}), q AS ({query}), s AS (SELECT a.*, {_SCORE[metric]} AS s FROM a, q WHERE {where}) SELECT vec_id, round(s, 6) + 0.0 AS score{columns} FROM s ORDER BY s, vec_id LIMIT {K}"


def _join_sql(metric: Metric) -> str:
    return f"""WITH a AS ({_E}), q AS ({_E} WHERE {ASKED}),
s AS (SELECT q.vec_id AS query_id, a.vec_id, {_SCORE[metric]} AS s FROM a, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, round(s, 6) + 0.0 AS score FROM r WHERE rank <= {K}"""


def _fold_sql(v: str = "v", last: str = "SELECT * FROM f") -> str:
    return f"""WITH o AS ({_OPS}), del AS (SELECT doc_id, max(CASE WHEN op = 'delete' THEN seq END) AS ds FROM o GROUP BY doc_id),
birth AS (SELECT o.doc_id, min(o.seq) AS bs FROM o JOIN del USING (doc_id) WHERE o.op = 'upsert' AND o.seq > coalesce(ds, 0) GROUP BY o.doc_id),
f AS (SELECT o.doc_id, max_by({v}, CASE WHEN op = 'upsert' THEN seq END) AS v, max_by(kind, CASE WHEN kind IS NOT NULL THEN seq END) AS kind,
  max_by(amount, CASE WHEN amount IS NOT NULL THEN seq END) AS amount, min(bs) AS birth,
  max(CASE WHEN op = 'upsert' THEN seq END) AS live_seq
  FROM o JOIN birth USING (doc_id) WHERE o.seq >= bs GROUP BY o.doc_id)
{last}"""


_LIVE = "l AS (SELECT doc_id, vec_id, embedding::DOUBLE[] AS e FROM f JOIN embeddings ON vec_id = v)"
_SLOTS = f""", u AS (SELECT seq, doc_id, row_number() OVER (ORDER BY seq) - 1 AS slot FROM o WHERE op = 'upsert'),
t AS (SELECT (slot // {CAPACITY})::INTEGER AS seg_id, slot % {CAPACITY} AS internal_id, ((slot // {CAPACITY}) % {COMPACTION.num_levels})::INTEGER AS level,
  coalesce(u.seq <> f.live_seq, true) AS dead FROM u LEFT JOIN f USING (doc_id)),
g AS (SELECT seg_id, level, count(*) AS num_vectors, count(*) FILTER (WHERE dead) AS tombstones FROM t GROUP BY ALL),
st AS (SELECT *, num_vectors - tombstones AS live, tombstones / num_vectors AS ratio FROM g)"""
_ELIGIBLE = f"""el AS (SELECT level, count(*) AS segments, max(ratio) AS worst FROM st GROUP BY level
  HAVING (level < {COMPACTION.num_levels - 1} AND count(*) >= power({COMPACTION.level_count_multiplier}, level + 2)) OR max(ratio) > {COMPACTION.tombstone_threshold})"""


def _slots_sql(last: str) -> str:
    return _fold_sql(last="SELECT 1").removesuffix("\nSELECT 1") + _SLOTS + "\n" + last


def _live_sql(last: str) -> str:
    v = "(CASE WHEN op = 'upsert' THEN (seq - 1) % (SELECT count(*) FROM embeddings) END)"
    return _fold_sql(v, "SELECT 1").removesuffix("\nSELECT 1") + ", " + _LIVE + "\n" + last


_WRITTEN = """WITH b AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS seq FROM nation),
l AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) + (SELECT count(*) FROM nation) AS seq FROM nation WHERE n_regionkey <= 2),
o AS (SELECT seq, 'upsert' AS op, n_nationkey::BIGINT AS n_nationkey, n_nationkey::BIGINT AS v0, n_name AS name, n_regionkey::BIGINT AS region, NULL::DOUBLE AS size FROM b
  UNION ALL SELECT seq, CASE n_regionkey WHEN 0 THEN 'delete' WHEN 1 THEN 'update_metadata' ELSE 'upsert' END, n_nationkey, CASE WHEN n_regionkey = 2 THEN -n_nationkey END,
  CASE WHEN n_regionkey = 1 THEN lower(n_name) END, NULL, CASE WHEN n_regionkey = 2 THEN 0.5 END FROM l)"""


ORACLE: dict[str, str] = {
    "knn_l2": _top(Metric.L2),
    "knn_cosine": _top(Metric.COSINE),
    "knn_dot": _top(Metric.DOT),
    "knn_cosine_zero_query": _top(Metric.COSINE, query="SELECT list_transform(e, lambda x: 0.0::DOUBLE) AS e FROM (" + _E + ") WHERE vec_id = 0"),
    "knn_l2_sql": _top(Metric.L2),
    "knn_include_metadata": _top(Metric.L2, _CORPUS, columns=", lang, source, n_chars, quality, toxic"),
    "knn_include_vector": f"WITH t AS ({_top(Metric.L2)}) SELECT vec_id, unnest(range(len(embedding)))::BIGINT AS pos, unnest(embedding)::DOUBLE AS val FROM embeddings JOIN t USING (vec_id)",
    **{name: _top(Metric.L2, _CORPUS, where) for name, (_, where) in FILTERS.items()},
    "filter_match_count": f"WITH a AS ({_CORPUS}) "
    + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_matched, CASE WHEN count(*) <= {planner.EXACT_LIMIT} THEN 'exact' ELSE 'post_filter' END AS strategy FROM a WHERE {w}" for n, (_, w) in FILTERS.items()),
    "knn_join_l2": _join_sql(Metric.L2),
    "knn_join_cosine": _join_sql(Metric.COSINE),
    "knn_join_dot": _join_sql(Metric.DOT),
    "point_lookup": "SELECT vec_id, unnest(range(len(embedding)))::BIGINT AS pos, unnest(embedding)::DOUBLE AS val FROM embeddings WHERE vec_id = 7",
    "live_state_after_ops": _fold_sql(last="SELECT doc_id, v, kind, amount, birth FROM f"),
    "live_count": _fold_sql(last="SELECT count(*) AS n_live FROM f"),
    "deleted_ids": _fold_sql(last="SELECT DISTINCT doc_id FROM o WHERE doc_id NOT IN (SELECT doc_id FROM f)"),
    "metadata_merge": _fold_sql(last="SELECT doc_id, kind, amount FROM f WHERE amount IS NOT NULL AND kind <> 'purchase'"),
    "batch_dedup_last_wins": "SELECT batch, doc_id, pos, value FROM (SELECT event_id // 500 AS batch, user_id AS doc_id, event_id AS pos, value, row_number() OVER (PARTITION BY event_id // 500, user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
    "knn_after_mutations": _live_sql(f"SELECT doc_id, vec_id, round(list_distance(l.e, q.e), 6) + 0.0 AS score FROM l, (SELECT e FROM ({_E}) WHERE vec_id = 0) q ORDER BY list_distance(l.e, q.e), doc_id LIMIT {K}"),
    "doc_ord_assignment": f"""WITH o AS ({_OPS}), m AS (SELECT *, lag(op) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM o WHERE op IN ('upsert', 'delete'))
SELECT doc_id, seq, row_number() OVER (ORDER BY seq) - 1 AS doc_ord FROM m WHERE op = 'upsert' AND coalesce(before, 'delete') = 'delete'""",
    "segment_stats": _slots_sql("SELECT seg_id, level, num_vectors, tombstones, live, round(ratio, 6) + 0.0 AS ratio FROM st"),
    "tombstone_set": _slots_sql("SELECT seg_id, internal_id FROM t WHERE dead"),
    "compaction_triggers": _slots_sql("").rstrip() + f", {_ELIGIBLE} SELECT level, segments, round(worst, 6) + 0.0 AS worst FROM el",
    "compaction_candidates": _slots_sql("").rstrip()
    + f""", {_ELIGIBLE},
p AS (SELECT level, seg_id, ratio, coalesce(sum(live) OVER w, 0) AS before, row_number() OVER (PARTITION BY level ORDER BY ratio DESC, seg_id) AS rk,
  floor(16 * power(2, least(level + 1, {COMPACTION.num_levels - 1})) * (1.0 - {COMPACTION.tombstone_threshold})) AS fill
  FROM st WHERE level IN (SELECT level FROM el) WINDOW w AS (PARTITION BY level ORDER BY ratio DESC, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, count(*) OVER (PARTITION BY level) AS n FROM p WHERE before < fill OR rk = 1)
SELECT level, seg_id FROM c WHERE n >= 2 OR ratio > 0""",
    "recall_at_k": f"""WITH a AS ({_E}), q AS ({_E} WHERE {ASKED}), s AS (SELECT q.vec_id AS query_id, a.vec_id, list_distance(a.e, q.e) AS s FROM a, q),
t AS (SELECT query_id, vec_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) <= {K}),
r AS (SELECT query_id, vec_id FROM s WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) <= {K})
SELECT t.query_id, round(count(r.vec_id) / {K}.0, 6)::DOUBLE AS recall FROM t LEFT JOIN r ON r.query_id = t.query_id AND r.vec_id = t.vec_id GROUP BY t.query_id""",
    "latency_percentiles": """WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT p::DOUBLE AS p, value FROM (VALUES (50.0), (95.0), (99.0)) v(p) JOIN r ON i = floor(p / 100.0 * (n - 1) + 0.5)""",
    "latency_by_type": """WITH g AS (SELECT event_type, list_sort(list(value)) AS xs, count(value) AS n, avg(value) AS a FROM events GROUP BY event_type)
SELECT event_type, round(a, 6) AS avg, xs[floor(0.5 * (n - 1) + 0.5)::INT + 1] AS p50, xs[floor(0.95 * (n - 1) + 0.5)::INT + 1] AS p95, xs[floor(0.99 * (n - 1) + 0.5)::INT + 1] AS p99 FROM g""",
    "vector_multiplicity": _live_sql("SELECT n AS held_by, count(*) AS n_vectors FROM (SELECT e, count(*) AS n FROM l GROUP BY e) GROUP BY n"),
    "ann_ivf": _join_sql(Metric.L2),
    "ann_recall": f"SELECT count(*) AS n_queries, true AS recall_is_enough FROM embeddings WHERE {ASKED}",
    "ann_post_filter": f"WITH a AS ({_CORPUS}), q AS (SELECT e FROM a WHERE vec_id = 0), s AS (SELECT a.vec_id, lang, {_SCORE[Metric.L2]} AS s FROM a, q ORDER BY s, a.vec_id::VARCHAR LIMIT {planner.over_fetch(K)}) SELECT vec_id, round(s, 6) + 0.0 AS score FROM s WHERE lang = 'en' ORDER BY s, vec_id::VARCHAR LIMIT {K}",
    "index_after_compaction": "SELECT count(*) + count(*) FILTER (WHERE label % 2 = 0) AS n_rows, count(*) + count(*) FILTER (WHERE label % 2 = 0) AS n_listed FROM embeddings",
    "fvecs_roundtrip": "SELECT vec_id, unnest(range(len(embedding)))::BIGINT AS pos, unnest(embedding)::DOUBLE AS val FROM embeddings",
    "bvecs_roundtrip": "SELECT vec_id, unnest(range(len(embedding)))::BIGINT AS pos, unnest(list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 100)::BIGINT)) AS val FROM embeddings",
    "ivecs_roundtrip": "SELECT vec_id, unnest([0, 1, 2])::BIGINT AS pos, unnest([vec_id, -vec_id, label::BIGINT]) AS val FROM embeddings",
    "raw_append": "SELECT vec_id + half * (SELECT count(*) FROM embeddings) AS vec_id, unnest(range(len(embedding)))::BIGINT AS pos, unnest(embedding)::DOUBLE AS val FROM embeddings, (VALUES (0), (1)) h(half)",
    "groundtruth": f"WITH j AS ({_join_sql(Metric.L2)}), n AS (SELECT *, dense_rank() OVER (ORDER BY query_id) - 1 AS i FROM j) SELECT i AS query_id, rank - 1 AS pos, 'doc_' || vec_id AS doc_id FROM n WHERE rank <= 5",
    "query_subset": "SELECT least(50, count(*)) AS n, least(50, count(*)) AS n_distinct, least(50, count(*)) AS n_again FROM embeddings",
    "reopened": f"SELECT vec_id, e[1] AS v0, lang, source, n_chars, quality, toxic FROM ({_CORPUS})",
    "ingested_file": f"WITH t AS ({_top(Metric.L2)}) SELECT 'doc_' || vec_id AS doc_id, score FROM t",
    "log_scan": f"{_WRITTEN} SELECT seq, op, n_nationkey, v0, name, region, size FROM o",
    "log_recovery": """SELECT n_nationkey::BIGINT AS n_nationkey, (CASE WHEN n_regionkey = 2 THEN -n_nationkey ELSE n_nationkey END)::BIGINT AS v0,
  CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS name, n_regionkey::BIGINT AS region, CASE WHEN n_regionkey = 2 THEN 0.5::DOUBLE END AS size FROM nation WHERE n_regionkey <> 0""",
    "write_visibility": f"{_WRITTEN} SELECT max(seq) + 1 AS token, 1 AS visible_before, max(seq) + 1 AS visible_after, (SELECT count(*) FROM nation WHERE n_regionkey <> 0) AS n_live FROM o",
    "log_truncation": "SELECT true AS rotated, 1::BIGINT AS n_after, true AS nothing_pending",
    "metadata_checks": """SELECT n_nationkey, CASE n_regionkey WHEN 1 THEN 'TypeError' WHEN 2 THEN 'ValueError' WHEN 3 THEN 'ValueError' ELSE 'ok' END AS said,
  CASE WHEN n_regionkey <= 2 THEN '0' WHEN n_regionkey = 3 THEN '2' ELSE '' END AS field_ids FROM nation""",
    "compaction_under_writes": "SELECT vec_id, (CASE WHEN label = 2 THEN -embedding[1] ELSE embedding[1] END)::DOUBLE AS v0 FROM embeddings WHERE label <> 1",
    "compaction_result": "SELECT count(*) AS n_before, count(*) AS n_after, count(*) AS n_counted, true AS fewer_segments, true AS below_threshold FROM embeddings WHERE label >= 4",
    "background_compaction": "SELECT count(*) AS n_live, sum(vec_id)::BIGINT AS sum_of_ids, true AS merged, 0::BIGINT AS n_errors FROM embeddings WHERE label >= 4",
    "verify_recall": "SELECT 1.0::DOUBLE AS exact_recall, 0::BIGINT AS n_below_one, true AS index_is_enough",
    "verify_mutation": "SELECT 60::BIGINT AS checked, true AS passed",
    "bench_modes": "SELECT * FROM (VALUES ('search', 4::BIGINT, true, 1.0::DOUBLE), ('write', 20::BIGINT, true, NULL)) v(mode, n, saved, recall)",
    "collection_search": _top(Metric.L2, _CORPUS, FILTERS["filter_and"][1], columns=", n_chars, quality"),
    "streaming_apply": _fold_sql("(CASE WHEN op = 'upsert' THEN seq % 1000 END)", "SELECT doc_id, v, kind, amount FROM f"),
}
