import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecloom.database import Database
from vecloom.operators import ann, evaluate, search
from vecloom.sources import vectorfiles as V
from vecloom.streaming import apply as stream
from vecloom.types import CollectionSchema, FieldSchema, FieldType, MetadataSchema, Metric


def test_vector_files(spark, tmp_path):
    f, b, i = (str(tmp_path / n) for n in ("x.fvecs", "x.bvecs", "x.ivecs"))
    data = np.arange(12, dtype=np.float32).reshape(4, 3)
    open(f, "wb").write(b"".join(struct.pack("<i3f", 3, *r) for r in data))
    open(b, "wb").write(b"".join(struct.pack("<i3B", 3, *map(int, r)) for r in data))
    open(i, "wb").write(b"".join(struct.pack("<i3i", 3, *map(int, r)) for r in data))
    for df in (V.read_fvecs(spark, f), V.load_vectors(spark, b), V.load_vectors(spark, f)):
        assert [list(r.vector) for r in df.orderBy("idx").collect()] == data.tolist()
    assert [list(r.vector) for r in V.read_ivecs(spark, i).orderBy("idx").collect()] == data.astype(int).tolist()
    assert V.load_groundtruth(spark, i, 2).orderBy("query_id").first().ids == ["doc_0", "doc_1"]
    assert V.load_groundtruth(spark, i, 9).orderBy("query_id").first().ids == ["doc_0", "doc_1", "doc_2"]
    out = str(tmp_path / "raw")
    V.write_vectors(V.read_fvecs(spark, f).coalesce(1), out)
    assert [list(r.vector) for r in V.read_raw(spark, out, 3).orderBy("idx").collect()] == data.tolist()
    V.write_vectors(V.read_fvecs(spark, f).repartitionByRange(3, "idx").sortWithinPartitions("idx"), out)
    assert [list(r.vector) for r in V.read_raw(spark, out, 3).orderBy("idx").collect()] == data.tolist() * 2, "appended, in order"
    V.write_vectors(V.read_fvecs(spark, b.replace("bvecs", "fvecs")).limit(2).coalesce(1), out, mode="overwrite")
    back = V.read_raw(spark, out, 3).orderBy("idx").collect()
    assert [(r.idx, list(r.vector)) for r in back] == [(i, data[i].tolist()) for i in range(2)]
    with pytest.raises(Exception, match="nowhere"):
        V.read_raw(spark, str(tmp_path / "nowhere"), 3).collect()
    open(f, "wb").write(b"12")
    with pytest.raises(Exception, match="file too small"):
        V.read_fvecs(spark, f).collect()
    open(f, "wb").write(struct.pack("<i3f", 3, 1, 2, 3) + b"zz")
    with pytest.raises(Exception, match="trailing bytes"):
        V.read_fvecs(spark, f).collect()


def test_stream_equals_batch(spark, tmp_path):
    meta = MetadataSchema((FieldSchema(0, "i", FieldType.INT64),))
    ends = []
    for way in ("batch", "stream"):
        c = Database(spark, str(tmp_path / way)).create_collection(CollectionSchema("c", 2, metadata_schema=meta))
        q = None
        for round in range(3):
            for k in range(10):
                c.upsert(f"d{k}", [float(k), float(round)], {"i": k * round} if k % 2 else None)
            c.delete(f"d{round}")
            token = c.update_metadata("d5", {"i": 99 + round})
            if way == "stream":
                q = stream.start(c, str(tmp_path / "check"), once=True)
                q.awaitTermination(120)
                assert q.exception() is None
                assert c.visible_seq >= token.value
            else:
                c.wait_visible(token)
        ends.append(sorted((r.doc_id, tuple(r.vector), r.i) for r in c.rows().select("doc_id", "vector", "meta.i").collect()))
    assert ends[0] == ends[1] and len(ends[0]) == 9


@pytest.mark.parametrize("metric", list(Metric))
def test_join_and_index(spark, metric, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32) + 5 * rng.integers(0, 6, size=(600, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<float>")
    q = df.where("doc_id < 12").select(F.col("doc_id").alias("query_id"), "vector")
    got = search.nearest_join(q, df, 5, metric).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    blocks = search.nearest_join(q, df, 5, metric).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r["rank"]) for r in got] == [(r.query_id, r.id, r["rank"]) for r in blocks]
    one = search.nearest(df, x[3].tolist(), 5, metric).collect()
    assert [r.doc_id for r in one] == [r.id for r in got if r.query_id == 3]
    index = ann.fit(df, 6, metric)
    assert ann.recall(index, df, q, 5, 6) == 1.0
    index = ann.calibrated(index, df, 0.95, k=5)
    many = df.where("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    assert ann.recall(index, df, many, 5, index.nprobe) >= 0.9
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "QUERY_ROWS", 5)
    assert ann.recall(index, index.assign(df), q, 5, 6) == 1.0, "lists in several blocks"


def test_collection_index_and_post_filter(spark, tmp_path):
    c = Database(spark, str(tmp_path / "db")).create_collection(CollectionSchema("c", 2, metadata_schema=MetadataSchema((FieldSchema(0, "i", FieldType.INT64),))))
    rows = spark.range(400).select(F.col("id").cast("string").alias("doc_id"), F.array((F.col("id") % 20).cast("float"), (F.col("id") / 20).cast("float")).alias("vector"), (F.col("id") % 2).alias("i"))
    assert c.ingest(rows) == 400
    c.build_index(n_lists=8)
    c.wait_visible(c.upsert("new", [3.1, 3.1]))
    want = [h.doc_id for h in c.search([3.1, 3.1], 5, strategy="exact")]
    assert [h.doc_id for h in c.search([3.1, 3.1], 5, strategy="index")] == want and want[0] == "new"


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "c", 3)], "query_id int, id string, rank int")
    assert evaluate.hits_to_ids(hits).first().ids == ["a", "b", "c"]
    df = spark.createDataFrame([(["a", "b", "c"], ["c", "x", "a"])], "t array<string>, r array<string>")
    assert df.select(evaluate.recall_at_k(F.col("t"), F.col("r"), 3).alias("v")).first().v == pytest.approx(2 / 3)
    assert df.select(evaluate.recall_at_k(F.col("t"), F.col("r"), 4).alias("v")).first().v == 0.5
    s = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (5.0,)], "x double")
    assert {r.p: r.value for r in evaluate.percentiles(s, "x", (0.0, 50.0, 100.0)).collect()} == {0.0: 1.0, 50.0: 3.0, 100.0: 5.0}
    assert evaluate.percentiles(s.limit(0), "x", (50.0,)).first().value == 0.0
    ties = spark.createDataFrame([("a", v) for v in [0.5] * 700 + [0.1, 0.9, None]] + [("b", None), (None, 0.25), (None, -0.5)], "g string, x double")
    got = {r.g: (r.p50, r.p95, r.p99) for r in evaluate.latency_summary(ties, "x", ("g",)).collect()}
    assert got == {"a": (0.5, 0.5, 0.5), "b": (0.0, 0.0, 0.0), None: (0.25, 0.25, 0.25)}
