import struct
import threading
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F
from vecloom import database
from vecloom.database import Conflict, Database
from vecloom.operators import maintenance
from vecloom.plans.filters import And, Eq, Exists, In, Range
from vecloom.streaming.compactor import Compactor
from vecloom.types import CollectionSchema, CompactionParams, FieldSchema, FieldType, MetadataSchema, Metric, SegmentParams, Timestamp

A, B, C = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
ALL = MetadataSchema(tuple(FieldSchema(i, n, t) for i, (n, t) in enumerate([("s", FieldType.STRING), ("i", FieldType.INT64), ("f", FieldType.FLOAT64), ("b", FieldType.BOOL), ("t", FieldType.TIMESTAMP), ("y", FieldType.BYTES)])))


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def make(db, name="c", dim=3, metric=Metric.L2, meta=None, **kw):
    return db.create_collection(CollectionSchema(name, dim, metric, metadata_schema=meta, **kw))


def ids(hits):
    return [h.doc_id for h in hits]


def test_write_search_delete_replace(spark, db, tmp_path):
    c = make(db)
    c.upsert("a", A)
    c.upsert("b", B)
    token = c.upsert("c", C)
    assert token.value == 4
    c.wait_visible(token)
    hits = c.search(A, 3, include_vector=True)
    assert hits[0].doc_id == "a" and hits[0].score == 0 and hits[0].vector == A
    assert ids(hits) == ["a", "b", "c"]
    c.delete("a")
    c.upsert("b", A)
    c.wait_visible(c.delete("unknown"))
    assert c.visible_seq == 7
    assert ids(c.search(A, 5)) == ["b", "c"]
    assert c.search(A, 0) == [] and c.count() == 2
    assert c.get("b").vector == A and c.get("a") is None
    with pytest.raises(ValueError, match="dimension mismatch: expected 3, got 2"):
        c.search([1.0, 2.0], 1)
    with pytest.raises(ValueError, match="dimension mismatch"):
        c.upsert("x", [1.0])
    with pytest.raises(ValueError, match="finite"):
        c.upsert("x", [1.0, float("nan"), 0.0])
    # reopened: the same snapshot, and a write that was never applied is replayed
    c.upsert("z", [0.9, 0.1, 0.0])
    again = Database(spark, str(tmp_path / "db")).collection("c")
    assert ids(again.search(A, 3)) == ["b", "z", "c"]
    with pytest.raises(ValueError, match="already exists"):
        make(db)
    with pytest.raises(ValueError, match="not found"):
        db.collection("nothing")


def test_batches(db):
    c = make(db, meta=ALL, segment_params=SegmentParams(insert_batch_size=4))
    assert c.upsert_batch([]).value == 1
    with pytest.raises(ValueError, match="index 1: dimension mismatch"):
        c.upsert_batch([("a", A, None), ("b", A[:2], None)])
    with pytest.raises(ValueError, match="insert_batch_size"):
        c.upsert_batch([("a", A, None)] * 5)
    c.wait_visible(c.upsert_batch([("a", A, {"i": 1, "s": "old"}), ("b", B, None), ("a", C, {"i": 2})]))
    hit = c.search(C, 1, include_metadata=True)[0]
    assert (hit.doc_id, hit.metadata) == ("a", {"i": 2}), "the earlier entry leaves no metadata"


def test_metadata_round_trip_merge_and_lifecycle(spark, db, tmp_path):
    c = make(db, dim=2, meta=ALL)
    when = datetime(2023, 11, 14, 22, 13, 20, tzinfo=timezone.utc)
    full = {"s": "日本語テスト\0x", "i": -(2**63), "f": 1.5, "b": False, "t": when, "y": b"\x00\xff"}
    c.upsert("a", [1, 0], full)
    c.upsert("b", [0, 1], {"s": ""})
    c.upsert("e", [5, 5])
    c.wait_visible(c.upsert("m", [3, 3], {"i": 2**63 - 1}))
    by = {h.doc_id: h.metadata for h in c.search([0, 0], 9, include_metadata=True)}
    assert by == {"a": {**full, "t": Timestamp(1_700_000_000_000_000)}, "b": {"s": ""}, "e": None, "m": {"i": 2**63 - 1}}
    c.upsert("a", [1, 1], {"i": 7})  # merged, not replaced
    c.update_metadata("b", {"b": True})
    c.update_metadata("nobody", {"i": 1})  # no effect
    c.delete("m")
    c.wait_visible(c.upsert("m", [3, 3]))  # a fresh birth without metadata
    again = Database(spark, str(tmp_path / "db")).collection("c")
    by = {h.doc_id: h.metadata for h in again.search([0, 0], 9, include_metadata=True)}
    assert by["a"] == {**full, "i": 7, "t": Timestamp(1_700_000_000_000_000)}
    assert by["b"] == {"s": "", "b": True} and by["m"] is None and set(by) == {"a", "b", "e", "m"}


def test_validation(db):
    c = make(db, meta=ALL)
    for bad, said in (({"i": "x"}, "field 'i': expected int64, got string"), ({"i": True}, "'i'"), ({"q": 1}, "'q'"), ({"f": float("nan")}, "finite"), ({"f": float("inf")}, "finite"), ({"f": 1}, "expected float64, got int64")):
        with pytest.raises((ValueError, TypeError), match=said):
            c.upsert("a", A, bad)
    plain = make(db, "plain")
    for f in (lambda: plain.upsert("a", A, {}), lambda: plain.update_metadata("a", {}), lambda: plain.search(A, 1, And(()))):
        with pytest.raises(ValueError, match="no metadata schema"):
            f()
    with pytest.raises(ValueError, match=r"unknown metric: 'x' \(expected l2, cosine, or dot\)"):
        Metric.parse("x")
    assert Metric.parse("COSINE") is Metric.COSINE


def test_filters(db):
    meta = MetadataSchema((FieldSchema(0, "cat", FieldType.STRING), FieldSchema(1, "score", FieldType.INT64), FieldSchema(2, "active", FieldType.BOOL), FieldSchema(3, "x", FieldType.FLOAT64)))
    c = make(db, dim=2, meta=meta)
    c.upsert("a", [1, 0], {"cat": "x", "score": 10, "active": True})
    c.upsert("b", [2, 0], {"cat": "y", "score": 20, "active": False})
    c.upsert("c", [3, 0], {"cat": "x", "score": 30, "x": 1.0})
    c.wait_visible(c.upsert("d", [4, 0]))
    find = lambda f: ids(c.search([0, 0], 9, f))
    assert find(And(())) == ["a", "b", "c", "d"]
    assert find(Eq(0, "x")) == ["a", "c"]
    assert find(Eq(0, 1)) == find(Eq(9, 1)) == find(In(0, ())) == find(Exists(9)) == []
    assert find(In(1, (10, 30, "x"))) == ["a", "c"]
    assert find(Range(1, 10, 20)) == ["a", "b"]
    assert find(Range(1, gte=20)) == ["b", "c"] and find(Range(1, lte=20)) == ["a", "b"] and find(Range(1)) == find(Exists(1)) == ["a", "b", "c"]
    assert find(And((Eq(0, "x"), Range(1, gte=11)))) == ["c"]
    assert find(Exists(2)) == ["a", "b"]
    for bad in (Range(1, gte="x"), Range(2, gte=True), Range(3, gte=float("nan"))):
        with pytest.raises((TypeError, ValueError)):
            find(bad)
    hit = c.search([0, 0], 1, Eq(0, "y"), include_metadata=True, include_vector=True)[0]
    assert (hit.metadata, hit.vector) == ({"cat": "y", "score": 20, "active": False}, [2.0, 0.0])
    c.update_metadata("a", {"cat": "y"})
    c.wait_visible(c.delete("b"))
    assert find(Eq(0, "x")) == ["c"] and find(Eq(0, "y")) == ["a"]


def test_metrics_on_small_cases(db):
    for metric, want in ((Metric.L2, [0.0, 2**0.5]), (Metric.COSINE, [0.0, 1.0]), (Metric.DOT, [-1.0, 0.0])):
        c = make(db, metric.value, metric=metric)
        c.upsert("a", A)
        c.wait_visible(c.upsert("b", B))
        assert [h.score for h in c.search(A, 2)] == pytest.approx(want)
    assert [h.score for h in db.collection("cosine").search([0, 0, 0], 2)] == [1.0, 1.0]


def test_segments_compaction_and_vacuum(spark, db, tmp_path):
    params = dict(segment_params=SegmentParams(segment_capacity=5), compaction_params=CompactionParams(num_levels=2, level_count_multiplier=1))
    c = make(db, meta=ALL, **params)
    c.wait_visible(c.upsert_batch([(f"d{i}", [float(i), 0, 0], {"i": i}) for i in range(11)]))
    assert [(s.num_vectors, s.sealed) for s in c.manifest.segments] == [(5, True), (5, True), (1, False)]
    c.delete("d1")
    c.wait_visible(c.delete("d6"))
    assert c.tombstones().count() == 2
    assert c.compact() >= 1
    assert sorted(s.level for s in c.manifest.segments if s.sealed) == [1]
    assert c.tombstones().count() == 0 and c.count() == 9
    want = [f"d{i}" for i in range(11) if i not in (1, 6)]
    assert ids(c.search([0, 0, 0], 20)) == want
    before = len(c.files.list(c.files.at("segments")))
    assert c.vacuum() == 0, "files may belong to a commit under way"
    assert c.vacuum(grace=0) > 0 and len(c.files.list(c.files.at("segments"))) < before
    again = Database(spark, str(tmp_path / "db")).collection("c")
    assert {h.doc_id: h.metadata["i"] for h in again.search([0, 0, 0], 20, include_metadata=True)} == {d: int(d[1:]) for d in want}
    c.wait_visible(c.upsert("d1", [1.0, 0, 0]))
    assert ids(c.search([0, 0, 0], 2)) == ["d0", "d1"]


def test_log_rotation_and_replay(spark, db, tmp_path):
    c = make(db, metric=Metric.COSINE, wal_segment_bytes=512)
    for i in range(21):
        c.upsert(f"d{i}", [1.0, float(i), 0.0])
    assert c.wal_segment_count > 1
    again = Database(spark, str(tmp_path / "db")).collection("c")
    assert again.count() == 21 and again.wal_segment_count == 1
    assert ids(again.search([1, 0, 0], 1)) == ["d0"]


def test_ingest_file(db, tmp_path):
    rows = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]]
    path = tmp_path / "v.bin"
    path.write_bytes(b"".join(struct.pack("<4f", *r) for r in rows))
    c = make(db, dim=4)
    assert c.ingest_file(str(path)) == 3
    assert c.ingest_file(str(path)) == 3 and c.count() == 3, "again: upserts"
    assert ids(c.search([0, 1, 0, 0], 1)) == ["doc_1"]
    path.write_bytes(b"123")
    with pytest.raises(Exception, match="partial record: 3 trailing bytes"):
        c.ingest_file(str(path))


def test_random_ops_equal_a_sequential_model(db):
    rng = np.random.default_rng(0)
    c = make(db, dim=2, meta=ALL, segment_params=SegmentParams(segment_capacity=7))
    model = {}
    for step in range(160):
        d = f"d{rng.integers(12)}"
        meta = {k: v for k, v in (("i", int(rng.integers(9))), ("s", str(rng.integers(9)))) if rng.random() < 0.5}
        op = rng.choice(["up", "up", "del", "meta"])
        if op == "up":
            v = [float(rng.integers(50)), float(step)]
            c.upsert(d, v, meta)
            model[d] = (v, {**model.get(d, (0, {}))[1], **meta})
        elif op == "del":
            c.delete(d)
            model.pop(d, None)
        else:
            c.update_metadata(d, meta)
            if d in model:
                model[d] = (model[d][0], {**model[d][1], **meta})
        if step % 40 == 39:
            c.apply()
            got = {r.doc_id: (list(r.vector), c._plain(r.m) or {}) for r in c.rows().select("doc_id", "vector", c._shown().alias("m")).collect()}
            assert got == model and c.count() == len(model)
            assert c.rows().select("doc_ord").distinct().count() == len(model)


def scans(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "PushedFilters" in line]


def test_a_merge_keeps_writes_made_meanwhile(spark, db, tmp_path):
    """Upserts, deletes and metadata land after a merge has read its snapshot, through another handle."""
    params = dict(segment_params=SegmentParams(segment_capacity=4), compaction_params=CompactionParams(num_levels=2, level_count_multiplier=1))
    c = make(db, meta=ALL, **params)
    c.wait_visible(c.upsert_batch([(f"d{i}", [float(i), 0, 0], {"i": i}) for i in range(12)]))
    other = Database(spark, str(tmp_path / "db")).collection("c")
    write, done = c._write, []

    def late(frame, path):
        write(frame, path)
        if not done:
            done.append(1)
            other.upsert("d1", [1.5, 0, 0], {"s": "late"})
            other.delete("d2")
            other.update_metadata("d3", {"i": 33})
            other.wait_visible(other.upsert("new", [50.0, 0, 0]))

    c._write = late
    before = c.manifest.version
    assert c.compact_once() == 1
    assert done and c.manifest.version > before + 1
    c._write = write
    for handle in (c, Database(spark, str(tmp_path / "db")).collection("c")):
        got = {h.doc_id: (h.vector[0], h.metadata) for h in handle.search([0, 0, 0], 50, include_metadata=True, include_vector=True)}
        assert set(got) == {f"d{i}" for i in range(12) if i != 2} | {"new"} and handle.count() == 12
        assert got["d1"] == (1.5, {"i": 1, "s": "late"}) and got["d3"] == (3.0, {"i": 33}) and got["d5"] == (5.0, {"i": 5})
    assert c.visible_seq == other.visible_seq


def test_a_stale_commit_fails_and_apply_goes_on_from_the_new_snapshot(spark, db, tmp_path):
    c = make(db)
    c.wait_visible(c.upsert("a", A))
    stale = c.manifest.copy()
    other = Database(spark, str(tmp_path / "db")).collection("c")
    other.wait_visible(other.upsert("b", B))
    with pytest.raises(Conflict):
        c._publish(stale)
    ops = c.typed(spark.createDataFrame([(9, "upsert", "z", [0.0, 0.0, 1.0], (None,))], c.log_type))
    c.apply_ops(ops)  # begins on the stale snapshot, ends on the new one
    assert {h.doc_id for h in c.search(A, 9)} == {"a", "b", "z"} and c.visible_seq == 10


def test_levels_merge_side_by_side_and_a_taken_segment_is_left_alone(db):
    params = dict(segment_params=SegmentParams(segment_capacity=3), compaction_params=CompactionParams(num_levels=3, level_count_multiplier=1))
    c = make(db, **params)
    for step in range(3):
        c.wait_visible(c.upsert_batch([(f"d{i}", [float(i), float(step), 0], None) for i in range(4 * step, 4 * step + 12)]))
        c.compact_once()
    assert c._busy == set()
    assert c._merge({999}, 1) is False
    c.compact()
    assert c.count() == 20 and len(ids(c.search([0, 0, 0], 99))) == 20


def test_background_compaction(db):
    c = make(db, segment_params=SegmentParams(segment_capacity=4), compaction_params=CompactionParams(num_levels=2, level_count_multiplier=1))
    with Compactor(c, interval=0.05) as worker:
        c.wait_visible(c.upsert_batch([(f"d{i}", [float(i), 0, 0], None) for i in range(12)]))
        worker.wait_idle(60)
    assert worker.errors == [] and worker.merges >= 1
    assert sorted(s.level for s in c.manifest.segments if s.sealed) == [0, 1] and c.count() == 12, "two fill the output"


def test_apply_and_point_reads_touch_only_their_buckets(spark, db):
    c = make(db, segment_params=SegmentParams(buckets=8))
    c.wait_visible(c.upsert_batch([(f"d{i}", [float(i), 0, 0], None) for i in range(200)]))
    seen = []
    rows = c.rows
    c.rows = lambda m=None, buckets=None: seen.append(rows(m, buckets)) or seen[-1]
    c.wait_visible(c.upsert("d7", [7.5, 0, 0]))
    assert c.get("d7").vector[0] == 7.5
    for df in seen:
        (scan,) = [x for x in scans(df) if "vector" in x.partition("ReadSchema")[2]]
        assert "bucket" in scan.partition("PartitionFilters: [")[2].partition("]")[0], scan
        assert len({r.bucket for r in df.select("bucket").distinct().collect()}) == 1


def test_index_reads_its_lists_and_outlives_merges(spark, db):
    c = make(db, dim=2, meta=ALL, segment_params=SegmentParams(segment_capacity=64, ef_search=16), compaction_params=CompactionParams(num_levels=2, level_count_multiplier=1))
    rows = [(f"d{i:03d}", [float(i % 20), float(i // 20)], {"i": i % 3}) for i in range(400)]
    c.wait_visible(c.upsert_batch(rows))
    c.build_index(n_lists=16)
    plan = scans(c.search_df([3.1, 3.1], 5, strategy="index"))
    assert any("In(list" in x or "EqualTo(list" in x for x in plan), plan
    assert c._probed(c.manifest, [3.1, 3.1], c.rows()).count() < 400
    c.delete("d063")
    c.wait_visible(c.upsert("new", [3.1, 3.1], {"i": 0}))
    assert c.compact() >= 1
    assert c.manifest.index and c.rows().where("list IS NULL").count() == 0
    for query in ([3.1, 3.1], [0.2, 18.9], [19.0, 0.0]):
        want = ids(c.search(query, 5, strategy="exact"))
        assert ids(c.search(query, 5, strategy="index")) == want
        near = [d for d in ids(c.search(query, 100, strategy="index"))]
        matching = set(ids(c.search(query, 400, Eq(1, 0), strategy="exact")))
        assert ids(c.search(query, 5, Eq(1, 0), strategy="post_filter")) == [d for d in near if d in matching][:5]
    assert ids(c.search([3.1, 3.1], 1, strategy="index")) == ["new"]
    c.drop_index()
    assert c.manifest.index is None and ids(c.search([3.1, 3.1], 1, strategy="index")) == ["new"]


def test_tombstone_folders_become_one(db):
    c = make(db)
    for i in range(12):
        c.wait_visible(c.upsert("a", [float(i), 0, 0]))
    assert len(c.manifest.dead) <= 9 and c.tombstones().count() == 11 and c.count() == 1


def test_a_level_of_many_segments_is_merged_at_once_until_none_is_eligible(spark, db):
    """Some hundred segments with tombstones come to rest in a few merges, which fill segments of their level."""
    c = make(db, dim=1, segment_params=SegmentParams(segment_capacity=2), compaction_params=CompactionParams(num_levels=3, level_count_multiplier=1))
    c.ingest(spark.range(200).select(F.col("id").cast("string").alias("doc_id"), F.array(F.col("id").cast("float")).alias("vector")))
    ops = spark.range(0, 200, 5).select((F.col("id") + c.next_seq).alias("seq"), F.lit("delete").alias("op"), F.col("id").cast("string").alias("doc_id"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast(c._meta_type).alias("meta"))
    c.apply_ops(ops)
    assert 1 <= c.compact() <= 6
    sealed = [s for s in c.manifest.segments if s.sealed]
    assert c.eligible() == {} and all(not s.tombstones and s.num_vectors <= 2 * 2**s.level for s in sealed)
    assert sum(s.num_vectors for s in sealed) == c.count() == c.rows().count() == 160 and len(sealed) <= 30
    assert {r.doc_id for r in c.rows().select("doc_id").collect()} == {str(i) for i in range(200) if i % 5}
    places = c.rows().select("seg_id", "internal_id").distinct()
    assert places.count() == 160 and places.agg(F.max("internal_id")).first()[0] < 8


def test_a_merge_into_several_segments_keeps_deletes_made_meanwhile(spark, db, tmp_path):
    params = dict(segment_params=SegmentParams(segment_capacity=4), compaction_params=CompactionParams(num_levels=2, level_count_multiplier=1))
    c = make(db, **params)
    c.wait_visible(c.upsert_batch([(f"d{i}", [float(i), 0, 0], None) for i in range(40)]))
    other = Database(spark, str(tmp_path / "db")).collection("c")
    write, done = c._write, []

    def late(frame, path):
        write(frame, path)
        if not done:
            done.append(1)
            for i in (3, 20, 39):
                token = other.delete(f"d{i}")
            other.wait_visible(token)

    c._write = late
    assert c.compact_once() == 1
    sealed = [s for s in c.manifest.segments if s.sealed]
    assert done and [(s.level, s.num_vectors) for s in sealed] == [(1, 8)] * 5 and sorted(s.tombstones for s in sealed) == [0, 0, 1, 1, 1]
    assert c.count() == 37 and {r.doc_id for r in c.rows().select("doc_id").collect()} == {f"d{i}" for i in range(40) if i not in (3, 20, 39)}


def test_the_plan_begins_with_the_candidates(spark):
    """On random segments: what the query picks is the first group of the plan, and of a level with one group all of it."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 30):
        params = CompactionParams(num_levels=3, level_count_multiplier=int(rng.integers(1, 3)))
        segments = [(i, int(rng.integers(3)), int(v), int(rng.integers(v + 1))) for i, v in enumerate(rng.integers(0, 20, n))]
        stats = maintenance.with_ratio(spark.createDataFrame(segments, "seg_id int, level int, num_vectors long, tombstones long"))
        picked, plan, rest = {}, maintenance.plan(segments, params, 20), segments
        while rows := maintenance.candidates(maintenance.with_ratio(spark.createDataFrame(rest, stats.select("seg_id", "level", "num_vectors", "tombstones").schema)), params, 20).collect():
            for r in rows:
                picked.setdefault(r.level, set()).add(r.seg_id)
            taken = {r.seg_id for r in rows}
            if not (rest := [s for s in rest if s[0] not in taken]):
                break
        assert plan == picked



def test_background_compaction_of_many_segments_comes_to_rest_in_few_merges(spark, db):
    """Deletes get in beside the merges, which are as many as levels, not as segments."""
    c = make(db, dim=1, segment_params=SegmentParams(segment_capacity=2), compaction_params=CompactionParams(num_levels=3, level_count_multiplier=1))
    c.ingest(spark.range(120).select(F.col("id").cast("string").alias("doc_id"), F.array(F.col("id").cast("float")).alias("vector")))
    ops = spark.range(0, 120, 3).select((F.col("id") + c.next_seq).alias("seq"), F.lit("delete").alias("op"), F.col("id").cast("string").alias("doc_id"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast(c._meta_type).alias("meta"))
    with Compactor(c, interval=0.05) as worker:
        c.apply_ops(ops)
        worker.wait_idle(120)
    assert worker.errors == [] and 1 <= worker.merges <= 8
    assert c.eligible() == {} and c.count() == c.rows().count() == 80


def test_merges_without_end_do_not_keep_a_write_from_its_commit(db, monkeypatch):
    """Another thread publishes, as merges do, far more often than a pass over the log takes."""
    monkeypatch.setattr(database, "ATTEMPTS", 3)
    c = make(db)
    c.wait_visible(c.upsert_batch([("a", A, None), ("b", B, None)]))
    published, stop, failed = [], threading.Event(), []

    def publish():
        while not stop.wait(0.02):
            try:
                published.append(c._amend(lambda m: setattr(m, "next_seg", m.next_seg + 1)).version)
            except Conflict as e:
                failed.append(e)

    worker = threading.Thread(target=publish)
    worker.start()
    try:
        c.wait_visible(c.delete("a"))
        c.wait_visible(c.upsert("c", C))
    finally:
        stop.set()
        worker.join()
    assert published and failed == [] and published == sorted(set(published))
    assert {r.doc_id for r in c.rows().select("doc_id").collect()} == {"b", "c"} and c.count() == 2


def test_an_overtaken_pass_leaves_nothing_cached(spark, db, tmp_path):
    c = make(db)
    c.wait_visible(c.upsert("a", A))
    other = Database(spark, str(tmp_path / "db")).collection("c")
    commit, passes = c._commit, []

    def late(*args):
        passes.append(1)
        if len(passes) == 1:
            other.apply_ops(spark.createDataFrame(rows[:1], c.log_type))
        commit(*args)

    c._commit = late
    cache = spark._jsparkSession.sharedState().cacheManager()
    rows = [(c.next_seq, "upsert", "b", B, None), (c.next_seq + 1, "delete", "a", None, None)]
    before = cache.numCachedEntries()
    c.apply_ops(spark.createDataFrame(rows, c.log_type))
    assert len(passes) == 2 and c.count() == 1
    assert cache.numCachedEntries() <= before
