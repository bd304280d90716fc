"""Databases and collections: a mutation log, immutable Parquet segments, and manifests that name a snapshot.

    <base>/<collection>/schema.json
    <base>/<collection>/manifest/<version>.json             the highest one counts
    <base>/<collection>/segments/commit=<uuid>/bucket=<n>/  Parquet: doc_ord, doc_id, vector, meta, seg_id, internal_id, last_seq, list
    <base>/<collection>/dead/commit=<uuid>/bucket=<n>/      Parquet: seg_id, internal_id of rows that no longer count
    <base>/<collection>/index/<uuid>.json                   centroids and the number of lists to probe
    <base>/<collection>/log/<id>/<first seq>.json           mutations, a file per write, so a batch is atomic

Rows lie in the bucket of their document's hash, so what a mutation touches is looked up in the touched buckets only,
and are sorted by index list in their files, so a search that probes some lists skips the pages of the others.

A commit names the version it was made from and fails if another one was published since; mutations are then applied
again to the new snapshot, and merges and index builds, whose rows are written already, are fitted to it. Readers
work on the manifest they opened: its files never change.
"""

from __future__ import annotations

import base64
import json
import threading
import time
import uuid
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fs import Files
from .operators import ann, maintenance, oplog, search
from .plans import planner
from .plans.filters import Filter, compile
from .types import CollectionSchema, SearchHit, Timestamp, WriteToken, check_dimension, micros

ATTEMPTS = 50
"""Times that a commit is tried while others get in first."""
DEAD_FILES = 8
"""Folders of tombstones that a manifest names before they are made one."""
_DEAD = "seg_id int, internal_id long, bucket int"


class Conflict(RuntimeError):
    """Another writer has published since the snapshot that a commit was made from."""


UpsertEntry = tuple[str, Sequence[float], dict[str, Any] | None]


@dataclass
class Segment:
    """seg_id 0 upwards; ``sealed`` segments take no more rows."""

    seg_id: int
    level: int = 0
    sealed: bool = False
    num_vectors: int = 0
    tombstones: int = 0
    paths: list[str] = field(default_factory=list)


@dataclass
class Manifest:
    version: int = 0
    applied_seq: int = 0
    next_seg: int = 1
    next_ord: int = 0
    segments: list[Segment] = field(default_factory=lambda: [Segment(0)])
    dead: list[str] = field(default_factory=list)
    index: str | None = None

    def to_json(self) -> str:
        return json.dumps(self, default=vars)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        d = json.loads(text)
        d["segments"] = [Segment(**s) for s in d["segments"]]
        return cls(**d)

    def copy(self) -> Manifest:
        return Manifest.from_json(self.to_json())

    @property
    def paths(self) -> list[str]:
        return sorted({p for s in self.segments for p in s.paths})

    @property
    def live(self) -> int:
        return sum(s.num_vectors - s.tombstones for s in self.segments)


class Database:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.files = spark, Files(spark, base)
        self.files.mkdirs(self.files.root)
        self._open: dict[str, Collection] = {}

    def create_collection(self, schema: CollectionSchema) -> Collection:
        root = self.files.at(schema.name)
        if self.files.exists(f"{root}/schema.json"):
            raise ValueError(f"collection '{schema.name}' already exists")
        for folder in ("manifest", "segments", "dead", "index", "log/000001"):
            self.files.mkdirs(f"{root}/{folder}")
        self.files.publish(f"{root}/manifest/{0:012d}.json", Manifest().to_json())
        self.files.publish(f"{root}/schema.json", schema.to_json())  # last: from here on it exists
        return self.collection(schema.name)

    def collection(self, name: str) -> Collection:
        """The open collection, or the stored one with its log replayed."""
        if name not in self._open:
            if not self.files.exists(self.files.at(name, "schema.json")):
                raise ValueError(f"collection '{name}' not found")
            self._open[name] = Collection(self.spark, self.files.at(name))
        return self._open[name]


class Collection:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.schema = CollectionSchema.from_json(self.files.read(self.files.at("schema.json")))
        self._lock = threading.RLock()
        self._turn = threading.RLock()  # to publish, taken before _lock: a pass over the log keeps merges from publishing within it
        self._busy: set[int] = set()
        self._indexes: dict[str, ann.Index] = {}
        self.manifest = self._latest()
        logs = self.files.list(self.files.at("log"))
        self._wal = int(logs[-1]) + 1 if logs else 1
        self._wal_bytes = 0
        self.next_seq = max([self.manifest.applied_seq, *(self._last_seq(x) for x in logs)]) + 1
        self.apply()  # what a crash left unapplied
        self.files.mkdirs(self._log())

    # ---- schemas and files ----

    def _log(self, wal: int | None = None) -> str:
        return self.files.at("log", f"{wal or self._wal:06d}")

    def _latest(self) -> Manifest:
        names = self.files.list(self.files.at("manifest"))
        names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
        return Manifest.from_json(self.files.read(self.files.at("manifest", names[-1])))

    def _last_seq(self, wal: str) -> int:
        names = [n for n in self.files.list(self.files.at("log", wal)) if n.endswith(".json") and not n.startswith(".")]
        return int(names[-1].split("-")[1][:-5]) if names else 0

    @property
    def _meta_type(self) -> T.StructType:
        fields = self.schema.metadata_schema.struct.fields if self.schema.metadata_schema else []
        return T.StructType([*fields, T.StructField("_", T.BooleanType())])  # never empty, which Parquet has no place for

    @property
    def _fields(self) -> list[str]:
        return [f.name for f in self.schema.metadata_schema.fields] if self.schema.metadata_schema else []

    @property
    def _row_type(self) -> T.StructType:
        return T.StructType(
            [
                T.StructField("doc_ord", T.LongType()),
                T.StructField("doc_id", T.StringType()),
                T.StructField("vector", T.ArrayType(T.FloatType(), False)),
                T.StructField("meta", self._meta_type),
                T.StructField("last_seq", T.LongType()),
                T.StructField("seg_id", T.IntegerType()),
                T.StructField("internal_id", T.LongType()),
                T.StructField("list", T.IntegerType()),
                T.StructField("bucket", T.IntegerType()),
            ]
        )

    def _bucket(self, doc_id: str = "doc_id") -> Column:
        return F.pmod(F.xxhash64(F.col(doc_id)), F.lit(self.schema.segment_params.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        """Rows by bucket, sorted by index list, in files of a size that AQE chooses and pages of some lists."""
        placed = rows.withColumn("bucket", self._bucket()).select(*self._row_type.names)
        placed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "list", "doc_id").write.option("parquet.page.row.count.limit", 2000).partitionBy("bucket").parquet(path)

    def _fresh(self, folder: str) -> str:
        """A folder of a commit, which readers of several take for a partition."""
        return self.files.at(folder, f"commit={uuid.uuid4().hex}")

    def _stored(self, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self._row_type).option("basePath", self.files.at("segments")).parquet(*paths).select(*self._row_type.names)

    def _buried(self, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(_DEAD).option("basePath", self.files.at("dead")).parquet(*paths).select("seg_id", "internal_id", "bucket")

    # ---- writes ----

    def _validated(self, vector: Sequence[float] | None, metadata: dict[str, Any] | None, where: str = "") -> dict[str, Any] | None:
        if vector is not None:
            check_dimension(self.schema.dimension, len(vector), where)
            if any(x != x or x in (float("inf"), float("-inf")) for x in map(float, vector)):
                raise ValueError(f"{where}vector elements must be finite")
        if metadata is None:
            return None
        if self.schema.metadata_schema is None:
            raise ValueError("collection has no metadata schema")
        self.schema.metadata_schema.validate(metadata)
        plain = {}
        for name, v in metadata.items():
            plain[name] = micros(v) if isinstance(v, Timestamp) or hasattr(v, "year") else base64.b64encode(v).decode() if isinstance(v, bytes) else v
        return plain

    def _append(self, ops: list[dict[str, Any]]) -> WriteToken:
        """One file, renamed into place: all of a write or nothing of it."""
        with self._lock:
            return self._append_one(ops)

    def _append_one(self, ops: list[dict[str, Any]]) -> WriteToken:
        first = self.next_seq
        lines = [json.dumps({"seq": first + i, **op}) for i, op in enumerate(ops)]
        last = first + len(ops) - 1
        if self._wal_bytes >= self.schema.wal_segment_bytes:
            self._wal, self._wal_bytes = self._wal + 1, 0
            self.files.mkdirs(self._log())
        text = "\n".join(lines) + "\n"
        if not self.files.publish(f"{self._log()}/{first:020d}-{last:020d}.json", text):
            raise RuntimeError("another writer has taken this sequence number")
        self._wal_bytes += len(text)
        self.next_seq = last + 1
        return WriteToken(last + 1)

    def upsert(self, doc_id: str, vector: Sequence[float], metadata: dict[str, Any] | None = None) -> WriteToken:
        meta = self._validated(vector, metadata)
        return self._append([{"op": "upsert", "doc_id": doc_id, "vector": [float(x) for x in vector], "meta": meta or {}}])

    def upsert_batch(self, entries: Sequence[UpsertEntry]) -> WriteToken:
        """All or nothing; of equal ids the last counts, and earlier ones leave no metadata."""
        if not entries:
            return WriteToken(self.next_seq)
        most = self.schema.segment_params.insert_batch_size
        if len(entries) > most:
            raise ValueError(f"batch of {len(entries)} exceeds insert_batch_size {most}")
        checked = [(d, v, self._validated(v, m, f"index {i}: ")) for i, (d, v, m) in enumerate(entries)]
        last = {d: i for i, (d, _, _) in enumerate(checked)}
        return self._append([{"op": "upsert", "doc_id": d, "vector": [float(x) for x in v], "meta": m or {}} for i, (d, v, m) in enumerate(checked) if last[d] == i])

    def delete(self, doc_id: str) -> WriteToken:
        return self._append([{"op": "delete", "doc_id": doc_id, "meta": {}}])

    def update_metadata(self, doc_id: str, metadata: dict[str, Any]) -> WriteToken:
        if self.schema.metadata_schema is None:
            raise ValueError("collection has no metadata schema")
        return self._append([{"op": "update_metadata", "doc_id": doc_id, "meta": self._validated(None, metadata)}])

    @property
    def visible_seq(self) -> int:
        return self.manifest.applied_seq + 1

    @property
    def wal_segment_count(self) -> int:
        return len(self.files.list(self.files.at("log")))

    def wait_visible(self, token: WriteToken, timeout: float = 60.0) -> None:
        """Applies the log, or waits for a stream that does, until the write is visible."""
        end = time.time() + timeout
        while self.visible_seq < token.value:
            self.apply()
            if self.visible_seq < token.value:
                if time.time() > end:
                    raise TimeoutError(f"token {token.value} is not visible, {self.visible_seq} is")
                time.sleep(0.05)

    # ---- the log as a DataFrame ----

    @property
    def log_type(self) -> T.StructType:
        stored = [T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in self._meta_type]
        return T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("meta", T.StructType(stored))])

    def typed(self, raw: DataFrame) -> DataFrame:
        """Log rows with metadata of the declared types."""
        cols = [(F.timestamp_micros(F.col(f"meta.`{f.name}`")) if isinstance(f.dataType, T.TimestampType) else F.col(f"meta.`{f.name}`")).alias(f.name) for f in self._meta_type]
        return raw.select("seq", "op", "doc_id", "vector", F.struct(*cols).alias("meta"))

    def pending(self) -> DataFrame | None:
        """The log from the first sequence number not yet applied."""
        paths = []
        for wal in self.files.list(self.files.at("log")):
            names = [n for n in self.files.list(self.files.at("log", wal)) if n.endswith(".json") and not n.startswith(".")]
            paths += [self.files.at("log", wal, n) for n in names if int(n.split("-")[1][:-5]) > self.manifest.applied_seq]
        if not paths:
            return None
        return self.typed(self.spark.read.schema(self.log_type).option("mode", "DROPMALFORMED").json(paths)).where(F.col("seq") > self.manifest.applied_seq)

    # ---- applying ----

    def apply(self) -> int:
        """Folds pending mutations into a new snapshot; returns the sequence number applied."""
        ops = self.pending()
        if ops is not None:
            self.apply_ops(ops)
        self._truncate_log()
        return self.manifest.applied_seq

    def apply_ops(self, ops: DataFrame) -> None:
        """Idempotent: ops up to the applied sequence number are skipped. If another commit gets in first, they are
        applied to the snapshot that it made. Merges of this collection object publish before or after a pass, never
        within it: theirs can be fitted to a newer snapshot, a pass would begin again each time."""
        for _ in range(ATTEMPTS):
            with self._turn:
                base = self.manifest
                try:
                    return self._apply_to(base, ops)
                except Conflict:
                    self.refresh()
        raise Conflict(f"not applied in {ATTEMPTS} attempts")

    def _apply_to(self, base: Manifest, ops: DataFrame) -> None:
        ops = ops.where(F.col("seq") > base.applied_seq).persist()
        kept = [ops]
        try:
            seen = ops.agg(F.max("seq").alias("last"), F.count("*").alias("n"), F.collect_set(self._bucket()).alias("buckets")).first()  # at most SegmentParams.buckets
            last, buckets = seen["last"], sorted(seen["buckets"])
            if last is None:
                return
            touched = self.rows(base, buckets).join(ops.select("doc_id").distinct(), "doc_id", "left_semi").persist()
            kept.append(touched)
            flat = lambda d, *more: d.select("seq", "op", "doc_id", "vector", *[F.col(f"meta.`{f}`").alias(f"m_{i}") for i, f in enumerate(self._fields)], *more)
            before = flat(touched.withColumn("seq", F.lit(0).cast("long")).withColumn("op", F.lit("upsert")), F.col("doc_ord").alias("old"))
            every = before.unionByName(flat(ops), allowMissingColumns=True)
            held = touched.count()
            # Documents that live already are born at 0, so births of this pass are numbered after them.
            start = touched.select(F.lit(0).cast("long").alias("seq"), F.lit("upsert").alias("op"), "doc_id")
            births = oplog.births(ops.select("seq", "op", "doc_id").unionByName(start), seen["n"] + held).where("seq > 0")
            born = births.select("doc_id", F.col("seq").alias("birth"), (F.col("doc_ord") - held + base.next_ord).alias("fresh")).persist()
            kept.append(born)
            n_born = born.count()
            folded = oplog.fold(every, "vector", [f"m_{i}" for i in range(len(self._fields))], ["old"])
            folded = folded.join(born, ["doc_id", "birth"], "left")
            meta = F.struct(*[F.col(f"m_{i}").alias(f) for i, f in enumerate(self._fields)], F.lit(None).cast("boolean").alias("_"))
            # A document that only ops without effect touched keeps its row.
            changed = folded.where(F.col("last_seq") > 0).select(F.coalesce("fresh", "old").alias("doc_ord"), "doc_id", "vector", meta.alias("meta"), "last_seq")
            gone = touched.select("seg_id", "internal_id", "bucket") if held else None
            self._commit(base, changed, gone, last, n_born, seen["n"])
        finally:
            for frame in reversed(kept):
                frame.unpersist()

    def _commit(self, base: Manifest, added: DataFrame, dead: DataFrame | None, applied: int, n_born: int, most: int) -> None:
        """Adds rows, ``most`` of them at most, to the writable segment, sealing it whenever it is full, and publishes."""
        m = base.copy()
        m.segments.sort(key=lambda s: s.seg_id)
        capacity = self.schema.segment_params.segment_capacity
        open_ = next(s for s in m.segments if not s.sealed)
        staged = self._fresh("segments")
        numbered = oplog.numbered(added, "last_seq", "place", most)
        held, first, fresh = open_.num_vectors, open_.seg_id, m.next_seg
        place = F.col("place") + held
        hop = F.floor(place / capacity)
        seg = F.when(hop == 0, F.lit(first)).otherwise(F.lit(fresh - 1) + hop).cast("int")
        rows = numbered.withColumn("seg_id", seg).withColumn("internal_id", place % capacity)
        self._write(self._listed(rows, m.index), staged)
        counts = {r["seg_id"]: r["count"] for r in self._stored([staged]).groupBy("seg_id").count().collect()}  # one row for each new segment
        for seg_id in sorted(counts):
            s = next((x for x in m.segments if x.seg_id == seg_id), None)
            if s is None:
                s = Segment(seg_id)
                m.segments.append(s)
                m.next_seg = seg_id + 1
            s.num_vectors += counts[seg_id]
            s.paths.append(staged)
        full = [s for s in m.segments if not s.sealed and s.num_vectors >= capacity]
        for s in full:
            s.sealed = True
        if all(s.sealed for s in m.segments):
            m.segments.append(Segment(m.next_seg))
            m.next_seg += 1
        by: dict[int, int] = {}
        if dead is not None:
            m.dead.append(self._bury(dead))
            by = {r["seg_id"]: r["count"] for r in self._buried(m.dead[-1:]).groupBy("seg_id").count().collect()}  # segments
        for s in m.segments:
            s.tombstones += by.get(s.seg_id, 0)
        if len(m.dead) > DEAD_FILES:
            m.dead = [self._bury(self.tombstones(m))]
        m.applied_seq, m.next_ord = applied, m.next_ord + n_born
        self._publish(m)

    def _bury(self, dead: DataFrame) -> str:
        path = self._fresh("dead")
        dead.select("seg_id", "internal_id", "bucket").hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(path)
        return path

    def refresh(self) -> Manifest:
        """Takes up the latest snapshot, whoever published it."""
        with self._lock:
            found = self._latest()
            if found.version > self.manifest.version:
                self.manifest = found
            return self.manifest

    def _publish(self, m: Manifest) -> None:
        """``m``, a changed copy of a snapshot, becomes the next version of that snapshot or of none."""
        m.version += 1
        with self._lock:
            if not self.files.publish(self.files.at("manifest", f"{m.version:012d}.json"), m.to_json()):
                raise Conflict(f"version {m.version} has been published by another writer")
            self.manifest = m

    def _amend(self, change) -> Manifest:
        """Publishes ``change(copy of the latest snapshot)``, again on a newer one if another commit gets in first."""
        for _ in range(ATTEMPTS):
            with self._turn:
                m = self.refresh().copy()
                change(m)
                try:
                    self._publish(m)
                    return m
                except Conflict:
                    pass
            time.sleep(0.01)
        raise Conflict(f"not published in {ATTEMPTS} attempts")

    def _truncate_log(self) -> None:
        """Drops closed log segments whose every op is applied, and applied files of the open one."""
        for wal in self.files.list(self.files.at("log")):
            names = [n for n in self.files.list(self.files.at("log", wal)) if n.endswith(".json") and not n.startswith(".")]
            done = [n for n in names if int(n.split("-")[1][:-5]) <= self.manifest.applied_seq]
            if int(wal) != self._wal and len(done) == len(names):
                self.files.delete(self.files.at("log", wal))

    def ingest(self, rows: DataFrame, id: str = "doc_id", vector: str = "vector") -> int:
        """Bulk upsert of a DataFrame past the log; further columns that the schema declares are metadata.
        Of equal ids one row counts. Returns the number of rows."""
        fields = [f for f in self._fields if f in rows.columns]
        n = rows.count()
        if not n:
            return 0
        bad = rows.where(F.col(vector).isNull() | (F.size(vector) != self.schema.dimension) | F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select(F.size(vector).alias("n")).first()
        if bad is not None:
            check_dimension(self.schema.dimension, bad["n"])
            raise ValueError("vector elements must be finite")
        meta = F.struct(*[(F.col(f) if f in fields else F.lit(None)).cast(self._meta_type[f].dataType).alias(f) for f in self._fields], F.lit(None).cast("boolean").alias("_"))
        first = self.next_seq
        ops = rows.select((F.monotonically_increasing_id()).alias("at"), F.lit("upsert").alias("op"), F.col(id).cast("string").alias("doc_id"), F.col(vector).cast("array<float>").alias("vector"), meta.alias("meta"))
        staged = self.files.at("segments", f"ingest-{uuid.uuid4().hex}")
        ops.write.parquet(staged)
        stored = self.spark.read.schema(ops.schema).parquet(staged)
        self.next_seq = first + n
        self.apply_ops(oplog.numbered(stored, "at", "place", n).withColumn("seq", F.col("place") + first).drop("at", "place"))
        self.files.delete(staged)
        return n

    def ingest_file(self, path: str) -> int:
        """Headerless little-endian float32 vectors; ids are doc_0, doc_1 and so on in file order."""
        from .sources.vectorfiles import read_raw

        rows = read_raw(self.spark, path, self.schema.dimension)
        return self.ingest(rows.select(F.concat(F.lit("doc_"), F.col("idx")).alias("doc_id"), "vector"))

    # ---- reads ----

    def rows(self, manifest: Manifest | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """Live rows of a snapshot, or of some of its buckets."""
        m = manifest or self.manifest
        if not m.paths:
            return self.spark.createDataFrame([], self._row_type)
        here = F.lit(True) if buckets is None else F.col("bucket").isin(list(buckets))
        stored = self._stored(m.paths).where(F.col("seg_id").isin([s.seg_id for s in m.segments if s.paths]) & here)
        if not m.dead:
            return stored
        return stored.join(self.tombstones(m).where(here), ["seg_id", "internal_id", "bucket"], "left_anti").select(*self._row_type.names)

    def segment_rows(self) -> DataFrame:
        """seg_id, level, dead of every stored row."""
        m = self.manifest
        levels = F.create_map(*[x for s in m.segments for x in (F.lit(s.seg_id), F.lit(s.level))])
        stored = self._stored(m.paths).where(F.col("seg_id").isin([s.seg_id for s in m.segments]))
        dead = self.tombstones().drop("bucket").withColumn("dead", F.lit(True))
        return stored.select("seg_id", "internal_id", levels[F.col("seg_id")].alias("level")).join(dead, ["seg_id", "internal_id"], "left").withColumn("dead", F.coalesce("dead", F.lit(False)))

    def tombstones(self, manifest: Manifest | None = None) -> DataFrame:
        """seg_id, internal_id, bucket of stored rows that no longer count."""
        m = manifest or self.manifest
        if not m.dead:
            return self.spark.createDataFrame([], _DEAD)
        return self._buried(m.dead).where(F.col("seg_id").isin([s.seg_id for s in m.segments]))

    def count(self) -> int:
        return self.manifest.live

    def get(self, doc_id: str) -> SearchHit | None:
        """Point read: the document's bucket only, and there an equality filter that prunes row groups."""
        bucket = self.spark.range(1).select(F.lit(doc_id).alias("doc_id")).select(self._bucket()).first()[0]
        r = self.rows(buckets=[bucket]).where(F.col("doc_id") == doc_id).select("vector", self._shown().alias("metadata")).first()
        return r and SearchHit(doc_id, 0.0, self._plain(r["metadata"]), list(r["vector"]))

    def _shown(self):
        return search.metadata_or_null(self._fields, "meta")

    def _plain(self, meta: Any) -> dict[str, Any] | None:
        if meta is None:
            return None
        kinds = {f.name: f.type for f in self.schema.metadata_schema.fields}
        out = {}
        for k, v in meta.asDict().items():
            if v is not None:
                out[k] = bytes(v) if isinstance(v, bytearray) else Timestamp(micros(v)) if kinds[k].value == "timestamp" else v
        return out

    def matching(self, filter: Filter) -> DataFrame:
        return self.rows().where(self._compiled(filter))

    def _compiled(self, filter: Filter) -> Column:
        if self.schema.metadata_schema is None:
            raise ValueError("collection has no metadata schema")
        return compile(filter, self.schema.metadata_schema)

    def search_df(self, query: Sequence[float], k: int, filter: Filter | None = None, include_metadata: bool = False, include_vector: bool = False, strategy: str = "auto") -> DataFrame:
        """doc_id, score, metadata, vector: at most k rows, nearest first."""
        check_dimension(self.schema.dimension, len(query))
        m = self.manifest
        base = self.rows(m)
        wanted = None if filter is None else self._compiled(filter)
        if strategy == "auto":
            count = planner.matched(base.where(wanted)) if wanted is not None and m.index else None
            strategy = planner.strategy(has_filter=wanted is not None, matches=count, rows=m.live, has_index=m.index is not None)
        indexed = strategy != "exact" and m.index is not None
        if indexed:
            base = self._probed(m, query, base)
        if wanted is not None and not (indexed and strategy == "post_filter"):
            base = base.where(wanted)
        columns = ["doc_id", "vector", *(["meta"] if include_metadata or wanted is not None else [])]
        if wanted is not None and indexed and strategy == "post_filter":
            # More candidates than asked for, then those of them that match.
            hits = search.nearest(base.select(*columns), query, planner.over_fetch(k), self.schema.metric)
            hits = hits.where(wanted).orderBy("score", "doc_id").limit(max(0, k))
        else:
            hits = search.nearest(base.select(*columns), query, k, self.schema.metric)
        shown = self._shown() if include_metadata else F.lit(None)
        kept = F.col("vector") if include_vector else F.lit(None).cast("array<float>")
        return hits.select("doc_id", "score", shown.alias("metadata"), kept.alias("vector"))

    def search(self, query: Sequence[float], k: int, filter: Filter | None = None, include_metadata: bool = False, include_vector: bool = False, strategy: str = "auto") -> list[SearchHit]:
        rows = self.search_df(query, k, filter, include_metadata, include_vector, strategy).collect()  # k rows
        return [SearchHit(r["doc_id"], r["score"], self._plain(r["metadata"]) if include_metadata else None, list(r["vector"]) if include_vector else None) for r in rows]

    def search_exact(self, query: Sequence[float], k: int, include_metadata: bool = False) -> list[SearchHit]:
        return self.search(query, k, None, include_metadata, strategy="exact")

    def search_many(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id, score, rank for queries (query_id, vector)."""
        return search.nearest_join(queries, self.rows().select("doc_id", "vector"), k, self.schema.metric)

    # ---- index ----

    def _index(self, path: str) -> ann.Index:
        if path not in self._indexes:
            self._indexes[path] = ann.Index.from_json(self.files.read(path))
        return self._indexes[path]

    def _listed(self, rows: DataFrame, index: str | None) -> DataFrame:
        """``rows`` with their list of the index, null without one."""
        rows = rows.drop("list")
        return self._index(index).assign(rows) if index else rows.withColumn("list", F.lit(None).cast("int"))

    def build_index(self, n_lists: int | None = None, seed: int = 1, recall: float = 0.95) -> None:
        """An inverted-file index: centroids, and every row's list with the row, so a search reads the probed lists
        only. Later writes get their list as they are applied, and merges keep it. ``n_lists`` is the root of the
        number of rows unless given; ef_construction bounds the training rows for each list and m the rounds of
        training; the number of lists to probe is the least that finds ``recall`` of the true neighbours of a sample
        of rows. Rows that were written meanwhile are listed before the snapshot with the index is published."""
        params, now = self.schema.segment_params, self.rows().select("doc_id", "vector")
        lists = n_lists or max(1, round(self.count() ** 0.5))
        model = ann.calibrated(ann.fit(now, lists, self.schema.metric, seed, rounds=params.m, per_list=params.ef_construction), now, recall)
        path = self.files.at("index", f"{uuid.uuid4().hex}.json")
        self.files.publish(path, model.to_json())
        made: dict[str, str] = {}
        for _ in range(ATTEMPTS):
            m = self.refresh().copy()
            if todo := [p for p in m.paths if p not in made]:
                new = self._fresh("segments")
                self._write(self._listed(self._stored(todo), path), new)
                made.update(dict.fromkeys(todo, new))
            for s in m.segments:
                s.paths = sorted({made[p] for p in s.paths})
            m.index = path
            try:
                return self._publish(m)
            except Conflict:
                continue
        raise Conflict(f"no index published in {ATTEMPTS} attempts")

    def drop_index(self) -> None:
        self._amend(lambda m: setattr(m, "index", None))

    def _probed(self, m: Manifest, query: Sequence[float], base: DataFrame) -> DataFrame:
        """The rows of the lists nearest to ``query``, and rows that the index has not seen."""
        model = self._index(m.index)
        probes = model.probe(query, max(model.nprobe, -(-self.schema.segment_params.ef_search // 16)))
        return base.where(F.col("list").isin(probes) | F.col("list").isNull())

    # ---- maintenance ----

    def stats(self) -> DataFrame:
        rows = [(s.seg_id, s.level, s.num_vectors, s.tombstones) for s in self.manifest.segments if s.sealed]
        return maintenance.with_ratio(self.spark.createDataFrame(rows, "seg_id int, level int, num_vectors long, tombstones long"))

    def eligible(self) -> dict[int, set[int]]:
        """Level -> segments to merge, of the levels that no merge is at work on."""
        sealed = [(s.seg_id, s.level, s.num_vectors, s.tombstones) for s in self.manifest.segments if s.sealed]
        chosen = maintenance.plan(sealed, self.schema.compaction_params, self.schema.segment_params.segment_capacity)
        return {level: c for level, c in chosen.items() if level not in self._busy}

    def compact(self) -> int:
        """Merges segments until no level is eligible, levels side by side; returns the merges made. Writes go on.
        Without writes it ends: below the top a merge moves rows up, and at the top it leaves no tombstones."""
        done = 0
        while made := self.compact_once():
            done += made
        return done

    def compact_once(self) -> int:
        """One merge on each eligible level, all at once; a level takes one at a time."""
        with self._lock:
            todo = self.eligible()
            self._busy |= set(todo)
        if not todo:
            return 0
        with ThreadPoolExecutor(len(todo)) as pool:  # levels; Spark runs the jobs of several threads side by side
            return sum(pool.map(lambda level: self._merge_level(level, todo[level]), sorted(todo)))

    def _merge_level(self, level: int, chosen: set[int]) -> bool:
        try:
            return self._merge(chosen, self.schema.compaction_params.output(level))
        finally:
            with self._lock:
                self._busy.discard(level)

    def _merge(self, chosen: set[int], level: int) -> bool:
        """Live rows of some segments become segments at the output level, as few as hold them and equally full; False
        if another merge took one of them.

        The rows are written from the snapshot at hand. When they are published, documents that were written or
        deleted since are tombstones of the merged segments; those move with their rows to the new ones.
        """
        capacity = self.schema.compaction_params.capacity(level, self.schema.segment_params.segment_capacity)

        def of(m: Manifest) -> list[Segment]:
            found = [s for s in m.segments if s.seg_id in chosen]
            if len(found) < len(chosen):
                raise LookupError
            return found

        def made(m: Manifest) -> tuple[int, int]:
            """Live rows and the segments that they fill."""
            n = sum(s.num_vectors - s.tombstones for s in of(m))
            return n, max(1, -(-n // capacity))

        try:
            base = self._amend(lambda m: setattr(m, "next_seg", m.next_seg + made(m)[1]))
        except LookupError:
            return False
        n, parts = made(base)
        first, size, ids = base.next_seg - parts, max(1, -(-n // parts)), sorted(chosen)
        path, moved = self._fresh("segments"), self.files.at("segments", f"moved-{uuid.uuid4().hex}")
        live = self.rows(base).where(F.col("seg_id").isin(ids)).withColumnsRenamed({"seg_id": "old_seg", "internal_id": "old_id"})
        part = F.least(F.floor(F.col("place") / size), F.lit(parts - 1))
        numbered = oplog.numbered(live, "doc_ord", "place", sum(s.num_vectors for s in of(base)))
        self._write(numbered.withColumn("seg_id", (part + first).cast("int")).withColumn("internal_id", F.col("place") - part * size), path)
        # Where each row went: its ordinal is its own, so both sides are read back rather than kept.
        was = live.select("doc_ord", "old_seg", "old_id")
        self._stored([path]).select("doc_ord", "seg_id", "internal_id", "bucket").join(was, "doc_ord").select("old_seg", "old_id", "seg_id", "internal_id", "bucket").write.parquet(moved)
        counts = {r["seg_id"]: r["count"] for r in self._stored([path]).groupBy("seg_id").count().collect()}  # one row for each new segment

        def change(m: Manifest) -> None:
            of(m)
            late: dict[int, int] = {}
            kept = self.tombstones(m).where(~F.col("seg_id").isin(ids))
            if m.dead != base.dead:
                since = self.tombstones(m).where(F.col("seg_id").isin(ids)).join(self.tombstones(base), ["seg_id", "internal_id", "bucket"], "left_anti")
                gone = since.select(F.col("seg_id").alias("old_seg"), F.col("internal_id").alias("old_id"))
                gone = self.spark.read.parquet(moved).join(gone, ["old_seg", "old_id"], "left_semi").select("seg_id", "internal_id", "bucket")
                kept, late = kept.unionByName(gone), {r["seg_id"]: r["count"] for r in gone.groupBy("seg_id").count().collect()}
            m.segments = [s for s in m.segments if s.seg_id not in chosen]
            m.segments += [Segment(i, level, True, counts[i], late.get(i, 0), [path]) for i in sorted(counts)]
            m.dead = [self._bury(kept)] if any(s.tombstones for s in m.segments) else []

        try:
            self._amend(change)
        except LookupError:
            return False
        finally:
            self.files.delete(moved)
        return True

    def vacuum(self, keep: int = 1, grace: float = 3600.0) -> int:
        """Deletes manifests but the last ``keep``, and files that none of those names and that are older than
        ``grace`` seconds, as a commit under way has written files that no manifest names yet. Returns the files deleted."""
        names = [n for n in self.files.list(self.files.at("manifest")) if not n.startswith(".")]
        kept = [Manifest.from_json(self.files.read(self.files.at("manifest", n))) for n in names[-keep:]]
        used = {p for m in kept for p in [*m.dead, *([m.index] if m.index else []), *m.paths]}
        gone = 0
        for folder in ("segments", "dead", "index"):
            for n in self.files.list(self.files.at(folder)):
                path = self.files.at(folder, n)
                if path not in used and self.files.age(path) >= grace:
                    self.files.delete(path)
                    gone += 1
        for n in names[:-keep]:
            self.files.delete(self.files.at("manifest", n))
        return gone
