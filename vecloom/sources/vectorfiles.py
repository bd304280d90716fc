"""Vector files: fvecs, bvecs, ivecs and headerless float32, as Python data sources that split by record.

    spark.dataSource.register(VectorFile)
    spark.read.format("vectorfile").option("kind", "fvecs").load(path)   ->   idx long, vector array<float>

Every record of an .fvecs, .bvecs or .ivecs file begins with its length as a little-endian int32; the
first record's counts for all of its file, so records lie at multiples of one size and tasks read ranges of them. A
folder is read as its files one after another.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: kind -> (bytes before the numbers, number's format, Spark type)
KINDS = {"fvecs": (4, "<f4", "array<float>"), "bvecs": (4, "u1", "array<float>"), "ivecs": (4, "<i4", "array<int>"), "raw": (0, "<f4", "array<float>")}
SPLIT_BYTES = 32 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def _files(files: pafs.FileSystem, path: str, kind: str) -> list[pafs.FileInfo]:
    """The file itself, or a folder's files of a kind in order of name, which is the order of writing."""
    info = files.get_file_info(path)
    if info.type is pafs.FileType.Directory:
        return sorted((f for f in files.get_file_info(pafs.FileSelector(path)) if f.is_file and f.base_name.endswith(f".{kind}") and f.base_name[0] not in "._"), key=lambda f: f.base_name)
    if info.type is pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [info]


class _Range(InputPartition):
    """Records first to last of a file, whose own first record has the number ``base``."""

    def __init__(self, path: str, base: int, first: int, last: int, record: int, dim: int):
        self.path, self.base, self.first, self.last, self.record, self.dim = path, base, first, last, record, dim


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, dim: int):
        self.path, self.kind, self.dim = path, kind, dim

    def partitions(self) -> list[InputPartition]:
        files, path = _open(self.path)
        head, number, _ = KINDS[self.kind]
        out, base, dim = [], 0, self.dim
        for info in _files(files, path, self.kind):
            if head:
                if info.size < head:
                    raise ValueError("file too small")
                with files.open_input_file(info.path) as f:
                    dim = int(np.frombuffer(f.read(4), "<i4")[0])
                if dim <= 0:
                    raise ValueError(f"bad dimension {dim}")
            record = head + dim * np.dtype(number).itemsize
            if info.size % record:
                raise ValueError(f"partial record: {info.size % record} trailing bytes")
            n, step = info.size // record, max(1, SPLIT_BYTES // record)
            out += [_Range(info.path, base, i, min(n, i + step), record, dim) for i in range(0, n, step)]
            base += n
        return out or [_Range("", 0, 0, 0, 1, 1)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.first == part.last:
            return
        files, _ = _open(self.path)
        head, number, kind = KINDS[self.kind]
        as_type = pa.int32() if kind == "array<int>" else pa.float32()
        with files.open_input_file(part.path) as f:
            for low in range(part.first, part.last, 8192):
                n = min(8192, part.last - low)
                f.seek(low * part.record)
                raw = np.frombuffer(f.read(n * part.record), np.uint8).reshape(n, part.record)
                values = np.ascontiguousarray(raw[:, head:]).view(number).astype(as_type.to_pandas_dtype())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.dim), pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + n) + part.base), lists], ["idx", "vector"])


class _Written(WriterCommitMessage):
    def __init__(self, staged: str, final: str):
        self.staged, self.final = staged, final


class _Writer(DataSourceArrowWriter):
    """A file per task, in task order, after those of earlier writes; tasks write to a folder of the job, and the driver
    moves what the successful attempts wrote into place."""

    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = path, kind, overwrite
        self.job = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        files, path = _open(self.path)
        head, number, _ = KINDS[self.kind]
        task = TaskContext.get()
        files.create_dir(f"{path}/_{self.job}", recursive=True)
        staged = f"{path}/_{self.job}/{task.partitionId():05d}-{task.taskAttemptId()}"
        with files.open_output_stream(staged) as f:
            for batch in batches:
                for v in batch.column(batch.schema.get_field_index("vector")).to_pylist():
                    f.write((np.array([len(v)], "<i4").tobytes() if head else b"") + np.array(v).astype(number).tobytes())
        return _Written(staged, f"{path}/part-{self.job}-{task.partitionId():05d}.{self.kind}")

    def commit(self, messages: list[_Written | None]) -> None:
        files, path = _open(self.path)
        files.create_dir(path, recursive=True)
        old = _files(files, path, self.kind) if self.overwrite else []
        for m in messages:
            if m is not None and files.get_file_info(m.staged).size:
                files.move(m.staged, m.final)
        for info in old:
            files.delete_file(info.path)
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        files, path = _open(self.path)
        if files.get_file_info(f"{path}/_{self.job}").type is pafs.FileType.Directory:
            files.delete_dir(f"{path}/_{self.job}")


class VectorFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectorfile"

    def schema(self) -> str:
        return f"idx long, vector {KINDS[self.options.get('kind', 'fvecs')][2]}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("kind", "fvecs"), int(self.options.get("dim", 0)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("kind", "fvecs"), overwrite)


def _read(spark: SparkSession, path: str, kind: str, dim: int = 0) -> DataFrame:
    spark.dataSource.register(VectorFile)
    return spark.read.format("vectorfile").option("kind", kind).option("dim", dim).load(path)


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "fvecs")


def read_bvecs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "bvecs")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "ivecs")


def read_raw(spark: SparkSession, path: str, dim: int) -> DataFrame:
    return _read(spark, path, "raw", dim)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """By file name: .bvecs, or else fvecs."""
    return _read(spark, path, "bvecs" if path.rstrip("/").endswith(".bvecs") else "fvecs")


def load_groundtruth(spark: SparkSession, path: str, k: int) -> DataFrame:
    """query_id, ids: the first k neighbours of each query as doc_<number>."""
    return read_ivecs(spark, path).select(F.col("idx").alias("query_id"), F.transform(F.slice("vector", 1, k), lambda x: F.concat(F.lit("doc_"), x.cast("string"))).alias("ids"))


def write_vectors(rows: DataFrame, path: str, kind: str = "raw", mode: str = "append") -> None:
    """A column ``vector`` as files of a kind in a folder, one per task, in the order of rows; ``append`` adds files after
    those that are there, ``overwrite`` puts them in their place."""
    rows.sparkSession.dataSource.register(VectorFile)
    rows.select("vector").write.format("vectorfile").option("kind", kind).mode(mode).save(path)
