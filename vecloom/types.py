"""Collections' schemas, parameters and results."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from enum import Enum
from typing import Any

from pyspark.sql import types as T


class Metric(Enum):
    """Lower is closer for all three."""

    L2 = "l2"
    COSINE = "cosine"
    DOT = "dot"

    @classmethod
    def parse(cls, text: str | Metric) -> Metric:
        if isinstance(text, Metric):
            return text
        for m in cls:
            if m.value == text.lower():
                return m
        raise ValueError(f"unknown metric: '{text}' (expected l2, cosine, or dot)")


class FieldType(Enum):
    STRING = "string"
    INT64 = "int64"
    FLOAT64 = "float64"
    BOOL = "bool"
    BYTES = "bytes"
    TIMESTAMP = "timestamp"

    @property
    def spark(self) -> T.DataType:
        return {"string": T.StringType(), "int64": T.LongType(), "float64": T.DoubleType(), "bool": T.BooleanType(), "bytes": T.BinaryType(), "timestamp": T.TimestampType()}[self.value]


@dataclass(frozen=True)
class Timestamp:
    """Microseconds since the epoch, without a zone."""

    micros: int


def type_of(value: Any) -> FieldType | None:
    """The one field type that a Python value has; none is coerced."""
    if isinstance(value, bool):
        return FieldType.BOOL
    if isinstance(value, Timestamp | datetime):
        return FieldType.TIMESTAMP
    for kind, found in ((str, FieldType.STRING), (int, FieldType.INT64), (float, FieldType.FLOAT64), (bytes, FieldType.BYTES)):
        if isinstance(value, kind):
            return found
    return None


def micros(value: Timestamp | datetime) -> int:
    if isinstance(value, Timestamp):
        return value.micros
    when = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    whole = when.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (whole.days * 86_400 + whole.seconds) * 1_000_000 + whole.microseconds


@dataclass(frozen=True)
class FieldSchema:
    id: int
    name: str
    type: FieldType
    filterable: bool = False


@dataclass(frozen=True)
class MetadataSchema:
    fields: tuple[FieldSchema, ...] = ()

    def field_by_name(self, name: str) -> FieldSchema | None:
        return next((f for f in self.fields if f.name == name), None)

    def field_by_id(self, id: int) -> FieldSchema | None:
        return next((f for f in self.fields if f.id == id), None)

    def validate(self, metadata: dict[str, Any]) -> dict[int, Any]:
        """Values by field id. Unknown fields, other types and non-finite floats are errors."""
        out = {}
        for name, value in metadata.items():
            f = self.field_by_name(name)
            if f is None:
                raise ValueError(f"unknown metadata field '{name}'")
            got = type_of(value)
            if got is not f.type:
                raise TypeError(f"field '{name}': expected {f.type.value}, got {got.value if got else type(value).__name__}")
            if got is FieldType.FLOAT64 and not math.isfinite(value):
                raise ValueError(f"field '{name}': float64 must be finite")
            if got is FieldType.INT64 and not -(2**63) <= value < 2**63:
                raise ValueError(f"field '{name}': int64 out of range")
            out[f.id] = value
        return out

    def names_to_ids(self, metadata: dict[str, Any]) -> dict[int, Any]:
        """Known fields only; unknown names are dropped."""
        return {f.id: v for n, v in metadata.items() if (f := self.field_by_name(n))}

    @property
    def struct(self) -> T.StructType:
        """Of declared fields, all optional; never inferred."""
        return T.StructType([T.StructField(f.name, f.type.spark) for f in self.fields])


@dataclass(frozen=True)
class SegmentParams:
    """m, ef_construction and ef_search advise the index: rounds of training, training rows for each list, and at
    least ef_search / 16 lists to probe. ``buckets`` is the number of document buckets that rows lie in."""

    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    segment_capacity: int = 500_000
    insert_batch_size: int = 2048
    buckets: int = 16


@dataclass(frozen=True)
class CompactionParams:
    num_levels: int = 4
    level_count_multiplier: int = 2
    tombstone_threshold: float = 0.2

    def is_top(self, level: int) -> bool:
        return level >= self.num_levels - 1

    def output(self, level: int) -> int:
        return min(level + 1, self.num_levels - 1)

    def threshold(self, level: int) -> int:
        return self.level_count_multiplier ** (level + 2)

    @staticmethod
    def capacity(level: int, base: int) -> int:
        return base * 2**level


@dataclass(frozen=True)
class CollectionSchema:
    name: str
    dimension: int
    metric: Metric = Metric.L2
    segment_params: SegmentParams = field(default_factory=SegmentParams)
    compaction_params: CompactionParams = field(default_factory=CompactionParams)
    wal_segment_bytes: int = 64 << 20
    metadata_schema: MetadataSchema | None = None

    def to_json(self) -> str:
        d = asdict(self)
        d["metric"] = self.metric.value
        if self.metadata_schema is not None:
            d["metadata_schema"] = [[f.id, f.name, f.type.value, f.filterable] for f in self.metadata_schema.fields]
        return json.dumps(d)

    @classmethod
    def from_json(cls, text: str) -> CollectionSchema:
        """Parameters that a stored schema lacks take their defaults."""
        d = json.loads(text)
        d["metric"] = Metric.parse(d.get("metric", "l2"))
        d["segment_params"] = SegmentParams(**d.get("segment_params", {}))
        d["compaction_params"] = CompactionParams(**d.get("compaction_params", {}))
        if d.get("metadata_schema") is not None:
            d["metadata_schema"] = MetadataSchema(tuple(FieldSchema(i, n, FieldType(t), x) for i, n, t, x in d["metadata_schema"]))
        return cls(**d)


@dataclass(frozen=True, order=True)
class WriteToken:
    """One more than the write's sequence number."""

    value: int


@dataclass(frozen=True)
class SearchHit:
    doc_id: str
    score: float
    metadata: dict[str, Any] | None = None
    vector: list[float] | None = None


def check_dimension(expected: int, got: int, where: str = "") -> None:
    if expected != got:
        raise ValueError(f"{where}dimension mismatch: expected {expected}, got {got}")
