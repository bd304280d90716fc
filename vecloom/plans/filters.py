"""The filter algebra: conjunctions of equality, membership, inclusive range and existence.

A filter compiles to a Column that is never null (each condition asks for the field first, and false AND null is
false), over a struct column of metadata, in conjunctions that Catalyst can push to the Parquet scan. Fields are
addressed by id; an unknown id is false. A literal of another type equals nothing; a range over one, over Bool or
Bytes, or with NaN, is an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import FieldSchema, FieldType, MetadataSchema, micros, type_of


@dataclass(frozen=True)
class And:
    parts: tuple[Any, ...] = ()


@dataclass(frozen=True)
class Eq:
    field_id: int
    value: Any


@dataclass(frozen=True)
class In:
    field_id: int
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Range:
    field_id: int
    gte: Any = None
    lte: Any = None


@dataclass(frozen=True)
class Exists:
    field_id: int


Filter = And | Eq | In | Range | Exists
_ORDERED = (FieldType.STRING, FieldType.INT64, FieldType.FLOAT64, FieldType.TIMESTAMP)


def _literal(value: Any) -> Column:
    if type_of(value) is FieldType.TIMESTAMP:
        return F.timestamp_micros(F.lit(micros(value)))
    return F.lit(bytearray(value)) if isinstance(value, bytes) else F.lit(value)


def _checked(f: FieldSchema, value: Any) -> Any:
    if type_of(value) is FieldType.FLOAT64 and math.isnan(value):
        raise ValueError(f"field '{f.name}': NaN cannot be compared")
    return value


def compile(expr: Filter, schema: MetadataSchema, meta: str | None = "meta") -> Column:
    """The Column of a filter; metadata fields are fields of the struct ``meta``, or plain columns if None."""
    if isinstance(expr, And):
        return reduce(lambda a, b: a & b, (compile(p, schema, meta) for p in expr.parts), F.lit(True))
    f = schema.field_by_id(expr.field_id)
    if f is None:
        return F.lit(False)
    column = F.col(f"{meta}.`{f.name}`" if meta else f"`{f.name}`")
    if isinstance(expr, Exists):
        return column.isNotNull()
    if isinstance(expr, Eq):
        return column.isNotNull() & (column == _literal(_checked(f, expr.value))) if type_of(expr.value) is f.type else F.lit(False)
    if isinstance(expr, In):
        same = [_checked(f, v) for v in expr.values if type_of(v) is f.type]
        return column.isNotNull() & column.isin([_literal(v) for v in same]) if same else F.lit(False)
    out = column.isNotNull()
    for bound, keep in ((expr.gte, column.__ge__), (expr.lte, column.__le__)):
        if bound is None:
            continue
        if type_of(bound) is not f.type or f.type not in _ORDERED:
            got = type_of(bound)
            raise TypeError(f"field '{f.name}': range over {f.type.value} cannot take {got.value if got else type(bound).__name__}")
        out = out & keep(_literal(_checked(f, bound)))
    return out
