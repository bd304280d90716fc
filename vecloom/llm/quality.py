"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once for each document: its measurement is stored, and bit ``r`` of
``rule_bits`` is set where rule ``r`` fails. The ledger is stored. A policy is a versioned set of rules, so it is applied
to the ledger with one bitwise AND, without reading a text again, and an ablation (what would come
back without one rule) is a count over the masked bits, of which there are at most 2**len(RULES)
distinct values, summed on the map side.

Defined cases: a null or empty text has no words and fails ``few_words`` only; a null doc_id is a
row like others; repeated rows are judged one by one; an empty table gives no rows; further columns
are ignored; whole texts are read however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, documents

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")
_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
_SYMBOLS = "#*$%&|<>"
_SPACE = dict.fromkeys([0x20, *range(0x09, 0x0E)])
_WINDOW = 5
_ODD = np.int64(-7046029254386353131)

RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeat_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words AND n_words > 0",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
    "shouting": "10 * n_upper > 6 * (n_upper + n_lower) AND n_upper + n_lower > 20",
}
"""Name and failure condition over MEASURES, by bit from 0; integers only, so engines agree."""


@dataclass(frozen=True)
class Policy:
    """A version's rules: a document is dropped if it fails any of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeat_words"))
POLICIES = {p.version: p for p in (BASE, Policy("2", tuple(RULES)))}


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at \x20 and \x09-\x0D, and nowhere else
    n = len(words)
    solid = len(text.translate(_SPACE))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    letters = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, int)
    return (
        n,
        solid,
        sum(int(letters[ord(c)]) for c in _SYMBOLS),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        int(letters[65:91].sum()),
        int(letters[97:123].sum()),
    )


def _repeated(words: list[bytes]) -> int:
    """Words that stand in a window of five words found twice or more."""
    n = len(words)
    if n <= _WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    starts = n - _WINDOW + 1
    pair = at[:-1] * len(ids) + at[1:]  # exact: below n * n
    pair = np.unique(pair, return_inverse=True)[1]
    four = np.unique(pair[:-2] * n + pair[2:], return_inverse=True)[1]
    five = four[:starts] * n + at[_WINDOW - 1 :]
    _, code, count = np.unique(five, return_inverse=True, return_counts=True)
    twice = count[code] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[:starts] += twice
    edge[_WINDOW:] -= twice
    return int((np.cumsum(edge[:n]) > 0).sum())


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t) for t in batch.column(1).to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and rule_bits (long), one row for each document."""
    measured = documents(docs).mapInArrow(_measure_batches, _SCHEMA)
    bits = sum((F.when(F.expr(rule), 1 << i).otherwise(0) for i, rule in enumerate(RULES.values())), F.lit(0))
    return measured.withColumn("rule_bits", bits.cast("long"))


def stored(docs: DataFrame) -> DataFrame:
    """The ledger, written once to the shared folder: policies and ablations read it and no text again."""
    return Table(ledger(docs), "ledger").df


def apply_policy(rows: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    """Adds the verdict of one policy version."""
    return rows.withColumn(column, F.col("rule_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (and would come back
    without it), and that fail it with others."""
    bits = F.col("rule_bits").bitwiseAND(F.lit(policy.mask))
    patterns = rows.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).alias("bit")) for r in policy.rules])
    return (
        patterns.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.expr("bits & r.bit") != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.expr("bits = r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum("n").alias("n_documents"),
        )
    )
