"""A corpus pipeline over ``documents``: language identification, near-duplicate removal, redaction of
personal data, mixing of sources, tokenisation.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. A text that redaction changed gets its new n_chars. A document of
the mix appears as often as it is taken.

Defined cases, for every stage: an empty table gives none; whole texts are read, however long; further columns are
kept, also where their names differ from the wanted ones by case only; a null doc_id or source and repeated rows are
rows like others. A null text or one without letters goes with the rejected languages; a stage given one all the same
keeps it (near_duplicates, personal_data), drops it as it has no words (mixture) or gives no tokens (tokenised).
Equal near-duplicate candidates are settled by the smallest doc_id, equal rows by their place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import bpe, jaccard, langid, mixing, pii
from vecloom.llm.common import Table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected: no letters, or a calibrated score below the threshold."""
    return langid.known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of five-word-shingle similarity 0.8 or more."""
    return jaccard.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in angle brackets in place of each span of personal data."""
    return pii.redact(docs, length="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until each source's words meet its target."""
    return mixing.resample(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, exact of every document of the mix."""
    import public_tokenizers

    return bpe.tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokenised", tokenised),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
