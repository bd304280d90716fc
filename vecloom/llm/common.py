"""What the training-data operators share: column picking, scratch tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
"""A word of the mixing and quality contracts, as a Java, Python and RE2 pattern."""


BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Arrow batches end at BATCH_BYTES, unless the session has its own bound: by rows alone, a batch of long texts has
    as many bytes as they have, several times over in the JVM and its Python worker."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def pick(df: DataFrame, **names: str) -> DataFrame:
    """``pick(df, doc_id="id")`` selects column ``id`` as ``doc_id``.

    Columns are resolved by position after an exact (then a case-insensitive) name match, so
    further columns whose names clash, also by case only, never make a reference ambiguous.
    A wanted column that is missing reads as null.
    """
    bounded(df.sparkSession)
    have = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])
    out = []
    for new, old in names.items():
        at = [i for i, c in enumerate(have) if c == old] or [i for i, c in enumerate(have) if c.lower() == old.lower()]
        out.append((F.col(f"_c{at[0]}") if at else F.lit(None)).alias(new))
    return plain.select(*out)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id long, text string of a table shaped like ``documents``."""
    return pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or in local mode (tests) one of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Table:
    """A DataFrame written as Parquet to the shared folder and reread: durable, lineage cut."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{scratch(self.spark)}/vecloom-{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; only when nothing lazy reads them any more."""
        drop_path(self.spark, self.path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_all(tables: Iterable[Table]) -> None:
    for t in tables:
        t.drop()


def keyed(docs: DataFrame) -> DataFrame:
    """did, th of each row: its doc_id (-1 for null) and a hash of its text, which name its text exactly."""
    d = documents(docs)
    return d.select(F.coalesce("doc_id", F.lit(-1)).alias("did"), F.xxhash64("text").alias("th"))


def allot(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` with, in all, c rows for each (did, th, m, c) of ``keys``, m being the rows that share
    the key: dropped where c is 0 or the key is absent, repeated where it asks for more than there are."""
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*plain)
    at = {n: plain[names.index(n) if n in names else [x.lower() for x in names].index(n)] for n in ("doc_id", "text")}
    rows = rows.withColumn("did", F.coalesce(F.col(at["doc_id"]).cast("long"), F.lit(-1))).withColumn("th", F.xxhash64(F.col(at["text"]).cast("string")))
    met = rows.join(keys.where("c > 0").select("did", "th", "m", "c").hint("merge"), ["did", "th"])
    out = met.where("m = 1").select(*plain, F.col("c").alias("k"))
    if not keys.where("m > 1 AND c > 0").isEmpty():  # rows that are equal share out what their key gets
        turn = F.row_number().over(Window.partitionBy("did", "th").orderBy(F.lit(1)))
        shared = met.where("m > 1").withColumn("turn", turn).withColumn("k", F.floor(F.col("c") / F.col("m")) + (F.col("turn") <= F.col("c") % F.col("m")).cast("long"))
        out = out.union(shared.where("k > 0").select(*plain, "k"))
    repeated = out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k")))).select(*plain)
    return repeated.toDF(*names)
