"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder: the session's ``spark.checkpoint.dir``, and one of our own only
    where that is unset on a local master, as in tests; a cluster must name it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of our own from whatever file system it is on."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: its lineage is cut, and it survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame, name: str = "__in") -> Column:
    """All columns of ``df`` in one struct, so that a caller's names never clash with ours."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)


def unpacked(columns: list[str], without: tuple[str, ...] = (), name: str = "__in") -> list[Column]:
    return [F.col(f"{name}.`{c}`").alias(c) for c in columns if c not in without]


def identity(doc_id: Column, text: Column) -> Column:
    """A 128-bit hash of an id and a text; null is neither of any id nor of any text."""
    shown, plain = F.coalesce(doc_id.cast("string"), F.lit("\u0000null")), F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(shown, plain, text.isNull()).alias("h1"), F.xxhash64(plain, F.lit("|"), shown).alias("h2"))


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) that depends on ``parts`` alone, so a repeated task draws it again."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))
