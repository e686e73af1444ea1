"""Helpers that several operators share: folders, pinned tables, text expressions."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that the contracts count as white space.
SPACES = (" ", "\t", "\n", "\x0b", "\f", "\r")
WORD = r"[^\x20\x09-\x0D]+"


@functools.cache
def _own_base() -> str:
    return "file://" + tempfile.mkdtemp(prefix="llm-")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that the cluster names; an own one only in a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_base()
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def pinned(df: DataFrame, kind: str) -> DataFrame:
    """The rows, written to the shared folder and read again, so that every later reader sees the same ones."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for char in SPACES:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))
