"""Session settings and the shared folder for tables written between two steps."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "fleetgauge", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_base() -> str:
    folder = tempfile.mkdtemp(prefix="fleetgauge-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """A new path under the cluster's checkpoint folder.

    Every executor must reach it, so a machine-local folder is used only when Spark itself runs
    on one machine and no folder was configured.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/fleetgauge-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Writes the rows to a checkpoint in the shared folder.

    The result no longer depends on how the rows were computed, so a lost executor cannot make
    two readers see different rows. Spark deletes the copy once nothing refers to it
    (`spark.cleaner.referenceTracking.cleanCheckpoints`, which `build_session` turns on).
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Writes the rows as a table in the shared folder, so that each reader reads only the columns it needs.

    The table goes when the program ends, if it still can; else with the folder.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:
            # The session has ended before.
            return
