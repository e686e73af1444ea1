"""Live views of a stream: newest values, and health per time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.operators.health import metric_means, score_means
from fleetgauge.operators.select import filter_satellites_in
from fleetgauge.sources.tables import remove_path
from fleetgauge.streaming.ingest import BatchWriter, stream_flush


def stream_latest(records: DataFrame, satellite_ids: Sequence[str] | None = None) -> DataFrame:
    """The newest record of each satellite; the state is one record per satellite.

    Of records with the same time the one whose other values are greatest, column by column. In update mode a
    batch has the satellites whose newest record changed, for `upsert_batch`.
    """
    if satellite_ids:
        records = filter_satellites_in(records, satellite_ids)
    columns = [c for c in records.columns if c not in ("satellite_id", "timestamp")]
    newest = F.max(F.struct("timestamp", *columns)).alias("newest")
    return records.groupBy("satellite_id").agg(newest).select("satellite_id", "newest.*").select(*records.columns)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) of the batches in each folder that counts: complete, and not held by a wider one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(f"{path}/versions=*/_SUCCESS"))
    spans = [tuple(map(int, f.getPath().getParent().getName().split("=")[1].split("-"))) for f in found or []]
    return sorted(a for a in spans if not any(b != a and b[0] <= a[0] and a[1] <= b[1] for b in spans))


def _newest_version(spark: SparkSession, path: str, spans: list[tuple[int, int]], schema: str) -> DataFrame:
    paths = [f"{path}/versions={a}-{b}" for a, b in spans]
    rows = spark.read.schema(f"{schema}, versions string").option("basePath", path).parquet(*paths)
    columns = [c for c in rows.columns if c not in ("satellite_id", "versions")]
    last = F.substring_index("versions", "-", -1).cast("long")
    return rows.groupBy("satellite_id").agg(F.max_by(F.struct(*columns), last).alias("row")).select("satellite_id", "row.*")


def upsert_batch(path: str, merge_every: int = C.MERGE_EVERY) -> BatchWriter:
    """Writes what changed, one row per satellite, as a version of its own; `read_latest` takes the newest of each.

    After every `merge_every` batches the versions before become one, so that there are never many; those that
    it replaces go with the next merge.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = [v for v in _versions(spark, path) if v[1] < batch_id]
        if len(old) > merge_every:
            hadoop = spark._jvm.org.apache.hadoop.fs
            for f in hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(f"{path}/versions=*")):
                name = f.getPath().getName().split("=")[1]
                if tuple(map(int, name.split("-"))) not in old and int(name.split("-")[1]) < batch_id:
                    remove_path(spark, f"{path}/versions={name}")
            _newest_version(spark, path, old, _ddl(batch)).write.mode("overwrite").parquet(f"{path}/versions={old[0][0]}-{old[-1][1]}")
        batch.write.mode("overwrite").parquet(f"{path}/versions={batch_id}-{batch_id}")

    return write


def read_latest(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The newest record of each satellite that `upsert_batch` wrote; `like` has its columns."""
    spans = _versions(spark, path)
    return _newest_version(spark, path, spans, _ddl(like)).select(*like.columns) if spans else spark.createDataFrame([], like.schema)


def stream_window_health(records: DataFrame, width: str = "1 hour", lateness: str | None = "10 minutes") -> DataFrame:
    """Health of each satellite in each time window, by the expressions of the batch score.

    On a stream, `lateness` sets how long a window waits for late readings.
    """
    if lateness and records.isStreaming:
        records = records.withWatermark("timestamp", lateness)
    means = metric_means(records, keys=(F.window("timestamp", width), F.col("satellite_id")))
    scored = score_means(means)
    return scored.select(
        "satellite_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "health_score", "status",
    )


def stream_late_data(records: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Readings of each satellite and window, as far as they are not later than `lateness`.

    What comes after its window has closed changes no window; it is in the store all the same.
    """
    counts = records.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", width), "satellite_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("satellite_id", F.col("window.start").alias("start"), "n")


def table_writer(path: str) -> BatchWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def drain(records: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a streaming frame over all that has arrived and returns what it wrote.

    In complete mode every batch holds the whole result, so only the last one is returned.
    """
    spark: SparkSession = records.sparkSession
    query = stream_flush(
        records, table_writer(f"{folder}/out"), f"{folder}/checkpoint", available_now=True, mode=mode
    )
    query.awaitTermination()
    written = spark.read.schema(f"{_ddl(records)}, batch long").parquet(f"{folder}/out")
    if mode == "complete":
        written = written.where(F.col("batch") == written.agg(F.max("batch")).scalar())
    return written.drop("batch")
