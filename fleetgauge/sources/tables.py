"""Reading and appending the stored tables, exports, and the registry file."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge import schemas
from fleetgauge.operators.select import parsed_timestamp


# Text exports keep microseconds.
CSV_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _as_declared(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns by name in declared order and type; absent ones are null, NaN becomes null."""
    columns, present = [], set(df.columns)
    for field in schema.fields:
        if field.name not in present:
            value = F.lit(None).cast(field.dataType)
        elif field.dataType == T.DoubleType():
            value = F.nanvl(F.col(field.name).cast("double"), F.lit(None).cast("double"))
        elif field.name == "timestamp":
            value = parsed_timestamp(df)
        else:
            value = F.col(field.name).cast(field.dataType)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def scan_telemetry(source: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    """The telemetry table with its declared schema, from a path or from a frame."""
    df = spark.read.parquet(source) if isinstance(source, str) else source
    return _as_declared(df, schemas.TELEMETRY)


def sql_query(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], args: dict | None = None) -> DataFrame:
    """User SQL over named tables, with bound arguments.

    The names are views only while the text is analysed: afterwards those that the caller had before are back,
    and no other is left behind.
    """
    before = {n: spark.table(n) for n in tables if any(t.isTemporary for t in spark.catalog.listTables(pattern=n))}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql, args=args)
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def generate_ids(df: DataFrame, first: int = 1) -> DataFrame:
    """Unique ids from `first` on; they rise inside a partition and leave gaps between them."""
    return df.withColumn("id", F.monotonically_increasing_id() + F.lit(first))


def coerce_batch(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Live records (text timestamps, any columns missing) as telemetry rows without id; `keep` names columns beside."""
    declared = T.StructType(schemas.TELEMETRY.fields + [records.schema[c] for c in keep])
    return _as_declared(records, declared).drop("id")


def numbered(df: DataFrame, coming: str, first: int) -> DataFrame:
    """Rows with ids from `first` on, without gaps, however many a partition has.

    They are written to `coming` first: the files and the row numbers in them then give each row its
    own number, and the same one if a task runs again. The caller removes `coming` when it is done.
    """
    df.write.mode("overwrite").parquet(coming)
    return with_numbers(df.sparkSession.read.schema(df.schema).parquet(coming), first)


def with_numbers(stored: DataFrame, first: int) -> DataFrame:
    """Rows of Parquet files, read as they are, with ids from `first` on by file and row number, without gaps."""
    rows = stored.select("*", "_metadata.file_path", "_metadata.row_index")
    # One row per file.
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    files = rows.groupBy("file_path").count().select("file_path", offset)
    placed = rows.join(files, "file_path").withColumn("id", F.col("offset") + F.col("row_index") + first)
    return placed.drop("file_path", "row_index", "offset")


_FILES_PER_FOLDER = 8


def _append(df: DataFrame, schema: T.StructType, path: str, folders: Sequence[str] = ()) -> None:
    """Appends; rows without an id get numbers from the present nanosecond on, so no look at the store is needed."""
    coming = f"{path}/_coming-{uuid.uuid4().hex}"
    rows = df if "id" in df.columns else numbered(df, coming, time.time_ns())
    try:
        declared = _as_declared(rows, schema)
        if folders:
            # A few files per folder, and a large one still spread over some tasks.
            declared = declared.repartition(*folders, F.pmod(F.xxhash64("id"), F.lit(_FILES_PER_FOLDER)))
        declared.write.mode("append").partitionBy(*folders).parquet(path)
    finally:
        remove_path(df.sparkSession, coming)


def append_telemetry(batch: DataFrame, path: str) -> None:
    """Appends a batch by column name; rows without an id get new ones."""
    _append(batch, schemas.TELEMETRY, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def remove_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def write_result_table(df: DataFrame, table: str, path: str) -> None:
    """Appends result rows in the declared schema of the table, one folder per satellite."""
    _append(df, schemas.TABLES[table], path, ["satellite_id"])


def read_result_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[table]).parquet(path)


def _flat(df: DataFrame) -> DataFrame:
    """Lists as text, since a CSV cell holds one value."""
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " | ") for c in lists})


def export_csv(df: DataFrame, path: str) -> None:
    writer = _flat(df).write.mode("overwrite").option("header", True)
    writer.option("timestampFormat", CSV_TIME).csv(path)


def export_json_report(reports: DataFrame, path: str) -> None:
    """One JSON document per satellite and line."""
    reports.write.mode("overwrite").option("timestampFormat", JSON_TIME).json(path)


def export_report_bundle(sheets: Mapping[str, DataFrame], path: str, format: str = "parquet") -> None:
    """Several named tables under one folder."""
    for name, df in sheets.items():
        if format == "csv":
            export_csv(df, f"{path}/{name}")
        else:
            df.write.mode("overwrite").format(format).save(f"{path}/{name}")


def load_registry(spark: SparkSession, path: str, *, one_list: bool = False) -> DataFrame:
    """The registry from lines of JSON, or from a file that is one JSON list."""
    return spark.read.schema(schemas.REGISTRY_FILE).option("multiLine", one_list).json(path)


def save_registry(registry: DataFrame, folder: str) -> str:
    """Writes a new version beside the old ones, which may still be read from; returns its path.

    One satellite per line, so that the registry is written in parallel.
    """
    path = f"{folder}/version={time.time_ns()}"
    registry.write.json(path)
    return path


def load_saved_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The newest complete version."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    parent = hadoop.Path(folder)
    files = parent.getFileSystem(spark._jsc.hadoopConfiguration())
    complete = files.globStatus(hadoop.Path(folder, "version=*/_SUCCESS"))
    newest = max(found.getPath().getParent().toString() for found in complete)
    return load_registry(spark, newest)
