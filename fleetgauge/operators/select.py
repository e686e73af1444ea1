"""Filters, projections, sorts and unions of telemetry rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge import constants as C
from fleetgauge.functions.scalars import dedup_key, label_of
from fleetgauge.operators.grouping import KEYS, Spread, ordering, present, spread_of
from fleetgauge.operators.ordering import reading_index

# Above this, Spark no longer cuts groups to their newest rows before the shuffle.
_SALTS = 256


def filter_satellite(df: DataFrame, satellite_id: str) -> DataFrame:
    return df.where(F.col("satellite_id") == F.lit(satellite_id))


def filter_satellites_in(df: DataFrame, satellite_ids: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the listed satellites; a long list may be given as a DataFrame of ids."""
    if isinstance(satellite_ids, DataFrame):
        return df.join(satellite_ids.select("satellite_id"), "satellite_id", "left_semi")
    return df.where(F.col("satellite_id").isin(list(satellite_ids)))


def active_satellites(registry: DataFrame) -> DataFrame:
    return registry.where(F.lower("status") == "active")


def _time_of(timestamp: Column) -> Column:
    """A time from ISO text; a bare number is no time, even where it looks like a year."""
    return F.when(timestamp.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(timestamp))


def parsed_timestamp(df: DataFrame, column: str = "timestamp") -> Column:
    if isinstance(df.schema[column].dataType, T.StringType):
        return _time_of(F.col(column))
    return F.col(column).cast("timestamp")


def is_valid_record(df: DataFrame) -> Column:
    return F.col("satellite_id").isNotNull() & parsed_timestamp(df).isNotNull()


def valid_record_filter(df: DataFrame) -> DataFrame:
    return df.where(is_valid_record(df))


def rejected_records(df: DataFrame) -> DataFrame:
    return df.where(~is_valid_record(df))


def fill_ingest_defaults(df: DataFrame) -> DataFrame:
    defaults = {"ingested_at": F.current_timestamp(), "data_source": F.lit(C.DEFAULT_SOURCE)}
    filled = {}
    for name, default in defaults.items():
        if name in df.columns:
            default = F.coalesce(F.col(name).cast(T.TimestampType() if name == "ingested_at" else "string"), default)
        filled[name] = default
    return df.withColumns(filled)


def coerce_timestamps(df: DataFrame) -> DataFrame:
    """Text to time; rows whose time cannot be read are dropped."""
    return df.withColumn("timestamp", parsed_timestamp(df)).dropna(subset=["timestamp"])


def with_dedup_key(df: DataFrame) -> DataFrame:
    return df.withColumn("dedup_key", dedup_key(F.col("satellite_id"), F.col("timestamp").cast("string")))


def numeric_projection(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *present(df, C.METRICS))


def melt_metrics(df: DataFrame, metrics: Sequence[str], ids: Sequence[str] = ("satellite_id", "timestamp")) -> DataFrame:
    """One row per reading and metric."""
    metrics = present(df, metrics)
    doubles = [F.col(m).cast("double").alias(m) for m in metrics]
    return df.select(*ids, *doubles).unpivot(list(ids), metrics, "metric", "value")


def sort_by_time(df: DataFrame) -> DataFrame:
    return df.orderBy(*ordering(df))


def series_points(df: DataFrame, metric: str, satellite_id: str | None = None) -> DataFrame:
    """Time-ordered points of one metric, for line, area and step charts."""
    rows = filter_satellite(df, satellite_id) if satellite_id else df
    ids = present(rows, ["id"])
    points = rows.select("satellite_id", "timestamp", *ids, F.col(metric).alias("value"))
    return points.orderBy("satellite_id", "timestamp", *ids)


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    columns = ["satellite_id", F.col(x).alias("x"), F.col(y).alias("y")]
    if color:
        columns.append(F.col(color).alias("color"))
    return pair_complete(df, x, y).select(*columns)


def pair_complete(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def preview(df: DataFrame, rows: int = 50) -> DataFrame:
    return sort_by_time(df).limit(rows)


def satellite_ids(df: DataFrame) -> DataFrame:
    return df.select("satellite_id").distinct().orderBy("satellite_id")


def latest_readings(df: DataFrame, rows: int = 500, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """The newest rows of each satellite, the newest first by `recency`.

    Cut in two steps, the first over many parts of each satellite, so that no task gets more than
    `rows` rows of a part from each task before it, or of each part.
    """
    newest = [F.col(c).desc() for c in ordering(df)]
    part = Window.partitionBy(*keys, "_part").orderBy(*newest)
    salt = F.pmod(F.xxhash64(*ordering(df)), F.lit(_SALTS))
    df = df.withColumn("_part", salt).withColumn("_in_part", F.row_number().over(part))
    df = df.where(F.col("_in_part") <= rows).drop("_part", "_in_part")
    ranked = df.withColumn("recency", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest)))
    return ranked.where(F.col("recency") <= rows)


def current_position(df: DataFrame, columns: Sequence[str] = ("latitude", "longitude", "altitude_km")) -> DataFrame:
    """The last row of each satellite, by one aggregate without a sort."""
    order = ordering(df)
    values = F.struct(*order, *columns)
    last = df.groupBy("satellite_id").agg(F.max_by(values, F.struct(*order)).alias("last"))
    return last.select("satellite_id", "last.*")


def mark_duplicates(
    df: DataFrame, columns: Sequence[str] | None = None, *, split: Spread | bool | None = None
) -> DataFrame:
    """Flags all but the first of the rows that agree in the given columns (default: in all)."""
    by = list(columns or df.columns)
    split = spread_of(df.select(F.xxhash64(*by).alias("row_hash")), ["row_hash"], split)
    order = [c for c in ordering(df) if c not in by]
    copies = reading_index(df, keys=by, order=order, name="_copy", split=split)
    return copies.withColumn("is_duplicate", F.col("_copy") > 0).drop("_copy")


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.distinct()


def union_batches(*batches: DataFrame) -> DataFrame:
    result = batches[0]
    for batch in batches[1:]:
        result = result.unionByName(batch, allowMissingColumns=True)
    return result


def mission_timeline(events: DataFrame, *, time: str = "timestamp", name: str = "name", lanes: Sequence[str] = KEYS) -> DataFrame:
    """Events in time order with a lane number and a name, `Event n` where it has none."""
    order = [time, *present(events, ["id"])]
    placed = reading_index(events, keys=lanes, order=order, name="lane")
    default = F.concat(F.lit("Event "), (F.col("lane") + 1).cast("string"))
    return placed.withColumn("name", F.coalesce(F.col(name), default) if name in events.columns else default)


def labelled_metrics(df: DataFrame) -> DataFrame:
    return df.withColumn("label", label_of(F.col("metric")))
