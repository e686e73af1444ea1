"""Joins between telemetry, the satellite registry and labelled intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.scalars import mission_status
from fleetgauge.operators.grouping import KEYS, ORDER, Spread, join_groups
from fleetgauge.operators.ordering import reading_index

BLOCK_READINGS = 1024


def join_anomaly_counts(health: DataFrame, counts: DataFrame) -> DataFrame:
    """Health rows with the number of events of the satellite, 0 where it had none."""
    totals = counts.groupBy("satellite_id").agg(F.sum("events").alias("anomaly_count"))
    return join_groups(health, totals, KEYS).withColumn(
        "anomaly_count", F.coalesce("anomaly_count", F.lit(0))
    )


def orphan_telemetry(df: DataFrame, registry: DataFrame) -> DataFrame:
    return df.join(registry, "satellite_id", "left_anti")


def satellites_with_data(registry: DataFrame, df: DataFrame) -> DataFrame:
    """Registered satellites with readings; the readings collapse to their ids first."""
    return registry.join(df.select("satellite_id").distinct(), "satellite_id", "left_semi")


def register_satellite(registry: DataFrame, records: DataFrame) -> DataFrame:
    """Adds records whose id is new and whose id and name are set, one of equal ids."""
    named = records.where(
        (F.coalesce(F.col("satellite_id"), F.lit("")) != "") & (F.coalesce(F.col("name"), F.lit("")) != "")
    )
    fresh = named.join(registry, "satellite_id", "left_anti")
    # Of equal ids the record that sorts first, column by column.
    others = [c for c in fresh.columns if c != "satellite_id"]
    new = fresh.groupBy("satellite_id").agg(F.min(F.struct(*others)).alias("_first")).select("satellite_id", "_first.*")
    if "registered_at" in registry.columns and "registered_at" not in new.columns:
        new = new.withColumn("registered_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    return registry.unionByName(new, allowMissingColumns=True)


def update_status(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Sets status and updated_at of the satellites in `changes` (satellite_id, status)."""
    # Of several changes of a satellite the status that sorts first.
    new = changes.groupBy(F.col("satellite_id").alias("_id")).agg(F.min("status").alias("_status"))
    joined = registry.join(new, F.col("satellite_id") == F.col("_id"), "left")
    old = F.col("updated_at") if "updated_at" in registry.columns else F.lit(None).cast("string")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return joined.withColumns(
        {
            "updated_at": F.when(F.col("_id").isNotNull(), now).otherwise(old),
            "status": F.coalesce("_status", "status"),
        }
    ).drop("_id", "_status")


def remove_satellite(registry: DataFrame, ids: DataFrame) -> DataFrame:
    return registry.join(ids.select("satellite_id"), "satellite_id", "left_anti")


def _strength(kind: Column, severity: Column, progress: Column) -> Column:
    ramp = severity * progress
    triangle = severity * (1 - F.abs(2 * progress - 1))
    return (
        F.when(kind == "battery_degradation", ramp)
        .when(kind.isin("temperature_spike", "signal_loss"), triangle)
        .when(kind.isin("cpu_spike", "memory_spike", "sensor_failure"), severity)
    )


def label_scenario_windows(
    df: DataFrame, windows: DataFrame, *, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
    split: Spread | bool | None = None,
) -> DataFrame:
    """Readings inside labelled index intervals, with the strength of each label there.

    The range join runs as an equi-join: intervals are cut into blocks of reading numbers, and a
    reading meets only the intervals of its own block, so a long history spreads over many keys.
    Of intervals of one type on one reading, the one that starts last counts.
    """
    indexed = reading_index(df, keys=keys, order=order, split=split)
    indexed = indexed.withColumn("_block", F.floor(F.col("reading_index") / BLOCK_READINGS))
    end = F.col("start_index") + F.col("duration")
    blocks = F.sequence(
        F.floor(F.col("start_index") / BLOCK_READINGS), F.floor((end - 1) / BLOCK_READINGS)
    )
    cut = windows.where(F.col("duration") > 0).withColumn("_block", F.explode(blocks))
    inside = indexed.join(cut, [*keys, "_block"]).where(
        (F.col("reading_index") >= F.col("start_index")) & (F.col("reading_index") < end)
    )
    progress = (F.col("reading_index") - F.col("start_index")) / F.greatest(F.lit(1), F.col("duration"))
    strength = _strength(F.col("type"), F.col("severity"), progress)
    return inside.groupBy(*keys, *order, "reading_index", "type").agg(
        F.max_by(strength, "start_index").alias("strength")
    )


def scenario_status(labels: DataFrame, *, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Mission status of each labelled reading from the strengths of its labels."""
    kinds = ("battery_degradation", "sensor_failure", "signal_loss")
    strengths = labels.groupBy(*keys, *order, "reading_index").agg(
        *[F.max(F.when(F.col("type") == k, F.col("strength"))).alias(k) for k in kinds]
    )
    status = mission_status(*[F.col(k) for k in kinds])
    return strengths.select(*keys, *order, "reading_index", status.alias("mission_status"))
