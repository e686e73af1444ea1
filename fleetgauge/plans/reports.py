"""Analytics reports and report documents: one nested row per satellite."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions.scalars import iso_time
from fleetgauge.operators.anomaly import anomaly_summary, detect_statistical
from fleetgauge.operators.grouping import KEYS, Spread, join_groups, spread_of
from fleetgauge.operators.health import health_report
from fleetgauge.operators.relations import correlation_matrix, rank_relationships, relationships
from fleetgauge.operators.series import trend
from fleetgauge.operators.statistics import distribution_analysis, statistics_summary


def nested(df: DataFrame, name: str, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """The rows of each satellite as one list; used on results of fixed length per satellite."""
    item = F.struct(*([order] if order else []), *columns)
    return df.groupBy("satellite_id").agg(F.sort_array(F.collect_list(item)).alias(name))


def metric_rank(metrics: Sequence[str], column: str = "metric") -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col(column))


def _by_metric(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return df.withColumn("rank", metric_rank(metrics))


def _join_all(base: DataFrame, *parts: DataFrame) -> DataFrame:
    return reduce(lambda left, right: join_groups(left, right, KEYS), parts, base)


def records_per_satellite(df: DataFrame) -> DataFrame:
    return df.groupBy("satellite_id").agg(F.count(F.lit(1)).alias("record_count"))


def analytics_report(df: DataFrame, *, split: Spread | bool | None = None) -> DataFrame:
    """Statistics, correlations, relationships, trends and distributions of every satellite."""
    spread = spread_of(df, KEYS, split)
    statistics = _by_metric(statistics_summary(df), C.METRICS)
    trends = _by_metric(trend(df, split=spread), C.TREND_METRICS)
    shapes = _by_metric(distribution_analysis(df), C.DISTRIBUTION_METRICS)
    matrix = correlation_matrix(df).withColumn("rank", metric_rank(C.METRICS, "col_x") * 100 + metric_rank(C.METRICS, "col_y"))
    related = rank_relationships(relationships(df))
    return _join_all(
        records_per_satellite(df),
        nested(statistics, "statistics", ["metric", "mean", "std", "min", "max", "unit"], "rank"),
        nested(matrix, "correlations", ["col_x", "col_y", "r"], "rank"),
        nested(related, "relationships", ["name", "correlation", "p_value", "strength", "direction"], "rank"),
        nested(trends, "trends", ["metric", "slope", "direction", "magnitude", "unit_per_sample"], "rank"),
        nested(
            shapes, "distributions",
            ["metric", "is_normal", "normality_p_value", "skewness", "kurtosis", "distribution_type"], "rank",
        ),
    )


def explain_inputs(
    df: DataFrame, *, flagged: DataFrame | None = None, split: Spread | bool | None = None
) -> DataFrame:
    """All that an explanation uses, one row per satellite.

    `flagged` holds the forest's flags (`isolation_forest_score`); without it the flagged
    percentage is null.
    """
    spread = spread_of(df, KEYS, split)
    events = detect_statistical(df, split=spread)
    anomalies = anomaly_summary(df if flagged is None else flagged, events)
    found = F.struct("total_anomalies", "ml_anomaly_pct", "severity", "summary").alias("anomalies")
    statistics = _by_metric(statistics_summary(df), C.METRICS)
    trends = _by_metric(trend(df, split=spread), C.TREND_METRICS)
    shapes = _by_metric(distribution_analysis(df), C.DISTRIBUTION_METRICS)
    related = rank_relationships(relationships(df))
    return _join_all(
        health_report(df),
        records_per_satellite(df),
        nested(statistics, "statistics", ["metric", "mean", "std", "min", "max", "unit"], "rank"),
        nested(trends, "trends", ["metric", "slope", "direction"], "rank"),
        nested(related, "relationships", ["name", "correlation", "strength", "direction"], "rank"),
        nested(shapes, "distributions", ["metric", "distribution_type", "skewness", "kurtosis"], "rank"),
        anomalies.select("satellite_id", found),
    )


def report_document(inputs: DataFrame, insights: Column | None = None, source: str = "recorded") -> DataFrame:
    """The nested report of each satellite from `explain_inputs`."""
    return inputs.select(
        "satellite_id",
        F.struct(
            iso_time(F.current_timestamp()).alias("generated_at"), F.col("satellite_id"),
            F.lit("Telemetry Analysis Report").alias("report_type"),
            F.col("record_count").alias("total_records"), F.lit(source).alias("data_source"),
        ).alias("report_metadata"),
        F.struct(F.col("health_score").alias("score"), "status", "recommendations").alias("health_assessment"),
        F.map_from_entries(
            F.transform("statistics", lambda s: F.struct(s["metric"], s.dropFields("rank", "metric")))
        ).alias("statistical_summary"),
        F.col("anomalies").alias("anomaly_report"),
        (F.lit("") if insights is None else insights).alias("ai_insights"),
    )
