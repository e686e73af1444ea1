"""Descriptive statistics per satellite and metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions.scalars import classify_distribution, unit_of
from fleetgauge.functions.tests_of_fit import with_normality_p
from fleetgauge.operators.grouping import KEYS, Spread, join_groups, present, scoped, spread_of
from fleetgauge.operators.quantiles import metric_quantiles, modes
from fleetgauge.operators.select import melt_metrics

PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _moments():
    return [
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.var_samp("value").alias("variance"), F.stddev_samp("value").alias("std_dev"),
        F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"),
        F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("missing"),
    ]


def column_statistics(
    df: DataFrame, *, metrics: Sequence[str] = C.METRICS, keys: Sequence[str] = KEYS,
    split: Spread | bool | None = None,
) -> DataFrame:
    """Nineteen numbers per satellite and metric; a metric without any value is left out."""
    df, keys = scoped(df, keys)
    split = spread_of(df, keys, split)
    values = melt_metrics(df, metrics, keys)
    by = [*keys, "metric"]
    result = values.groupBy(*by).agg(*_moments()).where(F.col("count") > 0)
    result = join_groups(result, metric_quantiles(df, metrics, keys, PERCENTILES, split=split), by)
    result = join_groups(result, modes(values, by, "value"), by)
    return result.select(
        *by, "mean", F.col("p50").alias("median"), "mode", "min", "max",
        (F.col("max") - F.col("min")).alias("range_value"), "variance", "std_dev",
        *PERCENTILES, "skewness", "kurtosis", "count", "missing",
        (F.col("p75") - F.col("p25")).alias("iqr"),
    )


def statistics_summary(
    df: DataFrame, *, metrics: Sequence[str] = C.METRICS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean, deviation, least, greatest and unit: one partial aggregate over the wide rows."""
    df, keys = scoped(df, keys)
    metrics = present(df, metrics)
    grouped = df.groupBy(*keys).agg(
        *[
            F.struct(
                F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"),
                F.min(m).cast("double").alias("min"), F.max(m).cast("double").alias("max"),
            ).alias(m)
            for m in metrics
        ]
    )
    long = grouped.unpivot(list(keys), list(metrics), "metric", "s")
    return long.where(F.col("s.mean").isNotNull()).select(
        *keys, "metric", "s.*", unit_of(F.col("metric")).alias("unit")
    )


def describe_columns(
    df: DataFrame, *, metrics: Sequence[str] = C.METRICS, keys: Sequence[str] = KEYS,
    split: Spread | bool | None = None,
) -> DataFrame:
    """Count, mean, deviation, least, quartiles and greatest, empty metrics included."""
    df, keys = scoped(df, keys)
    split = spread_of(df, keys, split)
    values = melt_metrics(df, metrics, keys)
    by = [*keys, "metric"]
    sums = values.groupBy(*by).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = {name: PERCENTILES[name] for name in ("p25", "p50", "p75")}
    return join_groups(sums, metric_quantiles(df, metrics, keys, quartiles, split=split), by)


def distribution_analysis(
    df: DataFrame, *, metrics: Sequence[str] = C.DISTRIBUTION_METRICS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Normality and shape of each metric with at least ten values."""
    df, keys = scoped(df, keys)
    shape = melt_metrics(df, metrics, keys).groupBy(*keys, "metric").agg(
        F.count("value").alias("count"), F.skewness("value").alias("skewness"),
        F.kurtosis("value").alias("kurtosis"),
    )
    long_enough = shape.where(F.col("count") >= 10)
    tested = with_normality_p(long_enough, "normality_p_value", "count", "skewness", "kurtosis")
    return tested.select(
        *keys, "metric", (F.col("normality_p_value") > 0.05).alias("is_normal"), "normality_p_value",
        "skewness", "kurtosis", classify_distribution(F.col("skewness")).alias("distribution_type"),
    )


def impute_median(
    df: DataFrame, metrics: Sequence[str], *, keys: Sequence[str] = KEYS, split: Spread | bool | None = None
) -> DataFrame:
    """Nulls replaced by the group's median of the metric."""
    spread = spread_of(df, keys, split)
    medians = group_medians(df, metrics, keys=keys, split=spread)
    joined = join_groups(df, medians, keys, few=spread.few)
    filled = {m: F.coalesce(F.col(m), F.col(f"_median_{m}")) for m in metrics}
    return joined.withColumns(filled).drop(*[f"_median_{m}" for m in metrics])


def group_medians(
    df: DataFrame, metrics: Sequence[str], *, keys: Sequence[str], split: Spread | bool | None = None
) -> DataFrame:
    """One row per group with `_median_<metric>`."""
    found = metric_quantiles(df, metrics, keys, {"median": 0.5}, split=split)
    by_metric = [
        F.max(F.when(F.col("metric") == m, F.col("median"))).alias(f"_median_{m}") for m in metrics
    ]
    return found.groupBy(*keys).agg(*by_metric)


def standardize(
    df: DataFrame, metrics: Sequence[str], *, keys: Sequence[str] = KEYS,
    split: Spread | bool | None = None,
) -> DataFrame:
    """Distance from the mean in population deviations; a constant metric keeps its distance, 0."""
    sums = df.groupBy(*keys).agg(
        *[F.avg(m).alias(f"_mean_{m}") for m in metrics],
        *[F.stddev_pop(m).alias(f"_std_{m}") for m in metrics],
    )
    scaled = {
        m: (F.col(m) - F.col(f"_mean_{m}"))
        / F.when(F.col(f"_std_{m}") == 0, 1.0).otherwise(F.col(f"_std_{m}"))
        for m in metrics
    }
    extra = [f"_{part}_{m}" for part in ("mean", "std") for m in metrics]
    joined = join_groups(df, sums, keys, few=spread_of(df, keys, split).few)
    return joined.withColumns(scaled).drop(*extra)
