"""The data under the charts: bins, boxes, bars, radar axes, tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.scalars import ecef, gauge_band, gauge_delta, progress_color
from fleetgauge.operators.grouping import KEYS, Spread, join_groups, ordering, present, scoped, spread_of
from fleetgauge.operators.quantiles import metric_quantiles
from fleetgauge.operators.select import current_position, melt_metrics


def histogram(
    df: DataFrame, metric: str, bins: int = 30, *, keys: Sequence[str] = KEYS,
    split: Spread | bool | None = None,
) -> DataFrame:
    """Counts in bins of equal width from the least to the greatest value, which closes the last bin.

    The limits of each group first, then the counts: what is shuffled is two values and at most `bins`
    rows of each group and task.
    """
    df, keys = scoped(df, keys)
    values = df.select(*keys, F.col(metric).cast("double").alias("value")).where("value IS NOT NULL")
    ends = values.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.coalesce(F.try_divide((F.col("value") - F.col("low")) * bins, F.col("high") - F.col("low")), F.lit(0.0))
    bin_no = F.least(F.floor(place), F.lit(bins - 1)).cast("int")
    return (
        join_groups(values, ends, keys, few=spread_of(df, keys, split).few)
        .groupBy(*keys, bin_no.alias("bin"), "low", "high")
        .agg(F.count(F.lit(1)).alias("readings"))
        .select(
            *keys, "bin", (F.col("low") + width * F.col("bin")).alias("bin_from"),
            (F.col("low") + width * (F.col("bin") + 1)).alias("bin_to"), "readings",
        )
    )


def box_stats(
    df: DataFrame, metrics: Sequence[str], *, keys: Sequence[str] = KEYS, split: Spread | bool | None = None
) -> DataFrame:
    """Quartiles, whisker ends within 1.5 box lengths, values outside them, and the mean."""
    df, keys = scoped(df, keys)
    split = spread_of(df, keys, split)
    by = [*keys, "metric"]
    values = melt_metrics(df, metrics, keys).where("value IS NOT NULL")
    boxes = metric_quantiles(df, metrics, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75}, split=split)
    quarters = ["q1", "median", "q3"]
    reach = (F.col("q3") - F.col("q1")) * 1.5
    boxes = boxes.withColumns({"_low": F.col("q1") - reach, "_high": F.col("q3") + reach})
    inside = F.col("value").between(F.col("_low"), F.col("_high"))
    return join_groups(values, boxes, by, few=split.few).groupBy(*by, *quarters).agg(
        F.min(F.when(inside, F.col("value"))).alias("lower_fence"),
        F.max(F.when(inside, F.col("value"))).alias("upper_fence"),
        F.count_if(~inside).alias("outliers"),
        F.avg("value").alias("mean"),
    )


def satellite_comparison(df: DataFrame, metric: str) -> DataFrame:
    mean = df.groupBy("satellite_id").agg(F.avg(metric).alias("mean"))
    return mean.withColumn("label", F.format_string("%.1f", F.round("mean", 1)))


def grouped_metric_means(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per satellite, one column of means per metric."""
    return df.groupBy("satellite_id").agg(*[F.avg(m).alias(m) for m in present(df, metrics)])


def category_values(df: DataFrame, category: str, value: str) -> DataFrame:
    """Bars: category, value and the value's label with one decimal."""
    return df.select(
        F.col(category).alias("category"), F.col(value).alias("value"),
        F.format_string("%.1f", F.round(F.col(value).cast("double"), 1)).alias("label"),
    )


def radar_values(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Axis values of each satellite, missing = 0; the first is repeated to close the shape."""
    means = grouped_metric_means(df, metrics)
    axes = [m if m in means.columns else None for m in metrics]
    values = [F.coalesce(F.col(m), F.lit(0.0)) if m else F.lit(0.0) for m in axes]
    return means.select(
        "satellite_id",
        F.array(*[F.lit(m) for m in [*metrics, metrics[0]]]).alias("axes"),
        F.array(*values, values[0]).alias("values"),
    )


def gauge(df: DataFrame, value: str) -> DataFrame:
    return df.withColumns({"band": gauge_band(F.col(value)), "delta": gauge_delta(F.col(value))})


def progress_bars(df: DataFrame, value: str) -> DataFrame:
    text = F.format_string("%.0f%%", F.round(F.col(value).cast("double"), 0))
    return df.withColumns({"bar_color": progress_color(F.col(value)), "bar_text": text})


def ecef_position(df: DataFrame) -> DataFrame:
    altitude = F.col("altitude_km") if "altitude_km" in df.columns else F.lit(None).cast("double")
    return df.withColumns(ecef(F.col("latitude"), F.col("longitude"), altitude))


def ground_track(df: DataFrame, *, split: Spread | bool | None = None) -> DataFrame:
    """Path points in time order; the last one of each satellite is marked."""
    order = ordering(df)
    last = current_position(df, columns=()).select("satellite_id", *order).withColumn("is_current", F.lit(True))
    last = last.withColumnsRenamed({c: f"_last_{c}" for c in order})
    few = spread_of(df, KEYS, split).few
    path = join_groups(df.select("satellite_id", *order, "longitude", "latitude"), last, KEYS, few=few)
    current = F.lit(True)
    for c in order:
        current = current & F.col(c).eqNullSafe(F.col(f"_last_{c}"))
    marked = path.withColumn("is_current", current).drop(*[f"_last_{c}" for c in order])
    return marked.orderBy("satellite_id", *order)
