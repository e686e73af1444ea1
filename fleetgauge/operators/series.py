"""Trends, moving averages and rates of change of the metrics over time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions.scalars import trend_direction
from fleetgauge.operators.grouping import KEYS, ORDER, Spread, dealt, join_groups, ordering, present, scoped, spread_of
from fleetgauge.operators.ordering import over_readings, running_totals
from fleetgauge.operators.select import melt_metrics
from fleetgauge.operators.windows import percent_change

SHORTEST = 10


def _unpivot(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    long = df.unpivot(list(keys), list(metrics), "metric", "s")
    return long.where(F.col("s.n") >= SHORTEST)


def trend(
    df: DataFrame, *, metrics: Sequence[str] = C.TREND_METRICS, keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER, split: Spread | bool | None = None,
) -> DataFrame:
    """Least-squares slope of each metric against the number of its known reading.

    All metrics are numbered by one pass of running counts over the readings.
    """
    df, keys = scoped(df, keys)
    metrics, order = present(df, metrics), ordering(df, order)
    narrow = df.select(*keys, *order, *metrics)
    counts = {f"_at_{m}": F.col(m).isNotNull().cast("long") for m in metrics}
    numbered = running_totals(narrow, counts, keys=keys, order=order, split=split)
    fits = numbered.groupBy(*keys).agg(
        *[
            F.struct(
                F.count(m).alias("n"),
                F.regr_slope(F.col(m), F.col(f"_at_{m}") - 1).alias("slope"),
                F.regr_intercept(F.col(m), F.col(f"_at_{m}") - 1).alias("intercept"),
            ).alias(m)
            for m in metrics
        ]
    )
    slope = F.col("s.slope")
    return _unpivot(fits, keys, metrics).select(
        *keys, "metric", slope.alias("slope"), F.col("s.intercept").alias("intercept"),
        trend_direction(slope).alias("direction"), F.abs(slope).alias("magnitude"),
        F.round(slope, 6).alias("unit_per_sample"),
    )


def rate_of_change(
    df: DataFrame, *, metrics: Sequence[str] = C.TREND_METRICS, keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER, split: Spread | bool | None = None,
) -> DataFrame:
    """Mean, greatest, least and deviation of the percent change from reading to reading."""
    df, keys = scoped(df, keys)
    metrics, order = present(df, metrics), ordering(df, order)
    narrow = df.select(*keys, *order, *metrics)
    changes = percent_change(narrow, metrics, keys=keys, order=order, split=split)
    sums = changes.groupBy(*keys).agg(
        *[
            F.struct(
                F.count(m).alias("n"),
                F.round(F.avg(f"{m}_change_pct"), 4).alias("mean_roc_pct"),
                F.round(F.max(f"{m}_change_pct"), 4).alias("max_increase_pct"),
                F.round(F.min(f"{m}_change_pct"), 4).alias("max_decrease_pct"),
                F.round(F.stddev_samp(f"{m}_change_pct"), 4).alias("volatility"),
            ).alias(m)
            for m in metrics
        ]
    )
    return _unpivot(sums, keys, metrics).select(
        *keys, "metric", "s.mean_roc_pct", "s.max_increase_pct", "s.max_decrease_pct", "s.volatility"
    )


def centered_moving_average(
    df: DataFrame, *, metrics: Sequence[str] = C.TREND_METRICS, window: int | None = None,
    keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, split: Spread | bool | None = None,
) -> DataFrame:
    """Centred mean of the known readings, null near both ends.

    Without a fixed `window` its width is a twentieth of the series, at least 5, so it differs from
    satellite to satellite. A frame needs a literal width; here each running total is instead sent
    to the two readings whose windows begin or end there, and one aggregate takes the difference.
    The totals are of deviations from the mean, which keeps them small on long series.
    """
    df, keys = scoped(df, keys)
    metrics, order = present(df, metrics), ordering(df, order)
    split = spread_of(df, keys, split)
    by = [*keys, "metric"]
    if window:
        long = melt_metrics(df, metrics, [*keys, *order]).where(F.col("value").isNotNull())
        sizes = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        series = join_groups(long, sizes.where(F.col("n") >= SHORTEST), by, "inner", few=split.few)

        def mean(w):
            frame = w.rowsBetween(-(window // 2), (window - 1) // 2)
            return {"average": F.when(F.count("value").over(frame) == window, F.avg("value").over(frame))}

        averaged = over_readings(
            series, mean, before=window // 2, after=(window - 1) // 2, keys=by, order=order,
            split=replace(split, rows=split.rows * len(metrics)),
        )
        return averaged.select(*by, *order, "value", F.lit(window).alias("width"), "average")
    wide = df.select(*keys, *order, *[F.col(m).cast("double").alias(m) for m in metrics])
    sizes = wide.groupBy(*keys).agg(
        *[F.count(m).alias(f"_n_{m}") for m in metrics], *[F.avg(m).alias(f"_center_{m}") for m in metrics]
    )
    totals = {f"_at_{m}": F.col(m).isNotNull().cast("long") for m in metrics}
    totals |= {f"_sum_{m}": F.col(m) - F.col(f"_center_{m}") for m in metrics}
    # The totals of all metrics go over the readings together; a row for each metric is made after that.
    totalled = running_totals(
        join_groups(wide, sizes, keys, few=split.few), totals, keys=keys, order=order, split=split
    )
    each = [
        F.struct(
            F.lit(m).alias("metric"), F.col(m).alias("value"),
            *[F.col(f"_{kind}_{m}").alias(kind) for kind in ("n", "center", "at", "sum")],
        )
        for m in metrics
    ]
    numbered = totalled.select(*keys, *order, F.explode(F.array(*each)).alias("p")).select(*keys, *order, "p.*")
    numbered = numbered.where(F.col("value").isNotNull() & (F.col("n") >= SHORTEST))
    width = F.greatest(F.lit(5), F.floor(F.col("n") / F.lit(20)))
    numbered = numbered.withColumn("width", width.cast("int"))
    first, last = F.floor(F.col("width") / F.lit(2)), F.floor((F.col("width") - 1) / F.lit(2))
    values = F.struct("value", "center", "width", *order)
    parts = F.array(
        F.struct(F.col("at").alias("target"), values.alias("own"), F.lit(None).cast("double").alias("low"),
                 F.lit(None).cast("double").alias("high")),
        F.struct((F.col("at") + first + 1).alias("target"), F.lit(None).cast(_type_of(numbered, values)).alias("own"),
                 F.col("sum").alias("low"), F.lit(None).cast("double").alias("high")),
        F.struct((F.col("at") - last).alias("target"), F.lit(None).cast(_type_of(numbered, values)).alias("own"),
                 F.lit(None).cast("double").alias("low"), F.col("sum").alias("high")),
    )
    sent = numbered.select(*by, F.explode(parts).alias("p")).select(*by, "p.*")
    # The places of a group are dealt over the tasks; else one would get all of them, three rows for each value.
    met = dealt(sent, split.rows * len(metrics), [*by, "target"]).groupBy(*by, "target").agg(
        F.max_by("own", F.col("own").isNotNull()).alias("own"),
        F.max("low").alias("low"), F.max("high").alias("high"),
    )
    head = F.floor(F.col("own.width") / F.lit(2)) + 1
    low = F.when(F.col("target") == head, 0.0).otherwise(F.col("low"))
    average = (F.col("high") - low) / F.col("own.width") + F.col("own.center")
    return met.where(F.col("own").isNotNull()).select(
        *by, *[F.col(f"own.{c}").alias(c) for c in order], "own.value", "own.width", average.alias("average")
    )


def _type_of(df: DataFrame, column):
    return df.select(column.alias("c")).schema["c"].dataType


def time_series_analysis(
    df: DataFrame, *, metrics: Sequence[str] = C.TREND_METRICS, keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER, split: Spread | bool | None = None,
) -> DataFrame:
    """Trend, rate of change and the last full moving average of each metric, one row each."""
    df, keys = scoped(df, keys)
    split = spread_of(df, keys, split)
    plan = dict(metrics=metrics, keys=keys, order=order, split=split)
    by = [*keys, "metric"]
    averages = centered_moving_average(df, **plan).where(F.col("average").isNotNull())
    smooth = averages.groupBy(*by).agg(
        F.max("width").alias("moving_average_width"), F.count("average").alias("moving_average_points"),
        F.min("average").alias("moving_average_min"), F.max("average").alias("moving_average_max"),
    )
    joined = join_groups(trend(df, **plan), rate_of_change(df, **plan), by)
    return join_groups(joined, smooth, by)
