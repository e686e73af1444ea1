"""Columns computed from neighbouring readings of the same satellite."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.operators.grouping import KEYS, ORDER, Spread, dealt, join_groups, spread_of
from fleetgauge.operators.ordering import fill_forward_backward, over_readings


def trailing_mean(value: Column | str, readings: int, window: WindowSpec) -> Column:
    """Mean of the last `readings` rows, null until all of them are known."""
    value = F.col(value) if isinstance(value, str) else value
    frame = window.rowsBetween(1 - readings, 0)
    return F.when(F.count(value).over(frame) == readings, F.avg(value).over(frame))


def delta(value: Column | str, window: WindowSpec) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value - F.lag(value).over(window)


def rolling_mean(
    df: DataFrame, metrics: Sequence[str], readings: int = C.ROLLING_READINGS, *,
    keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, **plan,
) -> DataFrame:
    """Adds `<metric>_mean`, the trailing mean over `readings` rows."""
    columns = lambda w: {f"{m}_mean": trailing_mean(m, readings, w) for m in metrics}
    return over_readings(df, columns, before=readings - 1, keys=keys, order=order, **plan)


def reading_delta(
    df: DataFrame, metrics: Sequence[str], *, keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER, **plan,
) -> DataFrame:
    """Adds `<metric>_delta`, the change from the reading before."""
    columns = lambda w: {f"{m}_delta": delta(m, w) for m in metrics}
    return over_readings(df, columns, before=1, keys=keys, order=order, **plan)


def percent_change(
    df: DataFrame, metrics: Sequence[str], *, keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER, split: Spread | bool | None = None,
) -> DataFrame:
    """Adds `<metric>_change_pct`, the change from the last known value in percent of its size.

    Readings without a value are skipped, so the known value is carried forward first and then
    looked up one row back. A change from zero has no percentage.
    """
    split = spread_of(df, keys, split)
    if not split.split:
        # Both windows find the rows where one shuffle has put them.
        df, split = dealt(df, split.rows, keys), replace(split, rows=0)
    known = {f"_known_{m}": F.col(m) for m in metrics}
    carried = fill_forward_backward(
        df.withColumns(known), list(known), keys=keys, order=order, backward=False, split=split
    )

    def columns(window: WindowSpec) -> dict[str, Column]:
        before = {m: F.lag(f"_known_{m}").over(window) for m in metrics}
        return {
            f"{m}_change_pct": F.try_divide(F.col(m) - before[m], F.abs(before[m])) * 100 for m in metrics
        }

    changed = over_readings(carried, columns, before=1, keys=keys, order=order, split=split)
    return changed.drop(*known)


def partition_std(
    df: DataFrame, metrics: Sequence[str], *, keys: Sequence[str] = KEYS,
    split: Spread | bool | None = None,
) -> DataFrame:
    """Adds `<metric>_std`, the sample deviation of the whole group, by an aggregate joined back."""
    std = df.groupBy(*keys).agg(*[F.stddev_samp(m).alias(f"{m}_std") for m in metrics])
    return join_groups(df, std, keys, few=spread_of(df, keys, split).few)


def bubble_sizes(
    df: DataFrame, x: str, y: str, size: str, *, keys: Sequence[str] = KEYS,
    smallest: float = 5, growth: float = 30, split: Spread | bool | None = None,
) -> DataFrame:
    """Points with a marker size scaled from the smallest to the largest value of the group."""
    ends = df.groupBy(*keys).agg(F.min(size).alias("_low"), F.max(size).alias("_high"))
    share = F.try_divide(F.col(size) - F.col("_low"), F.col("_high") - F.col("_low"))
    return join_groups(df, ends, keys, few=spread_of(df, keys, split).few).select(
        *keys, F.col(x).alias("x"), F.col(y).alias("y"), (share * growth + smallest).alias("size")
    )
