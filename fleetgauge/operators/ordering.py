"""Position, windows, running totals and gap filling over the readings of a group in time order.

Each operator has two plans with the same result. When every group is small enough for one task
(measured by one cheap count), it is a plain window: one shuffle, one sort. Otherwise the rows
are range-partitioned by (group, order), so a group of any size is cut into many slices of even
size, and what has to cross a slice boundary travels as one small row per slice.

`split` forces a plan: None = measure, False = one task per group, True = slices; an operator that
uses several of these measures once and hands the `Spread` on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetgauge.operators.grouping import FEW_GROUPS, KEYS, ORDER, Spread, dealt, join_groups, spread_of
from fleetgauge.session import pin

SLICE_ROWS = 1_000_000
CHUNK_ROWS = 200_000

Columns = Callable[[WindowSpec], Mapping[str, Column]]


def _slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], spread: Spread
) -> tuple[DataFrame, bool, int]:
    """Rows in global (group, order) order with `_slice`, the slice number, and `_seq`, the order.

    Also tells whether one row per group and slice is little enough to broadcast, and the number of rows.

    The last range column is the input partition: equal rows, however many, still spread over the
    slices, and a repeated task gives its rows the same value. The rows are pinned, since slice
    numbers must be the same for everything that is derived from them.
    """
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.count()
    count = max(default, math.ceil(total / SLICE_ROWS))
    cuts = [*keys, *order, "_source"]
    pinned = pin(
        df.withColumn("_source", F.spark_partition_id())
        .repartitionByRange(count, *cuts)
        .sortWithinPartitions(*cuts)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
        .drop("_source")
    )
    return pinned, spread.few and count <= FEW_GROUPS, total


def _earlier(keys: Sequence[str]) -> WindowSpec:
    """Over one row per (group, slice): all earlier slices of the group."""
    return Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def _within(keys: Sequence[str]) -> WindowSpec:
    """Readings of the group inside one slice, up to the current one."""
    window = Window.partitionBy(*keys, "_slice").orderBy("_seq")
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def reading_index(
    df: DataFrame, *, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
    name: str = "reading_index", split: Spread | bool | None = None,
) -> DataFrame:
    """0-based position of each reading in its group."""
    spread = spread_of(df, keys, split)
    if not spread.split:
        window = Window.partitionBy(*keys).orderBy(*(order or [F.lit(0)]))
        position = F.row_number().over(window) - 1
        return dealt(df, spread.rows, keys).withColumn(name, position.cast("long"))
    rows, few, _ = _slices(df, keys, order, spread)
    starts = rows.groupBy(*keys, "_slice").agg(
        F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    before = F.coalesce(F.sum("_rows").over(_earlier(keys)), F.lit(0))
    starts = starts.select(*keys, "_slice", (before - F.col("_first")).alias("_shift"))
    return (
        join_groups(rows, starts, [*keys, "_slice"], few=few)
        .withColumn(name, F.col("_seq") + F.col("_shift"))
        .drop("_slice", "_seq", "_shift")
    )


def over_readings(
    df: DataFrame, columns: Columns, *, before: int = 0, after: int = 0,
    keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
    split: Spread | bool | None = None, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds window columns that reach at most `before` readings back and `after` forward.

    In the sliced plan a group is cut by position into chunks of equal size, and the few readings
    near a cut are copied to the neighbouring chunk, so every task sees all that it needs.
    """
    spread = spread_of(df, keys, split)
    if not spread.split:
        return dealt(df, spread.rows, keys).withColumns(dict(columns(Window.partitionBy(*keys).orderBy(*order))))
    chunk_rows = max(chunk_rows, before, after)
    rows = reading_index(df, keys=keys, order=order, name="_position", split=spread)
    home = F.floor(F.col("_position") / F.lit(chunk_rows))
    offset = F.col("_position") % F.lit(chunk_rows)
    chunks = F.array_compact(
        F.array(
            home,
            F.when(offset >= chunk_rows - before, home + 1),
            F.when((offset < after) & (home > 0), home - 1),
        )
    )
    copied = rows.withColumn("_home", home).withColumn("_chunk", F.explode(chunks))
    copied = dealt(copied, spread.rows, [*keys, "_chunk"])
    window = Window.partitionBy(*keys, "_chunk").orderBy("_position")
    return (
        copied.withColumns(dict(columns(window)))
        .where(F.col("_home") == F.col("_chunk"))
        .drop("_home", "_chunk", "_position")
    )


def running_totals(
    df: DataFrame, totals: Mapping[str, Column], *, keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER, split: Spread | bool | None = None,
) -> DataFrame:
    """Adds sums over all readings of the group up to and including the current one."""
    spread = spread_of(df, keys, split)
    if not spread.split:
        window = Window.partitionBy(*keys).orderBy(*order)
        window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = dealt(df, spread.rows, keys)
        return placed.withColumns({name: F.sum(value).over(window) for name, value in totals.items()})
    added = df.withColumns({f"_add_{name}": value for name, value in totals.items()})
    rows, few, total = _slices(added, keys, order, spread)
    sums = rows.groupBy(*keys, "_slice").agg(*[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in totals])
    carried = sums.select(
        *keys, "_slice", *[F.sum(f"_sum_{n}").over(_earlier(keys)).alias(f"_carry_{n}") for n in totals]
    )
    rows = dealt(rows, total, [*keys, "_slice"]).withColumns(
        {f"_here_{n}": F.sum(f"_add_{n}").over(_within(keys)) for n in totals}
    )
    joined = join_groups(rows, carried, [*keys, "_slice"], few=few)
    return joined.withColumns(
        {
            n: F.when(
                F.col(f"_here_{n}").isNotNull() | F.col(f"_carry_{n}").isNotNull(),
                F.coalesce(F.col(f"_here_{n}"), F.lit(0)) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0)),
            )
            for n in totals
        }
    ).drop("_slice", "_seq", *[f"_{kind}_{n}" for kind in ("add", "here", "carry") for n in totals])


def fill_forward_backward(
    df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER, backward: bool = True, split: Spread | bool | None = None,
) -> DataFrame:
    """Fills nulls with the last known value and, if backward, those before the first with it."""
    if not columns:
        return df
    spread = spread_of(df, keys, split)
    if not spread.split:
        ordered = Window.partitionBy(*keys).orderBy(*order)
        so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return dealt(df, spread.rows, keys).withColumns(
            {
                c: F.coalesce(
                    F.last(c, ignorenulls=True).over(so_far),
                    *([F.first(c, ignorenulls=True).over(whole)] if backward else []),
                )
                for c in columns
            }
        )
    rows, few, total = _slices(df, keys, order, spread)
    known = [
        agg
        for c in columns
        for agg in (
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(f"_last_{c}"),
            F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(f"_first_{c}"),
        )
    ]
    ends = rows.groupBy(*keys, "_slice").agg(*known)
    whole = (
        Window.partitionBy(*keys).orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    carried = ends.select(
        *keys, "_slice",
        *[F.last(f"_last_{c}", ignorenulls=True).over(_earlier(keys)).alias(f"_carry_{c}") for c in columns],
        *[F.first(f"_first_{c}", ignorenulls=True).over(whole).alias(f"_head_{c}") for c in columns],
    )
    rows = dealt(rows, total, [*keys, "_slice"]).withColumns(
        {f"_here_{c}": F.last(c, ignorenulls=True).over(_within(keys)) for c in columns}
    )
    joined = join_groups(rows, carried, [*keys, "_slice"], few=few)
    return joined.withColumns(
        {
            c: F.coalesce(
                F.col(f"_here_{c}"), F.col(f"_carry_{c}"), *([F.col(f"_head_{c}")] if backward else [])
            )
            for c in columns
        }
    ).drop("_slice", "_seq", *[f"_{kind}_{c}" for kind in ("here", "carry", "head") for c in columns])
