"""Repair of telemetry rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.operators.grouping import KEYS, Spread, ordering, spread_of
from fleetgauge.operators.ordering import fill_forward_backward
from fleetgauge.operators.select import coerce_timestamps, drop_duplicates


def drop_sparse_rows(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Keeps rows with at least that share of their columns known."""
    return df.dropna(thresh=math.ceil(len(df.columns) * share))


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in without
    ]


def clean(df: DataFrame, *, keys: Sequence[str] = KEYS, split: Spread | bool | None = None) -> DataFrame:
    """Without copies and unreadable times, gaps filled in time order, sparse rows dropped."""
    # Measured before the copies go, so that they are looked for once.
    split = spread_of(df, keys, split)
    rows = coerce_timestamps(drop_duplicates(df))
    order = ordering(rows)
    filled = fill_forward_backward(
        rows, numeric_columns(rows, [*keys, *order]), keys=keys, order=order, split=split
    )
    return drop_sparse_rows(filled)


def clean_counts(df: DataFrame, *, keys: Sequence[str] = KEYS, split: Spread | bool | None = None) -> DataFrame:
    """Rows of each satellite before and after `clean`, and how many it removed."""
    before = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_before"), F.lit(0).alias("rows_after"))
    after = clean(df, keys=keys, split=split).groupBy(*keys).agg(
        F.lit(0).alias("rows_before"), F.count(F.lit(1)).alias("rows_after")
    )
    both = before.unionByName(after).groupBy(*keys).agg(
        F.sum("rows_before").alias("rows_before"), F.sum("rows_after").alias("rows_after")
    )
    return both.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))
