"""Helpers for operators that work per group: scope, group sizes, joins of group results."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("satellite_id",)
ORDER = ("timestamp", "id")

# A group up to this many rows may be sorted or hashed by one task.
GROUP_ROW_LIMIT = 1_000_000
# One row for each of up to this many groups may be broadcast.
FEW_GROUPS = 20_000
# Frames up to this many rows are left to Spark's number of shuffle partitions; of larger ones a task that
# sorts gets about so many rows.
FRAME_ROWS = 4_000_000
TASK_ROWS = 250_000


def scoped(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """With no keys the whole frame is one group, marked by the column `scope`."""
    if keys:
        return df, list(keys)
    return df.withColumn("scope", F.lit("all")), ["scope"]


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def ordering(df: DataFrame, order: Sequence[str] = ORDER) -> list[str]:
    return present(df, order)


@dataclass(frozen=True)
class Spread:
    """How the groups of a frame are worked on.

    `split`: some group is too large for one task, so groups are cut into slices.
    `few`: there are few enough groups to broadcast one row for each.
    `largest`: rows of the largest group, if they were counted.
    `rows`: all rows, if they were counted.
    """

    split: bool
    few: bool = False
    largest: int = 0
    rows: int = 0


def measure(df: DataFrame, keys: Sequence[str]) -> Spread:
    """Counts the rows per group (reading the key columns only) to choose a plan."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest, groups, rows = sizes.agg(F.max("n"), F.count(F.lit(1)), F.sum("n")).first()
    return Spread((largest or 0) > GROUP_ROW_LIMIT, groups <= FEW_GROUPS, largest or 0, rows or 0)


def spread_of(df: DataFrame, keys: Sequence[str], split: Spread | bool | None) -> Spread:
    """The given plan, or for None the measured one."""
    if split is None:
        return measure(df, keys)
    return split if isinstance(split, Spread) else Spread(split)


def dealt(df: DataFrame, rows: int, by: Sequence[str]) -> DataFrame:
    """The rows shuffled by the columns into as many parts as their number asks for.

    The number of shuffle partitions is a setting: if it stays as the rows grow, so do the rows that one task sorts.
    """
    if rows <= FRAME_ROWS:
        return df
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(default, math.ceil(rows / TASK_ROWS)), *by)


def join_groups(
    df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left", *, few: bool = False
) -> DataFrame:
    """Joins one-row-per-group results to rows, null keys included.

    The side is broadcast where the caller has counted its rows (`few`) and for a whole frame,
    which is one row. Otherwise Catalyst chooses: both sides are shuffled, or found already
    partitioned by the keys, and the adaptive skew join cuts up a hot group.
    """
    renamed = side.withColumnsRenamed({k: f"_side_{k}" for k in keys})
    if few or list(keys) == ["scope"]:
        renamed = F.broadcast(renamed)
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_side_{k}"))
        condition = same if condition is None else condition & same
    return df.join(renamed, condition, how).drop(*[f"_side_{k}" for k in keys])
