"""Exact quantiles and modes per group, also for groups too large for one task.

Of a large group a mergeable sketch, as large for a hundred values as for a billion, says between which two values
a rank lies. A second pass counts what lies below and keeps only what lies between, as values with their
counts; a running count over these finds the rank exactly. Only sketches, counts and the few values around the
ranks are shuffled. Where a group is so large that even these are many, sketches of what lies between narrow
it down first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.operators.grouping import GROUP_ROW_LIMIT, Spread, join_groups, spread_of
from fleetgauge.operators.ordering import running_totals
from fleetgauge.session import pin

#: Size of a sketch, whose error of a rank is about 0.0045 of the group; how far from a rank is looked, as a share; and
#: rows of a group that is small enough to be kept whole.
SKETCH, MARGIN, SMALL = 1000, 0.0125, 400
#: Ranks that the sketch of what lies within an interval is asked for; a rank is looked for within two steps.
STEPS = 64


def value_counts(df: DataFrame, keys: Sequence[str], value: str, copies: str | None = None) -> DataFrame:
    """How often each value occurs in each group."""
    n = F.sum(copies) if copies else F.count(F.lit(1))
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("copies"))


def _picks(size: Column, probabilities: dict[str, float]):
    """(name, side, rank) of the two readings around each quantile."""
    for name, p in probabilities.items():
        place = (size - 1) * F.lit(p)
        yield from ((name, "low", F.floor(place)), (name, "high", F.ceil(place)))


def _interpolated(found: DataFrame, keys: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    columns = []
    for name, p in probabilities.items():
        place = (F.col("_size") - 1) * F.lit(p)
        part = place - F.floor(place)
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        # Equal readings need no sum, which is no number for infinite ones.
        columns.append(F.when(low == high, low).otherwise(low * (F.ceil(place) - place) + high * part).alias(name))
    return found.select(*keys, *columns)


def _at_ranks(counts: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """The values that hold the ranks, from rows of value, copies, _upto (copies till here) and _size."""
    picks = []
    for name, side, rank in _picks(F.col("_size"), probabilities):
        holds = (F.col("_upto") - F.col("copies") <= rank) & (rank < F.col("_upto"))
        picks.append(F.max(F.when(holds, F.col(value))).alias(f"_{side}_{name}"))
    return counts.groupBy(*keys, "_size").agg(*picks)


def quantiles_of_counts(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], *,
    copies: str, split: Spread | bool | None = None,
) -> DataFrame:
    """As `quantiles`, of values that stand for several readings each.

    A small group is sorted by one aggregate; in a large one a running count over the values, in slices, shows
    which two hold each rank.
    """
    rows = df.where(F.col(value).isNotNull())
    spread = spread_of(rows, keys, split)
    if not spread.split:
        found = F.percentile(value, F.array(*[F.lit(p) for p in probabilities.values()]), F.col(copies))
        grouped = rows.groupBy(*keys).agg(found.alias("_found"))
        return grouped.select(*keys, *[F.col("_found")[i].alias(n) for i, n in enumerate(probabilities)])
    counts = value_counts(rows, keys, value, copies)
    sizes = counts.groupBy(*keys).agg(F.sum("copies").alias("_size"))
    upto = running_totals(counts, {"_upto": F.col("copies")}, keys=keys, order=(value,), split=spread)
    ranked = join_groups(upto, sizes, keys, few=spread.few)
    return _interpolated(_at_ranks(ranked, keys, value, probabilities), keys, probabilities)


def _sorted(value: str, probabilities: dict[str, float]) -> Column:
    return F.percentile(value, F.array(*[F.lit(p) for p in probabilities.values()]))


def _grid(sketch: Column) -> Column:
    """The values at evenly spaced ranks, from the least to the greatest."""
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]))


def _around(grid: Column, size: Column, rank: Column, side: str) -> Column:
    """(low, high) within which the value of a rank lies, as far as the sketch is right."""
    share = (rank + (1 if side == "high" else 0)) * STEPS / size
    below, above = F.floor(share).cast("int") - 1, F.ceil(share).cast("int") + 1
    low = F.when(below >= 0, F.get(grid, below)).otherwise(F.lit(-math.inf))
    high = F.when(above <= STEPS, F.get(grid, above)).otherwise(F.lit(math.inf))
    return F.struct(low.alias("low"), high.alias("high"))


def _merged(intervals: Column) -> Column:
    """Rising intervals, those that touch put together."""
    def put(done, x):
        last = F.element_at(done, -1)
        wider = F.struct(last["low"].alias("low"), F.greatest(last["high"], x["high"]).alias("high"))
        touching = F.size(done).cast("boolean") & (F.try_element_at(done, F.lit(-1))["high"] >= x["low"])
        return F.when(touching, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(intervals), F.array().cast("array<struct<low:double,high:double>>"), put)


def _celled(rows: DataFrame, keys: Sequence[str], value: str, intervals: DataFrame, most: int, few: bool) -> DataFrame:
    """Rows with `cell`: 2i - 1 within the i-th interval of the group, 2i behind it; and `_kept`, the value if within.

    The ends of the intervals, `most` at most, are columns, so that this is one generated function without lists.
    """
    ends = {f"_{end}{i}": F.get("_intervals", F.lit(i))[end] for i in range(most) for end in ("low", "high")}
    joined = join_groups(rows, intervals.select(*keys, *[c.alias(n) for n, c in ends.items()]), keys, few=few)
    v = F.col(value)
    passed = sum((F.coalesce((F.col(f"_low{i}") <= v).cast("int"), F.lit(0)) for i in range(most)), F.lit(0))
    joined = joined.select(*keys, value, passed.alias("_passed"), *[f"_high{i}" for i in range(most)])
    inside = F.lit(False)
    for i in range(most):
        inside = inside | ((F.col("_passed") == i + 1) & (v <= F.col(f"_high{i}")))
    return joined.select(*keys, (2 * F.col("_passed") - inside.cast("int")).alias("cell"), F.when(inside, v).alias("_kept"))


def _narrowed(rows: DataFrame, keys: Sequence[str], value: str, intervals: DataFrame, probabilities: dict[str, float], few: bool) -> DataFrame:
    """Narrower intervals, from sketches of what lies within the present ones."""
    cells = _celled(rows, keys, value, intervals, 2 * len(probabilities), few).groupBy(*keys, "cell").agg(
        F.count(F.lit(1)).alias("n"), F.when(F.count("_kept") > 0, _grid(F.kll_sketch_agg_double("_kept", F.lit(SKETCH)))).alias("grid")
    )
    group = Window.partitionBy(*keys)
    placed = cells.withColumns({"_size": F.sum("n").over(group), "_upto": F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))})
    inside = placed.where("cell % 2 = 1")
    ends = []
    for name, side, rank in _picks(F.col("_size"), probabilities):
        before = F.col("_upto") - F.col("n")
        holds = (before <= rank) & (rank < F.col("_upto"))
        ends.append(F.max(F.when(holds, _around(F.col("grid"), F.col("n"), rank - before, side))).alias(f"_{side}_{name}"))
    found = inside.groupBy(*keys).agg(*ends)
    return found.select(*keys, _merged(F.filter(F.array(*[F.col(c) for c in found.columns[len(keys):]]), lambda x: x.isNotNull())).alias("_intervals"))


def _ends(sketch: Column, probabilities: dict[str, float]) -> Column:
    """The values a little below and above each quantile, as a sketch has them."""
    shares = [min(max(p + m, 0.0), 1.0) for p in probabilities.values() for m in (-MARGIN, MARGIN)]
    return F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, shares)))


def _sketched(probabilities: dict[str, float]) -> Column:
    """The merged intervals around the ranks, from _size and _ends of a group."""
    intervals = []
    for i, p in enumerate(probabilities.values()):
        low = F.lit(-math.inf) if p - MARGIN <= 0 else F.get("_ends", F.lit(2 * i))
        high = F.lit(math.inf) if p + MARGIN >= 1 else F.get("_ends", F.lit(2 * i + 1))
        intervals.append(F.struct(low.alias("low"), high.alias("high")))
    whole = F.array(F.struct(F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high")))
    return F.when(F.col("_size") <= SMALL, whole).otherwise(_merged(F.array(*intervals)))


def _from_intervals(
    rows: DataFrame, keys: Sequence[str], value: str, intervals: DataFrame, probabilities: dict[str, float], spread: Spread
) -> DataFrame:
    """The quantiles, from intervals that hold their ranks unless a sketch was wrong."""
    share = 2 * MARGIN * len(probabilities)
    left = (spread.largest or (50 * GROUP_ROW_LIMIT if spread.split else 0)) * share
    while left > GROUP_ROW_LIMIT:
        intervals = pin(_narrowed(rows, keys, value, intervals, probabilities, spread.few))
        left *= 2 * MARGIN
    cells = _celled(rows, keys, value, intervals, 2 * len(probabilities), spread.few)
    counts = cells.groupBy(*keys, "cell", "_kept").agg(F.count(F.lit(1)).alias("copies"))
    group = Window.partitionBy(*keys)
    upto = F.sum("copies").over(group.orderBy("cell", "_kept").rowsBetween(Window.unboundedPreceding, 0))
    found = _at_ranks(counts.withColumns({"_upto": upto, "_size": F.sum("copies").over(group)}), keys, "_kept", probabilities)
    names = [f"_{side}_{name}" for name in probabilities for side in ("low", "high")]
    wrong = F.greatest(*[F.col(n).isNull() for n in names])
    # One row per group; written, as most often none is wrong and no more has to be done.
    found = pin(found)
    if found.where(wrong).isEmpty():
        return _interpolated(found, keys, probabilities)
    again = join_groups(rows, found.where(wrong).select(*keys, F.lit(True).alias("_wrong")), keys, "inner", few=spread.few)
    sorted_ = again.groupBy(*keys).agg(_sorted(value, probabilities).alias("_found"))
    return _interpolated(found.where(~wrong), keys, probabilities).unionByName(
        sorted_.select(*keys, *[F.col("_found")[i].alias(n) for i, n in enumerate(probabilities)])
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], *, split: Spread | bool | None = None
) -> DataFrame:
    """One row per group, one column per probability, interpolated linearly between readings; exact.

    Groups that one task can sort are sorted by one aggregate. Others go by sketches; should a sketch have been
    wrong about a rank, which the counts show, the group is sorted instead.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value))
    spread = spread_of(rows, keys, split)
    if not spread.split:
        grouped = rows.groupBy(*keys).agg(_sorted(value, probabilities).alias("_found"))
        return grouped.select(*keys, *[F.col("_found")[i].alias(n) for i, n in enumerate(probabilities)])
    sketched = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), _ends(F.kll_sketch_agg_double(value, F.lit(SKETCH)), probabilities).alias("_ends"))
    intervals = sketched.select(*keys, _sketched(probabilities).alias("_intervals"))
    return _from_intervals(rows, keys, value, intervals, probabilities, spread)


def metric_quantiles(
    df: DataFrame, metrics: Sequence[str], keys: Sequence[str], probabilities: dict[str, float], *, split: Spread | bool | None = None
) -> DataFrame:
    """`quantiles` of several columns: one row per group and metric that has a value.

    All columns are one aggregate over the rows as they are, of values or of sketches.
    """
    metrics = [m for m in metrics if m in df.columns]
    spread = spread_of(df, keys, split)
    doubles = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    if not spread.split:
        found = doubles.groupBy(*keys).agg(*[_sorted(m, probabilities).alias(m) for m in metrics]).unpivot(list(keys), metrics, "metric", "_found")
        return found.where("_found IS NOT NULL").select(*keys, "metric", *[F.col("_found")[i].alias(n) for i, n in enumerate(probabilities)])
    sketches = [
        F.struct(F.count(m).alias("size"), F.when(F.count(m) > 0, _ends(F.kll_sketch_agg_double(m, F.lit(SKETCH)), probabilities)).alias("ends")).alias(m)
        for m in metrics
    ]
    long = doubles.groupBy(*keys).agg(*sketches).unpivot(list(keys), metrics, "metric", "s")
    sketched = long.where("s.size > 0").select(*keys, "metric", F.col("s.size").alias("_size"), F.col("s.ends").alias("_ends"))
    intervals = sketched.select(*keys, "metric", _sketched(probabilities).alias("_intervals"))
    rows = doubles.unpivot(list(keys), metrics, "metric", "value").where("value IS NOT NULL")
    return _from_intervals(rows, [*keys, "metric"], "value", intervals, probabilities, spread)


def modes(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value per group, the smallest of equals.

    Counts per value first, spread over all values, and then the best count of each group.
    """
    counts = value_counts(df, keys, value)
    best = F.struct(F.col("copies"), (-F.col(value)).alias("smaller"))
    return counts.groupBy(*keys).agg(F.max_by(value, best).alias(name))
