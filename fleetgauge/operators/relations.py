"""Correlation between metrics of the same satellite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions.scalars import correlation_direction, correlation_strength
from fleetgauge.functions.tests_of_fit import pearson_p
from fleetgauge.operators.grouping import KEYS, Spread, join_groups, present, scoped, spread_of


# Share of a metric's own squared distances below which a pair's are taken for rounding noise.
_NOISE = 1e-12


def pearson(x: str, y: str) -> Column:
    """Pearson's r over the rows where both are known; null where one of them does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.try_divide(F.covar_pop(x, y), spread)


def _pair_sums(df: DataFrame, metrics: list[str], keys: list[str], few: bool) -> DataFrame:
    """Rows (a, b, n, p, and sums s, q, whole of either side) of each pair of metric numbers.

    Values are distances from the group's mean, so plain sums keep their precision, and a missing
    value adds nothing to any sum. What a missing y takes away from the sums of x is added up
    separately. A reading becomes one row per metric x, which keeps each aggregate narrow; it is
    summed up before anything is shuffled.
    """
    means = df.groupBy(*keys).agg(*[F.avg(m).alias(f"_mean_{m}") for m in metrics])

    def by_metric(rows: DataFrame) -> DataFrame:
        near = join_groups(rows, means, keys, few=few)
        z = near.select(*keys, *[(F.col(m) - F.col(f"_mean_{m}")).alias(m) for m in metrics])
        return z.select("*", F.posexplode(F.array(*metrics)).alias("place", "x"))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0.0))

    x = F.col("x")
    sums = [F.count(x).alias("n"), total(x).alias("s"), total(x * x).alias("q")]
    rows = df.select(*keys, *metrics)
    products = F.array(*[total(x * F.col(m)) for m in metrics]).alias("p")
    full = by_metric(rows).groupBy(*keys, "place").agg(*sums, products)
    beside = {m: F.when(F.col(m).isNull(), x) for m in metrics}
    # All readings are looked at: a filter for those with a gap in any of the metrics would be
    # placed by the optimizer through every step below it, which takes longer than it saves.
    lost = by_metric(rows).groupBy(*keys, "place").agg(
        F.array(*[F.count(v) for v in beside.values()]).alias("n"),
        F.array(*[total(v) for v in beside.values()]).alias("s"),
        F.array(*[total(v * v) for v in beside.values()]).alias("q"),
    )

    # From here on there are as many rows per group as there are pairs of metrics.
    cells = full.select(*keys, F.col("place").alias("x"), "n", "s", "q", F.posexplode("p").alias("y", "p"))
    missed = lost.select(
        *keys, F.col("place").alias("x"), F.posexplode(F.arrays_zip("n", "s", "q")).alias("y", "missed")
    )
    seen = {c: F.col(c) - F.coalesce(F.col(f"missed.{c}"), F.lit(0)) for c in ("n", "s", "q")}
    cells = join_groups(cells, missed, [*keys, "x", "y"]).select(
        *keys, "x", "y", "p", F.col("q").alias("whole"), *[v.alias(c) for c, v in seen.items()]
    )
    ahead, behind = F.col("x") <= F.col("y"), F.col("x") >= F.col("y")

    def side(which: Column, value: str, name: str) -> Column:
        return F.max(F.when(which, F.col(value))).alias(name)

    return cells.groupBy(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.max("n").alias("n"), side(ahead, "p", "p"),
        *[side(ahead, c, f"{c}_a") for c in ("s", "q", "whole")],
        *[side(behind, c, f"{c}_b") for c in ("s", "q", "whole")],
    )


def correlation_matrix(
    df: DataFrame, *, metrics: Sequence[str] = C.METRICS, keys: Sequence[str] = KEYS,
    split: Spread | bool | None = None,
) -> DataFrame:
    """Long rows (col_x, col_y, r): every pair both ways, and 1 for a metric with itself."""
    df, keys = scoped(df, keys)
    metrics = present(df, metrics)
    sums = _pair_sums(df, metrics, keys, spread_of(df, keys, split).few).where(F.col("n") > 1)

    def spread(side: str) -> Column:
        """Squared distances around the pair's own mean; noise alone counts as no spread."""
        around = F.col(f"q_{side}") - F.col(f"s_{side}") * F.col(f"s_{side}") / F.col("n")
        return F.when(around > F.col(f"whole_{side}") * _NOISE, around)

    together = F.col("p") - F.col("s_a") * F.col("s_b") / F.col("n")
    r = F.when(F.col("a") == F.col("b"), 1.0).otherwise(
        F.try_divide(together, F.sqrt(spread("a")) * F.sqrt(spread("b")))
    )
    names = F.array(*[F.lit(m) for m in metrics])
    one_way = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")))
    both_ways = F.array(
        F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))
    )
    cell = F.explode(F.when(F.col("a") == F.col("b"), one_way).otherwise(both_ways)).alias("c")
    return (
        sums.select(*keys, cell, r.alias("r"))
        .select(*keys, F.get(names, F.col("c.x")).alias("col_x"), F.get(names, F.col("c.y")).alias("col_y"), "r")
        .where(F.col("r").isNotNull())
    )


def relationships(
    df: DataFrame, *, pairs: Sequence[tuple[str, str, str]] = C.RELATIONSHIP_PAIRS,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """r, p-value, strength and direction of named pairs with more than two common readings."""
    df, keys = scoped(df, keys)
    pairs = [p for p in pairs if p[0] in df.columns and p[1] in df.columns]
    sums = df.groupBy(*keys).agg(
        *[pearson(x, y).alias(f"r{i}") for i, (x, y, _) in enumerate(pairs)],
        *[
            F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias(f"n{i}")
            for i, (x, y, _) in enumerate(pairs)
        ],
    )
    cells = [
        F.struct(F.lit(i).alias("pair"), F.lit(name).alias("name"),
                 F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
        for i, (_, _, name) in enumerate(pairs)
    ]
    long = sums.select(*keys, F.explode(F.array(*cells)).alias("p")).select(*keys, "p.*")
    r = F.col("r")
    return long.where(r.isNotNull() & (F.col("n") > 2)).select(
        *keys, "pair", "name", F.round(r, 4).alias("correlation"),
        F.round(pearson_p(r, F.col("n")), 6).alias("p_value"),
        correlation_strength(r).alias("strength"), correlation_direction(r).alias("direction"),
    )


def rank_relationships(related: DataFrame, top: int | None = None, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Numbers the pairs of a satellite (a handful of rows) from the strongest on."""
    strongest = Window.partitionBy(*keys).orderBy(F.abs("correlation").desc(), "pair")
    ranked = related.withColumn("rank", F.row_number().over(strongest))
    return ranked.where(F.col("rank") <= top) if top else ranked
