"""Isolation forest: trees grown on small samples, rows scored where Spark has put them.

Rows reach the trees by hashes of (seed, turn, id), so the forest does not depend on how the data is
partitioned, and only about one and a half samples of rows per tree are shuffled. A row of a large group is
hashed once, whatever the number of trees. Growing and walking trees is numpy on Arrow batches; sampling,
grouping, thresholds and joins are Spark's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.operators.grouping import KEYS, Spread, join_groups, present, scoped, spread_of
from fleetgauge.operators.quantiles import quantiles
from fleetgauge.operators.statistics import impute_median, standardize
from fleetgauge.session import written

SCORE_ROWS = 200_000
# Drawn rows per tree over the sample size: 256 of about 384, so a short sample is next to impossible.
_OVERSAMPLE = 1.5
_HASH_STEPS = 1 << 30


@dataclass(frozen=True)
class ForestSettings:
    trees: int = C.FOREST_TREES
    sample: int = C.FOREST_SAMPLE
    contamination: float = C.FOREST_CONTAMINATION
    seed: int = C.FOREST_SEED


def prepare(df: DataFrame, features: Sequence[str], *, keys: Sequence[str], split: Spread | bool | None = None) -> DataFrame:
    """Feature columns without nulls, on a common scale; a column without any value counts as 0."""
    spread = spread_of(df, keys, split)
    filled = impute_median(df, features, keys=keys, split=spread)
    scaled = standardize(filled, features, keys=keys, split=spread)
    return scaled.withColumns({f: F.coalesce(F.col(f), F.lit(0.0)) for f in features})


def _path_length(size: np.ndarray) -> np.ndarray:
    """Mean depth at which a search among `size` points ends without a hit."""
    size = np.asarray(size, dtype=float)
    result = np.where(size == 2, 1.0, 0.0)
    many = size > 2
    n = size[many]
    result[many] = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return result


def _grow(points: np.ndarray, rng: np.random.Generator, height: int) -> dict[str, list]:
    """One tree as parallel lists, one entry per node: where the value of `feature` is at most `threshold` a row
    goes to node `left`, else to the one behind it. A leaf leads to itself whatever the value.
    """
    tree = {"feature": [0], "threshold": [math.inf], "left": [0], "depth": [0.0]}
    draws = iter(rng.random(4 * len(points) + 4).tolist())
    sizes, depths = [len(points)], [0]
    todo = [(points, 0, 0)]
    while todo:
        rows, depth, node = todo.pop()
        if depth == height or len(rows) < 2:
            continue
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if not len(varying):
            continue
        feature = int(varying[int(next(draws) * len(varying))])
        threshold = float(low[feature] + next(draws) * (high[feature] - low[feature]))
        goes_left = rows[:, feature] <= threshold
        left = len(sizes)
        tree["feature"][node], tree["threshold"][node], tree["left"][node] = feature, threshold, left
        for side, part in enumerate((rows[goes_left], rows[~goes_left])):
            for name, value in zip(tree, (0, math.inf, left + side, 0.0)):
                tree[name].append(value)
            sizes.append(len(part))
            depths.append(depth + 1)
        todo += [(rows[~goes_left], depth + 1, left + 1), (rows[goes_left], depth + 1, left)]
    leaf = np.array(tree["left"]) == np.arange(len(sizes))
    tree["depth"] = np.where(leaf, np.array(depths, dtype=float) + _path_length(np.array(sizes)), 0.0).tolist()
    return tree


def _spread_out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The shuffle of the grouping, in a fixed number of parts.

    Left to itself it would be merged into few tasks by its size in bytes, while the work on it
    is dear in time.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_TREE_FIELDS = "sample_size int, feature array<int>, threshold array<double>, left array<int>, depth array<double>"


def isolation_forest_fit(
    prepared: DataFrame, features: Sequence[str], *, keys: Sequence[str] = KEYS,
    id_column: str = "id", settings: ForestSettings = ForestSettings(), few: bool = False,
) -> DataFrame:
    """One row per group and tree, the nodes as arrays. Work per row does not grow with the number of trees."""
    sizes = prepared.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    counted = join_groups(prepared.select(*keys, id_column, *features), sizes, keys, few=few)
    # A row draws one tree from each of `turns` blocks of trees: all trees in a small group, one in a large one.
    wanted = float(_OVERSAMPLE * settings.sample)
    turns = F.least(F.lit(settings.trees), F.ceil(F.lit(wanted * settings.trees) / F.col("_rows"))).cast("int")
    counted = counted.withColumn("_turns", turns).withColumn("_turn", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1)))
    drawn = counted.withColumn("_hash", F.xxhash64(F.lit(settings.seed), "_turn", id_column))
    first = F.floor(F.col("_turn") * settings.trees / F.col("_turns")).cast("int")
    behind = F.floor((F.col("_turn") + 1) * settings.trees / F.col("_turns")).cast("int")
    block = behind - first
    # The low bits choose the tree, the high ones whether the row is in its sample.
    limit = F.least(F.lit(1.0), F.lit(wanted) * block / F.col("_rows")) * _HASH_STEPS
    drawn = drawn.withColumn("_draw", F.shiftrightunsigned("_hash", 34)).where(F.col("_draw") < limit)
    drawn = drawn.withColumn("tree", (first + F.pmod(F.col("_hash").bitwiseAND((1 << 34) - 1), block)).cast("int"))
    names, sample, seed = list(features), settings.sample, settings.seed
    key_list = list(keys)

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_draw", id_column, *names]).head(sample)
        points = rows[names].to_numpy(float)
        height = int(np.ceil(np.log2(max(len(points), 2))))
        tree = _grow(points, np.random.default_rng([seed, int(key[-1])]), height)
        packed = {**dict(zip([*key_list, "tree"], key)), "sample_size": len(points), **tree}
        return pd.DataFrame({name: [value] for name, value in packed.items()})

    key_types = ", ".join(f"{k} {prepared.schema[k].dataType.simpleString()}" for k in keys)
    return (
        _spread_out(drawn.select(*keys, "tree", id_column, "_draw", *names), [*keys, "tree"])
        .groupBy(*keys, "tree")
        .applyInPandas(grow, f"{key_types}, tree int, {_TREE_FIELDS}")
    )


def _mean_depths(points: np.ndarray, trees: Iterator) -> np.ndarray:
    """Mean depth of each point over the trees, all points of a batch walked together; leaves lead to themselves."""
    total, count, rows = np.zeros(len(points)), 0, np.arange(len(points))
    for tree in trees:
        feature, threshold, left = (np.asarray(x) for x in (tree.feature, tree.threshold, tree.left))
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(int(np.ceil(np.log2(max(tree.sample_size, 2))))):
            node = left[node] + (points[rows, feature[node]] > threshold[node])
        total += np.asarray(tree.depth)[node]
        count += 1
    return total / max(count, 1)


def isolation_forest_raw_scores(
    prepared: DataFrame, forest: DataFrame, features: Sequence[str], *, keys: Sequence[str] = KEYS,
    id_column: str = "id", score_rows: int = SCORE_ROWS, few: bool = False,
) -> DataFrame:
    """`raw_score` of each id, near -1 for points that are isolated early.

    The rows of a group are hashed into parts of bounded size, and the group's forest, whose size
    is fixed by the number of trees and the sample, is sent to each part.
    """
    parts = prepared.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(score_rows)).cast("int").alias("_parts")
    )
    rows = join_groups(prepared.select(*keys, id_column, *features), parts, keys, few=few)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(id_column), F.col("_parts")).cast("int")).drop("_parts")
    sent = join_groups(forest, parts, keys)
    sent = sent.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    names, key_list = list(features), list(keys)

    def score(key: tuple, points: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        result = points[[*key_list, id_column]].copy()
        if len(trees) == 0:
            result["raw_score"] = -0.5
            return result
        depth = _mean_depths(points[names].to_numpy(float), trees.sort_values("tree").itertuples())
        usual = max(float(_path_length(np.array([trees["sample_size"].iloc[0]]))[0]), 1e-12)
        result["raw_score"] = -np.power(2.0, -depth / usual)
        return result

    fields = ", ".join(f"{c} {prepared.schema[c].dataType.simpleString()}" for c in [*keys, id_column])
    by = [*keys, "_part"]
    grouped = _spread_out(rows, by).groupBy(*by).cogroup(_spread_out(sent, by).groupBy(*by))
    return grouped.applyInPandas(score, f"{fields}, raw_score double")


def isolation_forest_score(
    df: DataFrame, *, features: Sequence[str] = C.FOREST_FEATURES, scope: str = "satellite",
    id_column: str = "id", settings: ForestSettings = ForestSettings(), split: Spread | bool | None = None,
) -> DataFrame:
    """The rows with `anomaly_score` (negative = anomalous), `is_anomaly` and `anomaly_type`.

    One forest per satellite, or one for all with `scope="fleet"`. The threshold is the lowest
    `contamination` share of the scores of a forest's own rows. Repeated ids are rows like others.
    """
    features = present(df, features)
    if len(features) < 2:
        return df.withColumns(
            {"anomaly_score": F.lit(1.0), "is_anomaly": F.lit(False), "anomaly_type": F.lit("none")}
        )
    rows, keys = scoped(df, KEYS if scope == "satellite" else ())
    split = spread_of(rows, keys, split)
    # Written with a number of its own for each row: ids may repeat.
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()))
    narrow = rows.select(*keys, id_column, "_row", *[F.col(f).cast("double").alias(f) for f in features])
    # Written once, as growing and scoring read it five times, and preparing it needs the medians.
    prepared = written(prepare(narrow, features, keys=keys, split=split))
    forest = isolation_forest_fit(prepared, features, settings=settings, keys=keys, id_column=id_column, few=split.few)
    # Written once: the threshold and the result both read the scores, and scoring is the dear part.
    raw = written(isolation_forest_raw_scores(prepared, forest, features, keys=keys, id_column="_row", few=split.few))
    offset = quantiles(raw, keys, "raw_score", {"_offset": settings.contamination}, split=split)
    scored = join_groups(raw, offset, keys, few=split.few)
    scored = scored.select(
        "_row", (F.col("raw_score") - F.col("_offset")).alias("anomaly_score")
    ).withColumns({"is_anomaly": F.col("anomaly_score") < 0, "anomaly_type": F.lit("none")})
    joined = rows.join(scored, "_row").drop("_row")
    return joined.drop("scope") if scope == "fleet" else joined
