"""Quantiles by sketches are exact: ties, infinities, small groups, narrowed intervals, and a sketch that is wrong."""

import math

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import grouping, quantiles as q
from fleetgauge.operators.grouping import Spread

WANTED = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.99, "f": 1.0}


@pytest.fixture(scope="module")
def values(spark, tmp_path_factory):
    """Groups of one row to many, with ties, nulls, infinities and a key that is null."""
    path = str(tmp_path_factory.mktemp("values") / "v")
    n = F.col("id")
    rows = spark.range(60_000).select(
        F.when(n % 11 < 6, "large").when(n % 11 < 8, "ties").when(n % 11 == 8, "ends").when(n < 1000, F.concat(F.lit("small"), (n % 90).cast("string"))).alias("k"),
        F.when(n % 13 == 0, None).when(n % 11 < 6, F.sin(n) * 1e6).when(n % 11 < 8, (n % 3).cast("double"))
        .when(n % 11 == 8, F.when(n % 5 == 0, math.inf).when(n % 5 == 1, -math.inf).otherwise(n.cast("double"))).otherwise(F.cos(n)).alias("v"),
    ).withColumn("w", F.col("v") * -2 + 0.0)
    rows.write.parquet(path)
    return spark.read.parquet(path)


def found(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


@pytest.mark.parametrize("largest", [0, 10**9, 10**12])
def test_sketches_are_exact(values, largest):
    plain = q.quantiles(values, ["k"], "v", WANTED, split=False)
    assert found(q.quantiles(values, ["k"], "v", WANTED, split=Spread(True, True, largest))) == found(plain)


def test_several_columns(values):
    plain = q.metric_quantiles(values, ["v", "w", "none"], ["k"], WANTED, split=False)
    assert found(q.metric_quantiles(values, ["v", "w", "none"], ["k"], WANTED, split=Spread(True, False))) == found(plain)


def test_wrong_sketches_are_noticed(values, monkeypatch):
    plain = found(q.quantiles(values, ["k"], "v", WANTED, split=False))
    monkeypatch.setattr(q, "MARGIN", -0.2)
    assert found(q.quantiles(values, ["k"], "v", WANTED, split=Spread(True, True, 1))) == plain


def test_largest_group_is_counted(values):
    assert grouping.measure(values, ["k"]).largest == values.groupBy("k").count().agg(F.max("count")).first()[0]
