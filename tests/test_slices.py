"""The plan for groups too large for one task gives the rows of the plain plan."""

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import anomaly, charts, grouping, relations, series, statistics, validation, windows
from fleetgauge.operators.grouping import Spread
from fleetgauge.operators.ordering import (
    fill_forward_backward, over_readings, reading_index, running_totals,
)
from fleetgauge.operators.quantiles import modes, quantiles
from fleetgauge.operators.select import latest_readings, mark_duplicates


def rows(df, digits=9):
    def plain(value):
        return round(value, digits) + 0.0 if isinstance(value, float) else value

    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


OPERATORS = {
    "index": lambda t, split: reading_index(t, split=split).select("id", "reading_index"),
    "totals": lambda t, split: running_totals(t, {"s": F.col("battery_pct")}, split=split).select("id", "s"),
    "fill": lambda t, split: fill_forward_backward(
        t.withColumn("battery_pct", F.when(F.col("id") % 3 == 0, F.col("battery_pct"))), ["battery_pct"], split=split
    ).select("id", "battery_pct"),
    "rolling": lambda t, split: windows.rolling_mean(t, ["temperature_c"], split=split).select("id", "temperature_c_mean"),
    "change": lambda t, split: windows.percent_change(t, ["battery_pct"], split=split).select("id", "battery_pct_change_pct"),
    "quantiles": lambda t, split: quantiles(t, ["satellite_id"], "radiation_level", {"a": 0.05, "b": 0.5, "c": 0.99}, split=split),
    "statistics": lambda t, split: statistics.column_statistics(t, split=split),
    "trend": lambda t, split: series.trend(t, split=split),
    "centered": lambda t, split: series.centered_moving_average(t, split=split),
    "centered_fixed": lambda t, split: series.centered_moving_average(t, window=7, split=split),
    "rate": lambda t, split: series.rate_of_change(t, split=split),
    "events": lambda t, split: anomaly.detect_statistical(t, split=split),
    "times": lambda t, split: validation.timestamp_issues(t, split=split),
    "boxes": lambda t, split: charts.box_stats(t, ["battery_pct", "altitude_km"], split=split),
    "correlation": lambda t, split: relations.correlation_matrix(t, split=split),
    "median": lambda t, split: statistics.impute_median(t, ["battery_pct"], split=split).select("id", "battery_pct"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
@pytest.mark.parametrize("few", [False, True])
def test_same_rows(stored, name, few):
    plain = rows(OPERATORS[name](stored, False), 6)
    assert rows(OPERATORS[name](stored, Spread(True, few)), 6) == plain


@pytest.mark.parametrize("chunk", [19, 20, 50, 1000])
def test_chunk_edges(stored, chunk):
    def columns(w):
        frame = w.rowsBetween(-19, 0)
        return {"mean": F.when(F.count("radiation_level").over(frame) == 20, F.avg("radiation_level").over(frame)),
                "next": F.lead("radiation_level", 2).over(w)}

    plain = over_readings(stored, columns, before=19, after=2, split=False).select("id", "mean", "next")
    cut = over_readings(stored, columns, before=19, after=2, split=True, chunk_rows=chunk).select("id", "mean", "next")
    assert rows(cut) == rows(plain)


def test_one_satellite_with_most_rows_and_null_key(spark, stored):
    """A hot group, a null group and equal rows all keep every row and their order."""
    hot = stored.withColumn("satellite_id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 > 0, "HOT").otherwise(F.col("satellite_id")))
    hot = hot.unionByName(hot.where("id = 7")).unionByName(hot.where("id = 7"))
    plain, cut = reading_index(hot, split=False), reading_index(hot, split=True)
    assert rows(cut.select("satellite_id", "id", "reading_index")) == rows(plain.select("satellite_id", "id", "reading_index"))


def test_copies_are_counted_in_both_plans(stored):
    many = stored.select("id", "satellite_id").unionByName(stored.select("id", "satellite_id").where("id < 50"))
    for split in (False, True):
        marked = mark_duplicates(many, split=split)
        assert marked.where("is_duplicate").count() == 50
        assert marked.count() == many.count()


def test_long_lists_of_newest_rows(stored):
    few, many = latest_readings(stored, 30), latest_readings(stored, 2000)
    assert rows(many.where("recency <= 30").select("id", "recency")) == rows(few.select("id", "recency"))
    assert many.count() == stored.count()


def test_mode_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", 1.0), ("a", 2.0)], "g string, v double")
    assert modes(df, ["g"], "v").first()["mode"] == 1.0


def test_a_frame_wider_than_a_chunk(stored):
    wide = lambda split: over_readings(
        stored.select("id", "satellite_id", "timestamp", "battery_pct"),
        lambda w: {"far": F.lag("battery_pct", 30).over(w), "near": F.lead("battery_pct", 25).over(w)},
        before=30, after=25, split=split, chunk_rows=10,
    )
    columns = ["id", "far", "near"]
    assert rows(wide(True).select(columns)) == rows(wide(False).select(columns))


def dealt_rows(df, monkeypatch, build):
    """The rows, and into how many tasks they are dealt when a task takes fifty."""
    monkeypatch.setattr(grouping, "FRAME_ROWS", 100, raising=False)
    monkeypatch.setattr(grouping, "TASK_ROWS", 50, raising=False)
    made = build(df)
    return rows(made, 6), made.groupBy(F.spark_partition_id()).count().count()


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_the_tasks_of_moving_averages_grow_with_the_rows(stored, monkeypatch, limit):
    plain = rows(series.centered_moving_average(stored, split=False), 6)
    monkeypatch.setattr(grouping, "GROUP_ROW_LIMIT", limit)
    cut, tasks = dealt_rows(stored, monkeypatch, series.centered_moving_average)
    assert cut == plain and tasks > 16


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_the_tasks_of_changes_and_trends_grow_with_the_rows(stored, monkeypatch, limit):
    plain = rows(windows.percent_change(stored.select("id", "satellite_id", "timestamp", "battery_pct"), ["battery_pct"], split=False), 6)
    whole = rows(series.time_series_analysis(stored, split=False), 4)
    monkeypatch.setattr(grouping, "GROUP_ROW_LIMIT", limit)
    narrow = stored.select("id", "satellite_id", "timestamp", "battery_pct")
    cut, tasks = dealt_rows(narrow, monkeypatch, lambda t: windows.percent_change(t, ["battery_pct"]))
    assert cut == plain and tasks > 8
    assert rows(series.time_series_analysis(stored), 4) == whole
