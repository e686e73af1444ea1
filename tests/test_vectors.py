"""Hand-made values for the banding functions and formulas, edges included."""

import math

import pytest
from pyspark.sql import functions as F

from fleetgauge import schemas
from fleetgauge.functions import health, scalars as S
from fleetgauge.functions.tests_of_fit import pearson_p, with_normality_p
from fleetgauge.operators import anomaly, cleaning, forest, health as fleet, relations, select, statistics, validation
from fleetgauge.operators.joins import label_scenario_windows


def apply(spark, function, values, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "metric, cases",
    [
        ("battery_pct", {85: 95.0, 84.9: 94.9, 60: 70.0, 30: 40.0, 29: 38.6, None: None}),
        ("temperature_c", {25: 100.0, 35: 60.0, 60: 20.0, 61: 2.0, 14: 58.9, -21: 0.0, None: None}),
        ("cpu_usage_pct", {50: 95.0, 75: 65.0, 90: 30.0, 91: 27.0, 101: 0.0}),
        ("memory_usage_pct", {60: 95.0, 80: 60.0, 95: 0.0, 96: 9.0}),
        ("signal_strength_dbm", {-50: 95.0, -80: 70.0, -100: 40.0, -110: 20.0, -130: 0.0}),
        ("solar_voltage_v", {28: 90.0, 20: 60.0, 10: 30.0, 5: 15.0}),
        ("radiation_level", {50: 93.0, 150: 60.0, 500: 25.0, 600: 20.0, 1200: 0.0}),
    ],
)
def test_scores(spark, metric, cases):
    values = [None if v is None else float(v) for v in cases]
    assert apply(spark, health.SCORERS[metric], values) == list(cases.values())


@pytest.mark.parametrize(
    "function, kind, cases",
    [
        (S.severity_from_count, "int", {5: "Low", 6: "Medium", 11: "High", 21: "Critical"}),
        (S.correlation_strength, "double", {0.8: "very strong", -0.6: "strong", 0.4: "moderate", 0.2: "weak", 0.19: "very weak"}),
        (S.classify_distribution, "double", {0.49: "symmetric", 0.5: "slightly right-skewed", 1.01: "right-skewed",
                                             -0.5: "slightly left-skewed", -1.01: "left-skewed"}),
        (S.health_category, "double", {90.0: "Excellent", 89.9: "Good", 70.0: "Good", 40.0: "Warning", 39.9: "Critical"}),
        (S.trend_direction, "double", {0.011: "increasing", 0.01: "stable", -0.011: "decreasing"}),
        (S.format_bytes, "double", {0.0: "0.00 B", 1024.0: "1.00 KB", 1536.0: "1.50 KB", 2.0**60: "1024.00 PB"}),
        (S.wrap_longitude, "double", {0.0: 0.0, 180.0: 180.0, 181.0: -179.0, 720.5: 0.5}),
        (S.progress_color, "double", {80.0: "#00CC96", 50.0: "#FFA15A", 49.0: "#EF553B"}),
        (S.gauge_band, "double", {39.0: "red", 40.0: "orange", 70.0: "green", 100.0: "green"}),
        (lambda c: S.clamp(c, 0, 100), "double", {-1.0: 0.0, 101.0: 100.0, None: None}),
    ],
)
def test_bands(spark, function, kind, cases):
    assert apply(spark, function, list(cases), kind) == list(cases.values())


def test_pearson_p(spark):
    df = spark.createDataFrame([(0.5, 12), (0.5, 3), (1.0, 10), (0.5, 2), (0.0, 50), (0.99, 400)], "r double, n int")
    p = [r[0] for r in df.select(pearson_p("r", "n")).collect()]
    assert p[0] == pytest.approx(0.097855, abs=1e-6)
    assert p[1] == pytest.approx(2 / 3, abs=1e-9)
    assert p[2] == 0.0 and p[3] is None
    assert p[4] == pytest.approx(1.0) and p[5] == pytest.approx(0.0, abs=1e-12)


def test_pearson_p_in_closed_form(spark):
    """Three, four and six pairs have short formulas; many pairs have the normal tail as their limit."""
    forms = {3: lambda r: 1 - 2 / math.pi * math.asin(r), 4: lambda r: 1 - r, 6: lambda r: 1 - 1.5 * r + 0.5 * r**3}
    sizes = [0.0, 1e-6, 0.1, 0.5, 0.9, 0.999, 1 - 1e-9]
    rows = [(sign * r, n) for n in forms for r in sizes for sign in (1.0, -1.0)]
    many = [(z / math.sqrt(n), n) for n in (10**9, 10**12) for z in (0.01, 1.0, 3.0, 6.0)]
    found = spark.createDataFrame(rows + many + [(float("nan"), 9), (None, 9)], "r double, n long").select("r", "n", pearson_p("r", "n").alias("p")).collect()
    for row in found[: len(rows)]:
        assert row.p == pytest.approx(forms[row.n](abs(row.r)), rel=1e-9, abs=1e-11)
    for row in found[len(rows) : -2]:
        assert row.p == pytest.approx(math.erfc(row.r * math.sqrt(row.n) / math.sqrt(2)), rel=1e-6)
    assert found[-2].p is None and found[-1].p is None


def test_pearson_p_needs_no_python_worker(spark):
    frame = spark.createDataFrame([("a", float(i), float(-i)) for i in range(9)], "satellite_id string, battery_pct double, temperature_c double")
    plan = relations.relationships(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_normality_of_normal_and_skewed_shape(spark):
    df = spark.createDataFrame([(200, 0.0, 0.0), (200, 2.0, 6.0), (9, 0.0, 0.0), (200, None, None)], "n int, g double, k double")
    p = [r["p"] for r in with_normality_p(df, "p", "n", "g", "k").collect()]
    assert p[0] > 0.9 and p[1] < 1e-6 and p[2] is None and p[3] is None


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([("a", float(i), 1.0, -float(i)) for i in range(20)], "satellite_id string, battery_pct double, cpu_usage_pct double, temperature_c double")
    found = {(r.col_x, r.col_y): r.r for r in relations.correlation_matrix(df).collect()}
    assert ("battery_pct", "cpu_usage_pct") not in found
    assert found["battery_pct", "temperature_c"] == pytest.approx(-1)
    assert found["cpu_usage_pct", "cpu_usage_pct"] == 1.0


def test_all_null_metric_and_missing_columns(spark):
    df = spark.createDataFrame([("a", None, 90.0), ("a", None, 90.0)], "satellite_id string, battery_pct double, cpu_usage_pct double")
    scores = {r.metric: r.score for r in fleet.metric_health(df).collect()}
    assert scores == {"battery_pct": None, "cpu_usage_pct": 30.0}
    assert fleet.overall_health(df).first().health_score == 30.0
    empty = spark.createDataFrame([("a", None)], "satellite_id string, battery_pct double")
    assert fleet.overall_health(empty).first().health_score == 50.0
    assert statistics.column_statistics(df).count() == 1


def test_empty_frame(spark):
    empty = schemas.empty_table(spark, "telemetry")
    assert anomaly.detect_statistical(empty).count() == 0
    assert statistics.column_statistics(empty).count() == 0
    assert validation.validate(empty).count() == 0
    assert cleaning.clean(empty).count() == 0


def test_whole_frame_as_one_group(tables):
    report = validation.validate(tables.telemetry, keys=())
    assert report.count() == 1 and report.first().scope == "all"
    assert report.first().total_records == tables.telemetry.count()


def test_rolling_needs_twenty_values(spark):
    from fleetgauge.operators.windows import rolling_mean

    df = spark.range(25).selectExpr("id", "'a' AS satellite_id", "timestamp_seconds(id) AS timestamp", "double(id) AS v")
    means = [r.v_mean for r in rolling_mean(df, ["v"]).orderBy("id").collect()]
    assert means[:19] == [None] * 19 and means[19:] == [9.5, 10.5, 11.5, 12.5, 13.5, 14.5]


def test_later_of_two_windows_wins_across_blocks(spark):
    df = spark.range(3000).selectExpr("id", "'a' AS satellite_id", "timestamp_seconds(id) AS timestamp")
    marks = spark.createDataFrame([("a", "cpu_spike", 1000, 500, 0.4), ("a", "cpu_spike", 1200, 1000, 0.9)], schemas.SCENARIO_WINDOWS)
    labels = label_scenario_windows(df, marks)
    found = {r.reading_index: r.strength for r in labels.collect()}
    assert len(found) == 1200 and found[1100] == 0.4 and found[1300] == 0.9 and found[2199] == 0.9


def test_numbers_are_no_times(spark):
    df = spark.createDataFrame([("a", "2024"), ("a", "5"), ("a", "2024-01-01T00:00:00"), (None, "2024-01-01")], "satellite_id string, timestamp string")
    assert select.valid_record_filter(df).count() == 1
    assert select.rejected_records(df).count() == 3


def test_schemas(spark):
    assert schemas.table_schemas(spark).groupBy("table_name").count().count() == 5
    assert len(schemas.TELEMETRY.fields) == 27


def test_forest_finds_planted_outliers_whatever_the_partitions(spark):
    df = spark.range(400).selectExpr(
        "id", "'a' AS satellite_id", "IF(id % 100 = 0, 900.0D, double(id % 7)) AS battery_pct",
        "IF(id % 100 = 0, -900.0D, double(id % 5)) AS temperature_c", "double(id % 11) AS radiation_level",
    )
    scored = forest.isolation_forest_score(df)
    lowest = [r.id for r in scored.orderBy("anomaly_score").limit(4).collect()]
    assert sorted(lowest) == [0, 100, 200, 300]
    again = forest.isolation_forest_score(df.repartition(3, "radiation_level"))
    assert {r.id: r.anomaly_score for r in scored.collect()} == pytest.approx({r.id: r.anomaly_score for r in again.collect()}, abs=1e-9)
    one = forest.isolation_forest_score(df.select("id", "satellite_id", "battery_pct"))
    assert one.where("anomaly_score = 1 AND NOT is_anomaly").count() == 400


def test_forest_parts_do_not_change_scores(spark, tables):
    features = ["battery_pct", "temperature_c", "radiation_level"]
    narrow = tables.telemetry.select("satellite_id", "id", *features)
    prepared = forest.prepare(narrow, features, keys=["satellite_id"])
    settings = forest.ForestSettings(trees=10)
    trees = forest.isolation_forest_fit(prepared, features, settings=settings)
    whole = forest.isolation_forest_raw_scores(prepared, trees, features)
    parts = forest.isolation_forest_raw_scores(prepared, trees, features, score_rows=9)
    assert {r.id: r.raw_score for r in whole.collect()} == {r.id: r.raw_score for r in parts.collect()}


def test_path_length():
    import numpy as np

    found = forest._path_length(np.array([1, 2, 256]))
    assert list(found[:2]) == [0, 1] and math.isclose(found[2], 10.2447, abs_tol=1e-3)


def test_forest_keeps_rows_with_repeated_ids(spark):
    df = spark.range(400).selectExpr("IF(id < 20, 0L, id) AS id", "'a' AS satellite_id", "double(id % 7) AS battery_pct", "double(id % 5) AS temperature_c")
    scored = forest.isolation_forest_score(df, settings=forest.ForestSettings(trees=5))
    assert scored.count() == 400 and scored.where("id = 0").count() == 20


def test_marks_of_copies_see_where_nulls_are(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", 1.0, None), ("a", 1.0, None), ("b", None, None)], "satellite_id string, x double, y double")
    found = {r.satellite_id: r.duplicate_count for r in validation.duplicate_profile(df).collect()}
    assert found == {"a": 1, "b": 0}
