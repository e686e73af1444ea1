"""Plans: one shuffle for window-only operators, pruned scans, no Python where none is needed."""

import pytest

from fleetgauge.operators import anomaly, health, relations, series, statistics, validation, windows
from fleetgauge.operators.select import filter_satellite, latest_readings


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return sum("Exchange hashpartitioning" in line for line in plan(df).splitlines())


def test_windows_shuffle_once(stored):
    assert exchanges(windows.rolling_mean(stored, ["temperature_c", "battery_pct"], split=False)) == 1
    assert exchanges(windows.percent_change(stored, ["battery_pct"], split=False)) == 1


def test_health_reads_only_its_columns(stored):
    text = plan(health.batch_health(stored))
    assert "gyro_x" not in text and "latitude" not in text and exchanges(health.batch_health(stored)) == 1


def test_filter_reaches_the_scan(stored):
    df = filter_satellite(stored, "SAT-0003")
    assert "EqualTo(satellite_id,SAT-0003)" in plan(df)


def test_newest_rows_are_cut_before_the_shuffle(stored):
    assert plan(latest_readings(stored, 100)).count("WindowGroupLimit") == 4


@pytest.mark.parametrize(
    "build",
    [
        health.batch_health, statistics.column_statistics, statistics.distribution_analysis, series.trend,
        series.centered_moving_average, relations.correlation_matrix, anomaly.detect_statistical, validation.validate,
    ],
)
def test_no_python_in_the_plan(stored, build):
    text = plan(build(stored))
    assert "Python" not in text and "InPandas" not in text
    assert "CartesianProduct" not in text
