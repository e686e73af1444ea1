"""Health score and status of each metric, as expressions on its mean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge.functions.scalars import bands, clamp

# Fixed values. Each step is (limit, base, slope, anchor) and stands for base + slope * (m - anchor).
# A step of RISING holds from its limit up, one of FALLING up to its limit; the last holds elsewhere.
RISING = {
    "battery_pct": [(85, 95, 0.33, 85), (60, 70, 1.0, 60), (30, 40, 1.0, 30), (None, 0, 1.33, 0)],
    "signal_strength_dbm": [
        (-50, 95, 0.1, -50), (-80, 70, 0.83, -80), (-100, 40, 1.5, -100), (None, 40, 2.0, -100),
    ],
    "solar_voltage_v": [(28, 90, 0.45, 28), (20, 60, 3.75, 20), (10, 30, 3.0, 10), (None, 0, 3.0, 0)],
}
FALLING = {
    "cpu_usage_pct": [(50, 95, 0.0, 0), (75, 95, -1.2, 50), (90, 65, -2.33, 75), (None, 30, -3.0, 90)],
    "memory_usage_pct": [(60, 95, 0.0, 0), (80, 95, -1.75, 60), (95, 60, -4.0, 80), (None, 10, -1.0, 95)],
    "radiation_level": [
        (50, 95, -0.1, 30), (150, 90, -0.3, 50), (500, 60, -0.1, 150), (None, 25, -0.05, 500),
    ],
}
# Fixed values: (lowest mean, status) where more is better, (highest mean, status) where less is.
RISING_STATUS = {
    "battery_pct": ([(70, "Healthy"), (40, "Degraded")], "Critical"),
    "signal_strength_dbm": ([(-60, "Strong"), (-90, "Moderate")], "Weak"),
    "solar_voltage_v": ([(28, "Optimal"), (20, "Adequate")], "Low"),
}
FALLING_STATUS = {
    "cpu_usage_pct": ([(60, "Normal"), (85, "High")], "Critical"),
    "memory_usage_pct": ([(65, "Normal"), (88, "High")], "Critical"),
    "radiation_level": ([(100, "Low"), (300, "Moderate")], "High"),
}


def _steps(m: Column, steps: list[tuple], rising: bool) -> Column:
    result = None
    for limit, base, slope, anchor in steps:
        line = F.lit(float(base)) + (m - float(anchor)) * slope
        if limit is None:
            return result.otherwise(line)
        holds = m >= limit if rising else m <= limit
        result = F.when(holds, line) if result is None else result.when(holds, line)
    return result


def _temperature(m: Column) -> Column:
    return (
        F.when(m.between(15, 35), 100 - F.abs(m - 25) * 4)
        .when((m > 35) & (m <= 60), 60 - (m - 35) * 1.6)
        .when((m >= -20) & (m < 15), 60 - (15 - m) * 1.14)
        .otherwise(20 - F.abs(m - 25) * 0.5)
    )


def _score(raw: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: F.when(m.isNotNull(), F.round(clamp(raw(m), 0, 100), 1))


def _falling_status(metric: str) -> Callable[[Column], Column]:
    def status(m: Column) -> Column:
        limits, worst = FALLING_STATUS[metric]
        result = F.when(m.isNull(), F.lit(None).cast("string"))
        for top, label in limits:
            result = result.when(m <= top, F.lit(label))
        return result.otherwise(F.lit(worst))

    return status


def _temperature_status(m: Column) -> Column:
    return (
        F.when(m.isNull(), F.lit(None).cast("string"))
        .when(m.between(15, 35), "Normal")
        .when(m > 35, "Elevated")
        .otherwise("Cold")
    )


def metric_mean(metric: str) -> Column:
    """The aggregate a metric is scored by; for the sensor, the percentage of readings equal to 1."""
    if metric == "sensor_status":
        return F.avg(F.when(F.col(metric) == 1, 1.0).otherwise(0.0)) * 100
    return F.avg(metric)


# Users may add a metric: a name, a score of its mean and a status of its mean.
SCORERS: dict[str, Callable[[Column], Column]] = {
    "battery_pct": _score(lambda m: _steps(m, RISING["battery_pct"], True)),
    "temperature_c": _score(_temperature),
    "signal_strength_dbm": _score(lambda m: _steps(m, RISING["signal_strength_dbm"], True)),
    "solar_voltage_v": _score(lambda m: _steps(m, RISING["solar_voltage_v"], True)),
    "cpu_usage_pct": _score(lambda m: _steps(m, FALLING["cpu_usage_pct"], False)),
    "memory_usage_pct": _score(lambda m: _steps(m, FALLING["memory_usage_pct"], False)),
    "radiation_level": _score(lambda m: _steps(m, FALLING["radiation_level"], False)),
    "sensor_status": lambda m: F.round(m, 1),
}
STATUSES: dict[str, Callable[[Column], Column]] = {
    "battery_pct": lambda m: bands(m, *RISING_STATUS["battery_pct"]),
    "temperature_c": _temperature_status,
    "signal_strength_dbm": lambda m: bands(m, *RISING_STATUS["signal_strength_dbm"]),
    "solar_voltage_v": lambda m: bands(m, *RISING_STATUS["solar_voltage_v"]),
    "cpu_usage_pct": _falling_status("cpu_usage_pct"),
    "memory_usage_pct": _falling_status("memory_usage_pct"),
    "radiation_level": _falling_status("radiation_level"),
    "sensor_status": lambda m: bands(m, [(98, "All Active"), (80, "Degraded")], "Failed", strict=True),
}


def overall(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the scores that are present, 50 when none is."""
    total = F.lit(0.0)
    weight = F.lit(0.0)
    for metric, score in scores.items():
        w = float(weights[metric])
        total = total + F.coalesce(score * w / 100, F.lit(0.0))
        weight = weight + F.when(score.isNotNull(), w).otherwise(0.0)
    mean = F.when(weight > 0, F.try_divide(total, weight) * 100).otherwise(50.0)
    return F.round(clamp(mean, 0, 100), 1)
