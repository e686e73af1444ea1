"""Health of satellites and of the fleet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions.health import SCORERS, STATUSES, metric_mean, overall
from fleetgauge.functions.scalars import health_category, health_color, health_emoji
from fleetgauge.operators.grouping import KEYS, present, scoped
from fleetgauge.operators.select import active_satellites, latest_readings

# Advice by metric: (score below which it is given, text), the sharper one first.
ADVICE = [
    ("battery_pct", [(50, "urgent: charge before further work, battery points are below 50"), (70, "soon: plan a longer charge, battery points are below 70")]),
    ("temperature_c", [(50, "urgent: bring the temperature back, its points are below 50"), (70, "soon: look at heating and cooling, temperature points are below 70")]),
    ("signal_strength_dbm", [(50, "urgent: test the radio link, signal points are below 50"), (70, "soon: compare ground stations, signal points are below 70")]),
    ("sensor_status", [(80, "soon: test the sensors, one in five readings or more came from a faulty one")]),
    ("cpu_usage_pct", [(50, "soon: move work off the processor, its points are below 50")]),
    ("memory_usage_pct", [(50, "soon: release memory, its points are below 50")]),
]
NO_ADVICE = "none: no metric is below its limit"


def metric_means(df: DataFrame, *, keys: Sequence[str | Column] = KEYS) -> DataFrame:
    """One column of means per scored metric that the frame has; the only pass over the readings."""
    metrics = present(df, list(SCORERS))
    return df.groupBy(*keys).agg(*[metric_mean(m).alias(m) for m in metrics])


def score_means(means: DataFrame, *, weights: Mapping[str, float] = C.HEALTH_WEIGHTS) -> DataFrame:
    """Means replaced by scores (`<metric>_score`), with overall score, category and colour."""
    metrics = present(means, list(SCORERS))
    scored = means.withColumns({f"{m}_score": SCORERS[m](F.col(m)) for m in metrics})
    scores = {m: F.col(f"{m}_score") for m in metrics}
    scored = scored.withColumn("health_score", overall(scores, weights))
    return scored.withColumns(
        {"status": health_category(F.col("health_score")), "color": health_color(F.col("health_score"))}
    )


def metric_health(df: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Value, score, unit and status of each metric, long rows."""
    df, keys = scoped(df, keys)
    means = metric_means(df, keys=keys)
    cells = [
        F.struct(
            F.lit(m).alias("metric"), F.round(F.col(m), 1).alias("value"), SCORERS[m](F.col(m)).alias("score"),
            F.lit(C.HEALTH_UNITS.get(m, "")).alias("unit"), STATUSES[m](F.col(m)).alias("status"),
        )
        for m in present(means, list(SCORERS))
    ]
    return means.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def overall_health(df: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    df, keys = scoped(df, keys)
    scored = score_means(metric_means(df, keys=keys))
    return scored.select(*keys, "health_score", "status", "color")


def batch_health(df: DataFrame) -> DataFrame:
    """One row per satellite in the shape of the stored health table, without id."""
    scored = score_means(metric_means(df))
    names = {
        "battery_score": "battery_pct", "temperature_score": "temperature_c",
        "signal_score": "signal_strength_dbm", "cpu_score": "cpu_usage_pct",
        "memory_score": "memory_usage_pct", "radiation_score": "radiation_level",
        "solar_power_score": "solar_voltage_v", "sensor_score": "sensor_status",
    }

    def score(metric: str) -> Column:
        return F.col(f"{metric}_score") if metric in scored.columns else F.lit(0.0)

    return scored.select(
        "satellite_id", F.current_timestamp().alias("timestamp"), "health_score",
        *[score(metric).alias(name) for name, metric in names.items()],
        F.col("status").alias("overall_status"),
    )


def advice(score_of: Mapping[str, Column]) -> Column:
    """List of advice from the scores that are given."""
    lines = []
    for metric, steps in ADVICE:
        if metric not in score_of:
            continue
        line = None
        for limit, text in steps:
            below = score_of[metric] < limit
            line = F.when(below, F.lit(text)) if line is None else line.when(below, F.lit(text))
        lines.append(line)
    found = F.array_compact(F.array(*lines)) if lines else F.array().cast("array<string>")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_ADVICE)))


def recommendations(df: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    df, keys = scoped(df, keys)
    scored = score_means(metric_means(df, keys=keys))
    scores = {m: F.col(f"{m}_score") for m in SCORERS if f"{m}_score" in scored.columns}
    return scored.select(*keys, "health_score", advice(scores).alias("recommendations"))


def health_report(df: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Score, status, colour, advice and all metric results nested in one row per satellite."""
    df, keys = scoped(df, keys)
    scored = score_means(metric_means(df, keys=keys))
    metrics = present(scored, list(SCORERS))
    nested = [
        F.struct(
            F.lit(m).alias("metric"), F.round(F.col(m), 1).alias("value"), F.col(f"{m}_score").alias("score"),
            F.lit(C.HEALTH_UNITS.get(m, "")).alias("unit"), STATUSES[m](F.col(m)).alias("status"),
        )
        for m in metrics
    ]
    return scored.select(
        *keys, "health_score", "status", "color",
        advice({m: F.col(f"{m}_score") for m in metrics}).alias("recommendations"),
        F.array(*nested).alias("metrics"),
    )


def fleet_join(registry: DataFrame, df: DataFrame, rows: int | None = None) -> DataFrame:
    """The readings of every active satellite, or its newest `rows` ones."""
    active = active_satellites(registry).select("satellite_id")
    readings = df.join(active, "satellite_id", "left_semi")
    return latest_readings(readings, rows) if rows else readings


def fleet_satellites(registry: DataFrame, df: DataFrame, rows: int | None = None) -> DataFrame:
    """Score and status of every active satellite, nulls for those without readings."""
    health = overall_health(fleet_join(registry, df, rows))
    active = active_satellites(registry).select("satellite_id").distinct()
    return active.join(health, "satellite_id", "left").select("satellite_id", "health_score", "status")


def fleet_overview(registry: DataFrame, df: DataFrame, rows: int | None = None) -> DataFrame:
    """Fleet totals, satellites per health band, and the mean health: one row.

    By default over all readings, which needs one partial aggregate; with `rows` over the newest ones.
    """
    status = {name.lower(): F.count_if(F.col("status") == name) for _, name, _, _ in C.HEALTH_BANDS}
    totals = fleet_satellites(registry, df, rows).agg(
        F.count(F.lit(1)).alias("total_satellites"), F.count("health_score").alias("analyzed"),
        *[count.alias(name) for name, count in status.items()],
        F.coalesce(F.round(F.avg("health_score"), 1), F.lit(0.0)).alias("average_health"),
    )
    return totals.withColumns(
        {
            "healthy": F.col("excellent") + F.col("good"),
            "attention": F.col("warning") + F.col("critical"),
        }
    )


def health_distribution(health: DataFrame) -> DataFrame:
    """Satellites per category with their share in percent; empty categories count 0."""
    names = [name for _, name, _, _ in C.HEALTH_BANDS]
    counts = health.agg(
        *[F.count_if(F.col("status") == n).alias(n) for n in names], F.count("status").alias("_all")
    )
    share = F.coalesce(F.round(F.try_divide(F.col("satellites"), F.col("_all")) * 100, 1), F.lit(0.0))
    return counts.unpivot(["_all"], names, "category", "satellites").select(
        "category", "satellites", share.alias("share_pct")
    )


def top_health(health: DataFrame, k: int = 10) -> DataFrame:
    return health.orderBy(F.col("health_score").desc(), "satellite_id").limit(k)


def with_emoji(health: DataFrame) -> DataFrame:
    return health.withColumn("emoji", health_emoji(F.col("health_score")))


def store_summary(df: DataFrame, *, relative_error: float | None = None) -> DataFrame:
    """Satellites and records in the store; with an error given, the satellites are estimated."""
    if relative_error:
        satellites = F.approx_count_distinct("satellite_id", relative_error)
    else:
        satellites = F.count_distinct("satellite_id")
    return df.agg(satellites.alias("total_satellites"), F.count(F.lit(1)).alias("total_records"))


def satellite_span(df: DataFrame) -> DataFrame:
    return df.groupBy("satellite_id").agg(
        F.count(F.lit(1)).alias("record_count"), F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )


def list_satellites(registry: DataFrame) -> DataFrame:
    """Registry rows, each with the number of all of them (counted by an aggregate)."""
    total = registry.agg(F.count(F.lit(1)))
    return registry.withColumn("satellite_count", total.scalar())
