"""Rule-based anomaly events."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions.scalars import anomaly_label, event_severity, severity_from_count
from fleetgauge.operators.forest import isolation_forest_score
from fleetgauge.operators.grouping import KEYS, ORDER, Spread, join_groups, ordering, spread_of
from fleetgauge.operators.ordering import over_readings
from fleetgauge.operators.validation import range_text
from fleetgauge.operators.windows import trailing_mean


@dataclass(frozen=True)
class Rule:
    """`hit(value, baseline, std)` marks an anomalous reading of the metric.

    `baseline(value, window)` is computed over at most `reach` earlier readings; `std` is the
    deviation of the metric over the whole satellite.
    """

    kind: str
    metric: str
    unit: str
    hit: Callable[[Column, Column, Column], Column]
    baseline: Callable[[Column, WindowSpec], Column] | None = None
    reach: int = 0


def _trailing(value: Column, window: WindowSpec) -> Column:
    return trailing_mean(value, C.ROLLING_READINGS, window)


def _previous(value: Column, window: WindowSpec) -> Column:
    return F.lag(value).over(window)


TEMPERATURE_SPIKE = Rule(
    "temperature_spike", "temperature_c", "C",
    lambda v, mean, std: v > mean + std * C.TEMPERATURE_SPIKE_STD, _trailing, C.ROLLING_READINGS - 1,
)
BATTERY_DROP = Rule(
    "battery_drop", "battery_pct", "%", lambda v, before, std: v - before < C.BATTERY_DROP, _previous, 1
)
SIGNAL_LOSS = Rule(
    "signal_loss", "signal_strength_dbm", "dBm",
    lambda v, mean, std: v < mean + C.SIGNAL_LOSS, _trailing, C.ROLLING_READINGS - 1,
)
CPU_OVERLOAD = Rule("cpu_overload", "cpu_usage_pct", "%", lambda v, none, std: v > C.CPU_OVERLOAD)
MEMORY_OVERLOAD = Rule("memory_overload", "memory_usage_pct", "%", lambda v, none, std: v > C.MEMORY_OVERLOAD)
RULES = [TEMPERATURE_SPIKE, BATTERY_DROP, SIGNAL_LOSS, CPU_OVERLOAD, MEMORY_OVERLOAD]


def detect_statistical(
    df: DataFrame, rules: Sequence[Rule] = RULES, *, keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER, split: Spread | bool | None = None,
) -> DataFrame:
    """One event per reading and rule that it hits, all rules in one pass over the readings."""
    rules = [r for r in rules if r.metric in df.columns]
    metrics = list(dict.fromkeys(r.metric for r in rules))
    order = ordering(df, order)
    rows = df.select(*dict.fromkeys([*keys, *order, *metrics]))
    spread = spread_of(rows, keys, split)
    std = rows.groupBy(*keys).agg(*[F.stddev_samp(m).alias(f"_std_{m}") for m in metrics])
    moving = [r for r in rules if r.baseline]
    if moving:
        baselines = lambda w: {f"_base_{r.kind}": r.baseline(F.col(r.metric), w) for r in moving}
        reach = max(r.reach for r in moving)
        rows = over_readings(rows, baselines, before=reach, keys=keys, order=order, split=spread)
    rows = join_groups(rows, std, keys, few=spread.few)
    events = []
    for i, rule in enumerate(rules):
        value, deviation = F.col(rule.metric), F.col(f"_std_{rule.metric}")
        base = F.col(f"_base_{rule.kind}") if rule.baseline else F.lit(None).cast("double")
        event = F.struct(
            F.lit(i).alias("rule"), F.lit(rule.kind).alias("type"), F.lit(rule.metric).alias("metric"),
            value.cast("double").alias("value"), F.lit(rule.unit).alias("unit"),
            event_severity(value, deviation).alias("severity"),
        )
        events.append(F.when(rule.hit(value, base, deviation), event))
    hits = rows.select(*keys, *order, F.explode(F.array_compact(F.array(*events))).alias("e"))
    return hits.select(*keys, *order, "e.*")


def detect(df: DataFrame, rule: Rule, **options) -> DataFrame:
    return detect_statistical(df, [rule], **options)


def classify_anomalies(df: DataFrame, **options) -> DataFrame:
    """Typed events; only the rules give types, the forest gives scores and flags."""
    return detect_statistical(df, **options)


def anomaly_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("satellite_id", "type").agg(
        F.count(F.lit(1)).alias("events"), F.min("rule").alias("rule")
    )


def anomaly_summary(df: DataFrame, events: DataFrame | None = None, *, fit: bool = False) -> DataFrame:
    """Events, flagged percentage, severity and a sentence for every satellite of the frame.

    The percentage needs the forest's flags in `is_anomaly`. Without them `fit` fits a forest; else it is null.
    """
    events = detect_statistical(df) if events is None else events
    if fit and "is_anomaly" not in df.columns:
        df = isolation_forest_score(df)
    flagged = F.avg(F.col("is_anomaly").cast("double")) if "is_anomaly" in df.columns else F.lit(None).cast("double")
    fleet = df.groupBy("satellite_id").agg(F.round(flagged * 100, 2).alias("ml_anomaly_pct"))
    by_type = anomaly_counts(events)
    part = F.struct(
        F.col("rule"), F.concat(F.col("events").cast("string"), F.lit(" "), anomaly_label(F.col("type"))).alias("text")
    )
    totals = by_type.groupBy("satellite_id").agg(
        F.sum("events").alias("total_anomalies"), F.sort_array(F.collect_list(part)).alias("parts")
    )
    total = F.coalesce("total_anomalies", F.lit(0))
    sentence = F.concat(F.lit("Detected: "), F.array_join(F.col("parts.text"), ", "), F.lit("."))
    return join_groups(fleet, totals, KEYS).select(
        "satellite_id", total.alias("total_anomalies"), "ml_anomaly_pct",
        severity_from_count(total).alias("severity"),
        F.coalesce(sentence, F.lit("No anomalies detected.")).alias("summary"),
    )


def first_anomalies(events: DataFrame, rows: int = 10) -> DataFrame:
    """The first events of each satellite (rule by rule, in time order) and how many more there are."""
    order = Window.partitionBy("satellite_id").orderBy("rule", *ordering(events))
    first = events.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows)
    totals = events.groupBy("satellite_id").agg(F.count(F.lit(1)).alias("events"))
    more = F.greatest(F.lit(0), F.col("events") - rows)
    return join_groups(first, totals, KEYS).withColumn("more", more)


def anomaly_records(events: DataFrame) -> DataFrame:
    """Events in the shape of the stored anomaly table, without id."""
    ranges = F.create_map(*[F.lit(x) for m, r in C.VALUE_RANGES.items() for x in (m, range_text(*r))])
    return events.select(
        "satellite_id", "timestamp", F.col("type").alias("anomaly_type"), "severity",
        F.concat(F.lit("One of the "), anomaly_label(F.col("type"))).alias("description"),
        F.col("metric").alias("affected_metric"), F.col("value").alias("metric_value"),
        F.try_element_at(ranges, F.col("metric")).alias("expected_range"),
        F.current_timestamp().alias("detected_at"),
    )
