"""Explanation texts as Columns over the rows of `explain_inputs`.

A text is a list of facts, one sentence a line. Each topic turns what was measured into sentences; a
mode is a choice of topics for a reader.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions.scalars import health_category, iso_time, traffic_light
from fleetgauge.operators.anomaly import first_anomalies
from fleetgauge.operators.grouping import KEYS, join_groups

#: What each rule has measured.
EVENT_TEXTS = {
    "temperature_spike": f"more than {C.TEMPERATURE_SPIKE_STD:g} deviations above the mean of {C.ROLLING_READINGS} readings",
    "battery_drop": f"more than {-C.BATTERY_DROP:g} points below the reading before",
    "signal_loss": f"more than {-C.SIGNAL_LOSS:g} dBm below the mean of {C.ROLLING_READINGS} readings",
    "cpu_overload": f"above the limit of {C.CPU_OVERLOAD:g} %",
    "memory_overload": f"above the limit of {C.MEMORY_OVERLOAD:g} %",
}
NO_EVENTS = "0 readings broke a rule."

#: Least score of a band, and what a score of that size says about the weighted metrics.
SCORE_MEANINGS = [
    (90, "Nearly all metrics are where they should be."),
    (70, "On the whole the metrics are sound, but some cost points."),
    (40, "Several metrics cost many points."),
    (None, "Most of the points are lost."),
]


def number(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.round(value, digits) + F.lit(0.0))  # no minus before zero


def _sentence(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _each(items: str, fact: Callable[[Column], Column]) -> Column:
    """One fact per item, none for a null list."""
    return F.coalesce(F.transform(items, fact), F.array().cast("array<string>"))


def verdict() -> Column:
    return F.array(
        _sentence(
            F.col("satellite_id"), " has ", number(F.col("health_score"), 1), " of 100 health points (",
            health_category(F.col("health_score")), ") over ", F.col("record_count").cast("string"), " readings.",
        )
    )


def meaning() -> Column:
    text = F.lit(SCORE_MEANINGS[-1][1])
    for least, says in reversed(SCORE_MEANINGS[:-1]):
        text = F.when(F.col("health_score") >= least, F.lit(says)).otherwise(text)
    return F.array(text)


def events() -> Column:
    found = F.col("anomalies")
    many = F.coalesce(found["total_anomalies"], F.lit(0))
    broken = _sentence(many.cast("string"), " readings broke a rule, severity ", found["severity"], ".")
    return F.array(F.when(many > 0, broken).otherwise(F.lit(NO_EVENTS)))


def metrics() -> Column:
    scored = F.filter("metrics", lambda m: m["score"].isNotNull())
    fact = lambda m: _sentence(m["metric"], " averages ", number(m["value"], 1), " ", m["unit"], " and earns ", number(m["score"], 1), " points.")
    return F.coalesce(F.transform(scored, fact), F.array().cast("array<string>"))


def lights() -> Column:
    scored = F.filter("metrics", lambda m: m["score"].isNotNull())
    return F.coalesce(
        F.transform(scored, lambda m: _sentence(m["metric"], " is on ", F.lower(traffic_light(m["score"])), ".")),
        F.array().cast("array<string>"),
    )


def spreads() -> Column:
    return _each(
        "statistics",
        lambda s: _sentence(s["metric"], " lies at ", number(s["mean"], 6), " with a deviation of ", F.coalesce(number(s["std"], 6), F.lit("none")), "."),
    )


def trends() -> Column:
    return _each("trends", lambda t: _sentence(t["metric"], " is ", t["direction"], " at ", number(t["slope"], 4), " a reading."))


def shapes() -> Column:
    return _each(
        "distributions",
        lambda d: _sentence(d["metric"], " is ", d["distribution_type"], ": skewness ", number(d["skewness"], 2), ", excess kurtosis ", number(d["kurtosis"], 2), "."),
    )


def relations() -> Column:
    return _each(
        "relationships",
        lambda r: _sentence(r["name"], " correlate at ", number(r["correlation"], 3), ", which is ", r["strength"], " and ", r["direction"], "."),
    )


def tips() -> Column:
    return _each("recommendations", lambda t: _sentence("Advice: ", t))


# Users may add a mode: a name and the topics of its text.
MODES: dict[str, list[Callable[[], Column]]] = {
    "engineer": [verdict, events, tips, metrics, trends, spreads, relations],
    "scientist": [verdict, shapes, spreads, relations],
    "student": [verdict, meaning, lights, tips],
}


def text_of(mode: str) -> Column:
    """The text of a mode; an unknown one gets the engineer's."""
    return F.array_join(F.concat(*[topic() for topic in MODES.get(mode, MODES["engineer"])]), "\n")


def explain(inputs: DataFrame, mode: str = "engineer") -> DataFrame:
    return inputs.select("satellite_id", F.lit(mode).alias("mode"), text_of(mode).alias("explanation"))


def explain_anomalies(events: DataFrame, satellites: DataFrame | None = None, shown: int = 10) -> DataFrame:
    """The first events of each satellite, a line each; `satellites` adds those without any event."""
    how = F.coalesce(
        *[F.when(F.col("type") == kind, F.lit(says)) for kind, says in EVENT_TEXTS.items()], _sentence("caught by the rule ", F.col("type"))
    )
    line = _sentence(
        iso_time(F.col("timestamp")), " ", F.col("metric"), " ", number(F.col("value"), 2), " ", F.col("unit"), ": ", how, " (", F.col("severity"), ")"
    )
    first = first_anomalies(events, shown).withColumn("line", line)
    listed = first.groupBy("satellite_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "line"))).alias("items"), F.max("events").alias("events"), F.max("more").alias("more"),
    )
    count = _sentence(F.col("events").cast("string"), " readings broke a rule")
    head = F.when(F.col("more") > 0, _sentence(count, "; the first ", F.size("items").cast("string"), ":")).otherwise(_sentence(count, ":"))
    report = listed.select("satellite_id", F.array_join(F.concat(F.array(head), F.col("items.line")), "\n").alias("explanation"))
    if satellites is None:
        return report
    every = satellites.select("satellite_id").distinct()
    return join_groups(every, report, KEYS).withColumn("explanation", F.coalesce("explanation", F.lit(NO_EVENTS)))


def insight_card(inputs: DataFrame, title: str, insights: Column, written: Column | None = None) -> DataFrame:
    """Title, time of writing, metrics, insights, and the insights in one line."""
    joined = F.when(F.size(insights) > 0, F.array_join(insights, " | ")).otherwise("Nothing to report.")
    return inputs.select(
        "satellite_id", F.lit(title).alias("title"), iso_time(F.current_timestamp() if written is None else written).alias("timestamp"),
        "metrics", insights.alias("insights"), joined.alias("summary"),
    )
