"""Reports and explanations."""

from pyspark.sql import functions as F

from checks.aggregates import DIRECTION, RELATED, SERIES, SHAPE_NAME, SHAPES
from checks.anomalies import SUMMARY
from checks.catalog import Tables, query
from checks.health import _METRICS
from checks.sql_parts import ADVICE, ALL_METRICS, EVENTS, health
from fleetgauge import constants as C
from fleetgauge.operators import anomaly, forest
from fleetgauge.plans import explain, reports

_NONE = "none: no metric is below its limit"
_LIGHT = "CASE WHEN {0} >= 70 THEN 'green' WHEN {0} >= 40 THEN 'orange' ELSE 'red' END"


@query("analytics_report")
def _(t: Tables):
    report = reports.analytics_report(t.telemetry)
    return report.select(
        "satellite_id", "record_count",
        *[F.to_json(c).alias(c) for c in ("statistics", "correlations", "relationships", "trends", "distributions")],
    )


@query(
    "explain_inputs",
    f"""WITH {health()}, {SUMMARY}
FINALLY
SELECT satellite_id, health_score, status, (SELECT count(*) FROM telemetry x WHERE x.satellite_id = health.satellite_id)
  AS record_count, 8 AS metrics, 16 AS statistics, 7 AS trends, 4 AS distributions, total_anomalies, severity, summary
FROM health JOIN summaries USING (satellite_id)""",
    doubles="health_score",
)
def _(t: Tables):
    inputs = reports.explain_inputs(t.telemetry)
    return inputs.select(
        "satellite_id", "health_score", "status", "record_count",
        *[F.size(c).alias(c) for c in ("metrics", "statistics", "trends", "distributions")],
        F.col("anomalies.total_anomalies"), F.col("anomalies.severity").alias("severity"), F.col("anomalies.summary"),
    )


@query("report_document")
def _(t: Tables):
    flagged = forest.isolation_forest_score(t.telemetry)
    inputs = reports.explain_inputs(t.telemetry, flagged=flagged)
    document = reports.report_document(inputs, explain.text_of("student"))
    return document.select("satellite_id", F.to_json(F.struct(*document.columns[1:])).alias("document"))


def _place(metrics) -> str:
    return f"list_position({list(metrics)!r}, metric)"


_VERDICT = """satellite_id || ' has ' || printf('%.1f', round(health_score, 1)) || ' of 100 health points (' || status || ') over '
  || (SELECT count(*) FROM telemetry x WHERE x.satellite_id = health.satellite_id) || ' readings.'"""
_SPREADS = " UNION ALL ".join(
    f"SELECT satellite_id, {i} AS place, '{m} lies at ' || printf('%.6f', round(avg({m}), 6) + 0E0) || ' with a deviation of ' || "
    f"coalesce(printf('%.6f', round(stddev_samp({m}), 6) + 0E0), 'none') || '.' AS line FROM telemetry GROUP BY satellite_id"
    for i, m in enumerate(C.METRICS)
)
_EARNED = " UNION ALL ".join(
    f"SELECT satellite_id, {i} AS place, '{m} averages ' || printf('%.1f', round({m}, 1)) || ' {unit} and earns ' || printf('%.1f', {score}) || ' points.' AS line FROM health"
    for i, (m, score, unit, _) in enumerate(_METRICS)
)
_LINES = f"""WITH {health()}, {SUMMARY}, {SERIES}, {RELATED.removeprefix('WITH ').split(chr(10) + 'FINALLY')[0]}, verdicts AS (
  SELECT satellite_id, 0 AS place, {_VERDICT} AS line FROM health
), events_said AS (SELECT satellite_id, 0 AS place, CASE WHEN total_anomalies > 0
    THEN total_anomalies || ' readings broke a rule, severity ' || severity || '.' ELSE '0 readings broke a rule.' END AS line FROM summaries
), tips AS (SELECT satellite_id, 0 AS place, 'Advice: ' || replace(coalesce(nullif({ADVICE}, ''), '{_NONE}'), ' | ', chr(10) || 'Advice: ') AS line FROM health
), earned AS ({_EARNED}), spreads AS ({_SPREADS}
), turns AS (SELECT satellite_id, {_place(C.TREND_METRICS)} AS place, metric || ' is ' || {DIRECTION} || ' at ' || printf('%.4f', round(slope, 4) + 0E0) || ' a reading.' AS line FROM trends
), relations AS (SELECT satellite_id, row_number() OVER (PARTITION BY satellite_id ORDER BY abs(correlation) DESC, pair) AS place,
    name || ' correlate at ' || printf('%.3f', round(correlation, 3) + 0E0) || ', which is ' || strength || ' and ' || direction || '.' AS line FROM related
)"""
_SHAPE_LINES = f"""WITH {SHAPES}
FINALLY
SELECT satellite_id, {_place(C.DISTRIBUTION_METRICS)} AS place, metric || ' is ' || {SHAPE_NAME} || ': skewness '
  || printf('%.2f', round(skewness, 2) + 0E0) || ', excess kurtosis ' || printf('%.2f', round(kurtosis, 2) + 0E0) || '.' AS line FROM d_four"""


def _told(mode: str, *topics: str) -> str:
    lines = " UNION ALL ".join(f"SELECT satellite_id, {i} AS topic, place, line FROM {topic}" for i, topic in enumerate(topics))
    return f"SELECT satellite_id, '{mode}' AS mode, string_agg(line, chr(10) ORDER BY topic, place) AS explanation FROM ({lines}) GROUP BY satellite_id"


ENGINEER = _told("engineer", "verdicts", "events_said", "tips", "earned", "turns", "spreads", "relations")


@query("explain_engineer", f"{_LINES}\nFINALLY\n{ENGINEER}")
def _(t: Tables):
    return explain.explain(reports.explain_inputs(t.telemetry), "engineer")


# The shapes come from CTEs of their own, under names that the others use too.
_WITH_SHAPES = _SHAPE_LINES.removeprefix("WITH ").replace("vals", "s_vals").split("\nFINALLY\n")
SCIENTIST = _told("scientist", "verdicts", "shapes_said", "spreads", "relations")
_ALL_LINES = f"{_LINES}, {_WITH_SHAPES[0]}, shapes_said AS ({_WITH_SHAPES[1]})"


@query("explain_scientist", f"{_ALL_LINES}\nFINALLY\n{SCIENTIST}")
def _(t: Tables):
    return explain.explain(reports.explain_inputs(t.telemetry), "scientist")


_LIGHTS = " || chr(10) || ".join(f"'{m} is on ' || {_LIGHT.format(score)} || '.'" for m, score, _, _ in _METRICS)
STUDENT = f"""WITH {health()}, advised AS (SELECT *, (SELECT count(*) FROM telemetry x WHERE x.satellite_id = health.satellite_id) AS n,
    coalesce(nullif({ADVICE}, ''), '{_NONE}') AS tips FROM health)
FINALLY
SELECT satellite_id, 'student' AS mode, satellite_id || ' has ' || printf('%.1f', round(health_score, 1)) || ' of 100 health points (' || status
  || ') over ' || n || ' readings.' || chr(10)
  || CASE WHEN health_score >= 90 THEN 'Nearly all metrics are where they should be.'
          WHEN health_score >= 70 THEN 'On the whole the metrics are sound, but some cost points.'
          WHEN health_score >= 40 THEN 'Several metrics cost many points.' ELSE 'Most of the points are lost.' END || chr(10)
  || {_LIGHTS} || chr(10) || 'Advice: ' || replace(tips, ' | ', chr(10) || 'Advice: ') AS explanation
FROM advised"""


@query("explain_student", STUDENT)
def _(t: Tables):
    return explain.explain(reports.explain_inputs(t.telemetry), "student")


_LIT = " UNION ALL ".join(
    f"SELECT satellite_id, {i} AS place, '{m} is on ' || {_LIGHT.format(score)} || '.' AS line FROM health" for i, (m, score, _, _) in enumerate(_METRICS)
)
_EVERY = f"""{_ALL_LINES}, lit AS ({_LIT}), meanings AS (
  SELECT satellite_id, 0 AS place, CASE WHEN health_score >= 90 THEN 'Nearly all metrics are where they should be.'
    WHEN health_score >= 70 THEN 'On the whole the metrics are sound, but some cost points.'
    WHEN health_score >= 40 THEN 'Several metrics cost many points.' ELSE 'Most of the points are lost.' END AS line FROM health)"""


@query("explain", f"{_EVERY}\nFINALLY\n{ENGINEER} UNION ALL {SCIENTIST} UNION ALL {_told('student', 'verdicts', 'meanings', 'lit', 'tips')}")
def _(t: Tables):
    inputs = reports.explain_inputs(t.telemetry)
    modes = [explain.explain(inputs, mode) for mode in ("engineer", "scientist", "student")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


@query(
    "explain_anomalies",
    f"""WITH {EVENTS}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY satellite_id ORDER BY rule, timestamp, id) AS place,
    count(*) OVER (PARTITION BY satellite_id) AS n FROM events_found
), items AS (
  SELECT satellite_id, place, n, strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN epoch_us(timestamp) % 1000000 = 0 THEN '' ELSE strftime(timestamp, '.%f') END
    || ' ' || metric || ' ' || printf('%.2f', round(value, 2)) || ' ' || unit || ': ' || CASE type
    WHEN 'temperature_spike' THEN 'more than 3 deviations above the mean of 20 readings'
    WHEN 'battery_drop' THEN 'more than 2 points below the reading before'
    WHEN 'signal_loss' THEN 'more than 15 dBm below the mean of 20 readings'
    ELSE 'above the limit of 95 %' END || ' (' || severity || ')' AS line
  FROM placed WHERE place <= 10
), written AS (
  SELECT satellite_id, any_value(n) || ' readings broke a rule' || CASE WHEN any_value(n) > 10 THEN '; the first 10' ELSE '' END || ':' || chr(10)
    || string_agg(line, chr(10) ORDER BY place) AS explanation
  FROM items GROUP BY satellite_id)
FINALLY
SELECT satellite_id, coalesce(explanation, '0 readings broke a rule.') AS explanation
FROM (SELECT satellite_id FROM satellites UNION SELECT satellite_id FROM telemetry) LEFT JOIN written USING (satellite_id)""",
)
def _(t: Tables):
    every = t.satellites.select("satellite_id").union(t.telemetry.select("satellite_id"))
    return explain.explain_anomalies(anomaly.detect_statistical(t.telemetry), every)


_ENTRIES = " || '; ' || ".join(
    f"'{m} ' || printf('%.1f', round({m}, 1)) || ' {unit} ' || {status}" for m, _, unit, status in _METRICS
)


@query(
    "insight_card",
    f"""WITH {health()}, advised AS (SELECT satellite_id, coalesce(nullif({ADVICE}, ''), '{_NONE}') AS summary,
    {_ENTRIES} AS metrics FROM health)
FINALLY
SELECT satellite_id, 'Fleet health' AS title, '2024-01-02T03:04:05' AS timestamp, metrics, string_split(summary, ' | ') AS insights, summary FROM advised""",
)
def _(t: Tables):
    inputs = reports.explain_inputs(t.telemetry)
    card = explain.insight_card(inputs, "Fleet health", F.col("recommendations"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    entry = lambda m: F.concat(m["metric"], F.lit(" "), F.format_string("%.1f", m["value"]), F.lit(" "), m["unit"], F.lit(" "), m["status"])
    return card.withColumn("metrics", F.array_join(F.transform("metrics", entry), "; "))
