"""Health of satellites and fleet."""

from pyspark.sql import functions as F

from checks.catalog import Tables, query
from checks.sql_parts import ADVICE, health
from fleetgauge.operators import health as fleet

_METRICS = [
    ("battery_pct", "battery_score", "%", "CASE WHEN battery_pct >= 70 THEN 'Healthy' WHEN battery_pct >= 40 THEN 'Degraded' ELSE 'Critical' END"),
    ("temperature_c", "temperature_score", "C", "CASE WHEN temperature_c BETWEEN 15 AND 35 THEN 'Normal' WHEN temperature_c > 35 THEN 'Elevated' ELSE 'Cold' END"),
    ("signal_strength_dbm", "signal_score", "dBm", "CASE WHEN signal_strength_dbm >= -60 THEN 'Strong' WHEN signal_strength_dbm >= -90 THEN 'Moderate' ELSE 'Weak' END"),
    ("solar_voltage_v", "solar_power_score", "V", "CASE WHEN solar_voltage_v >= 28 THEN 'Optimal' WHEN solar_voltage_v >= 20 THEN 'Adequate' ELSE 'Low' END"),
    ("cpu_usage_pct", "cpu_score", "%", "CASE WHEN cpu_usage_pct <= 60 THEN 'Normal' WHEN cpu_usage_pct <= 85 THEN 'High' ELSE 'Critical' END"),
    ("memory_usage_pct", "memory_score", "%", "CASE WHEN memory_usage_pct <= 65 THEN 'Normal' WHEN memory_usage_pct <= 88 THEN 'High' ELSE 'Critical' END"),
    ("radiation_level", "radiation_score", "rad", "CASE WHEN radiation_level <= 100 THEN 'Low' WHEN radiation_level <= 300 THEN 'Moderate' ELSE 'High' END"),
    ("sensor_status", "sensor_score", "%", "CASE WHEN sensor_status > 98 THEN 'All Active' WHEN sensor_status > 80 THEN 'Degraded' ELSE 'Failed' END"),
]
METRIC_SQL = " UNION ALL ".join(
    f"SELECT satellite_id, '{m}' AS metric, round({m}, 1) AS value, {score} AS score, '{unit}' AS unit, "
    f"{status} AS status FROM h_scores"
    for m, score, unit, status in _METRICS
)
COLOR = "CASE status WHEN 'Excellent' THEN '#00CC96' WHEN 'Good' THEN '#636EFA' WHEN 'Warning' THEN '#FFA15A' ELSE '#EF553B' END"


@query("metric_health", f"WITH {health()}\nFINALLY\n{METRIC_SQL}", doubles="value score")
def _(t: Tables):
    return fleet.metric_health(t.telemetry)


@query(
    "overall_health",
    f"WITH {health()}\nFINALLY\nSELECT satellite_id, health_score, status, {COLOR} AS color FROM health",
    doubles="health_score",
)
def _(t: Tables):
    return fleet.overall_health(t.telemetry)


@query(
    "batch_health",
    f"""WITH {health()}
FINALLY
SELECT satellite_id, health_score, battery_score, temperature_score, signal_score, cpu_score, memory_score,
  radiation_score, solar_power_score, sensor_score, status AS overall_status FROM health""",
    doubles="health_score battery_score temperature_score signal_score cpu_score memory_score radiation_score "
            "solar_power_score sensor_score",
)
def _(t: Tables):
    return fleet.batch_health(t.telemetry).drop("timestamp")


@query(
    "recommendations",
    f"""WITH {health()}
FINALLY
SELECT satellite_id, health_score, coalesce(nullif({ADVICE}, ''), 'none: no metric is below its limit')
  AS recommendations FROM health""",
    doubles="health_score",
)
def _(t: Tables):
    advice = fleet.recommendations(t.telemetry)
    return advice.withColumn("recommendations", F.array_join("recommendations", " | "))


def _fleet(source: str) -> str:
    return f"""WITH near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY satellite_id ORDER BY timestamp DESC, id DESC) AS recency
  FROM telemetry WHERE satellite_id IN (SELECT satellite_id FROM satellites WHERE status = 'active')) AS r{source}), {health('near')}
FINALLY
"""


OVERVIEW = """SELECT count(*) AS total_satellites, count(h.health_score) AS analyzed,
  count(CASE WHEN h.status = 'Excellent' THEN 1 END) AS excellent, count(CASE WHEN h.status = 'Good' THEN 1 END) AS good,
  count(CASE WHEN h.status = 'Warning' THEN 1 END) AS warning, count(CASE WHEN h.status = 'Critical' THEN 1 END) AS critical,
  coalesce(round(avg(h.health_score), 1), 0E0) AS average_health,
  count(CASE WHEN h.status IN ('Excellent', 'Good') THEN 1 END) AS healthy,
  count(CASE WHEN h.status IN ('Warning', 'Critical') THEN 1 END) AS attention
FROM (SELECT satellite_id FROM satellites WHERE status = 'active') LEFT JOIN health h USING (satellite_id)"""


@query("fleet_overview", _fleet("") + OVERVIEW, doubles="average_health")
def _(t: Tables):
    return fleet.fleet_overview(t.satellites, t.telemetry)


@query("fleet_overview_newest", _fleet(" WHERE recency <= 200") + OVERVIEW, doubles="average_health")
def _(t: Tables):
    return fleet.fleet_overview(t.satellites, t.telemetry, rows=200)


@query(
    "fleet_satellites",
    _fleet("") + """SELECT satellite_id, h.health_score, h.status
FROM (SELECT satellite_id FROM satellites WHERE status = 'active') LEFT JOIN health h USING (satellite_id)""",
    doubles="health_score",
)
def _(t: Tables):
    return fleet.fleet_satellites(t.satellites, t.telemetry)


@query(
    "health_distribution",
    f"""WITH {health()}, names AS (SELECT unnest(['Excellent', 'Good', 'Warning', 'Critical']) AS category)
FINALLY
SELECT category, count(status) AS satellites,
  round(count(status) * 100E0 / (SELECT count(*) FROM health), 1) AS share_pct
FROM names LEFT JOIN health ON status = category GROUP BY category""",
    doubles="share_pct",
)
def _(t: Tables):
    return fleet.health_distribution(fleet.overall_health(t.telemetry))


@query("store_summary", "SELECT count(DISTINCT satellite_id) AS total_satellites, count(*) AS total_records FROM telemetry")
def _(t: Tables):
    return fleet.store_summary(t.telemetry)


@query(
    "satellite_span",
    "SELECT satellite_id, count(*) AS record_count, min(timestamp) AS first_time, max(timestamp) AS last_time "
    "FROM telemetry GROUP BY satellite_id",
)
def _(t: Tables):
    return fleet.satellite_span(t.telemetry)
