"""Scalar helpers on columns of the tables."""

from pyspark.sql import functions as F

from checks.aggregates import RELATED, SERIES
from checks.catalog import Tables, query
from checks.sql_parts import EVENTS, STATISTICS, health, melted
from fleetgauge.functions import scalars as S
from fleetgauge.operators import anomaly, charts, health as fleet, relations, select, series, windows
from fleetgauge.operators.ordering import reading_index

BATTERY_BAND = """CASE WHEN battery_pct IS NULL THEN NULL WHEN battery_pct >= 90 THEN '{0}' WHEN battery_pct >= 70 THEN '{1}'
  WHEN battery_pct >= 40 THEN '{2}' ELSE '{3}' END"""


@query(
    "health_category",
    f"""SELECT id, {BATTERY_BAND.format('Excellent', 'Good', 'Warning', 'Critical')} AS category,
  {BATTERY_BAND.format('#00CC96', '#636EFA', '#FFA15A', '#EF553B')} AS color,
  {BATTERY_BAND.format('🟢', '🔵', '🟠', '🔴')} AS emoji FROM telemetry""",
)
def _(t: Tables):
    score = F.col("battery_pct")
    return t.telemetry.select(
        "id", S.health_category(score).alias("category"), S.health_color(score).alias("color"),
        S.health_emoji(score).alias("emoji"),
    )


@query(
    "clamp",
    "SELECT id, CASE WHEN battery_pct IS NOT NULL THEN greatest(60E0, least(90E0, battery_pct)) END AS value FROM telemetry",
    doubles="value",
)
def _(t: Tables):
    return t.telemetry.select("id", S.clamp(F.col("battery_pct"), 60, 90).alias("value"))


@query(
    "safe_divide", "SELECT id, coalesce(radiation_level / nullif(solar_voltage_v, 0), -1E0) AS ratio FROM telemetry",
    doubles="ratio", digits=9,
)
def _(t: Tables):
    return t.telemetry.select("id", S.safe_divide(F.col("radiation_level"), F.col("solar_voltage_v"), -1.0).alias("ratio"))


def _bytes_sql(size: str) -> str:
    steps = [("B", 0), ("KB", 1), ("MB", 2), ("GB", 3), ("TB", 4)]
    cases = " ".join(
        f"WHEN abs({size} / {1024 ** p}E0) < 1024 THEN printf('%.2f {unit}', round({size} / {1024 ** p}E0, 2))"
        for unit, p in steps
    )
    return f"CASE {cases} ELSE printf('%.2f PB', round({size} / {1024 ** 5}E0, 2)) END"


_SIZE = "(radiation_level * pow(10E0, id % 17))"


@query("format_bytes", f"SELECT id, {_bytes_sql(_SIZE)} AS size FROM telemetry")
def _(t: Tables):
    size = F.col("radiation_level") * F.pow(F.lit(10.0), F.col("id") % 17)
    return t.telemetry.select("id", S.format_bytes(size).alias("size"))


@query(
    "iso_timestamp",
    """SELECT id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN epoch_us(timestamp) % 1000000 = 0 THEN '' ELSE strftime(timestamp, '.%f') END || 'Z' AS iso FROM telemetry""",
)
def _(t: Tables):
    return t.telemetry.select("id", S.iso_timestamp(F.col("timestamp")).alias("iso"))


@query("correlation_strength", RELATED + "SELECT satellite_id, name, strength, direction FROM related")
def _(t: Tables):
    sums = t.telemetry.groupBy("satellite_id").agg(
        *[relations.pearson(x, y).alias(name) for x, y, name in relations.C.RELATIONSHIP_PAIRS]
    )
    names = [name for _, _, name in relations.C.RELATIONSHIP_PAIRS]
    long = sums.unpivot(["satellite_id"], [f"`{n}`" for n in names], "name", "r").where("r IS NOT NULL")
    r = F.col("r")
    return long.select(
        "satellite_id", "name", S.correlation_strength(r).alias("strength"), S.correlation_direction(r).alias("direction")
    )


@query(
    "classify_distribution",
    f"""WITH {STATISTICS}, shapes AS (SELECT satellite_id, metric, CASE WHEN m2 > 0 THEN m3 / pow(m2, 15E-1) END AS s FROM v_moments)
FINALLY
SELECT satellite_id, metric, CASE WHEN s IS NULL THEN NULL WHEN abs(s) < 5E-1 THEN 'symmetric' WHEN s > 1 THEN 'right-skewed'
  WHEN s > 0 THEN 'slightly right-skewed' WHEN s < -1 THEN 'left-skewed' ELSE 'slightly left-skewed' END AS shape FROM shapes""",
)
def _(t: Tables):
    values = select.melt_metrics(t.telemetry, relations.C.METRICS, ["satellite_id"])
    skew = values.groupBy("satellite_id", "metric").agg(F.skewness("value").alias("s"))
    return skew.select("satellite_id", "metric", S.classify_distribution(F.col("s")).alias("shape"))


@query(
    "trend_direction",
    f"""WITH {SERIES}
FINALLY
SELECT satellite_id, metric, CASE WHEN slope > 1E-2 THEN 'increasing' WHEN slope < -1E-2 THEN 'decreasing' ELSE 'stable' END
  AS direction FROM trends""",
)
def _(t: Tables):
    return series.trend(t.telemetry).select("satellite_id", "metric", "direction")


@query(
    "unit_of",
    f"""WITH {melted('battery_pct, temperature_c, altitude_km, gyro_x', 'id')}
FINALLY
SELECT id, metric, CASE metric WHEN 'battery_pct' THEN '%' WHEN 'temperature_c' THEN 'C' WHEN 'altitude_km' THEN 'km'
  ELSE 'deg/s' END AS unit FROM vals""",
)
def _(t: Tables):
    long = select.melt_metrics(t.telemetry, ["battery_pct", "temperature_c", "altitude_km", "gyro_x"], ["id"])
    return long.select("id", "metric", S.unit_of(F.col("metric")).alias("unit"))


@query(
    "label_of",
    f"""WITH {melted('battery_pct, temperature_c, altitude_km, latitude', 'id')}
FINALLY
SELECT id, metric, CASE metric WHEN 'battery_pct' THEN 'Battery (%)' WHEN 'temperature_c' THEN 'Temperature (°C)'
  WHEN 'altitude_km' THEN 'Altitude (km)' ELSE metric END AS label FROM vals""",
)
def _(t: Tables):
    long = select.melt_metrics(t.telemetry, ["battery_pct", "temperature_c", "altitude_km", "latitude"], ["id"])
    return select.labelled_metrics(long).select("id", "metric", "label")


@query(
    "event_severity",
    """WITH stds AS (SELECT satellite_id, stddev_samp(temperature_c) AS s FROM telemetry GROUP BY 1)
FINALLY
SELECT id, CASE WHEN abs(temperature_c) > s * 3 THEN 'High' ELSE 'Medium' END AS severity
FROM telemetry JOIN stds USING (satellite_id)""",
)
def _(t: Tables):
    rows = windows.partition_std(t.telemetry, ["temperature_c"])
    return rows.select("id", S.event_severity(F.col("temperature_c"), F.col("temperature_c_std")).alias("severity"))


@query(
    "severity_from_count",
    f"""WITH {EVENTS}
FINALLY
SELECT satellite_id, type, CASE WHEN count(*) > 20 THEN 'Critical' WHEN count(*) > 10 THEN 'High' WHEN count(*) > 5 THEN 'Medium'
  ELSE 'Low' END AS severity FROM events_found GROUP BY satellite_id, type""",
)
def _(t: Tables):
    counts = anomaly.anomaly_counts(anomaly.detect_statistical(t.telemetry))
    return counts.select("satellite_id", "type", S.severity_from_count(F.col("events")).alias("severity"))


@query(
    "traffic_light",
    f"""WITH {health()}
FINALLY
SELECT satellite_id, CASE WHEN health_score >= 70 THEN 'Green' WHEN health_score >= 40 THEN 'Orange' ELSE 'Red' END AS light
FROM health""",
)
def _(t: Tables):
    scores = fleet.overall_health(t.telemetry)
    return scores.select("satellite_id", S.traffic_light(F.col("health_score")).alias("light"))


@query(
    "progress_color",
    """SELECT id, CASE WHEN cpu_usage_pct >= 80 THEN '#00CC96' WHEN cpu_usage_pct >= 50 THEN '#FFA15A' ELSE '#EF553B' END
  AS bar_color, printf('%.0f%%', round(cpu_usage_pct, 0)) AS bar_text FROM telemetry""",
)
def _(t: Tables):
    return charts.progress_bars(t.telemetry, "cpu_usage_pct").select("id", "bar_color", "bar_text")


@query(
    "gauge_band",
    f"""WITH {health()}
FINALLY
SELECT satellite_id, CASE WHEN health_score < 40 THEN 'red' WHEN health_score < 70 THEN 'orange' ELSE 'green' END AS band,
  health_score - 50 AS delta FROM health""",
    doubles="delta",
)
def _(t: Tables):
    return charts.gauge(fleet.overall_health(t.telemetry), "health_score").select("satellite_id", "band", "delta")


@query(
    "ecef_position",
    """SELECT id, (6371E0 + altitude_km) * cos(radians(latitude)) * cos(radians(longitude)) AS x,
  (6371E0 + altitude_km) * cos(radians(latitude)) * sin(radians(longitude)) AS y,
  (6371E0 + altitude_km) * sin(radians(latitude)) AS z FROM telemetry""",
    doubles="x y z",
)
def _(t: Tables):
    return charts.ecef_position(t.telemetry).select("id", "x", "y", "z")


@query(
    "wrap_longitude",
    """SELECT id, CASE WHEN d - 360 * floor(d / 360) > 180 THEN d - 360 * floor(d / 360) - 360 ELSE d - 360 * floor(d / 360) END
  AS longitude FROM (SELECT id, longitude * 3 AS d FROM telemetry)""",
    doubles="longitude",
)
def _(t: Tables):
    return t.telemetry.select("id", S.wrap_longitude(F.col("longitude") * 3).alias("longitude"))


@query(
    "orbit_number",
    """SELECT id, CAST((row_number() OVER (PARTITION BY satellite_id ORDER BY timestamp, id) - 1) // 54 AS INT) + 1
  AS orbit_number FROM telemetry""",
)
def _(t: Tables):
    return reading_index(t.telemetry).select("id", S.orbit_number(F.col("reading_index"), 54).alias("orbit_number"))


@query(
    "comm_status",
    "SELECT id, CASE WHEN signal_strength_dbm > -100 THEN 1 WHEN signal_strength_dbm IS NOT NULL THEN 0 END AS comm_status FROM telemetry",
)
def _(t: Tables):
    return t.telemetry.select("id", S.comm_status(F.col("signal_strength_dbm")).alias("comm_status"))


@query("dedup_key", "SELECT id, satellite_id || ':' || timestamp AS dedup_key FROM telemetry_dirty")
def _(t: Tables):
    return select.with_dedup_key(t.dirty).select("id", "dedup_key")
