"""Filters, projections, sorts, set operations and joins."""

from pyspark.sql import functions as F

from checks.catalog import Tables, query
from checks.sql_parts import ALL_METRICS, EVENTS, health, melted
from fleetgauge.operators import anomaly, charts, cleaning, health as fleet, joins, select, validation

LABEL_WINDOWS = """e_rows AS (
  SELECT satellite_id, timestamp, id,
    row_number() OVER (PARTITION BY satellite_id ORDER BY timestamp, id) - 1 AS reading_index FROM telemetry
), e_hits AS (
  SELECT satellite_id, timestamp, id, reading_index, type, severity, start_index,
    (reading_index - start_index) / CAST(greatest(1, duration) AS DOUBLE) AS p,
    row_number() OVER (PARTITION BY satellite_id, id, type ORDER BY start_index DESC) AS newest
  FROM e_rows JOIN scenario_windows USING (satellite_id)
  WHERE reading_index >= start_index AND reading_index < start_index + duration
), labels AS (
  SELECT satellite_id, timestamp, id, reading_index, type,
    CASE WHEN type = 'battery_degradation' THEN severity * p
         WHEN type IN ('temperature_spike', 'signal_loss') THEN severity * (1 - abs(2 * p - 1)) ELSE severity END AS strength
  FROM e_hits WHERE newest = 1
)"""


@query("filter_satellite", "SELECT id, satellite_id, battery_pct FROM telemetry WHERE satellite_id = 'SAT-0003'", digits=None)
def _(t: Tables):
    return select.filter_satellite(t.telemetry, "SAT-0003").select("id", "satellite_id", "battery_pct")


@query(
    "filter_satellites_in",
    "SELECT id, satellite_id, cpu_usage_pct FROM telemetry WHERE satellite_id IN ('SAT-0001', 'SAT-0004')", digits=None,
)
def _(t: Tables):
    return select.filter_satellites_in(t.telemetry, ["SAT-0001", "SAT-0004"]).select("id", "satellite_id", "cpu_usage_pct")


@query("active_satellites", "SELECT * FROM satellites WHERE status = 'active'")
def _(t: Tables):
    return select.active_satellites(t.satellites)


VALID = "satellite_id IS NOT NULL AND regexp_matches(timestamp, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(timestamp AS TIMESTAMP) IS NOT NULL"


@query("valid_record_filter", f"SELECT id, satellite_id, timestamp FROM telemetry_dirty WHERE {VALID}")
def _(t: Tables):
    return select.valid_record_filter(t.dirty).select("id", "satellite_id", "timestamp")


@query("rejected_records", f"SELECT id, satellite_id, timestamp FROM telemetry_dirty WHERE NOT ({VALID})")
def _(t: Tables):
    return select.rejected_records(t.dirty).select("id", "satellite_id", "timestamp")


@query(
    "fill_ingest_defaults",
    "SELECT id, CASE WHEN id % 3 = 0 THEN 'realtime' ELSE data_source END AS data_source, true AS has_time FROM telemetry",
)
def _(t: Tables):
    bare = t.telemetry.withColumn("data_source", F.when(F.col("id") % 3 != 0, F.col("data_source")))
    filled = select.fill_ingest_defaults(bare)
    return filled.select("id", "data_source", F.col("ingested_at").isNotNull().alias("has_time"))


@query(
    "coerce_timestamps",
    "SELECT id, satellite_id, TRY_CAST(timestamp AS TIMESTAMP) AS timestamp FROM telemetry_dirty "
    "WHERE TRY_CAST(timestamp AS TIMESTAMP) IS NOT NULL",
)
def _(t: Tables):
    return select.coerce_timestamps(t.dirty).select("id", "satellite_id", "timestamp")


@query(
    "drop_sparse_rows",
    """SELECT * FROM telemetry_dirty WHERE (CASE WHEN id IS NULL THEN 0 ELSE 1 END)
  + (CASE WHEN satellite_id IS NULL THEN 0 ELSE 1 END) + (CASE WHEN timestamp IS NULL THEN 0 ELSE 1 END)
  + (CASE WHEN battery_pct IS NULL THEN 0 ELSE 1 END) + (CASE WHEN temperature_c IS NULL THEN 0 ELSE 1 END)
  + (CASE WHEN signal_strength_dbm IS NULL THEN 0 ELSE 1 END) + (CASE WHEN mission_status IS NULL THEN 0 ELSE 1 END) >= 4""",
    digits=None,
)
def _(t: Tables):
    return cleaning.drop_sparse_rows(t.dirty)


@query("numeric_projection", f"SELECT id, {ALL_METRICS} FROM telemetry", digits=None)
def _(t: Tables):
    return select.numeric_projection(t.telemetry, keep=["id"])


@query(
    "melt_metrics",
    f"WITH {melted('battery_pct, temperature_c, signal_strength_dbm', 'satellite_id, timestamp')}\nFINALLY\n"
    "SELECT satellite_id, timestamp, metric, value FROM vals",
    digits=None,
)
def _(t: Tables):
    return select.melt_metrics(t.telemetry, ["battery_pct", "temperature_c", "signal_strength_dbm"])


@query("series_points", "SELECT satellite_id, timestamp, id, battery_pct AS value FROM telemetry", digits=None)
def _(t: Tables):
    return select.series_points(t.telemetry, "battery_pct")


@query(
    "scatter_points",
    "SELECT satellite_id, battery_pct AS x, temperature_c AS y, cpu_usage_pct AS color FROM telemetry "
    "WHERE battery_pct IS NOT NULL AND temperature_c IS NOT NULL",
    digits=None,
)
def _(t: Tables):
    return select.scatter_points(t.telemetry, "battery_pct", "temperature_c", "cpu_usage_pct")


@query(
    "preview", "SELECT id, satellite_id, timestamp, battery_pct FROM telemetry ORDER BY timestamp, id LIMIT 50", digits=None
)
def _(t: Tables):
    return select.preview(t.telemetry).select("id", "satellite_id", "timestamp", "battery_pct")


@query(
    "pair_complete",
    "SELECT id, battery_pct, signal_strength_dbm FROM telemetry WHERE battery_pct IS NOT NULL AND signal_strength_dbm IS NOT NULL",
    digits=None,
)
def _(t: Tables):
    rows = select.pair_complete(t.telemetry, "battery_pct", "signal_strength_dbm")
    return rows.select("id", "battery_pct", "signal_strength_dbm")


@query("sort_by_time", "SELECT id, satellite_id, timestamp FROM telemetry ORDER BY timestamp, id")
def _(t: Tables):
    return select.sort_by_time(t.telemetry).select("id", "satellite_id", "timestamp")


@query("satellite_ids", "SELECT DISTINCT satellite_id FROM telemetry ORDER BY 1")
def _(t: Tables):
    return select.satellite_ids(t.telemetry)


@query("drop_duplicates", "SELECT DISTINCT * FROM telemetry_dirty", digits=None)
def _(t: Tables):
    return select.drop_duplicates(t.dirty)


@query(
    "union_batches",
    "SELECT id, satellite_id, battery_pct, CAST(NULL AS DOUBLE) AS cpu_usage_pct FROM telemetry "
    "UNION ALL SELECT id, satellite_id, NULL, cpu_usage_pct FROM telemetry",
    digits=None,
)
def _(t: Tables):
    first = t.telemetry.select("id", "satellite_id", "battery_pct")
    return select.union_batches(first, t.telemetry.select("id", "satellite_id", "cpu_usage_pct"))


CLEAN = """WITH c_rows AS (
  SELECT * REPLACE (TRY_CAST(timestamp AS TIMESTAMP) AS timestamp) FROM (SELECT DISTINCT * FROM telemetry_dirty)
  WHERE TRY_CAST(timestamp AS TIMESTAMP) IS NOT NULL
), c_filled AS (
  SELECT id, satellite_id, timestamp, mission_status,
    coalesce(last_value(battery_pct IGNORE NULLS) OVER up, first_value(battery_pct IGNORE NULLS) OVER down) AS battery_pct,
    coalesce(last_value(temperature_c IGNORE NULLS) OVER up, first_value(temperature_c IGNORE NULLS) OVER down) AS temperature_c,
    coalesce(last_value(signal_strength_dbm IGNORE NULLS) OVER up,
             first_value(signal_strength_dbm IGNORE NULLS) OVER down) AS signal_strength_dbm
  FROM c_rows
  WINDOW up AS (PARTITION BY satellite_id ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY satellite_id ORDER BY timestamp, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), c_clean AS (
  SELECT * FROM c_filled WHERE 3 + (battery_pct IS NOT NULL)::INT + (temperature_c IS NOT NULL)::INT
    + (signal_strength_dbm IS NOT NULL)::INT + (mission_status IS NOT NULL)::INT >= 4
)
FINALLY
"""


@query("clean", CLEAN + "SELECT * FROM c_clean", digits=None)
def _(t: Tables):
    return cleaning.clean(t.dirty)


@query(
    "clean_counts",
    CLEAN + """SELECT satellite_id, rows_before, rows_after, rows_before - rows_after AS rows_removed
FROM (SELECT satellite_id, count(*) AS rows_before FROM telemetry_dirty GROUP BY 1)
JOIN (SELECT satellite_id, count(*) AS rows_after FROM c_clean GROUP BY 1) USING (satellite_id)""",
)
def _(t: Tables):
    return cleaning.clean_counts(t.dirty)


@query(
    "range_flags",
    """SELECT id, concat_ws(',', CASE WHEN battery_pct < 0 OR battery_pct > 100 THEN 'battery_pct' END,
  CASE WHEN temperature_c < -50 OR temperature_c > 150 THEN 'temperature_c' END,
  CASE WHEN altitude_km < 200 OR altitude_km > 2000 THEN 'altitude_km' END,
  CASE WHEN velocity_kms < 65E-1 OR velocity_kms > 85E-1 THEN 'velocity_kms' END,
  CASE WHEN solar_voltage_v < 0 OR solar_voltage_v > 50 THEN 'solar_voltage_v' END,
  CASE WHEN current_a < 0 OR current_a > 100 THEN 'current_a' END,
  CASE WHEN cpu_usage_pct < 0 OR cpu_usage_pct > 100 THEN 'cpu_usage_pct' END,
  CASE WHEN memory_usage_pct < 0 OR memory_usage_pct > 100 THEN 'memory_usage_pct' END,
  CASE WHEN signal_strength_dbm < -120 OR signal_strength_dbm > 0 THEN 'signal_strength_dbm' END,
  CASE WHEN radiation_level < 0 OR radiation_level > 1000 THEN 'radiation_level' END,
  CASE WHEN gyro_x < -500 OR gyro_x > 500 THEN 'gyro_x' END, CASE WHEN gyro_y < -500 OR gyro_y > 500 THEN 'gyro_y' END,
  CASE WHEN gyro_z < -500 OR gyro_z > 500 THEN 'gyro_z' END, CASE WHEN accel_x < -20 OR accel_x > 20 THEN 'accel_x' END,
  CASE WHEN accel_y < -20 OR accel_y > 20 THEN 'accel_y' END, CASE WHEN accel_z < -20 OR accel_z > 20 THEN 'accel_z' END
  ) AS out_of_range FROM telemetry""",
)
def _(t: Tables):
    flagged = validation.range_flags(t.telemetry)
    return flagged.select("id", F.array_join("out_of_range", ",").alias("out_of_range"))


@query(
    "first_anomalies",
    f"""WITH {EVENTS}, placed AS (SELECT *, row_number() OVER (PARTITION BY satellite_id ORDER BY rule, timestamp, id) AS place,
    count(*) OVER (PARTITION BY satellite_id) AS events FROM events_found)
FINALLY
SELECT satellite_id, place, type, value, severity, greatest(0, events - 10) AS more FROM placed WHERE place <= 10""",
    digits=None,
)
def _(t: Tables):
    first = anomaly.first_anomalies(anomaly.detect_statistical(t.telemetry))
    return first.select("satellite_id", "place", "type", "value", "severity", "more")


@query(
    "mission_timeline",
    f"""WITH {EVENTS}, lanes AS (
  SELECT satellite_id, timestamp, id, CASE WHEN rule < 3 THEN type END AS name,
    row_number() OVER (PARTITION BY satellite_id ORDER BY timestamp, id, rule) - 1 AS lane FROM events_found)
FINALLY
SELECT satellite_id, timestamp, lane, coalesce(name, 'Event ' || CAST(lane + 1 AS VARCHAR)) AS name FROM lanes""",
)
def _(t: Tables):
    events = anomaly.detect_statistical(t.telemetry).withColumn("name", F.when(F.col("rule") < 3, F.col("type")))
    placed = select.mission_timeline(events.withColumn("id", F.col("id") * 10 + F.col("rule")))
    return placed.select("satellite_id", "timestamp", "lane", "name")


@query(
    "join_anomaly_counts",
    f"""WITH {health()}, {EVENTS}, counted AS (SELECT satellite_id, count(*) AS n FROM events_found GROUP BY 1)
FINALLY
SELECT satellite_id, health_score, coalesce(n, 0) AS anomaly_count FROM health LEFT JOIN counted USING (satellite_id)""",
    doubles="health_score",
)
def _(t: Tables):
    counts = anomaly.anomaly_counts(anomaly.detect_statistical(t.telemetry))
    return joins.join_anomaly_counts(fleet.overall_health(t.telemetry), counts).select(
        "satellite_id", "health_score", "anomaly_count"
    )


@query(
    "fleet_join",
    """WITH placed AS (SELECT *, row_number() OVER (PARTITION BY satellite_id ORDER BY timestamp DESC, id DESC) AS recency
  FROM telemetry WHERE satellite_id IN (SELECT satellite_id FROM satellites WHERE status = 'active'))
FINALLY
SELECT satellite_id, id, recency FROM placed WHERE recency <= 200""",
)
def _(t: Tables):
    return fleet.fleet_join(t.satellites, t.telemetry, 200).select("satellite_id", "id", "recency")


@query(
    "fleet_readings",
    "SELECT satellite_id, id FROM telemetry WHERE satellite_id IN (SELECT satellite_id FROM satellites WHERE status = 'active')",
)
def _(t: Tables):
    return fleet.fleet_join(t.satellites, t.telemetry).select("satellite_id", "id")


@query(
    "orphan_telemetry",
    "SELECT id, satellite_id FROM telemetry WHERE satellite_id NOT IN (SELECT satellite_id FROM satellites)",
)
def _(t: Tables):
    return joins.orphan_telemetry(t.telemetry, t.satellites).select("id", "satellite_id")


@query(
    "satellites_with_data",
    "SELECT * FROM satellites WHERE satellite_id IN (SELECT satellite_id FROM telemetry)",
)
def _(t: Tables):
    return joins.satellites_with_data(t.satellites, t.telemetry)


@query(
    "register_satellite",
    """SELECT satellite_id, name, status FROM satellites
UNION ALL SELECT DISTINCT satellite_id, satellite_id || ' found', 'active' FROM telemetry
  WHERE satellite_id NOT IN (SELECT satellite_id FROM satellites)""",
)
def _(t: Tables):
    seen = t.telemetry.select("satellite_id").distinct()
    records = seen.withColumns({"name": F.concat("satellite_id", F.lit(" found")), "status": F.lit("active")})
    unnamed = seen.withColumns({"name": F.lit(""), "status": F.lit("active")})
    registered = joins.register_satellite(t.satellites, records.unionByName(unnamed))
    return registered.select("satellite_id", "name", "status")


@query(
    "update_status",
    """SELECT satellite_id, name, CASE WHEN s THEN 'seen' ELSE status END AS status, s AS has_update
FROM (SELECT *, satellite_id IN (SELECT satellite_id FROM telemetry) AS s FROM satellites)""",
)
def _(t: Tables):
    changes = t.telemetry.select("satellite_id", F.lit("seen").alias("status")).distinct()
    updated = joins.update_status(t.satellites, changes)
    return updated.select("satellite_id", "name", "status", F.col("updated_at").isNotNull().alias("has_update"))


@query(
    "remove_satellite", "SELECT * FROM satellites WHERE satellite_id NOT IN (SELECT satellite_id FROM telemetry)"
)
def _(t: Tables):
    return joins.remove_satellite(t.satellites, t.telemetry.select("satellite_id").distinct())


@query(
    "label_scenario_windows",
    f"WITH {LABEL_WINDOWS}\nFINALLY\nSELECT satellite_id, id, reading_index, type, strength FROM labels",
    doubles="strength",
)
def _(t: Tables):
    labels = joins.label_scenario_windows(t.telemetry, t.windows)
    return labels.select("satellite_id", "id", "reading_index", "type", "strength")


@query(
    "mission_status",
    f"""WITH {LABEL_WINDOWS}, strengths AS (SELECT satellite_id, id,
    max(CASE WHEN type = 'battery_degradation' THEN strength END) AS b,
    max(CASE WHEN type = 'sensor_failure' THEN strength END) AS s,
    max(CASE WHEN type = 'signal_loss' THEN strength END) AS g FROM labels GROUP BY satellite_id, id)
FINALLY
SELECT satellite_id, id, CASE WHEN g > 5E-1 THEN 'Limited' WHEN s > 5E-1 OR b > 3E-1 THEN 'Degraded' ELSE 'Nominal' END
  AS mission_status FROM strengths""",
)
def _(t: Tables):
    labels = joins.label_scenario_windows(t.telemetry, t.windows)
    return joins.scenario_status(labels).select("satellite_id", "id", "mission_status")


@query(
    "top_health",
    f"WITH {health()}\nFINALLY\nSELECT satellite_id, health_score, status FROM health ORDER BY health_score DESC, satellite_id LIMIT 10",
    doubles="health_score",
)
def _(t: Tables):
    return fleet.top_health(fleet.overall_health(t.telemetry)).select("satellite_id", "health_score", "status")


@query(
    "list_satellites", "SELECT *, (SELECT count(*) FROM satellites) AS satellite_count FROM satellites"
)
def _(t: Tables):
    return fleet.list_satellites(t.satellites)


@query(
    "ground_track",
    """SELECT satellite_id, timestamp, id, longitude, latitude,
  row_number() OVER (PARTITION BY satellite_id ORDER BY timestamp DESC, id DESC) = 1 AS is_current FROM telemetry""",
    digits=None,
)
def _(t: Tables):
    return charts.ground_track(t.telemetry)
