"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from checks.catalog import Tables, query
from checks.sql_parts import ALL_METRICS, EVENTS, STATISTICS, health
from fleetgauge import schemas
from fleetgauge.operators import anomaly, health as fleet, joins, statistics, validation
from fleetgauge.plans import reports
from fleetgauge.sources import tables

DIRTY_TIME = "TRY_CAST(timestamp AS TIMESTAMP)"


@query("scan_telemetry", "SELECT * FROM telemetry", digits=None)
def _(t: Tables):
    return t.telemetry


@query(
    "sql_query",
    "SELECT satellite_id, count(*) AS readings, avg(battery_pct) AS battery FROM telemetry "
    "WHERE cpu_usage_pct > 50 GROUP BY satellite_id",
    doubles="battery",
)
def _(t: Tables):
    text = """SELECT satellite_id, count(*) AS readings, avg(battery_pct) AS battery
              FROM telemetry WHERE cpu_usage_pct > :load GROUP BY satellite_id"""
    return tables.sql_query(t.spark, text, {"telemetry": t.telemetry}, {"load": 50})


@query(
    "append_telemetry",
    "SELECT satellite_id, timestamp, battery_pct, altitude_km, mission_status, id % 2 = 0 AS kept_id FROM telemetry",
    digits=None,
)
def _(t: Tables):
    path = t.scratch()
    tables.append_telemetry(t.telemetry.where("id % 2 = 0"), path)
    tables.append_telemetry(t.telemetry.where("id % 2 = 1").drop("id"), path)
    stored = t.spark.read.schema(schemas.TELEMETRY).parquet(path)
    columns = ["satellite_id", "timestamp", "battery_pct", "altitude_km", "mission_status"]
    own = t.telemetry.where("id % 2 = 0").select("id", F.lit(True).alias("own"))
    joined = stored.join(own, "id", "left")
    return joined.select(*columns, F.coalesce("own", F.lit(False)).alias("kept_id"))


@query("generate_ids", "SELECT count(*) AS rows_, count(*) AS ids FROM telemetry")
def _(t: Tables):
    numbered = tables.generate_ids(t.telemetry.drop("id"))
    return numbered.agg(F.count(F.lit(1)).alias("rows_"), F.count_distinct("id").alias("ids"))


@query(
    "coerce_batch",
    f"""SELECT satellite_id, {DIRTY_TIME} AS timestamp, CAST(NULL AS DOUBLE) AS altitude_km, battery_pct,
        temperature_c, signal_strength_dbm, mission_status FROM telemetry_dirty""",
    digits=None,
)
def _(t: Tables):
    return tables.coerce_batch(t.dirty).select(
        "satellite_id", "timestamp", "altitude_km", "battery_pct", "temperature_c", "signal_strength_dbm",
        "mission_status",
    )


@query(
    "export_csv",
    f"SELECT id, satellite_id, timestamp, {ALL_METRICS}, mission_status FROM telemetry",
    digits=None,
)
def _(t: Tables):
    path = t.scratch()
    kept = t.telemetry.select("id", "satellite_id", "timestamp", *ALL_METRICS.split(", "), "mission_status")
    tables.export_csv(kept, path)
    return t.spark.read.schema(kept.schema).option("header", True).csv(path)


@query(
    "export_json_report",
    f"""WITH {health()}, {EVENTS}
FINALLY
SELECT satellite_id, (SELECT count(*) FROM telemetry x WHERE x.satellite_id = health.satellite_id) AS total_records,
  health_score AS score, status, (SELECT count(*) FROM events_found e WHERE e.satellite_id = health.satellite_id) AS total_anomalies
FROM health""",
    doubles="score",
)
def _(t: Tables):
    path = t.scratch()
    documents = reports.report_document(reports.explain_inputs(t.telemetry))
    tables.export_json_report(documents, path)
    read = t.spark.read.schema(documents.schema).json(path)
    return read.select(
        "satellite_id", "report_metadata.total_records", "health_assessment.score", "health_assessment.status",
        "anomaly_report.total_anomalies",
    )


UNITS = """CASE metric WHEN 'altitude_km' THEN 'km' WHEN 'velocity_kms' THEN 'km/s' WHEN 'battery_pct' THEN '%'
  WHEN 'solar_voltage_v' THEN 'V' WHEN 'current_a' THEN 'A' WHEN 'temperature_c' THEN 'C' WHEN 'cpu_usage_pct' THEN '%'
  WHEN 'memory_usage_pct' THEN '%' WHEN 'signal_strength_dbm' THEN 'dBm' WHEN 'radiation_level' THEN 'rad'
  WHEN 'gyro_x' THEN 'deg/s' WHEN 'gyro_y' THEN 'deg/s' WHEN 'gyro_z' THEN 'deg/s' ELSE 'g' END"""
SUMMARY_SQL = f"""WITH {STATISTICS}
FINALLY
SELECT satellite_id, metric, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
  {UNITS} AS unit FROM vals GROUP BY satellite_id, metric"""


@query("export_report_bundle", SUMMARY_SQL, doubles="mean std min max")
def _(t: Tables):
    path = t.scratch()
    summary = statistics.statistics_summary(t.telemetry)
    tables.export_report_bundle({"Telemetry": t.telemetry, "Statistics": summary}, path)
    return t.spark.read.schema(summary.schema).parquet(f"{path}/Statistics")


@query(
    "export_fleet_summary",
    f"""WITH {health()}, {EVENTS}
FINALLY
SELECT satellite_id, health_score, status AS overall_status,
  (SELECT count(*) FROM events_found e WHERE e.satellite_id = health.satellite_id) AS anomaly_count FROM health""",
    doubles="health_score",
)
def _(t: Tables):
    path = t.scratch()
    counts = anomaly.anomaly_counts(anomaly.detect_statistical(t.telemetry))
    summary = joins.join_anomaly_counts(fleet.batch_health(t.telemetry), counts)
    tables.export_csv(summary, path)
    read = t.spark.read.schema(summary.schema).option("header", True).csv(path)
    return read.select("satellite_id", "health_score", "overall_status", "anomaly_count")


REGISTRY_SQL = "SELECT satellite_id, name, mission_type, orbit_type, status FROM satellites"


@query("load_registry", REGISTRY_SQL)
def _(t: Tables):
    path = t.scratch()
    t.satellites.write.json(path)
    return tables.load_registry(t.spark, path).select("satellite_id", "name", "mission_type", "orbit_type", "status")


@query("save_registry", REGISTRY_SQL.replace("status FROM", "CASE WHEN status = 'standby' THEN 'retired' ELSE status END AS status FROM"))
def _(t: Tables):
    folder = t.scratch()
    tables.save_registry(t.satellites, folder)
    changes = tables.load_saved_registry(t.spark, folder).where("status = 'standby'")
    changes = changes.select("satellite_id", F.lit("retired").alias("status"))
    tables.save_registry(joins.update_status(tables.load_saved_registry(t.spark, folder), changes), folder)
    saved = tables.load_saved_registry(t.spark, folder)
    return saved.select("satellite_id", "name", "mission_type", "orbit_type", "status")


@query(
    "write_result_tables",
    f"""WITH {health()}, {EVENTS}
FINALLY
SELECT 'health' AS record, satellite_id, health_score AS number, status AS text FROM health
UNION ALL SELECT 'anomaly', satellite_id, value, type FROM events_found
UNION ALL SELECT 'validation', satellite_id, CAST(count(*) - count(battery_pct) + count(*) - count(temperature_c)
  + count(*) - count(signal_strength_dbm) AS DOUBLE), 'missing' FROM telemetry GROUP BY satellite_id""",
    doubles="number",
)
def _(t: Tables):
    path = t.scratch()
    events = anomaly.detect_statistical(t.telemetry)
    tables.write_result_table(fleet.batch_health(t.telemetry), "health_records", f"{path}/health")
    tables.write_result_table(anomaly.anomaly_records(events), "anomaly_records", f"{path}/anomaly")
    reports_ = validation.validation_records(validation.validate(t.telemetry))
    tables.write_result_table(reports_, "validation_reports", f"{path}/validation")

    def stored(table, folder, kind, number, text):
        rows = tables.read_result_table(t.spark, table, f"{path}/{folder}")
        return rows.select(
            F.lit(kind).alias("record"), "satellite_id", F.expr(number).cast("double").alias("number"), F.expr(text).alias("text")
        )

    return (
        stored("health_records", "health", "health", "health_score", "overall_status")
        .unionByName(stored("anomaly_records", "anomaly", "anomaly", "metric_value", "anomaly_type"))
        .unionByName(stored("validation_reports", "validation", "validation", "missing_count", "'missing'"))
    )


@query(
    "describe_columns",
    f"""WITH {STATISTICS}
FINALLY
SELECT satellite_id, metric, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
  quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
  max(value) AS max FROM vals GROUP BY satellite_id, metric""",
    doubles="mean std min p25 p50 p75 max",
)
def _(t: Tables):
    return statistics.describe_columns(t.telemetry)
