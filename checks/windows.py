"""Windows over the readings of a satellite."""

from checks.catalog import Tables, query
from fleetgauge.operators import ordering, select, statistics, windows

IN_TIME = "PARTITION BY satellite_id ORDER BY timestamp, id"


@query(
    "rolling_mean",
    f"""SELECT id, satellite_id,
  CASE WHEN count(temperature_c) OVER w = 20 THEN avg(temperature_c) OVER w END AS temperature_c_mean,
  CASE WHEN count(signal_strength_dbm) OVER w = 20 THEN avg(signal_strength_dbm) OVER w END AS signal_strength_dbm_mean
FROM telemetry WINDOW w AS ({IN_TIME} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    doubles="temperature_c_mean signal_strength_dbm_mean",
)
def _(t: Tables):
    rolled = windows.rolling_mean(t.telemetry, ["temperature_c", "signal_strength_dbm"])
    return rolled.select("id", "satellite_id", "temperature_c_mean", "signal_strength_dbm_mean")


@query(
    "reading_delta",
    f"SELECT id, battery_pct - lag(battery_pct) OVER ({IN_TIME}) AS battery_pct_delta FROM telemetry",
    doubles="battery_pct_delta",
)
def _(t: Tables):
    return windows.reading_delta(t.telemetry, ["battery_pct"]).select("id", "battery_pct_delta")


@query(
    "percent_change",
    f"""WITH changes AS (
  SELECT id, (battery_pct - lag(battery_pct) OVER w) / nullif(abs(lag(battery_pct) OVER w), 0) * 100 AS battery_pct_change_pct
  FROM telemetry WHERE battery_pct IS NOT NULL WINDOW w AS ({IN_TIME}))
FINALLY
SELECT id, battery_pct_change_pct FROM telemetry LEFT JOIN changes USING (id)""",
    doubles="battery_pct_change_pct",
)
def _(t: Tables):
    return windows.percent_change(t.telemetry, ["battery_pct"]).select("id", "battery_pct_change_pct")


@query(
    "partition_std",
    "SELECT id, stddev_samp(temperature_c) OVER (PARTITION BY satellite_id) AS temperature_c_std FROM telemetry",
    doubles="temperature_c_std",
)
def _(t: Tables):
    return windows.partition_std(t.telemetry, ["temperature_c"]).select("id", "temperature_c_std")


@query(
    "fill_forward_backward",
    f"""SELECT id,
  coalesce(last_value(battery_pct IGNORE NULLS) OVER up, first_value(battery_pct IGNORE NULLS) OVER down) AS battery_pct,
  coalesce(last_value(signal_strength_dbm IGNORE NULLS) OVER up,
           first_value(signal_strength_dbm IGNORE NULLS) OVER down) AS signal_strength_dbm
FROM telemetry WINDOW up AS ({IN_TIME} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  down AS ({IN_TIME} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    digits=None,
)
def _(t: Tables):
    columns = ["battery_pct", "signal_strength_dbm"]
    return ordering.fill_forward_backward(t.telemetry, columns).select("id", *columns)


@query("reading_index", f"SELECT id, row_number() OVER ({IN_TIME}) - 1 AS reading_index FROM telemetry")
def _(t: Tables):
    return ordering.reading_index(t.telemetry).select("id", "reading_index")


@query(
    "mark_duplicates",
    """SELECT id, timestamp, mission_status, row_number() OVER (PARTITION BY id, satellite_id, timestamp, battery_pct,
  temperature_c, signal_strength_dbm, mission_status ORDER BY id) > 1 AS is_duplicate FROM telemetry_dirty""",
)
def _(t: Tables):
    return select.mark_duplicates(t.dirty).select("id", "timestamp", "mission_status", "is_duplicate")


@query(
    "latest_readings",
    """WITH placed AS (SELECT id, satellite_id,
  row_number() OVER (PARTITION BY satellite_id ORDER BY timestamp DESC, id DESC) AS recency FROM telemetry)
FINALLY
SELECT * FROM placed WHERE recency <= 100""",
)
def _(t: Tables):
    return select.latest_readings(t.telemetry, 100).select("id", "satellite_id", "recency")


@query(
    "current_position",
    """WITH placed AS (SELECT satellite_id, timestamp, id, latitude, longitude, altitude_km,
  row_number() OVER (PARTITION BY satellite_id ORDER BY timestamp DESC, id DESC) AS recency FROM telemetry)
FINALLY
SELECT * EXCLUDE (recency) FROM placed WHERE recency = 1""",
    digits=None,
)
def _(t: Tables):
    return select.current_position(t.telemetry)


@query(
    "bubble_sizes",
    """WITH ends AS (SELECT satellite_id, min(radiation_level) AS lo, max(radiation_level) AS hi FROM telemetry GROUP BY 1)
FINALLY
SELECT satellite_id, battery_pct AS x, temperature_c AS y, (radiation_level - lo) / nullif(hi - lo, 0) * 30 + 5 AS size
FROM telemetry JOIN ends USING (satellite_id)""",
    doubles="x y size",
)
def _(t: Tables):
    return windows.bubble_sizes(t.telemetry, "battery_pct", "temperature_c", "radiation_level")


@query(
    "impute_median",
    """WITH medians AS (SELECT satellite_id, quantile_cont(battery_pct, 0.5) AS mb, quantile_cont(temperature_c, 0.5) AS mt
  FROM telemetry GROUP BY 1)
FINALLY
SELECT id, coalesce(battery_pct, mb) AS battery_pct, coalesce(temperature_c, mt) AS temperature_c
FROM telemetry JOIN medians USING (satellite_id)""",
    doubles="battery_pct temperature_c",
)
def _(t: Tables):
    filled = statistics.impute_median(t.telemetry, ["battery_pct", "temperature_c"])
    return filled.select("id", "battery_pct", "temperature_c")


@query(
    "standardize",
    """WITH sums AS (SELECT satellite_id, avg(battery_pct) AS ab, stddev_pop(battery_pct) AS sb, avg(gyro_x) AS ag,
  stddev_pop(gyro_x) AS sg FROM telemetry GROUP BY 1)
FINALLY
SELECT id, (battery_pct - ab) / CASE WHEN sb = 0 THEN 1 ELSE sb END AS battery_pct,
  (gyro_x - ag) / CASE WHEN sg = 0 THEN 1 ELSE sg END AS gyro_x FROM telemetry JOIN sums USING (satellite_id)""",
    doubles="battery_pct gyro_x",
)
def _(t: Tables):
    return statistics.standardize(t.telemetry, ["battery_pct", "gyro_x"]).select("id", "battery_pct", "gyro_x")
