"""SQL pieces that several oracles share, written independently of the library."""

ALL_METRICS = (
    "altitude_km, velocity_kms, battery_pct, solar_voltage_v, current_a, temperature_c, cpu_usage_pct, "
    "memory_usage_pct, signal_strength_dbm, radiation_level, gyro_x, gyro_y, gyro_z, accel_x, accel_y, accel_z"
)
TREND_METRICS = (
    "battery_pct, temperature_c, signal_strength_dbm, altitude_km, cpu_usage_pct, solar_voltage_v, radiation_level"
)
SHAPE_METRICS = "battery_pct, temperature_c, signal_strength_dbm, altitude_km"


def melted(metrics: str, ids: str = "satellite_id", name: str = "vals", source: str = "telemetry") -> str:
    return (
        f"{name} AS (SELECT * FROM (SELECT {ids}, {metrics} FROM {source}) "
        f"UNPIVOT INCLUDE NULLS (value FOR metric IN ({metrics})))"
    )


# Mean, score and status of the eight scored metrics, and the overall score.
def health(source: str = "telemetry", key: str = "satellite_id") -> str:
    return f"""h_means AS (
  SELECT {key}, avg(battery_pct) AS battery_pct, avg(temperature_c) AS temperature_c,
    avg(signal_strength_dbm) AS signal_strength_dbm, avg(solar_voltage_v) AS solar_voltage_v,
    avg(cpu_usage_pct) AS cpu_usage_pct, avg(memory_usage_pct) AS memory_usage_pct,
    avg(radiation_level) AS radiation_level,
    avg(CASE WHEN sensor_status = 1 THEN 1E0 ELSE 0E0 END) * 100 AS sensor_status
  FROM {source} GROUP BY {key}
), h_raw AS (
  SELECT *,
    CASE WHEN battery_pct >= 85 THEN 95 + (battery_pct - 85) * 33E-2
         WHEN battery_pct >= 60 THEN 70 + (battery_pct - 60)
         WHEN battery_pct >= 30 THEN 40 + (battery_pct - 30) ELSE battery_pct * 133E-2 END AS r_battery,
    CASE WHEN temperature_c BETWEEN 15 AND 35 THEN 100 - abs(temperature_c - 25) * 4
         WHEN temperature_c > 35 AND temperature_c <= 60 THEN 60 - (temperature_c - 35) * 16E-1
         WHEN temperature_c >= -20 AND temperature_c < 15 THEN 60 - (15 - temperature_c) * 114E-2
         ELSE 20 - abs(temperature_c - 25) * 5E-1 END AS r_temperature,
    CASE WHEN signal_strength_dbm >= -50 THEN 95 + (signal_strength_dbm + 50) * 1E-1
         WHEN signal_strength_dbm >= -80 THEN 70 + (signal_strength_dbm + 80) * 83E-2
         WHEN signal_strength_dbm >= -100 THEN 40 + (signal_strength_dbm + 100) * 15E-1
         ELSE 40 + (signal_strength_dbm + 100) * 2 END AS r_signal,
    CASE WHEN solar_voltage_v >= 28 THEN 90 + (solar_voltage_v - 28) * 45E-2
         WHEN solar_voltage_v >= 20 THEN 60 + (solar_voltage_v - 20) * 375E-2
         WHEN solar_voltage_v >= 10 THEN 30 + (solar_voltage_v - 10) * 3 ELSE solar_voltage_v * 3 END AS r_solar,
    CASE WHEN cpu_usage_pct <= 50 THEN 95E0 WHEN cpu_usage_pct <= 75 THEN 95 - (cpu_usage_pct - 50) * 12E-1
         WHEN cpu_usage_pct <= 90 THEN 65 - (cpu_usage_pct - 75) * 233E-2
         ELSE 30 - (cpu_usage_pct - 90) * 3 END AS r_cpu,
    CASE WHEN memory_usage_pct <= 60 THEN 95E0 WHEN memory_usage_pct <= 80 THEN 95 - (memory_usage_pct - 60) * 175E-2
         WHEN memory_usage_pct <= 95 THEN 60 - (memory_usage_pct - 80) * 4
         ELSE 10 - (memory_usage_pct - 95) END AS r_memory,
    CASE WHEN radiation_level <= 50 THEN 95 + (30 - radiation_level) * 1E-1
         WHEN radiation_level <= 150 THEN 90 - (radiation_level - 50) * 3E-1
         WHEN radiation_level <= 500 THEN 60 - (radiation_level - 150) * 1E-1
         ELSE 25 - (radiation_level - 500) * 5E-2 END AS r_radiation
  FROM h_means
), h_scores AS (
  SELECT * EXCLUDE (r_battery, r_temperature, r_signal, r_solar, r_cpu, r_memory, r_radiation),
    round(greatest(0E0, least(100E0, r_battery)), 1) AS battery_score,
    round(greatest(0E0, least(100E0, r_temperature)), 1) AS temperature_score,
    round(greatest(0E0, least(100E0, r_signal)), 1) AS signal_score,
    round(greatest(0E0, least(100E0, r_solar)), 1) AS solar_power_score,
    round(greatest(0E0, least(100E0, r_cpu)), 1) AS cpu_score,
    round(greatest(0E0, least(100E0, r_memory)), 1) AS memory_score,
    round(greatest(0E0, least(100E0, r_radiation)), 1) AS radiation_score,
    round(sensor_status, 1) AS sensor_score
  FROM h_raw
), h_overall AS (
  SELECT *, round((battery_score * 25 + temperature_score * 15 + signal_score * 15 + solar_power_score * 10
     + cpu_score * 10 + memory_score * 10 + radiation_score * 10 + sensor_score * 5) / 100, 1) AS health_score
  FROM h_scores
), health AS (
  SELECT *, CASE WHEN health_score >= 90 THEN 'Excellent' WHEN health_score >= 70 THEN 'Good'
     WHEN health_score >= 40 THEN 'Warning' ELSE 'Critical' END AS status FROM h_overall
)"""


ADVICE = """concat_ws(' | ', CASE WHEN battery_score < 50 THEN 'urgent: charge before further work, battery points are below 50'
    WHEN battery_score < 70 THEN 'soon: plan a longer charge, battery points are below 70' END,
  CASE WHEN temperature_score < 50 THEN 'urgent: bring the temperature back, its points are below 50'
    WHEN temperature_score < 70 THEN 'soon: look at heating and cooling, temperature points are below 70' END,
  CASE WHEN signal_score < 50 THEN 'urgent: test the radio link, signal points are below 50'
    WHEN signal_score < 70 THEN 'soon: compare ground stations, signal points are below 70' END,
  CASE WHEN sensor_score < 80 THEN 'soon: test the sensors, one in five readings or more came from a faulty one' END,
  CASE WHEN cpu_score < 50 THEN 'soon: move work off the processor, its points are below 50' END,
  CASE WHEN memory_score < 50 THEN 'soon: release memory, its points are below 50' END)"""

EVENTS = """a_std AS (
  SELECT satellite_id, stddev_samp(temperature_c) AS st, stddev_samp(battery_pct) AS sb,
    stddev_samp(signal_strength_dbm) AS ss, stddev_samp(cpu_usage_pct) AS sc, stddev_samp(memory_usage_pct) AS sm
  FROM telemetry GROUP BY satellite_id
), a_base AS (
  SELECT t.*, st, sb, ss, sc, sm,
    CASE WHEN count(temperature_c) OVER w = 20 THEN avg(temperature_c) OVER w END AS mt,
    CASE WHEN count(signal_strength_dbm) OVER w = 20 THEN avg(signal_strength_dbm) OVER w END AS ms,
    battery_pct - lag(battery_pct) OVER (PARTITION BY satellite_id ORDER BY timestamp, id) AS db
  FROM telemetry t JOIN a_std USING (satellite_id)
  WINDOW w AS (PARTITION BY satellite_id ORDER BY timestamp, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
), events_found AS (
  SELECT satellite_id, timestamp, id, 0 AS rule, 'temperature_spike' AS type, 'temperature_c' AS metric,
    temperature_c AS value, 'C' AS unit, CASE WHEN abs(temperature_c) > 3 * st THEN 'High' ELSE 'Medium' END AS severity
  FROM a_base WHERE temperature_c > mt + 3 * st
  UNION ALL SELECT satellite_id, timestamp, id, 1, 'battery_drop', 'battery_pct', battery_pct, '%',
    CASE WHEN abs(battery_pct) > 3 * sb THEN 'High' ELSE 'Medium' END FROM a_base WHERE db < -2
  UNION ALL SELECT satellite_id, timestamp, id, 2, 'signal_loss', 'signal_strength_dbm', signal_strength_dbm, 'dBm',
    CASE WHEN abs(signal_strength_dbm) > 3 * ss THEN 'High' ELSE 'Medium' END FROM a_base WHERE signal_strength_dbm < ms - 15
  UNION ALL SELECT satellite_id, timestamp, id, 3, 'cpu_overload', 'cpu_usage_pct', cpu_usage_pct, '%',
    CASE WHEN abs(cpu_usage_pct) > 3 * sc THEN 'High' ELSE 'Medium' END FROM a_base WHERE cpu_usage_pct > 95
  UNION ALL SELECT satellite_id, timestamp, id, 4, 'memory_overload', 'memory_usage_pct', memory_usage_pct, '%',
    CASE WHEN abs(memory_usage_pct) > 3 * sm THEN 'High' ELSE 'Medium' END FROM a_base WHERE memory_usage_pct > 95
)"""

STATISTICS = f"""{melted(ALL_METRICS)}, v_mean AS (
  SELECT satellite_id, metric, avg(value) AS m FROM vals GROUP BY ALL
), v_moments AS (
  SELECT satellite_id, metric, count(value) AS n, avg((value - m) * (value - m)) AS m2,
    avg((value - m) * (value - m) * (value - m)) AS m3,
    avg((value - m) * (value - m) * (value - m) * (value - m)) AS m4
  FROM vals JOIN v_mean USING (satellite_id, metric) GROUP BY ALL
)"""

