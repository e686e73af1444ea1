"""Fixed values of the telemetry model: columns, limits, weights, labels."""

# The columns a telemetry table is expected to have.
EXPECTED_COLUMNS = [
    "satellite_id", "timestamp", "latitude", "longitude", "altitude_km", "velocity_kms",
    "orbit_number", "battery_pct", "solar_voltage_v", "current_a", "temperature_c",
    "cpu_usage_pct", "memory_usage_pct", "signal_strength_dbm", "radiation_level",
    "gyro_x", "gyro_y", "gyro_z", "accel_x", "accel_y", "accel_z",
    "sensor_status", "comm_status", "mission_status",
]

# The sixteen measured metrics, with unit and axis label.
METRIC_UNITS = {
    "altitude_km": "km", "velocity_kms": "km/s", "battery_pct": "%", "solar_voltage_v": "V",
    "current_a": "A", "temperature_c": "C", "cpu_usage_pct": "%", "memory_usage_pct": "%",
    "signal_strength_dbm": "dBm", "radiation_level": "rad",
    "gyro_x": "deg/s", "gyro_y": "deg/s", "gyro_z": "deg/s",
    "accel_x": "g", "accel_y": "g", "accel_z": "g",
}
METRIC_LABELS = {
    "altitude_km": "Altitude (km)", "velocity_kms": "Velocity (km/s)",
    "battery_pct": "Battery (%)", "solar_voltage_v": "Solar Voltage (V)",
    "current_a": "Current (A)", "temperature_c": "Temperature (°C)",
    "cpu_usage_pct": "CPU Usage (%)", "memory_usage_pct": "Memory Usage (%)",
    "signal_strength_dbm": "Signal (dBm)", "radiation_level": "Radiation (rad)",
    "gyro_x": "Gyro X (°/s)", "gyro_y": "Gyro Y (°/s)", "gyro_z": "Gyro Z (°/s)",
    "accel_x": "Accel X (g)", "accel_y": "Accel Y (g)", "accel_z": "Accel Z (g)",
}
METRICS = list(METRIC_UNITS)

# Columns that must be numeric.
MUST_BE_NUMERIC = ["latitude", "longitude", *METRICS]

# Allowed range of each metric, both ends included.
VALUE_RANGES = {
    "battery_pct": (0, 100), "temperature_c": (-50, 150), "altitude_km": (200, 2000),
    "velocity_kms": (6.5, 8.5), "solar_voltage_v": (0, 50), "current_a": (0, 100),
    "cpu_usage_pct": (0, 100), "memory_usage_pct": (0, 100), "signal_strength_dbm": (-120, 0),
    "radiation_level": (0, 1000),
    "gyro_x": (-500, 500), "gyro_y": (-500, 500), "gyro_z": (-500, 500),
    "accel_x": (-20, 20), "accel_y": (-20, 20), "accel_z": (-20, 20),
}

# Alert limits of the quality report, in percent.
MAX_MISSING_PCT = 10.0
MAX_DUPLICATE_PCT = 5.0

# Weight of each metric in the overall health score (sum 100).
HEALTH_WEIGHTS = {
    "battery_pct": 25, "temperature_c": 15, "signal_strength_dbm": 15, "solar_voltage_v": 10,
    "cpu_usage_pct": 10, "memory_usage_pct": 10, "radiation_level": 10, "sensor_status": 5,
}
HEALTH_UNITS = {
    "battery_pct": "%", "temperature_c": "C", "signal_strength_dbm": "dBm", "solar_voltage_v": "V",
    "cpu_usage_pct": "%", "memory_usage_pct": "%", "radiation_level": "rad", "sensor_status": "%",
}

# Lowest score of each health band with its name, colour and sign.
HEALTH_BANDS = [
    (90, "Excellent", "#00CC96", "🟢"),
    (70, "Good", "#636EFA", "🔵"),
    (40, "Warning", "#FFA15A", "🟠"),
    (None, "Critical", "#EF553B", "🔴"),
]

# Thresholds of the anomaly rules and settings of the isolation forest.
TEMPERATURE_SPIKE_STD = 3.0
BATTERY_DROP = -2.0
SIGNAL_LOSS = -15.0
CPU_OVERLOAD = 95.0
MEMORY_OVERLOAD = 95.0
ROLLING_READINGS = 20
FOREST_CONTAMINATION = 0.05
FOREST_TREES = 100
FOREST_SEED = 42
FOREST_SAMPLE = 256
FOREST_FEATURES = [
    "battery_pct", "temperature_c", "solar_voltage_v", "current_a", "cpu_usage_pct",
    "memory_usage_pct", "signal_strength_dbm", "radiation_level",
    "gyro_x", "gyro_y", "gyro_z", "accel_x", "accel_y", "accel_z",
]

# Names of the event types, part of the summaries' format.
ANOMALY_LABELS = {
    "temperature_spike": "temperature spikes", "battery_drop": "rapid battery drops",
    "signal_loss": "signal degradation events", "cpu_overload": "CPU overload events",
    "memory_overload": "memory overload events",
}

# Column choices of the analyses.
RELATIONSHIP_PAIRS = [
    ("battery_pct", "temperature_c", "Battery vs Temperature"),
    ("battery_pct", "signal_strength_dbm", "Battery vs Signal"),
    ("altitude_km", "temperature_c", "Altitude vs Temperature"),
    ("solar_voltage_v", "battery_pct", "Solar Power vs Battery"),
    ("cpu_usage_pct", "temperature_c", "CPU vs Temperature"),
    ("signal_strength_dbm", "altitude_km", "Signal vs Altitude"),
    ("radiation_level", "altitude_km", "Radiation vs Altitude"),
]
TREND_METRICS = [
    "battery_pct", "temperature_c", "signal_strength_dbm", "altitude_km", "cpu_usage_pct",
    "solar_voltage_v", "radiation_level",
]
DISTRIBUTION_METRICS = ["battery_pct", "temperature_c", "signal_strength_dbm", "altitude_km"]

# Limits of the live ingest.
FLUSH_MILLISECONDS = 500
TAP_RECORDS = 50
DEFAULT_SOURCE = "realtime"

# Ours: seconds for which a stream knows the keys that came, and batches after which the store merges.
DEDUP_SECONDS = 600
MERGE_EVERY = 25

EARTH_RADIUS_KM = 6371.0
DEFAULT_ALTITUDE_KM = 400.0
