"""Declared schemas of the five stored tables and of the two small side tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
_TEXT, _TIME = T.StringType(), T.TimestampType()

TELEMETRY = _schema(
    id=_LONG, satellite_id=_TEXT, timestamp=_TIME, latitude=_DOUBLE, longitude=_DOUBLE,
    altitude_km=_DOUBLE, velocity_kms=_DOUBLE, orbit_number=_INT, battery_pct=_DOUBLE,
    solar_voltage_v=_DOUBLE, current_a=_DOUBLE, temperature_c=_DOUBLE, cpu_usage_pct=_DOUBLE,
    memory_usage_pct=_DOUBLE, signal_strength_dbm=_DOUBLE, radiation_level=_DOUBLE,
    gyro_x=_DOUBLE, gyro_y=_DOUBLE, gyro_z=_DOUBLE, accel_x=_DOUBLE, accel_y=_DOUBLE,
    accel_z=_DOUBLE, sensor_status=_INT, comm_status=_INT, mission_status=_TEXT,
    data_source=_TEXT, ingested_at=_TIME,
)

SATELLITES = _schema(
    satellite_id=_TEXT, name=_TEXT, mission_type=_TEXT, launch_date=_TIME, orbit_type=_TEXT,
    status=_TEXT, created_at=_TIME,
)

HEALTH_RECORDS = _schema(
    id=_LONG, satellite_id=_TEXT, timestamp=_TIME, health_score=_DOUBLE, battery_score=_DOUBLE,
    temperature_score=_DOUBLE, signal_score=_DOUBLE, cpu_score=_DOUBLE, memory_score=_DOUBLE,
    radiation_score=_DOUBLE, solar_power_score=_DOUBLE, sensor_score=_DOUBLE,
    overall_status=_TEXT,
)

ANOMALY_RECORDS = _schema(
    id=_LONG, satellite_id=_TEXT, timestamp=_TIME, anomaly_type=_TEXT, severity=_TEXT,
    description=_TEXT, affected_metric=_TEXT, metric_value=_DOUBLE, expected_range=_TEXT,
    detected_at=_TIME,
)

VALIDATION_REPORTS = _schema(
    id=_LONG, satellite_id=_TEXT, timestamp=_TIME, quality_score=_DOUBLE, missing_count=_INT,
    duplicate_count=_INT, invalid_count=_INT, issues=T.ArrayType(_TEXT), created_at=_TIME,
)

TABLES = {
    "satellites": SATELLITES, "telemetry": TELEMETRY, "health_records": HEALTH_RECORDS,
    "anomaly_records": ANOMALY_RECORDS, "validation_reports": VALIDATION_REPORTS,
}

REGISTRY_FILE = _schema(
    satellite_id=_TEXT, name=_TEXT, mission_type=_TEXT, orbit_type=_TEXT, status=_TEXT,
    altitude_km=_DOUBLE, launch_date=_TEXT, description=_TEXT, registered_at=_TEXT,
    updated_at=_TEXT,
)

SCENARIO_WINDOWS = _schema(
    satellite_id=_TEXT, type=_TEXT, start_index=_INT, duration=_INT, severity=_DOUBLE,
)


def live_schema() -> T.StructType:
    """A live record: telemetry without id, its timestamp still text."""
    fields = [f for f in TELEMETRY.fields if f.name != "id"]
    return T.StructType(
        [T.StructField(f.name, _TEXT if f.dataType == _TIME else f.dataType, True) for f in fields]
    )


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def table_schemas(spark: SparkSession) -> DataFrame:
    """One row per declared column: table, position, column, type."""
    rows = [
        (table, position, field.name, field.dataType.simpleString())
        for table, schema in TABLES.items()
        for position, field in enumerate(schema.fields)
    ]
    return spark.createDataFrame(
        rows, "table_name string, position int, column_name string, column_type string"
    )
