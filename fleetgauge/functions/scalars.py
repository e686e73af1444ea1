"""Small Column helpers shared by the batch and the streaming operators."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge import constants as C


def bands(value: Column, limits: list[tuple[float, str]], otherwise: str, *, strict: bool = False) -> Column:
    """Label of the first limit the value reaches (or exceeds, when strict); null stays null."""
    result = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, label in limits:
        result = result.when(value > limit if strict else value >= limit, F.lit(label))
    return result.otherwise(F.lit(otherwise))


def clamp(value: Column, low: float, high: float) -> Column:
    bounded = F.greatest(F.lit(low).cast("double"), F.least(F.lit(high).cast("double"), value))
    return F.when(value.isNotNull(), bounded)


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def _band_part(score: Column, part: int) -> Column:
    (*upper, last) = C.HEALTH_BANDS
    return bands(score, [(band[0], band[part]) for band in upper], last[part])


def health_category(score: Column) -> Column:
    return _band_part(score, 1)


def health_color(score: Column) -> Column:
    return _band_part(score, 2)


def health_emoji(score: Column) -> Column:
    return _band_part(score, 3)


def format_bytes(size: Column) -> Column:
    units = ["B", "KB", "MB", "GB", "TB"]
    result = None
    for power, unit in enumerate(units):
        scaled = size / float(1024**power)
        text = F.format_string(f"%.2f {unit}", F.round(scaled, 2))
        small = F.abs(scaled) < 1024
        result = F.when(small, text) if result is None else result.when(small, text)
    return result.otherwise(F.format_string("%.2f PB", F.round(size / float(1024**5), 2)))


def iso_time(ts: Column) -> Column:
    """ISO text, with the fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction))


def iso_timestamp(ts: Column) -> Column:
    return F.concat(iso_time(ts), F.lit("Z"))


def correlation_strength(r: Column) -> Column:
    limits = [(0.8, "very strong"), (0.6, "strong"), (0.4, "moderate"), (0.2, "weak")]
    return bands(F.abs(r), limits, "very weak")


def correlation_direction(r: Column) -> Column:
    return bands(r, [(0, "positive")], "negative", strict=True)


def classify_distribution(skew: Column) -> Column:
    return (
        F.when(skew.isNull(), F.lit(None).cast("string"))
        .when(F.abs(skew) < 0.5, "symmetric")
        .when(skew > 1, "right-skewed")
        .when(skew > 0, "slightly right-skewed")
        .when(skew < -1, "left-skewed")
        .otherwise("slightly left-skewed")
    )


def trend_direction(slope: Column) -> Column:
    return (
        F.when(slope.isNull(), F.lit(None).cast("string"))
        .when(slope > 0.01, "increasing")
        .when(slope < -0.01, "decreasing")
        .otherwise("stable")
    )


def _lookup(metric: Column, table: dict[str, str], missing: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, metric), missing)


def unit_of(metric: Column) -> Column:
    return _lookup(metric, C.METRIC_UNITS, F.lit(""))


def label_of(metric: Column) -> Column:
    return _lookup(metric, C.METRIC_LABELS, metric)


def anomaly_label(kind: Column) -> Column:
    return _lookup(kind, C.ANOMALY_LABELS, kind)


def event_severity(value: Column, std: Column) -> Column:
    """High when the plain value exceeds three column deviations; an unknown deviation is Medium."""
    high = F.coalesce(F.abs(value) > std * 3, F.lit(False))
    return F.when(high, "High").otherwise("Medium")


def severity_from_count(count: Column) -> Column:
    return bands(count, [(20, "Critical"), (10, "High"), (5, "Medium")], "Low", strict=True)


def traffic_light(score: Column) -> Column:
    return bands(score, [(70, "Green"), (40, "Orange")], "Red")


def progress_color(value: Column) -> Column:
    return bands(value, [(80, "#00CC96"), (50, "#FFA15A")], "#EF553B")


def gauge_band(value: Column, thresholds: dict[str, float] | None = None) -> Column:
    """Name of the first threshold that is not below the value; above all of them, the last."""
    steps = thresholds or {"red": 40, "orange": 70, "green": 100}
    result = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, top in steps.items():
        result = result.when(value < top, F.lit(name))
    return result.otherwise(F.lit(list(steps)[-1]))


def gauge_delta(value: Column, reference: float = 50) -> Column:
    return value - F.lit(reference)


def ecef(latitude: Column, longitude: Column, altitude_km: Column) -> dict[str, Column]:
    """Cartesian position in km on a spherical Earth."""
    lat, lon = F.radians(latitude), F.radians(longitude)
    r = F.coalesce(altitude_km, F.lit(C.DEFAULT_ALTITUDE_KM)) + F.lit(C.EARTH_RADIUS_KM)
    return {"x": r * F.cos(lat) * F.cos(lon), "y": r * F.cos(lat) * F.sin(lon), "z": r * F.sin(lat)}


def wrap_longitude(degrees: Column) -> Column:
    turned = F.pmod(degrees, F.lit(360.0))
    return F.when(turned > 180, turned - 360).otherwise(turned)


def orbit_number(index: Column, readings_per_orbit: int) -> Column:
    return (F.floor(index / F.lit(readings_per_orbit)) + 1).cast("int")


def comm_status(signal: Column) -> Column:
    return F.when(signal > -100, 1).when(signal.isNotNull(), 0)


def mission_status(battery: Column, sensor: Column, signal: Column) -> Column:
    """Status from scenario strengths (absent = null); a lost signal outranks a degraded part."""
    limited = F.coalesce(signal > 0.5, F.lit(False))
    degraded = F.coalesce(sensor > 0.5, F.lit(False)) | F.coalesce(battery > 0.3, F.lit(False))
    return F.when(limited, "Limited").when(degraded, "Degraded").otherwise("Nominal")


def dedup_key(satellite_id: Column, timestamp: Column) -> Column:
    return F.concat_ws(":", satellite_id, timestamp)
