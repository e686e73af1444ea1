"""Statistics, correlation, trends, quality profiles and chart data."""

from pyspark.sql import functions as F

from checks.catalog import Tables, query
from checks.sql_parts import ALL_METRICS, SHAPE_METRICS, STATISTICS, TREND_METRICS, health, melted
from checks.tables import SUMMARY_SQL
from fleetgauge import constants as C
from fleetgauge.operators import charts, health as fleet, relations, series, statistics, validation


@query(
    "column_statistics",
    f"""WITH {STATISTICS}, v_counts AS (
  SELECT satellite_id, metric, value, count(*) AS n FROM vals WHERE value IS NOT NULL GROUP BY ALL
), v_mode AS (
  SELECT satellite_id, metric, value AS mode,
    row_number() OVER (PARTITION BY satellite_id, metric ORDER BY n DESC, value) AS place FROM v_counts)
FINALLY
SELECT satellite_id, metric, avg(value) AS mean, quantile_cont(value, 0.5) AS median, any_value(mode) AS mode,
  min(value) AS min, max(value) AS max, max(value) - min(value) AS range_value, var_samp(value) AS variance,
  stddev_samp(value) AS std_dev, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
  quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95,
  quantile_cont(value, 0.99) AS p99, any_value(CASE WHEN m2 > 0 THEN m3 / pow(m2, 15E-1) END) AS skewness,
  any_value(CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 END) AS kurtosis, count(value) AS count,
  count(*) - count(value) AS missing, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
FROM vals JOIN v_moments USING (satellite_id, metric)
JOIN (SELECT * FROM v_mode WHERE place = 1) AS modes USING (satellite_id, metric)
GROUP BY satellite_id, metric""",
    doubles="mean median mode min max range_value variance std_dev p25 p50 p75 p90 p95 p99 skewness kurtosis iqr",
)
def _(t: Tables):
    return statistics.column_statistics(t.telemetry)


@query("statistics_summary", SUMMARY_SQL, doubles="mean std min max")
def _(t: Tables):
    return statistics.statistics_summary(t.telemetry)


CORRELATION = f"""WITH {melted(ALL_METRICS, 'satellite_id, id')}, pairs AS (
  SELECT a.satellite_id, a.metric AS col_x, b.metric AS col_y,
    covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0) AS r
  FROM vals a JOIN vals b ON a.satellite_id = b.satellite_id AND a.id = b.id AND a.metric <> b.metric
  WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL)
FINALLY
SELECT satellite_id, col_x, col_y, r FROM pairs WHERE r IS NOT NULL
UNION ALL SELECT satellite_id, metric, metric, 1E0 FROM vals GROUP BY satellite_id, metric HAVING count(value) > 1"""


@query("correlation_matrix", CORRELATION, doubles="r")
def _(t: Tables):
    return relations.correlation_matrix(t.telemetry)


_PAIR_SQL = "\n  UNION ALL ".join(
    f"""SELECT satellite_id, {i} AS pair, '{name}' AS name, covar_pop({x}, {y})
    / nullif(stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END), 0) AS r,
    count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) AS n FROM telemetry GROUP BY satellite_id"""
    for i, (x, y, name) in enumerate(C.RELATIONSHIP_PAIRS)
)
RELATED = f"""WITH pairs AS ({_PAIR_SQL}), related AS (
  SELECT satellite_id, pair, name, round(r, 4) AS correlation,
    CASE WHEN abs(r) >= 8E-1 THEN 'very strong' WHEN abs(r) >= 6E-1 THEN 'strong' WHEN abs(r) >= 4E-1 THEN 'moderate'
         WHEN abs(r) >= 2E-1 THEN 'weak' ELSE 'very weak' END AS strength,
    CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
  FROM pairs WHERE r IS NOT NULL AND n > 2)
FINALLY
"""


@query(
    "relationships", RELATED + "SELECT satellite_id, name, correlation, strength, direction FROM related",
    doubles="correlation",
)
def _(t: Tables):
    related = relations.relationships(t.telemetry)
    return related.select("satellite_id", "name", "correlation", "strength", "direction")


# p is the share of sin(t)^(n - 3) that lies below acos(abs(r)), of what lies below pi / 2; both by Simpson's rule.
_STEPS = 4000
_SIMPSON = "sum((CASE WHEN k = 0 OR k = {0} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(sin({1} * k / {0}), n - 3)) * {1}"


@query(
    "relationship_p_values",
    RELATED.replace("\nFINALLY\n", f"""), tails AS (
  SELECT satellite_id, pair, {_SIMPSON.format(_STEPS, "acos(least(1E0, abs(r)))")} / ({_SIMPSON.format(_STEPS, "(pi() / 2)")}) AS p
  FROM pairs, generate_series(0, {_STEPS}) AS s(k) WHERE r IS NOT NULL AND n > 2 GROUP BY satellite_id, pair, r, n)
FINALLY
""".removeprefix(")")) + "SELECT satellite_id, name, correlation, p AS p_value FROM related JOIN tails USING (satellite_id, pair)",
    doubles="correlation p_value",
)
def _(t: Tables):
    return relations.relationships(t.telemetry).select("satellite_id", "name", "correlation", "p_value")


@query(
    "rank_relationships",
    RELATED + """SELECT * FROM (SELECT satellite_id, name, correlation,
  row_number() OVER (PARTITION BY satellite_id ORDER BY abs(correlation) DESC, pair) AS rank FROM related) WHERE rank <= 5""",
    doubles="correlation",
)
def _(t: Tables):
    ranked = relations.rank_relationships(relations.relationships(t.telemetry), top=5)
    return ranked.select("satellite_id", "name", "correlation", "rank")


SERIES = f"""{melted(TREND_METRICS, 'satellite_id, timestamp, id')}, line AS (
  SELECT satellite_id, metric, timestamp, id, value,
    row_number() OVER (PARTITION BY satellite_id, metric ORDER BY timestamp, id) - 1 AS i,
    count(*) OVER (PARTITION BY satellite_id, metric) AS n,
    lag(value) OVER (PARTITION BY satellite_id, metric ORDER BY timestamp, id) AS before
  FROM vals WHERE value IS NOT NULL
), trends AS (
  SELECT satellite_id, metric, regr_slope(value, i) AS slope, regr_intercept(value, i) AS intercept
  FROM line WHERE n >= 10 GROUP BY ALL
), rates AS (
  SELECT satellite_id, metric, round(avg(c), 4) AS mean_roc_pct, round(max(c), 4) AS max_increase_pct,
    round(min(c), 4) AS max_decrease_pct, round(stddev_samp(c), 4) AS volatility
  FROM (SELECT *, (value - before) / nullif(abs(before), 0) * 100 AS c FROM line) WHERE n >= 10 GROUP BY ALL
), widths AS (
  SELECT *, CAST(greatest(5, n // 20) AS INT) AS width FROM line WHERE n >= 10
), averages AS (
  SELECT a.satellite_id, a.metric, a.timestamp, a.id, a.value, a.width,
    CASE WHEN count(b.value) = a.width THEN avg(b.value) END AS average
  FROM widths a JOIN line b ON a.satellite_id = b.satellite_id AND a.metric = b.metric
    AND b.i BETWEEN a.i - a.width // 2 AND a.i + (a.width - 1) // 2
  GROUP BY a.satellite_id, a.metric, a.timestamp, a.id, a.value, a.width
)"""


DIRECTION = "CASE WHEN slope > 1E-2 THEN 'increasing' WHEN slope < -1E-2 THEN 'decreasing' ELSE 'stable' END"


@query(
    "trend",
    f"""WITH {SERIES}
FINALLY
SELECT satellite_id, metric, slope, intercept, {DIRECTION} AS direction, abs(slope) AS magnitude,
  round(slope, 6) AS unit_per_sample FROM trends""",
    doubles="slope intercept magnitude unit_per_sample",
)
def _(t: Tables):
    return series.trend(t.telemetry)


@query(
    "rate_of_change", f"WITH {SERIES}\nFINALLY\nSELECT * FROM rates",
    doubles="mean_roc_pct max_increase_pct max_decrease_pct volatility",
)
def _(t: Tables):
    return series.rate_of_change(t.telemetry)


@query(
    "centered_moving_average", f"WITH {SERIES}\nFINALLY\nSELECT * FROM averages", doubles="value average",
)
def _(t: Tables):
    return series.centered_moving_average(t.telemetry)


@query(
    "time_series_analysis",
    f"""WITH {SERIES}, smooth AS (SELECT satellite_id, metric, max(width) AS moving_average_width,
  count(average) AS moving_average_points, min(average) AS moving_average_min, max(average) AS moving_average_max
  FROM averages WHERE average IS NOT NULL GROUP BY ALL)
FINALLY
SELECT satellite_id, metric, slope, intercept, {DIRECTION} AS direction, abs(slope) AS magnitude,
  round(slope, 6) AS unit_per_sample, mean_roc_pct, max_increase_pct, max_decrease_pct, volatility,
  moving_average_width, moving_average_points, moving_average_min, moving_average_max
FROM trends JOIN rates USING (satellite_id, metric) LEFT JOIN smooth USING (satellite_id, metric)""",
    doubles="slope intercept magnitude unit_per_sample mean_roc_pct max_increase_pct max_decrease_pct volatility "
            "moving_average_min moving_average_max",
)
def _(t: Tables):
    return series.time_series_analysis(t.telemetry)


SHAPES = f"""{STATISTICS}, d_shape AS (
  SELECT satellite_id, metric, CAST(n AS DOUBLE) AS n, CASE WHEN m2 > 0 THEN m3 / pow(m2, 15E-1) END AS skewness,
    CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 END AS kurtosis FROM v_moments
  WHERE n >= 10 AND metric IN ('battery_pct', 'temperature_c', 'signal_strength_dbm', 'altitude_km')
), d_one AS (
  SELECT *, skewness * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
    sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
    3 * (n - 1) / (n + 1) AS e, 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS v,
    6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS q FROM d_shape
), d_two AS (
  SELECT *, y / sqrt(2 / (w2 - 1)) AS ya, (kurtosis + 3 - e) / sqrt(v) AS x,
    6 + (8 / q) * (2 / q + sqrt(1 + 4 / (q * q))) AS a FROM d_one
), d_three AS (
  SELECT *, ln(ya + sqrt(ya * ya + 1)) / sqrt(ln(w2) / 2) AS z1, 1 + x * sqrt(2 / (a - 4)) AS den FROM d_two
), d_four AS (
  SELECT *, (1 - 2 / (9 * a) - sign(den) * cbrt((1 - 2 / a) / nullif(abs(den), 0))) / sqrt(2 / (9 * a)) AS z2 FROM d_three)"""
SHAPE_NAME = """CASE WHEN skewness IS NULL THEN NULL WHEN abs(skewness) < 5E-1 THEN 'symmetric' WHEN skewness > 1 THEN 'right-skewed'
    WHEN skewness > 0 THEN 'slightly right-skewed' WHEN skewness < -1 THEN 'left-skewed'
    ELSE 'slightly left-skewed' END"""


@query(
    "distribution_analysis",
    f"""WITH {SHAPES}
FINALLY
SELECT satellite_id, metric, exp(-(z1 * z1 + z2 * z2) / 2) > 5E-2 AS is_normal,
  exp(-(z1 * z1 + z2 * z2) / 2) AS normality_p_value, skewness, kurtosis,
  {SHAPE_NAME} AS distribution_type FROM d_four""",
    doubles="normality_p_value skewness kurtosis",
)
def _(t: Tables):
    return statistics.distribution_analysis(t.telemetry)


DIRTY_COLUMNS = ["id", "satellite_id", "timestamp", "battery_pct", "temperature_c", "signal_strength_dbm", "mission_status"]
_MISSING = " UNION ALL ".join(
    f"SELECT satellite_id, count(*) AS total_records, '{c}' AS column_name, count(*) - count({c}) AS missing_count "
    "FROM telemetry_dirty GROUP BY 1"
    for c in DIRTY_COLUMNS
)


@query(
    "missing_profile",
    f"""SELECT *, round(missing_count * 100E0 / total_records, 2) AS missing_pct,
  round(missing_count * 100E0 / total_records, 2) > 10 AS over_limit FROM ({_MISSING})""",
    doubles="missing_pct",
)
def _(t: Tables):
    return validation.missing_profile(t.dirty)


@query(
    "duplicate_profile",
    """WITH copies AS (SELECT satellite_id, count(*) AS n FROM telemetry_dirty GROUP BY id, satellite_id, timestamp,
  battery_pct, temperature_c, signal_strength_dbm, mission_status), sums AS (
  SELECT satellite_id, CAST(sum(n) AS BIGINT) AS total_records, CAST(sum(n - 1) AS BIGINT) AS duplicate_count
  FROM copies GROUP BY 1)
FINALLY
SELECT *, round(duplicate_count * 100E0 / total_records, 2) AS duplicate_pct,
  round(duplicate_count * 100E0 / total_records, 2) > 5 AS duplicate_issue FROM sums""",
    doubles="duplicate_pct",
)
def _(t: Tables):
    return validation.duplicate_profile(t.dirty)


@query("missing_columns", """SELECT satellite_id, count(*) AS total_records,
  'latitude,longitude,altitude_km,velocity_kms,orbit_number,solar_voltage_v,current_a,cpu_usage_pct,memory_usage_pct,'
  || 'radiation_level,gyro_x,gyro_y,gyro_z,accel_x,accel_y,accel_z,sensor_status,comm_status' AS missing_columns
FROM telemetry_dirty GROUP BY satellite_id""")
def _(t: Tables):
    profile = validation.quality_profile(t.dirty)
    return profile.select("satellite_id", "total_records", F.array_join("missing_columns", ",").alias("missing_columns"))


@query("dtype_issues", """SELECT satellite_id, count(*) AS total_records,
  'Column ''battery_pct'' is not numeric' AS dtype_issues FROM telemetry_dirty GROUP BY satellite_id""")
def _(t: Tables):
    texts = t.dirty.withColumn("battery_pct", F.col("battery_pct").cast("string"))
    profile = validation.quality_profile(texts)
    return profile.select("satellite_id", "total_records", F.array_join("dtype_issues", ",").alias("dtype_issues"))


_LIMITS = [
    ("battery_pct", "0", "100"), ("temperature_c", "-50", "150"), ("altitude_km", "200", "2000"),
    ("velocity_kms", "6.5", "8.5"), ("solar_voltage_v", "0", "50"), ("current_a", "0", "100"),
    ("cpu_usage_pct", "0", "100"), ("memory_usage_pct", "0", "100"), ("signal_strength_dbm", "-120", "0"),
    ("radiation_level", "0", "1000"), ("gyro_x", "-500", "500"), ("gyro_y", "-500", "500"), ("gyro_z", "-500", "500"),
    ("accel_x", "-20", "20"), ("accel_y", "-20", "20"), ("accel_z", "-20", "20"),
]
VIOLATIONS = " UNION ALL ".join(
    f"""SELECT satellite_id, {i} AS place, '{c}' AS metric,
  count(CASE WHEN {c} < {low} OR {c} > {high} THEN 1 END) AS violations, '[{low}, {high}]' AS expected,
  printf('[%.2f, %.2f]', round(min({c}), 2), round(max({c}), 2)) AS actual_range FROM telemetry GROUP BY satellite_id"""
    for i, (c, low, high) in enumerate(_LIMITS)
)


@query(
    "range_violations",
    f"SELECT * EXCLUDE (place) FROM ({VIOLATIONS}) WHERE violations > 0",
)
def _(t: Tables):
    return validation.range_violations(t.telemetry)


def _time_issues(source: str) -> str:
    return f"""t_rows AS (
  SELECT satellite_id, id, timestamp AS text, TRY_CAST(timestamp AS TIMESTAMP) AS ts FROM {source}
), t_gaps AS (
  SELECT satellite_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY satellite_id ORDER BY ts, id)) / 1E6 AS gap
  FROM t_rows WHERE ts IS NOT NULL
), t_median AS (SELECT satellite_id, quantile_cont(gap, 0.5) AS median_gap FROM t_gaps GROUP BY 1
), t_wide AS (
  SELECT satellite_id, any_value(median_gap) AS median_gap_seconds, count(CASE WHEN gap > 5 * median_gap THEN 1 END) AS large_gaps
  FROM t_gaps JOIN t_median USING (satellite_id) WHERE gap IS NOT NULL GROUP BY 1
), t_counts AS (
  SELECT satellite_id, count(CASE WHEN text IS NOT NULL AND ts IS NULL THEN 1 END) AS unparseable_timestamps,
    count(ts) - count(DISTINCT ts) AS duplicate_timestamps FROM t_rows GROUP BY 1
), t_issues AS (
  SELECT satellite_id, unparseable_timestamps, duplicate_timestamps, median_gap_seconds, coalesce(large_gaps, 0) AS large_gaps,
    (unparseable_timestamps > 0)::INT + (duplicate_timestamps > 0)::INT + (coalesce(large_gaps, 0) > 0)::INT AS issue_kinds
  FROM t_counts LEFT JOIN t_wide USING (satellite_id))"""


@query(
    "timestamp_issues", f"WITH {_time_issues('telemetry_dirty')}\nFINALLY\nSELECT * FROM t_issues",
    doubles="median_gap_seconds", digits=4,
)
def _(t: Tables):
    return validation.timestamp_issues(t.dirty)


_ALL_COLUMNS = (
    "id, satellite_id, timestamp, latitude, longitude, altitude_km, velocity_kms, orbit_number, battery_pct, "
    "solar_voltage_v, current_a, temperature_c, cpu_usage_pct, memory_usage_pct, signal_strength_dbm, radiation_level, "
    "gyro_x, gyro_y, gyro_z, accel_x, accel_y, accel_z, sensor_status, comm_status, mission_status, data_source"
)
_NULLS = " + ".join(f"count(*) - count({c})" for c in _ALL_COLUMNS.split(", "))
REPORT = f"""WITH {_time_issues('telemetry')}, violations AS ({VIOLATIONS}), q_ranges AS (
  SELECT satellite_id, CAST(sum(violations) AS BIGINT) AS range_violation_count,
    sum(least(10E0, violations * 1E-1)) AS deduction,
    string_agg('Range violation in ' || metric || ': ' || violations || ' values outside ' || expected, ' | ' ORDER BY place)
      FILTER (violations > 0) AS texts
  FROM violations GROUP BY 1
), q_copies AS (
  SELECT satellite_id, CAST(sum(n - 1) AS BIGINT) AS duplicate_count
  FROM (SELECT satellite_id, count(*) AS n FROM telemetry GROUP BY {_ALL_COLUMNS}) GROUP BY 1
), q_counts AS (
  SELECT satellite_id, count(*) AS total_records, {_NULLS} AS missing_total FROM telemetry GROUP BY 1
), q_all AS (
  SELECT *, round(missing_total / CAST(total_records * 26 AS DOUBLE) * 100, 2) AS missing_pct_total,
    round(duplicate_count / CAST(total_records AS DOUBLE) * 100, 2) AS duplicate_pct
  FROM q_counts JOIN q_copies USING (satellite_id) JOIN q_ranges USING (satellite_id) JOIN t_issues USING (satellite_id)
), report AS (
  SELECT *, least(30E0, missing_pct_total) + least(20E0, duplicate_pct * 2) + deduction + issue_kinds * 5 AS lost FROM q_all)
FINALLY
"""
_SCORES = "round(lost, 1) AS deductions, round(greatest(0E0, 100 - lost), 1) AS quality_score"


@query(
    "quality_score",
    REPORT + f"SELECT satellite_id, missing_pct_total, duplicate_pct, {_SCORES} FROM report",
    doubles="missing_pct_total duplicate_pct deductions quality_score",
)
def _(t: Tables):
    scored = validation.quality_score(validation.quality_profile(t.telemetry))
    return scored.select("satellite_id", "missing_pct_total", "duplicate_pct", "deductions", "quality_score")


@query(
    "validate",
    REPORT + f"""SELECT satellite_id, total_records, 26 AS total_columns, missing_total, missing_pct_total, duplicate_count,
  duplicate_pct, duplicate_pct > 5 AS duplicate_issue, range_violation_count, unparseable_timestamps,
  duplicate_timestamps, large_gaps, {_SCORES},
  concat_ws(' | ', texts, CASE WHEN duplicate_timestamps > 0 THEN duplicate_timestamps || ' duplicate timestamps found' END,
    CASE WHEN large_gaps > 0 THEN large_gaps || ' unusually large timestamp gaps detected' END) AS issues FROM report""",
    doubles="missing_pct_total duplicate_pct deductions quality_score",
)
def _(t: Tables):
    report = validation.validate(t.telemetry)
    return report.select(
        "satellite_id", "total_records", "total_columns", "missing_total", "missing_pct_total", "duplicate_count",
        "duplicate_pct", "duplicate_issue", "range_violation_count", "unparseable_timestamps",
        "duplicate_timestamps", "large_gaps", "deductions", "quality_score",
        F.array_join("issues", " | ").alias("issues"),
    )


@query(
    "satellite_comparison",
    """SELECT satellite_id, avg(battery_pct) AS mean, printf('%.1f', round(avg(battery_pct), 1)) AS label
FROM telemetry GROUP BY satellite_id""",
    doubles="mean",
)
def _(t: Tables):
    return charts.satellite_comparison(t.telemetry, "battery_pct")


@query(
    "grouped_metric_means",
    "SELECT satellite_id, avg(battery_pct) AS battery_pct, avg(cpu_usage_pct) AS cpu_usage_pct, "
    "avg(memory_usage_pct) AS memory_usage_pct FROM telemetry GROUP BY satellite_id",
    doubles="battery_pct cpu_usage_pct memory_usage_pct",
)
def _(t: Tables):
    return charts.grouped_metric_means(t.telemetry, ["battery_pct", "cpu_usage_pct", "memory_usage_pct"])


@query(
    "histogram",
    """WITH ends AS (SELECT satellite_id, min(radiation_level) AS lo, max(radiation_level) AS hi FROM telemetry GROUP BY 1),
placed AS (SELECT satellite_id, lo, hi,
  CAST(least(floor(coalesce((radiation_level - lo) * 30 / nullif(hi - lo, 0), 0)), 29) AS INT) AS bin
  FROM telemetry JOIN ends USING (satellite_id) WHERE radiation_level IS NOT NULL)
FINALLY
SELECT satellite_id, bin, lo + (hi - lo) / 30 * bin AS bin_from, lo + (hi - lo) / 30 * (bin + 1) AS bin_to, count(*) AS readings
FROM placed GROUP BY satellite_id, bin, lo, hi""",
    doubles="bin_from bin_to",
)
def _(t: Tables):
    return charts.histogram(t.telemetry, "radiation_level")


@query(
    "box_stats",
    f"""WITH {melted(SHAPE_METRICS)}, quarters AS (
  SELECT satellite_id, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
    quantile_cont(value, 0.75) AS q3, avg(value) AS mean FROM vals GROUP BY ALL
), inside AS (SELECT *, value BETWEEN q1 - (q3 - q1) * 15E-1 AND q3 + (q3 - q1) * 15E-1 AS near
  FROM vals JOIN quarters USING (satellite_id, metric) WHERE value IS NOT NULL)
FINALLY
SELECT satellite_id, metric, q1, median, q3, min(CASE WHEN near THEN value END) AS lower_fence,
  max(CASE WHEN near THEN value END) AS upper_fence, count(CASE WHEN NOT near THEN 1 END) AS outliers, any_value(mean) AS mean
FROM inside GROUP BY satellite_id, metric, q1, median, q3""",
    doubles="q1 median q3 lower_fence upper_fence mean",
)
def _(t: Tables):
    return charts.box_stats(t.telemetry, C.DISTRIBUTION_METRICS)


@query(
    "category_values",
    f"""WITH {health()}
FINALLY
SELECT satellite_id AS category, health_score AS value, printf('%.1f', health_score) AS label FROM health""",
    doubles="value",
)
def _(t: Tables):
    return charts.category_values(fleet.overall_health(t.telemetry), "satellite_id", "health_score")


@query(
    "radar_values",
    """WITH means AS (SELECT satellite_id, coalesce(avg(battery_pct), 0) AS b, coalesce(avg(cpu_usage_pct), 0) AS c,
  coalesce(avg(memory_usage_pct), 0) AS m FROM telemetry GROUP BY 1)
FINALLY
SELECT satellite_id, unnest([0, 1, 2, 3, 4]) AS place, unnest(['battery_pct', 'cpu_usage_pct', 'memory_usage_pct',
  'not_a_metric', 'battery_pct']) AS axis, unnest([b, c, m, 0E0, b]) AS value FROM means""",
    doubles="value",
)
def _(t: Tables):
    axes = charts.radar_values(t.telemetry, ["battery_pct", "cpu_usage_pct", "memory_usage_pct", "not_a_metric"])
    pairs = F.arrays_zip(F.col("axes").alias("axis"), F.col("values").alias("value"))
    rows = axes.select("satellite_id", F.posexplode(pairs).alias("place", "p"))
    return rows.select("satellite_id", "place", F.col("p.axis"), F.col("p.value"))
