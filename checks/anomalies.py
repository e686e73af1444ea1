"""Anomaly rules, summaries and the isolation forest."""

from pyspark.sql import functions as F

from checks.catalog import Tables, query
from checks.sql_parts import EVENTS
from fleetgauge import constants as C
from fleetgauge.operators import anomaly, forest
from fleetgauge.operators.grouping import KEYS

COLUMNS = "satellite_id, timestamp, id, type, metric, value, unit, severity"


def _events(name: str, where: str = ""):
    return f"WITH {EVENTS}\nFINALLY\nSELECT {COLUMNS} FROM events_found {where}"


def _shown(events):
    return events.select(*COLUMNS.split(", "))


for _rule in anomaly.RULES:
    @query(f"detect_{_rule.kind}", _events(_rule.kind, f"WHERE type = '{_rule.kind}'"), digits=None)
    def _(t: Tables, rule=_rule):
        return _shown(anomaly.detect(t.telemetry, rule))


@query("detect_statistical", _events("all"), digits=None)
def _(t: Tables):
    return _shown(anomaly.detect_statistical(t.telemetry))


@query("classify_anomalies", _events("all"), digits=None)
def _(t: Tables):
    return _shown(anomaly.classify_anomalies(t.telemetry))


@query(
    "anomaly_counts",
    f"WITH {EVENTS}\nFINALLY\nSELECT satellite_id, type, count(*) AS events FROM events_found GROUP BY satellite_id, type",
)
def _(t: Tables):
    return anomaly.anomaly_counts(anomaly.detect_statistical(t.telemetry)).drop("rule")


SUMMARY = f"""{EVENTS}, s_types AS (SELECT satellite_id, rule, count(*) AS n, count(*) || ' ' || CASE rule
    WHEN 0 THEN 'temperature spikes' WHEN 1 THEN 'rapid battery drops' WHEN 2 THEN 'signal degradation events'
    WHEN 3 THEN 'CPU overload events' ELSE 'memory overload events' END AS text FROM events_found GROUP BY satellite_id, rule
), s_all AS (SELECT satellite_id, CAST(sum(n) AS BIGINT) AS total,
    'Detected: ' || string_agg(text, ', ' ORDER BY rule) || '.' AS sentence FROM s_types GROUP BY satellite_id
), summaries AS (
  SELECT satellite_id, coalesce(total, 0) AS total_anomalies, CASE WHEN total > 20 THEN 'Critical' WHEN total > 10 THEN 'High'
    WHEN total > 5 THEN 'Medium' ELSE 'Low' END AS severity, coalesce(sentence, 'No anomalies detected.') AS summary
  FROM (SELECT DISTINCT satellite_id FROM telemetry) LEFT JOIN s_all USING (satellite_id))"""


@query(
    "anomaly_summary",
    f"""WITH {SUMMARY}, shares AS (SELECT satellite_id, round(ceil((count(*) - 1) * 5E-2) / count(*) * 100, 2) AS ml_anomaly_pct
  FROM telemetry GROUP BY satellite_id)
FINALLY
SELECT * FROM summaries JOIN shares USING (satellite_id)""",
    doubles="ml_anomaly_pct",
)
def _(t: Tables):
    return anomaly.anomaly_summary(t.telemetry, fit=True)


def _prepared(t: Tables):
    features = C.FOREST_FEATURES
    narrow = t.telemetry.select("satellite_id", "id", *features)
    return forest.prepare(narrow, features, keys=KEYS), features


@query(
    "isolation_forest_fit",
    """SELECT satellite_id, CAST(tree AS INTEGER) AS tree, CAST(least(256, n) AS INTEGER) AS sample_size, true AS binary_tree
FROM (SELECT satellite_id, count(*) AS n FROM telemetry GROUP BY satellite_id), range(100) AS r(tree)""",
)
def _(t: Tables):
    """Each satellite has 100 trees over 256 of its readings, or all, with one leaf more than inner nodes."""
    prepared, features = _prepared(t)
    trees = forest.isolation_forest_fit(prepared, features)
    leaves = F.size(F.filter("threshold", lambda t: t == float("inf")))
    return trees.select("satellite_id", "tree", "sample_size", (F.size("feature") == 2 * leaves - 1).alias("binary_tree"))


@query(
    "isolation_forest_rows",
    """SELECT id, satellite_id, count(*) AS rows_ FROM telemetry_dirty GROUP BY ALL""",
)
def _(t: Tables):
    """Rows with repeated ids come out as often as they went in."""
    rows = t.dirty.withColumn("copy", F.col("battery_pct") * 0)
    scored = forest.isolation_forest_score(rows, settings=forest.ForestSettings(trees=5))
    return scored.groupBy("id", "satellite_id").agg(F.count(F.lit(1)).alias("rows_"))


@query("isolation_forest_score")
def _(t: Tables):
    scored = forest.isolation_forest_score(t.telemetry)
    return scored.select("id", "satellite_id", "anomaly_score", "is_anomaly", "anomaly_type")


@query("isolation_forest_score_fleet")
def _(t: Tables):
    scored = forest.isolation_forest_score(t.telemetry, scope="fleet")
    return scored.select("id", "satellite_id", "anomaly_score", "is_anomaly", "anomaly_type")


@query(
    "isolation_forest_share",
    """SELECT satellite_id, count(*) AS readings, CAST(ceil((count(*) - 1) * 5E-2) AS BIGINT) AS flagged
FROM telemetry GROUP BY satellite_id""",
)
def _(t: Tables):
    """Without equal scores the share of flagged rows follows from the number of rows alone."""
    scored = forest.isolation_forest_score(t.telemetry)
    return scored.groupBy("satellite_id").agg(
        F.count(F.lit(1)).alias("readings"), F.count_if("is_anomaly").alias("flagged")
    )
