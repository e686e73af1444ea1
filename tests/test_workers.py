"""Python workers need nothing of this repository installed."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from fleetgauge.session import build_session
from fleetgauge.operators.forest import ForestSettings, isolation_forest_score
from fleetgauge.operators.relations import relationships
spark = build_session("elsewhere", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
df = spark.range(60).selectExpr("id % 50 AS id", "'a' AS satellite_id", "double(id) AS battery_pct", "double(id % 7) AS temperature_c")
scored = isolation_forest_score(df, settings=ForestSettings(trees=3))
print("rows", scored.count(), relationships(df).where("p_value IS NOT NULL").count())
"""


def test_from_another_folder(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 60 1" in done.stdout, done.stderr[-2000:]
