"""Times the headline queries and prints one JSON line.

Each query is run once to warm up and then BENCH_RUNS times; its median counts. The derived
telemetry table is written once before, so that a query is timed from its scan on.
"""

from __future__ import annotations

import json
import os
import statistics as stat
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pyspark

from checks.catalog import Tables
from fleetgauge import constants as C
from fleetgauge.operators import anomaly, charts, cleaning, forest, health, relations, select, series
from fleetgauge.operators import statistics, validation, windows
from fleetgauge.operators.ordering import fill_forward_backward, reading_index
from fleetgauge.plans import explain, reports
from fleetgauge.session import build_session, shared_folder

HEADLINE = {
    "fleet_overview": lambda t, s: health.fleet_overview(s, t),
    "metric_health": lambda t, s: health.metric_health(t),
    "batch_health": lambda t, s: health.batch_health(t),
    "column_statistics": lambda t, s: statistics.column_statistics(t),
    "statistics_summary": lambda t, s: statistics.statistics_summary(t),
    "correlation_matrix": lambda t, s: relations.correlation_matrix(t),
    "relationships": lambda t, s: relations.relationships(t),
    "trend": lambda t, s: series.trend(t),
    "rate_of_change": lambda t, s: series.rate_of_change(t),
    "centered_moving_average": lambda t, s: series.centered_moving_average(t),
    "distribution_analysis": lambda t, s: statistics.distribution_analysis(t),
    "detect_statistical": lambda t, s: anomaly.detect_statistical(t),
    "anomaly_summary": lambda t, s: anomaly.anomaly_summary(t),
    "rolling_mean": lambda t, s: windows.rolling_mean(t, ["temperature_c", "signal_strength_dbm"]),
    "rolling_mean_sliced": lambda t, s: windows.rolling_mean(t, ["temperature_c"], split=True),
    "reading_index": lambda t, s: reading_index(t),
    "fill_forward_backward": lambda t, s: fill_forward_backward(t, list(C.HEALTH_WEIGHTS)[:4]),
    "clean": lambda t, s: cleaning.clean(t),
    "validate": lambda t, s: validation.validate(t),
    "latest_readings": lambda t, s: select.latest_readings(t),
    "histogram": lambda t, s: charts.histogram(t, "radiation_level"),
    "box_stats": lambda t, s: charts.box_stats(t, C.DISTRIBUTION_METRICS),
    "isolation_forest_score": lambda t, s: forest.isolation_forest_score(t),
    "explain_student": lambda t, s: explain.explain(reports.explain_inputs(t), "student"),
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = sys.argv[1:] or list(HEADLINE)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    source = Tables(spark, folder)
    path = shared_folder(spark)
    source.telemetry.write.parquet(path)
    telemetry = spark.read.schema(source.telemetry.schema).parquet(path)
    seconds = {}
    for name in wanted:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            HEADLINE[name](telemetry, source.satellites).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(stat.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline query time, median after warm-up", "value": round(sum(seconds.values()), 3),
                "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
                "cpus": int(cpus), "spark": pyspark.__version__,
            }
        )
    )


if __name__ == "__main__":
    main()
