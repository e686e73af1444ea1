import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.catalog import Tables  # noqa: E402
from fleetgauge.session import build_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture(scope="session")
def stored(spark, tables, tmp_path_factory):
    """The telemetry table as files, so that a plan shows the operator alone."""
    path = str(tmp_path_factory.mktemp("telemetry") / "t")
    tables.telemetry.write.parquet(path)
    return spark.read.schema(tables.telemetry.schema).parquet(path)
