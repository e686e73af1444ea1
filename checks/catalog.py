"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.session import shared_folder
from fleetgauge.sources import demo
from fleetgauge.sources.tables import scan_telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The four telemetry tables, derived from the given ones when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    @cached_property
    def telemetry(self) -> DataFrame:
        return scan_telemetry(demo.telemetry(self.spark, self.folder)).drop("ingested_at")

    @cached_property
    def dirty(self) -> DataFrame:
        return demo.telemetry_dirty(self.spark, self.folder)

    @cached_property
    def satellites(self) -> DataFrame:
        return demo.satellites(self.spark, self.folder)

    @cached_property
    def windows(self) -> DataFrame:
        return demo.scenario_windows(self.spark, self.folder)

    def scratch(self) -> str:
        return shared_folder(self.spark)


def rounded(df: DataFrame, digits: int | None) -> DataFrame:
    if digits is None:
        return df
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles})


def query(name: str, sql: str | None = None, *, doubles: str = "", digits: int | None = 6):
    """Registers a query; `doubles` names the floating-point columns that both sides round."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: rounded(build(Tables(spark, folder)), digits)
        if sql is not None:
            ORACLES[name] = oracle_text(sql, doubles.split(), digits)
        return build

    return register


def oracle_text(sql: str, doubles: list[str], digits: int | None) -> str:
    body = sql.strip()
    ctes = ""
    if body.startswith("WITH "):
        ctes, body = body[5:].split("\nFINALLY\n")
        ctes = ", " + ctes
    if doubles and digits is not None:
        replaced = ", ".join(f"round({c}, {digits}) + 0E0 AS {c}" for c in doubles)
        body = f"SELECT * REPLACE ({replaced}) FROM ({body}) AS answer"
    return f"{demo.sql_views()}{ctes}\n{body}"
