"""Registered queries over the given tables, each with the same question in SQL where SQL can ask it."""

from checks import aggregates, anomalies, health, rows, scalars, streams, tables, texts, windows  # noqa: F401
from checks.catalog import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
