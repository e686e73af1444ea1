"""The entry points, with and without the optional operators."""

import importlib.util
import sys
from pathlib import Path

import __spark_entry__ as registered

HERE = Path(registered.__file__)


def load_again():
    spec = importlib.util.spec_from_file_location("entry_again", HERE)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_without_the_optional_package(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("fleetgauge.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "fleetgauge.llm", None)
    alone = load_again()
    assert "fleet_overview" in alone.queries() and "pipeline" not in alone.queries()
    assert not [n for n in alone.queries() if n.startswith("op")]
    assert set(alone.oracle_sql()) <= set(alone.queries())


def test_every_sql_has_its_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())
