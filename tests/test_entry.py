"""The driver's contract holds with and without the subpackage for training text."""

import os
import runpy
import sys

import pytest

ENTRY = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")


def test_every_twin_has_a_query():
    e = runpy.run_path(ENTRY)
    assert set(e["oracle_sql"]()) <= set(e["queries"]())


@pytest.mark.parametrize("gone", ["fleetlens.llm", "corpus_pipeline"])
def test_entry_without_the_subpackage(monkeypatch, gone):
    for name in [m for m in sys.modules if m.startswith(("fleetlens.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)
    e = runpy.run_path(ENTRY)
    assert not [n for n in e["queries"]() if n.startswith("op") or n == "pipeline"]
    assert "dp00_vehicle_vs_baseline" in e["queries"]()


def test_other_import_errors_are_not_swallowed(monkeypatch):
    pytest.importorskip("fleetlens.llm.queries")
    for name in [m for m in sys.modules if m.startswith(("fleetlens.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "fleetlens.session", None)
    with pytest.raises(ImportError):
        runpy.run_path(ENTRY)
