"""The entry points with and without the optional corpus part."""

from __future__ import annotations

import importlib
import sys

import __spark_entry__ as entry
from colophon.plans import ORACLES, QUERIES


def test_entry_points_without_the_corpus_part(monkeypatch):
    for name in ("colophon.llm", "colophon.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)  # importing it fails, as if it were not there
    importlib.reload(entry)
    assert entry.queries() == QUERIES and entry.oracle_sql() == ORACLES and len(QUERIES) > 150


def test_the_pipeline_file_alone_is_no_harm(monkeypatch):
    """corpus_pipeline.py may still lie there when the subpackage is gone."""
    for name in [m for m in sys.modules if m == "colophon.llm" or m.startswith("colophon.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.setitem(sys.modules, "colophon.llm", None)
    assert entry.queries() == QUERIES
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_corpus_part():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "colophon"
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not [p for p in others if "colophon.llm" in p.read_text(encoding="utf-8")]
