import importlib
import math
import sys

import pytest

from glyphmill.plans import registry


def same(value):
    """A value as both engines give it."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 8))
    return repr(list(value)) if isinstance(value, (list, tuple)) else repr(value)


def test_entry_without_the_training_data_part(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    for name in [m for m in sys.modules if m.startswith("glyphmill.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "glyphmill.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())


def test_flagship(spark):
    out = importlib.import_module("__spark_entry__").entry(spark)
    assert out.columns == ["query_id", "chunk_id", "rank", "source", "text"] and out.count() > 0


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_its_sql(spark, duck, small_dir, name):
    out = registry.queries()[name](spark, small_dir)
    columns = sorted(out.columns)
    got = sorted(tuple(map(same, r)) for r in out.select(*columns).collect())
    if name not in registry.oracle_sql():
        assert got
        return
    found = duck(small_dir).execute(registry.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in columns]
    assert len(found.description) == len(columns)
    assert got == sorted(tuple(same(r[i]) for i in at) for r in found.fetchall())
