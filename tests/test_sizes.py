"""Odd and large inputs, as in tables larger than the given ones."""

import re

import pytest

from glyphmill.plans import registry


def same_as_sql(spark, duck, folder, name):
    """The query's rows and those of its SQL, over the tables in ``folder``."""
    out = registry.queries()[name](spark, str(folder))
    found = duck(folder).execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    return sorted(repr(tuple(r)) for r in out.select(*names).collect()) == want and len(want) > 0


def documents(duck, folder, rows):
    """A table of documents in ``folder``, each of a text and a length; the folder."""
    con = duck(folder)
    con.execute("create table d (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into d values (?, ?, 'fr', 's', ?)", [(i, t, n) for i, (t, n) in enumerate(rows)])
    con.execute(f"copy d to '{folder}/documents.parquet'")
    return folder


def test_formats_of_empty_documents(spark, duck, tmp_path):
    rows = documents(duck, tmp_path, [("", 0), ("a", 1), (None, None), ("long", 2000), ("", 0)])
    assert same_as_sql(spark, duck, rows, "french_formats")


@pytest.mark.parametrize("name", ["run_moves", "run_deltas", "compare_runs"])
def test_runs_are_measured_once(spark, duck, small_dir, name):
    """What comparing two runs does to a run's rows doesn't search the corpus again."""
    out = registry.queries()[name](spark, small_dir)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" not in plan and "embedding" not in plan and same_as_sql(spark, duck, small_dir, name)


def test_one_shuffle_of_postings(spark, small_dir):
    """Document frequencies and scores are of one shuffle of the corpus's words."""
    found = registry.queries()["bm25_topk"](spark, small_dir)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    made = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning\(token#\d+, chunk_id", line)]
    assert len([line for line in made if "ReusedExchange" in line]) == 1 and len(made) == 2
