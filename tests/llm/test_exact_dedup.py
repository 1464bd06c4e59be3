import hashlib
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import exact_dedup


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc)
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            yield i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()


ROWS = [(i, "hot  text") for i in range(50, 10, -1)] + [(100 + i, f"t {i % 7}") for i in range(30)] + [(5, None), (6, ""), (7, "\t"), (8, " "), (None, "only null id"), (None, "t 1"), (9, "x\u00a0y"), (10, "x y")]


@pytest.mark.parametrize("support", [0.1, 0.001, 1.0])
def test_matches_brute_force(docs_of, support):
    docs = docs_of(ROWS).withColumn("kept", F.lit("clash"))
    out = exact_dedup.mark_duplicates(docs, support=support, carry=["doc_id"])
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(brute(ROWS), key=key)
    kept = exact_dedup.deduplicate(docs, support=support)
    assert kept.columns == docs.columns and kept.first().kept == "clash"
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(d or -1 for d, k, _, own, _ in brute(ROWS) if own)


def test_repeated_rows_and_empty(docs_of):
    out = exact_dedup.mark_duplicates(docs_of([(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b")]))
    assert sorted((r.doc_id or -1, r.kept) for r in out.collect()) == [(-1, False), (-1, True), (1, False), (1, True), (2, False)]
    assert exact_dedup.mark_duplicates(docs_of([])).count() == 0


def test_plan_is_native(docs_of):
    plan = exact_dedup.mark_duplicates(docs_of(ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
