import hashlib
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate, queries


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in wins}
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        yield doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_whole_table(spark, sf_dir):
    docs = [tuple(r.values()) for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    items = [tuple(r.values()) for r in pq.read_table(f"{sf_dir}/benchmark.parquet", columns=["item_id", "text"]).to_pylist()]
    got = sorted(tuple(r) for r in queries.op4_decontamination(spark, sf_dir).collect())
    assert got == sorted(brute(docs, items))
    assert sum(r[-1] for r in got) > 10


DOCS = [(1, "x y One, two THREE four. z"), (2, None), (3, ""), (4, "one two"), (5, "alpha é9 beta alpha é9 beta"), (5, "alpha é9 beta alpha é9 beta"), (None, "five")]
ITEMS = [(1, "one two three four"), (2, "five"), (3, None), (4, "..."), (12, "ALPHA é9 beta"), (None, "x y"), (7, "one two three four")]


def test_short_items_and_odd_rows(spark, docs_of):
    docs = docs_of(DOCS).withColumn("items", F.lit("clash"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = sorted((d if d is not None else -1, n, h, i) for d, n, h, i, *_ in brute(DOCS, [x for x in ITEMS if x[0] is not None], 3))
    for block_words in (10**6, 1):
        out = decontaminate.scan(docs, bench, window=3, block_words=block_words)
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, len(r.items)) for r in out.collect()) == expected
    clean = decontaminate.remove_documents(docs, bench, window=3)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench, window=3).collect()}
    assert cut[1] == "x y . z" and cut[2] is None and cut[5] == "" and cut[None] == ""
    assert decontaminate.scan(docs_of([]), bench).count() == 0
    assert {r.n_hit for r in decontaminate.scan(docs, bench.limit(0)).collect()} == {0}
