import math
import re
from collections import Counter

import numpy as np
import pytest

from glyphmill.llm import ranked_search
from glyphmill.llm.queries import table


def brute(docs, items, k):
    """Every item against every document."""
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    counted = [(i, Counter(cut(t))) for i, t in docs]
    rows, length = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for name, text in items:
        found = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * rows // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * rows + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(cut(text)) if t in c)
            if score > 0:
                found.append((-score, i is not None, i))
        out += [(name, r, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


def answers(index, items, k):
    return [tuple(r) for r in ranked_search.search(index, items, k).collect()]


def test_equals_brute_force(spark, small_dir):
    docs, items = table(spark, small_dir, "documents"), table(spark, small_dir, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    index = ranked_search.build_index(docs.repartition(3))
    assert sorted(answers(index, items, 10)) == sorted(want)


@pytest.mark.parametrize("blocks", [(1_000, 50_000), (2, 50_000), (1_000, 3)])
def test_ties_nulls_and_blocks(spark, docs_of, monkeypatch, blocks):
    monkeypatch.setattr(ranked_search, "ITEMS", blocks[0])
    monkeypatch.setattr(ranked_search, "TERMS", blocks[1])
    texts = ["a b c", "a b c", None, "", "?!", "A a a b", "c " * 600, "Straße ÄB äb", "a b c", "d"] + ["e f"] * 30
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "a b c"), (0, "a b c")]
    items = [(1, "a, b"), (2, None), (3, ""), (4, "zzz"), (5, "c C c"), (6, "ÄB straße"), (7, "äb"), (8, "e"), (9, "d e"), (9, "a b c d"), (10, "the " * 5000)]
    got = answers(ranked_search.build_index(docs_of(docs).repartition(4)), spark.createDataFrame(items, "item_id int, text string"), 4)
    assert sorted(got, key=repr) == sorted(brute(docs, items, 4), key=repr)


def test_tables(spark, docs_of):
    items = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert answers(ranked_search.build_index(docs_of([])), items, 3) == []
    assert answers(ranked_search.build_index(docs_of([(1, None)])), items, 3) == []
    assert answers(ranked_search.build_index(docs_of([(1, "a")])), items.where("false"), 3) == []
    clash = docs_of([(1, "b")]).selectExpr("doc_id", "text", "5 as id", "6 as n_terms", "7 as sketch", "8 as score")
    assert answers(ranked_search.build_index(clash), items.selectExpr("*", "1 as rank", "2 as item", "3 as name"), 3)[0][:3] == (1, 1, 1)


def test_bounds_hold():
    """No score exceeds its bound, also where counts are beyond what a coordinate keeps."""
    docs = [Counter({b"a": 300, b"b": 2}), Counter({b"t%d" % i: 1 + i % 7 for i in range(3000)}), Counter({b"a": 1})]
    names = [b"a", b"b", b"t5", b"t6", b"t999", b"absent"]
    df = {t: sum(t in c for c in docs) for t in names if any(t in c for c in docs)}
    q = ranked_search.Queries([names[:2], names[2:], [b"absent"]], df, 3, sum(sum(c.values()) for c in docs))
    assert q.live.tolist() == [0, 1]
    for c in docs:
        m = q.lengths(np.array([sum(c.values())]))
        bounds = q.bounds(np.frombuffer(ranked_search.sketch(c), np.uint8).reshape(1, -1), m)[0]
        for item in (0, 1):
            assert q.score(c, int(m[0]), item) <= bounds[item]
