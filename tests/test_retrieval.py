import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.config import EngineConfig
from glyphmill.operators import evaluate, fusion, lexical, retrieve, vector


def ranking(out):
    rows = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r.rank)):
        rows.setdefault(r.query_id, []).append(r.chunk_id)
    return rows


def plain_bm25(query, chunks, k):
    docs = [(i, t.split()) for i, t in chunks]
    avg = sum(len(w) for _, w in docs) / len(docs)
    scores = {}
    for word in query.split():
        df = sum(word in w for _, w in docs)
        for i, w in docs:
            if tf := Counter(w)[word]:
                scores[i] = scores.get(i, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avg))
    return sorted(scores, key=lambda i: (-round(scores[i], 8)))[:k]


CHUNKS = [(1, "apple banana cherry"), (2, "banana " * 2 + "date " * 60), (3, "apple apple fig"), (4, "grape"), (5, "grape"), (6, "")]


def test_bm25(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, text string")
    queries = ["apple", "banana", "apple apple banana", "grape cherry", "unknown words"]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    got = ranking(lexical.bm25_topk(q, chunks, 3))
    assert got == {i: r for i, t in enumerate(queries) if (r := plain_bm25(t, CHUNKS, 3))}
    assert got[1][0] == 1 and got[3] == [1, 4, 5]  # the short document wins; ties keep the order of the corpus
    assert lexical.bm25_topk(q, chunks.limit(0), 3).count() == 0


def rankings(spark, *lists):
    return [spark.createDataFrame([(0, c, i) for i, c in enumerate(r, 1)] or [], "query_id int, chunk_id string, rank int") for r in lists]


def test_rrf(spark):
    fuse = lambda lists, w, k, n: ranking(fusion.rrf(rankings(spark, *lists), w, k, n)).get(0, [])
    assert fuse([["a", "b"], ["b", "c"]], [1, 1], 60, 2) == ["b", "a"]
    assert fuse([["a", "b"], []], [3, 1], 60, 5) == ["a", "b"]
    assert fuse([["a", "b"], ["c", "d"]], [1, 1], 10, 4) == ["a", "c", "b", "d"]
    long = [f"x{i}" for i in range(48)]
    solo = [["solo", *long, "both"], [f"y{i}" for i in range(48)] + ["both"]]
    assert fuse(solo, [1, 1], 60, 1) == ["both"] and fuse(solo, [1, 1], 1, 1) == ["solo"]
    with pytest.raises(ValueError):
        fusion.rrf([], [1], 10, 1)


def test_knn_and_hybrid(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 1)
    vectors = spark.createDataFrame([(1, [0.0, 0.2]), (2, [0.0, 0.9]), (3, [0.0, 0.2]), (4, None)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(0, "fig", [0.0, 0.0]), (1, "grape", [0.0, 1.0])], "query_id int, text string, embedding array<float>")
    assert ranking(vector.knn(q, vectors, 3)) == {0: [1, 3, 2], 1: [2, 1, 3]}
    assert ranking(vector.knn(q, vectors, 3, threshold=0.5)) == {0: [1, 3], 1: [2]}
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, text string").where("chunk_id <> 5")
    found = ranking(retrieve.retrieve(q, chunks, vectors, 3))
    assert found[0][0] == 3 and set(found[1]) <= {1, 2, 3, 4}
    only = ranking(retrieve.retrieve(q, chunks, vectors, 2, EngineConfig(hybrid_enabled=False)))
    assert only == {0: [1, 3], 1: [2, 1]}


def test_evaluation(spark):
    expected = spark.createDataFrame([("q1", "a", 3), ("q1", "b", None), ("q2", "a", 9), ("q5", "a", 1)], "query_id string, source string, page int")
    retrieved = spark.createDataFrame(
        [("q1", "a", 4, 1), ("q1", "b", None, 2), ("q1", "a", 3, 3), ("q2", "a", None, 1), ("q3", "a", 1, 1), ("q5", "a", 1, 7)], "query_id string, source string, page int, rank int"
    )
    ranks = evaluate.first_match_rank(expected, retrieved)
    assert {r.query_id: r["rank"] for r in ranks.collect()} == {"q1": 2, "q5": 7}
    questions = spark.createDataFrame([(f"q{i}",) for i in (1, 2, 3, 4, 5)], "query_id string")
    near = spark.createDataFrame([("q1", 0.3), ("q2", 0.1), ("q5", 0.2), ("q3", 0.25)], "query_id string, min_distance double")
    res = evaluate.results(questions, expected, ranks, near).cache()
    s = evaluate.summary(res, 5).first()
    assert (s.questions, s.answerable, s.out_of_corpus, s.hits, s.misses, s.rank_1, s.rank_2_to_k) == (5, 3, 2, 1, 1, 0, 1)
    assert s.hit_at_k == pytest.approx(0.3333) and s.mrr == pytest.approx(0.1667)
    stats = {r.out_of_corpus: tuple(r)[1:] for r in evaluate.distance_stats(res).collect()}
    assert stats == {False: (3, 0.1, 0.2, 0.3), True: (1, 0.25, 0.25, 0.25)}
    assert evaluate.distances_overlap(evaluate.distance_stats(res)).first().overlap
    moved = res.withColumn("rank", F.when(F.col("query_id") == "q2", 1).otherwise(F.col("rank"))).where("query_id <> 'q5'")
    assert tuple(evaluate.compare(res, moved).first()) == (1, 0, 1, 1, 0)
    empty = evaluate.summary(res.limit(0), 5).first()
    assert empty.hit_at_k == 0.0 and empty.mrr == 0.0
    indexed = spark.createDataFrame([("b",)], "source string")
    assert {r.query_id for r in evaluate.orphans(expected, indexed).collect()} == {"q2", "q5"}


def test_fingerprint(spark):
    import hashlib

    ids = [f"book::chunk_{i}" for i in range(40)]
    total = 0
    for i in ids:
        total ^= int(hashlib.sha256(i.encode()).hexdigest(), 16)
    expected = hashlib.sha256(f"{len(ids)}:{total}".encode()).hexdigest()[:12]
    frame = spark.createDataFrame([(i,) for i in ids], "chunk_id string")
    assert evaluate.fingerprint(frame) == expected == evaluate.fingerprint(frame.orderBy(F.desc("chunk_id")))


def test_config():
    assert EngineConfig.from_env({"GLYPHMILL_CHUNK_SIZE": "300", "GLYPHMILL_HYBRID_ENABLED": " off ", "GLYPHMILL_ASK_RATE": "2/5", "GLYPHMILL_N_RESULTS": " "}) == EngineConfig(chunk_size=300, hybrid_enabled=False, ask_rate=(2, 5))
    for bad in ({"CHUNK_SIZE": "0"}, {"ANSWER_MODE": "x"}, {"HYBRID_VECTOR_WEIGHT": "0"}, {"ASK_RATE": "5"}, {"ASK_RATE": "0/3"}):
        with pytest.raises(ValueError):
            EngineConfig.from_env({f"GLYPHMILL_{k}": v for k, v in bad.items()})
