import random

import pytest

from glyphmill.operators import pivots, vector


def table(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} int, embedding array<float>")


def answers(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.distance) for r in df.collect())


@pytest.mark.parametrize("block", [8, 512])
def test_equals_all_pairs(spark, block):
    draw = random.Random(1)
    centres = [[draw.gauss(0, 5) for _ in range(6)] for _ in range(9)]
    point = lambda: [c + draw.gauss(0, 0.3) for c in draw.choice(centres)]
    rows = [(i, point()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, None), (2001, [99.0] * 6)]  # many at one place, and one far away
    asked = [(i, v) for i, v in rows[:25]] + [(5000, [0.0] * 6), (5001, None), (5002, [99.0] * 6), (25, rows[0][1])]
    vectors, queries = table(spark, rows, "chunk_id").repartition(5), table(spark, asked, "query_id")
    index = pivots.VectorIndex.build(vectors, block=block)
    for k in (1, 7, 60):
        assert answers(index.knn(queries.where("query_id < 25 or query_id >= 5000"), k)) == answers(vector.knn(queries.where("query_id < 25 or query_id >= 5000"), vectors, k))
    if block == 8:
        assert index.share_measured(queries, 3) < 0.4
    assert answers(index.knn(queries.limit(2), 2_000)) == answers(vector.knn(queries.limit(2), vectors, 2_000))


def test_queries_in_blocks_and_tables(spark, small_dir, monkeypatch):
    monkeypatch.setattr(pivots, "QUERIES", 7)
    e = spark.read.parquet(f"{small_dir}/embeddings.parquet").selectExpr("cast(vec_id as int) chunk_id", "embedding")
    queries = e.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    index = pivots.VectorIndex.build(e, block=16)
    assert answers(index.knn(queries, 5)) == answers(vector.knn(queries, e, 5))
    none = pivots.VectorIndex.build(e.where("false"))
    assert none.knn(queries, 3).count() == 0 and index.knn(queries.where("false"), 3).count() == 0
