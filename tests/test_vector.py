"""Nearest neighbours by products against plain distances."""

import math
import random

import pytest

from glyphmill.operators import vector
from glyphmill.plans import registry


def plain(queries, vectors, k, threshold=-1.0):
    """``(query, rank, id, distance)`` from all pairs, one after another; without a distance first, NaN last."""
    out = []
    for name, q in queries:
        near = []
        for i, v in vectors:
            if q is None or v is None:
                continue
            if len(q) != len(v) or None in q or None in v:
                near.append(((0, 0.0), i, None))
                continue
            total = 0.0
            for a, b in zip(q, v):
                total += (a - b) * (a - b)
            d = math.sqrt(total) if not math.isnan(total) else total
            d = d if math.isnan(d) or math.isinf(d) else math.floor(d * 1e6 + 0.5) / 1e6
            near.append(((2, 0.0) if math.isnan(d) else (1, d), i, d))
        near.sort(key=lambda x: (x[0], x[1]))
        out += [(name, rank, i, repr(d)) for rank, (_, i, d) in enumerate(near[:k], 1) if threshold <= 0 or d is None or d <= threshold]
    return sorted(out)


def answers(found):
    return sorted((r.query_id, r["rank"], r.chunk_id, repr(r.distance)) for r in found.collect())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_equals_plain_distances(spark, monkeypatch, kind):
    for name, size in {"TILE": 7, "STRIP": 50, "FIRST": 40, "READ": 640, "PAIRS": 33, "BLOCK": 64}.items():
        monkeypatch.setattr(vector, name, size)
    draw = random.Random(3)
    point = lambda size=1.0: [draw.choice([draw.gauss(0, size), draw.randrange(3) * 0.25]) for _ in range(8)]
    near = lambda v: [x + draw.randrange(-3, 4) * 4e-7 for x in v]
    rows = [point() for _ in range(400)]
    rows += [rows[0]] * 150 + [near(rows[1]) for _ in range(60)] + [point(1e5) for _ in range(20)]  # many at one place, and within what rounding hides
    rows += [None, [1.0, 2.0], [0.5] * 7 + [None], [1e300] * 8, [math.inf] + [0.0] * 7, [math.nan] * 8, [1e160] * 8, []]
    draw.shuffle(rows)
    ids = list(range(len(rows))) if kind == "long" else [f"é{i}" for i in range(len(rows))]
    vectors = list(zip(ids, rows))
    queries = [(i, v) for i, v in enumerate(rows) if i % 5 == 0 or v is None or len(v) != 8 or None in v or abs(v[0]) > 1e100 or math.isnan(v[0])]
    queries += [(len(rows) + i, next(v for v in rows if rows.count(v) > 9)) for i in range(3)]
    v = spark.createDataFrame(vectors, f"chunk_id {kind}, embedding array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, embedding array<double>")
    for k, threshold in ((1, -1.0), (5, -1.0), (9, 1.1), (130, -1.0), (1000, 2.0)):
        some = queries if k < 100 else queries[::9]
        asked = q if k < 100 else spark.createDataFrame(some, "query_id int, embedding array<double>")
        assert answers(vector.knn(asked, v, k, threshold)) == plain(some, vectors, k, threshold)
    far = spark.createDataFrame([(0, [1e6] * 8)], "query_id int, embedding array<double>")
    same = v.where("size(embedding) = 8 and not exists(embedding, x -> x is null)")
    assert vector.knn(far, same, 3, 0.5).count() == 0
    assert vector.knn(q.where("false"), v, 3).count() == 0 and vector.knn(q, v.where("false"), 3).count() == 0


def test_no_pair_is_a_row(spark, small_dir):
    """Pairs of vectors are products of matrices in tasks, not rows of a join."""
    e = spark.read.parquet(f"{small_dir}/embeddings.parquet")
    found = vector.knn(e.selectExpr("vec_id as query_id", "embedding"), e.selectExpr("vec_id as chunk_id", "embedding"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and found.count() == 1500


@pytest.mark.parametrize("name", ["vector_threshold", "vector_min_distance"])
def test_ties_and_none_near_as_in_sql(spark, duck, tmp_path, name):
    """A place of many vectors, one of which no vector but itself is near, and vectors on a grid, against SQL."""
    con = duck(tmp_path)
    con.execute(f"""copy (select i as vec_id, (case when i % 3 = 0 then [0.5, 0.5, 0.5] when i = 40 then [50, 50, 50] else [i % 7, i % 5, i % 4] end)::FLOAT[] as embedding, 0 as label
      from range(1200) t(i)) to '{tmp_path}/embeddings.parquet'""")
    out = registry.queries()[name](spark, str(tmp_path))
    found = duck(tmp_path).execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    assert want and sorted(repr(tuple(r)) for r in out.select(*names).collect()) == want
    assert "NestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()
