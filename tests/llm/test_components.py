"""Connected components, with frequent nodes among them, against a union-find."""

import random

import pytest

from glyphmill.llm.shared import HEAVY_NODE, connected_components


def union_find(edges):
    of = {}

    def root(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = sorted((root(u), root(v)))
            of[b] = a
    return {x: root(x) for x in of}


def cases():
    rng = random.Random(3)
    hub = [(5_000, v) for v in range(3_000)] + [(5_000, v) for v in range(6_000, 9_000)]
    second = [(20_000 + i, 40_000) for i in range(4_000)] + [(40_000, 5_001), (5_001, 5_002)]
    chain = [(50_000 + i, 50_001 + i) for i in range(40)]
    loose = [(rng.randrange(60_000, 61_000), rng.randrange(60_000, 61_000)) for _ in range(600)]
    odd = [(1, None), (None, 2), (None, None), (7, 7), (9_999_999, 9_999_999), (5_000, 3), (3, 5_000)]
    return [("hubs", hub + second + chain + loose + odd), ("bridged", hub + second + [(8_999, 23_999)]), ("few", [(1, 2), (3, 2), (8, 9)]), ("none", [])]


@pytest.mark.parametrize("name,edges", cases())
def test_components_equal_union_find(spark, name, edges):
    frame = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = connected_components(frame, node_edges=500).collect()
    assert {r.node: r.component for r in got} == union_find(edges)
    assert len(got) == len({r.node for r in got})


def test_frequent_nodes_lie_in_no_shuffled_join(spark):
    """The broadcast side has at most two nodes for each share of the edges."""
    edges = [(0, v) for v in range(1, 2_001)] + [(10_000 + i, 20_000 + i) for i in range(3_000)]
    ends = {}
    for u, v in edges:
        ends[u], ends[v] = ends.get(u, 0) + 1, ends.get(v, 0) + 1
    heavy = [u for u, n in ends.items() if n > HEAVY_NODE * len(edges)]
    assert heavy == [0] and len(heavy) <= 2 / HEAVY_NODE
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), node_edges=1_000)
    assert got.groupBy("component").count().where("count > 2").collect() == [(0, 2_001)]
