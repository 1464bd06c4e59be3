import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import containment, ingest, limiter, ordered, pages, statistics
from glyphmill.sources import golden


def largest(spark, df, *keys):
    """Rows of the largest partition of ``df``, and of all."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes), sum(sizes)


@pytest.mark.parametrize("parts", [1, 5, 31])
def test_scan_of_one_hot_group(spark, parts):
    draw = random.Random(1)
    data = [("hot", i, draw.randrange(3)) for i in range(900)] + [(f"k{i % 40}", i, i % 2) for i in range(300)] + [(None, i, 1) for i in range(50)]
    draw.shuffle(data)
    df = spark.createDataFrame(data, "k string, o int, v int")
    out = ordered.scan(df, ["k"], ["o"], ["v", "o"], lambda b: b.isNull() | (b["v"] != F.col("v")), parts)
    got = {(r.k, r.o): (r.place, tuple(r.before) if r.before else None, r.island) for r in out.collect()}
    assert len(got) == len(data)
    for k in {r[0] for r in data}:
        before, island = None, 0
        for place, (_, o, v) in enumerate(sorted(r for r in data if r[0] == k)):
            island += before is None or before[0] != v
            assert got[k, o] == (place, before, island)
            before = (v, o)


def test_no_task_holds_the_hot_group(spark):
    df = spark.range(20_000).select(F.lit("one").alias("k"), F.col("id").alias("o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordered.scan(df, ["k"], ["o"], ["o"], parts=16)
        most, total = largest(spark, out)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert total == 20_000 and most < total / 3


def test_pages_labels_and_ordinals_of_one_source(spark):
    numbers = [1, 1, 1, 2, 2, 3, 3, 3, 3, 1] * 6
    rows = [("s", i, n, f"t{i}", i % 4 != 2) for i, n in enumerate(numbers)] + [("t", 0, 1, "x", True)]
    df = spark.createDataFrame(rows, "source string, ord int, number int, text string, labelled boolean")
    want, islands = [], []
    for source, i, n, t, labelled in rows:
        if islands and labelled and islands[-1][0] == source and islands[-1][2] == n:
            islands[-1][3].append(t)
        else:
            islands.append([source, i, n, [t], labelled])
    want = sorted((s, i, n, "\n".join(t), len(t), l or len(t) > 1) for s, i, n, t, l in islands)  # noqa: E741
    for parts in (1, 7):
        got = pages.merge_pages(df, parts=parts)
        assert sorted((r.source, r.ord, r.number, r.text, r.parts, r.labelled) for r in got.collect()) == want
        shown = pages.collapse_labels(df.withColumn("name", F.col("number").cast("string")), "source", "ord", parts=parts)
        assert sum(r.shown != "" for r in shown.collect()) == 1 + sum(a != b for a, b in zip(numbers, numbers[1:])) + 1
        placed = ingest.prepare_chunks(df, order=("ord",), parts=parts)
        assert sorted((r.chunk_id, r.chunk_index) for r in placed.collect()) == sorted((f"{r[0]}::chunk_{r[1]}", r[1]) for r in rows)
    sample = golden.seeded_sample(df.where("source = 's'"), "ord", 9, 4, parts=6)
    drawn = sorted(random.Random(4).sample(range(60), 9))
    assert sorted((r.ord, r.offset) for r in sample.collect()) == [(i, i) for i in drawn] and sample.columns == [*df.columns, "offset"]


def fold(events, most, window):
    out = []
    for key in {k for k, _ in events}:
        log = deque()
        for now in sorted(t for k, t in events if k == key):
            while log and now - log[0] >= window:
                log.popleft()
            full = len(log) >= most
            out.append((key, now, not full, max(1, math.ceil(window - (now - log[0]))) if full else None))
            if not full:
                log.append(now)
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_limiter_with_a_client_that_never_pauses(spark, parts):
    draw = random.Random(2)
    events = [("hot", i / 3 + draw.random()) for i in range(700)] + [(f"c{i % 20}", draw.random() * 900) for i in range(300)] + [(None, float(i)) for i in range(40)] + [("ties", 5.0)] * 30
    df = spark.createDataFrame(events, "user_id string, ts double")
    got = limiter.limit(df, 4, 10.0, parts=parts).collect()
    assert sorted(map(tuple, got), key=repr) == fold(events, 4, 10.0)
    if parts == 23:
        placed = ordered.scan(df.withColumnRenamed("user_id", "key"), ["key"], ["ts"], parts=parts, keep_block=True)
        assert placed.where("key = 'hot'").select(ordered.BLOCK).distinct().count() > 8


def test_limiter_edges(spark):
    none = spark.createDataFrame([], "user_id string, ts double")
    assert limiter.limit(none, 1, 1).count() == 0
    rows = spark.createDataFrame([("a", None), ("a", 1.0), ("a", 2.0), ("a", 11.0)], "user_id string, ts double")
    assert [tuple(r) for r in limiter.limit(rows, 1, 10).orderBy("ts").collect()] == [("a", 1.0, True, None), ("a", 2.0, False, 9), ("a", 11.0, True, None)]
    with pytest.raises(ValueError):
        limiter.limit(rows, 0, 10)


@pytest.mark.parametrize("chars", [1_000_000, 4])
def test_containment(spark, chars):
    texts = [("a", "xxabcabc"), ("b", "bc"), ("c", None), ("d", ""), ("e", "ABC é 🙂 z"), ("f", "bc" * 5000), ("a", "abc")]
    needles = [(1, "abc"), (2, "bc"), (3, "bca"), (4, ""), (5, None), (6, "🙂"), (7, "bc"), (8, "zz"), (9, "é 🙂 z")]
    t, n = spark.createDataFrame(texts, "source string, text string"), spark.createDataFrame(needles, "query_id int, needle string")
    got = sorted(map(tuple, containment.contained(t, n, block_chars=chars).collect()))
    assert got == sorted((i, s) for i, x in needles for s, y in texts if x and y is not None and x in y)
    assert containment.contained(t, n.where("query_id = 4")).count() == 0 and containment.contained(t.where("false"), n).count() == 0


def test_order_statistics(spark):
    draw = random.Random(3)
    groups = {
        "wide": [draw.choice([1, -1]) * 10.0 ** draw.randrange(-300, 300) for _ in range(200)],
        "ends": [1.7e308, -1.7e308, 0.0, 5e-324],
        "same": [2.5] * 40,
        "near": [1.0 + i * 2**-52 for i in range(30)],
        "one": [-0.5],
        None: [float(i) for i in range(11)],
        "heavy": [7.0] * 5000 + [float(i) for i in range(3000)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double").repartition(5)
    got = {r.g: (r.n, r.least, r.nth, r.most) for r in statistics.nth(df, "g", "v", F.floor(F.col("n") / 2), bins=16).collect()}
    assert got == {g: (len(vs), min(vs), sorted(vs)[len(vs) // 2], max(vs)) for g, vs in groups.items()}
    assert statistics.nth(df.where("v is null"), "g", "v", F.lit(0)).count() == 0
    assert {r.g for r in statistics.nth(df, "g", "v", F.lit(50)).collect()} == {"wide", "heavy"}
