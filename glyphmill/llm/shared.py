"""Helpers that several operators use: shared-folder tables and components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is set, in local mode only: on a
    cluster a machine-local folder would lose rows, so that raises.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 8_000_000) -> None:
    """Sends at most ``rows`` rows, and no more once there are ``size`` bytes, to Python at a time.

    Texts are long, and a batch is held on both sides, for every task.  The
    session keeps the bounds, as Spark reads them when a frame is run, which is
    after the operator that made it has returned; lower ones stay as they are.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def returning(batches: Iterator) -> Iterator:
    """The results of a task, after which its worker gives back the memory that the task is done with.

    Workers live on beside the executor, idle or for other stages, and would
    hold what they once took.
    """
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)


def spread(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` of ``rows`` rows over so many partitions that none has more than ``most``, and every core has one."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, not a recomputation.
    The files go when the application's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


#: A node with more edges than a task may join, and more than this share of all, gets a broadcast: at most two nodes for each share.
NODE_EDGES, HEAVY_NODE = 500_000, 0.001


def connected_components(edges: DataFrame, max_rounds: int = 60, node_edges: int = NODE_EDGES) -> DataFrame:
    """Connected components of ``edges(u, v)`` as ``(node, component)``.

    Alternating large-star and small-star contraction: every round joins each
    node's edges with that node's least neighbour.  Nodes with more than
    ``node_edges`` edges and more than ``HEAVY_NODE`` of all, of which there
    are at most ``2 / HEAVY_NODE``, get it by a broadcast and their edges stay
    where they are; so no task ever holds a component or the edges of a
    frequent node.  A round with no more edges than one node may have has no
    such node, and its plan leaves the broadcasts out.  ``component`` is the
    least node of the component; only nodes with an edge to another node are
    returned.  Null ends and self-loops are ignored.
    """

    def with_least(e: DataFrame, least: DataFrame, heavy: float | None) -> DataFrame:
        if heavy is None:
            return e.join(least.select("u", "m"), "u")
        some = least.where(F.col("n") > heavy).select("u", "m")
        light = e.join(F.broadcast(some.select("u")), "u", "left_anti")
        return e.join(F.broadcast(some), "u").unionByName(light.join(least.select("u", "m"), "u"))

    def stars(e: DataFrame, n: int) -> DataFrame:
        heavy = max(node_edges, HEAVY_NODE * n) if n > node_edges else None
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = with_least(both.where(F.col("v") > F.col("u")), least, heavy).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_least(large, least, heavy)
        return (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("double"))).first())

    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = materialise(e, "components")
    now = state(e)
    for _ in range(max_rounds):
        if not now[0]:
            break
        e = materialise(stars(e, now[0]), "components")
        before, now = now, state(e)
        if now[:2] == before[:2]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
