"""Exact nearest neighbours by pivots: blocks of vectors that the triangle inequality rules out aren't read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphmill.sources.scratch import new_folder, written

#: Pivots at most, vectors of a block at least, and blocks at most, as every task that plans a query gets their bounds.
PIVOTS, BLOCK, BLOCKS = 256, 512, 200_000
#: Query vectors that are searched for at a time.
QUERIES = 4_096
#: Blocks that are read first for each query, beyond those that k vectors need.
FIRST = 2
#: What a distance to six places may hide.
MARGIN = 2e-6


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of two matrices, by differences and without loss."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        out[i] = np.sqrt(np.square(b - row).sum(axis=1))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class VectorIndex:
    """Vectors in written blocks, each around a pivot and between two distances from it."""

    def __init__(self, rows: DataFrame, pivots: np.ndarray, bounds: pd.DataFrame, n: int):
        self.rows, self.pivots, self.bounds, self.n = rows, pivots, bounds, n

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str = "chunk_id", column: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK) -> VectorIndex:
        """Deals the vectors out by their nearest pivot and their distance from it.

        Pivots are vectors of the table, at most ``pivots`` and the root of
        their number, picked by a hash of their id.  Null vectors are left out;
        all others have one dimension.
        """
        spark = vectors.sparkSession
        own = vectors.select(F.col(id_col).alias("id"), F.col(column).alias("v")).where("v is not null")
        n = own.count()
        drawn = own.orderBy(F.xxhash64("id"), "id").limit(min(pivots, max(1, int(n**0.5)))).select("v").collect() if n else []
        centres = np.array([r.v for r in drawn], np.float64)
        sent = spark.sparkContext.broadcast(centres)
        fields = StructType([*own.schema.fields, *StructType.fromDDL("pivot int, far double").fields])

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                far = _distances(sent.value, _matrix(batch.column(1)))
                at = far.argmin(axis=0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far[at, np.arange(len(at))])], names=["id", "v", "pivot", "far"])

        parts = max(1, min(BLOCKS // 2, -(-n // block)))
        dealt = own.mapInArrow(nearest, fields).repartitionByRange(parts, "pivot", "far")
        # a partition may hold the end of one pivot's vectors and the beginning of the next one's
        placed = written(dealt.withColumn("block", F.concat_ws("-", F.spark_partition_id(), "pivot")), "vector-blocks")
        bounds = placed.groupBy("block", "pivot").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.count("*").alias("n")).toPandas()
        path = f"{new_folder(spark, 'vectors')}/blocks"
        placed.repartition("block").sortWithinPartitions("block").write.parquet(path)
        return cls(spark.read.schema(placed.schema).parquet(path), centres, bounds, n)

    def _planned(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, q, block, least, first)``: the blocks that can hold one of a query's k nearest, by the bounds alone.

        The k nearest are no farther than the far ends of the nearest blocks
        with k vectors; a block whose near end is beyond that is left out.
        """
        spark = queries.sparkSession
        b = self.bounds.sort_values("block")
        sent = spark.sparkContext.broadcast((self.pivots, b["block"].to_numpy(str), b["pivot"].to_numpy(), b["lo"].to_numpy(), b["hi"].to_numpy(), b["n"].to_numpy()))
        schema = StructType([*queries.schema.fields, *StructType.fromDDL("block string, least double, first boolean").fields])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, names, pivot, lo, hi, size = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    d = _distances(_matrix(one.column(1)), centres)[0][pivot]
                    least, most = np.maximum(np.maximum(d - hi, lo - d), 0), d + hi
                    order = np.argsort(most, kind="stable")
                    enough = np.searchsorted(np.cumsum(size[order]), k)
                    limit = most[order[min(enough, len(order) - 1)]] + MARGIN if enough < len(order) else np.inf
                    kept = np.flatnonzero(least <= limit)
                    kept = kept[np.argsort(least[kept], kind="stable")]
                    first = np.cumsum(size[kept]) - size[kept] < k
                    first[: FIRST + int(first.sum())] = True
                    arrays = [pa.concat_arrays([c] * len(kept)) if len(kept) else c.slice(0, 0) for c in one.columns]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(names[kept].tolist(), pa.string()), pa.array(least[kept]), pa.array(first)], names=["query_id", "q", "block", "least", "first"])

        return queries.mapInArrow(choose, schema)

    def _measured(self, pairs: DataFrame, k: int) -> DataFrame:
        """``(query_id, chunk_id, distance)``: the k nearest in each block of each query that asks for it."""
        kind = pairs.schema["query_id"].dataType.simpleString(), self.rows.schema["id"].dataType.simpleString()

        def near(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asked) and len(held):
                held = held.sort_values("id")
                vectors, ids = np.stack(held["v"].to_numpy()).astype(np.float64), held["id"].to_numpy()
                for name, q in zip(asked["query_id"], asked["q"]):
                    far = np.round(np.sqrt(np.square(vectors - np.asarray(q, np.float64)).sum(axis=1)), 6)
                    best = np.argsort(far, kind="stable")[:k]  # ties by id
                    out.append(pd.DataFrame({"query_id": name, "chunk_id": ids[best], "distance": far[best]}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk_id": [], "distance": []})

        left = pairs.select("block", "query_id", "q").groupBy("block")
        return left.cogroup(self.rows.select("block", "id", "v").groupBy("block")).applyInPandas(near, f"query_id {kind[0]}, chunk_id {kind[1]}, distance double")

    def _pairs(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """What the first blocks give, and the pairs of queries and other blocks that are still to be read."""
        planned = written(self._planned(queries, k), "vector-plan")
        early = written(self._measured(planned.where("first"), k), "vector-first")
        by = Window.partitionBy("query_id").orderBy("distance")
        reached = early.withColumn("place", F.row_number().over(by)).where(F.col("place") == k).select(F.col("query_id").alias("r"), F.col("distance").alias("reached"))
        rest = planned.where("not first").join(reached, F.col("query_id") == F.col("r"), "left")
        return early, rest.where(F.col("reached").isNull() | (F.col("least") <= F.col("reached") + MARGIN)).drop("r", "reached")

    def knn(self, queries: DataFrame, k: int, query_id: str = "query_id", column: str = "embedding") -> DataFrame:
        """``(query_id, chunk_id, rank, distance)``, as :func:`~glyphmill.operators.vector.knn` answers, of the vectors in blocks that can matter."""
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(column).alias("q")).where("q is not null")
        near = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
        kind = asked.schema["query_id"].dataType.simpleString(), self.rows.schema["id"].dataType.simpleString()
        if not self.n:
            return queries.sparkSession.createDataFrame([], f"query_id {kind[0]}, chunk_id {kind[1]}, rank int, distance double")
        blocks = max(1, -(-asked.count() // QUERIES))
        out = None
        for i in range(blocks):
            part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
            early, rest = self._pairs(part, k)
            found = early.unionByName(self._measured(rest, k))
            out = found if out is None else out.unionByName(found)
        return out.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "distance")

    def share_measured(self, queries: DataFrame, k: int, query_id: str = "query_id", column: str = "embedding") -> float:
        """The part of all pairs of queries and vectors whose distance :meth:`knn` computes."""
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(column).alias("q")).where("q is not null")
        planned = written(self._planned(asked, k), "vector-plan")
        _, rest = self._pairs(asked, k)
        sizes = self.rows.groupBy("block").agg(F.count("*").alias("n"))
        read = planned.where("first").select("block").unionByName(rest.select("block")).join(sizes, "block").agg(F.sum("n")).first()[0] or 0
        return read / max(1, asked.count() * self.n)
