"""Exact nearest neighbours of a set of query vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Query vectors that are sent to every task at once; more are taken in blocks, one scan each.
BLOCK = 16_384
#: Query vectors and vectors whose products are computed at once, and numbers that vectors read at once have at most.
TILE, STRIP, READ = 256, 2_048, 1 << 20
#: Vectors that give the first bounds.
FIRST = 1_024
#: Pairs whose distance is computed by differences at once.
PAIRS = 32_768
#: What a distance to six places may hide.
MARGIN = 1e-6
#: Squares above this are left to differences, as a sum of products could overflow.
LARGE = 1e300


def _rounded(distance: np.ndarray) -> np.ndarray:
    """To six places, halves up."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = distance * 1e6
        whole = np.floor(scaled)
        return np.where(np.isfinite(scaled), (whole + (scaled - whole >= 0.5)) / 1e6, distance)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of ``a`` and ``b``, pair by pair, squares added in order."""
    if not a.shape[1]:
        return np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        return _rounded(np.sqrt(np.cumsum(np.square(a - b), axis=1)[:, -1]))


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """``{length: (rows, matrix)}``; rows with a null among their numbers are under -1, without a matrix."""
    sizes = np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten()
    if flat.null_count:
        starts = np.cumsum(sizes) - sizes
        missing = np.cumsum(np.concatenate([[0], np.asarray(flat.is_null().to_numpy(zero_copy_only=False), np.int64)]))
        holed = missing[starts + sizes] > missing[starts]
        flat = flat.fill_null(0)
    else:
        holed = np.zeros(len(sizes), bool)
    numbers = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)
    ends = np.cumsum(sizes)
    kinds = np.where(holed, -1, sizes)
    found = {}
    for length in np.unique(kinds):
        rows = np.flatnonzero(kinds == length)
        if length < 0:
            found[-1] = rows, np.zeros((len(rows), 0))
        elif len(rows) == len(sizes):
            found[int(length)] = rows, numbers.reshape(len(rows), length)
        else:
            found[int(length)] = rows, numbers[(ends[rows] - length)[:, None] + np.arange(length)]
    return found


def _few_copies(matrix: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that have fewer than ``k`` equal ones before them; the others are among no query's ``k`` nearest."""
    if len(matrix) <= k or not matrix.shape[1] or np.unique(matrix[:, 0], return_counts=True)[1].max() <= k:
        return np.arange(len(matrix))
    _, group = np.unique(np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    starts = np.r_[True, group[order][1:] != group[order][:-1]]
    place = np.arange(len(order)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
    return np.sort(order[place < k])


class _Tile:
    """Some queries of one length, and the ``k`` nearest of each so far: by distance, then in the order in which vectors came."""

    def __init__(self, rows: np.ndarray, matrix: np.ndarray, length: int, k: int, threshold: float, ids: pa.Array):
        self.rows, self.matrix, self.length, self.k, self.threshold = rows, matrix, length, k, threshold
        with np.errstate(over="ignore", invalid="ignore"):
            self.squares = np.square(matrix).sum(axis=1)
        self.plain = self.squares < LARGE  # neither that large nor infinite nor NaN
        whole = np.where(self.plain[:, None], matrix, 0.0)
        self.left = np.hstack([-2 * whole, np.where(self.plain, self.squares, 0.0)[:, None], np.ones((len(rows), 1))])
        self.query, self.far, self.ids = np.zeros(0, np.int64), np.zeros(0), ids
        self.reach = np.full(len(rows), threshold if threshold > 0 else np.inf)  # a distance beyond which nothing counts
        self.full = np.zeros(len(rows), bool)

    def _limit(self, reach: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Squares, as products give them, up to which a vector may be as near as ``reach``."""
        return np.where(reach >= 0, np.square(reach + MARGIN) + slack, -np.inf)

    def _found(self, right: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of plain queries and vectors that may count, by products."""
        slack = 1e-14 * (self.length + 8) * (np.where(self.plain, self.squares, 0.0) + most + 1e-300)
        pairs = []
        limit = self._limit(self.reach, slack)
        limit[~self.plain] = -np.inf
        for at in range(0, len(right), STRIP):
            d = self.left @ right[at : at + STRIP].T
            if d.shape[1] > self.k and (self.plain & ~self.full).any():
                kth = np.partition(d, self.k - 1, axis=1)[:, self.k - 1]
                near = self._limit(np.sqrt(np.maximum(kth + slack, 0)), slack)
                limit = np.where(self.plain, np.minimum(limit, near), -np.inf)
            q, v = np.divmod(np.flatnonzero((d <= limit[:, None]).ravel()), d.shape[1])
            pairs.append((q, v + at))
        return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])

    def take(self, kinds: dict, ready: dict, ids: pa.Array) -> None:
        """Vectors of a batch, in order; ``ready`` holds what is the same for all tiles."""
        query, at, far = [], [], []
        for length, (rows, matrix) in kinds.items():
            n, w = len(self.rows), min(len(rows), self.k)
            if length != self.length or length < 0:  # no distance
                query.append(np.repeat(np.arange(n), w))
                at.append(np.tile(rows[:w], n))
                far.append(np.full(n * w, -np.inf))
                continue
            plain, right, most, odd = ready[length]
            pairs = []
            if len(plain):
                q, v = self._found(right, most)
                pairs.append((q, plain[v]))
            rest = np.flatnonzero(~self.plain)
            pairs.append((np.repeat(rest, len(plain)), np.tile(plain, len(rest))))
            pairs.append((np.repeat(np.arange(n), len(odd)), np.tile(odd, n)))
            for q, v in pairs:
                for i in range(0, len(q), PAIRS):
                    d = _exact(self.matrix[q[i : i + PAIRS]], matrix[v[i : i + PAIRS]])
                    with np.errstate(invalid="ignore"):
                        near = np.flatnonzero(~(d > self.reach[q[i : i + PAIRS]]) if self.threshold <= 0 else d <= self.reach[q[i : i + PAIRS]])
                    query.append(q[i : i + PAIRS][near])
                    at.append(rows[v[i : i + PAIRS][near]])
                    far.append(d[near])
        if not any(map(len, query)):
            return
        query, at, far = np.concatenate(query), np.concatenate(at), np.concatenate(far)
        held = len(self.query)
        place = np.concatenate([np.arange(held) - held, at])  # those held came before
        query, far = np.concatenate([self.query, query]), np.concatenate([self.far, far])
        order = np.lexsort((place, far, query))
        starts = np.r_[True, query[order][1:] != query[order][:-1]]
        nth = np.arange(len(order)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
        order, nth = order[nth < self.k], nth[nth < self.k]
        place = place[order]
        self.ids = pa.concat_arrays([self.ids, ids]).take(pa.array(place + held))
        self.query, self.far = query[order], far[order]
        last = nth == self.k - 1
        self.full[self.query[last]] = True
        self.reach[self.query[last]] = np.fmin(self.reach[self.query[last]], self.far[last])


def _nearest(batches: Iterator[pa.RecordBatch], asked: pa.Table, k: int, threshold: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest of each asked vector among a task's, which come in the order of their ids."""
    own = asked.column(0).combine_chunks()
    tiles = []
    for length, (rows, matrix) in _by_length(asked.column(1).combine_chunks()).items():
        for i in range(0, len(rows), TILE):
            tiles.append(_Tile(rows[i : i + TILE], matrix[i : i + TILE], length, k, threshold, pa.array([], kind)))
    lengths = {t.length for t in tiles}
    first = True
    for batch in batches:
        done, width = 0, max(1, pc.max(pc.list_value_length(batch.column(1))).as_py() or 0)
        while done < batch.num_rows:
            part = batch.slice(done, FIRST if first else max(FIRST, READ // width))
            done += part.num_rows
            first = False
            ids, kinds, ready = part.column(0).cast(kind), _by_length(part.column(1)), {}
            for length in lengths & kinds.keys() - {-1}:
                rows, matrix = kinds[length]
                kept = _few_copies(matrix, k)
                kinds[length] = rows, matrix = rows[kept], matrix[kept]
                with np.errstate(over="ignore", invalid="ignore"):
                    squares = np.square(matrix).sum(axis=1)
                is_plain = squares < LARGE
                plain = np.flatnonzero(is_plain)
                right = np.hstack([matrix[plain], np.ones((len(plain), 1)), squares[plain, None]])
                ready[length] = plain, right, squares[plain].max(initial=0.0), np.flatnonzero(~is_plain)
            for tile in tiles:
                tile.take(kinds, ready, ids)
    for tile in tiles:
        if len(tile.query):
            far = pa.array(tile.far, mask=np.isneginf(tile.far))
            yield pa.RecordBatch.from_arrays([own.take(pa.array(tile.rows[tile.query])), tile.ids, far], names=["query_id", "chunk_id", "distance"])


def knn(queries: DataFrame, vectors: DataFrame, k: int, threshold: float = -1.0, query_id: str = "query_id", vector_id: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """``(query_id, chunk_id, rank, distance)``: the ``k`` nearest of each query by L2 distance, to six places; ties by id.

    A positive ``threshold`` drops neighbours farther away.  All queries are
    compared with all vectors, in blocks of ``BLOCK`` queries: a task rules
    pairs out by matrix products, with room for what these round, measures the
    others by differences, and keeps its own ``k`` best of a query.  Vectors of
    another length than the query, or with a null, have no distance and come
    first.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).alias("query_id"), F.col(column).alias("q")).where("q is not null")
    v = vectors.select(F.col(vector_id).alias("chunk_id"), F.col(column).alias("v")).where("v is not null")
    kinds = [df.schema[c].dataType for df, c in ((q, "query_id"), (v, "chunk_id"))]
    own, kind = map(to_arrow_type, kinds)
    schema = f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, distance double"
    n = max(1, -(-q.count() * max(1, k // 64) // BLOCK))
    blocks = [q if n == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]
    parts = max(v.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)  # a file may be one split
    dealt = v.repartition(parts, "chunk_id").sortWithinPartitions("chunk_id")

    def block(part: DataFrame) -> DataFrame:
        table = part.toArrow()
        sent = spark.sparkContext.broadcast(table.set_column(0, "query_id", table.column(0).cast(own)))
        return dealt.mapInArrow(lambda batches: _nearest(batches, sent.value, k, threshold, kind), schema)

    near = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    found = reduce(DataFrame.unionByName, map(block, blocks)).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    return found.select("query_id", "chunk_id", "rank", "distance")


def min_distance(queries: DataFrame, vectors: DataFrame, **options) -> DataFrame:
    """``(query_id, min_distance)`` of the raw query, no threshold and no fusion."""
    return knn(queries, vectors, 1, **options).select("query_id", F.col("distance").alias("min_distance"))
