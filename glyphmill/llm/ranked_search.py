"""Ranked lexical search by hashed max-sketches: upper bounds for all items at once, exact scores where they matter."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.shared import materialise, small_batches

#: Coordinates of a sketch for each distinct term of its document, at least; a power of two in all.
SPARSE = 8
#: Occurrences from which on a coordinate says "many".
MANY = 255
#: Items that are searched for at a time, and their terms: what every task gets.
ITEMS, TERMS = 1_000, 50_000
#: A search of one row in so many finds where the search of all starts.
FIRST = 32
#: Cells of the table of documents by query terms that a task fills at a time.
CELLS = 1_000_000
#: Maps what is no letter, digit or beyond ASCII to a space, and A-Z to a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters, digits and anything beyond ASCII, A-Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term)


def sketch(counts: dict[bytes, int]) -> bytes:
    """The sketch of a document's term counts.

    A term's impact grows with its count and depends on nothing else within a
    document, so each coordinate keeps the largest count of the terms hashed to
    it, which is the maximum of their impacts for any corpus: the sketch stays
    right when documents are added.  Counts beyond MANY - 1 are MANY.  There are
    at least SPARSE coordinates a term; a document without terms has none.
    """
    if not counts:
        return b""
    width = 1 << (SPARSE * len(counts) - 1).bit_length()
    at = np.fromiter(map(_hash, counts), np.uint64, len(counts)) & np.uint64(width - 1)
    out = np.zeros(width, np.uint8)
    np.maximum.at(out, at.astype(np.int64), np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), MANY).astype(np.uint8))
    return out.tobytes()


def _counted(found: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for t in found:
        out[t] = out.get(t, 0) + 1
    return out


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_terms, sketch, text)`` of each row of ``docs``, as a written table.

    It holds no statistics of the corpus, so tables of further documents can be
    put beside it.
    """
    small_batches(docs.sparkSession)
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {frame.schema['id'].dataType.simpleString()}, n_terms long, sketch binary, text string"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sketches = [], []
            for text in batch.column(1):
                found = terms(text.as_py())
                sizes.append(len(found))
                sketches.append(sketch(_counted(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), batch.column(1)], names=["id", "n_terms", "sketch", "text"])

    return materialise(frame.mapInArrow(apply, schema), "search-index")


def _document_counts(index: DataFrame, wanted) -> dict[bytes, int]:
    """How many rows of ``index`` hold each term of the broadcast set ``wanted``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = wanted.value, {}
        for batch in batches:
            for text in batch.column(0):
                for t in known.intersection(terms(text.as_py())):
                    found[t] = found.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    rows = index.select("text").mapInArrow(apply, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # TERMS rows at most
    return {bytes(r["term"]): r["df"] for r in rows}


class Queries:
    """A block of items: for each its terms and their weights, flat and by item."""

    def __init__(self, items: list[list[bytes]], df: dict[bytes, int], rows: int, length: int):
        self.rows, self.length = rows, length
        names = sorted({t for item in items for t in item})
        at = {t: i for i, t in enumerate(names)}
        self.names = names
        self.weight = np.array([math.floor(1000 * math.log((2 * rows + 2) / (2 * df.get(t, 0) + 1))) for t in names], np.int64)
        self.hashes = np.fromiter(map(_hash, names), np.uint64, len(names))
        held = np.array([t in df for t in names], bool)
        own = [np.array([at[t] for t in item if held[at[t]]], np.int64) for item in items]
        self.live = np.array([i for i, o in enumerate(own) if len(o)], np.int64)  # items of which no document holds a term have no result
        self.own = [own[i] for i in self.live]
        self.flat = np.concatenate(self.own) if self.own else np.zeros(0, np.int64)
        self.begins = np.concatenate(([0], np.cumsum([len(o) for o in self.own])[:-1])).astype(np.int64) if self.own else np.zeros(0, np.int64)

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """Each document's m by its number of terms."""
        return 10 + np.array([90 * int(x) * self.rows // self.length for x in n], np.int64)

    def bounds(self, sketches: np.ndarray, m: np.ndarray) -> np.ndarray:
        """For each of some sketches of one width (rows) and each item, what no score exceeds."""
        seen = sketches[:, (self.hashes & np.uint64(sketches.shape[1] - 1)).astype(np.int64)].astype(np.float64)
        most = np.where(seen == MANY, 1e6, 1e9 * seen / (1000 * seen + 8 * m[:, None])) * self.weight
        return np.add.reduceat(most[:, self.flat], self.begins, axis=1) * (1 + 1e-9)

    def score(self, counts: dict[bytes, int], m: int, item: int) -> int:
        total = 0
        for t in self.own[item].tolist():
            tf = counts.get(self.names[t])
            if tf:
                total += int(self.weight[t]) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        return total


def _search(index: DataFrame, queries, k: int, least, id_type: str) -> DataFrame:
    """``(item, id, score)``: for each item the k best of every task, which are all of the k best of all.

    A batch's bounds are found in one go; then each item's documents are scored
    exactly in descending order of bounds until these fall below what k
    documents are known to reach (``least``, or the task's own k-th score).
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = queries.value
        floor = least.value.copy()
        best: list[list[tuple[int, object]]] = [[] for _ in q.live]
        full = lambda x: (-x[0], x[1] is not None, x[1] if x[1] is not None else 0)  # noqa: E731  null ids first

        def look(batch: pa.RecordBatch) -> None:
            ids, texts = batch.column(0).to_pylist(), batch.column(3)
            sizes = batch.column(1).to_numpy()
            m = q.lengths(sizes)
            sketches = batch.column(2)
            widths = np.array([len(s) for s in sketches.to_pylist()])
            counted: dict[int, dict[bytes, int]] = {}
            for width in np.unique(widths[widths > 0]):
                rows = np.flatnonzero(widths == width)
                step = max(1, CELLS // max(len(q.weight), len(q.flat), int(width)))
                for part in np.split(rows, range(step, len(rows), step)):
                    grid = np.frombuffer(b"".join(sketches[int(i)].as_py() for i in part), np.uint8).reshape(len(part), -1)
                    bounds = q.bounds(grid, m[part])
                    for item in np.flatnonzero((bounds >= np.maximum(floor, 1)).any(axis=0)):
                        own, mine = bounds[:, item], best[item]
                        for d in np.argsort(-own, kind="stable"):
                            if own[d] < max(floor[item], 1):
                                break
                            row = int(part[d])
                            if row not in counted:
                                counted[row] = _counted(terms(texts[row].as_py()))
                            score = q.score(counted[row], int(m[row]), int(item))
                            if score > 0:
                                mine.append((score, ids[row]))
                                if len(mine) > 4 * k:
                                    mine.sort(key=full)
                                    del mine[k:]
                                    floor[item] = max(floor[item], mine[-1][0])
                        if len(mine) >= k:
                            mine.sort(key=full)
                            del mine[k:]
                            floor[item] = max(floor[item], mine[-1][0])

        for batch in batches:
            look(batch)
        found = [(int(q.live[i]), d, s) for i, mine in enumerate(best) for s, d in sorted(mine, key=full)[:k]]
        columns = zip(*found) if found else ([], [], [])
        types = (pa.int32(), id_arrow, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["item", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(index.schema["id"].dataType)
    return index.select("id", "n_terms", "sketch", "text").mapInArrow(apply, f"item int, id {id_type}, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item id, rank, id, score)``: the ``k`` best rows of ``index`` for each row of ``items``, those with a score above 0.

    With N rows that have terms, L terms in all, n in a document, and df rows
    that hold a term, a term weighs ``floor(1000 ln((2N+2)/(2df+1)))`` and adds
    its weight times ``10^9 tf div (1000 tf + 8 m)`` where ``m = 10 + 90 n N div
    L``; an item's terms count once.  Equal scores rank by id, null first.

    Items are taken in blocks of at most ITEMS rows and about TERMS terms.  A
    first search among one row in FIRST finds what score k rows reach; the
    search of all rows starts there, so that most are ruled out by their bounds.
    Null items and items without terms have no result; repeated items are
    answered repeatedly.
    """
    spark = index.sparkSession
    sc = spark.sparkContext
    totals = index.agg(F.count_if(F.col("n_terms") > 0), F.sum("n_terms")).first()
    rows, length = totals[0], totals[1] or 0
    id_type = index.schema["id"].dataType.simpleString()
    item_type = items.schema[id_col].dataType.simpleString()
    found, block, names = [], [], set()

    def finish() -> None:
        wanted = sc.broadcast(frozenset(names))
        queries = Queries([t for _, t in block], _document_counts(index, wanted), rows, length)
        if len(queries.live):
            sent = sc.broadcast(queries)
            least = np.zeros(len(queries.live), np.int64)
            first = _top(_search(index.where(F.pmod(F.xxhash64("sketch"), F.lit(FIRST)) == 0), sent, k, sc.broadcast(least), id_type), k)
            for r in first.where(F.col("rank") == k).select("item", "score").collect():  # one row an item
                least[np.searchsorted(queries.live, r["item"])] = r["score"]
            best = _top(_search(index, sent, k, sc.broadcast(least), id_type), k)
            keys = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item int, name {item_type}")
            found.append(best.join(F.broadcast(keys), "item").select(F.col("name").alias(id_col), "rank", "id", "score"))
        block.clear()
        names.clear()

    if rows:
        for r in items.select(id_col, text_col).toLocalIterator():
            own = sorted(set(terms(r[1])))
            if own:
                if block and (len(block) >= ITEMS or len(names) + len(own) > TERMS):
                    finish()
                block.append((r[0], own))
                names.update(own)
        if block:
            finish()
    empty = spark.createDataFrame([], f"{id_col} {item_type}, rank int, id {id_type}, score long")
    out = found[0] if found else empty
    for more in found[1:]:
        out = out.unionByName(more)
    return out
