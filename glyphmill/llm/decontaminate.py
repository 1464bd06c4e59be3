"""Benchmark decontamination: a broadcast set of hashed test n-grams, scanned and verified."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.shared import returning, small_batches

#: Words of benchmark text that one broadcast may hold; larger benchmarks are taken in blocks, one scan each.
BLOCK_WORDS = 2_000_000
_GAPS = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the runs of digits, letters and non-ASCII characters, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_GAPS).split()


class Windows:
    """The windows of some benchmark items: word numbers, hashes by length, and the items of each window."""

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.words: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            own = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            n = min(window, len(own))
            for i in range(len(own) - n + 1 if own else 0):
                self.items[tuple(own[i : i + n])].add(item)
        by_length = defaultdict(list)
        for w in self.items:
            by_length[len(w)].append(w)
        self.hashes = {n: np.unique(self._roll(np.array(ws, dtype=np.uint64).T)) for n, ws in sorted(by_length.items())}

    def _roll(self, columns: np.ndarray) -> np.ndarray:
        h = np.zeros(columns.shape[1], np.uint64)
        for c in columns:
            h = (h ^ (c * self.STEP)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return h

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie in a window, and the items whose windows occur."""
        hit, items = np.zeros(len(words), bool), set()
        get = self.words.get
        own = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        known = np.concatenate(([0], np.cumsum(own > 0)))
        for n, hashes in self.hashes.items():
            if len(own) < n:
                break
            start = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(start):
                continue
            rolled = self._roll(np.stack([own[start + j] for j in range(n)]))
            at = np.searchsorted(hashes, rolled)
            for i in start[hashes[np.minimum(at, len(hashes) - 1)] == rolled]:
                found = self.items.get(tuple(own[i : i + n].tolist()))  # verified word by word
                if found is not None:
                    hit[i : i + n] = True
                    items |= found
        return hit, items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[DataFrame]:
    """The benchmark, dealt by item into as many blocks as keep each within ``block_words`` (about; an item stays whole)."""
    b = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    letters = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-letters // (4 * block_words)))
    for k in range(n):
        yield b if n == 1 else b.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_words: int = BLOCK_WORDS,
    carry: list[str] | None = None,
) -> DataFrame:
    """Each row of ``docs`` (columns ``carry``, by default the id) with what it shares with the benchmark.

    Adds ``n_words``, ``spans`` (maximal runs of hit words, ``begin`` to ``end``
    as word numbers, end excluded), ``n_hit`` and ``items`` (ids of items with
    an occurring window, as strings, sorted).  A window is ``window``
    consecutive words of an item, or all of a shorter item's words.  A null
    text has no words, an item without words no window, and a row without id or
    text in the benchmark is left out.

    The windows of a block of the benchmark, bounded by ``block_words`` words,
    are broadcast; documents are scanned where they lie, without a shuffle, once
    per block.
    """
    carry = [id_col] if carry is None else carry
    spark = docs.sparkSession
    small_batches(spark)
    keep = [f"__c{i}" for i in range(len(carry))]
    frame = docs.select(*[F.col(c).alias(k) for c, k in zip(carry, keep)], F.col(text_col).alias("__text"))
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    frame = frame.withColumns({"__n": F.lit(None).cast("long"), "__spans": F.lit(None).cast(span), "__items": F.lit(None).cast("array<string>")})
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        shared = spark.sparkContext.broadcast(Windows([tuple(r) for r in block.collect()], window))

        def apply(batches, shared=shared):
            windows = shared.value
            for batch in batches:
                names = batch.schema.names
                cols = {n: batch.column(i) for i, n in enumerate(names)}
                n_words, spans, items = [], [], []
                for text, old_spans, old_items in zip(*(cols[c] for c in ("__text", "__spans", "__items"))):
                    words = words_of(text.as_py())
                    hit, found = windows.scan(words)
                    for s in old_spans.as_py() or ():
                        hit[s["begin"] : s["end"]] = True
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
                    n_words.append(len(words))
                    spans.append([{"begin": b, "end": e} for b, e in zip(edges[::2], edges[1::2])])
                    items.append(sorted(found.union(old_items.as_py() or ())))
                cols |= {"__n": pa.array(n_words, pa.int64()), "__spans": pa.array(spans, batch.schema.field("__spans").type), "__items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

        frame = frame.mapInArrow(lambda batches, run=apply: returning(run(batches)), frame.schema)
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return frame.select(
        *[F.col(k).alias(c) for c, k in zip(carry, keep)],
        F.col("__n").alias("n_words"), F.col("__spans").alias("spans"), n_hit.alias("n_hit"), F.col("__items").alias("items"),
    )


def items_digest(items: list[str]) -> str:
    """SHA-256 of the sorted item ids, comma-joined."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their columns."""
    scanned = scan(docs.withColumnsRenamed({"n_words": "__own_n", "spans": "__own_spans", "n_hit": "__own_hit", "items": "__own_items"}), benchmark, **options,
                   carry=[{"n_words": "__own_n", "spans": "__own_spans", "n_hit": "__own_hit", "items": "__own_items"}.get(c, c) for c in docs.columns])
    back = {"__own_n": "n_words", "__own_spans": "spans", "__own_hit": "n_hit", "__own_items": "items"}
    clean = scanned.where("n_hit = 0").drop("n_words", "spans", "n_hit", "items").withColumnsRenamed(back)
    return clean.select(*docs.columns)


def cut_spans(text: str | None, spans) -> str | None:
    """``text`` without the characters from the first to the last word of each span."""
    if text is None or spans is None or not len(spans):
        return text
    places, out, at = [m.span() for m in _WORD.finditer(text)], [], 0
    for s in spans:
        out.append(text[at : places[s["begin"]][0]])
        at = places[s["end"] - 1][1]
    return "".join([*out, text[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, text)`` of every row, benchmark passages cut out of the texts (:func:`cut_spans`)."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([cut_spans(t, s) for t, s in zip(texts, spans)], dtype=object)

    found = scan(docs, benchmark, id_col=id_col, text_col=text_col, carry=[id_col, text_col], **options)
    text = F.when(F.col("n_hit") > 0, cut(text_col, "spans")).otherwise(F.col(text_col))
    return found.select(id_col, text.alias(text_col))
