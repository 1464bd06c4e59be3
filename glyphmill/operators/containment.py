"""Which of many texts hold which of many needles, in one reading of the texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of the needles that an automaton is made of; more take further readings of the texts.
BLOCK_CHARS = 1_000_000


@lru_cache(maxsize=2)
def _automaton(needles: tuple[str, ...]):
    """An automaton that names the place in ``needles`` of each that it meets."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, needle in enumerate(needles):
        found.add_word(needle, i)
    found.make_automaton()
    return found


def _block(texts: DataFrame, needles: list[tuple[object, str]], text_id: str, text_col: str, needle_id: str, kind) -> DataFrame:
    """Pairs for the needles of one automaton; equal needles are one pattern of several ids."""
    ids: dict[str, list] = {}
    for i, needle in needles:
        ids.setdefault(needle, []).append(i)
    sent = texts.sparkSession.sparkContext.broadcast((tuple(ids), list(ids.values())))
    rows = texts.select(F.col(text_id).alias("t"), F.col(text_col).alias("text")).where("text is not null")
    kinds = to_arrow_type(kind), to_arrow_type(rows.schema["t"].dataType)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, named = sent.value
        automaton = _automaton(patterns)
        for batch in batches:
            met: tuple[list, list] = ([], [])
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for p in {p for _, p in automaton.iter(text.as_py())}:
                    met[0].extend(named[p])
                    met[1].extend([i] * len(named[p]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(met, kinds)], names=["n", "t"])

    schema = f"n {kind.simpleString()}, t {rows.schema['t'].dataType.simpleString()}"
    return rows.mapInArrow(apply, schema).select(F.col("n").alias(needle_id), F.col("t").alias(text_id))


def contained(texts: DataFrame, needles: DataFrame, text_id: str = "source", text_col: str = "text", needle_id: str = "query_id", needle_col: str = "needle", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(needle_id, text_id)`` for each needle that is part of a text, once for each row of both.

    The needles go into automata of bounded size, one after another; each reads
    every text once, whatever the number of needles, and no pair is compared.
    Null and empty needles are part of none.
    """
    kind = needles.schema[needle_id].dataType
    blocks: list[list] = [[]]
    size = 0
    for row in needles.select(needle_id, needle_col).where(F.length(needle_col) > 0).toLocalIterator():
        if blocks[-1] and size + len(row[1]) > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((row[0], row[1]))
        size += len(row[1])
    if not blocks[0]:
        return texts.select(F.lit(None).cast(kind).alias(needle_id), F.col(text_id)).where("false")
    return reduce(DataFrame.unionByName, [_block(texts, b, text_id, text_col, needle_id, kind) for b in blocks])
