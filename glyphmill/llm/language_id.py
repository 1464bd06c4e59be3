"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.shared import returning, small_batches

#: Bounds of the labelled sample: documents and UTF-8 bytes per language, and languages.
SAMPLE_DOCS, SAMPLE_BYTES, MAX_LANGUAGES = 64, 48_000, 400
#: Texts are parsed in blocks of this many bytes side by side, whose joins are then put right.
BLOCK = 512
#: Bytes of normalised text that a task parses at a time.
SLICE = 1_000_000
_LETTER = re.compile(r"[^\W\d_]")
_TO_LETTERS = bytes(i if 97 <= i <= 122 or i > 127 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))


def normalise(text: str | None) -> bytes:
    """Lower-cased UTF-8, runs of ASCII non-letters as one space; empty if there is no letter at all."""
    if not text or not _LETTER.search(text):
        return b""
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TO_LETTERS).split()) + b" "


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of ``data``; state 0 is the start."""
    move, link, length, last = [{}], [-1], [0], 0
    for c in data:
        now = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = now
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return move


class CrossParser:
    """Automata of all languages as one table each: ``(state, byte class)`` to the next state.

    A negative entry ``-1 - s`` means: the longest match ends before this byte,
    a new phrase starts with it, and ``s`` is the state after it.
    """

    def __init__(self, texts: dict[str, bytes]):
        self.names = sorted(texts)
        seen = sorted(set().union(*texts.values())) if texts else []
        self.classes = np.zeros(256, np.uint8)  # one class is left for bytes unseen; UTF-8 never uses all 256
        for k, b in enumerate(seen):
            self.classes[b] = k + 1
        self.width = len(seen) + 1
        self.tables = []
        for name in self.names:
            move = suffix_automaton(texts[name])
            start = np.zeros(self.width, np.int32)
            for c, s in move[0].items():
                start[self.classes[c]] = s
            table = np.tile(-1 - start, (len(move), 1))
            for s in range(1, len(move)):  # whatever leaves the start begins a phrase
                for c, t in move[s].items():
                    table[s, self.classes[c]] = t
            self.tables.append(table.ravel())

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases per text and language, whole texts: row by text, column by language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.names)), np.int64)
        if not sizes.any():
            return out
        data = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        n_blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        first = (np.cumsum(sizes) - sizes)[owner] + inner * BLOCK
        last = np.minimum(first + BLOCK, np.cumsum(sizes)[owner])
        filled = np.flatnonzero(sizes)
        for k, table in enumerate(self.tables):
            begins = self._begins(table, data, first, last, inner > 0)
            out[filled, k] = np.add.reduceat(begins, (np.cumsum(sizes) - sizes)[filled], dtype=np.int64)
        return out

    def _begins(self, table: np.ndarray, data: np.ndarray, first: np.ndarray, last: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Where phrases begin.

        Each block is parsed as if a phrase began with it, then again from the
        state in which the block before it ends, until a phrase begins where
        one began before: from there on both agree.  Blocks in which this does
        not happen hand on another state; those after them are parsed once more.
        """
        held = bytearray(len(data))
        begins = np.frombuffer(held, np.uint8)
        entry, leave = np.zeros(len(first), np.int32), np.zeros(len(first), np.int32)

        def parse(lane: np.ndarray, state: np.ndarray) -> None:
            at, stop = first[lane], last[lane]
            while len(lane):
                step = table[state * self.width + data[at]]
                begun = step < 0
                met = begun & (begins[at] != 0)
                begins[at] = begun
                state = np.where(begun, -1 - step, step)
                at = at + 1
                over = at == stop
                if (done := met | over).any():
                    ended = over & ~met
                    leave[lane[ended]] = state[ended]
                    going = ~done
                    lane, at, stop, state = lane[going], at[going], stop[going], state[going]

        parse(np.arange(len(first)), entry)
        again = np.flatnonzero(follows)
        entry[again] = leave[again - 1]
        parse(again, entry[again])
        rows, letters = memoryview(table), memoryview(data)
        for k in np.flatnonzero(follows & (entry != np.append(0, leave[:-1]))).tolist():
            while k < len(first) and follows[k] and entry[k] != leave[k - 1]:
                entry[k] = state = int(leave[k - 1])
                for at in range(int(first[k]), int(last[k])):
                    step = rows[state * self.width + letters[at]]
                    if step >= 0:
                        held[at], state = 0, step
                    elif held[at]:
                        break
                    else:
                        held[at], state = 1, -1 - step
                else:
                    leave[k] = state
                k += 1
        return begins


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> CrossParser:
    """Automata from a bounded sample of labelled rows.

    Per language the ``sample_docs`` rows of smallest hashed id are taken, of
    those up to ``4 * sample_bytes`` characters if there are any, else the
    shortest.  Of their normalised texts, whole ones count in that order as long
    as they fit in ``sample_bytes``; where none fits, the shortest, cut to the
    bound.  Of rows that repeat an id, one counts.  Rows without label or text
    don't count; ``docs`` must hold training rows only.  More than
    ``MAX_LANGUAGES`` labels are an error.
    """
    lang, h, size = F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.length(text_col)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    long = F.greatest(size - 4 * sample_bytes, F.lit(0)).alias("long")
    order = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "id"))
    picked = rows.select(lang, h, long, F.col(id_col).alias("id")).withColumn("k", order)
    picked = picked.where(F.col("k") <= sample_docs).select("lang", "h", "long").distinct()
    some = picked.select("lang").distinct().limit(MAX_LANGUAGES + 1)
    if some.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    texts = rows.select(lang, h, long, F.substring(text_col, 1, 4 * sample_bytes).alias("text"))
    texts = texts.join(F.broadcast(picked), ["lang", "h", "long"]).groupBy("lang", "h").agg(F.min("text"))  # MAX_LANGUAGES * sample_docs rows at most
    by: dict[str, list[tuple[int, bytes]]] = {}
    for lang, h, text in texts.toLocalIterator():
        if data := normalise(text):
            by.setdefault(lang, []).append((h, data))
    chosen = {}
    for lang, found in by.items():
        total, kept = 0, []
        for _, data in sorted(found):
            if total + len(data) <= sample_bytes:
                total += len(data)
                kept.append(data)
        chosen[lang] = b"".join(kept) or min((d for _, d in found), key=len)[:sample_bytes]
    return CrossParser(chosen)


def identify(docs: DataFrame, parser: CrossParser, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) with ``lang_pred``, ``score`` and ``phrase_bytes``.

    Every whole normalised text is cut greedily into longest matches with each
    language's automaton; the language needing the fewest phrases wins (ties:
    the name that sorts first).  ``score`` is the winner's share of the inverse
    phrase counts, 0 to 1; ``phrase_bytes`` the mean phrase length for the
    winner.  ``und`` with score 0 if the text is null or has no letter, or
    nothing was learned.  Input columns of these names are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for batch in batches:
            lang, score, mean = [], [], []
            at, texts = 0, batch.tolist()
            while at < len(texts):  # by size, as texts differ in length
                data, size = [], 0
                while at < len(texts) and size < SLICE:
                    data.append(normalise(texts[at]))
                    size += len(data[-1])
                    at += 1
                own = {d: i for i, d in enumerate(dict.fromkeys(data))}  # copies are parsed once
                counts = p.phrases(list(own))[[own[d] for d in data]] if p.names else None
                for i, d in enumerate(data):
                    if not d or counts is None:
                        lang.append("und"), score.append(0.0), mean.append(math.nan)
                        continue
                    k = int(counts[i].argmin())
                    lang.append(p.names[k])
                    score.append(float(1 / counts[i, k] / (1 / counts[i]).sum()))
                    mean.append(len(d) / counts[i, k])
            yield pd.DataFrame({"lang_pred": lang, "score": score, "phrase_bytes": mean})

    @F.pandas_udf("lang_pred string, score double, phrase_bytes double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from returning(found(batches))

    names = ("lang_pred", "score", "phrase_bytes")
    carried = [c for c in (docs.columns if carry is None else carry) if c not in names]
    out = docs.select(*carried, predict(text_col).alias("__p"))
    return out.select(*carried, "__p.lang_pred", "__p.score", F.nanvl("__p.phrase_bytes", F.lit(None).cast("double")).alias("phrase_bytes"))
