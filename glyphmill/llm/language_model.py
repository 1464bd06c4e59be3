"""Katz backoff language model: Good-Turing discounted bigrams over exactly normalised backoff."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.shared import materialise, small_batches

#: The most frequent words that every task knows by number and count (two bytes a number).
HOT_WORDS = 65_000
#: Numbers below HOT: hot words by falling count; START: the history of a text's first token.  Above: ids of other words.
HOT, START = 65_536, 65_535
#: A word this share of a partition's tokens deals its continuations out by the word as well,
SHARE = 1 / 8
#: and bigrams of two such words, of the first so many, are dealt out over all partitions, each of which counts a part.
SPLIT = 512
#: Counts up to this are discounted.
CUT = 5
#: Tokens that a task holds at a time, and that a partition of the model is planned for.
FLUSH, PER_PARTITION = 900_000, 1_600_000
_END = b"\n"
_TOP = 1 << 63


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, runs of anything but ``[\\x20\\x09-\\x0D]``, then the end token."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), _END]


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's Good-Turing factors for counts ``0..CUT`` from the numbers ``n[1..CUT+1]`` of types with each count.

    Where a factor isn't within (0, 1], as on small or odd data, all counts but
    one go undiscounted and singletons keep half.
    """
    d = np.ones(CUT + 1)
    n = n.astype(np.float64)
    if (n[1 : CUT + 2] > 0).all():
        common = (CUT + 1) * n[CUT + 1] / n[1]
        r = np.arange(1, CUT + 1)
        d[1:] = ((r + 1) * n[2 : CUT + 2] / (r * n[1 : CUT + 1]) - common) / (1 - common) if common != 1 else -1
        if ((d[1:] > 0) & (d[1:] <= 1)).all() and d[1] < 1:
            return d
    return np.array([1, 0.5] + [1.0] * (CUT - 1))


class Unigrams:
    """The lower order: discounted relative counts, the mass left going to unknown words as one class."""

    def __init__(self, tokens: int, types: int, count_of: np.ndarray, mass: float | None = None):
        self.tokens, self.types = tokens, types
        self.d = discounts(count_of)
        r = np.arange(CUT + 1)
        low = (count_of[: CUT + 1] * r).astype(np.float64)
        seen = ((low * self.d).sum() + tokens - low.sum()) / tokens if tokens else 0.0
        self.scale, self.unknown = (1.0, 1 - seen) if seen < 1 - 1e-12 else (tokens / (tokens + 1), 1 / (tokens + 1))

    def probability(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(np.float64)
        p = self.scale * np.where(counts <= CUT, self.d[np.minimum(counts, CUT).astype(np.int64)], 1.0) * c / max(1, self.tokens)
        return np.where(counts > 0, p, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the add-half probability, unknown words being one more type."""
        return np.log10((counts.astype(np.float64) + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each one's bytes dealt into planes so that small numbers compress well."""
    planes = [(a.dtype.str, len(a), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, 5))


def _unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, data in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        dtype = np.dtype(kind)
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Heat(NamedTuple):
    """How many of the hot words, by falling count, are dealt out as histories, and how many in pairs."""

    salted: int
    split: int


def _split(h: np.ndarray, w: np.ndarray, heat: Heat) -> np.ndarray:
    return ((h < heat.split) | (h == START)) & (w < heat.split)


def _home(h: np.ndarray, w: np.ndarray, parts: int, heat: Heat, task: int = 0) -> np.ndarray:
    """The partition of a bigram: by history; by both words for frequent histories; by the task too for pairs of frequent words."""
    salted = (h < heat.salted) | (h == START)
    key = np.where(salted, _mix(h) + w, h)
    return (_mix(np.where(_split(h, w, heat), key + np.uint64(task), key)) % np.uint64(parts)).astype(np.int64)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys made one, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    runs = _runs(keys) if len(keys) else np.zeros(0, np.int64)
    return keys[runs], np.add.reduceat(counts, runs) if len(runs) else counts


def _histogram(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, CUT + 2), minlength=CUT + 3)[: CUT + 2].astype(np.float64)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """``(w, c)``: the 64-bit XXH64 of every token and its count."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes({})
        for batch in batches:
            found, size = [], 0
            for k, text in enumerate(batch.column(0)):
                words = words_of(text.as_py())
                found.append(np.fromiter((codes[w] for w in words), np.uint64, len(words)))
                size += len(words)
                if size >= FLUSH or k == batch.num_rows - 1:
                    w, c = np.unique(np.concatenate(found), return_counts=True)
                    found, size = [], 0
                    for at in range(0, len(w), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(w[at : at + 100_000].view(np.int64)), pa.array(c[at : at + 100_000])], names=["w", "c"])

    return docs.select(text_col).mapInArrow(apply, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


class _Codes(dict):
    """Words to numbers: hot words by rank, others by hash with the top bit set."""

    def __init__(self, hot: dict[int, int]):
        super().__init__()
        self.hot = hot

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word) | _TOP
        self[word] = code = self.hot.get(h, h)
        return code


def _deal(texts: Iterator[tuple], hot: dict[int, int], hot_counts: np.ndarray, uni: Unigrams, heat: Heat, parts: int, task: int):
    """``(partition, kind, blob)`` of a task's texts ``(id, text, train)``.

    Kinds: ``m`` what is known of its documents, to their home; ``h`` bigrams
    whose word is hot, to the history's partition; ``w`` the others, to the
    word's partition, where its count is found.
    """
    codes, number = _Codes(hot), 0
    logs, done = uni.base(hot_counts), False
    while not done:
        rows, found, size = [], [], 0
        done = True
        for doc, text, train in texts:
            words = words_of(text)
            code = np.fromiter((codes[w] for w in words), np.uint64, len(words))
            found.append(code)
            rows.append((doc, not train, len(code)))
            size += len(code)
            if size >= FLUSH:
                done = False
                break
        if not rows:
            return
        w = np.concatenate(found)
        lengths = np.array([r[2] for r in rows])
        starts = np.cumsum(lengths) - lengths
        h = np.concatenate(([START], w[:-1])).astype(np.uint64)
        h[starts] = START
        local = np.repeat(np.arange(number, number + len(rows)), lengths)
        held = np.repeat(np.array([r[1] for r in rows]), lengths)
        doc = (local * 2 + held).astype(np.uint32)
        common = w < HOT
        of_hot = hot_counts[np.where(common, w, 0).astype(np.int64)]
        known = common & (of_hot > 0)
        base = np.bincount(local - number, np.where(known, logs[np.where(common, w, 0).astype(np.int64)], 0), len(rows))
        n_known = np.bincount(local - number, known, len(rows))
        yield task % parts, "m", pickle.dumps((task, number, [r[:2] for r in rows], lengths, base, n_known), 5)
        number += len(rows)
        for kind, some in (("h", common), ("w", ~common)):
            ws, hs, ds = w[some], h[some], doc[some]
            home = _home(hs, ws, parts, heat, task) if kind == "h" else (_mix(ws) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((ws, hs, home) if kind == "h" else (hs, ws, home))
            ws, hs, ds, home = ws[order], hs[order], ds[order], home[order]
            edges = np.searchsorted(home, np.arange(parts + 1))
            for p in range(parts):
                a, b = edges[p], edges[p + 1]
                if a == b:
                    continue
                first, second = (hs[a:b], ws[a:b]) if kind == "h" else (ws[a:b], hs[a:b])
                runs = _runs(first)
                size_of = np.diff(np.append(runs, b - a)).astype(np.uint32)
                yield p, kind, pickle.dumps((task, _pack(first[runs], size_of, second, ds[a:b])), 5)


def _look_up(rows, uni: Unigrams, heat: Heat, parts: int):
    """A word partition's bigrams with their words' counts, on to the history's partition; base scores to the documents' homes."""
    w, h, doc, task = _gather((pickle.loads(blob) for kind, blob in rows if kind == "w"), word_first=True)
    if not len(w):
        return
    part = TaskContext.get().partitionId()
    order = np.argsort(w, kind="stable")
    w, h, doc, task = w[order], h[order], doc[order], task[order]
    runs = _runs(w)
    size_of = np.diff(np.append(runs, len(w)))
    counts = np.add.reduceat((doc & 1 == 0).astype(np.int64), runs)
    rank = np.repeat(np.arange(len(runs)), size_of)
    each = counts[rank]
    known = each > 0
    yield from _sums(task, doc, parts, np.where(known, uni.base(each), uni.base(np.zeros(1))[0]), known)
    number = (HOT + rank * parts + part).astype(np.uint64)
    home = _home(h, number, parts, heat)
    order = np.lexsort((number, h, task, home))
    h, number, doc, task, home, each = h[order], number[order], doc[order], task[order], home[order], each[order]
    for a, b in _pieces(home, task):
        runs = _runs(h[a:b])
        size_of = np.diff(np.append(runs, b - a)).astype(np.uint32)
        yield int(home[a]), ("r", pickle.dumps((int(task[a]), _pack(h[a:b][runs], size_of, number[a:b], doc[a:b], each[a:b].astype(np.uint32))), 5))


def _pieces(*columns: np.ndarray):
    runs = _runs(*columns) if len(columns[0]) else np.zeros(0, np.int64)
    return zip(runs.tolist(), [*runs[1:].tolist(), len(columns[0])])


def _gather(blobs, word_first: bool, counts: np.ndarray | None = None):
    """The bigrams of some blobs as columns; with ``counts`` those of hot words, a fifth column."""
    columns = [[], [], [], [], []]
    for task, packed in blobs:
        first, size_of, second, doc, *more = _unpack(packed)
        first = np.repeat(first, size_of)
        h, w = (second, first) if word_first else (first, second)
        own = [w, h, doc, np.full(len(w), task, np.uint32)]
        if counts is not None:
            own.append(more[0].astype(np.int64) if more else counts[w.astype(np.int64)])
        for c, x in zip(columns, own):
            c.append(x)
    kinds = (np.uint64, np.uint64, np.uint32, np.uint32, np.int64)[: 4 + (counts is not None)]
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(columns, kinds)]


def _sums(task: np.ndarray, doc: np.ndarray, parts: int, *values: np.ndarray):
    """Sums of ``values`` by document, to the documents' homes."""
    key = task.astype(np.uint64) << np.uint64(32) | (doc >> 1).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    runs = _runs(key) if len(key) else np.zeros(0, np.int64)
    docs = (key[runs] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    tasks = (key[runs] >> np.uint64(32)).astype(np.int64)
    sums = [np.add.reduceat(v[order].astype(np.float64), runs) if len(runs) else np.zeros(0) for v in values]
    for a, b in _pieces(tasks):
        kind = "b" if len(values) == 2 else "s"
        yield int(tasks[a]) % parts, (kind, pickle.dumps((int(tasks[a]), _pack(docs[a:b], *[s[a:b] for s in sums])), 5))


class _Histories:
    """A history partition's bigrams, counted."""

    def __init__(self, rows, hot_counts: np.ndarray, uni: Unigrams, heat: Heat):
        self.heat = heat
        blobs = (pickle.loads(blob) for kind, blob in rows if kind in "hr")
        w, h, doc, task, each = _gather(blobs, word_first=False, counts=hot_counts)
        order = np.lexsort((w, h))
        self.h, self.doc, self.task = h[order], doc[order], task[order]
        w, each = w[order], each[order]
        self.n = len(w)
        self.pair = _runs(self.h, w) if self.n else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.pair, self.n))
        self.count = np.add.reduceat((self.doc & 1 == 0).astype(np.int64), self.pair) if self.n else np.zeros(0, np.int64)
        self.lower = uni.probability(each[self.pair])
        self.own = self.h[self.pair]
        self.split = _split(self.own, w[self.pair], heat)
        self.key = (self.own << np.uint64(16)) | w[self.pair]  # tells pairs that are split
        self.start = _runs(self.own) if self.n else np.zeros(0, np.int64)

    def by_history(self) -> np.ndarray:
        """Per history: types with count 1 to CUT, the sum of larger counts, and the lower-order mass of its continuations; without pairs that are split."""
        return np.add.reduceat(_terms(self.count, self.lower) * ~self.split[:, None], self.start) if self.n else np.zeros((0, CUT + 2))

    def statistics(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of types by count (row 0) and what frequent histories' partitions add up to (rows 1 on); split pairs and their counts here."""
        out = np.zeros((self.heat.salted + 2, CUT + 2))
        out[0] = _histogram(self.count[~self.split])
        heads = self.own[self.start]
        salted = (heads < self.heat.salted) | (heads == START)
        out[_row(heads[salted], self.heat) + 1] += self.by_history()[salted]
        return out, *_added(self.key[self.split], self.count[self.split])

    def scores(self, d: np.ndarray, salted_sums: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(w | h) of every token: discounted relative count, or else the history's backoff weight times P(w)."""
        sums, heads = self.by_history(), self.own[self.start]
        salted = (heads < self.heat.salted) | (heads == START)
        sums[salted] = salted_sums[_row(heads[salted], self.heat)]
        self.count[self.split] = counts[np.searchsorted(keys, self.key[self.split])] if len(keys) else 0
        total, scale, weight = backoff(sums, d)
        per_pair = np.repeat(np.arange(len(heads)), np.diff(np.append(self.start, len(self.pair))))
        own = np.where(self.count <= CUT, d[np.minimum(self.count, CUT)], 1.0) * self.count / np.maximum(total, 1)[per_pair] * scale[per_pair]
        return np.repeat(np.log10(np.where(self.count > 0, own, weight[per_pair] * self.lower)), self.size)


def _terms(count: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """What each pair adds to its history's sums."""
    columns = [count == r for r in range(1, CUT + 1)] + [np.where(count > CUT, count, 0), np.where(count > 0, lower, 0)]
    return np.stack([c.astype(np.float64) for c in columns], axis=1)


def _row(heads: np.ndarray, heat: Heat) -> np.ndarray:
    return np.where(heads == START, heat.salted, heads).astype(np.int64)


def backoff(sums: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per history: its count, the factor on its discounted probabilities, and its exact backoff weight.

    A history whose continuations leave no mass has its denominator raised by
    one; an unknown history leaves all to the lower order.
    """
    r = np.arange(1, CUT + 1)
    total = (sums[:, :CUT] * r).sum(axis=1) + sums[:, CUT]
    kept = ((sums[:, :CUT] * r * d[1:]).sum(axis=1) + sums[:, CUT]) / np.maximum(total, 1)
    full = (total > 0) & (kept > 1 - 1e-12)
    scale = np.where(full, total / (total + 1), 1.0)
    left = np.where(full, 1 / (total + 1), 1 - kept)
    return total, scale, np.where(total > 0, left / np.maximum(1 - sums[:, CUT + 1], 1e-300), 1.0)


def _hot(words: DataFrame) -> list[tuple[int, int]]:
    """``(w, c)`` of the most frequent words by falling count: at most HOT_WORDS, as many whole classes of like counts as fit."""
    rank = F.floor(F.log2("c") * 16)
    total, least = 0, None
    for row in sorted(words.groupBy(rank.alias("r")).count().collect(), reverse=True):  # some hundred classes, whatever the counts
        total += row[1]
        if total > HOT_WORDS:
            break
        least = row.r
    found = [] if least is None else words.where(rank >= least).collect()
    return sorted(((r.w, r.c) for r in found), key=lambda x: (-x[1], x[0]))


def _at(key: int) -> int:
    return key


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", per_partition: int = PER_PARTITION) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    The model is a Katz bigram model learned from the rows where ``train`` is
    true (null: not): P(w | h) is the Good-Turing discounted relative count
    where the bigram was seen, else the history's backoff weight times P(w);
    the weights make every history sum to one exactly.  P(w) is the discounted
    unigram, with all unknown words as one class.  ``score`` is the log10
    probability of the text with its end; ``base_score`` the add-half unigram
    one.  Null texts count as empty, with the end as their only token.  With
    nothing to learn from every token is unknown.  Words are told apart by 63 bits of XXH64.

    One pass counts words.  Then each text's bigrams are sent to the partition
    of their history (rare words pass by the word's partition, which knows its
    count), packed by task; continuations of the commonest histories are dealt
    out by word, and pairs of the commonest words over all partitions, whose
    parts of their counts are added up.  Partitions are counted once for the
    discounts and read again for the scores; sums by document go back to the
    document's home.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sc = spark.sparkContext
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    words = materialise(count_words(frame.where("train"), "text"), "unigrams")
    totals = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), *[F.count(F.when(F.col("c") == r, 1)) for r in range(1, CUT + 2)]).first()
    uni = Unigrams(int(totals[1]), int(totals[0]), np.array([0, *totals[2:]], np.int64))
    top = _hot(words)
    hot_counts = np.array([c for _, c in top] or [0], np.int64)
    hot = sc.broadcast({w & (2 * _TOP - 1): k for k, (w, _) in enumerate(top)})
    parts = max(1, spark.sparkContext.defaultParallelism, -(-uni.tokens // per_partition))
    frequent = int((hot_counts > SHARE * per_partition).sum())
    heat = Heat(frequent, min(frequent, SPLIT))
    shared = sc.broadcast((hot_counts, uni, heat))

    def deal(batches):
        def texts():
            for batch in batches:
                for row in zip(*(batch.column(i) for i in range(3))):
                    yield tuple(x.as_py() for x in row)

        task = TaskContext.get().partitionId()
        for p, kind, blob in _deal(texts(), hot.value, *shared.value, parts, task):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([kind]), pa.array([blob], pa.binary())], names=["p", "kind", "blob"])

    dealt = frame.mapInArrow(deal, "p int, kind string, blob binary").rdd
    dealt = dealt.map(lambda r: (r.p, (r.kind, bytes(r.blob)))).partitionBy(parts, _at)
    looked = dealt.mapPartitions(lambda rows: _look_up((v for _, v in rows), *shared.value[1:], parts)).partitionBy(parts, _at)
    here = dealt.union(looked)
    if here.getNumPartitions() != dealt.getNumPartitions():
        raise RuntimeError("the partitions of both hops must stay together")

    def statistics(rows):
        yield _Histories((v for _, v in rows), *shared.value).statistics()

    def merged(a, b):
        return a[0] + b[0], *_added(np.concatenate((a[1], b[1])), np.concatenate((a[2], b[2])))

    found, keys, counts = here.mapPartitions(statistics).treeReduce(merged)
    found[0] += _histogram(counts)
    word = (keys & np.uint64(0xFFFF)).astype(np.int64)
    np.add.at(found, _row(keys >> np.uint64(16), heat) + 1, _terms(counts, uni.probability(hot_counts[word])))
    known = sc.broadcast((discounts(found[0]), found[1:], keys, counts))

    def score(rows):
        part = _Histories((v for _, v in rows), *shared.value)
        if part.n:
            yield from _sums(part.task, part.doc, parts, part.scores(*known.value))

    scored = here.mapPartitions(score).partitionBy(parts, _at)

    def finish(rows):
        docs_of, base, model = [], {}, {}
        for _, (kind, blob) in rows:
            if kind == "m":
                docs_of.append(pickle.loads(blob))
            elif kind in "bs":
                task, packed = pickle.loads(blob)
                (base if kind == "b" else model).setdefault(task, []).append(_unpack(packed))
        for task, first, ids, lengths, base_sum, known in docs_of:
            n = len(ids)
            columns = [base_sum.copy(), known.astype(np.float64), np.zeros(n)]
            for to, blobs in ((columns[:2], base.get(task, ())), (columns[2:], model.get(task, ()))):
                for local, *sums in blobs:
                    at = local.astype(np.int64) - first
                    mine = (at >= 0) & (at < n)
                    for column, s in zip(to, sums):
                        column[at[mine]] += s[mine]
            for (doc, held), size, b, k, s in zip(ids, lengths.tolist(), *(c.tolist() for c in columns)):
                yield doc, held, size, round(k), uni.tokens, b, s

    fields = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = T.StructType([T.StructField(id_col, frame.schema["id"].dataType), *T._parse_datatype_string(fields).fields])
    return spark.createDataFrame(here.union(scored).mapPartitions(finish), schema, verifySchema=False)
