"""Cross-tokenizer alignment: groups and links of the tokens that two tokenizers make of the same text."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.sentencepiece_bpe import BYTE, Model
from glyphmill.llm.shared import materialise, small_batches

#: Chunks that a task remembers, twice, and the longest that it does.
CACHE_CHUNKS, CACHE_LENGTH = 150_000, 48
#: Characters of text that are aligned at once.
SLICE = 1_000_000
#: Id pairs whose counts are sent to all tasks at a time (17 bytes each).
PAIRS = 2_000_000
#: A space that always begins a new token for both tokenizers: one after anything but white space, and not at the end.
_CUT = re.compile(r"(?<=\S) (?!\Z)")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and what their ids stand for in bytes."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = _byte_letters()
        vocabulary = json.loads(a_json)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        model = Model.of(b_model)
        self.by_chunk = model.by_word and not model.squeeze and model.dummy_prefix and not model.char_map.units
        self.b_bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace("▁".encode(), b" ") for p, k in zip(model.pieces, model.kinds)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # what each id is written as: first of its group or a later one, A then B
        self.written = np.array([f";{i}" for i in range(len(self.a_bytes))] + [f",{i}" for i in range(len(self.a_bytes))] + [f"|{i}" for i in range(len(self.b_bytes))] + [f",{i}" for i in range(len(self.b_bytes))], object)
        self.a_table, self.b_table = (np.array(t, object) for t in (self.a_bytes, self.b_bytes))
        self.known: dict[str, tuple | None] = {}
        self.earlier: dict[str, tuple | None] = {}

    def chunks(self, text: str) -> list[str]:
        return _CUT.split(text) if self.by_chunk else [text]

    def align(self, chunks: list[str]) -> list[tuple[int, int, int, str, bytes] | None]:
        """For each text its numbers of A tokens, B tokens and groups, the groups written out, and its links as packed pairs of ids.

        None where the tokens' bytes aren't the text with a space before.
        """
        plain = [(" " + c).encode() for c in chunks]
        a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
        b = self.b.encode(chunks, num_threads=1)
        good: Sequence[int] = range(len(chunks))
        n_a, n_b, ids_a, ids_b = self._flat(a, b)
        size = np.fromiter(map(len, plain), np.int64, len(plain))
        whole = b"".join(plain)
        # all at once: if every text's tokens end where it ends and all bytes are the same, so are each text's
        ends = [np.concatenate(([0], np.cumsum(t[i])))[np.cumsum(n)] for t, i, n in ((self.a_size, ids_a, n_a), (self.b_size, ids_b, n_b))]
        same = all((e == np.cumsum(size)).all() for e in ends) and all(b"".join(t[i].tolist()) == whole for t, i in ((self.a_table, ids_a), (self.b_table, ids_b)))
        out: list = [None] * len(chunks)
        if not same:
            good = [i for i, p in enumerate(plain) if b"".join([self.a_bytes[x] for x in a[i]]) == p == b"".join([self.b_bytes[x] for x in b[i]])]
            if not good:
                return out
            n_a, n_b, ids_a, ids_b = self._flat([a[i] for i in good], [b[i] for i in good])
        # texts lie one after another, so that no group or link reaches into the next
        end_a, end_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        begin_a, begin_b = end_a - self.a_size[ids_a], end_b - self.b_size[ids_b]
        kind = np.repeat((0, 1), (len(ids_a), len(ids_b)))
        begins, ends = np.concatenate((begin_a, begin_b)), np.concatenate((end_a, end_b))
        order = np.lexsort((kind, begins))
        reach = np.maximum.accumulate(ends[order])
        fresh = np.concatenate(([True], begins[order][1:] >= reach[:-1]))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(fresh) - 1
        by_group = np.lexsort((begins, kind, group))
        label = 2 * group[by_group] + kind[by_group]
        later = np.concatenate(([False], label[1:] == label[:-1]))
        base = np.array([0, 2 * len(self.a_bytes)])[kind[by_group]] + later * np.array([len(self.a_bytes), len(self.b_bytes)])[kind[by_group]]
        written = self.written[base + np.concatenate((ids_a, ids_b))[by_group]].tolist()
        # an A token overlaps the B tokens from the first that ends after its start to the last that starts before its end
        first, last = np.searchsorted(end_b, begin_a, "right"), np.searchsorted(begin_b, end_a, "left")
        per = last - first
        pair_b = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per - first, per)
        links = np.repeat(ids_a, per) * len(self.b_bytes) + ids_b[pair_b]
        tokens = np.concatenate(([0], np.cumsum(n_a + n_b)))
        last_a = np.cumsum(n_a) - 1
        linked = np.concatenate(([0], np.cumsum(per)[last_a])) * links.itemsize
        groups = np.diff(np.concatenate(([-1], group[last_a])))
        packed = links.tobytes()
        tokens, linked = tokens.tolist(), linked.tolist()
        rows = zip(good, n_a.tolist(), n_b.tolist(), groups.tolist(), tokens, tokens[1:], linked, linked[1:])
        for i, na, nb, n, begin, end, first_link, last_link in rows:
            out[i] = (na, nb, n, "".join(written[begin:end])[1:], packed[first_link:last_link])
        return out

    @staticmethod
    def _flat(*many: list[list[int]]) -> list[np.ndarray]:
        """How many ids each text has, and all of them, for each tokenizer."""
        counts = [np.fromiter(map(len, ids), np.int64, len(ids)) for ids in many]
        return counts + [np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in zip(many, counts)]

    def align_texts(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """:meth:`align` of whole texts, put together from their chunks, each of which is aligned once."""
        cut = [self.chunks(t) if t else [] for t in texts]
        wanted = set().union(*cut)
        new = wanted - self.known.keys()
        if len(self.known) + len(new) > CACHE_CHUNKS:
            self.earlier, self.known, new = self.known, {}, wanted
        self.known.update((c, self.earlier[c]) for c in new & self.earlier.keys())
        new = list(new - self.earlier.keys())
        if new:
            self.known.update(zip(new, self.align(new)))
        get = self.known.__getitem__
        out = []
        for text, chunks in zip(texts, cut):
            own = list(map(get, chunks))
            if own and None in own:  # bytes differ in a chunk; the whole decides
                own = self.align([text])
            if not own or None in own:
                out.append((0, 0, 0, "", np.zeros(0, np.int64)))
                continue
            a, b, groups, written, links = zip(*own)
            out.append((sum(a), sum(b), sum(groups), ";".join(written), np.frombuffer(b"".join(links), np.int64)))
        for c in new:
            if len(c) > CACHE_LENGTH:
                del self.known[c]
        return out


@lru_cache(maxsize=1)
def _loaded(a_json: str, b_model: bytes) -> Aligner:
    return Aligner(a_json, b_model)


def link(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, ``n_a, n_b, n_groups, n_links, groups, groups_sha256`` and its links: ``pairs``, distinct id pairs, and ``times``, how often each.

    ``groups`` writes each group's A ids, a bar and its B ids.  A pair is its A
    id times the size of B's vocabulary plus its B id.  Null and empty texts,
    and those whose tokens' bytes aren't those of the text, have no tokens.
    """
    small_batches(docs.sparkSession)
    with open(a_path, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((a_json, b_model))
    frame = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    schema = f"__id {frame.schema['__id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _loaded(*sent.value)

        def answer(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
            found = aligner.align_texts(texts)
            a, b, groups, written, links = zip(*found)
            sizes = np.array([len(x) for x in links])
            flat = np.concatenate(links)
            row = np.repeat(np.arange(len(sizes)), sizes)
            both = np.sort(row << 40 | flat)  # fewer than 2**22 texts at once, pairs below 2**40
            new = np.concatenate(([True], both[1:] != both[:-1])) if len(both) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(both))).astype(np.int32)
            offsets = np.searchsorted(both[at] >> 40, np.arange(len(sizes) + 1)).astype(np.int32)
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in (a, b, groups, sizes)), pa.array(written, pa.string())]
            arrays += [pa.ListArray.from_arrays(offsets, both[at] & ((1 << 40) - 1)), pa.ListArray.from_arrays(offsets, times)]
            return pa.RecordBatch.from_arrays(arrays, names=["__id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

        for batch in batches:
            held, first, size = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                held.append(text.as_py())
                size += len(held[-1] or "")
                if size >= SLICE or k == batch.num_rows - 1:
                    yield answer(batch.slice(first, k + 1 - first), held)
                    held, first, size = [], k + 1, 0

    return frame.mapInArrow(apply, schema).withColumnRenamed("__id", id_col)


def pair_counts(linked: DataFrame, b_size: int) -> DataFrame:
    """``(pair, n, best)``: how many rows hold each pair, and whether that is the most that any pair of its A id has."""
    counts = linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    of = Window.partitionBy(F.expr(f"pair div {b_size}"))  # one A id's pairs: B's vocabulary at most
    return counts.withColumn("best", F.col("n") == F.max("n").over(of))


def _looked_up(linked: DataFrame, table: tuple, own: list[str]) -> DataFrame:
    """``linked`` with ``n_best`` and ``count_sum`` raised by what the pairs of one part of the counts add."""
    sent = linked.sparkSession.sparkContext.broadcast(table)
    at = [linked.columns.index(c) for c in ("pairs", "times", "n_best", "count_sum")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = sent.value
        for batch in batches:
            lists, times = batch.column(at[0]), batch.column(at[1]).flatten().to_numpy()
            pairs = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            place = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
            times = np.where(keys[place] == pairs, times, 0).astype(np.int64)
            columns = list(batch.columns)
            for column, value in ((at[2], times * best[place]), (at[3], times * counts[place])):
                added = np.zeros(batch.num_rows, np.int64)
                np.add.at(added, row, value)
                columns[column] = pa.array(columns[column].to_numpy() + added, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return linked.mapInArrow(apply, linked.schema).select(*own)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = PAIRS) -> DataFrame:
    """For each row its id with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A is a byte-level tokenizer's JSON file and reads a space and the text, B a
    SentencePiece model and reads the text.  Tokens lie over the bytes of space
    and text; where tokens of both end, a group ends.  All tokens are sorted by
    start and their ends accumulated as maxima, and a group begins where a start
    reaches the maximum before it.  Links are the pairs of tokens whose bytes
    overlap; ``n_best`` counts those whose ids no other pair of the same A id
    outnumbers in ``docs``, ``count_sum`` adds up the rows that hold each link's
    ids.  ``groups_sha256`` is the digest of the groups written out, '' without
    tokens.  Null and empty texts, and texts whose tokens' bytes differ from
    them, have no tokens: all numbers are 0.  Repeated rows count repeatedly.

    Texts are cut at spaces that begin a token for both; a chunk that comes
    again isn't aligned again.  The counts are looked up by tasks, in parts of
    at most ``most_pairs`` id pairs, one pass over the links for each part.
    """
    linked = link(docs, a_path, b_path, id_col, text_col)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    linked = materialise(linked.withColumn("groups_sha256", digest).drop("groups"), "alignment-links")
    counts = materialise(pair_counts(linked, len(Model(b_path).pieces)), "alignment-counts")
    n = counts.count()
    parts = max(1, -(-n // most_pairs))
    own = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out = linked.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for part in range(parts if n else 0):
        if part:
            out = materialise(out, "alignment-sums")
        rows = counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == part).orderBy("pair").toArrow()
        if rows.num_rows:
            table = tuple(rows.column(c).to_numpy() for c in ("pair", "n", "best"))
            out = _looked_up(out, table, out.columns)
    return out.select(*own)
