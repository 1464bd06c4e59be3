"""SentencePiece (BPE) encoding with byte offsets into the original text, and decoding."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import returning, small_batches

SPACE = "▁"
SPACE_UTF8 = SPACE.encode()
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words whose pieces a worker remembers, twice.
CACHE_WORDS = 110_000
#: Characters of text whose results are sent back at once.
SLICE = 1_000_000
#: Characters of a word that is merged side by side with others.
MERGE_WIDTH = 32


def _fields(data: bytes):
    """The fields of a protobuf message: number and value."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class CharMap:
    """A compiled character map: a double-array trie of source prefixes, and the strings they become."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length and string position of the longest prefix of ``data[at:]`` in the map; length 0 if none."""
        units, found = self.units, (0, 0)
        if not units:
            return found
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        pos = offset(units[0])
        for i in range(at, len(data)):
            b = data[i]
            pos ^= b
            if pos >= len(units) or units[pos] & 0x800000FF != b:
                break
            unit = units[pos]
            pos ^= offset(unit)
            if unit & 256:
                found = (i + 1 - at, units[pos] & 0x7FFFFFFF)
        return found

    def replacement(self, position: int) -> bytes:
        return self.strings[position : self.strings.index(b"\0", position)]


class Model:
    """A SentencePiece BPE model file: pieces, scores and the normaliser's settings."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._read(f.read())

    @classmethod
    def of(cls, data: bytes) -> Model:
        """The model of a file's bytes."""
        model = cls.__new__(cls)
        model._read(data)
        return model

    def _read(self, data: bytes) -> None:
        self.pieces: list[bytes] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        self.byte_fallback, self.model_type, spec = False, 1, b""
        suffix = False
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b""))
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                self.model_type, self.byte_fallback, suffix = own.get(3, 1), bool(own.get(35, 0)), bool(own.get(24, 0))
                self.unknown_surface = own.get(44, " ⁇ ".encode())
            elif number == 3:
                spec = value
        if self.model_type != 2:
            raise ValueError("only BPE models are supported")
        if suffix or USER_DEFINED in self.kinds:
            raise ValueError("white space as suffix and user-defined pieces are not supported")
        own = dict(_fields(spec))
        self.char_map = CharMap(own.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, UNUSED)}
        self.unused = {p for p, k in zip(self.pieces, self.kinds) if k == UNUSED}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = [self.pieces.index(b"<0x%02X>" % b) for b in range(256)] if self.byte_fallback else []
        inner = [p.decode().lstrip(SPACE) for p in self.ids]
        #: Whether no piece has a space after another character: then words are encoded each on its own.
        self.by_word = self.escape and not any(SPACE in p for p in inner)
        # what each id decodes to
        self.surface = [
            b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else self.unknown_surface if k == UNKNOWN else p.replace(SPACE_UTF8, b" ")
            for p, k in zip(self.pieces, self.kinds)
        ]

        #: Whether a line break is part of no piece and no map entry, so that it always stands alone.
        self.by_line = self.by_word and self.byte_fallback and not self.char_map.units and not self.squeeze and not any("\n" in p for p in inner)
        self.table = np.array(self.surface, dtype=object)
        self._index_pairs()

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the byte of ``text`` it comes from.

        Each longest prefix that the character map knows is replaced as a whole
        (a character it doesn't know stays); all bytes of the replacement come
        from the start of that prefix.  Then the settings of the model apply:
        leading, trailing and repeated spaces go if ``remove_extra_whitespaces``, a space is put before,
        and spaces become U+2581.
        """
        data = text.encode("utf-8", "surrogatepass")
        space = SPACE_UTF8 if self.escape else b" "
        if not self.char_map.units and not self.squeeze:  # every byte stays: no loop needed
            if not data:
                return b"", np.zeros(1, np.int64)
            raw = np.frombuffer(data, np.uint8)
            source = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(space), 1)) if self.escape else np.arange(len(raw))
            lead = np.zeros(len(space) * self.dummy_prefix, np.int64)
            return space * self.dummy_prefix + data.replace(b" ", space), np.concatenate((lead, source, [len(data)]))
        parts, at = [], 0
        while at < len(data):
            used, where = self.char_map.longest(data, at)
            if used:
                parts.append((at, self.char_map.replacement(where)))
            else:
                used = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
                parts.append((at, data[at : at + used]))
            at += used
        end = len(data)
        if self.squeeze:
            while parts and parts[-1][1].strip(b" ") == b"":
                end = parts.pop()[0]
            first = 0
            while first < len(parts) and parts[first][1].strip(b" ") == b"":
                first += 1
            parts = parts[first:]
        if not parts:
            return b"", np.array([end])
        out, source = [], []
        if self.dummy_prefix:
            out.append(space)
            source += [parts[0][0]] * len(space)
        before = self.squeeze
        for place, piece in parts:
            if self.squeeze and before:
                piece = piece.lstrip(b" ")
            if not piece:
                continue
            before = piece.endswith(b" ")
            piece = piece.replace(b" ", space) if self.escape else piece
            out.append(piece)
            source += [place] * len(piece)
        data = b"".join(out)
        if self.squeeze:
            while data.endswith(space):
                data = data[: -len(space)]
                end = source[len(data)]
        return data, np.array([*source[: len(data)], end], np.int64)

    def merge(self, word: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Ids of a normalised string, and for each the UTF-8 length of what it covers (0 for all but the last byte of a fallback).

        Neighbours merge as long as one of the pairs is a piece, best score
        first and leftmost of equals.  Unused pieces are split again; what is
        no piece falls back to bytes, or to the unknown id.
        """
        symbols = [c.encode("utf-8", "surrogatepass") for c in word]
        left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        queue: list[tuple[float, int, int, bytes]] = []
        origin: dict[bytes, tuple[bytes, bytes]] = {}
        scores, ids = self.scores, self.ids

        def offer(i: int, j: int) -> None:
            if i < 0 or j >= len(symbols):
                return
            both = symbols[i] + symbols[j]
            k = ids.get(both)
            if k is not None:
                heapq.heappush(queue, (-scores[k], i, j, both))
                if both in self.unused:
                    origin[both] = (symbols[i], symbols[j])

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if not symbols[i] or not symbols[j] or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, b""
            right[i] = right[j]
            if right[j] < len(symbols):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])

        return self._emit([x for x in symbols if x], origin)

    def merge_many(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`merge` of many words: the words (in another order), how many ids each has, all ids, and the lengths they cover.

        Short words are merged side by side, a merge in each at a time.
        """
        known = self.letters
        short = sorted((w for w in words if len(w) <= MERGE_WIDTH and known.issuperset(w)), key=len) if self.pairs is not None else []
        parts = [self._merge_grid(short[at : at + 8192]) for at in range(0, len(short), 8192)]
        spelled = set(short)
        rest = [w for w in words if w not in spelled]
        found = [self.merge(w) for w in rest]
        parts.append((np.array([len(f[0]) for f in found], np.int64), np.array([i for f in found for i in f[0]], np.int32), np.array([n for f in found for n in f[1]], np.int32)))
        return short + rest, *(np.concatenate(c) for c in zip(*parts))

    def _merge_grid(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = max(map(len, words))
        grid = np.full((len(words), width + 1), -1, np.int32)
        sizes = np.array([len(w) for w in words])
        grid[np.arange(width + 1) < sizes[:, None]] = [self.symbol[c] for c in "".join(words)]
        rows = np.arange(len(words))
        # symbols stay where their first character was; what stands beside each is kept instead
        following = np.tile(np.arange(1, width + 2, dtype=np.int8), (len(words), 1))
        before = np.tile(np.arange(-1, width, dtype=np.int8), (len(words), 1))
        gain, into = self._gains(grid[:, :-1], grid[:, 1:])
        while True:
            place = gain[rows].argmax(axis=1)
            live = gain[rows, place] > -np.inf
            rows, place = rows[live], place[live]
            if not len(rows):
                break
            merged, gone = into[rows, place], following[rows, place]
            right, left = following[rows, gone], before[rows, place]
            grid[rows, place], grid[rows, gone], gain[rows, gone] = merged, -1, -np.inf
            following[rows, place], before[rows, right] = right, place
            gain[rows, place], into[rows, place] = self._gains(merged, grid[rows, right])
            inner = left >= 0
            r, c = rows[inner], left[inner]
            gain[r, c], into[r, c] = self._gains(grid[r, c], merged[inner])
        ids = grid[grid >= 0]
        return (grid >= 0).sum(axis=1), ids, self.width[ids]

    def _gains(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of what two neighbours become, minus infinity where nothing."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) << 20 | right)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        same = self.pairs[at] == key
        return np.where(same, self.pair_gain[at], np.float32(-np.inf)), np.where(same, self.pair_into[at], np.int32(-1))

    def _index_pairs(self) -> None:
        """All pairs of pieces or characters that a piece is made of, sorted, with its score and id."""
        known = {p.decode("utf-8", "surrogatepass"): i for p, i in self.ids.items()}
        self.letters = frozenset(c for c in "".join(known) if c in known)  # others take the long way
        rows = [(known[w[:i]] << 20 | known[w[i:]], k) for w, k in known.items() for i in range(1, len(w)) if w[:i] in known and w[i:] in known]
        self.symbol = known
        self.width = np.array([len(p) for p in self.pieces], np.int32)
        self.marks = np.array([2 * p.count(SPACE_UTF8) for p in self.pieces], np.int32)
        self.pairs = None
        if rows and not self.unused and len(self.pieces) < 1 << 20:
            rows.sort()
            keys, into = zip(*rows)
            self.pairs, self.pair_into = np.array(keys, np.int64), np.array(into, np.int32)
            self.pair_gain = np.array(self.scores, np.float32)[self.pair_into]

    def _emit(self, symbols: list[bytes], origin: dict[bytes, tuple[bytes, bytes]]) -> tuple[tuple[int, ...], tuple[int, ...]]:
        out: list[int] = []
        sizes: list[int] = []
        ids = self.ids

        def emit(piece: bytes) -> None:
            if piece in origin:
                for part in origin[piece]:
                    emit(part)
            elif piece in ids:
                out.append(ids[piece])
                sizes.append(len(piece))
            elif self.byte_fallback:
                out.extend(self.bytes[b] for b in piece)
                sizes.extend([0] * (len(piece) - 1) + [len(piece)])
            elif out and out[-1] == self.unknown:
                sizes[-1] += len(piece)  # neighbouring unknowns are one
            else:
                out.append(self.unknown)
                sizes.append(len(piece))

        for s in symbols:
            emit(s)
        return tuple(out), tuple(sizes)

    def decode(self, ids) -> str:
        """The text of ``ids``: pieces joined, byte pieces read as UTF-8, the put-before space taken off."""
        ids = np.asarray(ids, np.int64)
        data = b"".join(self.table[ids].tolist())
        if self.dummy_prefix and data[:1] == b" " and self.kinds[next(i for i in ids.tolist() if self.surface[i])] == NORMAL:
            data = data[1:]
        return data.decode("utf-8", "replace")


class Pool:
    """The pieces of numbered words: ids, the UTF-8 length each covers, and the length in a text whose spaces are still one byte."""

    def __init__(self):
        self.ends = np.zeros(1, np.int64)
        self.columns = [np.zeros(0, np.int32)] * 3

    def add(self, counts: np.ndarray, columns: list[np.ndarray]) -> None:
        """Words with so many pieces each follow the last one."""
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts)))
        self.columns = [np.concatenate(x) for x in zip(self.columns, columns)]

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many pieces each of the words has, and where all of these lie in the columns."""
        first = self.ends[words]
        counts = self.ends[words + 1] - first
        ends = np.cumsum(counts)
        return counts, np.repeat(first - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes with a memory of words, as most words come again.

    A word's pieces lie in a pool under its number, which is kept under the word
    where one space comes before, else under a line break and the word.  Words
    that weren't met for ``CACHE_WORDS`` new ones are forgotten.
    """

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.earlier: dict[str, int] = {}
        self.pool, self.older = Pool(), Pool()
        words = rf"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+" if model.by_line else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        self.split = re.compile(words if model.by_word else r"(?s).+")

    def _add(self, keys: list[str], counts: np.ndarray, columns: list[np.ndarray]) -> None:
        at = len(self.pool.ends) - 1
        self.pool.add(counts, columns)
        self.known.update(zip(keys, range(at, at + len(keys))))

    def _learn(self, keys: set[str]) -> None:
        if len(self.known) + len(keys) > CACHE_WORDS:
            self.earlier, self.known = self.known, {}
            self.older, self.pool = self.pool, Pool()
        if old := list(self.earlier.keys() & keys):
            counts, at = self.older.places(np.array(list(map(self.earlier.__getitem__, old)), np.int64))
            self._add(old, counts, [c[at] for c in self.older.columns])
            keys = keys.difference(old)
        by_word = {k[1:] if k[:1] == "\n" else SPACE + k: k for k in keys if k[:1] == "\n"}
        plain = [SPACE + k for k in keys if k[:1] != "\n"]
        for words, key in ((plain, lambda w: w[1:]), (list(by_word), by_word.__getitem__)):
            if not words:
                continue
            words, counts, ids, sizes = self.model.merge_many(words)
            narrow = np.where(sizes > 0, sizes - self.model.marks[ids], 0).astype(np.int32)
            self._add(list(map(key, words)), counts, [ids, sizes, narrow])

    def _words(self, text: str) -> tuple[list[str], np.ndarray | None]:
        """The keys of a text's words, and the source of each normalised byte unless nothing but spaces changes its length."""
        model = self.model
        if model.by_line and model.dummy_prefix and text and text[0] != " " and "  " not in text and SPACE not in text:
            # each space begins a word and each line break stands alone, so no normalised string is built
            if "\n" not in text:
                return text.split(" "), None
            keys: list[str] = []
            for k, line in enumerate(text.split("\n")):
                if k:
                    keys.append("\n\n")
                    first, *line = line.split(" ")
                    if first:
                        keys.append("\n" + first)
                    keys += line
                else:
                    keys += line.split(" ")
            return keys, None
        data, source = model.normalise(text)
        words = self.split.findall(data.decode("utf-8", "surrogatepass"))
        return [w[1:] if w[0] == SPACE and "\n" not in w and SPACE not in w[1:2] else "\n" + w for w in words], source

    def encode_many(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and where in its UTF-8 each piece begins and ends.

        The pieces tile the text in order.  All bytes of a fallback character
        carry its span's start, and but for the last an empty span.
        """
        cut = [self._words(t or "") for t in texts]
        wanted = set().union(*[keys for keys, _ in cut])
        new = wanted - self.known.keys()
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:  # begin anew with all words of these texts
                new = wanted
            self._learn(new)
        words = np.fromiter(map(self.known.__getitem__, chain.from_iterable(keys for keys, _ in cut)), np.int64, sum(len(keys) for keys, _ in cut))
        counts, at = self.pool.places(words)
        all_ids, all_sizes, all_narrow = (c[at] for c in self.pool.columns)
        pieces = np.concatenate(([0], np.cumsum(counts)))
        stops = pieces[np.cumsum([0, *(len(keys) for keys, _ in cut)])].tolist()
        out = []
        for (_, source), a, b in zip(cut, stops, stops[1:]):
            if source is None:
                sizes = all_narrow[a:b]
                ends = np.cumsum(sizes, dtype=np.int32) - np.int32(1)  # the put-before space has no byte in the text
                begins = ends - sizes
                begins[:1] = 0
            else:
                sizes = all_sizes[a:b]
                ends = np.cumsum(sizes, dtype=np.int64)
                begins, ends = source[ends - sizes].astype(np.int32), source[ends].astype(np.int32)
            out.append((all_ids[a:b], begins, ends))
        return out

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_many([text])[0]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True, decode: bool = False, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (the id by default) with ``ids`` and, if asked, ``begins``, ``ends`` and ``decoded``.

    Whole texts are encoded, without begin or end ids; null and empty texts
    have none.  ``begins`` and ``ends`` are byte offsets into the text's UTF-8.
    The model file is read once in the driver and sent to the tasks.
    """
    carry = [id_col] if carry is None else carry
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Model(model_path))
    extra = ["begins array<int>", "ends array<int>"] * spans + ["decoded string"] * decode
    keep = {c: f"__c{i}" for i, c in enumerate(carry)}
    frame = docs.select(*[F.col(c).alias(k) for c, k in keep.items()], F.col(text_col).alias("__text"))
    schema = frame.drop("__text").schema
    fields = ", ".join(["ids array<int>", *extra])
    for field in frame.sparkSession.createDataFrame([], fields).schema:
        schema = schema.add(field)

    def apply(batches):
        encoder = Encoder(model.value)  # goes with the task: a worker that lives on shouldn't hold its words
        lists = lambda parts: pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32), np.concatenate(parts))
        for batch in batches:
            texts, held = batch.column(batch.schema.get_field_index("__text")), []
            first = size = 0
            for k, text in enumerate(texts):
                held.append(text.as_py())
                size += len(held[-1] or "")
                if size < SLICE and k < len(texts) - 1:
                    continue
                found, held = encoder.encode_many(held), []
                columns = dict(zip(("ids", "begins", "ends"), zip(*found)))
                arrays = [batch.column(i).slice(first, k + 1 - first) for i in range(batch.num_columns - 1)]
                for f in schema.fields[len(arrays) :]:
                    arrays.append(pa.array([encoder.model.decode(x[0]) for x in found], pa.string()) if f.name == "decoded" else lists(columns[f.name]))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])
                first, size = k + 1, 0

    return frame.mapInArrow(lambda batches: returning(apply(batches)), schema).withColumnsRenamed({k: c for c, k in keep.items()})


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text of each row's ids; null ids give null, no ids an empty text."""
    model = tokens.sparkSession.sparkContext.broadcast(Model(model_path))

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda ids: None if ids is None else model.value.decode(ids))

    small_batches(tokens.sparkSession)
    return tokens.withColumn(out_col, read(ids_col))
