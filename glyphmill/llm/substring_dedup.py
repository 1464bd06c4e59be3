"""Removal of long repeated byte strings, by suffix arrays of shards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.anchors import segment_hash, segments
from glyphmill.llm.shared import materialise, small_batches
from glyphmill.llm.suffix_array import repeated_windows

#: Bytes of a shard, and of one key's segments beyond which its windows are counted by their hash instead.
SHARD_BYTES, HOT_BYTES = 1_500_000, 3_000_000
#: Windows of hot keys that one partition counts.
HOT_WINDOWS = 4_000_000
_HASH = np.dtype([("a", "<u8"), ("b", "<u8")])


def _runs_of(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).tolist()
    return edges[::2], edges[1::2]


def _scan(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """A row per text, equal texts of a batch as one: a number, the ids, the compressed text, and its segments."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("text", T.BinaryType())])
    for f in T._parse_datatype_string("keys array<long>, segs array<binary>, starts array<int>, windows array<int>, inners array<boolean>"):
        schema = schema.add(f)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, pack = TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            same: dict[str, list] = {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                same.setdefault(text.as_py() or "", []).append(doc)
            rows = []
            for text, ids in same.items():
                data = text.encode("utf-8", "surrogatepass")
                found = segments(data, length)
                hashes = [segment_hash(data, s, w, length) for _, s, w, _ in found]
                keys, starts, windows, inners = zip(*found) if found else ((), (), (), ())
                rows.append((number, ids, pack.compress(data), keys, hashes, starts, windows, inners))
                number += 1
            types = [pa.int64(), pa.list_(batch.schema.field(0).type), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(apply, schema)


def _cut(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments ``(key, seg, single, rid, start, windows)``: ``(key, seg, single, data)``."""
    asked = wanted.groupBy("rid").agg(F.collect_list(F.struct("key", "seg", "single", "start", "windows")).alias("asked"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for text, some in zip(batch.column(0), batch.column(1)):
                data = unpack.decompress(text.as_py())
                rows = some.as_py()
                out = [data[r["start"] : r["start"] + r["windows"] + length - 1] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["key"] for r in rows], pa.int64()), pa.array([r["seg"] for r in rows], pa.binary()), pa.array([r["single"] for r in rows], pa.bool_()), pa.array(out, pa.binary())],
                    names=["key", "seg", "single", "data"],
                )

    joined = texts.select("rid", "text").join(asked, "rid").select("text", "asked")
    return joined.mapInArrow(apply, "key long, seg binary, single boolean, data binary")


_FOUND = "seg binary, begins array<int>, ends array<int>"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["seg", "begins", "ends"])


def _by_suffix_arrays(cut: DataFrame, length: int) -> DataFrame:
    """Runs of windows that come again, for segments that are ``single``; the segments of a key are in one shard."""

    def shard(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = []
        for (seg, single, _), again in zip(rows, repeated_windows([r[2] for r in rows], length)):
            if single and again.any():
                found.append((seg, *_runs_of(again)))
        if found:
            yield _found(found)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for key, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != last and size >= SHARD_BYTES:
                    yield from shard(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
                last = key
        if rows:
            yield from shard(rows)

    return cut.repartition("key").sortWithinPartitions("key").mapInArrow(apply, _FOUND)


def _by_hashes(cut: DataFrame, length: int, buckets: int) -> DataFrame:
    """The same for keys whose segments are too many for a shard: 128-bit hashes of their windows, counted by bucket.

    A task first makes equal windows of its own rows one, with their number.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            data = [r[2] for r in rows]
            sizes = np.array([len(d) - length + 1 for d in data])
            digest = xxhash.xxh3_128_digest
            hashes = np.frombuffer(b"".join(digest(d[i : i + length]) for d, n in zip(data, sizes.tolist()) for i in range(n)), _HASH)
            order = np.lexsort((hashes["b"], hashes["a"]))
            sorted_ = hashes[order]
            new = np.append(True, sorted_[1:] != sorted_[:-1])
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(new) - 1
            counts = np.diff(np.append(np.flatnonzero(new), len(order)))
            unique = sorted_[new]
            home = unique["a"] % np.uint64(buckets)
            owner = np.repeat(np.arange(len(rows)), sizes)
            place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            segs = [r[0] for r in rows]
            single = np.array([r[1] for r in rows])
            for b in range(buckets):
                mine = np.flatnonzero((home[number] == b))
                kept = np.flatnonzero(home == b)
                if not len(mine):
                    continue
                local = np.searchsorted(kept, number[mine])
                asked = single[owner[mine]]
                parts = [unique[kept].tobytes(), counts[kept].astype(np.int32).tobytes(), local[asked].astype(np.int32).tobytes(), owner[mine][asked].astype(np.int32).tobytes(), place[mine][asked].astype(np.int32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([segs], pa.list_(pa.binary())), *[pa.array([p], pa.binary()) for p in parts]], names=["bucket", "segs", "h", "n", "local", "owner", "place"])

        rows, windows = [], 0
        for batch in batches:
            for _, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows.append(row)
                windows += len(row[2]) - length + 1
                if windows >= 1_000_000:
                    yield from flush(rows)
                    rows, windows = [], 0
        if rows:
            yield from flush(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list] = {}
        for batch in batches:
            for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                blobs.setdefault(bucket, []).append(row)
        for rows in blobs.values():
            hashes = np.concatenate([np.frombuffer(r[1], _HASH) for r in rows])
            counts = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows])
            order = np.lexsort((hashes["b"], hashes["a"]))
            sorted_ = hashes[order]
            start = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
            again = np.empty(len(order), bool)
            again[order] = np.repeat(np.add.reduceat(counts[order].astype(np.int64), start) > 1, np.diff(np.append(start, len(order))))
            at = 0
            for segs, h, _, local, owner, place in rows:
                mine = again[at : at + len(h) // 16]
                at += len(mine)
                hit = mine[np.frombuffer(local, np.int32)]
                owners, places = np.frombuffer(owner, np.int32)[hit], np.frombuffer(place, np.int32)[hit]
                edge = np.flatnonzero(np.append(True, (owners[1:] != owners[:-1]) | (places[1:] != places[:-1] + 1))) if len(owners) else np.zeros(0, int)
                by: dict[int, tuple[list, list]] = {}
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(owners)]):
                    begins, ends = by.setdefault(int(owners[a]), ([], []))
                    begins.append(int(places[a]))
                    ends.append(int(places[b - 1]) + 1)
                if by:
                    yield _found([(segs[o], *x) for o, x in by.items()])

    packed = cut.mapInArrow(pack, "bucket int, segs array<binary>, h binary, n binary, local binary, owner binary, place binary")
    return packed.repartition(buckets, "bucket").mapInArrow(count, _FOUND)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """``(id, n_bytes, spans, kept)`` for each row of ``docs``.

    Every byte covered by a ``length``-byte string that also starts anywhere
    else in the table's texts (UTF-8; the same text included, overlaps count)
    is removed.  ``spans`` are the maximal removed runs, ``begin`` to ``end``
    (end excluded), ``kept`` the remaining bytes (binary: a cut may split a
    character).  Strings are judged on the input.  Null counts as empty; texts
    shorter than ``length`` stay whole.

    Each text is cut into segments of windows with the same least gram hash, so
    equal windows have equal keys.  Keys that occur once go at once; segments
    that occur twice are repeats as a whole; where different segments share a
    key, they are gathered in the key's shard, whose suffix array is induced,
    and windows whose permuted common prefix with a neighbour is long enough
    come again.  A key whose segments outgrow a shard is counted by the hashes
    of its windows, over many tasks.
    """
    small_batches(docs.sparkSession)
    texts = materialise(_scan(docs, id_col, text_col, length), "repeat-texts")
    zipped = F.arrays_zip(F.col("keys").alias("key"), F.col("segs").alias("seg"), F.col("starts").alias("start"), F.col("windows").alias("w"), F.col("inners").alias("inner"))
    segs = texts.select("rid", F.size("ids").alias("copies"), F.explode(zipped).alias("s"))
    segs = segs.select("rid", "copies", "s.key", "s.seg", "s.start", F.col("s.w").alias("windows"), "s.inner")
    keys = segs.groupBy("key").agg(F.sum("copies").alias("n"), F.max("inner").alias("inner")).where("n > 1 or inner").select("key")
    shared = materialise(segs.join(keys, "key", "left_semi"), "repeat-candidates")
    distinct = shared.groupBy("key", "seg").agg(
        F.sum("copies").alias("n"), F.max("inner").alias("inner"), F.max("windows").alias("windows"), F.min(F.struct("rid", "start")).alias("at")
    )
    distinct = materialise(distinct.select("key", "seg", "n", "inner", "windows", "at.rid", "at.start"), "repeat-segments")
    by_key = distinct.groupBy("key").agg(
        F.count("*").alias("segs"), F.min("n").alias("least"), F.max(F.col("inner") & (F.col("n") == 1)).alias("own"),
        F.sum("windows").alias("all_windows"), F.sum(F.col("windows") + length - 1).alias("size"),
    )
    open_ = materialise(by_key.where("(segs > 1 and least = 1) or own").withColumn("hot", F.col("size") > HOT_BYTES), "repeat-keys")
    wanted = distinct.select("key", "seg", (F.col("n") == 1).alias("single"), "rid", "start", "windows")
    part = lambda hot: wanted.join(open_.where(F.col("hot") == hot).select("key"), "key")
    found = _by_suffix_arrays(_cut(part(False), texts, length), length)
    windows = open_.where("hot").agg(F.sum("all_windows")).first()[0]
    if windows:
        found = found.unionByName(_by_hashes(_cut(part(True), texts, length), length, -(-windows // HOT_WINDOWS)))
    twice = distinct.where("n > 1").select("seg", F.array(F.lit(0)).alias("begins"), F.array("windows").alias("ends"))
    found = materialise(found.unionByName(twice), "repeat-found")
    spans = shared.select("rid", "seg", "start").join(found, "seg").groupBy("rid").agg(F.collect_list(F.struct("start", "begins", "ends")).alias("found"))
    final = texts.select("rid", "ids", "text").join(spans, "rid", "left").select("ids", "text", "found")
    id_field = T.StructField(id_col, docs.schema[id_col].dataType)
    schema = T.StructType([id_field, *T._parse_datatype_string("n_bytes long, spans array<struct<begin: long, end: long>>, kept binary").fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows, size = [], 0
            for k, (ids, text, some) in enumerate(zip(*(batch.column(i) for i in range(3)))):
                data = unpack.decompress(text.as_py())
                edges: list = []
                for begin, end in sorted(chain.from_iterable(((f["start"] + b, f["start"] + e - 1 + length) for b, e in zip(f["begins"], f["ends"])) for f in some.as_py() or ())):
                    if edges and begin <= edges[-1]["end"]:
                        edges[-1]["end"] = max(edges[-1]["end"], end)
                    else:
                        edges.append({"begin": begin, "end": end})
                stops = [0, *chain.from_iterable((e["begin"], e["end"]) for e in edges), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(stops[::2], stops[1::2]))
                rows += [(i, len(data), edges, kept) for i in ids.as_py()]
                size += (len(kept) + 50 * len(edges)) * len(ids)
                if size > 8_000_000 or k == batch.num_rows - 1:
                    types = (batch.schema.field(0).type.value_type, pa.int64(), span_type, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=schema.names)
                    rows, size = [], 0

    return final.mapInArrow(finish, schema)
