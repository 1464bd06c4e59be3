"""Near copies: SimHash links, and the verified similarity of five-word shingles, both found by deletion-variant signatures.

SimHash (:mod:`glyphmill.llm.simhash`) links texts whose fingerprints differ in
two bits or fewer.  A bit differs in 15 % of texts that are 0.8 alike, so
segments of bits would be too short to find those.  Their signatures are cut from
min-hashes, each of which is equal with the probability that is the
similarity: of :data:`COARSE` segments one differs by at most one min-hash in
0.9999 of such pairs, variants with one wildcard are joined by equality, and
what they find is verified.  Members of full buckets that can be similar to
another member take :data:`FINE` segments, of which one is equal in 0.9998.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm import simhash
from glyphmill.llm.shared import connected_components, materialise, returning, small_batches, spread

#: Words of a shingle; texts of which four fifths of all shingles (of both) are common are near copies.
SHINGLE = 5
#: Segments and min-hashes of each.  Members of fuller buckets take the fine ones, whole: 0.9998 of pairs, and fewer chance ones.
COARSE, FINE = (7, 5), (28, 6)
#: Buckets up to this many texts are compared pair by pair; larger coarse ones take fine signatures, texts of larger fine ones are crowds.
BUCKET = 16
#: Texts of a crowd that a task compares with as many others at a time, shingles that it does at once, and shingles of texts that it lays out for that.
CROWD_PART, SLAB, LAID = 512, 4_096, 500_000
#: Coarse min-hashes of which a pair must share so many (0.9999 of near copies do) before its texts are looked at.
ALIKE = 18
#: Texts of a task that writes out signatures.
SIGNED = 50_000
#: Shingles that are min-hashed at a time.
STEP = 4_096
_SEEDS = np.random.default_rng(8).integers(1, 1 << 63, (2, FINE[0] * FINE[1]), np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, as sorted XXH64 values.

    A-Z are lower-cased; words are runs of anything but ``[\\x20\\x09-\\x0D]``.
    Texts of fewer words are one shingle, also those without any.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = {digest(join(g)) for g in zip(*(words[i:] for i in range(SHINGLE)))} if len(words) > SHINGLE else {digest(join(words))}
    return np.sort(np.fromiter(grams, np.uint64, len(grams)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the common shingles are at least 0.8 of all."""
    least, most = sorted((len(a), len(b)))
    if 5 * least < 4 * most:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * common >= 4 * (least + most - common)


def min_hashes(own: np.ndarray, shape: tuple[int, int] = COARSE) -> np.ndarray:
    """For each of as many permutations of all numbers as ``shape`` has min-hashes, the top half of the least that a shingle takes."""
    count = shape[0] * shape[1]
    xor, odd = _SEEDS[0][:count, None], _SEEDS[1][:count, None] | np.uint64(1)
    least = np.full(count, np.uint64(2**64 - 1))
    for at in range(0, len(own), STEP):
        least = np.minimum(least, ((own[at : at + STEP] ^ xor) * odd).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketched(docs: DataFrame, text_col: str, fingerprints: bool) -> DataFrame:
    """``docs`` with a number ``__rid``, the min-hashes ``__h`` and, if asked, the SimHash ``__fp`` of each text."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("__rid long, __h array<int>" + ", __fp long" * fingerprints).fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            hashes = [min_hashes(shingles(text.as_py())) for text in batch.column(at)]
            rids = pa.array(np.arange(number, number + batch.num_rows), pa.int64())
            number += batch.num_rows
            columns = [*batch.columns, rids, pa.array(hashes, pa.list_(pa.int32()))]
            if fingerprints:
                bits = np.array([simhash.fingerprint(text.as_py()) for text in batch.column(at)], np.uint64)
                columns.append(pa.array(bits.view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(lambda batches: returning(apply(batches)), schema)


def _signatures(hashes: Column, segments: int, size: int) -> Column:
    """Each segment with each of its min-hashes made a wildcard, as a hash tagged by both."""
    variants = F.sequence(F.lit(0), F.lit(segments * size - 1))
    wild = lambda i: (i % size).cast("int")
    first = lambda i: (i - i % size + 1).cast("int")
    left = lambda i: F.slice(hashes, first(i), wild(i))
    right = lambda i: F.slice(hashes, (i + 2).cast("int"), F.lit(size - 1) - wild(i))
    return F.transform(variants, lambda i: F.xxhash64(i, left(i), right(i)))


def _segments(hashes: Column, segments: int, size: int) -> Column:
    """Each segment as a hash tagged by its place."""
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: F.xxhash64(i, F.slice(hashes, (i * size + 1).cast("int"), F.lit(size))))


def _pairs(texts: DataFrame, signatures: Column, label: str) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(u, v)`` of ``texts(rid, ...)`` whose ``signatures`` share a bucket of up to BUCKET, and the members ``(rid, sig, n)`` of larger ones."""
    keyed = spread(texts, texts.count(), SIGNED).select("rid", F.explode(signatures).alias("sig"))
    sizes = keyed.groupBy("sig").agg(F.count("*").alias("n"), F.min("rid").alias("u"), F.max("rid").alias("v")).where("n > 1")
    sizes = materialise(sizes, f"near-{label}-buckets")
    members = materialise(keyed.join(sizes.where("n > 2").select("sig", "n").hint("merge"), "sig"), f"near-{label}-members")
    lists = members.where(F.col("n") <= BUCKET).groupBy("sig").agg(F.array_sort(F.collect_list("rid")).alias("m"))
    each = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y > x), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    pairs = sizes.where("n = 2").select("u", "v").unionByName(lists.select(F.explode(each).alias("p")).select("p.u", "p.v"))
    return pairs.distinct(), members.where(F.col("n") > BUCKET).select("rid", "sig", "n")


def _linkable(sets: DataFrame) -> DataFrame:
    """The rows of ``sets(rid, s, ...)`` that can be similar to another one.

    Shingles that no other text of them has are common to none, so a text of
    which these are over a fifth is similar to none.
    """
    held = sets.select("rid", F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("n"), F.min("rid").alias("rid"))
    alone = held.where("n = 1").groupBy("rid").agg(F.count("*").alias("own"))
    size = F.size("s").cast("long")
    kept = 5 * (size - F.coalesce("own", F.lit(0))) >= 4 * size
    return sets.join(alone.hint("merge"), "rid", "left").where(kept).select(*sets.columns)


def _alike(a: Column, b: Column) -> Column:
    """Whether two texts share so many coarse min-hashes that they may be similar."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y) >= ALIKE


def _plausible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` of numbers whose coarse min-hashes in ``rows(rid, h)`` don't rule them out."""
    coarse = lambda rid, name: rows.select(F.col("rid").alias(rid), F.col("h").alias(name)).hint("merge")
    return pairs.join(coarse("v", "b"), "v").join(coarse("u", "a"), "u").where(_alike(F.col("a"), F.col("b"))).select("u", "v")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` ``(u, v)`` of numbers whose ``texts(rid, text)`` are similar."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(rid, text):
            if rid not in known:
                if len(known) >= 64:
                    known.clear()
                known[rid] = shingles(text.as_py())
            return known[rid]

        for batch in batches:
            us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = [similar(of(u, a), of(v, b)) for u, v, a, b in zip(us, vs, batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(c, keep) if k], pa.int64()) for c in (us, vs)], names=["u", "v"])

    text = lambda rid, name: texts.select(F.col("rid").alias(rid), F.col("text").alias(name)).hint("merge")
    return pairs.join(text("v", "b"), "v").join(text("u", "a"), "u").select("u", "v", "a", "b").mapInArrow(lambda batches: returning(apply(batches)), "u long, v long")


def _crowds(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``(rid, crowd, degree, key)`` of the ``members(rid, sig, n)`` of full buckets.

    A crowd is what full buckets join.  ``degree`` adds up the sizes of a text's
    full buckets: the text at the middle of a crowd shares most.  ``key`` tells
    texts by their shingles, so that no choice depends on row numbers.
    """
    least = members.groupBy("sig").agg(F.min("rid").alias("least"))
    stars = members.join(least, "sig").select(F.col("rid").alias("u"), F.col("least").alias("v"))
    of = connected_components(stars).select(F.col("node").alias("rid"), F.col("component").alias("crowd"))
    degree = members.groupBy("rid").agg(F.sum("n").alias("degree"))
    return of.join(degree, "rid").join(sets.select("rid", F.xxhash64("s").alias("key")).hint("merge"), "rid")


def _placed(crowds: DataFrame, of: DataFrame) -> DataFrame:
    """``crowds`` with the component ``home`` of each text."""
    own = crowds.join(of.withColumnRenamed("node", "rid"), "rid", "left")
    return materialise(own.withColumn("home", F.coalesce("component", "rid")).drop("component"), "near-homes")


def _outside(placed: DataFrame) -> DataFrame:
    """The texts of ``placed`` that aren't in the largest component of their crowd."""
    sizes = placed.groupBy("crowd", "home").agg(F.count("*").alias("n"), F.max("degree").alias("d"), F.max("key").alias("k"))
    largest = sizes.groupBy("crowd").agg(F.max_by("home", F.struct("n", "d", "k", "home")).alias("largest"))
    return placed.join(largest, "crowd").where("home <> largest").drop("largest")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` has in common with each of ``b``, a slab of shingles at a time."""
    values = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    fresh = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(fresh) - 1
    often = np.bincount(column)[column] > 1  # others are common to none
    row, column = row[often], column[often]
    column = np.unique(column, return_inverse=True)[1]
    out = np.zeros((len(a), len(b)), np.int64)
    for begin in range(0, int(column.max(initial=-1)) + 1, SLAB):
        here = slice(*np.searchsorted(column, (begin, begin + SLAB)))
        grid = np.zeros((len(a) + len(b), SLAB), np.float32)
        grid[row[here], column[here] - begin] = 1
        out += (grid[: len(a)] @ grid[len(a) :].T).astype(np.int64)
    return out


def _cuts(sets: list[np.ndarray]) -> list[slice]:
    """``sets`` in runs of LAID shingles or less, but of one set at least."""
    begins, size = [0], 0
    for i, x in enumerate(sets):
        if size and size + len(x) > LAID:
            begins.append(i)
            size = 0
        size += len(x)
    return [slice(i, j) for i, j in zip(begins, [*begins[1:], len(sets)])]


def joining(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Pairs ``(u, v)`` of similar texts of two blocks ``(rid, home, s)``, as many as join the homes that such pairs join."""
    a, b = ([np.asarray(x, np.int64) for x in block["s"]] for block in (left, right))
    rids, homes = [block["rid"].to_numpy(np.int64) for block in (left, right)], [block["home"].to_numpy(np.int64) for block in (left, right)]
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.get(x, x) != x:
            x = top[x] = top.get(top[x], top[x])
        return x

    out = []
    for m in _cuts(a) if b else []:
        for n in _cuts(b) if a else []:
            common = _common(a[m], b[n])
            union = np.add.outer([len(x) for x in a[m]], [len(x) for x in b[n]]) - common
            found = (5 * common >= 4 * union) & (homes[0][m][:, None] != homes[1][n])
            for i, j in zip(*np.nonzero(found)):
                x, y = root(int(homes[0][m][i])), root(int(homes[1][n][j]))
                if x != y:
                    top[x] = y
                    out.append((rids[0][m][i], rids[1][n][j]))
    return pd.DataFrame(out, columns=["u", "v"]).astype(np.int64)


def _compared(asked: DataFrame, placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` that join what similar texts of ``asked`` and of all of their crowd join.

    Both sides are cut into blocks of about CROWD_PART, every two of which meet
    in a group of their own; no pair leaves it that doesn't join two components.
    """
    count = lambda of, name: of.groupBy("crowd").agg(F.ceil(F.count("*") / CROWD_PART).cast("int").alias(name))
    shape = count(asked, "blocks").join(count(placed, "parts"), "crowd")
    dealt = lambda of, n: F.pmod(F.xxhash64("rid"), F.col(n)).alias(of)
    each = lambda of, n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)).alias(of)
    own = lambda of: of.select("rid", "crowd", "home").join(shape, "crowd").join(sets.hint("merge"), "rid")
    named = lambda *names: [F.col(n).alias(n) for n in names]  # noqa: E731  columns of its own, as both sides come from the same tables
    left = own(asked).select(*named("crowd", "rid", "home", "s"), dealt("block", "blocks"), each("part", "parts"))
    right = own(placed).select("crowd", "rid", "home", "s", each("block", "blocks"), dealt("part", "parts"))
    keys = ("crowd", "block", "part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(joining, "u long, v long")


def links(rows: DataFrame, text_col: str, fingerprints: bool = False) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of the links between similar texts of ``rows`` that share a bucket.

    With ``fingerprints``, SimHash's links come first and join as well.  In a crowd, the text of the largest degree is compared with all others
    first, and then all texts that are still outside of the crowd's largest
    component are.  So every two texts of a crowd have been compared unless they
    are joined, whatever the order of the rows.  What is joined is handed on as
    stars.
    """
    hashes = rows.select(F.col("__rid").alias("rid"), F.col("__h").alias("h"))
    pairs, full = _pairs(hashes, _signatures(F.col("h"), *COARSE), "coarse")
    pairs = materialise(_plausible(pairs, hashes), "near-pairs")
    full = materialise(full.select("rid").distinct(), "near-full")
    asked = pairs.select(F.col("u").alias("rid")).unionByName(pairs.select(F.col("v").alias("rid"))).unionByName(full).distinct()
    texts = rows.select(F.col("__rid").alias("rid"), F.col("__h").alias("h"), F.col(text_col).alias("text"))
    texts = materialise(texts.join(asked.hint("merge"), "rid", "left_semi"), "near-texts")  # all texts are dealt out once, here
    sets = materialise(_sets(texts.join(full.hint("merge"), "rid", "left_semi")), "near-full-sets")
    sets = materialise(_linkable(sets), "near-linkable")
    more, members = _pairs(sets.select("rid", "fine"), _segments(F.col("fine"), *FINE), "fine")
    members = materialise(members, "near-full-buckets")
    pairs = materialise(pairs.unionByName(_plausible(more, texts)).distinct(), "near-pairs")
    edges = _verified(pairs, texts)
    if fingerprints:
        edges = edges.unionByName(simhash.row_links(rows.select(F.col("__rid").alias("rid"), F.col("__fp").alias("fp"))))
    edges = materialise(edges, "near-links")
    if members.isEmpty():
        return edges

    crowds = materialise(_crowds(members, sets), "near-crowds")
    sets = materialise(sets.select("rid", "s").join(crowds.select("rid").hint("merge"), "rid", "left_semi"), "near-sets")
    stars = lambda of: of.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    of = materialise(connected_components(edges), "near-joined")
    placed = _placed(crowds, of)
    first = F.row_number().over(Window.partitionBy("crowd").orderBy(F.desc("degree"), "key", "rid"))
    middles = placed.withColumn("place", first).where("place = 1")
    edges = materialise(stars(of).unionByName(_compared(middles, placed, sets)), "near-links")
    of = materialise(connected_components(edges), "near-joined")
    placed = _placed(crowds, of)
    return materialise(stars(of).unionByName(_compared(_outside(placed), placed, sets)), "near-links")


def _sets(texts: DataFrame) -> DataFrame:
    """``(rid, s, fine)``: the shingles of each of ``texts(rid, text)`` and their fine min-hashes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column(1)]
            fine = [min_hashes(x, FINE) for x in found]
            columns = [batch.column(0), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), pa.array(fine, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "s", "fine"])

    return texts.select("rid", "text").mapInArrow(lambda batches: returning(apply(batches)), "rid long, s array<long>, fine array<int>")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprints: bool = False) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near copies: the smallest id of each.

    Texts are near copies when the Jaccard similarity of their shingles
    (:func:`shingles`) is 0.8 or more, with ``fingerprints`` also when their
    SimHash fingerprints differ in two bits or fewer; a group is what such links
    join.  SimHash's links are all found.  No other is made that isn't verified; of those there are, 0.9998 or more are
    found in themselves, and more of the groups, as most are joined by several.
    The result doesn't depend on the order or the partitions of the rows.  Rows
    with a null id stay, as nothing says which of them is which; rows of a group
    that repeat the kept id stay with it.
    """
    small_batches(docs.sparkSession)
    rows = materialise(_sketched(docs, text_col, fingerprints), "near-rows")
    of = connected_components(links(rows, text_col, fingerprints))
    of = materialise(of.join(rows.select(F.col("__rid").alias("node"), F.col(id_col).alias("id")), "node"), "near-named")
    least = of.groupBy("component").agg(F.min("id").alias("least"))
    dropped = of.join(least, "component").where("least < id").select(F.col("node").alias("__rid"))
    return rows.join(dropped, "__rid", "left_anti").select(*docs.columns)
