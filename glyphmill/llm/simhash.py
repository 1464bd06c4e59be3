"""SimHash near-duplicates, linked by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import connected_components, materialise, small_batches, spread

#: Signature buckets up to this many fingerprints are compared pair by pair; larger ones take the exact way of full-width variants.
BUCKET = 16
#: Fingerprints of a task that writes out their signatures.
SIGNED = 50_000
#: Buckets of more than two that are sent to every task to pick their members; beyond this many, members are found by a shuffled join.
BROADCAST_BUCKETS = 500_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text, as an unsigned number.

    A-Z are lower-cased; words are runs of anything but ``[\\x20\\x09-\\x0D]``;
    every shingle (repeats included; the whole sequence if there are fewer
    words) votes with its XXH64, seed 42.  A bit is set if over half the votes
    have it.  Null and texts without words: zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    votes = np.fromiter((digest(join(x), 42) for x in zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else (digest(join(words), 42),), np.uint64, n)
    count = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = votes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` for each row; ``fp`` is the fingerprint's bits as a signed long."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), fp(text_col).alias("fp"))


def _variants(fp: Column) -> Column:
    """A fingerprint's signatures: each 32-bit half with one bit made a wildcard, tagged by half and bit.

    Where two fingerprints differ in two bits or fewer, one half differs in one
    at most, so they share the signature that has this bit as its wildcard.
    """
    low, high = fp.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(fp, 32)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    one = lambda half, side: F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: half.bitwiseAND(F.bitwise_not(bit(i))) + F.call_function("shiftleft", (i + 32 * side).cast("long"), F.lit(32)),
    )
    return F.concat(one(low, 0), one(high, 1))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(u, v)`` between the distinct ``fps(fp)`` that join all fingerprints two or fewer bits apart.

    Signatures of one wildcard are joined by equality.  Buckets of up to
    ``bucket`` fingerprints are verified pair by pair.  The members of larger
    ones are linked exactly without pairs: each fingerprint also stands for the
    64 values one bit away (one wildcard over its full width), two fingerprints
    share such a value if and only if they differ in two bits or fewer, and all
    that share one are linked to the least of them.
    """
    keyed = spread(fps, fps.count(), SIGNED).select("fp", F.explode(_variants(F.col("fp"))).alias("sig"))
    sizes = keyed.groupBy("sig").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = materialise(sizes, "simhash-buckets")
    close = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= 2
    out = sizes.where("n = 2").where(close(F.col("a"), F.col("b"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    more = sizes.where("n > 2").select("sig", "n")
    way = "broadcast" if more.count() <= BROADCAST_BUCKETS else "merge"  # 16 bytes each
    larger = materialise(keyed.join(more.hint(way), "sig"), "simhash-members")
    lists = larger.where(F.col("n") <= bucket).groupBy("sig").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y > x) & close(x, y)), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    out = out.unionByName(lists.select(F.explode(pairs).alias("p")).select("p.u", "p.v"))
    crowd = larger.where(F.col("n") > bucket).select("fp").distinct()
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    values = crowd.select("fp", F.explode(near).alias("value"))
    least = values.groupBy("value").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = values.join(least, "value").where("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    return out.unionByName(stars).distinct()


def row_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(u, v)`` that join all rows of ``fps(rid, fp)`` whose fingerprints are two or fewer bits apart."""
    named = materialise(fps.groupBy("fp").agg(F.min("rid").alias("least")), "simhash-distinct")
    same = fps.join(named.hint("merge"), "fp").where("rid <> least").select(F.col("least").alias("u"), F.col("rid").alias("v"))
    of = lambda end: named.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_rid"))
    between = links(named.select("fp"), bucket).join(of("u"), "u").join(of("v"), "v")
    return same.unionByName(between.select(F.col("u_rid").alias("u"), F.col("v_rid").alias("v")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``(id, fingerprint, component_id)`` for each row of ``docs``.

    Rows are near-duplicates when their fingerprints (:func:`fingerprint`)
    differ in two bits or fewer; ``component_id`` is the smallest id reachable
    over such links, the row's own included.  ``fingerprint`` is 16 lowercase
    hex digits.  Rows with a null id get an answer too but never name a
    component (null where no row of the component has an id).  All texts
    without words share the fingerprint zero.
    """
    fp = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    named = materialise(fp.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    of = connected_components(links(named.select("fp"), bucket)).withColumnRenamed("node", "fp")
    of = named.join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    of = materialise(of, "simhash-components")
    names = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(names, "component").select("fp", "component_id")
    return fp.join(of, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near-duplicates: the smallest id of each.

    Rows with a null id stay, as nothing says which of them is which; rows that
    repeat a kept id with a text of the same component stay with it.
    """
    found = near_duplicates(docs, id_col, text_col, shingle).select(F.col(id_col).alias("__id"), "component_id").distinct()
    dropped = found.where("__id is not null and component_id < __id").select("__id").distinct()
    return docs.join(dropped, docs[id_col] == dropped["__id"], "left_anti")
