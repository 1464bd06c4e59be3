"""Exact de-duplication that splits off heavy digests (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.shared import materialise


def normalised_digest(text: str) -> Column:
    """SHA-256 (binary) of the text, each run of ASCII white space made one space; null counts as empty."""
    squeezed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.unhex(F.sha2(squeezed, 256))


def frequent_digests(digests: DataFrame, support: float) -> DataFrame:
    """Verified winners of a Misra-Gries pass: ``(d, hot_keep, hot_size)``.

    ``freqItems`` keeps at most ``1 / support`` counters and finds every digest
    with at least that share of the rows (and perhaps some others); an exact
    count over all rows then keeps those that really repeat.  So at most
    ``1 / support`` rows of about 50 bytes come back, however large the input.
    """
    found = digests.select(F.hex("d").alias("d")).freqItems(["d"], support)
    found = found.select(F.explode("d_freqItems").alias("d")).select(F.unhex("d").alias("d"))
    exact = digests.join(F.broadcast(found), "d", "left_semi").groupBy("d")
    return exact.agg(F.min("id").alias("hot_keep"), F.count("*").alias("hot_size")).where("hot_size > 1")


def mark_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001, carry: list[str] | None = None
) -> DataFrame:
    """Each row of ``docs`` (columns ``carry``, or all) with ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after making each run of ``[\\x20\\x09-\\x0D]``
    one space; null counts as empty.  Of equal texts the row with the smallest
    id stays (null ids come last; of rows repeated with the same id exactly one
    stays, and ``keep_id`` is null only if all ids of the group are).  Input
    columns with the added names are replaced; all others are carried.

    Digests with at least ``support`` of the rows are found by a Misra-Gries
    pass, verified, and broadcast (at most ``1 / support`` rows): their rows
    never meet in one task.  The rest are dealt out by digest.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    carried = [c for c in (docs.columns if carry is None else carry) if c not in added]
    tagged = docs.select(*dict.fromkeys([*carried, id_col]), normalised_digest(text_col).alias("__d"))
    if text_col in carried:  # only the digests are kept for the passes that count them
        digests = materialise(tagged.select(F.col(id_col).alias("id"), F.col("__d").alias("d")), "digests")
    else:
        tagged = materialise(tagged, "digests")
        digests = tagged.select(F.col(id_col).alias("id"), F.col("__d").alias("d"))
    hot = frequent_digests(digests, support).select(F.col("d").alias("__d"), F.col("hot_keep").alias("__hot_keep"), F.col("hot_size").alias("__hot_size"))
    tagged = tagged.join(F.broadcast(hot), "__d", "left")
    loser = F.col("__hot_size").isNotNull() & ~F.coalesce(F.col(id_col) == F.col("__hot_keep"), F.col("__hot_keep").isNull())
    rest = Window.partitionBy("__d")
    order = rest.orderBy(F.col(id_col).asc_nulls_last())
    lost = tagged.where(loser).select(
        "*", F.col("__hot_keep").alias("__keep"), F.col("__hot_size").alias("__size"), F.lit(False).alias("__kept")
    )
    dealt = tagged.where(~loser).select(
        "*",
        F.coalesce("__hot_keep", F.min(id_col).over(rest)).alias("__keep"),
        F.coalesce("__hot_size", F.count(F.lit(1)).over(rest)).alias("__size"),
        (F.row_number().over(order) == 1).alias("__kept"),
    )
    out = lost.unionByName(dealt)
    return out.select(
        *carried,
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.lower(F.hex("__d")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`mark_duplicates` keeps, with their columns."""
    added = ("keep_id", "group_size", "kept", "text_sha256")
    names = {c: f"__own_{c}" for c in docs.columns if c in added}
    marked = mark_duplicates(docs.withColumnsRenamed(names), **options).where("kept")
    return marked.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
