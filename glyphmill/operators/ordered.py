"""Row numbers, the row before, and islands of ordered groups, however large one of them is."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.sources.scratch import written

#: The column that says in which block of the order a row lies.
BLOCK = "block__"


def _same(keys: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in keys])


def _edges(rows: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """``aggregates`` of each block's first and last group: two rows a block at most, and the only groups that other blocks can have too."""
    of = F.struct(*keys)
    ends = rows.groupBy(BLOCK).agg(F.min(of).alias("a"), F.max(of).alias("z"))
    here = rows.join(F.broadcast(ends), BLOCK).where(of.eqNullSafe(F.col("a")) | of.eqNullSafe(F.col("z")))
    return here.groupBy(BLOCK, *keys).agg(*aggregates)


def _carried(rows: DataFrame, keys: Sequence[str], edges: DataFrame, **columns: Callable[[object], Column]) -> DataFrame:
    """``rows`` with ``columns``, each made of the edges of a group's earlier blocks; null where there are none."""
    by = Window.partitionBy(*keys).orderBy(BLOCK)  # as many rows as a group has blocks
    carry = edges.select(BLOCK, *keys, *[f(by).alias(name) for name, f in columns.items()])
    names = {k: f"{k}__" for k in (BLOCK, *keys)}
    carry = F.broadcast(carry.withColumnsRenamed(names))
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return rows.join(carry, on, "left").drop(*names.values())


def blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``rows`` in written blocks of the order by ``keys`` and ``order``, each with its number."""
    by = [*keys, *order]
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    return written(dealt.withColumn(BLOCK, F.spark_partition_id()), "ordered-blocks")


def scan(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], before: Sequence[str] = (), opens: Callable[[Column], Column] | None = None, parts: int | None = None, keep_block: bool = False
) -> DataFrame:
    """``rows`` with ``place``, ``before`` and ``island``, within the groups of ``keys`` in ``order``.

    ``place`` counts rows from 0.  ``before`` has the columns of that name of
    the row before, null for a group's first.  ``island`` counts the rows up to
    here for which ``opens(before)`` is true, the first of a group among them
    if that is true of null.  ``order`` should be unique in a group; equal rows
    follow each other in some order.

    The rows are range-partitioned by key and order, so that a group of any size
    lies in as many blocks as it fills.  Each block is numbered by itself; what
    earlier blocks of a group hand on (counts, a last row) is a table of two
    rows a block.
    """
    laid = blocks(rows, keys, order, parts)
    by = Window.partitionBy(BLOCK, *keys).orderBy(*order)
    last = F.struct(*before) if before else F.lit(0)
    at = F.struct(*order)
    edges = _edges(laid, keys, F.count("*").alias("n"), F.max_by(last, at).alias("last"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    out = laid.withColumns({"n__": F.row_number().over(by), "b__": F.lag(last).over(by)})
    out = _carried(out, keys, edges, o__=lambda w: F.sum("n").over(earlier(w)), l__=lambda w: F.lag("last").over(w))
    out = out.withColumn("place", F.col("n__") - 1 + F.coalesce("o__", F.lit(0)))
    if before:
        out = out.withColumn("before", F.coalesce("b__", F.when(F.col("n__") == 1, F.col("l__"))))
    out = out.drop("n__", "b__", "o__", "l__")
    if opens is not None:
        out = written(out.withColumn("f__", F.coalesce(opens(F.col("before")), F.lit(False)).cast("long")), "ordered-islands")
        edges = _edges(out, keys, F.sum("f__").alias("f"))
        out = out.withColumn("s__", F.sum("f__").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        out = _carried(out, keys, edges, c__=lambda w: F.sum("f").over(earlier(w)))
        out = out.withColumn("island", F.col("s__") + F.coalesce("c__", F.lit(0))).drop("f__", "s__", "c__")
    return out if keep_block else out.drop(BLOCK)
