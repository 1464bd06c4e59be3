"""Reciprocal-rank fusion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(rankings: Sequence[DataFrame], weights: Sequence[float], constant: int, k: int) -> DataFrame:
    """``(query_id, chunk_id, rank, vote)`` from rankings ``(query_id, chunk_id, rank)``.

    Each ranking votes ``weight / (constant + rank)``; an id twice in one votes
    twice.  Ties go to the first ranking that has the id, then to its place there.
    """
    if len(rankings) != len(weights):
        raise ValueError("every ranking needs a weight")
    votes = [
        r.select("query_id", "chunk_id", (F.lit(float(w)) / (constant + F.col("rank"))).alias("vote"), F.struct(F.lit(i).alias("list"), F.col("rank")).alias("met"))
        for i, (r, w) in enumerate(zip(rankings, weights))
    ]
    votes = reduce(DataFrame.unionByName, votes).groupBy("query_id", "chunk_id").agg(F.round(F.sum("vote"), 12).alias("vote"), F.min("met").alias("met"))
    best = Window.partitionBy("query_id").orderBy(F.desc("vote"), "met.list", "met.rank")
    return votes.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "vote")
