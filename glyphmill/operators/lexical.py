"""Inverted index and BM25 over a set of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.config import DEFAULTS
from glyphmill.functions.text import tokens

#: Words of all queries that are sent to every task, to thin out and to weigh the corpus's tokens; more are joined by a shuffle.
BROADCAST_WORDS = 200_000


def term_frequencies(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``(chunk_id, token, tf)``."""
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.explode(tokens(F.col(text_col))).alias("token"))
    return rows.groupBy("chunk_id", "token").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``(chunk_id, dl)``, chunks without tokens included."""
    return chunks.select(F.col(id_col).alias("chunk_id"), F.size(tokens(F.col(text_col))).cast("long").alias("dl"))


def corpus_stats(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """One row ``(n, avgdl)`` over all chunks; 0.0 where there are none."""
    return lengths(chunks, id_col, text_col).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf(n, df):
    """``ln(1 + (n - df + 0.5) / (df + 0.5))``."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def document_frequencies(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``(token, df, idf)``; the count behind the idf includes chunks without tokens."""
    rows = chunks.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token"))
    found = rows.groupBy("token").agg(F.count("*").alias("df"))
    return found.crossJoin(F.broadcast(chunks.agg(F.count("*").alias("n")))).select("token", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """``(query_id, token, qtf, first_pos)``: repeated words count repeatedly."""
    rows = queries.select(F.col(id_col).alias("query_id"), F.posexplode(tokens(F.col(text_col))).alias("pos", "token"))
    return rows.groupBy("query_id", "token").agg(F.count("*").alias("qtf"), F.min("pos").alias("first_pos"))


def bm25_scores(queries: DataFrame, chunks: DataFrame, query_id: str = "query_id", chunk_id: str = "chunk_id", text_col: str = "text", config=DEFAULTS) -> DataFrame:
    """``(query_id, chunk_id, score, first_pos)`` of every chunk that shares a word with the query.

    The corpus's tokens are thinned to the queries' words before anything is
    shuffled, so postings of other words never leave their task.
    """
    terms = query_terms(queries, query_id, text_col)
    vocabulary = terms.select("token").distinct()
    few = terms.count() <= BROADCAST_WORDS
    vocabulary = F.broadcast(vocabulary) if few else vocabulary
    sized = chunks.select(F.col(chunk_id).alias("chunk_id"), tokens(F.col(text_col)).alias("w")).select("chunk_id", "w", F.size("w").alias("dl"))
    stats = sized.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    hits = sized.select("chunk_id", "dl", F.explode("w").alias("token")).join(vocabulary, "token", "left_semi")
    postings = hits.groupBy("token", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    known = postings.groupBy("token").agg(F.expr("count(tf, dl)").alias("df"))  # of all columns, so that one shuffle serves this and the scores
    weighed = terms.join(known, "token").crossJoin(F.broadcast(stats))
    weighed = weighed.select("query_id", "token", "first_pos", "avgdl", (F.col("qtf") * idf(F.col("n"), F.col("df"))).alias("weight"))
    weighed = F.broadcast(weighed) if few else weighed  # else words that many texts have would gather in one task
    k1, b = config.bm25_k1, config.bm25_b
    gain = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return weighed.join(postings, "token").groupBy("query_id", "chunk_id").agg(F.sum(gain).alias("score"), F.min("first_pos").alias("first_pos"))


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int, **options) -> DataFrame:
    """``(query_id, chunk_id, rank, score)``: the ``k`` best of each query.

    Scores count to eight places; ties go to the chunk met first, by the
    position of the query's first word in it and then by its id.
    """
    scored = bm25_scores(queries, chunks, **options).withColumn("score", F.round("score", 8))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_pos", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "score")
