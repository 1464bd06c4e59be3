"""Retrieval of a set of questions: vectors alone, or fused with BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.config import DEFAULTS, EngineConfig
from glyphmill.operators.fusion import rrf
from glyphmill.operators.lexical import bm25_topk
from glyphmill.operators.vector import knn


def source_of(meta_cols: dict[str, str] | None = None):
    """A citation's five fields; names in the table may differ."""
    names = meta_cols or {}
    fields = ("source", "title", "page", "line_start", "line_end")
    return F.struct(*[F.col(names.get(f, f)).alias(f) for f in fields])


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, n_results: int | None = None, config: EngineConfig = DEFAULTS) -> DataFrame:
    """``(query_id, chunk_id, rank)`` for ``questions(query_id, text, embedding)``.

    Hybrid: the candidate pools of both searches are fused; the distance
    threshold holds for the vector pool alone.  Chunks without metadata (here:
    that ``chunks`` doesn't hold) go after the cut, so fewer may remain.
    """
    n = n_results or config.n_results
    pool = max(config.hybrid_candidates, n)
    if not config.hybrid_enabled:
        found = knn(questions, vectors, n, config.distance_threshold)
    else:
        near = knn(questions, vectors, pool, config.distance_threshold)
        words = bm25_topk(questions, chunks, pool, config=config)
        found = rrf([near, words], [config.hybrid_vector_weight, config.hybrid_lexical_weight], config.hybrid_rrf_k, n)
    return found.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")


def hydrate(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds text and citation to ``found``, after the limit."""
    return found.join(chunks, "chunk_id")
