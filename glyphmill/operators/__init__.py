"""Operators over DataFrames: retrieval, evaluation, ingestion, limits, pages, grounding and models."""
