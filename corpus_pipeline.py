"""Corpus pipeline: language ID, exact and near de-duplication, decontamination, tokenisation.

``STAGES`` are applied one after another; each takes ``(spark, docs, sf_dir)``
and returns a frame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate, exact_dedup, language_id, near_copies, sentencepiece_bpe
from glyphmill.llm.queries import table, tokenizer_path
from glyphmill.llm.shared import materialise

#: Mean UTF-8 bytes of a phrase below which a text resembles none of the learned languages.
LEAST_PHRASE_BYTES = 2.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those that no language's automaton matches beyond two bytes a phrase.

    The automata learn from the stage's own labelled rows; ``lang`` stays as it
    came, or is the predicted one where it was null.
    """
    parser = language_id.learn(docs)
    found = language_id.identify(docs, parser)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("phrase_bytes") >= LEAST_PHRASE_BYTES))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that of the smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest doc_id.

    SimHash links fingerprints of 64 bits that differ in two or fewer; texts
    with five-word shingles 0.8 alike, most of which differ in more, are linked
    as well.
    """
    return near_copies.keep_one(docs, fingerprints=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window of ten words occurs go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"), window=10)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of the decoded text, which must be the text again."""
    out = sentencepiece_bpe.encode(docs, tokenizer_path(), spans=False, decode=True, carry=["doc_id", "lang", "source"])
    return out.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near copies and the tokenizer can't be written in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None
