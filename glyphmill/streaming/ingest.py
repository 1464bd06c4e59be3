"""Ingestion of new and changed documents as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.config import DEFAULTS
from glyphmill.functions.chunking import chunk_pages
from glyphmill.operators.ingest import Store, plan, prepare_chunks
from glyphmill.operators.pages import merge_pages
from glyphmill.sources.corpus import pages_of

CHUNK_SCHEMA = "source string, chunk_id string, chunk_index int, page int, line_start int, line_end int, text string, title string, author string"


def ingest_batch(files: DataFrame, store: Store, model: str = DEFAULTS.embedding_model, read: Callable[[DataFrame], DataFrame] = pages_of, size: int = DEFAULTS.chunk_size) -> None:
    """Brings ``files(source, content)`` into the store.

    Files whose fingerprint and model are registered are left out before any
    is read; those that can't be read are noted as errors.  Of a name that
    comes twice in a batch one file counts.  Doing a batch again changes nothing.
    """
    found = files.select("source", "content", F.sha2("content", 256).alias("fingerprint")).dropDuplicates(["source"])
    known = plan(found.select("source", "fingerprint", F.lit(None).cast("long").alias("chunks")), store.registry(), model)
    fresh = known.where("status <> 'unchanged'").select("source", "fingerprint")
    pages = read(found.join(fresh.select("source"), "source", "left_semi")).persist()
    try:
        store.note_errors(pages.where("error is not null"))
        bad = pages.where("error is not null").select("source").distinct()
        meta = pages.where("text is not null").groupBy("source").agg(F.first("title", True).alias("title"), F.first("author", True).alias("author"))
        whole = merge_pages(pages.where("text is not null").select("source", "ord", "number", "text", "labelled"))
        chunks = prepare_chunks(chunk_pages(whole.select("source", "ord", F.col("number").alias("page"), "text"), size), order=("ord", "chunk_no"))
        chunks = chunks.join(meta, "source").select(*[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])
        counts = chunks.groupBy("source").agg(F.count("*").alias("n"))
        read_ = fresh.join(bad, "source", "left_anti").join(counts, "source", "left")
        store.upsert(plan(read_.select("source", "fingerprint", F.coalesce("n", F.lit(0)).alias("chunks")), store.registry(), model), chunks, model)
    finally:
        pages.unpersist()


def ingest_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, model: str = DEFAULTS.embedding_model, **options):
    """Starts to ingest the PDF and EPUB files that are in ``folder`` and not yet in the checkpoint, and ends when there are none left."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{pdf,epub,PDF,EPUB}").load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), "content")
    handle = lambda batch, _: ingest_batch(batch, store, model, **options)
    return named.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
