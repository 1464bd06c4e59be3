"""One very long text among short ones, through every operator that reads texts (8,000,000 words: 50 MB, in LONG_TEXT_WORDS)."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate, exact_dedup, language_id, language_model, near_copies, quality, queries, sentencepiece_bpe, simhash, substring_dedup

rng = random.Random(8)
WORDS = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
SIZE = int(os.environ.get("LONG_TEXT_WORDS", "700000"))
LONG = " ".join(rng.choices(WORDS, k=SIZE))
ROWS = [(1, LONG), (2, "a short text of some words"), (3, None), (4, "another short text"), (5, "a short text of some words")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('long')}/documents"
    spark.createDataFrame([(2, ROWS[1][1], "en"), (3, None, None), (4, ROWS[3][1], "en"), (5, ROWS[4][1], "en"), (1, LONG, "xx")], "doc_id long, text string, lang string").write.parquet(path)
    return spark.read.parquet(path)


def test_counts(spark, docs):
    items = spark.createDataFrame([(7, " ".join(LONG.split()[-12:]))], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.scan(docs, items).collect()}
    assert found[1].n_words == SIZE and found[1].n_hit >= 12 and found[2].n_hit == 0
    out = {r.doc_id: r for r in language_model.score_texts(docs, F.lit(True)).collect()}
    assert out[1].n_tokens == SIZE + 1 and out[3].n_tokens == 1 and len(out) == 5
    assert {r.doc_id: r.kept for r in exact_dedup.mark_duplicates(docs, carry=["doc_id"]).collect()} == {1: True, 2: True, 3: True, 4: True, 5: False}


def test_near(docs):
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 2}
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).select("doc_id").collect()) == [1, 2, 3, 4]


def test_language_and_quality(spark, docs):
    parser = language_id.learn(docs)
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs, parser, carry=["doc_id"]).collect()} == {1: "xx", 2: "en", 3: "und", 4: "en", 5: "en"}
    trees = quality.learn(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), rounds=2)
    assert quality.score_quality(docs, trees, carry=["doc_id"]).where("score between 0 and 1").count() == 5


def test_tokens_and_repeats(docs):
    tokens = {r.doc_id: r for r in sentencepiece_bpe.encode(docs, queries.tokenizer_path(), decode=True).select("doc_id", F.size("ids").alias("n"), F.sha2("decoded", 256).alias("h")).collect()}
    assert tokens[1].h == hashlib.sha256(LONG.encode()).hexdigest() and tokens[1].n > SIZE and tokens[3].n == 0
    out = substring_dedup.remove_repeats(docs.withColumn("text", F.when(F.col("doc_id") == 4, F.lit(LONG[-30_000:-29_000])).otherwise(F.col("text"))))
    spans = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in out.select("doc_id", "spans").collect()}
    assert spans == {1: [(len(LONG) - 30_000, len(LONG) - 29_000)], 2: [], 3: [], 4: [(0, 1000)], 5: []}
