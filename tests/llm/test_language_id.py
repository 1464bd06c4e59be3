import random

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import language_id, queries


def brute_phrases(text, learned):
    """Greedy longest matches of the whole text."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in learned:
            size += 1
        at += size
        n += 1
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(2)
    learned = {k: bytes(rng.choices(b"abc d", k=300)) for k in ("x", "y")} | {"z": bytes(rng.choices(b"ab", k=3000))}
    parser = language_id.CrossParser(learned)
    texts = [bytes(rng.choices(b"abcd e\xc3", k=rng.choice([1, 5, 511, 512, 513, 700, 1300, 4000]))) for _ in range(60)] + [b"a", b""]
    texts += [learned["z"][a:b] for a, b in ((0, 3000), (7, 2900), (1, 1025))]  # single phrases over many blocks
    texts += [learned["z"][:1700] + b"e" + learned["z"][100:2500] + learned["x"], b"", learned["y"] * 9, b"a" * 5000]
    got = parser.phrases(texts)
    for row, text in zip(got.tolist(), texts):
        assert row == [brute_phrases(text, learned[k]) for k in parser.names]


def test_ties_long_samples_and_too_many_languages(docs_of, monkeypatch):
    rows = [(1, "same words here", "b"), (2, "same words here", "a"), (3, "long only " * 40, "c"), (4, "long only " * 60, "c"), (1, "same words here", "b")]
    parser = language_id.learn(docs_of(rows), sample_bytes=50)
    assert parser.names == ["a", "b", "c"]
    out = language_id.identify(docs_of([(1, "same words"), (2, "long only long")]), parser).collect()
    assert [(r.lang_pred, r.score < 0.5) for r in out] == [("a", True), ("c", False)]
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language_id.learn(docs_of(rows))


def test_held_out_accuracy(spark, sf_dir):
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    out = queries.op2_language_id(spark, sf_dir).join(truth, "doc_id")
    right, rows = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert rows > 200 and right > 0.98


def test_odd_rows(docs_of):
    rows = [(1, "the cat sat on the mat and the dog", "en"), (2, "le chat est sur la table avec le chien", "fr"), (3, "no label", None), (None, None, "fr")]
    parser = language_id.learn(docs_of(rows))
    assert parser.names == ["en", "fr"]
    odd = docs_of([(1, None), (2, ""), (3, "12 ... 7"), (4, "the mat"), (5, "la table"), (5, "la table"), (6, "漢字"), (7, "the dog sat " * 9000)]).withColumn("score", F.lit("clash"))
    got = sorted((r.doc_id, r.lang_pred) for r in language_id.identify(odd, parser, carry=["doc_id"]).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "fr"), (5, "fr"), (6, "en"), (7, "en")]
    nothing = language_id.learn(docs_of([]))
    assert [r.lang_pred for r in language_id.identify(docs_of([(1, "abc")]), nothing).collect()] == ["und"]
    assert language_id.identify(docs_of([]), parser).count() == 0
