import hashlib
import random
import re

import pytest
import sentencepiece
from test_decontaminate import brute as brute_hits
from test_near_copies import brute as brute_near

import corpus_pipeline
from glyphmill.llm import language_id, queries, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, small_dir, tmp_path_factory):
    """The rows before and after each stage, each written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen.append(docs.collect())
    return seen


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_columns(steps):
    assert all(r.__fields__ == COLUMNS for rows in steps[:-1] for r in rows[:1])


def test_language(spark, steps):
    docs = spark.createDataFrame(steps[0], "doc_id long, text string, lang string, source string, n_chars long")
    learned = language_id.learn(docs)
    expected = []
    for r in steps[0]:
        data = language_id.normalise(r.text)
        if data and len(data) / learned.phrases([data]).min() >= corpus_pipeline.LEAST_PHRASE_BYTES:
            expected.append(r.doc_id)
    assert ids(steps[1]) == sorted(expected)
    assert len(steps[1]) > 0.95 * len(steps[0])


def test_exact_copies(steps):
    groups = {}
    for r in steps[1]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
    assert ids(steps[2]) == sorted(map(min, groups.values()))


def test_near_copies(steps):
    kept, pairs = brute_near([(r.doc_id, r.text) for r in steps[2]])
    assert ids(steps[3]) == kept and pairs > 0


def test_contamination(spark, steps, small_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [d for d, *_, hit in brute_hits([(r.doc_id, r.text) for r in steps[3]], items) if not hit]
    assert ids(steps[4]) == sorted(clean) and len(clean) < len(steps[3])


def test_tokens(steps):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    texts = {r.doc_id: r.text for r in steps[4]}
    assert ids(steps[5]) == sorted(texts)
    for r in steps[5]:
        assert list(r.ids) == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages_in_turn(spark, steps, small_dir):
    assert sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, small_dir).collect()) == sorted(r.ids_sha256 for r in steps[-1])


def test_odd_and_empty_tables(spark, docs_of, small_dir, tmp_path):
    for rows in ([], [(None, None), (1, None), (2, ""), (3, "only one text with words"), (3, "only one text with words"), (None, "x y")]):
        docs = docs_of(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame((out := stage(spark, docs, small_dir)).collect(), out.schema)
        assert {r.doc_id for r in docs.collect()} <= {3, None}


def by_fingerprints(rows):
    """Ids that stay when fingerprints two or fewer bits apart are linked."""
    prints = [simhash.fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min(d for (d, _), h in zip(rows, group) if h == g) for g in set(group)}
    return sorted(d for (d, _), g in zip(rows, group) if least[g] == d)


def test_near_copies_by_fingerprints(spark, docs_of, small_dir):
    """SimHash links texts that a line said again and again makes alike, though they share few distinct shingles."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(40)]
    for _ in range(4):
        line = " ".join(word() for _ in range(11))
        rows += [(len(rows) + k, " ".join([*[line] * 60, *(word() for _ in range(12))])) for k in range(3)]
    rng.shuffle(rows)
    kept = by_fingerprints(rows)
    assert len(kept) < len(rows) == len(brute_near(rows)[0])
    assert ids(corpus_pipeline.drop_near_copies(spark, docs_of(rows), small_dir).collect()) == kept
