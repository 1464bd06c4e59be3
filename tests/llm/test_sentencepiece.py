import hashlib
import random
import tracemalloc

import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from glyphmill.llm import queries, sentencepiece_bpe
from glyphmill.llm.sentencepiece_bpe import CharMap, Encoder, Model

ODD = ["", " ", "  ", "a", "  lead", "trail  ", "a  b\n\tc", "<s> x</s>", "\x00a", "é ｆｕｌｌ ﬁ 中文 😀", "a▁b", "▁", "▁▁ ▁x", "<0x41>", "\u200b\ufeff", "x" * 5000, "ñ" * 300, "\r\n\r\n", "🙂🙃" * 40, "<unk>", " <unk> x"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())


@pytest.fixture(scope="module")
def model():
    return Model(queries.tokenizer_path())


def check_tiles(text, ids, begins, ends, model):
    size = len((text or "").encode())
    assert len(ids) == len(begins) == len(ends)
    if len(ids):
        assert begins[0] == 0 and ends[-1] == size
        for k in range(1, len(ids)):
            assert begins[k] <= ends[k] and begins[k] >= begins[k - 1]


def test_odd_texts_match_the_library(library, model):
    encoder = Encoder(model)
    for text in ODD:
        ids, begins, ends = encoder.encode(text)
        assert ids.tolist() == library.encode(text), text
        assert model.decode(ids) == library.decode(ids), text
        check_tiles(text, ids, begins, ends, model)


def test_random_texts_match_the_library(library, model):
    rng, encoder = random.Random(5), Encoder(model)
    alphabet = list("abcdefg ABC  .,\n\t0123é中ü▁😀") + ["the ", "ing", "  ", "tion", "\u0301", "\ud7ff"]
    for _ in range(600):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        ids, begins, ends = encoder.encode(text)
        assert ids.tolist() == library.encode(text)
        assert model.decode(ids) == library.decode(ids)
        check_tiles(text, ids, begins, ends, model)


def test_spans_name_the_source_bytes(model):
    for text in ("Hello  wörld", "Hello wörld\nline two", "ab▁c d"):
        ids, begins, ends = Encoder(model).encode(text)
        raw = text.encode()
        for i, b, e in zip(ids, begins, ends):
            piece = model.pieces[i].replace("▁".encode(), b" ") if model.kinds[i] == 1 else raw[b:e]
            assert raw[b:e].replace("▁".encode(), b" ") == piece or (b == 0 and b" " + raw[b:e] == piece)


def test_both_ways_agree(model, library):
    """Words on their own, and the whole normalised string with its alignment, short and long merges."""
    rng, fast, slow = random.Random(8), Encoder(model), Encoder(model)
    slow.model = Model(queries.tokenizer_path())
    slow.model.by_line = False
    slow.model.pairs = None
    for _ in range(300):
        text = "".join(rng.choices(["the", "tion", "é", "\n", " ", " a", "中", "x", "\t"], k=rng.randint(1, 40)))
        for a, b in zip(fast.encode(text), slow.encode(text)):
            assert a.tolist() == b.tolist(), text


def test_compiled_map_matches_the_library():
    """The library's own NFKC map: longest prefixes, alignment and space rules."""
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    blob = normalizer.serialized_model_proto()
    own = Model.__new__(Model)
    spec = dict(sentencepiece_bpe._fields(blob)).get(3)
    settings = dict(sentencepiece_bpe._fields(spec))
    own.char_map, own.dummy_prefix, own.squeeze, own.escape = CharMap(settings[2]), True, True, True
    rng = random.Random(3)
    alphabet = list("ab  é①ﬁｆ㍿ Å가ﷺ\u3000\u00a0\t\n") + ["e\u0301", "カ\u3099", "\u200b", "中"]
    texts = ["", " ", "ﬁne", "  ①  x ", *("".join(rng.choices(alphabet, k=rng.randint(1, 25))) for _ in range(400))]
    for text in texts:
        expected, offsets = normalizer.normalize(text, with_offsets=True)
        got, source = own.normalise(text)
        assert got.decode() == expected, repr(text)
        assert len(source) == len(got) + 1 and all(a <= b for a, b in zip(source, source[1:]))


def test_whole_table(spark, small_dir, library):
    out = {r.doc_id: r for r in queries.op1_sentencepiece(spark, small_dir).collect()}
    rows = pq.read_table(f"{small_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(out) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "")
        got = out[r["doc_id"]]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert got.source_bytes == len((r["text"] or "").encode())


def test_odd_tables(docs_of):
    out = sentencepiece_bpe.encode(docs_of([(1, None), (None, ""), (1, "x"), (1, "x")]).withColumn("ids", F.lit("clash")), queries.tokenizer_path(), decode=True)
    rows = out.collect()
    assert out.columns == ["doc_id", "ids", "begins", "ends", "decoded"]
    assert sorted(len(r.ids) for r in rows) == [0, 0, 1, 1] and {r.decoded for r in rows} == {"", "x"}
    assert sentencepiece_bpe.encode(docs_of([]), queries.tokenizer_path()).count() == 0
    back = sentencepiece_bpe.decode(out.select("ids"), queries.tokenizer_path()).collect()
    assert sorted(r.decoded for r in back) == ["", "", "x", "x"]


def test_forgotten_words_match_the_library(model, library, monkeypatch):
    """Words that are met again after others, with room for few, also in texts of more words than there is room for."""
    monkeypatch.setattr(sentencepiece_bpe, "CACHE_WORDS", 50)
    rng, encoder = random.Random(4), Encoder(model)
    words = ["".join(rng.choices("abcdeé\n", k=rng.randint(1, 40))) for _ in range(200)]
    for _ in range(60):
        texts = [rng.choice([" ", "  "]).join(rng.choices(words[at : at + 40], k=rng.choice([3, 30, 90]))) for at in rng.choices(range(160), k=3)]
        for text, (ids, begins, ends) in zip(texts, encoder.encode_many(texts)):
            assert ids.tolist() == library.encode(text)
            check_tiles(text, ids, begins, ends, model)


def test_a_known_word_is_no_heap_of_objects(model):
    """Tens of thousands of words come and go with a task: each costs its text and a place in shared arrays."""
    rng = random.Random(6)
    words = list({"".join(rng.choices("abcdefgh", k=8)) for _ in range(40_000)})
    encoder = Encoder(model)
    encoder.encode(" ".join(words[:10]))
    tracemalloc.start()
    for at in range(0, len(words), 4_000):
        encoder.encode(" ".join(words[at : at + 4_000]))
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used / len(words) < 220
