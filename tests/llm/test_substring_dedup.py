import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import queries, substring_dedup
from glyphmill.llm.suffix_array import repeated_windows, suffix_array


def brute(rows, length):
    """(doc, n_bytes, n_removed, n_spans, kept) by counting every window."""
    data = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(hashlib.blake2b(b[i : i + length], digest_size=12).digest() for _, b in data for i in range(len(b) - length + 1))
    for d, b in data:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if count[hashlib.blake2b(b[i : i + length], digest_size=12).digest()] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        yield d, len(b), int(mask.sum()), spans, np.frombuffer(b, np.uint8)[~mask].tobytes()


def test_suffix_arrays():
    rng = random.Random(1)
    for k in range(150):
        n, letters = rng.randint(1, 250), rng.choice([2, 3, 10, 200])
        text = np.array([rng.randint(1, letters) for _ in range(n)] + [0], np.uint8)
        if k % 5 == 0:
            text[: n // 2] = 1
        raw = text.tobytes()
        assert suffix_array(text).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_suffix_arrays_of_numbers():
    """The recursion's strings, whose buckets are handled in groups."""
    rng = random.Random(2)
    for k in range(120):
        n, most = rng.randint(1, 400), rng.choice([2, 5, 300, 10**5])
        text = [rng.randint(1, most) for _ in range(n)] + [0]
        if k % 4 == 0:
            text[: n // 2] = (text[:3] * n)[: n // 2]
        assert suffix_array(np.array(text, np.int64)).tolist() == sorted(range(n + 1), key=lambda i: text[i:])


def test_repeated_windows():
    rng = random.Random(4)
    for k in range(120):
        base = bytes(rng.choices(b"ab" if k % 2 else b"abcdefg \n", k=200))
        texts = []
        for _ in range(rng.randint(1, 6)):
            at = rng.randint(0, 150)
            piece = bytearray(base[at : at + rng.randint(0, 120)])
            if piece and rng.random() < 0.7:
                piece[rng.randrange(len(piece))] = ord("X")
            texts.append(bytes(piece))
        length = rng.choice([5, 20, 33])
        count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        assert [x.tolist() for x in repeated_windows(texts, length)] == [[count[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]


@pytest.mark.parametrize("kind", ["cyrillic", "periodic"])
def test_overlaps_beyond_a_window(kind):
    """Segments that share far more bytes than a window holds."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("абвгдежзик", k=rng.randint(2, 7))) + " "
    for _ in range(8):
        texts = []
        for _ in range(12):
            shared = "".join(word() for _ in range(90)).encode()[:730] if kind == "cyrillic" else (word() * 200).encode()[: rng.randint(700, 1500)]
            for _ in range(rng.randint(2, 4)):
                texts.append("".join(word() for _ in range(rng.randint(0, 8))).encode() + shared + "".join(word() for _ in range(rng.randint(0, 8))).encode())
        rng.shuffle(texts)
        count = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
        assert [x.tolist() for x in repeated_windows(texts, 400)] == [[count[t[i : i + 400]] > 1 for i in range(len(t) - 399)] for t in texts]


def test_whole_table(spark, small_dir):
    rows = [tuple(r.values()) for r in pq.read_table(f"{small_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = sorted(tuple(r) for r in queries.op6_substring_dedup(spark, small_dir).collect())
    assert got == sorted((d, n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in brute(rows, 400))
    assert sum(r[2] for r in got) > 0


def fixture():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij é", k=rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, row = text(40), text(60)
    rows = [(i, text(rng.randint(0, 25)) + passage + text(rng.randint(0, 25))) for i in range(60)]
    for i in range(60, 130):  # near copies of one text
        words = row.split(" ")
        words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(200 + i, row) for i in range(5)]
    rows += [(300, "z" * 900), (301, "xy" * 200), (302, None), (303, ""), (None, text(30)), (304, "line one\n" * 80), (305, passage[:120]), (305, passage[:120]), (306, "ééé" * 100)]
    return rows


@pytest.mark.parametrize("shard,hot,windows", [(1_500_000, 3_000_000, 4_000_000), (500, 2_000, 3_000), (1, 1, 10**6)])
def test_matches_brute_force(docs_of, monkeypatch, shard, hot, windows):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(substring_dedup, "HOT_BYTES", hot)
    monkeypatch.setattr(substring_dedup, "HOT_WINDOWS", windows)
    rows = fixture()
    docs = docs_of(rows).withColumn("kept", F.lit("clash"))
    out = substring_dedup.remove_repeats(docs, length=60).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), bytes(r.kept)) for r in out), key=key)
    assert got == sorted(brute(rows, 60), key=key)


def test_empty_table(docs_of):
    assert substring_dedup.remove_repeats(docs_of([])).count() == 0


def test_passages_of_over_50_words(spark, docs_of, tmp_path):
    """By the contract bytes decide: a repeated passage goes from 400 bytes on, however many words it has."""
    rng, rows, gone = random.Random(6), [], {}
    for n in (300, 399, 400, 401):
        passage = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(59))[: n - 1].ljust(n, "q")
        assert len(passage.split()) > 50 and len(passage.encode()) == n
        for before, after in (("", "1 more"), ("some 2", "3 more"), ("some 4", "")):
            rows.append((len(rows), before + passage + after))
            gone[len(rows) - 1] = n if n >= 400 else 0
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op6_substring_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_removed for r in out} == gone
    assert {r.doc_id: r.n_bytes for r in out} == {d: len(t) for d, t in rows}
