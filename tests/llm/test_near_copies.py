import random

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from glyphmill.llm import near_copies


def brute(rows):
    """Ids that stay, by comparing all pairs of word sequences."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    group = list(range(len(rows)))
    pairs = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                pairs += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}
    return sorted(r[0] for i, r in enumerate(rows) if r[0] == least[group[i]]), pairs


def crowd():
    """Chains of ever more changed copies, crowds around a text, and texts that share most of a passage."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    texts = ["", " \t", "one Two", "ONE two", "a b c d e", "a b c d e f"]
    for _ in range(4):
        words = [word() for _ in range(rng.randint(20, 120))]
        base = list(words)
        for _ in range(25):
            words = list(words)
            words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
            near = list(base)
            near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near) + " " + word())
    passage = [word() for _ in range(40)]
    texts += [" ".join([*passage, *(word() for _ in range(rng.randint(1, 14)))]) for _ in range(60)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("bucket", [16, 2, 1_000])
def test_every_group_is_found(docs_of, monkeypatch, bucket):
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    rows = crowd()
    kept, pairs = brute(rows)
    assert pairs > 100
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(docs_of(rows).sparkSession, docs_of(rows), "").collect()) == kept


def hub(centre: bool):
    """A text and 299 copies with two words changed each, with or without the text itself, and a chain out of them."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    base = [word() for _ in range(120)]
    texts = [" ".join(base)] if centre else []
    for _ in range(299 if centre else 90):
        words = list(base)
        for at in rng.sample(range(120), 2):
            words[at] = word()
        texts.append(" ".join(words))
    for _ in range(30):
        words = list(words)
        words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize("centre", [True, False])
def test_crowd_around_a_text(spark, docs_of, centre):
    """Every group is whole, whatever the partitions, also where no text lies in the middle."""
    rows = hub(centre)
    kept, pairs = brute(rows)
    assert pairs > 100 and (len(kept) == 1 if centre else len(kept) > 1)
    for parts in (1, 5, 31) if centre else (3,):
        docs = docs_of(rows).repartition(parts)
        assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == kept


def test_texts_like_no_other_take_no_fine_signatures(docs_of, monkeypatch):
    """Of full buckets, texts of which over a fifth of the shingles are theirs alone are left out; those that are similar are all found."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    passage, base = [word() for _ in range(60)], [word() for _ in range(120)]
    texts = [" ".join([*passage, *(word() for _ in range(20))]) for _ in range(300)]
    for _ in range(40):
        words = list(base)
        words[rng.randrange(120)] = word()
        texts.append(" ".join(words))
    signed, pairs = {}, near_copies._pairs

    def counted(rows, how, label):
        signed[label] = rows.count()
        return pairs(rows, how, label)

    monkeypatch.setattr(near_copies, "_pairs", counted)
    rows = list(enumerate(texts))
    kept, similar = brute(rows)
    assert similar == 780 and kept == list(range(301))
    assert sorted(r.doc_id for r in near_copies.keep_one(docs_of(rows)).collect()) == kept
    assert signed == {"coarse": 340, "fine": 40}


def test_blocks_of_long_texts(monkeypatch):
    """However the shingles of two blocks are laid out, the same homes are joined."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 300)
    sets = [np.unique(np.concatenate((base[: rng.integers(240, 300)], rng.integers(0, 1 << 60, rng.integers(0, 40))))) for _ in range(30)] + [rng.integers(0, 1 << 60, 5)]
    frame = lambda at: pd.DataFrame({"rid": at, "home": at, "s": [sets[i] for i in at]})

    def joined():
        out = near_copies.joining(frame(range(20)), frame(range(10, 31)))
        group = list(range(31))
        for u, v in zip(out["u"], out["v"]):
            group = [group[v] if g == group[u] else g for g in group]
        return [[i for i in range(31) if group[i] == group[k]] for k in range(31)]

    want = list(range(31))
    for i in range(20):
        for j in range(10, 31):
            if near_copies.similar(sets[i], sets[j]):
                want = [want[j] if g == want[i] else g for g in want]
    want = [[i for i in range(31) if want[i] == want[k]] for k in range(31)]
    for laid, slab in ((500_000, 4_096), (700, 4_096), (1, 7)):
        monkeypatch.setattr(near_copies, "LAID", laid)
        monkeypatch.setattr(near_copies, "SLAB", slab)
        assert joined() == want
    assert len(near_copies.joining(frame([]), frame([1]))) == 0 == len(near_copies.joining(frame([1]), frame([])))


def test_whole_table(spark, docs_of, sf_dir):
    rows = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in rows]
    kept, pairs = brute(rows)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect())
    assert pairs > 0 and got == kept
