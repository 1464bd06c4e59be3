import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import quality, queries


def test_trees_follow_brute_force():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = quality.fit_trees(x, y, rounds=40, depth=3)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = trees.base
        for f, c, v in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            total += v[node - len(f)]
        return total

    assert np.allclose([walk(r) for r in x[:50]], trees.raw(x[:50]))


def test_a_round_is_the_best_split():
    """One round of depth one, against every cut of every feature."""
    rng = np.random.default_rng(4)
    x, y = np.round(rng.normal(size=(90, 4)), 1), (rng.random(90) > 0.6).astype(float)
    y[x[:, 2] > 0.4] = 1
    got = quality.fit_trees(x, y, rounds=1, depth=1, rate=0.5, bins=200, l2=1.0, least=2.0)
    p = (y.sum() + 1) / (len(y) + 2)
    assert np.isclose(got.base, np.log(p / (1 - p)))
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = (0.0, None, None)
    for f in range(4):
        for cut in np.unique(x[:, f]):
            left = x[:, f] <= cut
            if min(h[left].sum(), h[~left].sum()) < 2:
                continue
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
            best = max(best, (gain, f, left.tolist()), key=lambda b: b[0])
    left = np.array(best[2])
    assert got.feature[0, 0] == best[1] and ((x[:, best[1]] <= got.cut[0, 0]) == left).all()
    for leaf, m in enumerate((left, ~left)):
        assert np.isclose(got.value[0, leaf], -0.5 * g[m].sum() / (h[m].sum() + 1))


def test_statistics_follow_their_names():
    for text in ("The cat sat. The cat ran!\n\nThe cat sat. The cat ran!\nÉté [a|b] 12 12 x@y aaaa\tveryveryverylong", "", "   ", "one", "é" * 40, "A-b c_d {e}\r\n" * 9):
        data = text.encode()
        words, lines, n = data.split(), [x for x in data.split(b"\n") if x.strip()], max(1, len(data))
        m, share = max(1, len(words)), lambda f: sum(f(b) for b in data) / n  # noqa: B023
        counts = Counter(words)
        lengths = [len(w) for w in words] or [0]
        mean = sum(lengths) / len(lengths)
        runs = [len(list(r)) for _, r in itertools.groupby(data)]
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(data).values())
        spaces, marks = b" \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85", b",;:'\"()-"
        want = {
            "log_words": math.log1p(len(words)), "log_lines": math.log1p(len(lines)), "word_length": mean, "word_length_sd": math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)),
            "unique_words": len(counts) / m, "top_word": max(counts.values(), default=1) / m, "short_words": sum(x <= 3 for x in lengths) / m, "long_words": sum(x >= 12 for x in lengths) / m,
            "lower": share(lambda b: 97 <= b <= 122), "digit": share(lambda b: 48 <= b <= 57), "space": share(lambda b: b < 128 and b in spaces), "newline": share(lambda b: b == 10),
            "upper": share(lambda b: 65 <= b <= 90), "sentence_end": share(lambda b: b in b".!?"), "comma_like": share(lambda b: b in marks), "non_ascii": share(lambda b: b > 127),
            "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)), "repeated_words": sum(a == b for a, b in itertools.pairwise(words)) / m, "words_per_line": len(words) / max(1, len(lines)),
            "digit_words": sum(w.isdigit() for w in words) / m, "longest_run": math.log1p(max(runs, default=0)), "words_per_sentence": math.log1p(len(words) / max(1, sum(b in b".!?" for b in data))),
            "stop_share": sum(c for _, c in counts.most_common(10)) / m if words else 1.0, "entropy": entropy, "urls": sum(1 for i in range(len(data)) if data[i : i + 3] == b"://" or data[i : i + 1] == b"@") / m,
            "capital_words": sum(65 <= w[0] <= 90 for w in words) / m, "brackets": share(lambda b: b in b"<>[]{}"), "pipes": data.count(b"|") / m,
        }
        got = dict(zip(quality.FEATURES, quality.statistics(text)))
        assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-9), text
        assert got["other_mark"] == pytest.approx(share(lambda b: True) - sum(got[k] for k in ("lower", "digit", "space", "newline", "upper", "sentence_end", "comma_like", "non_ascii")), abs=1e-9)


def test_held_out(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = queries.op10_quality(spark, sf_dir).join(labels, "doc_id").where("held_out").toPandas()
    assert len(out) > 50
    assert (out.predicted == out.quality).mean() > 0.9
    a, b = out.score[out.quality == 1], out.score[out.quality == 0]
    assert np.mean(a.to_numpy()[:, None] > b.to_numpy()[None]) > 0.9


def test_odd_rows(spark, docs_of):
    docs = docs_of([(1, "good text here."), (2, "### %%% $$$"), (3, None), (3, None), (None, ""), (4, "x" * 200_000)]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 1), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    trees = quality.learn(docs, labels, rounds=3)
    out = quality.score_quality(docs, trees, carry=["doc_id"]).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    nothing = quality.learn(docs_of([]), labels.limit(0))
    assert quality.score_quality(docs_of([]), nothing).count() == 0
    assert quality.score_quality(docs, nothing).first().score == 0.5
