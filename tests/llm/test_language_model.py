import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import language_model as lm
from glyphmill.llm import queries


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if w] + ["</s>"]


def factors(n):
    if all(n[r] > 0 for r in range(1, 7)) and 6 * n[6] != n[1]:
        a = 6 * n[6] / n[1]
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, 6)}
        if all(0 < x <= 1 for x in d.values()) and d[1] < 1:
            return d
    return {1: 0.5, 2: 1, 3: 1, 4: 1, 5: 1}


class Brute:
    """Katz bigrams with dictionaries."""

    def __init__(self, texts):
        self.c, self.b, self.h = Counter(), defaultdict(Counter), Counter()
        for t in texts:
            last = "<s>"
            for w in tokens(t):
                self.c[w] += 1
                self.b[last][w] += 1
                self.h[last] += 1
                last = w
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d1 = factors(Counter(self.c.values()))
        self.d2 = factors(Counter(x for y in self.b.values() for x in y.values()))
        seen = sum(self.d1.get(x, 1) * x for x in self.c.values()) / self.n if self.n else 0
        self.scale, self.unknown = (1, 1 - seen) if seen < 1 - 1e-12 else (self.n / (self.n + 1), 1 / (self.n + 1))

    def p1(self, w):
        x = self.c.get(w, 0)
        return self.scale * self.d1.get(x, 1) * x / self.n if x else self.unknown

    def p(self, w, h):
        if not self.h[h]:
            return self.p1(w)
        kept = sum(self.d2.get(x, 1) * x for x in self.b[h].values()) / self.h[h]
        full = kept > 1 - 1e-12
        if x := self.b[h].get(w, 0):
            return self.d2.get(x, 1) * x / (self.h[h] + full)
        return (1 / (self.h[h] + 1) if full else 1 - kept) / (1 - sum(map(self.p1, self.b[h])))

    def score(self, text):
        total, last = 0.0, "<s>"
        for w in tokens(text):
            seen = self.b[last].get(w, 0) if self.h[last] else 0
            p = self.p(w, last)
            total += math.log10(p if seen or not self.h[last] else p * self.p1(w))
            last = w
        return total

    def base(self, text):
        return sum(math.log10((self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in tokens(text))


def compare(out, rows, train):
    model = Brute([t for d, t in rows if train(d)])
    assert len(out) == len(rows)
    got = sorted(out, key=lambda r: (r[0] is None, r[0] or 0))
    for r, (doc, text) in zip(got, sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))):
        assert r[0] == doc and r.held_out == (not train(doc)) and r.n_tokens == len(tokens(text)) and r.train_tokens == model.n
        assert r.n_known == sum(model.c[w] > 0 for w in tokens(text))
        assert r.base_score == pytest.approx(model.base(text), rel=1e-9) and r.score == pytest.approx(model.score(text), rel=1e-9)


def test_every_history_sums_to_one(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").select("text").limit(60).collect()
    model = Brute([r.text for r in rows])
    assert sum(map(model.p1, model.c)) + model.unknown == pytest.approx(1)
    for h in list(model.b)[:40]:
        seen = model.b[h]
        kept = sum(model.p(w, h) for w in seen)
        rest = sum(model.p1(w) for w in model.c if w not in seen) + model.unknown
        assert kept + model.p("never seen", h) * rest == pytest.approx(1)


def test_whole_table(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op9_language_model(spark, small_dir).collect()
    compare(out, rows, lambda d: zlib.crc32(str(d).encode()) % 5 != 1)


@pytest.mark.parametrize("hot,split,flush", [(65_000, 512, 4_000_000), (65_000, 2, 9), (3, 1, 30), (0, 0, 7)])
def test_odd_rows(docs_of, monkeypatch, hot, split, flush):
    monkeypatch.setattr(lm, "HOT_WORDS", hot)
    monkeypatch.setattr(lm, "SPLIT", split)
    monkeypatch.setattr(lm, "FLUSH", flush)
    rows = [(i, t) for i, t in enumerate([None, "", "a b a b a b", "The the THE", "a c\ta b", "z z z z z z z z", "never seen words", "a b", "x " * 500])] + [(3, "The the THE"), (3, "b a")]
    docs = docs_of(rows).withColumn("score", F.lit("clash"))
    compare(lm.score_texts(docs, F.col("doc_id") != 6, per_partition=10).collect(), rows, lambda d: d != 6)


def test_nothing_to_learn_or_score(docs_of):
    assert lm.score_texts(docs_of([]), F.lit(True)).count() == 0
    out = lm.score_texts(docs_of([(None, "a b"), (2, None)]), F.lit(None).cast("boolean")).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in out)
