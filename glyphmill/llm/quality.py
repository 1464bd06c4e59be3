"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import small_batches

#: Labelled rows that a fit may gather, chosen by hashed id.
SAMPLE_ROWS = 20_000
_LINE = re.compile(r"[^\n]+")
_CLASS = np.zeros(256, np.int64)  # 0 other ASCII, then letter, digit, space, newline, upper, sentence end, other mark, non-ASCII
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = 8 if _i > 127 else 5 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit() else 4 if _c == "\n" else 3 if _c.isspace() else 6 if _c in ".!?" else 7 if _c in ",;:'\"()-" else 0
FEATURES = (
    "log_words", "log_lines", "word_length", "word_length_sd", "unique_words", "top_word", "short_words", "long_words", "lower", "digit",
    "space", "newline", "upper", "sentence_end", "comma_like", "other_mark", "non_ascii", "repeated_lines", "repeated_words", "words_per_line",
    "marked_words", "digit_words", "longest_run", "words_per_sentence", "stop_share", "entropy", "urls", "capital_words", "brackets", "pipes",
)


def statistics(text: str | None) -> list[float]:
    """The document's ``FEATURES``; all whole-text, all defined for an empty text (null counts as one)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    n = max(1, len(raw))
    by_byte = np.bincount(raw, minlength=256)
    share = np.bincount(_CLASS, by_byte, 9) / n
    words = data.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    seen = np.fromiter(counts.values(), np.int64, len(counts)) if counts else np.ones(1, np.int64)
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = by_byte[by_byte > 0] / n
    twice = sum(a == b for a, b in zip(words, words[1:]))
    mark = sum(not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,;:!?\"')") for w in words)
    change = np.flatnonzero(np.diff(raw)) if len(raw) > 1 else np.zeros(0, np.int64)
    run = int(np.diff(np.concatenate(([-1], change, [len(raw) - 1]))).max()) if len(raw) else 0
    sentences = max(1, int(by_byte[[33, 46, 63]].sum()))
    return [
        np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), len(counts) / m, seen.max() / m, (lengths <= 3).sum() / m, (lengths >= 12).sum() / m, share[1], share[2],
        share[3], share[4], share[5], share[6], share[7], share[0], share[8], 1 - len(set(lines)) / max(1, len(lines)), twice / m, len(words) / max(1, len(lines)),
        mark / m, sum(w.isdigit() for w in words) / m, np.log1p(run), np.log1p(len(words) / sentences), np.sort(seen)[-10:].sum() / m, -(p * np.log2(p)).sum(), (data.count(b"://") + data.count(b"@")) / m, sum(w[:1].isupper() for w in words) / m, by_byte[[60, 62, 91, 93, 123, 125]].sum() / n, by_byte[124] / m,
    ]


class Trees:
    """Boosted trees as flat arrays: node ``i`` of tree ``t`` goes to ``2i+1`` or ``2i+2``, leaves are the last level."""

    def __init__(self, base: float, depth: int, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.depth, self.feature, self.cut, self.value = base, depth, feature, cut, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: float = 4.0) -> Trees:
    """Gradient boosting of the logistic loss on per-feature histograms of ``bins`` quantile bins.

    Every level adds gradients and curvatures into one histogram per node,
    feature and bin and splits each node where the gain is largest; nodes
    without a gain send all rows to the left.  Without rows, or with one label
    only, the model is a constant.
    """
    inner, leaves = 2**depth - 1, 2**depth
    rate_of_1 = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_of_1 / (1 - rate_of_1)))
    if not len(y) or y.min() == y.max():
        return Trees(base, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], axis=1)
    offset = np.arange(x.shape[1]) * bins
    raw, all_f, all_c, all_v = np.full(len(y), base), [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (x.shape[1] * bins) + offset + binned).ravel()
            shape = (width, x.shape[1], bins)
            sums = [np.bincount(slot, np.repeat(v, x.shape[1]), width * x.shape[1] * bins).reshape(shape).cumsum(axis=2) for v in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in np.flatnonzero(gain.reshape(width, -1).max(axis=1) > 1e-6):
                f, b = divmod(int(best[k]), bins)
                if b < len(cuts[f]):
                    feature[first + k], cut[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        raw = raw + value[leaf]
        all_f.append(feature), all_c.append(cut), all_v.append(value)
    return Trees(base, depth, np.array(all_f), np.array(all_c), np.array(all_v))


def _matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, **tree_options) -> Trees:
    """Fits on at most ``sample_rows`` labelled rows, those of smallest hashed id.

    ``labels`` must hold training rows only.  Rows with a null id or label don't
    count, nor ids whose labels disagree; of texts that repeat an id, the one that
    sorts first counts.  Statistics are computed in the cluster, and only they
    come to the driver (240 bytes a row).
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z").drop("z")
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    stats = F.pandas_udf(lambda texts: pd.Series(list(_matrix(texts))), "array<double>")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("y").cast("double").alias("y"))
    small_batches(docs.sparkSession)
    found = rows.select("id", "y", stats("text").alias("x")).toPandas().sort_values("id", kind="stable")
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_trees(x, (found["y"].to_numpy(dtype=np.float64) > 0).astype(np.float64), **tree_options)


def score_quality(docs: DataFrame, trees: Trees, text_col: str = "text", carry: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """The columns ``carry`` (all by default) with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    Whole texts count; null counts as empty, and an empty text has a score too.
    Input columns of these names are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(_matrix(texts)))

    carried = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "predicted")]
    out = docs.select(*carried, score(text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
