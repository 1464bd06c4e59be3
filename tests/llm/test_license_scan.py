import math
import re

import pytest

from glyphmill.llm import license_scan
from glyphmill.llm.queries import LICENSE_NOTICES, LICENSE_PHRASES


def brute(text, phrases, notices, threshold, least):
    """What the operator answers for a text, by looking at every place and block."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, base = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    labels, best = set(base), 0.0
    for label, texts in notices.items():
        for own in map(license_scan.words_of, texts):
            size = license_scan.block_words(len(own), least)
            for begin in range(0, max(len(w) - size // 2, 0) + 1, size // 2):
                share = len(set(own) & set(w[begin : begin + size])) / len(set(own))
                if share >= threshold - 1e-12:
                    labels.add(label)
                    best = max(best, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best


NOTICES = {"x": ["alpha beta gamma delta epsilon", "one two two three"], "y": ["beta gamma zeta eta theta iota kappa lambda mu nu xi omicron"], "z": ["solo"]}
PHRASES = {"alpha beta": "ab", "two two": "tt", "cc by": "cc-by"}
TEXTS = [
    None, "", "...", "alpha", "ALPHA\nbeta; gamma x delta epsilon", "two two two two", "İK alpha\x85beta", "cc-by cc, by ccby cc by", "one three",
    "solo", "beta gamma zeta eta theta " + "filler " * 9 + "iota kappa lambda mu nu", "beta gamma zeta eta theta " + "filler " * 90 + "iota kappa lambda mu nu",
    ("the " * 7 + "alpha beta gamma epsilon ") * 400, "beta " * 20_000 + "gamma zeta eta theta iota kappa lambda mu nu xi omicron",
]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_equals_brute_force(spark, docs_of, threshold):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "alpha beta"), (3, "alpha"), (3, "alpha")]
    out = license_scan.scan(docs_of(rows), PHRASES, NOTICES, threshold, least_block=8)
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted(((i, *brute(t, PHRASES, NOTICES, threshold, 8)) for i, t in rows), key=repr)


def test_long_notices_word_by_word(spark, docs_of):
    """A real notice with a fifth of its words replaced is found, with more it isn't."""
    words = license_scan.words_of(LICENSE_NOTICES["mit"][1])
    own = sorted(set(words))
    spare = len(own) - math.ceil(0.8 * len(own))
    changed = lambda k: " ".join("zzz" if w in own[:k] else w for w in words)
    filler = "Enan the of " * 300
    docs = docs_of([(0, filler + changed(spare) + filler), (1, filler + changed(spare + 1) + filler), (2, changed(spare))])
    got = {r.doc_id: r for r in license_scan.scan(docs, LICENSE_PHRASES, {"mit": [LICENSE_NOTICES["mit"][1]]}).collect()}
    assert got[0].labels == got[2].labels == "mit" and got[0].score >= 0.8
    assert got[0].n_base == 0 and got[2].n_words == len(words)
    for i in (0, 1, 2):  # words like "the" and "of" around it count for its block
        text = docs.where(f"doc_id = {i}").first().text
        assert tuple(got[i])[1:] == brute(text, LICENSE_PHRASES, {"mit": [LICENSE_NOTICES["mit"][1]]}, 0.8, license_scan.LEAST_BLOCK)


def test_tables(spark, docs_of):
    assert license_scan.scan(docs_of([]), PHRASES, NOTICES).count() == 0
    clash = docs_of([(1, "alpha beta gamma delta epsilon")]).selectExpr("doc_id", "text", "1 as n", "2 as size", "3 as tokens", "'q' as labels", "4 as __rid")
    assert license_scan.scan(clash, {}, NOTICES).first().labels == "x"
    assert license_scan.scan(clash, PHRASES, {}).first().labels == "ab"
    with pytest.raises(ValueError):
        license_scan.scan(clash, {}, {"many": [" ".join(f"w{i}" for i in range(license_scan.MOST_WORDS + 1))]})
