import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import formatting, selection, text


@pytest.fixture(scope="module")
def apply(spark):
    """Evaluates expressions over rows of one or two text columns."""
    global A, B
    A, B = F.col("a"), F.col("b")

    def run(rows, *exprs):
        pairs = [(r, None) if r is None or isinstance(r, str) else r for r in rows]
        frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
        out = frame.select("i", *[e.alias(f"x{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()
        return [r[1] if len(exprs) == 1 else tuple(r)[1:] for r in out]

    return run


A = B = None  # columns a and b, once there is a session


def model_normalise(t):
    t = "".join(c for c in t if not unicodedata.combining(c)).replace("ـ", "")
    return unicodedata.normalize("NFKC", t).translate(str.maketrans(text.FOLD_FROM, text.FOLD_TO)).lower()


def test_normalise_matches_unicodedata(apply):
    rng = random.Random(0)
    pool = list("abcÉé ÀßİſøŒ١٢٣أإةىؤئـ") + ["ﻻ", "ﷺ", "①", "ﬁ", "ً", "ّ", "é", "가", "가", " ", "㍿", "ｆ", "ﱞ", "क़", "ٕ"]
    rows = ["", "Café", "مُحَمَّد", *("".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(300))]
    for got, t in zip(apply(rows, text.normalise(A)), rows):
        assert got == model_normalise(t), t


def test_tokens(apply):
    assert apply(["الإجماع على الخنثى؟", "ab abc ABC a_b", None, "من الذي", "حتى متى"], text.tokens(A)) == [
        ["الاجماع", "الخنثي"], ["abc", "abc", "a_b"], [], [], ["حتي", "متي"],
    ]


def test_numbers_and_words(apply):
    rows = [("سنة ١٩٨٩ و 7 و 7", "في 1989"), ("no digits", "1"), ("la chute, du MUR mur,", "du mur La chute")]
    assert apply(rows, text.absent_numbers(A, B)) == [["7", "7"], [], []]
    assert apply(rows, text.is_grounded(A, B)) == [False, True, True]
    assert apply(rows[2:], text.absent_words(A, B)) == [["chute,", "mur,"]]


def test_citations(apply):
    rows = [("x [[ one ]] y [[two]] [[]] [[open", "ONE  and مُحَمَّد"), ("[[محمد]] [[ absent ]]", "قال مُحَمَّد كذا"), ("none", "x")]
    assert apply(rows, text.citations(A)) == [["one", "two", ""], ["محمد", "absent"], []]
    assert apply(rows, text.fabricated_citations(A, B)) == [["two"], ["absent"], []]


def test_refusals(apply):
    rows = ["عذرًا، لا توجد معلومات كافية", "لا يوجد في السياق المستخرج شيء", "لا يجوز بيع الأسهم", "لا جواب.", "Paris"]
    assert apply(rows, text.is_refusal(A, "ar")) == [True, True, False, True, False]
    rows = ["Désolé, il n'y a pas assez d’informations", "Les extraits ne mentionnent pas cela", "Oui."]
    assert apply(rows, text.is_refusal(A, "fr")) == [True, True, False]
    assert apply(["لا جواب", "Oui"], text.is_refusal(A, "xx")) == [True, False]


def test_language(apply):
    rows = ["نعم", "bonjour à tous", "12 ؟", "", None, "abc ابت", "ـــ", "αβγ", "abcdefg ابت"]
    assert apply(rows, text.detect_language(A)) == ["ar", "fr", None, None, None, None, "ar", None, "fr"]
    assert apply(["abc ابت"], text.detect_language(A, 0.5)) == ["ar"]


def test_letters_follow_unicode_names(apply):
    rng = random.Random(3)
    rows = ["".join(chr(rng.choice([rng.randint(32, 0x24F), rng.randint(0x600, 0x6FF), rng.randint(0xFB50, 0xFDFF)])) for _ in range(30)) for _ in range(60)]
    count = lambda t, s: sum(c.isalpha() and unicodedata.name(c, "").startswith(s) for c in t)
    got = apply(rows, text.script_letters(A, "ARABIC"), text.script_letters(A, "LATIN"))
    assert got == [(count(t, "ARABIC"), count(t, "LATIN")) for t in rows]


def test_stop_words_are_whole():
    assert len(text.STOP_WORDS) == 67 and sum(len(w) < 3 for w in text.STOP_WORDS) == 22
    assert all(re.fullmatch(r"\w+", w) for w in text.STOP_WORDS)


def test_choices_in_digits_and_letters(spark):
    digits = {"3": 3, "  2  ": 2, "الجواب هو 4": 4, "1\n": 1, "1, 2, 3: 2": 2, "0": 0, "9": None, "-2": None, "": None, "none": None, "٣": 3, "المقطع ٥": 5, "३": 3, "２": 2, "−3": None, "−33": 3, "6 or ٤": 4, None: None}
    rows = spark.createDataFrame(list(digits.items()), "a string, want int")
    for r in rows.select("a", "want", selection.choice_from_digits(F.col("a"), F.lit(5)).alias("got")).collect():
        assert r.got == r.want, r.a
    letters = {"C": 3, "  b  ": 2, "[B]": 2, "A\n": 1, "B then C, so D": 4, "0": 0, "370": None, "6": None, "Z": None, "": None}
    rows = spark.createDataFrame(list(letters.items()), "a string, want int")
    for r in rows.select("a", "want", selection.choice_from_letters(F.col("a"), F.lit(5)).alias("got")).collect():
        assert r.got == r.want, r.a


def test_numbers_round_as_the_double_is(spark):
    values = [0.35, 0.45, 2.675, 0.125, 0.375, 2.5, 3.5, -0.25, 1e21, 123456789.995, 0.0, 1 / 3]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 1, 2):
        got = [r[0] for r in rows.select(formatting.french_number(F.col("v"), places)).collect()]
        assert got == [f"{v:.{places}f}".replace(".", ",") for v in values]


def test_white_space_of_all_kinds(spark):
    blanks = [" ", "\n", "\t\r", " ", " ", "\x1c", "\x85", "\x0b\x0c", "　"]
    rows = spark.createDataFrame([(b, f"{b}x {b}y{b}") for b in blanks], "b string, t string")
    source = F.struct(F.lit("file").alias("source"), F.col("b").alias("title"), F.lit(1).alias("page"), F.lit(2).alias("line_start"), F.lit(3).alias("line_end"))
    got = rows.select("b", "t", formatting.source_label(source).alias("label"), text.strip(F.col("t")).alias("s"), formatting.format_chosen(F.col("t"), source, "fr").alias("chosen"))
    for r in got.collect():
        assert r.label == "file" and r.s == r.t.strip() and f"\n\n{r.t.strip()}\n\nfile — " in r.chosen


def test_letters_are_counted_in_one_reading(spark, apply):
    """A text goes once through one function for both scripts, whatever the number of tests on the counts."""
    rows = ["", None, "abc", "ابـ", "é" * 70 + "ا" * 30, "漢字 12", "a" * 69 + "ا" * 31, "𝒜Ω"] * 3
    assert apply(rows, text.detect_language(F.concat(A, F.lit("")))) == [None, None, "fr", "ar", "fr", None, None, None] * 3
    frame = spark.createDataFrame([("a",)], "a string").select(text.detect_language(F.concat(F.col("a"), F.lit("b"))))
    shown = frame._jdf.queryExecution().executedPlan().toString()
    assert shown.count("ArrowEvalPython") == 1 and "regexp_replace" not in shown
