"""Text normalisation, tokens, numbers, citations, refusals and scripts as column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from glyphmill.config import DEFAULTS

# The words that lexical search leaves out. Compared after normalisation, so some can never match.
STOP_WORDS = (
    "في", "من", "على", "عن", "الى", "ان", "ما", "لا", "هذا", "هذه", "ذلك",
    "التي", "الذي", "الذين", "به", "بها", "له", "لها", "ثم", "قد", "كان",
    "هو", "هي", "كل", "بين", "عند", "غير", "اذا", "اما", "اي", "ولا", "ولم",
    "لم", "لما", "كما", "حتى", "بعد", "قبل", "او", "و", "ف", "ب", "ل",
    "قال", "قوله", "حدثنا", "اخبرنا", "الك", "الل", "وسلم", "عنه", "علي",
    "بن", "ابن", "ابي", "ابيه", "صلى", "عليه", "رسول", "الله", "النبي",
    "كيف", "هل", "متى", "اين", "ماذا", "لماذا",
)
# Letters that count as one, and the digits U+0660 to U+0669.
FOLD_FROM, FOLD_TO = "أإآٱىةؤئ٠١٢٣٤٥٦٧٨٩", "اااايهوي0123456789"
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩", "0123456789"
TATWEEL = "ـ"
# Negations of availability; with a word for the source they make a refusal.
UNAVAILABLE = (
    "لا يوجد", "لا توجد", "لا اوجد", "لا وجدت", "لا اجد", "لا نجد", "لا اعلم", "لا نعلم",
    "لم اجد", "لم نجد", "لم يوجد", "لم توجد", "لم ينص", "لم يذكر", "لم يرد", "لا يتضمن",
    "لا تتضمن", "لا يذكر", "لا تذكر", "لا يرد", "لا ترد", "ليس هناك", "لا شيء",
)
# Words for the source, already normalised.
SOURCE_WORDS = (
    "السياق", "السياقات", "النص", "النصوص", "الوثايق", "المرفق", "المقدم", "المذكور", "المشار", "السطور", "المستخرج", "المصادر",
)
# Whole formulas of refusal by language.
REFUSALS = {
    "ar": (
        "لا توجد معلومات", "لا توجد المعلومات", "لا يوجد معلومات", "لا توجد الاجابه", "لا اوجد معلومات", "لا يوجد سياق",
        "لا يوجد جواب", "لا يوجد صله", "لا يوجد سوال صحيح", "لا يوجد mention", "لا توجد في الوثايق", "لا اوجد الاجابه",
        "لا تجد الاجابه", "لا جواب",
    ),
    "fr": (
        "pas assez d informations", "aucune information", "ne contiennent pas", "ne mentionnent pas", "ne permet pas de repondre",
    ),
}


def _ranges(points) -> list[list[int]]:
    ranges: list[list[int]] = []
    for p in points:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return ranges


def _class(points) -> str:
    """A Java character class of code points, as ranges."""
    ranges = points if isinstance(points, list) else _ranges(points)
    return "[" + "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def _gaps(ranges: list[list[int]], most: int = 12) -> list[list[int]]:
    """The first range and the widest between the given ones, of alphabets (below U+3000): characters in them needn't be looked up."""
    between = [[a[1] + 1, b[0] - 1] for a, b in zip([[0, -1], *ranges], [*ranges, [sys.maxunicode + 1, 0]]) if a[1] + 1 < b[0] and a[1] < 0x3000]
    return sorted(sorted(between, key=lambda r: r[0] - r[1] if r[0] else -sys.maxunicode)[:most])


def _points(test):
    return (p for p in range(sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF and test(chr(p)))


@cache
def combining_class() -> str:
    """Characters of a nonzero canonical combining class (not the same as the category Mn), tested only where a mark may be."""
    return r"(?=[\p{M}\p{Cn}])" + _class(_points(unicodedata.combining))


@cache
def compatibility_class() -> str:
    """Characters without which NFKC leaves a text without combining marks alone: those it changes, and parts it may join."""
    joins = set()
    for p in range(sys.maxunicode + 1):
        d = unicodedata.decomposition(chr(p))
        if d and not d.startswith("<") and len(parts := d.split()) == 2 and not unicodedata.combining(chr(int(parts[1], 16))):
            joins.add(int(parts[1], 16))
    ranges = _ranges(_points(lambda c: ord(c) in joins or 0x1100 <= ord(c) <= 0x11FF or unicodedata.normalize("NFKC", c) != c))
    return f"(?!{_class(_gaps(ranges))}){_class(ranges)}"


@cache
def letter_ranges(script: str) -> list[list[int]]:
    """Letters whose Unicode name begins with the script's: tatweel is one, though its script property says Common."""
    return _ranges(_points(lambda c: c.isalpha() and unicodedata.name(c, "").startswith(script)))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: A character other than ASCII and the Latin letters U+00C0 to U+00FF; texts without one need none of the steps below.
_BEYOND = r"[^\x00-\x7F\xC0-\xFF]"


def compatible(text: Column) -> Column:
    """NFKC; only texts that it can change go through Python."""
    needs = text.rlike(_BEYOND) & text.rlike(compatibility_class())
    return F.when(needs, _nfkc(F.when(needs, text))).otherwise(text)


def normalise(text: Column) -> Column:
    """Comparable form: no combining marks, no tatweel, NFKC, letters and digits folded, lower case."""
    marks = F.replace(F.regexp_replace(text, combining_class(), ""), F.lit(TATWEEL), F.lit(""))
    beyond = text.rlike(_BEYOND)
    bare = F.when(beyond, marks).otherwise(text)
    return F.lower(F.when(beyond, F.translate(compatible(bare), FOLD_FROM, FOLD_TO)).otherwise(text))


def tokens(text: Column, least: int = DEFAULTS.min_token_length) -> Column:
    """The words of the normalised text, in order, without short ones and stop words; null text has none."""
    words = F.split(F.coalesce(normalise(text), F.lit("")), r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS))


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]+$", "")


def ascii_digits(text: Column) -> Column:
    """The text with decimal digits of all scripts as ASCII."""
    found = {c: str(unicodedata.decimal(c)) for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"}
    return F.translate(text, "".join(found), "".join(found.values()))


def squeeze(text: Column) -> Column:
    """White-space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def comparable(text: Column) -> Column:
    return squeeze(normalise(text))


def refusal_form(text: Column) -> Column:
    """The comparable form with apostrophes and Arabic commas as spaces."""
    return squeeze(F.translate(normalise(text), "'’`،؛", "     "))


def numbers(text: Column) -> Column:
    """All digit runs in order, U+0660 to U+0669 as ASCII."""
    return F.filter(F.split(F.translate(text, DIGITS_FROM, DIGITS_TO), r"\P{Nd}+"), lambda n: n != "")


def _split(text: Column) -> Column:
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def checkable_words(text: Column, least: int = DEFAULTS.grounding_min_length) -> Column:
    """White-space words of the normalised text (punctuation stays attached) of ``least`` characters or more."""
    return F.filter(_split(normalise(text)), lambda w: F.length(w) >= least)


def absent_numbers(answer: Column, context: Column) -> Column:
    """Numbers of the answer that the context lacks, with repeats, in order."""
    known = numbers(context)
    return F.filter(numbers(answer), lambda n: ~F.array_contains(known, n))


def absent_words(answer: Column, context: Column) -> Column:
    """Checkable words of the answer that the context lacks, each once, in order."""
    return F.array_except(checkable_words(answer), _split(normalise(context)))


def is_grounded(answer: Column, context: Column) -> Column:
    return F.size(absent_numbers(answer, context)) == 0


def citations(answer: Column) -> Column:
    """What stands between ``[[`` and the next ``]]``, trimmed; an unclosed one doesn't count, an empty one does."""
    parts = F.split(answer, r"\[\[")
    closed = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.contains(p, F.lit("]]")))
    return F.transform(closed, lambda p: F.regexp_replace(F.substring_index(p, "]]", 1), r"(?U)^\s+|\s+$", ""))


def fabricated_citations(answer: Column, context: Column) -> Column:
    """Citations whose comparable form isn't part of the context's.

    All citations of a row are normalised as one string, parted by a character
    of private use that the normalisation leaves alone.
    """
    mark = "\ue000"
    cited = citations(answer)
    forms = F.transform(F.split(normalise(F.array_join(cited, mark)), mark), squeeze)
    known = F.array_repeat(comparable(context), F.size(cited))
    found = F.transform(F.arrays_zip(forms.alias("form"), known.alias("known")), lambda p: F.contains(p["known"], p["form"]))
    bad = F.filter(F.arrays_zip(cited.alias("cited"), found.alias("found")), lambda p: p["cited"].isNotNull() & ~p["found"])
    return F.transform(bad, lambda p: p["cited"])


def is_refusal(answer: Column, language: str = "ar") -> Column:
    """Whether the answer says it can't: a formula of its language; in Arabic also a negation with a word for the source.

    Languages without formulas of their own use the Arabic ones.
    """
    any_of = lambda words: "|".join(map(re.escape, words))
    pattern = any_of(_plain(REFUSALS.get(language, REFUSALS["ar"])))
    if language == "ar":
        pattern += f"|^(?=.*(?:{any_of(UNAVAILABLE)})).*(?:{any_of(SOURCE_WORDS)})"
    return refusal_form(answer).rlike(f"(?s)(?:{pattern})")  # one pattern, as the form is dear


def _plain(words) -> list[str]:
    """Refusal form of literals."""
    table = str.maketrans(FOLD_FROM + "'’`،؛", FOLD_TO + " " * 5)
    bare = ("".join(c for c in w if not unicodedata.combining(c)).replace(TATWEEL, "") for w in words)
    return [" ".join(unicodedata.normalize("NFKC", w).translate(table).lower().split()) for w in bare]


#: Bytes of texts whose characters are looked up at once, unless one text has more.
_COUNTED = 1 << 17


def _counts(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """For each text the sum of what ``table`` has at its characters' code points; 0 for null texts."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    out = np.zeros(len(texts), np.int64)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _COUNTED, "right")) - 1)
        at = offsets[first : last + 1] - offsets[first]
        raw = bytes(held[int(offsets[first]) : int(offsets[last])]) if held is not None else b""
        codes = np.frombuffer(raw, np.uint8)
        if not raw.isascii():
            try:
                text = raw.decode()
                at = np.concatenate([[0], np.cumsum((codes & 0xC0) != 0x80)])[at]  # places of characters, not of bytes
            except UnicodeDecodeError:
                parts = [raw[a:b].decode(errors="replace") for a, b in zip(at, at[1:])]
                text, at = "".join(parts), np.cumsum([0, *map(len, parts)])
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sums = np.concatenate([[0], np.cumsum(table.take(codes))])
        out[first:last] = sums[at[1:]] - sums[at[:-1]]
        first = last
    return out


def _table(scripts: list[list[list[int]]]) -> np.ndarray:
    """One at the first script's letters, 2**32 at the second one's: sums of both don't mix."""
    table = np.zeros(sys.maxunicode + 1, np.int64)
    for k, ranges in enumerate(scripts):
        for a, b in ranges:
            table[a : b + 1] |= 1 << 32 * k
    return table


def _letters(*scripts: str):
    """A function of a text that counts the letters of one script or two, in one reading."""
    ranges = [letter_ranges(s) for s in scripts]
    made: list = []

    def count(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(_table(ranges))
        sums = _counts(texts, made[0])
        return pa.StructArray.from_arrays([pa.array((sums >> 32 * k & 0xFFFFFFFF).astype(np.int32)) for k in range(len(scripts))], list(scripts))

    return F.arrow_udf(count, StructType([StructField(s, IntegerType()) for s in scripts]))


def script_letters(text: Column, script: str) -> Column:
    """How many letters of a script (``ARABIC``, ``LATIN``) the text has."""
    return _letters(script)(text)[script]


def detect_language(text: Column, threshold: float = DEFAULTS.language_dominance) -> Column:
    """``ar`` or ``fr`` by the share of Arabic or Latin letters; null where neither dominates or there are none."""
    found = _letters("ARABIC", "LATIN")(text)
    arabic, latin = found["ARABIC"], found["LATIN"]
    total = F.nullif(arabic + latin, F.lit(0))
    return F.when(arabic / total >= threshold, "ar").when(latin / total >= threshold, "fr")
