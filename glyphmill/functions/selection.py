"""Reading a model's choice of a passage, and labels for passages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.text import ascii_digits

# The letters that can label passages.
LETTERS = "ABCDEFGH"


def labels(n: int, letters: bool = False) -> list[str]:
    """``1..n``, or as many letters as there are up to eight."""
    return list(LETTERS[:n]) if letters else [str(i + 1) for i in range(n)]


def choice_schema(n: int) -> dict:
    """JSON Schema of an answer that names a passage, 0 for none.  Fixed values: models are asked for just this."""
    return {"type": "object", "properties": {"passage": {"type": "integer", "minimum": 0, "maximum": n}}, "required": ["passage"]}


def _within(value: Column, n: Column) -> Column:
    return F.when((value >= 0) & (value <= n), value.cast("int"))


def choice_from_json(answer: Column, n: Column) -> Column:
    """The integer ``passage`` of a JSON object if within 0..n; null where unreadable.  Of equal keys the last counts."""
    named = F.filter(F.map_entries(F.from_json(F.trim(answer), "map<string,variant>")), lambda e: e["key"] == "passage")
    value = F.try_element_at(named, F.lit(-1))["value"]
    return F.when(F.schema_of_variant(value) == "BIGINT", _within(F.try_variant_get(value, "$", "bigint"), n))


def _unsigned(answer: Column) -> Column:
    """The answer, digits that come right after a minus (ASCII or U+2212) blanked: a sign hides one digit, not the number."""
    return F.regexp_replace(F.coalesce(answer, F.lit("")), r"[-\x{2212}]\p{Nd}", " ")


def choice_from_digits(answer: Column, n: Column) -> Column:
    """The last number, in digits of any script, outside of :func:`_unsigned`'s blanks, if within 0..n."""
    runs = F.filter(F.split(ascii_digits(_unsigned(answer)), "[^0-9]+"), lambda r: r != "")
    return _within(F.try_element_at(runs, F.lit(-1)).try_cast("bigint"), n)


def choice_from_letters(answer: Column, n: Column) -> Column:
    """The last letter standing alone that labels one of the n passages, or 0 for a lone zero."""
    found = F.regexp_extract_all(_unsigned(answer), F.lit(r"\p{Nd}+|[A-Za-z]+"), 0)  # whole runs: longer ones label nothing
    place = lambda t: F.when(t == "0", 0).otherwise(F.nullif(F.instr(F.lit(LETTERS), F.when(F.length(t) == 1, F.upper(t)).otherwise("?")), F.lit(0)))
    read = F.filter(F.transform(found, place), lambda v: v.isNotNull() & (v <= n))
    return F.try_element_at(read, F.lit(-1)).cast("int")


def numbered(passages: Column, letters: bool = False) -> Column:
    """``[1] text`` blocks with blank lines between; more than eight lettered passages are an error."""
    if letters:
        tag = lambda i: F.substring(F.lit(LETTERS), i + 1, 1)
        body = F.transform(passages, lambda p, i: F.concat(F.lit("["), tag(i), F.lit("] "), p))
        return F.when(F.size(passages) <= len(LETTERS), F.array_join(body, "\n\n")).otherwise(F.raise_error(F.lit("more passages than letters")))
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n\n")
