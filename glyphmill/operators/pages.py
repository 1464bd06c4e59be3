"""Pages and citations: merging, ranges, gaps and labels."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.config import BLOCK_TAGS, BREAK_TAGS
from glyphmill.functions.text import strip
from glyphmill.operators.ordered import scan

#: Names to keep that are sent to every task; more are joined by a shuffle.
BROADCAST_NAMES = 100_000


def merge_pages(pages: DataFrame, doc: str = "source", order: str = "ord", parts: int | None = None) -> DataFrame:
    """Joins each labelled page to the kept page before it if the numbers are equal; the result counts as labelled.

    ``pages(source, ord, number, text, labelled)``; the page before may be
    unlabelled, and ``ord`` is unique in a source.  Islands are found in blocks
    of all pages' order, without their texts, so that no task sorts a source.
    """
    opens = lambda before: ~(F.col("labelled") & F.coalesce(before["number"] == F.col("number"), F.lit(False)))
    islands = scan(pages.select(doc, order, "number", "labelled"), [doc], [order], ["number"], opens, parts).select(F.col(doc).alias("d__"), F.col(order).alias("o__"), "island")
    rows = pages.join(islands, F.col(doc).eqNullSafe(F.col("d__")) & F.col(order).eqNullSafe(F.col("o__")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda x: x["t"])
    return rows.groupBy(doc, "island").agg(
        F.min(order).alias(order), F.min("number").alias("number"), F.array_join(texts, "\n").alias("text"),
        F.count("*").alias("parts"), (F.max("labelled") | (F.count("*") > 1)).alias("labelled"),
    ).drop("island")


def ranges(values: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, pages)``: distinct numbers in order as ``6, 30-32``."""
    rows = values.where(F.col(value).isNotNull()).select(key, value).distinct()
    w = Window.partitionBy(key).orderBy(value)
    islands = rows.withColumn("island", F.col(value) - F.row_number().over(w)).groupBy(key, "island").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    sorted_ = F.array_sort(F.collect_list(F.struct("a", text.alias("t"))))
    return islands.groupBy(key).agg(F.array_join(F.transform(sorted_, lambda x: x["t"]), ", ").alias("pages"))


def missing_pages(pages: DataFrame, key: str, number: str) -> DataFrame:
    """``(key, missing)``: numbers lacking between each key's least and greatest."""
    rows = pages.where(F.col(number).isNotNull()).select(key, F.col(number).alias("missing_after")).distinct()
    rows = rows.withColumn("next", F.lead("missing_after").over(Window.partitionBy(key).orderBy("missing_after")))
    gaps = rows.where(F.col("next") > F.col("missing_after") + 1)
    return gaps.select(key, F.explode(F.sequence(F.col("missing_after") + 1, F.col("next") - 1)).alias("missing"))


def label(title: Column, source: Column) -> Column:
    """How a work is named: its title, else its file."""
    return F.coalesce(F.nullif(strip(title), F.lit("")), source, F.lit(""))


def collapse_labels(cited: DataFrame, key: str, order: str, name: str = "name", parts: int | None = None) -> DataFrame:
    """Blanks a name equal to the one right before it."""
    same = F.coalesce(F.col("before")[name] == F.col(name), F.lit(False))
    return scan(cited, [key], [order], [name], parts=parts).select(*cited.columns, F.when((F.col(name) != "") & ~same, F.col(name)).otherwise("").alias("shown"))


def latest(names: DataFrame, keep: int, name: str = "name") -> DataFrame:
    """What retention drops: all but the last ``keep`` names."""
    if keep < 1:
        raise ValueError("retention must keep 1 or more")
    last = names.select(name).distinct().orderBy(F.desc(name)).limit(keep)
    return names.join(F.broadcast(last) if keep <= BROADCAST_NAMES else last, name, "left_anti")


def entities(text: Column) -> Column:
    """Named HTML entities as their characters; unknown and numeric ones stay."""
    known = F.from_json(F.lit(json.dumps({k: chr(v) for k, v in name2codepoint.items()} | {"apos": "'"})), "map<string,string>")
    parts = F.split(text, "&")

    def one(p: Column) -> Column:
        name = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        char = F.try_element_at(known, name)
        return F.when(char.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(char, F.substr(p, F.length(name) + F.lit(2))))

    return F.when(F.contains(text, F.lit("&")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))).otherwise(text)


def html_lines(html: Column) -> Column:
    """Non-empty lines of flattened HTML: breaks and block tags end lines, white space collapses."""
    ends = "|".join((*BLOCK_TAGS, *BREAK_TAGS))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    body = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), rf"(?i)</?(?:{ends})\b[^>]*>", "\n")
    text = F.regexp_replace(body, r"(?s)<[^>]*>", "")
    text = entities(text)
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.filter(lines, lambda x: x != "")
