"""Lines and pages into chunks with line addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.config import DEFAULTS


def split_line(line: Column, size: int = DEFAULTS.chunk_size) -> Column:
    """Pieces of at most ``size`` characters, cut at the last space that fits, else hard; no piece starts with white space."""
    piece = rf"(?Us)(.{{1,{size}}}(?= |\z)|.{{{size}}})\s*"
    return F.when(F.length(line) <= size, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(piece), 1))


def chunks_of(text: Column, size: int = DEFAULTS.chunk_size) -> Column:
    """A page's chunks ``(text, line_start, line_end)`` in order.

    Pieces of lines are packed greedily: a chunk closes when its length, one per
    line break included, and the next piece reach ``size``.  All pieces of a
    line bear its number.  Only the last chunk is left out for being blank.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(F.lit(1).cast("int").alias("one"), (i + 1).alias("no"), x.alias("line")))
    pieces = F.flatten(F.transform(lines, lambda x: F.transform(split_line(x["line"], size), lambda p: F.struct(p.alias("piece"), x["no"].alias("no")))))
    done_type = "array<struct<text:string,line_start:int,line_end:int>>"
    start = F.struct(
        F.array().cast(done_type).alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("length"), F.lit(1).alias("first"), F.lit(1).alias("last")
    )
    strip = lambda parts: F.regexp_replace(F.array_join(parts, "\n"), r"(?U)^\s+|\s+$", "")

    def step(a: Column, p: Column) -> Column:
        full = (F.size(a["open"]) > 0) & (a["length"] + F.length(p["piece"]) >= size)
        closed = F.array(F.struct(strip(a["open"]).alias("text"), a["first"].alias("line_start"), a["last"].alias("line_end")))
        return F.struct(
            F.when(full, F.concat(a["done"], closed)).otherwise(a["done"]).cast(done_type).alias("done"),
            F.when(full, F.array(p["piece"])).otherwise(F.concat(a["open"], F.array(p["piece"]))).alias("open"),
            (F.when(full, 0).otherwise(a["length"]) + F.length(p["piece"]) + 1).alias("length"),
            F.when(full, p["no"]).otherwise(a["first"]).alias("first"),
            p["no"].alias("last"),
        )

    def finish(a: Column) -> Column:
        last = F.array(F.struct(strip(a["open"]).alias("text"), a["first"].alias("line_start"), a["last"].alias("line_end")))
        return F.when((F.size(a["open"]) > 0) & (strip(a["open"]) != ""), F.concat(a["done"], last)).otherwise(a["done"]).cast(done_type)

    return F.aggregate(pieces, start, step, finish)


def chunk_pages(pages: DataFrame, size: int = DEFAULTS.chunk_size, text_col: str = "text") -> DataFrame:
    """A row per chunk of each page: the page's other columns, ``chunk_no`` (0-based in the page), text and lines."""
    others = [c for c in pages.columns if c != text_col]
    rows = pages.select(*others, F.posexplode(chunks_of(F.col(text_col), size)).alias("chunk_no", "chunk"))
    return rows.select(*others, "chunk_no", "chunk.text", "chunk.line_start", "chunk.line_end")
