"""Golden question sets (JSON lines) and evaluation reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.operators import evaluate
from glyphmill.operators.ordered import scan

#: The states of a question.
STATUSES = ("draft", "validated")


def parse_golden(lines: DataFrame) -> DataFrame:
    """Questions from ``lines(number, value)``, with ``error`` where a line breaks a rule.

    Blank lines and those that begin with ``#`` are skipped.  ``expected`` must
    be there; an empty list means the corpus shouldn't answer.  A page is an
    integer of at least 1 or absent, a source isn't blank, and an id (by default
    ``q`` and the line's number) comes once.
    """
    rows = lines.where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    rows = rows.withColumn("v", F.try_parse_json(F.trim("value")))
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("VOID"))
    text = lambda path: F.try_variant_get("v", path, "string")
    items = F.coalesce(F.try_variant_get("v", "$.expected", "array<variant>"), F.array().cast("array<variant>"))
    part = lambda x, path, t: F.try_variant_get(x, path, t)

    def bad_item(x):
        page = F.coalesce(F.schema_of_variant(part(x, "$.page", "variant")), F.lit("VOID"))
        source = F.schema_of_variant(part(x, "$.source", "variant"))
        blank = F.coalesce(F.trim(part(x, "$.source", "string")), F.lit("")) == ""
        return (F.coalesce(source, F.lit("")) != "STRING") | blank | ~page.isin("VOID", "BIGINT") | (F.coalesce(part(x, "$.page", "bigint"), F.lit(1)) < 1)

    id_text = F.coalesce(F.nullif(text("$.id"), F.lit("")), F.format_string("q%03d", F.col("number")))
    error = (
        F.when(F.col("v").isNull() | ~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "a JSON object is expected")
        .when((kind("$.question") != "STRING") | (F.trim(F.coalesce(text("$.question"), F.lit(""))) == ""), "question is missing")
        .when(~kind("$.id").isin("STRING", "VOID"), "id must be a string")
        .when(kind("$.expected") == "VOID", "expected is missing; [] means out of corpus")
        .when(~F.startswith(kind("$.expected"), F.lit("ARRAY")), "expected must be a list")
        .when(F.exists(items, bad_item), "an expected source is wrong")
        .when(~F.coalesce(text("$.status"), F.lit("draft")).isin(*STATUSES), "status is unknown")
        .when(~kind("$.lang").isin("STRING", "VOID") | ~kind("$.notes").isin("STRING", "VOID"), "lang and notes must be strings")
    )
    expected = F.transform(items, lambda x: F.struct(F.trim(part(x, "$.source", "string")).alias("source"), part(x, "$.page", "int").alias("page")))
    out = rows.select(
        F.col("number"), id_text.alias("id"), F.trim(text("$.question")).alias("question"), expected.alias("expected"),
        F.coalesce(text("$.lang"), F.lit("ar")).alias("lang"), F.coalesce(text("$.status"), F.lit("draft")).alias("status"),
        F.coalesce(text("$.notes"), F.lit("")).alias("notes"), error.alias("error"),
    )
    again = F.row_number().over(Window.partitionBy("id").orderBy("number")) > 1
    return out.withColumn("error", F.coalesce("error", F.when(again, "the id is used already")))


def strict(questions: DataFrame) -> DataFrame:
    """The questions, or a failure at the first wrong line: a set must not lose its hard questions silently."""
    fail = F.raise_error(F.concat(F.lit("line "), F.col("number").cast("string"), F.lit(": "), F.col("error")))
    return questions.where(F.when(F.col("error").isNotNull(), fail.cast("boolean")).otherwise(True)).drop("error")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A golden set's file; line numbers come from a single split, as a file is read by people."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value"))
    return strict(parse_golden(lines.select((F.col("pos") + 1).alias("number"), "value")))


def subset(questions: DataFrame, ids: Sequence[str] = (), out_of_corpus_only: bool = False) -> DataFrame:
    """Those of ``questions`` with one of ``ids`` (all, if there are none) and, if asked, those that expect nothing; none left is an error."""
    out = questions.where(F.size("expected") == 0) if out_of_corpus_only else questions
    wanted = [i.strip() for i in ids]
    out = out.where(F.col("id").isin(wanted)) if wanted else out
    if out.isEmpty():
        raise ValueError("no question fits the selection")
    return out


def append_golden(questions: DataFrame, path: str) -> None:
    """Appends JSON lines, letters unescaped."""
    fields = ("id", "question", "expected", "lang", "status", "notes")
    questions.select(F.to_json(F.struct(*fields)).alias("value")).write.mode("append").text(path)


def write_report(results: DataFrame, context: dict[str, str], label: str, k: int, path: str, ignored: Sequence[str] = ()) -> None:
    """A report's folder: ``results`` as JSON lines, and ``head``, one JSON object of what they were measured under and their summary.

    The time is in UTC, whatever the session's zone.  The summary is for people;
    :func:`read_report` doesn't read it, and figures are computed from the results.
    """
    results.write.mode("overwrite").json(f"{path}/results")
    spark = results.sparkSession
    kept = spark.read.schema(results.schema).json(f"{path}/results")
    figures = evaluate.summary(kept, k).select(F.col("questions").alias("count"), "answerable", "out_of_corpus", F.lit(len(ignored)).alias("ignored"), "hit_at_k", "mrr")
    if "latency_ms" in results.columns:
        figures = figures.crossJoin(evaluate.mean_latency(kept).select(F.col("latency_ms").alias("mean_latency_ms")))  # a row each
    figures = figures.select(F.struct("*").alias("summary"))
    head = figures.withColumns({
        "label": F.lit(label), "k": F.lit(k), "created_at": F.lit(datetime.now(timezone.utc).isoformat(timespec="seconds")),
        "context": F.map_from_arrays(F.array(*map(F.lit, context)).cast("array<string>"), F.array(*map(F.lit, context.values())).cast("array<string>")),
        "ignored_ids": F.array(*map(F.lit, ignored)).cast("array<string>"),
    })
    head.coalesce(1).write.mode("overwrite").json(f"{path}/head")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report's results, each with its label, k, time, context and the ids of the questions left out."""
    results = "query_id string, out_of_corpus boolean, rank int, min_distance double, latency_ms double"
    head = "label string, k int, created_at string, context map<string,string>, ignored_ids array<string>"
    return spark.read.schema(results).json(f"{path}/results").crossJoin(F.broadcast(spark.read.schema(head).json(f"{path}/head")))  # one row


def seeded_sample(rows: DataFrame, order: str, n: int, seed: int, parts: int | None = None) -> DataFrame:
    """``n`` rows with the ``offset`` that ``random.Random(seed).sample`` draws from the order of a column.

    Rows are numbered in blocks of the order, by the counts of those before.
    """
    import random

    total = rows.count()
    offsets = sorted(random.Random(seed).sample(range(total), min(n, total)))
    drawn = F.broadcast(rows.sparkSession.createDataFrame([(o,) for o in offsets], "drawn__ long"))
    numbered = scan(rows.withColumn("all__", F.lit(0)), ["all__"], [order], parts=parts)
    return numbered.join(drawn, F.col("place") == F.col("drawn__"), "left_semi").select(*rows.columns, F.col("place").cast("long").alias("offset"))
