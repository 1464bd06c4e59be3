"""Model-backed operators: pluggable embedders and generators, run where Spark puts the rows."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.config import DEFAULTS
from glyphmill.functions.formatting import format_chosen
from glyphmill.functions.prompts import REPAIR, choice_prompt
from glyphmill.functions.selection import numbered
from glyphmill.functions.text import detect_language, is_refusal


class Embedder(Protocol):
    name: str
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class ChatGenerator(Protocol):
    def chat(self, conversations: list[list[dict[str, str]]]) -> list[str]: ...


class HashingEmbedder:
    """A deterministic stand-in: signed hashed words, unit length.  It measures nothing of a real model."""

    def __init__(self, dimension: int = 64):
        self.name, self.dimension = f"hashing-{dimension}", dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[h % self.dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class EchoGenerator:
    """A deterministic stand-in that answers with the last line of its prompt."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [p.strip().rsplit("\n", 1)[-1] for p in prompts]

    def chat(self, conversations: list[list[dict[str, str]]]) -> list[str]:
        return self.generate([c[-1]["content"] for c in conversations])


def embed(rows: DataFrame, embedder: Embedder, text_col: str = "text", out_col: str = "embedding", batch: int = DEFAULTS.ingest_batch_size) -> DataFrame:
    """Adds a vector per row, ``batch`` texts a request; a vector of another dimension is an error."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            found = []
            for at in range(0, len(texts), batch):
                vectors = np.asarray(embedder.embed([t or "" for t in texts[at : at + batch]]), np.float32)
                if vectors.shape[1] != embedder.dimension:
                    raise ValueError(f"{embedder.name} gave {vectors.shape[1]} dimensions, not {embedder.dimension}")
                found += list(vectors)
            yield pd.Series(found)

    return rows.withColumn(out_col, run(text_col))


def generate(rows: DataFrame, generator: Generator, prompt_col: str = "prompt", out_col: str = "answer") -> DataFrame:
    """Adds the generator's answer to each prompt."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in parts:
            yield pd.Series(generator.generate([p or "" for p in prompts]))

    return rows.withColumn(out_col, run(prompt_col))


def converse(rows: DataFrame, generator: ChatGenerator, messages_col: str = "messages", out_col: str = "answer") -> DataFrame:
    """Adds the answer to each conversation, an array of ``(role, content)``; a null one is not sent and has an empty answer."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for conversations in parts:
            asked = [[{"role": m["role"], "content": m["content"]} for m in c] for c in conversations if c is not None]
            found = iter(generator.chat(asked) if asked else [])
            yield pd.Series(["" if c is None else next(found) for c in conversations])

    return rows.withColumn(out_col, run(messages_col))


def answer_in_language(rows: DataFrame, generator: ChatGenerator, language: str = "ar", retries: int = DEFAULTS.language_max_retries, prompt_col: str = "prompt") -> DataFrame:
    """Answers, and asks again while the answer is in the other language.

    What is sent again is the conversation so far: the prompt, the answer as the
    model's own words, and what to mend.  ``retries`` rewrites at most; an
    answer without a clear language is accepted, and an empty rewrite uses up a
    retry and changes nothing.
    """
    said = lambda role, content: F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"))
    prompt = said("user", F.col(prompt_col))
    out = converse(rows.withColumn("__sent", F.array(prompt)), generator, "__sent").drop("__sent")
    for _ in range(retries):
        wrong = F.coalesce(detect_language(F.col("answer")) != language, F.lit(False))
        again = F.when(wrong, F.array(prompt, said("assistant", F.col("answer")), said("user", F.lit(REPAIR[language]))))
        asked = converse(out.withColumn("__sent", again), generator, "__sent", "__new")
        out = asked.withColumn("answer", F.when(F.trim("__new") != "", F.col("__new")).otherwise(F.col("answer"))).drop("__sent", "__new")
    return out


class _Skipping:
    def __init__(self, generator: Generator):
        self.generator = generator

    def generate(self, prompts: list[str]) -> list[str]:
        asked = [p for p in prompts if p]
        found = iter(self.generator.generate(asked) if asked else [])
        return [next(found) if p else "" for p in prompts]


def refuse_then_select(rows: DataFrame, drafter: Generator, selector: Generator, read_choice, language: str = "ar") -> DataFrame:
    """``rows(prompt, select_prompt, n)`` with ``draft`` and ``choice``: 0 where the draft refuses, else the selector's (null: unreadable)."""
    out = generate(rows, drafter, "prompt", "draft")
    refused = is_refusal(F.col("draft"), language)
    out = generate(out.withColumn("__ask", F.when(~refused, F.col("select_prompt"))), _Skipping(selector), "__ask", "__raw")
    return out.withColumn("choice", F.when(F.col("__ask").isNull(), F.lit(0)).otherwise(read_choice(F.col("__raw"), F.col("n")))).drop("__ask", "__raw")


def select_answer(rows: DataFrame, selector: Generator, read_choice, language: str = "ar", letters: bool = False) -> DataFrame:
    """``rows(question, passages, sources)`` with ``raw``, ``choice`` and ``answer``.

    ``choice`` is 0 where the model says that no passage answers, and null where
    its words can't be read or there is no passage (which isn't asked about);
    ``answer`` is the chosen passage with its citation, else empty.
    """
    some = F.size("passages") > 0
    asked = rows.withColumn("__ask", F.when(some, choice_prompt(F.col("question"), numbered(F.col("passages"), letters), language, letters)))
    out = generate(asked, _Skipping(selector), "__ask", "raw").withColumn("choice", F.when(some, read_choice(F.col("raw"), F.size("passages"))))
    at = F.col("choice") - 1
    chosen = format_chosen(F.get("passages", at), F.get("sources", at), language)
    return out.withColumn("answer", F.when(F.col("choice") > 0, chosen).otherwise("")).drop("__ask")


def _attempted(ask: Callable[[object], object], value: object, waits: list[float], permanent: tuple[type[Exception], ...]) -> tuple[object, str | None, int]:
    """What ``ask(value)`` gives, its last error and how often it was asked."""
    error = None
    for used, wait in enumerate(waits, 1):
        time.sleep(wait)
        try:
            return ask(value), None, used
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if isinstance(e, permanent):
                return None, error, used
    return None, error, len(waits)


def request(
    rows: DataFrame, ask: Callable[[str], object], in_col: str, out_col: str, kind: str = "string", tries: int = 3, pause: float = 1.0, permanent: tuple[type[Exception], ...] = (), in_flight: int = 8
) -> DataFrame:
    """Adds ``out_col`` of type ``kind``, what ``ask`` gives for ``in_col``, with ``<out_col>_error`` and ``<out_col>_tries``.

    Each task has up to ``in_flight`` requests under way at a time.  A request
    that fails is tried again, ``tries`` times in all, after pauses that double
    from ``pause`` seconds; ``permanent`` errors aren't tried again.  A row that
    fails for good has its error in its column and no value, and no other row is
    touched by it.  Null isn't asked about.
    """
    waits = [0.0, *(pause * 2**i for i in range(tries - 1))]
    names = (out_col, f"{out_col}_error", f"{out_col}_tries")

    @F.pandas_udf(f"value {kind}, error string, tries int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for values in parts:
                found = pool.map(lambda v: (None, None, 0) if v is None else _attempted(ask, v, waits, permanent), values)
                yield pd.DataFrame(list(found), columns=["value", "error", "tries"])

    if tries < 1 or in_flight < 1:
        raise ValueError("tries and requests in flight must be 1 or more")
    asked = rows.withColumn("__got", run.asNondeterministic()(in_col))  # asked once, whatever is made of the answer
    return asked.select(*rows.columns, *[F.col(f"__got.{f}").alias(n) for f, n in zip(("value", "error", "tries"), names)])


def timing_sample(chunks: DataFrame, n: int, size: int = DEFAULTS.chunk_size, order: str = "chunk_id") -> tuple[list[str], bool]:
    """``n`` texts at most to time an embedder on, and whether they are real.

    These are the first chunks that have a text, however few; only where there
    are none at all, texts of a chunk's size are made up.
    """
    real = [r.text for r in chunks.where("text <> ''").orderBy(order).select("text").limit(n).collect()]
    return (real, True) if real else ([f"{i} ".ljust(size, "x") for i in range(n)], False)


def embedding_seconds(ms_per_chunk, chunks):
    """How long so many chunks take to embed."""
    return ms_per_chunk * chunks / 1000


def repeat(rows: DataFrame, times: int) -> DataFrame:
    """Each row ``times`` times, with its ``repetition`` from 1."""
    return rows.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(times))))
