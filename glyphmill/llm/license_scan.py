"""License scans: labels by phrases, and by an exact set-similarity join of text blocks with license notices."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import materialise

#: Share of a notice's distinct words that a block must hold.
THRESHOLD = 0.8
#: Words of the smallest blocks; longer notices take blocks of twice as many, and so on.
LEAST_BLOCK = 16
#: Distinct words that all notices may have together, as every task gets them.
MOST_WORDS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """The words of a notice, as :func:`scan` reads those of a document."""
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w]


def block_words(count: int, least: int = LEAST_BLOCK) -> int:
    """Words of the blocks in which a notice of ``count`` words is sought: any run of that many lies whole in one of them."""
    size = least
    while size < 2 * count:
        size *= 2
    return size


def _places(words: Column, phrase: list[str]) -> Column:
    """Where the words of ``phrase`` stand one after another, from 0."""
    starts = F.when(F.size(words) >= len(phrase), F.sequence(F.lit(0), F.size(words) - len(phrase))).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        found = F.get(words, i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            found = found & (F.get(words, i + k) == word)
        return found

    return F.filter(starts, here)


def _blocks(coded: Column, size: int, least: int) -> Column:
    """The distinct known words of each block of ``size`` words that has ``least`` of them; blocks begin every half of one."""
    step = size // 2
    last = F.greatest(F.ceil((F.size(coded) - size) / F.lit(step)), F.lit(0)).cast("int")
    known = lambda b: F.array_distinct(F.filter(F.slice(coded, b * step + 1, F.lit(size)), lambda w: w.isNotNull()))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(F.lit(size).alias("size"), b.alias("block"), known(b).alias("tokens")))
    return F.filter(blocks, lambda b: F.size(b["tokens"]) >= least)


def scan(
    docs: DataFrame, phrases: dict[str, str], notices: dict[str, list[str]], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", least_block: int = LEAST_BLOCK
) -> DataFrame:
    """Licenses named in each row of ``docs``: the id with ``n_words, n_base, first_word, last_word, base_labels, labels, score``.

    A-Z are lower-cased; words are runs of letters, digits and anything beyond
    ASCII.  ``phrases`` maps a phrase to its label; ``n_base`` counts all places
    where a phrase's words stand one after another, overlaps included, and
    ``first_word`` and ``last_word`` are the least and greatest start, from 0.
    ``notices`` maps a label to texts.  A text of n words is sought in blocks of
    :func:`block_words` that overlap by half, and found where a block holds at
    least ``threshold`` of its distinct words.  ``labels`` are those of phrases
    and notices, sorted; ``score`` is 1 where a phrase stands, else the largest
    share of a notice that was found, else 0.

    The join is exact.  Only words of notices can be common, so blocks are cut
    down to these.  Words are ordered by the number of documents that hold them,
    rarest first; a block is joined with a notice on the words of both prefixes,
    if it has enough words (length filter) and enough are left after the place
    of the common word (positional filter); what remains is counted out.

    Null texts have no words.  Repeated rows are answered repeatedly, also
    where the id is null; no column but the id and the text is read.
    """
    spark = docs.sparkSession
    templates = []
    for label, texts in notices.items():
        for text in texts:
            found = words_of(text)
            if found:
                own = sorted(set(found))
                templates.append((label, block_words(len(found), least_block), own, math.ceil(threshold * len(own) - 1e-9)))
    vocabulary = sorted({w for t in templates for w in t[2]})
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"notices have {len(vocabulary)} words, more than {MOST_WORDS}")
    wanted = [(words_of(p), label) for p, label in phrases.items()]

    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    out = docs.select(F.monotonically_increasing_id().alias("__rid"), F.col(id_col).alias("__id"), lowered.alias("__text"))
    out = out.withColumn("__words", F.filter(F.split("__text", BETWEEN), lambda w: w != ""))
    none = F.array().cast("array<int>")
    base = []
    for k, (phrase, _) in enumerate(wanted):
        hint = F.lit(True)
        for word in phrase:
            hint = hint & F.contains("__text", F.lit(word))
        out = out.withColumn(f"__p{k}", F.when(hint, _places(F.col("__words"), phrase)).otherwise(none))
        base.append(f"__p{k}")
    places = F.concat(*base) if base else none
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, (_, label) in zip(base, wanted)]).cast("array<string>"), lambda x: x.isNotNull())))
    sizes = sorted({t[1] for t in templates})
    least = {s: min(t[3] for t in templates if t[1] == s) for s in sizes}
    out = out.withColumn("__coded", F.transform("__words", lambda w: F.when(w.isin(vocabulary), w)) if vocabulary else F.array().cast("array<string>"))
    blocks = [_blocks(F.col("__coded"), s, least[s]) for s in sizes]
    rows = out.select(
        "__rid",
        F.col("__id").alias(id_col),
        F.size("__words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        labels.alias("__base"),
        F.array_distinct(F.filter("__coded", lambda w: w.isNotNull())).alias("__terms"),
        (F.concat(*blocks) if blocks else F.expr("cast(array() as array<struct<size:int,block:int,tokens:array<string>>>)")).alias("__blocks"),
    )
    rows = materialise(rows, "license-blocks")

    counts = {r["w"]: r["n"] for r in rows.select(F.explode("__terms").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # one row a word of a notice
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for k, (label, size, own, enough) in enumerate(templates):
        own = sorted(own, key=rank.__getitem__)
        prefixes += [(k, label, size, own, enough, i, w) for i, w in enumerate(own[: len(own) - enough + 1])]
    prefixes_df = spark.createDataFrame(prefixes, "template int, label string, size int, own array<string>, enough int, i int, token string")
    starts = sorted({p[-1] for p in prefixes})
    block = rows.select("__rid", F.explode("__blocks").alias("b")).where(F.exists("b.tokens", lambda w: w.isin(starts)))
    block = block.select("__rid", "b.size", F.array_intersect(F.array(*map(F.lit, order)).cast("array<string>"), "b.tokens").alias("tokens"))  # in the order of the first
    block = block.select("__rid", "size", "tokens", F.size("tokens").alias("n"), F.posexplode("tokens").alias("j", "token")).where(F.col("token").isin(starts))
    pairs = block.join(F.broadcast(prefixes_df), ["size", "token"]).where(
        (F.col("n") >= F.col("enough"))
        & (F.col("j") <= F.col("n") - F.col("enough"))
        & (F.least(F.size("own") - F.col("i"), F.col("n") - F.col("j")) >= F.col("enough"))
    )
    common = F.size(F.array_intersect("tokens", "own"))
    found = pairs.withColumn("common", common).where("common >= enough").groupBy("__rid").agg(F.collect_set("label").alias("__found"), F.max(F.col("common") / F.size("own")).alias("__share"))
    all_labels = F.array_sort(F.array_union("__base", F.coalesce("__found", F.array().cast("array<string>"))))
    return rows.drop("__terms", "__blocks").join(found, "__rid", "left").select(
        id_col,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("__share", F.lit(0.0))).alias("score"),
    )
