"""Measuring retrieval: matches, ranks, hits, populations, distances, and comparing runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.config import DEFAULTS, EngineConfig
from glyphmill.operators.statistics import nth


#: The parts of a fingerprint.
LANES = tuple(f"lane{i}" for i in range(8))


def source_matches(retrieved_source: Column, retrieved_page: Column, source: Column, page: Column) -> Column:
    """Same source, and the expected page null or equal; a null retrieved page doesn't match an expected one."""
    return (retrieved_source == source) & (page.isNull() | F.coalesce(retrieved_page == page, F.lit(False)))


def first_match_rank(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``(query_id, rank)``: the best place of ``retrieved(query_id, source, page, rank)`` that an ``expected(query_id, source, page)`` matches."""
    e = expected.select("query_id", F.col("source").alias("s"), F.col("page").alias("p"))
    hits = retrieved.join(e, "query_id").where(source_matches(F.col("source"), F.col("page"), F.col("s"), F.col("p")))
    return hits.groupBy("query_id").agg(F.min("rank").alias("rank"))


def results(questions: DataFrame, expected: DataFrame, ranks: DataFrame, min_distances: DataFrame | None = None) -> DataFrame:
    """A row per question: ``query_id, out_of_corpus, rank, min_distance``; out of corpus are those that expect nothing."""
    asked = expected.select("query_id").distinct().withColumn("answerable", F.lit(True))
    out = questions.select("query_id").join(asked, "query_id", "left").join(ranks, "query_id", "left")
    out = out.select("query_id", F.col("answerable").isNull().alias("out_of_corpus"), F.when(F.col("answerable"), F.col("rank")).alias("rank"))
    if min_distances is None:
        return out.withColumn("min_distance", F.lit(None).cast("double"))
    return out.join(min_distances, "query_id", "left")


def hit(rank: Column, k: int) -> Column:
    return rank.isNotNull() & (rank <= k)


def summary(found: DataFrame, k: int) -> DataFrame:
    """One row: counts, hit rate, MRR, misses (no rank at all) and the rank histogram; rates 0.0 without answerable questions."""
    answerable = ~F.col("out_of_corpus")
    is_hit = answerable & hit(F.col("rank"), k)
    return found.agg(
        F.count("*").alias("questions"),
        F.count_if(answerable).alias("answerable"),
        F.count_if("out_of_corpus").alias("out_of_corpus"),
        F.count_if(is_hit).alias("hits"),
        F.round(F.coalesce(F.avg(F.when(answerable, is_hit.cast("double"))), F.lit(0.0)), 4).alias("hit_at_k"),
        F.round(F.coalesce(F.avg(F.when(answerable, F.when(is_hit, 1 / F.col("rank")).otherwise(0.0))), F.lit(0.0)), 4).alias("mrr"),
        F.count_if(answerable & F.col("rank").isNull()).alias("misses"),
        F.count_if(answerable & (F.col("rank") == 1)).alias("rank_1"),
        F.count_if(is_hit & (F.col("rank") > 1)).alias("rank_2_to_k"),
    )


def misses(found: DataFrame) -> DataFrame:
    """The answerable questions of which no expected source came back at all."""
    return found.where("not out_of_corpus and rank is null").select("query_id")


def mean_latency(found: DataFrame) -> DataFrame:
    """One row ``latency_ms`` over all questions, out-of-corpus ones too; 0.0 without any."""
    return found.agg(F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 1).alias("latency_ms"))


def deltas(reference: DataFrame, candidate: DataFrame, k: int) -> DataFrame:
    """One row: hit rate, MRR and mean latency of both runs, and the candidate's less the reference's."""
    parts = []
    for name, run in (("reference", reference), ("candidate", candidate)):
        one = summary(run, k).select("hit_at_k", "mrr").crossJoin(mean_latency(run))  # a row each
        parts.append(one.withColumnsRenamed({c: f"{name}_{c}" for c in one.columns}))
    less = [F.round(F.col(f"candidate_{c}") - F.col(f"reference_{c}"), 4).alias(f"{c}_delta") for c in ("hit_at_k", "mrr", "latency_ms")]
    return parts[0].crossJoin(parts[1]).select("*", *less)


def moves(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """``(query_id, before, after, move)`` of answerable questions: progressed, regressed, stable, only_reference or only_candidate."""
    a = reference.where("not out_of_corpus").select("query_id", F.col("rank").alias("before"), F.lit(1).alias("a"))
    b = candidate.where("not out_of_corpus").select("query_id", F.col("rank").alias("after"), F.lit(1).alias("b"))
    last = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(1e18))
    move = (
        F.when(F.col("b").isNull(), "only_reference").when(F.col("a").isNull(), "only_candidate")
        .when(last("after") < last("before"), "progressed").when(last("after") > last("before"), "regressed").otherwise("stable")
    )
    return a.join(b, "query_id", "full").select("query_id", "before", "after", move.alias("move"))


def warnings_of(reference: dict, candidate: dict, moved: DataFrame) -> list[str]:
    """Why two runs can't be compared by their totals: another k, another corpus (by ``fingerprint``), or other questions."""
    found = []
    if reference.get("k") != candidate.get("k"):
        found.append(f"k differs: {reference.get('k')} and {candidate.get('k')}")
    a, b = reference.get("fingerprint"), candidate.get("fingerprint")
    if a and b and a != b:
        found.append(f"the corpus differs: {reference.get('chunks', '?')} and {candidate.get('chunks', '?')} chunks")
    if (n := moved.where("move like 'only_%'").count()):
        found.append(f"{n} questions are in one run only")
    return found


def answer_counts(answers: DataFrame) -> DataFrame:
    """One row: answers, refusals, and those that aren't refusals but cite nothing, or what the context lacks.

    ``answers(refused, citations, fabricated)``, the last two being arrays.
    """
    unfounded = ~F.col("refused") & ((F.size("fabricated") > 0) | (F.size("citations") == 0))
    return answers.agg(F.count("*").alias("answers"), F.count_if("refused").alias("refusals"), F.count_if(unfounded).alias("non_verifiable"))


def context_snapshot(chunks: DataFrame, questions: DataFrame, k: int, config: EngineConfig = DEFAULTS) -> DataFrame:
    """One row: how and over what is measured, so that a report can be told from another.

    ``chunks(source, chunk_id)`` are counted and told by the fingerprint of
    their ids, and of ``questions(status, out_of_corpus)`` the drafts and those
    without an answer are counted.
    """
    of = {"pipeline": "hybrid" if config.hybrid_enabled else "vector", "embedding_model": config.embedding_model, "chunk_size": config.chunk_size, "n_results": config.n_results, "k": k, "distance_threshold": config.distance_threshold}
    if config.hybrid_enabled:
        of |= {"candidates": config.hybrid_candidates, "rrf_k": config.hybrid_rrf_k, "vector_weight": config.hybrid_vector_weight, "lexical_weight": config.hybrid_lexical_weight}
    held = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("sources"))
    told = fingerprint_lanes(chunks, "chunk_id").select(fingerprint_of("n", *LANES).alias("fingerprint"))
    asked = questions.agg(F.count_if(F.col("status") == "draft").alias("drafts"), F.count_if("out_of_corpus").alias("out_of_corpus"))
    one = held.crossJoin(asked).crossJoin(told)
    return one.select(*[F.lit(v).alias(c) for c, v in of.items()], "chunks", "sources", "fingerprint", "drafts", "out_of_corpus")


def distance_stats(found: DataFrame) -> DataFrame:
    """``(out_of_corpus, n, minimum, median, maximum)`` of the nearest distances; the median is the upper one, found by counting."""
    stats = nth(found, "out_of_corpus", "min_distance", F.floor(F.col("n") / 2))
    rounded = lambda c, name: F.round(c, 4).alias(name)
    return stats.select("out_of_corpus", "n", rounded("least", "minimum"), rounded("nth", "median"), rounded("most", "maximum"))


def distances_overlap(stats: DataFrame) -> DataFrame:
    """One row ``overlap``: whether the nearest out-of-corpus question is as near as the farthest answerable one."""
    return stats.agg(
        (F.min(F.when(F.col("out_of_corpus"), F.col("minimum"))) <= F.max(F.when(~F.col("out_of_corpus"), F.col("maximum")))).alias("overlap")
    )


def compare(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: how answerable questions of both runs moved (no rank is the last place), and how the sets differ."""
    a = reference.where("not out_of_corpus").select("query_id", F.coalesce(F.col("rank").cast("double"), F.lit(1e18)).alias("a"))
    b = candidate.where("not out_of_corpus").select("query_id", F.coalesce(F.col("rank").cast("double"), F.lit(1e18)).alias("b"))
    both = a.join(b, "query_id", "full")
    return both.agg(
        F.count_if(F.expr("b < a")).alias("progressed"), F.count_if(F.expr("b > a")).alias("regressed"), F.count_if(F.expr("a = b")).alias("stable"),
        F.count_if(F.expr("b is null")).alias("only_reference"), F.count_if(F.expr("a is null")).alias("only_candidate"),
    )


def orphans(expected: DataFrame, indexed: DataFrame) -> DataFrame:
    """Questions that expect something, none of whose sources is indexed."""
    there = expected.join(indexed.select("source").distinct(), "source", "left_semi").select("query_id").distinct()
    return expected.select("query_id").distinct().join(there, "query_id", "left_anti")


def fingerprint_lanes(ids: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Count, and XOR of the ids' SHA-256 as eight 32-bit lanes; order doesn't matter and memory is constant."""
    digest = F.sha2(F.col(id_col).cast("string"), 256)
    lanes = [F.coalesce(F.bit_xor(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")), F.lit(0)).alias(f"lane{i}") for i in range(8)]
    return ids.where(F.col(id_col).isNotNull()).agg(F.count("*").alias("n"), *lanes)


def _decimal(lanes: Column) -> Column:
    """The number that 32-bit ``lanes`` make, highest first, in decimal digits: as long as 256 bits need."""
    base = 10**9

    def take(limbs: Column, lane: Column) -> Column:
        """``limbs``, nine digits each and lowest first, shifted by a lane."""

        def step(state: Column, limb: Column) -> Column:
            value = limb * (1 << 32) + state["carry"]
            return F.struct(F.call_function("div", value, F.lit(base)).alias("carry"), F.concat(state["out"], F.array(value % base)).alias("out"))

        return F.aggregate(limbs, F.struct(lane.alias("carry"), F.array().cast("array<bigint>").alias("out")), step)["out"]

    limbs = F.aggregate(lanes, F.array_repeat(F.lit(0).cast("long"), 9), take)
    digits = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.coalesce(F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit("")), F.lit("0"))


def fingerprint_of(n, *lanes) -> Column:
    """Twelve hex digits for a count and its lanes."""
    whole = _decimal(F.array(*[F.col(x).cast("long") for x in lanes]))
    return F.substring(F.sha2(F.concat(F.col(n).cast("string"), F.lit(":"), whole), 256), 1, 12)


def merge_lanes(parts: DataFrame) -> DataFrame:
    """The lanes of several sets of ids together, from ``parts(n, lane0 .. lane7)``.

    A set that replaces some of another's ids also comes with those, their ``n``
    negative: XOR takes them out as it put them in.
    """
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.bit_xor(c), F.lit(0)).alias(c) for c in LANES])


def fingerprint(ids: DataFrame, id_col: str = "chunk_id") -> str:
    """Twelve hex digits that tell a corpus by its ids."""
    return fingerprint_lanes(ids, id_col).select(fingerprint_of("n", *LANES)).first()[0]


def selection_balance(trials: DataFrame) -> DataFrame:
    """Per population ``in_corpus``: trials, visible answers, right first passages, right choices, abstentions (0), unreadable (null), stable questions.

    ``trials(query_id, in_corpus, expected_rank, choice)``; a question is stable
    if all its trials chose alike, null being a choice of its own.
    """
    per = trials.groupBy("query_id", "in_corpus").agg(
        F.count("*").alias("n"), F.count_if(F.expr("expected_rank is not null")).alias("v"), F.count_if(F.expr("expected_rank = 1")).alias("f"),
        F.count_if(F.expr("choice = expected_rank and choice > 0")).alias("r"), F.count_if(F.expr("choice = 0")).alias("z"), F.count_if(F.expr("choice is null")).alias("u"),
        (F.size(F.collect_set(F.coalesce("choice", F.lit(-1)))) == 1).alias("same"),
    )
    total = lambda c, name: F.sum(c).alias(name)
    return per.groupBy("in_corpus").agg(
        total("n", "trials"), total("v", "visible"), total("f", "rank1_right"), total("r", "right"), total("z", "abstentions"), total("u", "unreadable"),
        F.count_if("same").alias("stable"), F.count("*").alias("questions"),
    )
