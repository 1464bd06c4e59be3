"""The queries over the engine's own operators, and the SQL that each must equal."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.config import BLOCK_TAGS, BREAK_TAGS
from glyphmill.functions import chunking, formatting, prompts, selection, text
from glyphmill.operators import containment, evaluate, fusion, ingest, inverted, lexical, limiter, models, pages, pivots, retrieve, statistics, vector
from glyphmill.sources import scratch

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """At least a partition per core, for work heavier than its scan: a small file that is one split is dealt out first."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _chunks(spark, d) -> DataFrame:
    return _spread(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- tokens and BM25 ---------------------------------------------------------------------------------------------

# No text here holds a combining mark or a compatibility character, so SQL leaves those steps out; stop words are Arabic.
_TOK = r"list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: len(w) >= 3)"
_DOC_TOKENS = f"SELECT doc_id, {_TOK.format('text')} AS w FROM documents"


@_query(f"SELECT doc_id AS chunk_id, token, count(*) AS tf FROM ({_DOC_TOKENS}), unnest(w) AS u(token) GROUP BY ALL")
def tokenize_counts(spark, d):
    return lexical.term_frequencies(_chunks(spark, d))


@_query(f"""
WITH df AS (SELECT token, count(*) AS df FROM ({_DOC_TOKENS}), unnest(list_distinct(w)) AS u(token) GROUP BY token), n AS (SELECT count(*) AS n FROM documents)
SELECT token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 8) AS idf FROM df, n""")
def doc_frequency_idf(spark, d):
    return lexical.document_frequencies(_chunks(spark, d)).withColumn("idf", F.round("idf", 8))


@_query(f"SELECT count(*) AS n, round(avg(len(w)), 6) AS avgdl FROM ({_DOC_TOKENS})")
def corpus_statistics(spark, d):
    return lexical.corpus_stats(_chunks(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


def _bm25_sql(query: str) -> str:
    return f"""
doc AS (SELECT doc_id, w, len(w) AS dl FROM ({_DOC_TOKENS})), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM doc),
q AS (SELECT query_id, token, count(*) AS qtf, min(pos) AS first_pos FROM (
  SELECT query_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT item_id AS query_id, {_TOK.format(query)} AS w FROM benchmark)) GROUP BY ALL),
post AS (SELECT token, doc_id, dl, count(*) AS tf FROM doc, unnest(w) AS u(token) WHERE token IN (SELECT token FROM q) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
scored AS (
  SELECT query_id, doc_id AS chunk_id, min(first_pos) AS first_pos,
    round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 8) AS score
  FROM q JOIN df USING (token) JOIN post USING (token), stats GROUP BY ALL),
ranked AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_pos, chunk_id) AS rank FROM scored)"""


def _bm25(spark, d, k, questions=None):
    out = lexical.bm25_topk(_questions(spark, d) if questions is None else questions, _chunks(spark, d), k)
    return out.withColumns({"score": F.round("score", 5), "rank": F.col("rank").cast("long")})


@_query(f"WITH {_bm25_sql('text')} SELECT query_id, chunk_id, rank, round(score, 5) AS score FROM ranked WHERE rank <= 10")
def bm25_topk(spark, d):
    return _bm25(spark, d, 10)


@_query(f"""WITH {_bm25_sql("concat_ws(' ', text, text, reverse(text))")} SELECT query_id, chunk_id, rank, round(score, 5) AS score FROM ranked WHERE rank <= 10""")
def bm25_repeated_terms(spark, d):
    q = _questions(spark, d).select("query_id", F.concat_ws(" ", "text", "text", F.reverse("text")).alias("text"))
    return _bm25(spark, d, 10, q)


def _index(spark, d):
    """An index in a folder of its own, of all documents."""
    index = inverted.Index(spark, scratch.new_folder(spark, "index"))
    index.add(_chunks(spark, d))
    return index


def _ranked(found):
    return found.withColumns({"score": F.round("score", 5), "rank": F.col("rank").cast("long")})


@_query(f"WITH {_bm25_sql('text')} SELECT query_id, chunk_id, rank, round(score, 5) AS score FROM ranked WHERE rank <= 10")
def index_topk(spark, d):
    """What the index ranks, of which it reads the blocks that can matter."""
    return _ranked(_index(spark, d).topk(_questions(spark, d), 10))


@_query(f"""WITH documents AS (SELECT * FROM main.documents WHERE doc_id % 7 <> 3), {_bm25_sql('text')} SELECT query_id, chunk_id, rank, round(score, 5) AS score FROM ranked WHERE rank <= 10""")
def index_after_updates(spark, d):
    """Documents of which a fifth came with another text, then with their own, and of which a seventh was taken out."""
    index = inverted.Index(spark, scratch.new_folder(spark, "index"))
    chunks = _chunks(spark, d)
    late = F.col("chunk_id") % 5 == 0
    index.add(chunks.withColumn("text", F.when(late, F.concat(F.reverse("text"), F.lit(" "), "text")).otherwise(F.col("text"))))
    index.add(chunks.where(late))
    index.remove(chunks.where("chunk_id % 7 = 3"))
    return _ranked(index.topk(_questions(spark, d), 10))


# --- vectors and fusion ------------------------------------------------------------------------------------------


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


_NEAR = """
near AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(sqrt(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 6) AS distance
  FROM embeddings q, embeddings v WHERE {}),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM near)"""


def _vector_questions(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@_query(f"WITH {_NEAR.format('q.vec_id % 20 = 0')} SELECT query_id, chunk_id, rank, distance FROM placed WHERE rank <= 10")
def vector_topk_l2(spark, d):
    return vector.knn(_vector_questions(spark, d), _vectors(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))


@_query(f"WITH {_NEAR.format('q.vec_id % 20 = 0')} SELECT query_id, chunk_id, rank, distance FROM placed WHERE rank <= 10")
def vector_topk_pruned(spark, d):
    """The same of an index around pivots, of whose blocks those are read that can matter."""
    index = pivots.VectorIndex.build(_vectors(spark, d))
    return index.knn(_vector_questions(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))


@_query(f"WITH {_NEAR.format('q.vec_id % 20 = 0')} SELECT query_id, chunk_id, rank, distance FROM placed WHERE rank <= 20 AND distance <= 1.1")
def vector_threshold(spark, d):
    return vector.knn(_vector_questions(spark, d), _vectors(spark, d), 20, threshold=1.1).withColumn("rank", F.col("rank").cast("long"))


@_query(f"WITH {_NEAR.format('q.vec_id % 20 = 0')} SELECT query_id, distance AS min_distance FROM placed WHERE rank = 1")
def vector_min_distance(spark, d):
    return vector.min_distance(_vector_questions(spark, d), _vectors(spark, d))


def _hybrid_questions(spark, d):
    """Each benchmark item with the vector of its own number as its query vector."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return _questions(spark, d).join(v, "query_id", "left")


_RRF = f"""
WITH {_bm25_sql('text')}, {_NEAR.format('q.vec_id IN (SELECT item_id FROM benchmark)')},
votes AS (
  SELECT query_id, chunk_id, W0 / (10 + rank) AS vote, 0 AS list, rank FROM placed WHERE rank <= 50
  UNION ALL SELECT query_id, chunk_id, W1 / (10 + rank), 1, rank FROM ranked WHERE rank <= 50),
fused AS (SELECT query_id, chunk_id, round(sum(vote), 12) AS vote, min(list * 1000 + rank) AS met FROM votes GROUP BY ALL),
final AS (SELECT query_id, chunk_id, vote, row_number() OVER (PARTITION BY query_id ORDER BY vote DESC, met) AS rank FROM fused)"""


def _rrf_sql(first: str, second: str) -> str:
    return _RRF.replace("W0", f"{first}::DOUBLE").replace("W1", f"{second}::DOUBLE")


def _fused(spark, d, weights, n):
    q = _hybrid_questions(spark, d)
    lists = [vector.knn(q, _vectors(spark, d), 50), lexical.bm25_topk(q, _chunks(spark, d), 50)]
    return fusion.rrf(lists, weights, 10, n).withColumns({"vote": F.round("vote", 9), "rank": F.col("rank").cast("long")})


@_query(_rrf_sql("1.0", "1.0") + "SELECT query_id, chunk_id, rank, round(vote, 9) AS vote FROM final WHERE rank <= 10")
def rrf_fusion(spark, d):
    return _fused(spark, d, [1.0, 1.0], 10)


@_query(_rrf_sql("3.0", "0.5") + "SELECT query_id, chunk_id, rank, round(vote, 9) AS vote FROM final WHERE rank <= 10")
def rrf_weighted(spark, d):
    return _fused(spark, d, [3.0, 0.5], 10)


_HYBRID = _rrf_sql("1.0", "1.0")


@_query(_HYBRID + "SELECT query_id, chunk_id, rank, source, text FROM final JOIN documents ON doc_id = chunk_id WHERE rank <= 5")
def hybrid_retrieve(spark, d):
    docs = _spread(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source"))
    found = retrieve.retrieve(_hybrid_questions(spark, d), docs, _vectors(spark, d))
    return retrieve.hydrate(found, docs).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "source", "text")


# --- evaluation --------------------------------------------------------------------------------------------------

_GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_RANKS = f"""{_bm25_sql('text')}, {_GOLD},
first AS (SELECT g.query_id, min(rank) AS rank FROM gold g JOIN ranked r ON r.query_id = g.query_id AND r.chunk_id = g.doc_id WHERE rank <= 10 GROUP BY 1),
res AS (SELECT item_id AS query_id, item_id NOT IN (SELECT query_id FROM gold) AS ooc, first.rank FROM benchmark LEFT JOIN first ON first.query_id = item_id)"""


def _expected(spark, d):
    """Golden set: a benchmark item expects the documents that hold its text; each document is a work of one page."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    docs = _spread(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"))
    return containment.contained(docs, b).select("query_id", "source", F.lit(None).cast("int").alias("page"))


def _results(spark, d, distances=True):
    expected = _expected(spark, d)
    found = lexical.bm25_topk(_questions(spark, d), _chunks(spark, d), 10)
    retrieved = found.select("query_id", F.col("chunk_id").cast("string").alias("source"), F.lit(1).alias("page"), "rank")
    near = vector.min_distance(_hybrid_questions(spark, d), _vectors(spark, d)) if distances else None
    return evaluate.results(_questions(spark, d), expected, evaluate.first_match_rank(expected, retrieved), near)


def _run(spark, d):
    """A row per question, written, as comparing runs reads it several times; without distances, which no run is compared by."""
    return scratch.written(_results(spark, d, distances=False), "run")


@_query(f"""WITH {_RANKS} SELECT count(*) AS questions, count(CASE WHEN NOT ooc THEN 1 END) AS answerable, count(CASE WHEN ooc THEN 1 END) AS out_of_corpus, count(CASE WHEN rank <= 10 AND NOT ooc THEN 1 END) AS hits,
  round(coalesce(avg(CASE WHEN NOT ooc THEN (rank IS NOT NULL)::INT::DOUBLE END), 0), 4) AS hit_at_k, round(coalesce(avg(CASE WHEN NOT ooc THEN coalesce(1.0::DOUBLE / rank, 0) END), 0), 4) AS mrr,
  count(CASE WHEN NOT ooc AND rank IS NULL THEN 1 END) AS misses, count(CASE WHEN NOT ooc AND rank = 1 THEN 1 END) AS rank_1, count(CASE WHEN NOT ooc AND rank > 1 THEN 1 END) AS rank_2_to_k FROM res""")
def golden_hit_mrr(spark, d):
    return evaluate.summary(_results(spark, d), 10)


@_query(f"WITH {_RANKS} SELECT query_id, ooc AS out_of_corpus, rank FROM res")
def out_of_corpus_split(spark, d):
    return _results(spark, d).select("query_id", "out_of_corpus", F.col("rank").cast("long").alias("rank"))


_DIST = f"""WITH {_RANKS}, {_NEAR.format('q.vec_id IN (SELECT item_id FROM benchmark)')},
picked AS (SELECT ooc AS out_of_corpus, distance, row_number() OVER (PARTITION BY ooc ORDER BY distance) AS i, count(*) OVER (PARTITION BY ooc) AS n FROM res JOIN placed USING (query_id) WHERE placed.rank = 1),
spread AS (SELECT out_of_corpus, max(n) AS n, round(min(distance), 4) AS minimum, round(max(CASE WHEN i = n // 2 + 1 THEN distance END), 4) AS median, round(max(distance), 4) AS maximum FROM picked GROUP BY 1)"""


@_query(_DIST + "SELECT * FROM spread")
def distance_statistics(spark, d):
    return evaluate.distance_stats(_results(spark, d))


@_query(_DIST + "SELECT min(CASE WHEN out_of_corpus THEN minimum END) <= max(CASE WHEN NOT out_of_corpus THEN maximum END) AS overlap FROM spread")
def distance_overlap(spark, d):
    return evaluate.distances_overlap(evaluate.distance_stats(_results(spark, d)))


@_query(f"""WITH {_RANKS}, run_a AS (SELECT query_id, coalesce(rank::DOUBLE, 1e18) AS a FROM res WHERE NOT ooc),
run_b AS (SELECT query_id, coalesce((CASE WHEN query_id % 3 = 0 THEN rank - 1 WHEN query_id % 3 = 1 THEN rank + 1 ELSE rank END)::DOUBLE, 1e18) AS b FROM res WHERE NOT ooc AND query_id % 7 <> 0)
SELECT count(CASE WHEN b < a THEN 1 END) AS progressed, count(CASE WHEN b > a THEN 1 END) AS regressed, count(CASE WHEN a = b THEN 1 END) AS stable, count(CASE WHEN b IS NULL THEN 1 END) AS only_reference, count(CASE WHEN a IS NULL THEN 1 END) AS only_candidate FROM run_a FULL JOIN run_b USING (query_id)""")
def compare_runs(spark, d):
    found = _run(spark, d)
    moved = F.when(F.col("query_id") % 3 == 0, F.col("rank") - 1).when(F.col("query_id") % 3 == 1, F.col("rank") + 1).otherwise(F.col("rank"))
    return evaluate.compare(found, found.where("query_id % 7 <> 0").withColumn("rank", moved))


@_query("WITH h AS (SELECT sha256(doc_id::VARCHAR) AS h FROM documents) SELECT count(*) AS n, " + ", ".join(f"bit_xor(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT) AS lane{i}" for i in range(8)) + " FROM h")
def corpus_fingerprint_lanes(spark, d):
    return evaluate.fingerprint_lanes(table(spark, d, "documents"), "doc_id")


@_query(f"""WITH {_GOLD} SELECT query_id FROM gold GROUP BY 1 HAVING count_if(doc_id % 2 = 0) = 0""")
def orphan_questions(spark, d):
    indexed = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("source"))
    return evaluate.orphans(_expected(spark, d), indexed)


@_query(f"""WITH {_RANKS}, t AS (SELECT query_id, NOT ooc AS in_corpus, rank AS expected_rank, CASE rep WHEN 1 THEN coalesce(rank, 0) WHEN 2 THEN CASE WHEN query_id % 4 = 0 THEN NULL ELSE coalesce(rank, 0) END ELSE query_id % 3 END AS choice FROM res, range(1, 4) AS r(rep)),
per AS (SELECT query_id, in_corpus, count(*) AS n, count(expected_rank) AS v, count(CASE WHEN expected_rank = 1 THEN 1 END) AS f, count(CASE WHEN choice = expected_rank AND choice > 0 THEN 1 END) AS r, count(CASE WHEN choice = 0 THEN 1 END) AS z, count(CASE WHEN choice IS NULL THEN 1 END) AS u, count(DISTINCT coalesce(choice, -1)) = 1 AS same FROM t GROUP BY ALL)
SELECT in_corpus, sum(n)::BIGINT AS trials, sum(v)::BIGINT AS visible, sum(f)::BIGINT AS rank1_right, coalesce(sum(r), 0)::BIGINT AS "right", sum(z)::BIGINT AS abstentions, sum(u)::BIGINT AS unreadable, count(CASE WHEN same THEN 1 END) AS stable, count(*) AS questions FROM per GROUP BY 1""")
def selection_balance(spark, d):
    found = _results(spark, d).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(3))))
    rank = F.coalesce("rank", F.lit(0)).cast("long")
    choice = F.when(F.col("rep") == 1, rank).when(F.col("rep") == 2, F.when(F.col("query_id") % 4 != 0, rank)).otherwise(F.col("query_id") % 3)
    return evaluate.selection_balance(found.select("query_id", (~F.col("out_of_corpus")).alias("in_corpus"), F.col("rank").alias("expected_rank"), choice.alias("choice")))


@_query(f"WITH {_RANKS} SELECT item_id AS query_id FROM benchmark WHERE item_id IN (SELECT query_id FROM gold) AND (item_id % 3 = 0 OR item_id NOT IN (SELECT query_id FROM first))")
def missed_questions(spark, d):
    """Questions that were missed, when what was found for every third of them is lost."""
    found = _results(spark, d)
    return evaluate.misses(found.withColumn("rank", F.when(F.col("query_id") % 3 != 0, F.col("rank"))))


@_query(f"WITH {_GOLD} SELECT query_id, doc_id::VARCHAR AS source FROM gold")
def golden_sources(spark, d):
    """The documents that hold an item's text."""
    return _expected(spark, d).select("query_id", "source")


@_query("""WITH p AS (SELECT lang, n_chars::DOUBLE AS v, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n) AS n, min(v) AS least, max(CASE WHEN i = n // 2 THEN v END) AS nth, max(v) AS most FROM p GROUP BY 1""")
def length_medians(spark, d):
    """The median length of each language's documents, found by counting."""
    return statistics.nth(table(spark, d, "documents"), "lang", "n_chars", F.floor(F.col("n") / 2))


@_query("""SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index, source || '::chunk_' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS chunk_id FROM documents""")
def chunk_ordinals(spark, d):
    """Documents numbered within their source, in blocks."""
    rows = ingest.prepare_chunks(table(spark, d, "documents").select("source", "doc_id"), order=("doc_id",))
    return rows.select("source", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id")


_RUNS = f"""{_RANKS}, run_a AS (SELECT query_id, ooc, rank, len(text)::DOUBLE AS ms FROM res JOIN benchmark ON item_id = query_id),
run_b AS (SELECT query_id, ooc, CASE WHEN query_id % 3 = 0 THEN rank + 2 ELSE rank END AS rank, ms * 2 AS ms FROM run_a WHERE query_id % 7 <> 0)"""


def _two_runs(spark, d):
    """Two runs whose latency stands for the question's length, the second with some ranks moved and questions left out."""
    ms = _questions(spark, d).select("query_id", F.length("text").cast("double").alias("latency_ms"))
    a = _run(spark, d).join(ms, "query_id")
    moved = F.when(F.col("query_id") % 3 == 0, F.col("rank") + 2).otherwise(F.col("rank"))
    return a, a.where("query_id % 7 <> 0").withColumns({"rank": moved, "latency_ms": F.col("latency_ms") * 2})


@_query(f"""WITH {_RUNS}, t AS (SELECT 'a' AS run, * FROM run_a UNION ALL SELECT 'b', * FROM run_b),
s AS (SELECT run, round(coalesce(avg(CASE WHEN NOT ooc THEN coalesce(rank <= 10, FALSE)::INT::DOUBLE END), 0), 4) AS hit, round(coalesce(avg(CASE WHEN NOT ooc THEN CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END END), 0), 4) AS mrr, round(coalesce(avg(ms), 0), 1) AS ms FROM t GROUP BY 1)
SELECT a.hit AS reference_hit_at_k, a.mrr AS reference_mrr, a.ms AS reference_latency_ms, b.hit AS candidate_hit_at_k, b.mrr AS candidate_mrr, b.ms AS candidate_latency_ms,
  round(b.hit - a.hit, 4) AS hit_at_k_delta, round(b.mrr - a.mrr, 4) AS mrr_delta, round(b.ms - a.ms, 4) AS latency_ms_delta FROM s a, s b WHERE a.run = 'a' AND b.run = 'b'""")
def run_deltas(spark, d):
    return evaluate.deltas(*_two_runs(spark, d), 10)


@_query(f"""WITH {_RUNS} SELECT query_id, a.rank AS "before", b.rank AS "after", CASE WHEN b.query_id IS NULL THEN 'only_reference' WHEN coalesce(b.rank, 1e18) < coalesce(a.rank, 1e18) THEN 'progressed' WHEN coalesce(b.rank, 1e18) > coalesce(a.rank, 1e18) THEN 'regressed' ELSE 'stable' END AS move
FROM (SELECT * FROM run_a WHERE NOT ooc) a LEFT JOIN (SELECT * FROM run_b WHERE NOT ooc) b USING (query_id)""")
def run_moves(spark, d):
    out = evaluate.moves(*_two_runs(spark, d))
    return out.select("query_id", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"), "move")


@_query("""WITH q AS (SELECT count(CASE WHEN item_id % 3 = 0 THEN 1 END) AS drafts, count(CASE WHEN item_id % 2 = 0 THEN 1 END) AS out_of_corpus FROM benchmark)
SELECT 'hybrid' AS pipeline, 'bge-m3' AS embedding_model, 600 AS chunk_size, 5 AS n_results, 10 AS k, (-1)::DOUBLE AS distance_threshold, 50 AS candidates, 10 AS rrf_k, 1::DOUBLE AS vector_weight, 1::DOUBLE AS lexical_weight,
  (SELECT count(*) FROM documents) AS chunks, (SELECT count(DISTINCT source) FROM documents) AS sources, drafts, out_of_corpus,
  (SELECT substr(sha256(n || ':' || coalesce(nullif(ltrim(array_to_string(list_transform(list_reverse(limbs), lambda x: lpad(x::VARCHAR, 9, '0')), ''), '0'), ''), '0')), 1, 12) FROM (
    SELECT n, list_reduce(lanes, lambda l, lane: list_reduce(l, lambda s, x: {'c': (x * 4294967296 + s.c) // 1000000000, 'o': list_append(s.o, (x * 4294967296 + s.c) % 1000000000)}, {'c': lane[1], 'o': []::HUGEINT[]}).o, [0, 0, 0, 0, 0, 0, 0, 0, 0]::HUGEINT[]) AS limbs
    FROM (SELECT count(*) AS n, [""" + ", ".join(f"[bit_xor(('0x' || substr(sha256(doc_id::VARCHAR), {8 * i + 1}, 8))::BIGINT)::HUGEINT]" for i in range(8)) + """] AS lanes FROM documents))) AS fingerprint FROM q""")
def context_snapshot(spark, d):
    asked = table(spark, d, "benchmark").select(F.when(F.col("item_id") % 3 == 0, "draft").otherwise("validated").alias("status"), (F.col("item_id") % 2 == 0).alias("out_of_corpus"))
    return evaluate.context_snapshot(table(spark, d, "documents").withColumnRenamed("doc_id", "chunk_id"), asked, 10)


# --- chunks and ingestion ----------------------------------------------------------------------------------------


def _doc_pages(spark, d):
    """Each document is a work of one page."""
    return _spread(table(spark, d, "documents").select(F.col("doc_id").alias("source"), F.lit(1).alias("page"), "text"))


_PIECES = r"""lines AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), range(1, len(l) + 1) AS r(i)),
cut AS (
  SELECT doc_id, line_no, -1 AS piece_no, '' AS piece, line AS rest FROM lines WHERE len(line) > 600
  UNION ALL
  SELECT doc_id, line_no, piece_no + 1, substr(rest, 1, n), regexp_replace(substr(rest, n + 1), '^[\s\x0B\x{85}\p{Z}]+', '') FROM (
    SELECT *, CASE WHEN len(rest) <= 600 THEN len(rest) WHEN strpos(reverse(substr(rest, 1, 601)), ' ') BETWEEN 1 AND 600 THEN 601 - strpos(reverse(substr(rest, 1, 601)), ' ') ELSE 600 END AS n
    FROM cut WHERE rest <> '')),
pieces AS (SELECT doc_id, line_no, 0 AS piece_no, line AS piece FROM lines WHERE len(line) <= 600 UNION ALL SELECT doc_id, line_no, piece_no, piece FROM cut WHERE piece_no >= 0)"""
_PACKED = f"""WITH RECURSIVE {_PIECES}, p AS (SELECT doc_id, list({{'t': piece, 'no': line_no + 1}} ORDER BY line_no, piece_no) AS l FROM pieces GROUP BY doc_id),
""" + r"""f AS (SELECT doc_id, list_reduce(l, lambda a, x: {
    'done': CASE WHEN len(a.open) > 0 AND a.n + len(x.t) >= 600 THEN list_append(a.done, {'t': array_to_string(a.open, chr(10)), 'a': a.a, 'b': a.b}) ELSE a.done END,
    'open': CASE WHEN len(a.open) > 0 AND a.n + len(x.t) >= 600 THEN [x.t] ELSE list_append(a.open, x.t) END,
    'n': CASE WHEN len(a.open) > 0 AND a.n + len(x.t) >= 600 THEN 0 ELSE a.n END + len(x.t) + 1,
    'a': CASE WHEN len(a.open) > 0 AND a.n + len(x.t) >= 600 THEN x.no ELSE a.a END, 'b': x.no},
  {'done': []::STRUCT(t VARCHAR, a BIGINT, b BIGINT)[], 'open': []::VARCHAR[], 'n': 0::BIGINT, 'a': 1::BIGINT, 'b': 1::BIGINT}) AS s FROM p),
c AS (SELECT doc_id, CASE WHEN regexp_matches(array_to_string(s.open, ''), '\S') THEN list_append(s.done, {'t': array_to_string(s.open, chr(10)), 'a': s.a, 'b': s.b}) ELSE s.done END AS c FROM f),
k AS (SELECT doc_id, i - 1 AS chunk_no, c[i].a AS line_start, c[i].b AS line_end, regexp_replace(regexp_replace(c[i].t, '^[\s\x0B\x{85}\p{Z}]+', ''), '[\s\x0B\x{85}\p{Z}]+$', '') AS t FROM c, range(1, len(c) + 1) AS r(i))
"""


@_query(f"WITH RECURSIVE {_PIECES} SELECT doc_id, line_no, piece_no, len(piece) AS n_chars, sha256(piece) AS sha256 FROM pieces")
def line_split(spark, d):
    lines = _spread(table(spark, d, "documents")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.posexplode(chunking.split_line(F.col("line"))).alias("piece_no", "piece"))
    return rows.select("doc_id", "line_no", "piece_no", F.length("piece").cast("long").alias("n_chars"), F.sha2("piece", 256).alias("sha256"))


def _packed(spark, d):
    out = chunking.chunk_pages(_doc_pages(spark, d))
    return out.select("source", *[F.col(c).cast("long").alias(c) for c in ("chunk_no", "line_start", "line_end")], F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


@_query(_PACKED + "SELECT doc_id AS source, chunk_no, line_start, line_end, len(t) AS n_chars, sha256(t) AS sha256 FROM k")
def chunk_pack(spark, d):
    return _packed(spark, d)


@_query(_PACKED + "SELECT doc_id AS source, line_start, line_end, sha256(t) AS sha256 FROM k")
def chunk_pack_short_lines(spark, d):
    """The same without numbers and sizes; of all documents, though its name is from when it left long lines out."""
    return _packed(spark, d).select("source", "line_start", "line_end", "sha256")


def _registry(spark, d):
    """What an earlier run left: two thirds of the documents, some with another text, count or model, and some that are gone."""
    docs = table(spark, d, "documents").where("doc_id % 3 <> 0")
    kept = docs.select(
        F.col("doc_id").cast("string").alias("source"),
        F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.sha2("text", 256)).alias("fingerprint"),
        (F.col("n_chars") % 7 + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).alias("chunk_count"),
        F.when(F.col("doc_id") % 13 == 0, "other").otherwise("bge-m3").alias("embedding_model"),
    )
    gone = docs.where("doc_id % 50 = 1").select(F.concat(F.lit("gone"), F.col("doc_id").cast("string")).alias("source"), F.lit("x").alias("fingerprint"), F.lit(3).cast("long").alias("chunk_count"), F.lit("bge-m3").alias("embedding_model"))
    return kept.unionByName(gone)


def _found(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.sha2("text", 256).alias("fingerprint"), (F.col("n_chars") % 7).alias("chunks"))


_REG = """WITH docs AS (SELECT doc_id, doc_id::VARCHAR AS source, sha256(text) AS fingerprint, n_chars % 7 AS chunks FROM documents),
reg AS (SELECT source, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE fingerprint END AS rf, chunks + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS chunk_count, CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE 'bge-m3' END AS m FROM docs WHERE doc_id % 3 <> 0
  UNION ALL SELECT 'gone' || source, 'x', 3, 'bge-m3' FROM docs WHERE doc_id % 3 <> 0 AND doc_id % 50 = 1)
"""
_PLAN = _REG + """, plan AS (SELECT source, fingerprint, chunks, CASE WHEN rf = fingerprint AND m = 'bge-m3' THEN 'unchanged' WHEN chunks = 0 THEN 'empty' WHEN reg.source IS NOT NULL THEN 'updated' ELSE 'added' END AS status FROM docs LEFT JOIN reg USING (source))"""


@_query(_PLAN + "SELECT * FROM plan")
def ingest_plan(spark, d):
    return ingest.plan(_found(spark, d), _registry(spark, d), "bge-m3")


@_query(_PLAN + "SELECT status, count(*) AS documents, sum(CASE WHEN status IN ('added', 'updated') THEN chunks ELSE 0 END)::BIGINT AS chunks FROM plan GROUP BY 1")
def ingest_summary(spark, d):
    return ingest.summary(ingest.plan(_found(spark, d), _registry(spark, d), "bge-m3"))


@_query(_REG + """, idx AS (SELECT source, chunks AS indexed FROM docs WHERE doc_id % 3 <> 0 AND chunks > 0)
SELECT source, docs.source IS NOT NULL AS on_disk, coalesce(chunk_count, 0) AS registered, coalesce(indexed, 0) AS indexed,
  CASE WHEN docs.source IS NULL THEN 'orphan' WHEN chunk_count IS NULL AND coalesce(indexed, 0) = 0 THEN 'not_ingested' WHEN coalesce(chunk_count, 0) <> coalesce(indexed, 0) THEN 'gap' ELSE 'ok' END AS flag,
  coalesce(m <> 'bge-m3', FALSE) AS other_model
FROM docs FULL JOIN reg USING (source) LEFT JOIN idx USING (source)""")
def status_reconcile(spark, d):
    docs = table(spark, d, "documents")
    index = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("source"), F.explode(F.sequence(F.lit(0), (F.col("n_chars") % 7).cast("int"))).alias("i")).where("i > 0")
    return ingest.reconcile(docs.select(F.col("doc_id").cast("string").alias("source")), _registry(spark, d), index, "bge-m3")


@_query(_PLAN + """, now AS (SELECT source, fingerprint, chunks FROM plan WHERE status IN ('added', 'updated') UNION ALL SELECT source, rf, reg.chunk_count FROM reg LEFT JOIN plan USING (source) WHERE status IS NULL OR status = 'unchanged')
SELECT source, fingerprint, chunks AS chunk_count, chunks AS seen FROM now WHERE source NOT LIKE 'gone%'""")
def store_versions(spark, d):
    """A store that an earlier run filled, then ingestion brought up to date, and from which what is gone was taken."""
    store, schema = ingest.Store(spark, scratch.new_folder(spark, "store")), "source string, chunk_id string"
    number = F.explode(F.sequence(F.lit(1), F.col("chunks").cast("int")))
    pieces = lambda rows: rows.select("source", number.alias("i")).select("source", F.concat_ws("::", "source", "i").alias("chunk_id"))
    before = _registry(spark, d)
    for model in ("bge-m3", "other"):
        rows = before.where(F.col("embedding_model") == model).select("source", "fingerprint", F.col("chunk_count").alias("chunks"), F.lit("added").alias("status"))
        store.upsert(rows, pieces(rows.where("chunks > 0")), model)
    planned = ingest.plan(_found(spark, d), store.registry(), "bge-m3")
    store.upsert(planned, pieces(planned.where("chunks > 0")), "bge-m3")
    store.forget(store.registry().where(F.startswith("source", F.lit("gone"))).select("source"))
    seen = store.chunks(schema).groupBy("source").agg(F.count("*").alias("seen"))
    return store.registry().join(seen, "source", "left").select("source", "fingerprint", "chunk_count", F.coalesce("seen", F.lit(0)).alias("seen"))


@_query(_REG + "SELECT source, m AS embedding_model FROM reg WHERE m <> 'bge-m3'")
def model_divergence(spark, d):
    return ingest.other_models(_registry(spark, d), "bge-m3")


@_query("SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, d):
    return ingest.duplicate_names(table(spark, d, "documents"))


@_query("SELECT DISTINCT source FROM documents WHERE source <> ''")
def distinct_sources(spark, d):
    return ingest.distinct_sources(table(spark, d, "documents"))


@_query("""WITH a AS (SELECT doc_id::VARCHAR AS path, n_chars AS size, sha256(text) AS sha256 FROM documents),
b AS (SELECT doc_id::VARCHAR AS path, n_chars + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS size, CASE WHEN doc_id % 10 IN (1, 2) THEN 'x' ELSE sha256(text) END AS sha256 FROM documents WHERE doc_id % 10 <> 0)
SELECT a.path, CASE WHEN b.path IS NULL THEN 'missing' WHEN b.size <> a.size THEN 'size' ELSE 'sha256' END AS anomaly FROM a LEFT JOIN b USING (path) WHERE b.path IS NULL OR b.size <> a.size OR b.sha256 <> a.sha256""")
def manifest_verify(spark, d):
    docs = table(spark, d, "documents")
    made = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"))
    m = F.col("doc_id") % 10
    found = docs.where(m != 0).select(F.col("doc_id").cast("string").alias("path"), (F.col("n_chars") + (m == 1).cast("int")).alias("size"), F.when(m.isin(1, 2), "x").otherwise(F.sha2("text", 256)).alias("sha256"))
    return ingest.verify_manifest(made, found)


@_query("SELECT source, 'src' || doc_id AS name FROM documents WHERE 'src' || doc_id NOT IN (SELECT 'src' || doc_id FROM documents ORDER BY 1 DESC LIMIT 7)")
def retention(spark, d):
    return pages.latest(table(spark, d, "documents").select("source", F.concat(F.lit("src"), F.col("doc_id").cast("string")).alias("name")), 7)


# --- limiter -----------------------------------------------------------------------------------------------------


@_query("""WITH logs AS (SELECT user_id AS key, list(epoch_us(ts) / 1000000.0::DOUBLE ORDER BY ts) AS times FROM events GROUP BY 1),
f AS (SELECT key, list_reduce(times, lambda a, t: {
    'log': CASE WHEN len(list_filter(a.log, lambda x: t - x < 86400)) >= 5 THEN list_filter(a.log, lambda x: t - x < 86400) ELSE list_append(list_filter(a.log, lambda x: t - x < 86400), t) END,
    'out': list_append(a.out, {'ts': t, 'ok': len(list_filter(a.log, lambda x: t - x < 86400)) < 5, 'w': greatest(1, ceil(86400 - (t - list_filter(a.log, lambda x: t - x < 86400)[1])))::INT})},
  {'log': []::DOUBLE[], 'out': []::STRUCT(ts DOUBLE, ok BOOLEAN, w INT)[]}) AS s FROM logs), r AS (SELECT key, unnest(s.out) AS o FROM f)
SELECT key, o.ts AS ts, o.ok AS accepted, CASE WHEN NOT o.ok THEN o.w END AS retry_after FROM r""")
def rate_limit_sliding(spark, d):
    e = table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return limiter.limit(e, 5, 86400)


@_query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN coalesce(CASE WHEN event_id % 2 = 0 THEN 'h' || user_id END, 'inconnu') ELSE '10.0.0.' || user_id END AS client FROM events""")
def client_keys(spark, d):
    e = table(spark, d, "events")
    forwarded = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(" , 10.1.1.1")))
    host = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("h"), F.col("user_id").cast("string")))
    return e.select("event_id", limiter.client_key(forwarded, host).alias("client"))


# --- grounding, refusals, languages, choices ------------------------------------------------------------------------

_TURNS = "turns AS (SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context, role FROM conversations), pairs AS (SELECT * FROM turns WHERE role = 'assistant' AND context IS NOT NULL)"


def _pairs(spark, d):
    """Assistant turns, each with the turn before as its context."""
    c = table(spark, d, "conversations")
    rows = c.select("conv_id", "turn", "role", F.col("text").alias("answer"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("context"))
    return _spread(rows.where("role = 'assistant' and context is not null"))


@_query(r"""WITH d AS (SELECT doc_id, lang, text, lead(text) OVER (ORDER BY doc_id) AS context FROM documents WHERE regexp_matches(text, '\p{Nd}'))
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '\p{Nd}+'), lambda n: NOT list_contains(regexp_extract_all(context, '\p{Nd}+'), n)), ' ') AS absent,
  len(list_filter(regexp_extract_all(text, '\p{Nd}+'), lambda n: NOT list_contains(regexp_extract_all(context, '\p{Nd}+'), n))) = 0 AS grounded FROM d WHERE context IS NOT NULL""")
def number_grounding(spark, d):
    """Documents with numbers, each against the next such document as its context.

    Only the numbers travel, not the texts; the last row of each block of ids
    finds its successor in a table of the blocks' first rows.
    """
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"\p{Nd}"))
    rows = docs.select("doc_id", text.numbers(F.col("text")).alias("own"), F.floor(F.col("doc_id") / 10_000).alias("block"))
    first = rows.groupBy("block").agg(F.min(F.struct("doc_id", "own")).alias("first"))  # a row for 10,000 ids
    over = first.select("block", F.lead("first.own").over(Window.orderBy("block")).alias("over"))
    rows = rows.withColumn("next", F.lead("own").over(Window.partitionBy("block").orderBy("doc_id"))).join(over, "block")
    rows = rows.withColumn("context", F.coalesce("next", "over")).where("context is not null")
    absent = F.filter("own", lambda n: ~F.array_contains(F.col("context"), n))
    return rows.select("doc_id", F.array_join(absent, " ").alias("absent"), (F.size(absent) == 0).alias("grounded"))


_WORDS = r"list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> '')"


@_query(f"""WITH {_TURNS} SELECT conv_id, turn, len(list_distinct(list_filter({_WORDS.format('answer')}, lambda w: len(w) >= 4 AND NOT list_contains({_WORDS.format('context')}, w)))) AS n_absent,
  list_sort(list_distinct(list_filter({_WORDS.format('answer')}, lambda w: len(w) >= 4 AND NOT list_contains({_WORDS.format('context')}, w))))[1] AS first_absent FROM pairs""")
def word_grounding(spark, d):
    absent = text.absent_words(F.col("answer"), F.col("context"))
    return _pairs(spark, d).select("conv_id", "turn", absent.alias("a")).select("conv_id", "turn", F.size("a").cast("long").alias("n_absent"), F.try_element_at(F.array_sort("a"), F.lit(1)).alias("first_absent"))


_CITE = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"


@_query(f"""WITH {_TURNS}, c AS (SELECT conv_id, turn, context, answer, trim(string_split(answer, '.')[1]) AS one, trim(string_split(context, '.')[1]) AS two FROM pairs)
SELECT conv_id, turn, 2 AS n_citations, array_to_string(list_filter([one, two], lambda x: NOT contains({_CITE.format('context')}, {_CITE.format('x')})), '|') AS fabricated FROM c""")
def citation_check(spark, d):
    """Answers that cite their own first sentence and their context's, checked against the context."""
    first = lambda c: F.trim(F.split(c, r"\.")[0])
    rows = _pairs(spark, d).select("conv_id", "turn", "context", F.concat(F.lit("x [["), first("answer"), F.lit("]] y [["), first("context"), F.lit("]] [[open")).alias("a"))
    return rows.select("conv_id", "turn", F.size(text.citations(F.col("a"))).alias("n_citations"), F.array_join(text.fabricated_citations(F.col("a"), F.col("context")), "|").alias("fabricated"))


@_query(r"""SELECT conv_id, turn, (conv_id + turn) % 3 = 0 OR regexp_matches(lower(text), 'aucune information|ne contiennent pas|ne mentionnent pas') AS fr,
  (conv_id + turn) % 3 = 1 AS ar FROM conversations WHERE role = 'assistant'""")
def refusal_detect(spark, d):
    """Assistant turns, two thirds of them with a refusal put into them."""
    c = _spread(table(spark, d, "conversations").where("role = 'assistant'"))
    k = (F.col("conv_id") + F.col("turn")) % 3
    said = F.when(k == 0, F.concat("text", F.lit(" Il n’y a PAS assez d’informations."))).when(k == 1, F.concat(F.lit("لا يُوجد في "), "text", F.lit(" السياقِ"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", text.is_refusal(said, "fr").alias("fr"), text.is_refusal(said, "ar").alias("ar"))


@_query(f"""WITH {_TURNS}, c AS (SELECT (conv_id + turn) % 3 = 0 OR regexp_matches(lower(answer), 'aucune information|ne contiennent pas|ne mentionnent pas') AS refused, (conv_id + turn) % 3 = 1 AS cites, contains({_CITE.format('context')}, {_CITE.format("trim(string_split(answer, '.')[1])")}) AS known FROM pairs)
SELECT count(*) AS answers, count(CASE WHEN refused THEN 1 END) AS refusals, count(CASE WHEN NOT refused AND NOT (cites AND known) THEN 1 END) AS non_verifiable FROM c""")
def answer_verdicts(spark, d):
    """Answers of which a third refuse and a third cite their own first sentence."""
    k = (F.col("conv_id") + F.col("turn")) % 3
    cited = F.concat("answer", F.lit(" [["), F.trim(F.split("answer", r"\.")[0]), F.lit("]]"))
    said = F.when(k == 0, F.concat("answer", F.lit(" Il n’y a PAS assez d’informations."))).when(k == 1, cited).otherwise(F.col("answer"))
    rows = _pairs(spark, d).select("context", said.alias("a"))
    return evaluate.answer_counts(rows.select(text.is_refusal(F.col("a"), "fr").alias("refused"), text.citations(F.col("a")).alias("citations"), text.fabricated_citations(F.col("a"), F.col("context")).alias("fabricated")))


def _sql_text(template: str) -> str:
    """A template as an SQL expression over ``context`` and ``answer``."""
    quoted = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return quoted.replace("{context}", "' || context || '").replace("{question}", "' || answer || '")


@_query(f"""WITH {_TURNS} SELECT conv_id, turn, sha256({_sql_text(prompts.answer_template("fr"))}) AS fr, sha256({_sql_text(prompts.answer_template("ar", True))}) AS ar_cited,
  sha256({_sql_text(prompts.choice_template("fr", True, False))}) AS choice, sha256({_sql_text(prompts.choice_template("ar"))}) AS choice_json, CASE WHEN turn % 2 = 0 THEN 3 ELSE 1 END::BIGINT AS messages FROM pairs""")
def prompt_build(spark, d):
    q, c = F.col("answer"), F.col("context")
    asked = prompts.messages(q, c, "fr", F.when(F.col("turn") % 2 == 0, q))
    return _pairs(spark, d).select(
        "conv_id", "turn", F.sha2(asked[0]["content"], 256).alias("fr"), F.sha2(prompts.answer_prompt(q, c, "ar", True), 256).alias("ar_cited"),
        F.sha2(prompts.choice_prompt(q, c, "fr", True, False), 256).alias("choice"), F.sha2(prompts.choice_prompt(q, c), 256).alias("choice_json"), F.size(asked).cast("long").alias("messages"),
    )


@_query("SELECT source, sum(n_chars)::BIGINT AS chars, count(*) AS chunks, round(avg(n_chars) * count(*) / 1000, 6) AS seconds FROM documents GROUP BY 1")
def embedding_projection(spark, d):
    """How long each source's documents take to embed at as many milliseconds as they have characters."""
    rows = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("chunks"), F.avg("n_chars").alias("ms"))
    return rows.select("source", "chars", "chunks", F.round(models.embedding_seconds(F.col("ms"), F.col("chunks")), 6).alias("seconds"))


@_query(r"""WITH l AS (SELECT doc_id, len(regexp_replace(text, '[^\p{Latin}]', '', 'g')) AS lat FROM documents)
SELECT doc_id, CASE WHEN lat = 0 THEN NULL WHEN doc_id % 4 = 0 AND (lat * 3)::DOUBLE / (lat * 4) >= 0.7 THEN 'ar' WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN NULL WHEN lat > 0 THEN 'fr' END AS detected FROM l""")
def script_language(spark, d):
    """Texts with Arabic letters added: three for each Latin one, or as many, or none."""
    docs = _spread(table(spark, d, "documents"))
    n = text.script_letters(F.col("text"), "LATIN")
    k = F.col("doc_id") % 4
    more = F.when(k == 0, F.repeat(F.lit("بـت"), n)).when(k == 1, F.repeat(F.lit("ب"), n)).otherwise("")
    return docs.select("doc_id", text.detect_language(F.concat("text", more)).alias("detected"))


@_query("""SELECT doc_id, CASE WHEN n_chars % 9 <= 5 THEN (n_chars % 9)::INT END AS from_json,
  CASE WHEN n_chars % 9 <= 5 THEN (n_chars % 9)::INT END AS from_digits, CASE WHEN n_chars % 9 BETWEEN 1 AND 5 THEN (n_chars % 9)::INT END AS from_letters FROM documents""")
def choice_parse(spark, d):
    """Answers of three kinds built on each document's length modulo 9, read as a choice of five passages."""
    v = (F.col("n_chars") % 9).cast("string")
    n = F.lit(5)
    letter = F.substring(F.lit("-ABCDEFGHI"), (F.col("n_chars") % 9 + 1).cast("int"), F.lit(1))
    return table(spark, d, "documents").select(
        "doc_id", selection.choice_from_json(F.concat(F.lit('{"why": "12", "passage": '), v, F.lit("}")), n).alias("from_json"),
        selection.choice_from_digits(F.concat(F.lit("line 370, passage "), v, F.lit(". -4")), n).alias("from_digits"),
        selection.choice_from_letters(F.concat(F.lit("The passage "), F.lower(letter), F.lit(" (no other)")), n).alias("from_letters"),
    )


@_query("""SELECT doc_id, CASE WHEN n_chars % 9 <= 5 THEN (n_chars % 9)::INT END AS arabic, CASE WHEN n_chars % 9 <= 5 THEN (n_chars % 9)::INT END AS devanagari, CASE WHEN n_chars % 10 <= 5 THEN (n_chars % 10)::INT END AS signed FROM documents""")
def choice_parse_scripts(spark, d):
    """Choices of five passages in digits of other scripts, and after a number whose sign hides its first digit."""
    v, n = (F.col("n_chars") % 9).cast("string"), F.lit(5)
    say = lambda digits: selection.choice_from_digits(F.concat(F.lit("المقطع "), F.translate(v, "0123456789", digits)), n)
    hidden = selection.choice_from_digits(F.concat(F.lit("\u22127"), (F.col("n_chars") % 10).cast("string")), n)
    return table(spark, d, "documents").select("doc_id", say("٠١٢٣٤٥٦٧٨٩").alias("arabic"), say("०१२३४५६७८९").alias("devanagari"), hidden.alias("signed"))


# --- pages and formatting ----------------------------------------------------------------------------------------

_NUM = "nums AS (SELECT source, (doc_id * doc_id // 400) % 97 AS page, doc_id FROM documents)"


def _numbers(spark, d):
    return table(spark, d, "documents").select("source", F.expr("(doc_id * doc_id div 400) % 97").alias("page"), "doc_id")


@_query(f"""WITH {_NUM}, u AS (SELECT DISTINCT source, page FROM nums), g AS (SELECT source, page, page - row_number() OVER (PARTITION BY source ORDER BY page) AS island FROM u),
r AS (SELECT source, island, min(page) AS a, max(page) AS b FROM g GROUP BY 1, 2)
SELECT source, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY 1""")
def page_ranges(spark, d):
    return pages.ranges(_numbers(spark, d), "source", "page")


@_query(f"WITH {_NUM}, e AS (SELECT source, min(page) AS a, max(page) AS b FROM nums GROUP BY 1) SELECT source, missing FROM e, range(a, b + 1) AS r(missing) WHERE (source, missing) NOT IN (SELECT source, page FROM nums)")
def missing_pages(spark, d):
    return pages.missing_pages(_numbers(spark, d), "source", "page")


@_query("""WITH p AS (SELECT source, doc_id AS ord, (doc_id // 60) AS number, text, n_chars % 4 > 0 AS labelled FROM documents),
j AS (SELECT *, CASE WHEN labelled AND lag(number) OVER w = number THEN 0 ELSE 1 END AS opens FROM p WINDOW w AS (PARTITION BY source ORDER BY ord)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY ord) AS island FROM j)
SELECT source, min(ord) AS ord, min(number) AS number, count(*) AS parts, max(labelled::INT) = 1 OR count(*) > 1 AS labelled, sha256(string_agg(text, chr(10) ORDER BY ord)) AS sha256 FROM i GROUP BY source, island""")
def page_merge(spark, d):
    rows = table(spark, d, "documents").select("source", F.col("doc_id").alias("ord"), F.expr("doc_id div 60").alias("number"), "text", F.expr("n_chars % 4 > 0").alias("labelled"))
    return pages.merge_pages(rows).select("source", "ord", "number", "parts", "labelled", F.sha2("text", 256).alias("sha256"))


@_query("""WITH c AS (SELECT lang, doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN 'Book ' || (doc_id // 30) ELSE ' ' END), ''), source, '') AS name FROM documents)
SELECT lang, doc_id, name, CASE WHEN name <> '' AND name IS DISTINCT FROM lag(name) OVER (PARTITION BY lang ORDER BY doc_id) THEN name ELSE '' END AS shown FROM c""")
def source_label_collapse(spark, d):
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Book "), F.expr("doc_id div 30").cast("string"))).otherwise(" ")
    rows = table(spark, d, "documents").select("lang", "doc_id", pages.label(title, F.col("source")).alias("name"))
    return pages.collapse_labels(rows, "lang", "doc_id")


@_query("""SELECT doc_id, '📄 Extraits cités :' || chr(10) || '1. « ' || CASE WHEN len(t) > 200 THEN rtrim(substr(t, 1, 200)) || '…' ELSE t END || ' » — ' || source || ' — page 3 (lignes 1-' || n_chars || ')' AS excerpt,
  source || ' — page 3 (lignes 1-' || n_chars || '), page 4 (lignes 2-5)' AS cited FROM (SELECT *, replace(trim(text), chr(10), ' ') AS t FROM documents)""")
def citation_format(spark, d):
    s = F.struct("source", F.lit(None).cast("string").alias("title"), F.lit(3).alias("page"), F.lit(1).cast("long").alias("line_start"), F.col("n_chars").alias("line_end"))
    s2 = F.struct("source", F.lit(" ").alias("title"), F.lit(4).alias("page"), F.lit(2).cast("long").alias("line_start"), F.lit(5).cast("long").alias("line_end"))
    rows = table(spark, d, "documents")
    return rows.select("doc_id", formatting.format_excerpts(F.array("text"), F.array(s), "fr").alias("excerpt"), formatting.format_sources(F.array(s, s2), "fr").alias("cited"))


_ENTITIES = "MAP {" + ", ".join(f"'{k}': chr({v})" for k, v in (name2codepoint | {"apos": 39}).items()) + "}"
_HTML = rf"""WITH m AS (SELECT {_ENTITIES} AS m),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '[\s\x0B]+', ' ', 'g'),
  '(?i)</?(?:{"|".join((*BLOCK_TAGS, *BREAK_TAGS))})\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM pages),
p AS (SELECT page_id, string_split(t, '&') AS p FROM b),
e AS (SELECT page_id, i, CASE WHEN i = 1 THEN p[1] WHEN m[regexp_extract(p[i], '^([A-Za-z][A-Za-z0-9]*);', 1)] IS NULL THEN '&' || p[i]
  ELSE m[regexp_extract(p[i], '^([A-Za-z][A-Za-z0-9]*);', 1)] || substr(p[i], len(regexp_extract(p[i], '^([A-Za-z][A-Za-z0-9]*);', 1)) + 2) END AS x FROM p, m, range(1, len(p) + 1) AS r(i)),
l AS (SELECT page_id, list_filter(list_transform(string_split(string_agg(x, '' ORDER BY i), chr(10)), lambda x: trim(regexp_replace(x, '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g'))), lambda x: x <> '') AS l FROM e GROUP BY page_id)
SELECT page_id, i - 1 AS line_no, l[i] AS line FROM l, range(1, len(l) + 1) AS r(i)"""


@_query(_HTML)
def html_lines(spark, d):
    """Pages as lines of text."""
    rows = table(spark, d, "pages").select("page_id", F.posexplode(pages.html_lines(F.col("html"))).alias("line_no", "line"))
    return rows.select("page_id", F.col("line_no").cast("long").alias("line_no"), "line")


@_query("""SELECT doc_id, replace(printf('%.1f', n_chars / 7.0::DOUBLE), '.', ',') AS number, CASE WHEN n_chars <= 1 THEN n_chars || ' question' ELSE n_chars || ' questions' END AS counted,
  CASE WHEN n_chars < 90 THEN replace(printf('%.1f', n_chars::DOUBLE), '.', ',') || ' s' WHEN n_chars < 5400 THEN printf('%.0f', (n_chars / 60)::DOUBLE) || ' min' WHEN n_chars / 3600 < 36 THEN replace(printf('%.1f', (n_chars / 3600)::DOUBLE), '.', ',') || ' h' ELSE replace(printf('%.1f', (n_chars / 86400)::DOUBLE), '.', ',') || ' jours' END AS duration,
  CASE WHEN n_chars = 0 OR 120 / (n_chars * 32 / 1000) >= 5 THEN 'ok' WHEN 120 / (n_chars * 32 / 1000) >= 2 THEN 'thin' ELSE 'too_slow' END AS verdict FROM documents""")
def french_formats(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select(
        "doc_id", formatting.french_number(n / 7, 1).alias("number"), formatting.counted(n, "question").alias("counted"),
        formatting.duration(n.cast("double")).alias("duration"), formatting.batch_verdict(F.lit(32), n.cast("double"), F.lit(120)).alias("verdict"),
    )


_BLANK = r"'^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$'"


@_query(rf"""WITH t AS (SELECT doc_id, source, regexp_replace(text, {_BLANK}, '', 'g') AS t FROM documents)
SELECT doc_id, 'Passage sélectionné dans l''ouvrage (à vérifier) :' || chr(10) || chr(10) || t || chr(10) || chr(10) || source || ' — page 1 (lignes 2-3)' AS chosen,
  '📄 Extraits cités :' || chr(10) || '1. « ' || CASE WHEN len(t) > 200 THEN regexp_replace(substr(replace(t, chr(10), ' '), 1, 200), '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '') || '…' ELSE replace(t, chr(10), ' ') END || ' » — ' || source || ' — page 1 (lignes 2-3)' AS excerpt FROM t""")
def blank_margins(spark, d):
    """Passages and titles with white space of several kinds around them."""
    blank = F.lit("\n\t\u00a0\u2003\x0b ")
    s = F.struct("source", blank.alias("title"), F.lit(1).alias("page"), F.lit(2).alias("line_start"), F.lit(3).alias("line_end"))
    padded = F.concat(blank, "text", blank)
    rows = table(spark, d, "documents")
    return rows.select("doc_id", formatting.format_chosen(padded, s, "fr").alias("chosen"), formatting.format_excerpts(F.array(padded), F.array(s), "fr").alias("excerpt"))


@_query("""SELECT doc_id, replace(printf('%.1f', (n_chars % 1000) / 20.0::DOUBLE), '.', ',') AS tenths, replace(printf('%.2f', (n_chars % 1000) / 200.0::DOUBLE), '.', ',') AS hundredths,
  replace(printf('%.1f', (n_chars % 1000) / 4.0::DOUBLE), '.', ',') AS quarters, replace(printf('%.0f', (n_chars % 1000) / 2.0::DOUBLE), '.', ',') AS halves FROM documents""")
def rounded_numbers(spark, d):
    """Numbers that lie right between two roundings, or seem to."""
    n = F.col("n_chars") % 1000
    each = {"tenths": (n / 20, 1), "hundredths": (n / 200, 2), "quarters": (n / 4, 1), "halves": (n / 2, 0)}
    return table(spark, d, "documents").select("doc_id", *[formatting.french_number(v, p).alias(c) for c, (v, p) in each.items()])
