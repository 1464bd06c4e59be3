"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import (
    alignment,
    chat_format,
    decontaminate,
    exact_dedup,
    language_id,
    language_model,
    license_scan,
    quality,
    ranked_search,
    sentencepiece_bpe,
    simhash,
    substring_dedup,
    url_filter,
)

#: Where the public tokenizer files lie; GLYPHMILL_TOKENIZERS overrides the installed package's place.
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


#: Tools that calls may name, with the JSON schemas of their arguments.
TOOL_SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "open_page": {"type": "object", "properties": {"url": {"type": "string"}}, "required": ["url"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}

#: Phrases that name a license, with their labels.
LICENSE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices by which works are put under a license, as their publishers word them.
LICENSE_NOTICES = {
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mit": [
        "Released under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}


def tokenizer_path(name: str = PIECE_MODEL) -> str:
    """Path of a tokenizer file of the installed ``public_tokenizers`` package, or of the folder GLYPHMILL_TOKENIZERS."""
    folder = os.environ.get("GLYPHMILL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """At least a partition per core for work heavier than its scan: a small file is dealt out first."""
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = sentencepiece_bpe.encode(docs, tokenizer_path(), decode=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("source_bytes"),
        F.sha2(F.concat_ws(";", F.array_join("begins", ","), F.array_join("ends", ",")), 256).alias("spans_sha256"),
    )


def _hashed(id_col: str, buckets: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(buckets))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_hashed("doc_id", 4) == 2, F.lit(False))
    parser = language_id.learn(docs.where(~held_out))
    out = language_id.identify(docs, parser, carry=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "phrase_bytes")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"), TOOL_SCHEMAS)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return out.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(_hashed("doc_id", 5) == 1, F.lit(False))
    return language_model.score_texts(table(spark, sf_dir, "documents"), ~held_out)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(_hashed("doc_id", 5) == 0, F.lit(False))
    trees = quality.learn(docs, labels.where(~held_out))
    out = quality.score_quality(docs, trees, carry=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spread(spark, table(spark, sf_dir, "documents")), LICENSE_PHRASES, LICENSE_NOTICES)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(spread(spark, table(spark, sf_dir, "documents")))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"), k=10).withColumnRenamed("id", "doc_id")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(spread(spark, table(spark, sf_dir, "documents")), tokenizer_path(BYTE_MODEL), tokenizer_path())


def queries() -> dict:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_language_id": op2_language_id,
        "op3_chat_format": op3_chat_format,
        "op4_decontamination": op4_decontamination,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_url_filter": op7_url_filter,
        "op8_simhash": op8_simhash,
        "op9_language_model": op9_language_model,
        "op10_quality": op10_quality,
        "op11_license_scan": op11_license_scan,
        "op12_ranked_search": op12_ranked_search,
        "op13_alignment": op13_alignment,
    }


#: A-Z to a-z, for SQL whose lower() would change other letters.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_OP4 = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM item, range(1, len(w) - least(10, len(w)) + 2) AS r(i) WHERE len(w) > 0
),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
hits AS (
  SELECT doc_id, i, d.n, item FROM (
    SELECT doc_id, i, s.n, array_to_string(w[i:i + s.n - 1], ' ') AS gram
    FROM doc, (SELECT DISTINCT n FROM win) AS s, range(1, len(w) - s.n + 2) AS r(i)
  ) AS d JOIN win ON win.gram = d.gram AND win.n = d.n
),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, range(i, i + n) AS q(p) GROUP BY doc_id),
items_hit AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""

ORACLE_OP5 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d WINDOW same AS (PARTITION BY h)
"""

# The given pages hold no redirects or canonical links, so here the rules alone decide; aliases are tested in tests/llm.
ORACLE_OP7 = rf"""
WITH rules(action, h, p) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, {_LOWER.format("regexp_extract(r, '^[^/?#]*', 0)")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict, CAST(NULL AS VARCHAR) AS component
FROM parts LEFT JOIN best USING (page_id)
"""


# The given conversations hold no tool calls; links, order and arguments are tested in tests/llm.
ORACLE_OP3 = """
WITH placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST) - 1 AS position FROM conversations
)
SELECT conv_id, turn, role, position, CAST(NULL AS VARCHAR) AS link, CAST(NULL AS VARCHAR) AS errors,
  '{' || concat_ws(',', '"content":' || to_json(text), '"conv_id":' || conv_id, '"position":' || position, '"role":' || to_json(role), '"turn":' || turn) || '}' AS message_json
FROM placed
"""


def _notices_sql() -> str:
    rows = []
    for label, texts in LICENSE_NOTICES.items():
        for text in texts:
            words = license_scan.words_of(text)
            rows.append(f"('{label}', {license_scan.block_words(len(words))}, {sorted(set(words))})")
    return ", ".join(rows)


def _phrase_sql(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words, 1))
    return f"SELECT doc, i, '{LICENSE_PHRASES[phrase]}' AS label FROM d, range(0, len(w) - {len(words) - 1}) AS r(i) WHERE {same}"


# Every block of every size against every notice, without filters.
ORACLE_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {_WORDS} AS w FROM documents),
base AS ({" UNION ALL ".join(map(_phrase_sql, LICENSE_PHRASES))}),
named AS (SELECT doc, count(*) AS n, min(i) AS a, max(i) AS b, list_sort(list_distinct(list(label))) AS labels FROM base GROUP BY doc),
notice(label, size, own) AS (VALUES {_notices_sql()}),
block AS (SELECT doc, s.size, w[k * s.size // 2 + 1:k * s.size // 2 + s.size] AS own FROM d, (SELECT DISTINCT size FROM notice) AS s, range(0, CAST(greatest(ceil((len(w) - s.size) / (s.size / 2)), 0) AS BIGINT) + 1) AS r(k)),
share AS (SELECT doc, label, len(list_intersect(block.own, notice.own)) / len(notice.own) AS share FROM block JOIN notice USING (size)),
method AS (SELECT doc, list_distinct(list(label)) AS labels, max(share) AS share FROM share WHERE share >= {license_scan.THRESHOLD} GROUP BY doc)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word,
  array_to_string(coalesce(named.labels, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(named.labels, []), coalesce(method.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN named USING (doc) LEFT JOIN method USING (doc)
"""

_TERMS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {_TERMS} AS t FROM documents),
totals AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS length FROM d),
wanted AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
tf AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, n_docs),
score AS (
  SELECT item_id, doc, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // length)))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weight USING (term), totals GROUP BY item_id, doc, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= 10
"""


def oracle_sql() -> dict:
    return {"op3_chat_format": ORACLE_OP3, "op4_decontamination": ORACLE_OP4, "op5_exact_dedup": ORACLE_OP5, "op7_url_filter": ORACLE_OP7, "op11_license_scan": ORACLE_OP11, "op12_ranked_search": ORACLE_OP12}
