"""The corpus queries by name, each over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import byte_cnn, chat, decontaminate, exact_dedup, language_id, line_dedup, mixing, simhash, token_counts, token_store

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(PIECES))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


def op3_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_store.token_documents(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.mixture(docs).select("doc_id", mixing.token_count(docs["text"]).alias("n_tokens"), "copies")


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.languages(table(spark, folder, "documents"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return byte_cnn.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    out = chat.chat_documents(table(spark, folder, "conversations"))
    return out.select("conv_id", "chunk", "n_turns", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_token_ids": op3_token_ids,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_decontaminate": op6_decontaminate,
    "op7_language": op7_language,
    "op8_quality": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_chat": op10_chat,
    "pipeline": corpus_pipeline.run,
}

_DOMAIN = "CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) = '' THEN 'other' ELSE 'domain' || (regexp_extract(source, '([0-9]{1,9})$', 1)::BIGINT % 4)::VARCHAR END"


def _level(name: str, above: str, parents: list[str], level: str, weight: str) -> str:
    """SQL of one level of the tree: shares of the parent's share in closed form."""
    key = ", ".join([*parents, level])
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    joined = f"JOIN {above} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {above}"
    return f"""
        {name}_n AS (SELECT {key}, sum(cap)::HUGEINT AS cap, {weight} AS w FROM leaves GROUP BY {key}),
        {name}_o AS (
            SELECT {key}, cap, w, greatest(share - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::HUGEINT AS rest,
                   (sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS ws, row_number() OVER q AS k
            FROM {name}_n {joined} WINDOW q AS ({part} ORDER BY cap::DOUBLE / w, {level})
        ),
        {name}_f AS (SELECT *, min(CASE WHEN cap * ws <= rest * w THEN NULL ELSE k END) OVER ({part}) AS stop FROM {name}_o),
        {name} AS (
            SELECT {key}, CASE WHEN stop IS NULL OR k < stop THEN cap ELSE (max(CASE WHEN k = stop THEN rest END) OVER ({part}) * w) // (max(CASE WHEN k = stop THEN ws END) OVER ({part})) END AS share
            FROM {name}_f
        )"""


_MIXING = f"""
    WITH t AS (
        SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_DOMAIN} AS domain,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n
        FROM documents
    ),
    leaves AS (SELECT domain, lang, source, sum(n)::HUGEINT AS tokens, sum(n)::HUGEINT * {mixing.MAX_EPOCHS} AS cap FROM t GROUP BY ALL),
    root AS (SELECT floor(sum(tokens) * {mixing.SHARE}::DOUBLE)::HUGEINT AS share FROM leaves),
    {_level("d", "root", [], "domain", "CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END")},
    {_level("l", "d", ["domain"], "lang", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 ELSE 1 END")},
    {_level("s", "l", ["domain", "lang"], "source", "1")},
    e AS (SELECT *, CASE WHEN tokens > 0 THEN share // tokens ELSE {mixing.MAX_EPOCHS} END AS epochs FROM s JOIN leaves USING (domain, lang, source)),
    k AS (SELECT t.*, epochs, share - epochs * tokens AS remains, md5('{mixing.SEED}-' || (epochs + 1)::VARCHAR || '-' || doc_id::VARCHAR) AS key FROM t JOIN e USING (domain, lang, source)),
    c AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM k)
    SELECT doc_id, n AS n_tokens, (epochs + CASE WHEN remains > 0 AND upto <= remains THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
"""

ORACLE_SQL = {
    "op5_mixing": _MIXING,
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM n
    """,
    "op10_chat": f"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        c AS (SELECT conv_id, list(role || chr(0) || text ORDER BY k) AS turns FROM t GROUP BY conv_id),
        kept AS (
            SELECT conv_id FROM c a
            WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.turns[1] = a.turns[1] AND len(b.turns) > len(a.turns) AND b.turns[1:len(a.turns)] = a.turns)
              AND NOT EXISTS (SELECT 1 FROM c b WHERE b.turns = a.turns AND b.conv_id < a.conv_id)
        ),
        r AS (
            SELECT conv_id, (k - 1) // {chat.CHUNK} AS chunk, count(*) AS n_turns, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY k) AS text
            FROM t JOIN kept USING (conv_id) GROUP BY ALL
        )
        SELECT conv_id, chunk, n_turns, length(text) AS n_chars, sha256(text) AS text_sha256 FROM r
    """,
}
