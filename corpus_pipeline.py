"""A corpus from documents to token shards: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternq.llm import byte_cnn, decontaminate, mixing, simhash, token_store
from lanternq.shared import fresh, parked
from lanternq.sources.tables import table

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It is fitted on labelled documents of the corpus outside the held-out fold.

    Null and empty texts are scored like any other, repeated rows each; columns may have any names. An empty table gives no rows.
    """
    return byte_cnn.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each near-duplicate group, the one with the smallest id; null ids come last, and rows that share an id are told apart by all their columns.

    Null and empty texts are one group. An empty table gives no rows.
    """
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null and empty texts are clean, repeated rows are judged each, columns may have any names, an empty table gives no rows."""
    out = fresh(docs.columns, "leaks")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), out=out)
    return found.where(F.size(out) == 0).drop(out)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them. Null texts have no tokens, null languages and sources count as empty names, rows that repeat an id in a leaf are taken together; columns may have any names but
    those with two underscores in front; an empty table gives no rows."""
    return mixing.mixed(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's documents, read back from its files. Null texts count as empty, null ids come last, repeated rows are stored each, other columns are not read, an empty table gives no rows."""
    return token_store.token_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_weights),
    ("token-ID / binary output", token_ids),
]

#: Hashes, a network and a tokenizer are not SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not i else parked(docs, f"stage{i}"), sf_dir)
    return docs
