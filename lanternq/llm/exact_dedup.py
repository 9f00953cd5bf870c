"""Exact dedup by content sort, in DataFrame operations only.

Rows are range-partitioned by their normalised bytes: Spark samples splitters over (first bytes, hash of all bytes, block), sorts
each partition externally, and a window whose partition is the whole normalised text compares neighbouring rows in full. The splitters
hold a bounded prefix and a hash, so that the sample that reaches the driver stays small however long texts are.

A text that many rows share would fill one partition. Counts of a 64-bit hash (summed before the shuffle) find the texts that hold more
than 1 / (4 * partitions) of the rows; there are at most 4 * partitions of them, so that list can be broadcast. Their rows are dealt over blocks
of about that size, each block is sorted on its own, and the blocks' first rows (one for each block) are merged by full comparison of their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import parked, shuffle_partitions

#: Runs of these that are not just one space become one space.
BLANKS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
PREFIX = 48
LEAST_BLOCK = 64


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space (a run that is one space already needs no work); null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and form a group with the empty ones. Of equal texts the row with the smallest id stays; a null id
    comes last; of rows that repeat both id and text just one stays. Columns other than the two named are not read, so
    their names cannot clash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    block = max(LEAST_BLOCK, docs.count() // (4 * parts))
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("digest", F.xxhash64("norm"))
    hot = base.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > block).select("digest", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    dealt = base.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(hot), "digest", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod("row", "blocks"))).withColumn("head", F.substring("norm", 1, PREFIX))
    equal = Window.partitionBy("head", "digest", "block", "norm").orderBy(F.col("id").asc_nulls_last(), "row")
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(equal) == 1
    by_block = (
        dealt.repartitionByRange("head", "digest", "block")
        .select("id", "digest", "block", "blocks", "norm", first.alias("first"), F.first("id").over(whole).alias("low"), F.count("*").over(whole).alias("n"))
        .select("id", "digest", "block", "low", "n", "first", F.when(F.col("first") & F.col("blocks").isNotNull(), F.col("norm")).alias("witness"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    )
    rows = parked(by_block, "blocks")
    heads = rows.where(F.col("witness").isNotNull()).select("witness", "digest", "block", "low", "n")
    merged = heads.groupBy("witness").agg(F.min(F.struct(F.col("low").isNull().alias("none"), F.col("low").alias("low"), F.col("block").alias("block"))).alias("best"), F.sum("n").alias("all"))
    fixed = heads.join(merged, "witness").select(F.col("digest").alias("d"), F.col("block").alias("b"), F.col("low").alias("l"), F.col("best.low").alias("keep"), F.col("best.block").alias("keep_block"), "all")
    same = (F.col("digest") == F.col("d")) & (F.col("block") == F.col("b")) & F.col("low").eqNullSafe(F.col("l"))
    out = rows.drop("witness").join(F.broadcast(fixed), same, "left")
    split = F.col("d").isNotNull()
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(split, F.col("keep")).otherwise(F.col("low")).alias("keep_id"),
        F.when(split, F.col("all")).otherwise(F.col("n")).alias("group_size"),
        (F.col("first") & (~split | (F.col("block") == F.col("keep_block")))).alias("kept"),
        "text_sha256",
    )
