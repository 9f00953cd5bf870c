"""Chat formatting with collapse of cumulative snapshots, in DataFrame operations only.

Logs often hold a conversation several times, each copy a few turns longer. The rolling hash of a conversation's first k turns is the XOR of two 64-bit
hashes of (place, role, text) over those turns. A conversation whose whole hash is the hash of the first k turns of a longer one is dropped, and of equal
ones the smallest id stays. The hashes of proper prefixes are made distinct before they are joined, so that an opening that many
conversations share is one row.

Turns are numbered and hashed within blocks of BLOCK turn numbers, and the blocks are then chained, so that a conversation need not fit in
one task; it is rendered in chunks of CHUNK turns for the same reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import parked

BLOCK, CHUNK = 64, 256
BEGIN, END = "<|{}|>\n", "<|end|>\n"


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, block, place, x, y, piece): place within the conversation, XORs of hashes from its block's first turn on, and the rendered turn."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).where(F.col("conv").isNotNull())
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62)).cast("long"))
    sizes = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parked(sizes.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    order = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    placed = rows.join(offsets, ["conv", "block"]).withColumn("place", F.col("offset") + F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        "conv", "block", "place",
        F.bit_xor(F.xxhash64("place", "role", "text")).over(upto).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "text", "role", "place")).over(upto).alias("y"),
        F.concat(F.lit(BEGIN.split("{}")[0]), "role", F.lit(BEGIN.split("{}")[1]), "text", F.lit(END)).alias("piece"),
    )


def chat_documents(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rendered maximal conversations: conv_id, chunk (from 0, of CHUNK turns each), n_turns (of the chunk), text.

    Turns are in order of turn number (null last), then role, then text; repeated turns count as often as they occur. Null roles and texts count as empty. Rows
    with a null conversation id belong to no conversation and are left out. Other columns are not read. An empty table gives no rows.
    """
    rows = parked(_turns(turns, conv_col, turn_col, role_col, text_col), "turns")
    ends = rows.groupBy("conv", "block").agg(F.max(F.struct("place", "x", "y")).alias("end"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy("conv")
    chained = parked(
        ends.select(
            "conv", "block", F.coalesce(F.bit_xor("end.x").over(before), F.lit(0)).alias("bx"), F.coalesce(F.bit_xor("end.y").over(before), F.lit(0)).alias("by"),
            F.max("end.place").over(all_of).alias("n"), F.bit_xor("end.x").over(all_of).alias("wx"), F.bit_xor("end.y").over(all_of).alias("wy"),
        ),
        "chained",
    )
    whole = chained.groupBy("n", "wx", "wy").agg(F.min("conv").alias("conv"))
    prefixes = rows.join(chained, ["conv", "block"]).where(F.col("place") < F.col("n")).select(F.col("place").alias("n"), F.col("x").bitwiseXOR(F.col("bx")).alias("wx"), F.col("y").bitwiseXOR(F.col("by")).alias("wy")).distinct()
    kept = parked(whole.join(parked(prefixes, "prefixes"), ["n", "wx", "wy"], "left_anti").select("conv"), "kept")
    chunk = F.floor((F.col("place") - 1) / CHUNK).cast("long")
    parts = rows.join(kept, "conv", "left_semi").groupBy("conv", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("turns"))
    return parts.select(F.col("conv").alias("conv_id"), "chunk", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.piece", "").alias("text"))
