"""Greedy packing of text blocks into retrieval windows, as a fold over a page's blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TARGET = 512
_CHUNK = "struct<headings: array<string>, blocks: array<string>, tokens: int>"
_STATE = f"struct<done: array<{_CHUNK}>, trail: array<string>, open: array<string>, blocks: array<string>, tokens: int>"


def chunk_array(blocks: Column, target: int = TARGET) -> Column:
    """Chunks (headings, blocks, tokens) of an array of (level, text); level 0 is no heading. A block as large as a chunk stands alone."""
    empty = F.from_json(F.lit('{"done":[],"trail":[],"open":[],"blocks":[],"tokens":0}'), _STATE)

    def closed(s: Column) -> Column:
        chunk = F.struct(s["open"].alias("headings"), s["blocks"].alias("blocks"), T.approx_tokens(F.array_join(s["blocks"], "\n\n")).alias("tokens"))
        return F.when(F.size(s["blocks"]) > 0, F.concat(s["done"], F.array(chunk))).otherwise(s["done"])

    def step(s: Column, b: Column) -> Column:
        cost = T.approx_tokens(b["text"])
        full = (F.size(s["blocks"]) > 0) & ((cost >= target) | (s["tokens"] + cost > target))
        done, kept = F.when(full, closed(s)).otherwise(s["done"]), F.when(full, F.array().cast("array<string>")).otherwise(s["blocks"])
        used = F.when(full, 0).otherwise(s["tokens"])
        trail = F.when(b["level"] > 0, F.concat(F.slice(s["trail"], 1, F.greatest(b["level"] - 1, F.lit(0))), F.array(b["text"]))).otherwise(s["trail"])
        opened = F.when(F.size(kept) == 0, trail).otherwise(s["open"])
        now = F.concat(kept, F.array(b["text"]))
        alone = F.struct(opened.alias("headings"), now.alias("blocks"), T.approx_tokens(F.array_join(now, "\n\n")).alias("tokens"))
        whole = cost >= target
        return F.struct(
            F.when(whole, F.concat(done, F.array(alone))).otherwise(done).alias("done"), trail.alias("trail"), opened.alias("open"), F.when(whole, F.array().cast("array<string>")).otherwise(now).alias("blocks"), F.when(whole, 0).otherwise(used + cost).cast("int").alias("tokens")
        ).cast(_STATE)

    return F.aggregate(blocks, empty, step, closed)


def lead(chunk: Column) -> Column:
    """First block that is no heading of the trail."""
    return F.coalesce(F.try_element_at(F.filter(chunk["blocks"], lambda b: ~F.array_contains(chunk["headings"], b)), F.lit(1)), F.try_element_at(chunk["blocks"], F.lit(1)), F.lit(""))


def survives(chunk: Column) -> Column:
    """Whether a chunk can stand for itself: a fact in its trail or lead, and a lead that does not point back."""
    return T.has_fact_anchor(F.concat_ws(" ", F.array_join(chunk["headings"], " "), lead(chunk))) & T.opens_clean(lead(chunk))


def chunks(pages: DataFrame, target: int = TARGET, blocks: str = "blocks") -> DataFrame:
    """Columns of ``pages`` without ``blocks``, and a row for each chunk: idx from 1, headings, blocks, text, tokens."""
    keep = [x for x in pages.columns if x != blocks]
    rows = pages.select(*keep, F.posexplode(chunk_array(F.col(blocks), target)).alias("idx", "chunk"))
    return rows.select(*keep, (F.col("idx") + 1).alias("idx"), "chunk.headings", F.col("chunk.blocks").alias("blocks"), F.array_join("chunk.blocks", "\n\n").alias("text"), "chunk.tokens", lead(F.col("chunk")).alias("lead"), survives(F.col("chunk")).alias("survives"))
