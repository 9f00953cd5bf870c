"""A byte-level convolutional network in numpy, and text quality scored by it.

A text is its UTF-8 bytes. Filters six bytes wide move over it two bytes at a time; their largest response in each chunk of 256 bytes, of which
a new one starts every 128, goes through a hidden layer, and the mean and the maximum of that over all chunks of the document
give one probability. The chunks overlap and cover the whole text, whatever its length.

With a step of two bytes a filter is three look-ups in tables of byte pairs, so that scoring needs no multiplication per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..shared import fresh

WIDTH, STEP = 6, 2
BLOCK = 128
FILTERS, HIDDEN = 16, 16
#: The classifier is fitted on at most so many labelled rows of each class, and of these on texts of at most so many bytes.
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 1 << 16
EPOCHS, BATCH, RATE, DECAY = 14, 50, 3e-3, 1e-4
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Bytes convolved at once when scoring.
TILE = 1 << 17


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each followed by at least WIDTH - STEP zero bytes and filled up to whole blocks; and the number of blocks of each."""
    blocks = np.array([(len(x) + WIDTH - STEP) // BLOCK + 1 for x in texts], np.int64)
    out = bytearray(int(blocks.sum()) * BLOCK + WIDTH - STEP)
    at = 0
    for x, n in zip(texts, blocks.tolist(), strict=True):
        out[at : at + len(x)] = x
        at += n * BLOCK
    return np.frombuffer(bytes(out), np.uint8), blocks


@dataclass
class ByteCNN:
    filters: int = FILTERS
    hidden: int = HIDDEN
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.p:
            r = np.random.default_rng(self.seed)
            self.p = {
                "conv": r.normal(0, 0.15, (WIDTH, 256, self.filters)).astype(np.float32), "conv_b": np.zeros(self.filters, np.float32),
                "mix": r.normal(0, 0.3, (self.filters, self.hidden)).astype(np.float32), "mix_b": np.full(self.hidden, 0.1, np.float32),
                "out": r.normal(0, 0.1, 2 * self.hidden).astype(np.float32), "out_b": np.zeros(1, np.float32),
            }

    def tables(self) -> list[np.ndarray]:
        """Responses to each pair of bytes (low byte first), one table for each pair of a filter's places."""
        c = self.p["conv"]
        return [(c[i + 1][:, None, :] + c[i][None, :, :]).reshape(1 << 16, -1) for i in range(0, WIDTH, STEP)]

    def responses(self, pairs: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        n = len(pairs) - len(tables) + 1
        out = tables[0][pairs[:n]]
        for j, t in enumerate(tables[1:], 1):
            out += t[pairs[j : j + n]]
        return out

    @staticmethod
    def closed(raw: np.ndarray, blocks: np.ndarray, first: int = 0) -> np.ndarray:
        """``raw`` (blocks from ``first`` on, places, filters) without the windows that reach from a document's last zero bytes into the next document."""
        last = np.cumsum(blocks) - 1 - first
        raw[last[(last >= 0) & (last < len(raw))], -(WIDTH - STEP) // STEP :] = -np.inf
        return raw

    def head(self, peaks: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, ...]:
        """From the largest responses of each block: chunks (a block and the next of the same document), hidden layer, pooling, logit."""
        last = np.cumsum(blocks) - 1
        follow = np.arange(1, len(peaks) + 1)
        follow[last] = last
        right = peaks[follow] > peaks
        chunk = np.maximum(np.where(right, peaks[follow], peaks) + self.p["conv_b"], 0)
        hidden = np.maximum(chunk @ self.p["mix"] + self.p["mix_b"], 0)
        starts = last - blocks + 1
        pooled = np.concatenate((np.add.reduceat(hidden, starts) / blocks[:, None], np.maximum.reduceat(hidden, starts)), 1)
        return follow, right, chunk, hidden, pooled, pooled @ self.p["out"] + self.p["out_b"][0]

    def scores(self, texts: list[bytes], tables: list[np.ndarray] | None = None) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        tables = tables or self.tables()
        data, blocks = packed(texts)
        pairs = data.view(np.uint16)
        peaks = np.empty((int(blocks.sum()), self.filters), np.float32)
        step = TILE // BLOCK
        for i in range(0, len(peaks), step):
            n = min(step, len(peaks) - i)
            part = pairs[i * BLOCK // STEP : (i + n) * BLOCK // STEP + len(tables) - 1]
            self.closed(self.responses(part, tables).reshape(n, BLOCK // STEP, -1), blocks, i).max(1, out=peaks[i : i + n])
        return 1 / (1 + np.exp(-np.clip(self.head(peaks, blocks)[-1].astype(np.float64), -40, 40)))

    def gradients(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        data, blocks = packed(texts)
        pairs = data.view(np.uint16)
        raw = self.closed(self.responses(pairs, self.tables()).reshape(int(blocks.sum()), BLOCK // STEP, -1), blocks)
        where = raw.argmax(1)
        peaks = np.take_along_axis(raw, where[:, None, :], 1)[:, 0]
        follow, right, chunk, hidden, pooled, logit = self.head(peaks, blocks)
        d = ((1 / (1 + np.exp(-logit)) - labels) * weights / weights.sum()).astype(np.float32)
        g = {"out": pooled.T @ d, "out_b": np.array([d.sum()], np.float32)}
        doc = np.repeat(np.arange(len(blocks)), blocks)
        d_pool = d[:, None] * self.p["out"]
        top = ((hidden == pooled[doc, self.hidden :]) & (hidden > 0)).astype(np.float32)
        top /= np.maximum(np.add.reduceat(top, np.cumsum(blocks) - blocks), 1)[doc]  # equal chunks share
        d_hidden = ((d_pool[:, : self.hidden] / blocks[:, None])[doc] + top * d_pool[doc, self.hidden :]) * (hidden > 0)
        g |= {"mix": chunk.T @ d_hidden, "mix_b": d_hidden.sum(0)}
        d_chunk = (d_hidden @ self.p["mix"].T) * (chunk > 0)
        g["conv_b"] = d_chunk.sum(0)
        block = np.where(right, follow[:, None], np.arange(len(peaks))[:, None])
        f = np.arange(self.filters)[None, :]
        at = block * BLOCK + where[block, f] * STEP
        g["conv"] = np.stack([np.bincount((data[at + j].astype(np.int64) * self.filters + f).ravel(), d_chunk.ravel(), 256 * self.filters).reshape(256, -1) for j in range(WIDTH)]).astype(np.float32)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> ByteCNN:
        """Adam on the weighted log loss; the order of the rows is drawn from the seed."""
        r, t = np.random.default_rng(self.seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(EPOCHS):
            order = r.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                t += 1
                rate = RATE * (1 - epoch / EPOCHS) + 1e-4
                for k, x in self.gradients([texts[j] for j in own], labels[own], weights[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8) + DECAY * self.p[k])
        return self


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> ByteCNN:
    """Fitted on SAMPLE_ROWS labelled rows of each class at most, those with the smallest hashes of their id, none of the held-out fold; rows weigh as much as their class has in all labels."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = ByteCNN()
    chosen = None
    for y in sorted(counts):
        some = known.where(F.col("y") == y).distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
        chosen = some if chosen is None else chosen.unionAll(some)
    if chosen is None:
        model.p["out"][:] = 0
        return model
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    # However many rows repeat an id, one text of it is learned from: the one with the smallest hash.
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    rows = found.select("id", "y", "one.text").toPandas().sort_values(["id", "y"])
    if not len(rows):
        model.p["out"][:] = 0
        return model
    y = rows["y"].to_numpy()
    weights = np.array([counts[k] / max(1, (y == k).sum()) for k in y], np.float64)
    return model.fit([bytes(x) for x in rows["text"]], y.astype(np.float32), (weights / weights.mean()).astype(np.float32))


def score_column(docs: DataFrame, model: ByteCNN, columns: dict[str, Column], text_col: str = "text", out: str = "score") -> DataFrame:
    """``columns`` of ``docs`` and the probability, named ``out`` (none of ``columns`` may have that name)."""
    params, size = model.p, 2048

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = ByteCNN(model.filters, model.hidden, model.seed, params)
        tables = net.tables()
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                scores = net.scores([x or b"" for x in part.column(0).to_pylist()], tables)
                yield pa.record_batch([*part.columns[1:], pa.array(scores)], [*part.schema.names[1:], "score"])

    wide = docs.select(F.col(text_col).cast("binary").alias("bytes"), *[c.alias(f"c{i}") for i, c in enumerate(columns.values())])
    schema = StructType([*wide.schema.fields[1:], StructField("score", DoubleType())])
    return wide.mapInArrow(run, schema).toDF(*columns, out)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least THRESHOLD, with all their columns, whatever their names.

    Learned from ``labels`` as in ``quality_scores``; null and empty texts are scored like any other, and repeated rows each.
    """
    out = fresh(docs.columns, "score")
    scored = score_column(docs, learned(docs, labels, "quality", id_col, text_col), {c: F.col(f"`{c}`") for c in docs.columns}, text_col, out)
    return scored.where(F.col(out) >= THRESHOLD).drop(out)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.7).

    Null and empty texts are scored as a text without bytes. Without any labelled row every score is 0.5. Repeated rows are scored
    each; a null id is never held out, nor learned from. Only the bytes of a text enter its score.
    """
    model = learned(docs, labels, label, id_col, text_col)
    out = score_column(docs, model, {"doc_id": F.col(id_col), "held_out": held_out(id_col)}, text_col)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
