"""Benchmark decontamination by spaced-seed hashing.

A document is contaminated by an item if some window of 20 consecutive words of the item (the whole item, if it is shorter) stands in
the document word for word, up to one substitution in every five words (4 in 20, 3 in 15). Words are runs of letters, digits and
non-ASCII characters, in lower case.

Fixed masks select four of five or six neighbouring words and ignore the rest; hashes of the selected words are joined between benchmark and
documents. The masks are such that every window that counts has a place where one of them meets no substitution (the tests go through all
patterns of substitutions), so the search loses nothing. Around each hit the aligned words are compared and the best window containing
the hit decides.

The benchmark is the query set: it is cut into blocks of bounded bytes, and each block is hashed on the driver and held against all documents in
one pass without a shuffle. Documents are read whole and never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 20
ERRORS_PER = 5
#: Masks by the shortest item they serve; below five words nothing may differ.
MASKS = {10: ((0, 1, 2, 4), (0, 1, 4, 5)), 5: ((0, 1),), 4: ((0, 1, 2, 3),), 3: ((0, 1, 2),), 2: ((0, 1),), 1: ((0,),)}
#: Benchmark bytes held at once.
BLOCK_BYTES = 16 << 20
#: Words of documents looked at together, and hits verified together.
WORDS, HITS = 1 << 20, 1 << 16
PAD = 2 * WINDOW
_FOLD = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
BITS = 20


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_FOLD).split()


def masks_for(n: int) -> tuple[tuple[int, ...], ...]:
    return next((m for least, m in MASKS.items() if n >= least), ())


def _hash(codes: np.ndarray, mask: tuple[int, ...], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the selected words at each of n places, and whether all of them are known."""
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j, o in enumerate(mask):
        part = codes[o : o + n]
        h += part.astype(np.uint64) * _ODD[j]
        known &= part > 0
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), known


class Index:
    """Seeds of one block of the benchmark."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        split = [words(t) for _, t in items]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(x for s in split for x in s), 1)}
        sizes = np.array([len(s) for s in split], np.int64)
        self.starts = np.cumsum(sizes + PAD) - sizes
        self.ends = self.starts + sizes
        self.need = np.minimum(sizes, WINDOW)
        # Words between items are -1: no document has them.
        self.codes = np.full(int((sizes + PAD).sum()) + PAD, -1, np.int32)
        for s, at in zip(split, self.starts.tolist(), strict=True):
            self.codes[at : at + len(s)] = [self.vocabulary[w] for w in s]
        self.item = np.repeat(np.arange(len(items)), sizes + PAD)
        self.item = np.concatenate((self.item, np.full(PAD, len(items) - 1 if items else 0)))
        self.seeds = []
        for mask in sorted({m for n in sizes.tolist() for m in masks_for(n)}):
            own = np.array([mask in masks_for(n) for n in sizes.tolist()], bool)
            n = len(self.codes) - mask[-1]
            h, known = _hash(self.codes, mask, n)
            inside = np.concatenate([np.arange(a, max(a, b - mask[-1])) for a, b, o in zip(self.starts, self.ends, own, strict=True) if o] or [np.zeros(0, np.int64)])
            inside = inside[known[inside]]
            order = np.argsort(h[inside], kind="stable")
            keys, places = h[inside][order], inside[order]
            distinct, first = np.unique(keys, return_index=True)
            filled = np.zeros(1 << BITS, bool)
            filled[(distinct >> np.uint64(64 - BITS)).astype(np.int64)] = True
            self.seeds.append((mask, distinct, np.concatenate((first, [len(keys)])), places, filled))

    def hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(places in the documents, places in the benchmark, length of the mask) where the selected words agree."""
        for mask, keys, bounds, places, filled in self.seeds:
            n = len(codes) - mask[-1]
            if n <= 0 or not len(keys):
                continue
            h, known = _hash(codes, mask, n)
            at = np.flatnonzero(known & filled[(h >> np.uint64(64 - BITS)).astype(np.int64)])
            found = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            own = keys[found] == h[at]
            at, found = at[own], found[own]
            many = bounds[found + 1] - bounds[found]
            for lo, hi in _slices(many):
                part = many[lo:hi]
                within = np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part)
                yield np.repeat(at[lo:hi], part), places[np.repeat(bounds[found[lo:hi]], part) + within], mask[-1] + 1

    def best(self, codes: np.ndarray, at: np.ndarray, to: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each hit: item, words that agree in the best window around it, and where that window begins in the documents."""
        item = self.item[to]
        agree, begin = np.full(len(at), -1), np.zeros(len(at), np.int64)
        reach = np.arange(-(WINDOW - 1), WINDOW + span - 1)
        same = codes[np.clip(at[:, None] + reach, 0, len(codes) - 1)] == self.codes[np.clip(to[:, None] + reach, 0, len(self.codes) - 1)]
        sums = np.concatenate((np.zeros((len(at), 1), np.int64), np.cumsum(same, 1)), 1)
        for size in np.unique(self.need[item]).tolist():
            own = np.flatnonzero(self.need[item] == size)
            first = np.arange(span - size, 1) if size >= span else np.zeros(0, np.int64)
            if not len(first) or not len(own):
                continue
            col = first + WINDOW - 1
            total = sums[own][:, col + size] - sums[own][:, col]
            starts = to[own][:, None] + first
            total = np.where((starts >= self.starts[item[own]][:, None]) & (starts + size <= self.ends[item[own]][:, None]), total, -1)
            top = total.argmax(1)
            agree[own], begin[own] = total[np.arange(len(own)), top], at[own] + first[top]
        return item, agree, begin

    def search(self, texts: list[str | None]) -> list[list[tuple[int | None, int, int, int]]]:
        """For each text: (item id, first word, words, words that agree) of the best window for each item that contaminates it."""
        split = [words(t) for t in texts]
        sizes = np.array([len(s) for s in split], np.int64)
        starts = np.cumsum(sizes + PAD) - sizes
        codes = np.zeros(int((sizes + PAD).sum()) + PAD, np.int32)
        for s, at in zip(split, starts.tolist(), strict=True):
            codes[at : at + len(s)] = np.fromiter(map(self.vocabulary.get, s, repeat(0)), np.int32, len(s))
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for at, to, span in self.hits(codes):
            item, agree, begin = self.best(codes, at, to, span)
            size = self.need[item]
            for k in np.flatnonzero(agree >= size - size // ERRORS_PER).tolist():
                doc = int(np.searchsorted(starts, at[k], "right")) - 1
                key, value = (doc, int(item[k])), (int(agree[k]), -int(begin[k] - starts[doc]))
                if value > found.get(key, (-1, 0)):
                    found[key] = value
        out: list[list[tuple[int | None, int, int, int]]] = [[] for _ in texts]
        for (doc, i), (n, begin) in sorted(found.items()):
            out[doc].append((self.ids[i], -begin, int(self.need[i]), n))
        return out


def _slices(many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of hits of about HITS pairs."""
    if len(many):
        cuts = np.flatnonzero(np.diff(np.cumsum(many) // HITS)) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(many)], strict=True)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    block, size = [], 0
    for r in rows.orderBy("id", "text").toLocalIterator():
        block.append((r["id"], r["text"]))
        size += len(r["text"].encode("utf-8", "replace"))
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


SPAN = "array<struct<item_id: bigint, first_word: bigint, words: bigint, agree: bigint>>"
_SPAN = pa.list_(pa.struct([(x, pa.int64()) for x in ("item_id", "first_word", "words", "agree")]))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", out: str = "leaks") -> DataFrame:
    """All columns of ``docs`` and ``out``: for each item that contaminates the text, the best window (item_id, first_word, words, agree); empty for clean texts.

    Null and empty texts are clean; items without a word contaminate nothing; a null item_id is reported as null; repeated rows and items
    are each reported. ``out`` must not be a column of ``docs`` yet; other names may be anything.
    """
    place = docs.columns.index(text_col)
    # Columns go by their places, so that no name can trouble the Arrow step.
    found = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("spans", F.array().cast(SPAN))
    for block in _blocks(benchmark, item_col, item_text):
        index = Index(block)

        def scan(batches: Iterator[pa.RecordBatch], index: Index = index, place: int = place) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in _portions(b, place):
                    got = index.search(part.column(place).to_pylist())
                    old = part.column(part.num_columns - 1).to_pylist()
                    new = [[*(tuple(x.values()) for x in o), *n] for o, n in zip(old, got, strict=True)]
                    rows = pa.array([[dict(zip(("item_id", "first_word", "words", "agree"), x, strict=True)) for x in n] for n in new], _SPAN)
                    yield pa.record_batch([*part.columns[:-1], rows], part.schema.names)

        found = found.mapInArrow(scan, found.schema)
    return found.toDF(*docs.columns, out)


def _portions(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """Slices of some WORDS words each (a longer text is one of its own)."""
    sizes = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(place)], np.int64) // 6
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > WORDS:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if len(sizes) > begin:
        yield batch.slice(begin)


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, contaminated, item_ids, spans."""
    out = contamination(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, out="spans")
    return out.select("doc_id", (F.size("spans") > 0).alias("contaminated"), F.array_sort(F.col("spans.item_id")).alias("item_ids"), "spans")
