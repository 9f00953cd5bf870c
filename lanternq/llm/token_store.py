"""Token ids as binary shards with a minimal perfect hash index.

Documents are range-partitioned and sorted by id, encoded, and written through Spark's own committed writer, so that a lost
executor's task is simply run again and the store may lie in any file system. The file format is a Parquet data set of shards of about SHARD_BYTES:

==========  ==========================================================================================
part shard  place of the shard; (part, shard) ascends with the document id
first last  smallest and largest id (row groups are skipped by them when single ids are looked up)
keys counts ids of the shard's documents in order (null ids come last), and how many token ids each one has
ids width   token ids in the shard, and bytes of one (2 if the vocabulary is below 65536, else 4)
index       minimal perfect hash of the distinct keys: key -> slot
marks       32-bit fingerprint of the key in each slot
offsets     place of the key's first token id within the payload, for each slot
payload     the raw token ids, little-endian
==========  ==========================================================================================

A key is found by its shard's range, then in constant time: slot, fingerprint, offset.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import new_path
from .perfect_hash import PerfectHash, fingerprint

SHARD_BYTES = 4 << 20
END_ID = 1
#: Words with their ids, and stems with theirs (two generations), kept in each Python worker.
CACHE_WORDS, CACHE_STEMS = 450_000, 250_000
#: Stems that are encoded as one string, and documents whose words are looked up together.
JOINED, TOGETHER = 64, 128
#: A word of letters below U+0250 and these marks is a stem and one run of marks: the tokenizer lower-cases it and never merges across the two.
MARKS = ".,!?;:"
SCHEMA = "part int, shard int, first long, last long, keys array<long>, counts array<long>, ids long, width int, index binary, marks binary, offsets binary, payload binary"
_ARROW = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ids", pa.int64()), ("width", pa.int32())]
    + [(x, pa.binary()) for x in ("index", "marks", "offsets", "payload")]
)


class Encoder:
    """A tokenizer file whose texts split into independent pieces at ASCII white space, with bounded caches of pieces.

    Such a tokenizer (lower case, white space dropped, merges within runs of letters only) gives a text the ids of its pieces in
    order. Every piece is encoded by the library, once as long as it stays in a cache; stems that recur survive when the cache turns over.
    """

    def __init__(self, path: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece on its own."""
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encoded_stems(self, stems: list[str]) -> list[bytes]:
        """As ``encoded``, for pieces of one merge run each: many go into one string, and the ids that end a run part them again."""
        out: list[bytes] = []
        groups = [stems[i : i + JOINED] for i in range(0, len(stems), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            cuts = ((np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(cuts) == len(group):
                data = ids.tobytes()
                out.extend(data[a:b] for a, b in zip([0, *cuts], cuts, strict=False))
            else:  # the vocabulary has no marks for ends
                out.extend(self.encoded(group))
        return out

    def learn(self, fresh: list[str]) -> None:
        """Fills ``words`` for words that it does not hold."""
        stems, old, words = self.stems, self.old, self.words
        parts: list[tuple[str, str, str]] = []
        unknown, odd = set(), []
        for w in fresh:
            stem = w.rstrip(MARKS)
            if stem.isalpha() and max(stem) < "\u0250":
                low, rest = stem.lower(), w[len(stem) :]
                parts.append((w, low, rest))
                for x in (low, rest) if rest else (low,):
                    if x not in stems:
                        if x in old:
                            stems[x] = old[x]
                        else:
                            unknown.add(x)
            else:
                odd.append(w)
        order = list(unknown)
        stems.update(zip(order, self.encoded_stems(order), strict=True))
        for w, low, rest in parts:
            words[w] = stems[low] + stems[rest] if rest else stems[low]
        words.update(zip(odd, self.encoded(odd), strict=True))
        if len(stems) > CACHE_STEMS:
            self.old, self.stems = stems, {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self.words
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        fresh = set().union(*split).difference(known)
        if len(known) + len(fresh) > CACHE_WORDS:
            known.clear()
            fresh = set().union(*split)
        self.learn(list(fresh))
        return [b"".join([known[w] for w in words]) for words in split]


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, dtype: str) -> Encoder:
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = Encoder(path, dtype)
    return _encoders[path, dtype]


def _shard(part: int, shard: int, keys: list[int | None], parts: list[bytes], width: int) -> dict:
    counts = np.array([len(x) // width for x in parts], np.int64)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    known = np.array([k for k in keys if k is not None], np.int64)
    distinct, at = np.unique(known, return_index=True)
    places = np.flatnonzero([k is not None for k in keys])[at] if len(known) else at
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    marks, offsets = np.zeros(index.size, np.uint32), np.zeros(index.size, np.uint64)
    marks[slots], offsets[slots] = fingerprint(distinct), starts[places]
    return {
        "part": part, "shard": shard, "first": int(distinct[0]) if len(distinct) else None, "last": int(distinct[-1]) if len(distinct) else None, "keys": keys, "counts": counts.tolist(),
        "ids": int(counts.sum()), "width": width, "index": index.to_bytes(), "marks": marks.astype("<u4").tobytes(), "offsets": offsets.astype("<u8").tobytes(), "payload": b"".join(parts),
    }


def _writer(path: str, width: int, end_id: int, shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(path, f"<u{width}"), np.array([end_id], f"<u{width}").tobytes()
        part, shard, keys, parts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(i, TOGETHER)
                for key, ids in zip(some.column(0).to_pylist(), encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    keys.append(key)
                    parts.append(ids + end)
                    size += len(parts[-1])
                    if size >= shard_bytes:
                        yield pa.RecordBatch.from_pylist([_shard(part, shard, keys, parts, width)], _ARROW)
                        shard, keys, parts, size = shard + 1, [], [], 0
        if keys:
            yield pa.RecordBatch.from_pylist([_shard(part, shard, keys, parts, width)], _ARROW)

    return write


def vocabulary_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def write_store(docs: DataFrame, store: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes every whole text and writes the store in ascending order of id (repeated ids: then of a hash of the text; null ids last).

    Null and empty texts have the end id alone. ``tokenizer`` is a path that the executors can read too. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # The hash splits an id that very many rows repeat.
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = ranged.mapInArrow(_writer(tokenizer, vocabulary_width(tokenizer), end_id, shard_bytes), SCHEMA)
    shards.write.option("parquet.block.size", 8 * shard_bytes).parquet(store)


def _lookup(index: bytes, marks: bytes, offsets: bytes, keys: np.ndarray) -> np.ndarray:
    """First offset of each key in the shard; -1 for keys that it does not hold."""
    found = PerfectHash.from_bytes(index)
    if not found.size or not len(keys):
        return np.full(len(keys), -1, np.int64)
    slots = found.slots(keys)
    own = (slots >= 0) & (np.frombuffer(marks, "<u4")[slots] == fingerprint(keys.astype(np.int64)))
    return np.where(own, np.frombuffer(offsets, "<u8")[slots].astype(np.int64), -1)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            keys, counts = row["keys"].values, row["counts"].values.to_numpy()
            ids = np.frombuffer(row["payload"].as_buffer(), f"<u{row['width'].as_py()}")
            sequence = np.concatenate(([0], np.cumsum(counts)[:-1]))
            known = np.flatnonzero(keys.is_valid().to_numpy(zero_copy_only=False))
            values = keys.to_numpy(zero_copy_only=False)[known].astype(np.int64)
            starts = sequence.copy()
            if len(known):  # by the index; a repeated key's later rows follow its first
                new = np.concatenate(([True], values[1:] != values[:-1]))
                run = np.cumsum(new) - 1
                first = _lookup(row["index"].as_py(), row["marks"].as_py(), row["offsets"].as_py(), values[new])
                if (first < 0).any():
                    raise ValueError("a key is missing from its shard's index")
                starts[known] = first[run] + sequence[known] - sequence[known][new][run]
            sums = [zlib.crc32(ids[s : s + n].astype("<u4").tobytes()) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
            n = len(counts)
            yield pa.record_batch([pa.array([row["part"].as_py()] * n, pa.int32()), pa.array([row["shard"].as_py()] * n, pa.int32()), keys, pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["part", "shard", "doc_id", "offset", "n_tokens", "ids_crc32"])


def shard_starts(store: DataFrame) -> DataFrame:
    """(part, shard, base): token ids in all shards before. Sums by part first; there are no more parts than partitions were written."""
    sizes = store.select("part", "shard", "ids")
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("within", within).join(parts.select("part", before.alias("before")), "part").select("part", "shard", (F.col("before") + F.col("within")).alias("base"))


def read_documents(spark: SparkSession, store: str) -> DataFrame:
    """From the files: doc_id, start (token ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    shards = spark.read.parquet(store)
    rows = shards.select("part", "shard", "width", "keys", "counts", "index", "marks", "offsets", "payload").mapInArrow(_read, "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(shards), ["part", "shard"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def get(spark: SparkSession, store: str, key: int) -> list[list[int]]:
    """Token ids of the documents with one id, by the index; [] if there are none. Row groups of other ranges are not read."""
    out = []
    for row in spark.read.parquet(store).where((F.col("first") <= key) & (F.col("last") >= key)).orderBy("part", "shard").toLocalIterator():
        at = int(_lookup(row["index"], row["marks"], row["offsets"], np.array([key]))[0])
        if at >= 0:
            ids, begins = np.frombuffer(row["payload"], f"<u{row['width']}"), np.cumsum([0, *row["counts"]])
            for i in range(int(np.searchsorted(begins, at)), len(row["keys"])):
                if row["keys"][i] != key:
                    break
                out.append(ids[begins[i] : begins[i + 1]].tolist())
    return out


def token_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", store: str | None = None) -> DataFrame:
    """Writes the store (a new folder in the shared one unless given) and returns ``read_documents`` of it. An empty table gives no rows."""
    store = store or new_path(docs.sparkSession, "tokens")
    write_store(docs, store, tokenizer, id_col, text_col)
    return read_documents(docs.sparkSession, store)
