"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints of 64 bits link when they differ in at most four. Every bit position gets a non-zero vector of five bits; for each of the 31 non-zero
vectors v, a mask keeps the positions whose vector has an odd product with v. The (at most) four positions in which two linked
fingerprints differ span at most four dimensions, so some v is orthogonal to all of them, and under that mask the two are equal:
every linked pair meets in a table, without exception. About half of the bits are kept, so others rarely meet.

Rows with one fingerprint are one vertex from the start. Vertices that share a bucket are compared in numpy, streaming over sorted partitions; a
bucket yields a forest of links, never all its pairs. In a bucket of over BLOCK vertices all are first compared with the smallest one; only if that leaves several
components, the bucket is cut into blocks, and every two of its blocks are compared as a task's group of its own, so that no task gathers a bucket and no pair is left out.

Joins of tables that grow with the corpus are marked as merge joins: Spark takes the 31 keys of each row for one row, and packed Parquet for its rows, and would build them on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..shared import fresh, parked

RADIUS = 4
SHINGLE = 4
SEED = 42
BLOCK = 512
CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash of the four-word shingles, repeats included; 0 for no words or null."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and exactly \x20 \x09-\x0D
    n = len(words)
    if not n:
        return 0
    if n < SHINGLE:
        return _majority(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64))
    whole, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends[SHINGLE - 1 :].tolist()
    return _majority(np.array([hashed(whole[i:j], SEED) for i, j in zip(starts, stops, strict=False)], np.uint64))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
        yield pa.record_batch([b.column(0), pa.array(marks.view(np.int64))], ["id", "fp"])


def _row_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks = np.fromiter((fingerprint(x.as_py()) for x in b.column(2)), np.uint64, b.num_rows)
        yield pa.record_batch([b.column(0), b.column(1), pa.array(marks.view(np.int64))], ["id", "row", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row; fp holds the 64 bits as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_fingerprints, "id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2 ** (radius + 1) - 1 masks; any two words that differ in at most ``radius`` bits are equal under one of them."""
    top = 2 ** (radius + 1) - 1
    vectors = [i % top + 1 for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(marks: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Pairs (root, member) that connect what links of at most ``radius`` bits connect within ``marks``. Each vertex is compared with those not yet reached, so that a dense group takes little more than one pass."""
    out: list[tuple[int, int]] = []
    left = marks
    while len(left) > 1:
        root, left = left[0], left[1:]
        edge = [root]
        while edge and len(left):
            near = np.bitwise_count(left ^ edge.pop()) <= radius
            if near.any():
                got = left[near]
                left = left[~near]
                edge.extend(got)
                out.extend((int(root), int(x)) for x in got)
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by group: links within each group. The last group of a batch waits for the next."""
    rest: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.uint64)]

    def linked(groups: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(groups)) + 1
        starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(groups)]))
        twos = starts[stops - starts == 2]
        a, b = marks[twos], marks[twos + 1]
        near = np.bitwise_count(a ^ b) <= RADIUS
        more = [x for i, j in zip(starts[stops - starts > 2].tolist(), stops[stops - starts > 2].tolist(), strict=True) for x in forest(np.unique(marks[i:j]))]
        rest = np.array(more, np.uint64).reshape(-1, 2)
        src, dst = np.concatenate((a[near], rest[:, 0])), np.concatenate((b[near], rest[:, 1]))
        return pa.record_batch([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], ["src", "dst"])

    for batch in batches:
        groups, marks = (np.concatenate((r, batch.column(i).to_numpy().view(r.dtype))) for i, r in enumerate(rest))
        if not len(groups):
            continue
        last = np.flatnonzero(groups != groups[-1])
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield linked(groups[:cut], marks[:cut])
        rest = [groups[cut:], marks[cut:]]
    if len(rest[0]):
        yield linked(*rest)


def links(nodes: DataFrame) -> DataFrame:
    """Links (src, dst) that connect the distinct fingerprints ``fp`` of ``nodes``."""
    tables = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(covering_masks())])
    keys = nodes.select("fp", F.explode(tables).alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("pivot")).where("n > 1")
    met = parked(keys.join(shared.hint("merge"), "bucket"), "met")
    large = met.where(F.col("n") > BLOCK)
    star = parked(large.where((F.col("fp") != F.col("pivot")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= RADIUS)).select(F.col("pivot").alias("src"), F.col("fp").alias("dst")).distinct(), "star")
    roots = parked(connected_components(star).withColumnRenamed("node", "fp"), "pivots")
    several = large.join(roots.hint("merge"), "fp", "left").groupBy("bucket").agg(F.min(F.coalesce("root", "fp")).alias("lo"), F.max(F.coalesce("root", "fp")).alias("hi")).where("lo != hi").select("bucket")
    rest = met.where(F.col("n") <= BLOCK).unionAll(large.join(several, "bucket", "left_semi").select(*met.columns))
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    pairs = rest.select("fp", "bucket", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    pairs = pairs.withColumn("other", F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.lit(0).cast("long")))))
    group = F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
    within = pairs.select(group.alias("grp"), "fp").repartition("grp").sortWithinPartitions("grp", "fp").mapInArrow(_links, "src long, dst long")
    return within.unionAll(star)


def _rooted(nodes: DataFrame) -> DataFrame:
    """(fp, root) of the distinct fingerprints ``fp`` of ``nodes``."""
    found = parked(connected_components(links(nodes)).withColumnRenamed("node", "fp"), "roots")
    return nodes.join(found.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, with all its columns: the row with the smallest id, null last.

    Rows that repeat an id, and rows without one, take part like all others; of rows of a group with the same id the one with the smallest hash of all its columns stays, and of rows
    equal in all columns one. Null and empty texts are one group. Columns that cannot be hashed (maps) do not tell rows apart. An empty table gives no rows.
    """
    whole = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    r = fresh(docs.columns, "r")
    q = fresh([*docs.columns, r], "q")
    wide = docs.withColumns({r: F.xxhash64(*whole), q: F.xxhash64(F.lit("second"), *whole)})
    named = wide.select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(r).alias("r"), F.col(q).alias("q")).alias("row"), F.col(text_col).cast("binary").alias("text"))
    marks = parked(named.mapInArrow(_row_fingerprints, "id long, row struct<r: bigint, q: bigint>, fp long"), "fingerprints")
    rooted = parked(_rooted(parked(marks.select("fp").distinct(), "nodes")), "rooted")
    best = marks.join(rooted.hint("merge"), "fp").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
    kept = parked(best.select(F.col("best.row.r").alias(r), F.col("best.row.q").alias(q)), "kept")
    return wide.join(kept.hint("merge"), [r, q], "left_semi").dropDuplicates([r, q]).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null id take part and have the component of their fingerprint, but
    never name one (a component of nulls only has a null id). Rows that repeat an id stay apart, in the components of their
    fingerprints. Other columns are not read. An empty table gives no rows.
    """
    marks = parked(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = parked(marks.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    rooted = parked(_rooted(nodes).select("fp", "low", "root"), "rooted")
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = parked(rooted.join(parked(least, "least").hint("merge"), "root").select("fp", "component_id"), "named")
    return marks.join(named.hint("merge"), "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
