"""Connected components of an undirected graph by alternating stars.

Each round points every neighbour of a vertex at the smallest vertex of its neighbourhood, first the larger
neighbours (large star), then the smaller ones (small star). The rounds needed grow with the logarithm of the longest path.
A neighbourhood is never gathered: its minimum is a pre-aggregated MIN, written out, and joined back, so that a vertex with very
many edges is an ordinary skewed join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import dropped, parked

MAX_ROUNDS = 60
#: With more edges than this, joins are marked as merge joins: packed Parquet looks small enough to be built on the driver.
FEW = 100_000


def _star(pairs: DataFrame, own: str, other: str) -> DataFrame:
    """The smallest of each vertex and its neighbours, as (own, low)."""
    return pairs.groupBy(own).agg(F.min(other).alias("near")).select(own, F.least(own, "near").alias("low"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.select(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """(node, root) for every vertex of an edge; root is the smallest vertex that can be reached, itself included.

    Vertices may be of any orderable type. Edges with a null end and self-links are ignored (a vertex that has only
    self-links is not in the result), repeated edges count once, no edges give no rows.
    """
    a, b = F.col(left), F.col(right)
    now = parked(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        sized = lambda df, n=state[0]: df.hint("merge") if n > FEW else df
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        lows = parked(_star(both, "u", "v"), "lows")
        large = parked(both.join(sized(lows), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("low").alias("lo")).where("hi > lo").distinct(), "large")
        least = parked(_star(large, "hi", "lo"), "least")
        joined = large.join(sized(least), "hi")
        small = parked(
            joined.select(F.col("lo").alias("hi"), F.col("low").alias("lo")).where("hi > lo").unionAll(least.select("hi", F.col("low").alias("lo"))).distinct(),
            "small",
        )
        dropped(now, lows, large, least)
        now, before, state = small, state, _state(small)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)
