"""Pairs of similar sets by prefix filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Allowance for rounding; what it lets in too much is dropped by the exact comparison.
_SLACK = 1e-6


def similar_sets(rows: DataFrame, group: str, key: str, values: str, threshold: float) -> DataFrame:
    """(group, a, b, jaccard) for rows of a group, a < b by ``key``, whose arrays of distinct ``values`` have a Jaccard similarity of at least ``threshold``.

    Values of a group are ordered from the rarest to the most frequent. Two sets of that similarity share one of the first n - ceil(threshold * n) + 1 values of each, n being a set's
    size, so only those are joined: what many rows have in common is nearly never among them. Candidates are compared in full. Empty sets are similar to nothing; ``key`` names a row within its group.
    """
    sets = rows.select(F.col(group).alias("g"), F.col(key).alias("id"), F.col(values).alias("v"))
    item = sets.select("g", "id", F.size("v").alias("n"), F.explode("v").alias("x"))
    often = item.groupBy("g", "x").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("g", "id").orderBy("often", "x"))
    early = item.join(often, ["g", "x"]).withColumn("place", place).where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * (threshold - _SLACK)) + 1) & (F.col("often") > 1))
    a = early.select("g", "x", F.col("id").alias("a"), F.col("n").alias("na"))
    b = early.select("g", "x", F.col("id").alias("b"), F.col("n").alias("nb"))
    sized = F.least("na", "nb") >= F.greatest("na", "nb") * (threshold - _SLACK)
    met = a.join(b, ["g", "x"]).where((F.col("a") < F.col("b")) & sized).select("g", "a", "b").distinct()
    side = lambda k: sets.select("g", F.col("id").alias(k), F.col("v").alias(f"v{k}"))
    wide = met.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"]).withColumn("both", F.size(F.array_intersect("va", "vb")))
    jaccard = F.col("both") / (F.size("va") + F.size("vb") - F.col("both"))
    return wide.select(F.col("g").alias(group), "a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold - _SLACK)
