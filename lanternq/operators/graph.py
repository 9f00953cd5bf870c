"""Link graphs of sites: edges, in-degree, click depth, PageRank. Every step is partitioned by site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..shared import parked

DAMPING, ITERATIONS = 0.85, 50


def edges(pages: DataFrame) -> DataFrame:
    """(site_id, src, dst): distinct same-host content links of featured pages, without self-links."""
    link = pages.select("site_id", "host", F.col("url").alias("src"), F.explode("links").alias("l")).select("site_id", "host", "src", F.col("l.url").alias("dst"))
    same = (urls.host(F.col("dst")) == F.col("host")) & urls.is_content_path(urls.path(F.col("dst"))) & (F.col("dst") != F.col("src"))
    return link.where(same).select("site_id", "src", "dst").distinct()


def in_degree(links: DataFrame) -> DataFrame:
    """(site_id, node, n): pages that link to each target, sampled or not."""
    return links.groupBy("site_id", F.col("dst").alias("node")).agg(F.count("*").alias("n"))


def click_depth(pages: DataFrame, links: DataFrame, most: int = 64) -> DataFrame:
    """(site_id, node, depth) from the home page over sampled pages; null where it cannot be reached within ``most`` clicks.

    Breadth first: each round joins the frontier with the links and drops what has been seen, so that a round's rows are new pages only.
    """
    nodes = pages.select("site_id", F.col("url").alias("node"))
    seen = parked(pages.where("is_home").select("site_id", F.col("url").alias("node"), F.lit(0).alias("depth")), "depth")
    front = seen
    inner = links.join(nodes.select("site_id", F.col("node").alias("dst")), ["site_id", "dst"])
    for d in range(1, most):
        step = front.join(inner, (front.site_id == inner.site_id) & (front.node == inner.src)).select(inner.site_id, F.col("dst").alias("node")).distinct().join(seen, ["site_id", "node"], "left_anti")
        front = parked(step.withColumn("depth", F.lit(d)), "front")
        if front.isEmpty():
            break
        seen = parked(seen.unionAll(front), "depth")
    return nodes.join(seen, ["site_id", "node"], "left")


def pagerank(pages: DataFrame, links: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, cut_every: int = 10) -> DataFrame:
    """(site_id, node, rank) over pages and their targets; the mass of nodes without links is spread evenly over their site.

    Each node carries its targets (the links of one page), so that a round reads the ranks once: every node hands its share to its targets and a
    row to itself, and one aggregation collects them. The plan grows by a constant for each round, and lineage is cut every ``cut_every`` rounds.
    """
    nodes = pages.select("site_id", F.col("url").alias("node")).unionAll(links.select("site_id", "src")).unionAll(links.select("site_id", "dst")).distinct()
    targets = links.where("src <> dst").groupBy("site_id", F.col("src").alias("node")).agg(F.collect_set("dst").alias("to"))
    site = Window.partitionBy("site_id")
    state = nodes.join(targets, ["site_id", "node"], "left").withColumn("size", F.count("*").over(site)).withColumn("rank", 1.0 / F.col("size"))
    state = parked(state.select("site_id", "node", F.coalesce("to", F.array().cast("array<string>")).alias("to"), "size", "rank"), "rank")
    for i in range(1, iterations + 1):
        own = F.array(F.struct("node", "to", "size", F.lit(0.0).alias("given"), F.when(F.size("to") == 0, F.col("rank")).otherwise(0.0).alias("lost")))
        out = F.transform("to", lambda d: F.struct(d.alias("node"), F.lit(None).cast("array<string>").alias("to"), F.lit(None).cast("bigint").alias("size"), F.try_divide("rank", F.size("to")).alias("given"), F.lit(0.0).alias("lost")))
        sent = state.select("site_id", F.explode(F.concat(own, out)).alias("m")).select("site_id", "m.*")
        got = sent.groupBy("site_id", "node").agg(F.first("to", ignorenulls=True).alias("to"), F.max("size").alias("size"), F.sum("given").alias("given"), F.sum("lost").alias("lost"))
        now = (1 - damping) / F.col("size") + damping * (F.col("given") + F.sum("lost").over(site) / F.col("size"))
        state = got.select("site_id", "node", "to", "size", now.alias("rank"))
        if i % cut_every == 0 or i == iterations:
            state = parked(state, "rank")
    return state.select("site_id", "node", "rank")
