"""Whole audits over the page table, and the rows that the checks and operators of one site need, as fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, robots, rollup
from ..operators.answers import answer_matrix
from ..shared import parked
from ..sources.tables import table
from .checks import tables as X
from .checks.evaluate import audit
from .checks.joins import redirect_checks, sitemap_checks, transport_checks
from .checks.tables import sites_of

c = F.col


def _sites(spark: SparkSession, folder: str) -> X.Sites:
    return sites_of(spark, table(spark, folder, "pages"))


def audit_results(spark: SparkSession, folder: str) -> DataFrame:
    """All checks over all hosts."""
    return audit(_sites(spark, folder)).select("site_id", "id", "family", "evidence", "status", "points", "max_points", "detail")


def audit_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.site_scores(rollup.family_scores(parked(audit(_sites(spark, folder)), "results")))


def dom_links(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edges(_sites(spark, folder).pages)


def dom_pagerank(spark: SparkSession, folder: str) -> DataFrame:
    s = _sites(spark, folder)
    return graph.pagerank(s.pages, parked(graph.edges(s.pages), "edges")).withColumn("rank", F.round("rank", 6))


def dom_depth(spark: SparkSession, folder: str) -> DataFrame:
    s = _sites(spark, folder)
    return graph.click_depth(s.pages, parked(graph.edges(s.pages), "edges"))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    return answer_matrix(_sites(spark, folder).pages)


# --- fixtures: the same rows in Spark and as VALUES in SQL -------------------------------------------------------------------

_ROBOTS = [("gptbot", True, "/"), ("gptbot", True, "/a"), ("gptbot", False, "/private"), ("*", False, "/"), ("*", True, "/a$"), ("*", False, "/b*c"), ("*", True, "/b"), ("*", True, "/bxc")]
_ASKED = [("GPTBot", "/"), ("GPTBot", "/private/x"), ("GPTBot", "/zz"), ("Bingbot", "/"), ("Bingbot", "/a"), ("Bingbot", "/ab"), ("Bingbot", "/bxc"), ("Bingbot", "/b"), ("Bingbot", "/byyc1")]
_MAPS = [("s1", 0, "https://s1/a", "2024-01-01"), ("s1", 1, "https://s1/b", "2024-02-01"), ("s2", 0, "https://s2/a", "soon"), ("s3", 0, "https://s3/a", "2999-01-01"), ("s4", 0, "https://s4/a", "2024-01-01"), ("s4", 1, "https://s4/b", None), ("s4", 2, "https://s4/c", None)]
_HOPS = [("s1", "p1", 0, 301), ("s1", "p1", 1, 200), ("s1", "p2", 0, 302), ("s1", "p2", 1, 200), ("s2", "p1", 0, 301), ("s2", "p1", 1, 301), ("s2", "p1", 2, 200), ("s3", "p1", 0, 200), ("s4", "p1", 0, 301)]
_PSI = [("s1", 2500.0, 0.1, 200.0, 0.9, 199.0), ("s2", 2501.0, 0.25, 500.0, 0.5, 600.0), ("s3", 4001.0, 0.26, 501.0, 0.49, 601.0), ("s4", None, None, None, None, None)]


def _status(severity: str = "severity") -> Column:
    return F.when(F.max(severity) == 0, "pass").when(F.max(severity) == 1, "warn").otherwise("fail")


def _rolled(found: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    return found.where(c("id").isin(*ids) & c("severity").isNotNull()).groupBy("site_id", "id").agg(_status().alias("status"))


def _no_pages(spark: SparkSession, **given: DataFrame) -> X.Sites:
    pages = spark.createDataFrame([], X.PAGES)
    return X.Sites(X.featured(pages), as_of="2025-01-01T00:00:00Z", **given)


def robots_longest_match(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame([("s", a, i, allow, p) for i, (a, allow, p) in enumerate(_ROBOTS)], "site_id string, agent string, ord int, allow boolean, pattern string")
    return robots.blocked(rules, spark.createDataFrame([("s", a, p) for a, p in _ASKED], "site_id string, agent string, path string")).select("agent", "path", "blocked")


def sitemap_lastmod(spark: SparkSession, folder: str) -> DataFrame:
    s = _no_pages(spark, sitemap=spark.createDataFrame(_MAPS, X.SITEMAP))
    found = next(f for f in sitemap_checks(s) if f.where("id = 'sitemap-lastmod'").limit(1).count())
    return _rolled(found, ("sitemap-lastmod",)).drop("id")


def redirect_chains(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(s, ch, h, f"https://{s}/{h}", st, None) for s, ch, h, st in _HOPS], X.HOPS)
    return _rolled(redirect_checks(_no_pages(spark, hops=rows))[0], ("redirect-chains",)).drop("id")


def cwv_grades(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(s, "mobile", a, b, i, None, None, p, None, None, None, t, None) for s, a, b, i, p, t in _PSI], X.PSI)
    ids = ("cwv-lcp", "cwv-cls", "cwv-inp", "lighthouse-perf", "lab-tbt")
    every = None
    for f in transport_checks(_no_pages(spark, psi=rows)):
        every = f if every is None else every.unionAll(f)
    return _rolled(every, ids)


QUERIES = {f.__name__: f for f in (audit_results, audit_scores, dom_links, dom_pagerank, dom_depth, answers, robots_longest_match, sitemap_lastmod, redirect_chains, cwv_grades)}


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else "true" if x is True else "false" if x is False else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_WORST = "CASE max(v) WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' ELSE 'fail' END"
ORACLE_SQL = {
    "robots_longest_match": rf"""
        WITH r AS (SELECT * FROM (VALUES {_values(_ROBOTS)}) AS t(agent, allow, pattern)), q AS (SELECT * FROM (VALUES {_values(_ASKED)}) AS t(agent, path)),
        g AS (SELECT q.*, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.agent = lower(q.agent)) THEN lower(q.agent) ELSE '*' END AS grp FROM q),
        m AS (SELECT g.agent, g.path, allow, row_number() OVER (PARTITION BY g.agent, g.path ORDER BY length(pattern) DESC, allow DESC) AS k FROM g JOIN r ON r.agent = grp
              AND regexp_matches(g.path, '^' || replace(CASE WHEN pattern LIKE '%$' THEN pattern[:-2] ELSE pattern END, '*', '.*') || CASE WHEN pattern LIKE '%$' THEN '$' ELSE '' END))
        SELECT q.agent, q.path, NOT coalesce(allow, true) AS blocked FROM q LEFT JOIN m ON m.agent = q.agent AND m.path = q.path AND k = 1""",
    "sitemap_lastmod": f"""
        WITH m AS (SELECT site_id, try_cast(lastmod AS DATE) AS d FROM (VALUES {_values(_MAPS)}) AS t(site_id, pos, loc, lastmod)),
        s AS (SELECT site_id, count(*) AS n, count(d) AS ok, count_if(d > DATE '2025-01-01') AS f, count(DISTINCT d) AS kinds FROM m GROUP BY 1)
        SELECT site_id, CASE WHEN ok = 0 OR f = ok THEN 'fail' WHEN ok / n >= 0.5 AND kinds > 1 AND f = 0 THEN 'pass' ELSE 'warn' END AS status FROM s""",
    "redirect_chains": f"""
        WITH h AS (SELECT * FROM (VALUES {_values(_HOPS)}) AS t(site_id, chain, hop, status)),
        s AS (SELECT site_id, chain, count_if(status BETWEEN 300 AND 399) AS moves, arg_max(status, hop) AS last, arg_min(status, hop) AS first FROM h GROUP BY 1, 2),
        v AS (SELECT site_id, CASE WHEN moves > 1 OR last BETWEEN 300 AND 399 THEN 2 WHEN moves = 1 AND first NOT IN (301, 308) THEN 1 ELSE 0 END AS v FROM s)
        SELECT site_id, {_WORST} AS status FROM v GROUP BY 1""",
    "cwv_grades": f"""
        WITH p AS (SELECT * FROM (VALUES {_values(_PSI)}) AS t(site_id, lcp, cls, inp, perf, tbt)),
        v AS (
            SELECT site_id, 'cwv-lcp' AS id, CASE WHEN lcp <= 2500 THEN 0 WHEN lcp <= 4000 THEN 1 ELSE 2 END AS v FROM p WHERE lcp IS NOT NULL
            UNION ALL SELECT site_id, 'cwv-cls', CASE WHEN cls <= 0.1 THEN 0 WHEN cls <= 0.25 THEN 1 ELSE 2 END FROM p WHERE cls IS NOT NULL
            UNION ALL SELECT site_id, 'cwv-inp', CASE WHEN inp <= 200 THEN 0 WHEN inp <= 500 THEN 1 ELSE 2 END FROM p WHERE inp IS NOT NULL
            UNION ALL SELECT site_id, 'lighthouse-perf', CASE WHEN perf >= 0.9 THEN 0 WHEN perf >= 0.5 THEN 1 ELSE 2 END FROM p WHERE perf IS NOT NULL
            UNION ALL SELECT site_id, 'lab-tbt', CASE WHEN tbt < 200 THEN 0 WHEN tbt <= 600 THEN 1 ELSE 2 END FROM p WHERE tbt IS NOT NULL
        )
        SELECT site_id, id, {_WORST} AS status FROM v GROUP BY 1, 2""",
}
