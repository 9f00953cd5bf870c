"""An audit: all checks over all sites at once.

Rules over one page are columns of one pass (an array of severities, exploded and aggregated once), so the plan does not grow by a branch
for each check. Only checks that join other rows are branches of a union.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import text as T
from ...functions import urls
from ...operators import chunker, rollup
from ...shared import parked
from . import joins, rules
from .catalog import catalog
from .tables import RESOURCES, Sites

#: Structs of a site's well-known files, by path.
FILES = {
    "robots": "/robots.txt", "llms": "/llms.txt", "llms_full": "/llms-full.txt", "ai_json": "/.well-known/ai.json", "security_txt": "/.well-known/security.txt",
    "agents_json": "/.well-known/agents.json", "agent_json": "/.well-known/agent.json", "ucp_json": "/.well-known/ucp",
}
FEEDS = ("/feed", "/feed.xml", "/rss.xml", "/atom.xml", "/index.xml", "/feed.json")
#: Families whose checks fail on a site without pages; others skip.
FAIL_WITHOUT_PAGES = ("technical-seo", "on-page", "performance", "accessibility")


def brand_tokens(pages: DataFrame) -> DataFrame:
    """(site_id, brand): words of a final title segment that at least two pages share, and words in 80 % of at least four titles."""
    title = pages.select("site_id", F.coalesce("title", F.lit("")).alias("title")).where("title <> ''")
    parts = T.title_segments(F.col("title"))
    last = title.where(F.size(parts) >= 2).groupBy("site_id", F.lower(F.element_at(parts, -1)).alias("segment")).agg(F.count("*").alias("n")).where("n >= 2").select("site_id", F.explode(T.topic_tokens(F.col("segment"))).alias("word"))
    sizes = title.groupBy("site_id").agg(F.count("*").alias("titles"))
    common = title.select("site_id", F.explode(F.array_distinct(T.topic_tokens(F.col("title")))).alias("word")).groupBy("site_id", "word").agg(F.count("*").alias("n")).join(sizes, "site_id").where("titles >= 4 AND n >= titles * 0.8").select("site_id", "word")
    return last.unionAll(common).groupBy("site_id").agg(F.array_sort(F.collect_set("word")).alias("brand"))


def prepared(s: Sites) -> Sites:
    """``s`` with the columns that rules read besides the features of a page."""
    pages = s.pages.join(brand_tokens(s.pages), "site_id", "left")
    same = lambda x: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", F.count("*").over(Window.partitionBy("site_id", x))).otherwise(1)
    pages = pages.withColumn("description", F.col("metas")["description"]).withColumn("same_title", same(F.col("title"))).withColumn("same_description", same(F.col("description")))
    res = s.table("resources", RESOURCES)
    extra = res.groupBy("site_id").agg(F.max(F.when((F.col("path") == "/robots.txt") & (F.col("status") == 200), F.col("body"))).alias("robots_body"), F.bool_or((F.col("path") == "/favicon.ico") & (F.col("status") == 200)).alias("has_favicon"))
    return Sites(**(s.__dict__ | {"pages": parked(pages.join(extra, "site_id", "left"), "prepared")}))


def _spread(rows: DataFrame, found: dict[str, tuple[str, Column]], seq: str, label: str) -> DataFrame:
    """Findings of several rules over the same rows."""
    items = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(r).alias("rollup"), v.cast("int").alias("severity")) for k, (r, v) in found.items()])
    return rows.select("site_id", F.expr(seq).cast("int").alias("seq"), F.expr(label).cast("string").alias("label"), F.explode(F.filter(items, lambda x: x["severity"].isNotNull())).alias("f")).select("site_id", "f.id", "f.rollup", "seq", "label", "f.severity")


def findings(s: Sites) -> DataFrame:
    """(site_id, id, rollup, seq, label, severity) of all checks."""
    page = _spread(s.pages, rules.page_rules(s.as_of), "seq", "path")
    home = _spread(s.pages.where("is_home"), {k: ("sev", v) for k, v in rules.home_rules(s.as_of).items()}, "seq", "path")
    judged = s.pages.select("site_id", "seq", "path", F.explode("sd").alias("id", "severity")).where(F.col("id").isin(*rules.GRAPH_RULES))
    kinds = F.create_map(*[F.lit(x) for kv in rules.GRAPH_RULES.items() for x in kv])
    graph = judged.select("site_id", "id", kinds[F.col("id")].alias("rollup"), "seq", F.col("path").alias("label"), "severity")
    totals = s.pages.groupBy("site_id").agg(*[F.expr(e).alias(k) for k, e in rules.TOTALS.items()])
    total = _spread(totals, {k: ("sev", v) for k, v in rules.total_rules().items()}, "0", "'site'")
    windows = s.pages.where("main_words >= 300").select("site_id", "seq", "path", "blocks")
    kept = chunker.chunks(windows).groupBy("site_id", "seq", "path").agg(F.avg(F.col("survives").cast("int")).alias("share"))
    retrieval = joins.finding(kept, "chunk-retrieval-sim", "warn", F.when(F.col("share") < 0.7, 1).otherwise(0))
    own = s.pages.select("site_id", "seq", F.lit(-1).alias("pos"), "url")
    linked = joins.links_of(s).where("internal").select("site_id", "seq", "pos", "url")
    each = own.unionAll(linked).groupBy("site_id", "url").agg(F.min(F.struct("seq", "pos")).alias("at")).withColumn("issues", urls.url_issues(F.col("url")))
    spoken = F.when(F.size("issues") > 0, F.concat(urls.path(F.col("url")), F.lit(" ("), F.col("issues")[0], F.lit(")"))).otherwise(urls.path(F.col("url")))
    structure = joins.finding(each.select("site_id", F.col("at.seq").alias("seq"), spoken.alias("path"), "issues"), "url-structure", "agg", F.when(F.size("issues") > 0, 2).otherwise(0))
    out = [page, home, graph, total, retrieval, structure]
    if s.resources is not None:
        r = s.resources
        file = lambda cond: F.max(F.when(cond, F.struct(F.col("status"), F.lower("content_type").alias("type"), F.col("body"), F.regexp_extract("final_url", r"^https?://[^/?#]*([^?#]*)", 1).alias("final_path"))))
        files = r.groupBy("site_id").agg(
            *[file(F.col("path") == p).alias(k) for k, p in FILES.items()], file(F.col("path").startswith("/missing-")).alias("missing_page"), file(F.col("path").rlike(r"^/[0-9a-f]{8,128}\.txt$")).alias("indexnow"),
            F.max(F.regexp_extract("path", r"^/([0-9a-f]{8,128})\.txt$", 1)).alias("key"), F.bool_or(F.col("path").isin(*FEEDS) & (F.col("status") == 200) & F.coalesce(F.col("content_type").rlike("(?i)rss|atom|xml|feed"), F.lit(False))).alias("feed_found"),
        )
        feeds = s.pages.groupBy("site_id").agg(F.bool_or(F.size("feeds") > 0).alias("has_feed"))
        wide = feeds.join(files, "site_id", "left").withColumn("indexnow_key", F.nullif("key", F.lit("")))
        out.append(_spread(wide, {k: ("sev", v) for k, v in rules.site_rules(s.as_of).items()}, "0", "'site'"))
    joined = joins.findings(s)
    return reduce(DataFrame.unionAll, [*out, *([joined] if joined is not None else [])])


def audit(s: Sites, opt_in: tuple[str, ...] = (), unregistered: bool = False) -> DataFrame:
    """(site_id, ord, id, family, evidence, status, points, max_points, detail): a row for every site and registered check.

    Checks that run on request are left out unless named in ``opt_in``.
    """
    s = prepared(s)
    statuses = parked(rollup.rolled(parked(findings(s), "findings")), "statuses")
    which = F.col("registered") | F.lit(unregistered)
    checks = catalog(s.pages.sparkSession).where(which & (~F.col("opt_in") | F.col("id").isin(*opt_in) if opt_in else which & ~F.col("opt_in"))).drop("registered", "opt_in")
    sites = s.pages.groupBy("site_id").agg(F.count("*").alias("n_pages"))
    if s.resources is not None:
        sites = sites.unionAll(s.resources.select("site_id").distinct().join(sites, "site_id", "left_anti").withColumn("n_pages", F.lit(0).cast("long")))
    missing = F.when((F.col("n_pages") == 0) & F.col("family").isin(*FAIL_WITHOUT_PAGES), "fail").otherwise("skip")
    return rollup.results(sites, statuses, checks, missing)
