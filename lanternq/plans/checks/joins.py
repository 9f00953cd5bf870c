"""Checks that join pages with other rows: links, sitemap, robots rules, redirects, probes, other pages.

Each returns findings (site_id, id, rollup, seq, label, severity). The numbers of links, assets and URLs looked at are part of the verdicts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import text as T
from ...functions import urls as U
from ...operators import graph, robots
from ...operators.components import connected_components
from ...operators.similar import similar_sets
from ...shared import parked
from . import tables as X
from .rules import directives, sql, when

c = F.col


def finding(rows: DataFrame, check: str, rollup: str, severity: Column, label: str = "path", seq: str | None = "seq") -> DataFrame:
    return rows.select("site_id", F.lit(check).alias("id"), F.lit(rollup).alias("rollup"), (c(seq) if seq else F.lit(0)).cast("int").alias("seq"), c(label).cast("string").alias("label"), severity.cast("int").alias("severity"))


def first_n(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n distinct values of ``key`` per site."""
    once = rows.withColumn("__k", F.row_number().over(Window.partitionBy("site_id", key).orderBy(*order))).where("__k = 1")
    return once.withColumn("__k", F.row_number().over(Window.partitionBy("site_id").orderBy(*order))).where(c("__k") <= n).drop("__k")


def fetched(rows: DataFrame, url: str, resources: DataFrame) -> DataFrame:
    """Rows with status, final_url and body of the URL, if it was fetched."""
    return rows.join(resources.select("site_id", c("url").alias(url), c("status").alias("got"), "final_url", "content_type", "body", c("headers").alias("got_headers")), ["site_id", url], "left")


def links_of(s: X.Sites) -> DataFrame:
    rows = s.pages.select("site_id", "seq", "path", "url", "host", F.explode("links").alias("l")).select("site_id", "seq", "path", c("url").alias("src"), "host", "l.*")
    return rows.withColumn("to", U.canonical_identity(c("url"))).withColumn("internal", U.host(c("url")) == c("host"))


def link_checks(s: X.Sites) -> list[DataFrame]:
    out, links = [], links_of(s)
    res = s.table("resources", X.RESOURCES)
    if s.resources is not None:
        inner = first_n(links.where(c("internal") & U.is_content_path(U.path(c("url")))), "url", ["seq", "pos"], 30)
        got = fetched(inner.drop("body"), "url", res)
        out.append(finding(got, "broken-internal-links", "agg", when("got IS NULL OR got >= 400", 2, 0), "url"))
        assets = s.pages.select("site_id", "seq", "host", F.explode("assets").alias("a")).select("site_id", "seq", "host", c("a.url").alias("asset"), (c("a.kind") == "img").cast("int").alias("late"), "a.kind").where(c("kind").isin("js", "css", "img") & (U.host(c("asset")) == c("host")))
        out.append(finding(fetched(first_n(assets, "asset", ["late", "seq", "asset"], 20), "asset", res), "broken-subresources", "agg", when("got IS NULL OR got >= 400", 2, 0), "asset"))
        cached = fetched(first_n(assets.where("kind IN ('js', 'css')"), "asset", ["seq", "asset"], 1), "asset", res)
        out.append(finding(cached, "asset-caching", "sev", when(r"got_headers['cache-control'] RLIKE '(?i)max-age=[1-9]' OR got_headers['etag'] IS NOT NULL", 0, 1), "asset"))
        canon = s.pages.select("site_id", "seq", F.explode("canonicals").alias("target"))
        got = fetched(first_n(canon, "target", ["seq", "target"], 10), "target", res)
        out.append(finding(got, "canonical-resolves", "sev", when(r"got IS NULL OR got <> 200 OR body RLIKE '(?i)<meta[^>]+robots[^>]+noindex'", 2, U.canonical_identity(c("final_url")) != U.canonical_identity(c("target")), 1, 0), "target"))
        alternates = s.pages.select("site_id", "seq", c("url").alias("src"), F.explode("alternates").alias("a")).select("site_id", "seq", "src", c("a.url").alias("target"))
        got = fetched(first_n(alternates.where("target IS NOT NULL"), "target", ["seq", "target"], 5), "target", res)
        own = s.pages.select("site_id", c("url").alias("target"), F.explode("alternates").alias("b")).select("site_id", "target", U.canonical_identity(c("b.url")).alias("back")).groupBy("site_id", "target").agg(F.collect_set("back").alias("backs"))
        paired = got.join(own, ["site_id", "target"], "left")
        out.append(finding(paired, "hreflang", "any", when(sql("got = 200") & F.coalesce(F.array_contains("backs", U.canonical_identity(c("src"))), F.lit(False)), 0, 2), "target"))
    leaks = links.where(c("internal")).withColumn("leak", F.regexp_extract("rel", r"\b(nofollow|sponsored|ugc)\b", 1))
    leaks = leaks.withColumn("__k", F.row_number().over(Window.partitionBy("site_id", "to", "leak").orderBy("seq", "pos"))).where("__k = 1")
    out.append(finding(leaks, "internal-equity-leaks", "warn", when("leak <> ''", 1, 0), "url"))
    anchors = links.select("site_id", "to").distinct()
    hidden = s.pages.select("site_id", "seq", "host", F.explode("script_targets").alias("t")).select("site_id", "seq", "host", c("t.url").alias("target")).where(U.host(c("target")) == c("host"))
    hidden = hidden.withColumn("to", U.canonical_identity(c("target"))).join(anchors.withColumn("linked", F.lit(True)), ["site_id", "to"], "left")
    every = s.pages.select("site_id", "seq", c("path").alias("target"), F.lit(True).alias("linked"))
    out.append(finding(hidden.select("site_id", "seq", "target", "linked").unionAll(every), "js-only-destinations", "warn", when("linked", 0, 1), "target"))
    return out


def graph_checks(s: X.Sites) -> list[DataFrame]:
    links = parked(graph.edges(s.pages), "edges")
    pages = s.pages.select("site_id", "seq", "path", "url", "is_home").withColumn("id_", U.canonical_identity(c("url")))
    outs = links.groupBy("site_id", c("src").alias("url")).agg(F.count("*").alias("outs"))
    ins = links.select("site_id", U.canonical_identity(c("dst")).alias("id_")).distinct().withColumn("linked", F.lit(True))
    depth = graph.click_depth(s.pages, links).withColumnRenamed("node", "url")
    wide = parked(pages.join(outs, ["site_id", "url"], "left").join(ins, ["site_id", "id_"], "left").join(depth, ["site_id", "url"], "left").withColumn("n", F.count("*").over(Window.partitionBy("site_id"))), "wide")
    orphan, dead = "(linked IS NULL AND NOT is_home)", "outs IS NULL"
    linking = finding(wide.where("n > 1"), "internal-linking", "agg", when(f"{dead} OR {orphan} OR depth IS NULL OR depth > 3", 2, 0))
    equity = finding(wide.where("n >= 3"), "link-equity-map", "warn", when(f"{dead} OR {orphan}", 1, 0))
    return [linking, equity]


def robots_checks(s: X.Sites) -> list[DataFrame]:
    if s.resources is None:
        return []
    files = s.resources.where("path = '/robots.txt' AND status = 200 AND (coalesce(content_type, '') = '' OR content_type LIKE 'text/plain%')").select("site_id", "body")
    parsed = parked(robots.rules(files), "robots")
    spark = s.pages.sparkSession
    roster = spark.createDataFrame([(a, k) for k, names in (("training", robots.TRAINING), ("citation", robots.CITATION), ("search", robots.SEARCH)) for a in names], "agent string, tier string")
    asked = s.pages.select("site_id").distinct().crossJoin(F.broadcast(roster)).withColumn("path", F.lit("/"))
    got = parked(robots.blocked(parsed, asked.select("site_id", "agent", "path")).join(F.broadcast(roster), "agent").join(files.select("site_id", F.lit(True).alias("usable")), "site_id", "left"), "blocked")
    out = [
        finding(got.where("tier = 'search'"), "search-crawlers-allowed", "sev", when("usable IS NULL", 1, "blocked", 2, 0), "agent", None),
        finding(got.where("tier <> 'search'"), "ai-crawlers-allowed", "sev", when("blocked AND tier = 'citation'", 2, "blocked", 1, 0), "agent", None),
    ]
    if s.sitemap is not None:
        listed = s.sitemap.where("pos < 200").select("site_id", c("pos").alias("seq"), c("loc").alias("url"), F.lit("sitemap").alias("kind"))
        canon = s.pages.select("site_id", "seq", F.explode("canonicals").alias("url"), F.lit("canonical").alias("kind"))
        targets = listed.unionAll(canon).withColumn("path", U.path(c("url")))
        denied = robots.blocked(parsed, targets.select("site_id", F.lit("Googlebot").alias("agent"), "path")).select("site_id", "path", "blocked")
        noindex = s.pages.where(F.array_contains(directives(), "noindex")).select("site_id", U.canonical_identity(c("url")).alias("id_"), F.lit(True).alias("noindex"))
        wide = targets.withColumn("id_", U.canonical_identity(c("url"))).join(denied, ["site_id", "path"], "left").join(noindex, ["site_id", "id_"], "left")
        out.append(finding(wide, "indexing-conflicts", "sev", when("blocked", 2, "noindex AND kind = 'sitemap'", 1, 0), "url"))
    return out


def sitemap_checks(s: X.Sites) -> list[DataFrame]:
    if s.sitemap is None:
        return []
    entries = s.sitemap.withColumn("at", T.parse_date(c("lastmod"))).withColumn("id_", U.canonical_identity(c("loc")))
    hosts = s.pages.groupBy("site_id").agg(F.first("host").alias("host"))
    out = []
    if s.resources is not None:
        maps = s.resources.where("path LIKE '%sitemap%' AND status = 200").select("site_id", "url", "body")
        rob = s.resources.where("path = '/robots.txt' AND status = 200").select("site_id", c("body").alias("rules"))
        found = s.pages.select("site_id").distinct().join(maps.groupBy("site_id").agg(F.max_by("body", F.length("body")).alias("body")), "site_id", "left").join(rob, "site_id", "left")
        out.append(finding(found.withColumn("path", F.lit("/sitemap.xml")), "sitemap", "sev", when(r"body IS NULL OR body NOT RLIKE '<(urlset|sitemapindex)[\\s>]' OR body NOT RLIKE '<loc>'", 2, r"coalesce(rules, '') RLIKE '(?im)^\\s*sitemap\\s*:'", 0, 1), "path", None))
        index = maps.withColumn("n", F.regexp_count("body", F.lit("<loc>")))
        children = index.where("body RLIKE '<sitemapindex'").select("site_id", F.explode(F.slice(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)), 1, 5)).alias("child"))
        got = fetched(children, "child", s.resources)
        out.append(finding(got, "sitemap-index-limits", "any", when(r"got = 200 AND body RLIKE '<urlset[\\s>]' AND regexp_count(body, '<loc>') <= 50000", 0, 2), "child", None))
        ten = fetched(first_n(s.sitemap.withColumn("seq", c("pos")), "loc", ["pos"], 10), "loc", s.resources).join(hosts, "site_id")
        ok = (U.host(c("loc")) == c("host")) & (U.scheme(c("loc")) == "https") & sql("got = 200") & (U.canonical_identity(c("final_url")) == U.canonical_identity(c("loc"))) & sql("coalesce(body, '') NOT RLIKE '(?i)<meta[^>]+robots[^>]+noindex'")
        out.append(finding(ten, "sitemap-urls-valid", "agg", when(ok, 0, 2), "loc"))
    now = F.to_timestamp(F.lit(s.as_of))
    mods = entries.groupBy("site_id").agg(F.count("*").alias("n"), F.count("at").alias("ok"), F.count_if(c("at") > now).alias("future"), F.count_distinct("at").alias("kinds")).withColumn("path", F.lit("/sitemap.xml"))
    out.append(finding(mods, "sitemap-lastmod", "sev", when("ok = 0 OR future = ok", 2, "ok / n >= 0.5 AND kinds > 1 AND future = 0", 0, 1), "path", None))
    linked = links_of(s).select("site_id", c("to").alias("id_")).distinct().withColumn("linked", F.lit(True))
    listed = entries.select("site_id", "id_").distinct().withColumn("listed", F.lit(True))
    pages = s.pages.select("site_id", "seq", "path", "is_home", U.canonical_identity(c("url")).alias("id_")).join(listed, ["site_id", "id_"], "left").join(linked, ["site_id", "id_"], "left")
    out.append(finding(pages, "sitemap-orphans", "warn", when("listed IS NULL OR (linked IS NULL AND NOT is_home)", 1, 0)))
    dated = s.pages.select("site_id", "seq", "path", U.canonical_identity(c("url")).alias("id_"), T.parse_date(sql("headers['last-modified']")).alias("s1"), F.coalesce(T.parse_date(sql("metas['article:modified_time']")), T.parse_date(c("modified"))).alias("s2"))
    dated = dated.join(entries.groupBy("site_id", "id_").agg(F.max("at").alias("s3")), ["site_id", "id_"], "left")
    out.append(coherence(dated, s.as_of))
    return out


def coherence(dated: DataFrame, as_of: str) -> DataFrame:
    """Served, claimed and listed dates of a page, to within a day."""
    day, now = 86400, F.unix_timestamp(F.to_timestamp(F.lit(as_of)))
    s1, s2, s3 = (F.unix_timestamp(x) for x in ("s1", "s2", "s3"))
    known = sum(F.when(x.isNotNull(), 1).otherwise(0) for x in (s1, s2, s3))
    return finding(dated, "freshness-coherence", "sev", when(known < 2, F.lit(None), (s2 > now + day) | (s3 > now + day), 2, F.abs(s2 - s3) > day, 1, s2 - s1 > day, 1, s3 - s1 > day, 1, 0))


def page_pair_checks(s: X.Sites) -> list[DataFrame]:
    """Near-duplicate and competing pages of one site, from shared shingles and shared title words; only pages that share one meet."""
    pages = s.pages.select("site_id", "seq", "path", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("title", F.lit("")).alias("title"), T.shingles(c("main_text")).alias("sh"), F.array_distinct(T.topic_tokens(F.concat_ws(" ", "title", sql("try_element_at(h1s, 1)")))).alias("tk"), "brand")
    pages = parked(pages.withColumn("tk", F.array_except("tk", F.coalesce("brand", F.array().cast("array<string>")))), "topics")
    body = shared_pairs(pages, "sh", 0.8)
    near = body.where("jaccard >= 0.8")
    n = near.groupBy("site_id").agg(F.count("*").alias("pairs"), F.min("path_a").alias("path"))
    sites = pages.groupBy("site_id").agg(F.count("*").alias("pages")).join(n, "site_id", "left")
    unique = finding(sites.withColumn("label", F.coalesce("path", F.lit("/"))), "content-uniqueness", "sev", when("pages < 2", F.lit(None), "pairs >= 2", 2, "pairs = 1", 1, 0), "label", None)
    twins = shared_pairs(pages.where("size(tk) >= 3"), "tk", 0.6).where("jaccard >= 0.6 AND title_a <> title_b AND lang_a = lang_b")
    twins = twins.join(body.select("site_id", "seq_a", "seq_b", c("jaccard").alias("same")), ["site_id", "seq_a", "seq_b"], "left").where("coalesce(same, 0) < 0.8")
    hit = twins.select("site_id", c("seq_a").alias("seq"), c("path_a").alias("path"), F.lit(1).alias("v")).unionAll(pages.select("site_id", "seq", "path", F.lit(0)))
    return [unique, finding(hit, "keyword-cannibalization", "warn", c("v"))]


def shared_pairs(pages: DataFrame, values: str, threshold: float) -> DataFrame:
    """(site_id, seq_a, seq_b, path_a, ..., jaccard) for pages of a site whose array columns are that similar."""
    met = similar_sets(pages, "site_id", "seq", values, threshold).withColumnsRenamed({"a": "seq_a", "b": "seq_b"})
    side = lambda k: pages.select("site_id", c("seq").alias(f"seq_{k}"), c("path").alias(f"path_{k}"), c("title").alias(f"title_{k}"), c("lang").alias(f"lang_{k}"))
    return met.join(side("a"), ["site_id", "seq_a"]).join(side("b"), ["site_id", "seq_b"])


def anchor_checks(s: X.Sites) -> list[DataFrame]:
    """Does what links call a page (most often; first seen on a tie) agree with its title?"""
    links = links_of(s).where(c("internal") & (c("text") != ""))
    counts = links.groupBy("site_id", "to", F.lower("text").alias("anchor")).agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("first"), F.count_if(c("in_main")).alias("main"))
    best = Window.partitionBy("site_id", "to").orderBy(F.desc("n"), "first")
    top = counts.withColumn("k", F.row_number().over(best)).withColumn("kinds", F.count("*").over(Window.partitionBy("site_id", "to"))).where("k = 1")
    own = s.pages.select("site_id", "seq", "path", U.canonical_identity(c("url")).alias("to"), T.anchor_tokens(F.concat_ws(" ", "title", sql("try_element_at(h1s, 1)"))).alias("words"))
    parts = T.title_segments(c("title"))
    tail = F.when(F.size(parts) >= 2, F.element_at(parts, -1)).otherwise("")
    named = F.concat_ws(" ", F.substring_index("host", ".", 1), c("metas")["og:site_name"], tail)
    brands = s.pages.where("is_home").select("site_id", T.anchor_tokens(named).alias("brand"))
    less = lambda x: F.array_except(x, F.coalesce("brand", F.array().cast("array<string>")))
    wide = top.join(own, ["site_id", "to"]).join(brands, "site_id", "left").withColumn("said", less(T.anchor_tokens(c("anchor")))).withColumn("words", less(c("words"))).where("size(said) > 0")
    wide = wide.withColumn("graded", F.count("*").over(Window.partitionBy("site_id"))).where("graded >= 2")
    return [finding(wide, "anchor-target-profile", "warn", when("NOT arrays_overlap(said, words)", 1, "kinds = 1 AND main >= 3", 1, 0))]


def entity_checks(s: X.Sites) -> list[DataFrame]:
    """Unresolved references, and named entities that fall into several components, over all pages of a site."""
    nodes = s.pages.select("site_id", F.explode("nodes").alias("n"), "seq").select("site_id", F.when(c("n.synthetic") == "true", F.concat_ws("#", c("seq").cast("string"), "n.id")).otherwise(c("n.id")).alias("id_"), "n.types", "n.name")
    key = lambda x: F.when(c(x).startswith("_:"), F.concat_ws("#", c("seq").cast("string"), x)).otherwise(c(x))
    edges = s.pages.select("site_id", "seq", F.explode("edges").alias("e")).select("site_id", "seq", c("e.src").alias("src"), c("e.dst").alias("dst")).select("site_id", key("src").alias("src"), key("dst").alias("dst"))
    glue = lambda x: F.concat_ws("\x00", "site_id", x)
    known = nodes.groupBy("site_id", "id_").agg(F.max("types").alias("types"), F.max("name").alias("name"))
    roots = connected_components(edges.select(glue("src").alias("src"), glue("dst").alias("dst")))
    in_ = edges.select("site_id", c("dst").alias("id_")).distinct().withColumn("held", F.lit(True))
    wide = known.withColumn("node", glue("id_")).join(roots, "node", "left").join(in_, ["site_id", "id_"], "left")
    tops = wide.groupBy("site_id").agg(F.count_if(sql("types = ''")).alias("dangling"), F.count_if(sql("name <> '' AND held IS NULL")).alias("named"), F.count_distinct(F.when(sql("name <> '' AND held IS NULL"), F.coalesce("root", "node"))).alias("parts"))
    sites = s.pages.select("site_id").distinct().join(tops, "site_id", "left").withColumn("label", F.lit("graph"))
    return [finding(sites, "entity-graph-connectivity", "sev", when("dangling > 0", 2, "dangling IS NULL", 1, "named >= 2 AND parts >= 2", 1, 0), "label", None)]


def nap_checks(s: X.Sites) -> list[DataFrame]:
    """Name, phone and address as footers give them: the majority's value (the markup's on a tie), who deviates, and whether the markup does."""
    declared = s.pages.select("site_id", F.explode("nap").alias("dim", "said")).groupBy("site_id", "dim").agg(F.min("said").alias("said"))
    phone = T.normalize_phone(F.regexp_extract("footer_text", r"(\+?\d[\d\s().-]{6,}\d)", 1))
    rows = s.pages.select("site_id", "seq", "path", F.lit("phone").alias("dim"), F.nullif(phone, F.lit("")).alias("value"), "footer_text")
    held = s.pages.select("site_id", "seq", "path", "footer_text").join(declared.where("dim <> 'phone'"), "site_id").select("site_id", "seq", "path", "dim", F.when(F.contains(F.lower("footer_text"), F.lower("said")), c("said")).alias("value"))
    every = rows.drop("footer_text").unionByName(held).where("value IS NOT NULL")
    counts = every.groupBy("site_id", "dim", "value").agg(F.count("*").alias("n"), F.min("seq").alias("first")).join(declared, ["site_id", "dim"], "left")
    best = Window.partitionBy("site_id", "dim").orderBy(F.desc("n"), (c("value") == c("said")).desc_nulls_last(), "first")
    chosen = counts.withColumn("k", F.row_number().over(best)).where("k = 1").select("site_id", "dim", c("value").alias("usual"), "said")
    wide = every.join(chosen, ["site_id", "dim"])
    return [finding(wide, "nap-consistency", "agg", when("value <> usual", 2, 0)), finding(wide.where("value = usual AND said IS NOT NULL AND usual <> said"), "nap-consistency", "agg", F.lit(None))]


def redirect_checks(s: X.Sites) -> list[DataFrame]:
    """Chains by name: http (the home page by http), apex and www, slash:PATH (a toggled final slash), any other name (a plain chain)."""
    if s.hops is None:
        return []
    chain = s.hops.groupBy("site_id", "chain_id").agg(F.array_sort(F.collect_list(F.struct("hop", "url", "status", "location"))).alias("h"))
    chain = chain.withColumn("moves", sql("size(filter(h, x -> x.status BETWEEN 300 AND 399))")).withColumn("last", sql("element_at(h, -1)")).withColumn("first", c("h")[0]).withColumn("ends", ~c("last.status").between(300, 399))
    chain = parked(chain, "chains")
    plain = finding(chain.where("chain_id NOT RLIKE '^(http|apex|www|slash:.*)$'"), "redirect-chains", "sev", when("moves > 1 OR NOT ends", 2, "moves = 1 AND first.status NOT IN (301, 308)", 1, 0), "chain_id", None)
    slash = finding(chain.where("chain_id LIKE 'slash:%'"), "trailing-slash", "sev", when("first.status = 200", 2, "first.status IN (302, 307)", 1, 0), "chain_id", None)
    http = finding(chain.where("chain_id = 'http'"), "redirect-hygiene", "sev", when("first.status IN (301, 308) AND first.location LIKE 'https://%'", 0, "moves > 0", 1, 2), "chain_id", None)
    host = U.host(c("last.url"))
    first_host = U.host(c("first.url"))
    state = F.when(~c("ends") | (c("last.status") != 200), "broken").when(host == first_host, "serves").when((host == F.concat(F.lit("www."), first_host)) | (first_host == F.concat(F.lit("www."), host)), "crosses").otherwise("broken")
    hosts = chain.where("chain_id IN ('apex', 'www')").select("site_id", "chain_id", state.alias("state"), F.when(c("moves") > 0, c("first.status")).alias("code"))
    pair = hosts.groupBy("site_id").agg(F.max(F.when(c("chain_id") == "apex", c("state"))).alias("apex"), F.max(F.when(c("chain_id") == "www", c("state"))).alias("www"), F.max("code").alias("code")).withColumn("label", F.lit("www"))
    verdict = when("apex IS NULL AND www IS NULL", F.lit(None), "apex = 'broken' OR www = 'broken'", 2, "apex = 'serves' AND www = 'serves'", 2, "apex = 'crosses' AND www = 'crosses'", 2, "apex = 'crosses' OR www = 'crosses'", F.when(c("code").isin(301, 308), 0).otherwise(1), 1)
    return [plain, slash, http, finding(pair, "www-consolidation", "sev", verdict, "label", None)]


def probe_checks(s: X.Sites) -> list[DataFrame]:
    """What other user agents get, held against what the crawl got. The last attempt counts; one that recovered only warns."""
    if s.ua_probes is None:
        return []
    last = s.ua_probes.groupBy("site_id", "path", "ua_label", "is_ai").agg(F.max_by(F.struct("status", "final_url", "body"), "attempt").alias("p"), F.min_by("status", "attempt").alias("first"))
    base = s.pages.select("site_id", "path", "url", "main_words", "html_bytes", c("title").alias("own_title"), c("status").alias("own"))
    text = T.collapse(F.regexp_replace(F.regexp_replace("p.body", r"(?is)<(script|style|noscript|nav|header|footer|aside)\b.*?</\1>", " "), "<[^>]*>", " "))
    title = F.trim(F.regexp_extract("p.body", r"(?is)<title[^>]*>(.*?)</title>", 1))
    wide = last.join(base, ["site_id", "path"]).withColumn("words", T.word_count(text)).withColumn("label", F.concat_ws(" ", "ua_label", "path"))
    differs = sql("floor(p.status / 100) <> floor(own / 100) OR p.status IS NULL OR (main_words >= 20 AND words < 5) OR octet_length(p.body) < 0.7 * html_bytes") | (U.path(c("p.final_url")) != U.path(c("url"))) | (title != F.coalesce("own_title", F.lit("")))
    parity = finding(wide, "ai-serving-parity", "sev", when(~F.coalesce(differs, F.lit(True)), 0, "is_ai", 2, 1), "label", None)
    hard = "p.status IS NULL OR p.status IN (403, 451) OR p.status >= 500"
    reach = finding(wide.where("is_ai AND path = '/'"), "ai-crawler-reachability", "sev", when(hard, 2, "p.status NOT BETWEEN 200 AND 299 OR first <> p.status", 1, 0), "label", None)
    return [parity, reach]


def transport_checks(s: X.Sites) -> list[DataFrame]:
    out = []
    if s.transport is not None:
        t = s.transport.withColumn("label", F.lit("tls"))
        fs = "cipher RLIKE '(?i)(ECDHE|DHE|TLS_AES|TLS_CHACHA)'"
        out += [
            finding(t, "http-protocol", "sev", when("skip_reason IS NOT NULL", F.lit(None), "alpn IN ('h2', 'h3')", 0, 1), "label", None),
            finding(t, "tls-version", "sev", when("skip_reason IS NOT NULL", F.lit(None), f"tls_version = 'TLSv1.3' OR (tls_version = 'TLSv1.2' AND {fs})", 0, "tls_version = 'TLSv1.2'", 1, 2), "label", None),
        ]
    if s.psi is not None:
        p = s.psi.withColumn("label", c("strategy"))
        low = lambda v, good, poor: when(f"{v} IS NULL", F.lit(None), f"{v} <= {good}", 0, f"{v} <= {poor}", 1, 2)
        rules = {
            "lighthouse-perf": when("perf_score IS NULL", F.lit(None), "perf_score >= 0.9", 0, "perf_score >= 0.5", 1, 2), "cwv-lcp": low("coalesce(lcp, lab_lcp)", 2500, 4000), "cwv-cls": low("cls", 0.1, 0.25), "cwv-inp": low("inp", 200, 500),
            "cwv-assessment": when("overall = 'FAST'", 0, "overall = 'AVERAGE'", 1, "overall = 'SLOW'", 2, F.lit(None)), "cwv-ttfb": low("coalesce(ttfb, srt)", 800, 1800), "lab-tbt": when("tbt IS NULL", F.lit(None), "tbt < 200", 0, "tbt <= 600", 1, 2),
            "lab-fcp": when("fcp IS NULL", F.lit(None), "fcp <= 1800 AND coalesce(lab_lcp, 0) <= 4000", 0, "fcp <= 3000", 1, 2),
        }
        out += [finding(p, k, "sev", v, "label", None) for k, v in rules.items()]
    return out


def external_checks(s: X.Sites) -> list[DataFrame]:
    if s.external is None:
        return []
    hosts = s.pages.groupBy("site_id").agg(F.regexp_replace(F.first("host"), r"^www\.", "").alias("host"))
    outside = links_of(s).where(~c("internal")).withColumn("out_host", U.host(c("url"))).withColumn("side", (~c("in_main")).cast("int"))
    ten = first_n(outside.select("site_id", "seq", "pos", "side", "url", "out_host"), "out_host", ["side", "seq", "pos"], 10)
    got = ten.join(s.external.select("site_id", "url", c("status").alias("got")), ["site_id", "url"])
    health = finding(got, "outbound-link-health", "agg", when("got IN (404, 410)", 2, "got BETWEEN 200 AND 399", 0, F.lit(None)), "url")
    profiles = first_n(s.pages.select("site_id", "seq", F.explode("same_as").alias("url")), "url", ["seq", "url"], 6)
    back = profiles.join(s.external.where("status = 200"), ["site_id", "url"]).join(hosts, "site_id")
    named = F.exists(F.regexp_extract_all("body", F.lit(r"(?i)href=[\"']https?://(?:www\.)?([^/\"'?#]+)"), F.lit(1)), lambda h: F.lower(h) == c("host"))
    return [health, finding(back, "sameas-verified", "warn", when(named, 0, 1), "url")]


def lint_checks(s: X.Sites) -> list[DataFrame]:
    if s.resources is None:
        return []
    file = s.resources.where("path = '/llms.txt' AND status = 200").select("site_id", "url", c("body").alias("text"))
    hosts = s.pages.groupBy("site_id").agg(F.first("host").alias("host"))
    links = file.select("site_id", F.posexplode(T.markdown_links(c("text"))).alias("pos", "l")).select("site_id", "pos", c("l.url").alias("target")).join(hosts, "site_id")
    own = first_n(links.where(U.host(c("target")) == c("host")), "target", ["pos"], 12)
    dead = fetched(own, "target", s.resources).groupBy("site_id").agg(F.count_if(sql("got >= 400")).alias("dead"), F.count("*").alias("own"))
    relative = links.groupBy("site_id").agg(F.count_if(sql("target NOT RLIKE '^[a-zA-Z][a-zA-Z0-9+.-]*:'")).alias("relative"))
    listed = own.withColumn("id_", U.canonical_identity(c("target"))).join(s.table("sitemap", X.SITEMAP).select("site_id", U.canonical_identity(c("loc")).alias("id_")).distinct(), ["site_id", "id_"], "left_semi").groupBy("site_id").agg(F.count("*").alias("listed"))
    maps = s.table("sitemap", X.SITEMAP).select("site_id", F.lit(True).alias("mapped")).distinct()
    wide = file.join(dead, "site_id", "left").join(relative, "site_id", "left").join(listed, "site_id", "left").join(maps, "site_id", "left").withColumn("label", F.lit("/llms.txt"))
    return [finding(wide, "llms-txt-lint", "sev", when(r"regexp_count(text, '(?m)^#\\s+\\S') > 1 OR relative > 0 OR dead > 0 OR (mapped AND own > 0 AND listed IS NULL)", 1, 0), "label", None)]


GROUPS = (link_checks, graph_checks, robots_checks, sitemap_checks, page_pair_checks, anchor_checks, entity_checks, nap_checks, redirect_checks, probe_checks, transport_checks, external_checks, lint_checks)


def findings(s: X.Sites) -> DataFrame | None:
    every = [f for group in GROUPS for f in group(s)]
    return reduce(DataFrame.unionAll, every) if every else None
