"""Queries over the raw page table, without a DOM: what regular expressions can read off HTML and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import rollup
from ..operators.similar import similar_sets
from ..shared import parked
from ..sources.tables import table

c = F.col
BLANK = r"[\x20\x09-\x0D]+"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
H1 = r"(?is)<h1[^>]*>(.*?)</h1>"
ANCHOR = r"(?is)<a\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>"


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, BLANK, " "))


def stripped(html: Column) -> Column:
    """Text outside scripts, styles and tags."""
    return squeezed(F.regexp_replace(F.regexp_replace(html, r"(?is)<(?:script|style|noscript)\b.*?</(?:script|style|noscript)>", " "), r"<[^>]*>", " "))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").withColumn("site_id", U.host(c("url"))).withColumn("path", U.path(c("url"))).withColumn("title", squeezed(F.regexp_extract("html", TITLE, 1)))


#: Bounds of a title or heading, a description and an excerpt, in characters; a shorter excerpt than the last is none.
MOST_TITLE, MOST_DESCRIPTION, MOST_EXCERPT, LEAST_EXCERPT = 200, 300, 2000, 80
#: Entities that occur in titles and descriptions, in the order in which they are replaced.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
_DROPPED = ("(?is)" + "|".join(rf"<{t}\b.*?</{t}>" for t in ("script", "style", "noscript", "template", "svg")), "(?is)" + "|".join(rf"<{t}\b.*?</{t}>" for t in ("nav", "header", "footer", "aside")), "(?s)<!--.*?-->")


def decoded(text: Column) -> Column:
    """Numeric entities (decimal, then hexadecimal) and those of ENTITIES as characters."""
    for mark, base in (("&#", 10), ("&#x", 16)):
        digits = "[0-9]" if base == 10 else "[0-9a-fA-F]"
        point = lambda x: F.conv(x, base, 10).cast("bigint")  # noqa: E731, B023
        char = lambda x: F.when(point(x).between(1, 0xD7FF) | point(x).between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(point(x)), 8, "0")), "UTF-32")).otherwise("")  # noqa: E731, B023
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?i){mark}({digits}{{1,8}});"), F.lit(1)))
        text = F.when(F.contains(text, F.lit("&#")), F.aggregate(found, text, lambda acc, x: F.replace(acc, F.concat(F.lit(mark), x, F.lit(";")), char(x)))).otherwise(text)  # noqa: B023
    for name, char in ENTITIES:
        text = F.regexp_replace(text, f"(?i){name}", char)
    return text


def plain(html: Column) -> Column:
    """Text without tags, entities decoded, white space as single spaces."""
    return squeezed(decoded(F.regexp_replace(html, "<[^>]*>", " ")))


def excerpt_of(html: Column) -> Column:
    """Visible text of main, else article, else body, without chrome: up to MOST_EXCERPT characters, cut at the last space if that lies in the second half; null below LEAST_EXCERPT."""
    body = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)</body>", 1)
    body = F.when(body != "", body).otherwise(html)
    both = r"(?is)<main\b[^>]*>(.*?)</main>|<article\b[^>]*>(.*?)</article>"
    scope = F.when(body.rlike(both), F.concat(F.regexp_extract(body, both, 1), F.regexp_extract(body, both, 2))).otherwise(body)
    for pattern in _DROPPED:
        scope = F.regexp_replace(scope, pattern, " ")
    return F.transform(F.array(plain(scope)), _cut)[0]


def _cut(text: Column) -> Column:
    head = F.substring(text, 1, MOST_EXCERPT)
    space = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    short = F.when(space > MOST_EXCERPT // 2, F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(text) >= LEAST_EXCERPT, F.when(F.length(text) <= MOST_EXCERPT, text).otherwise(F.rtrim(short)))


def page_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Title, description, first heading and excerpt of each page; null where there is none."""
    cell = lambda x, most: F.nullif(F.trim(F.substring(plain(x), 1, most)), F.lit(""))
    tag = F.coalesce(F.get(F.filter(F.regexp_extract_all("html", F.lit(r"(?i)(<meta\b[^>]*>)"), F.lit(1)), lambda x: x.rlike(r"(?i)name\s*=\s*[\"']?description[\"']?") & x.rlike(r"(?i)content\s*=\s*[^\s>]")), F.lit(0)), F.lit(""))
    value = r"(?i)content\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
    content = F.concat(*[F.regexp_extract(tag, value, i) for i in (1, 2, 3)])
    return _pages(spark, folder).select(
        "page_id",
        "path",
        cell(F.regexp_extract("html", TITLE, 1), MOST_TITLE).alias("title"),
        cell(content, MOST_DESCRIPTION).alias("description"),
        cell(F.regexp_extract("html", H1, 1), MOST_TITLE).alias("h1"),
        excerpt_of(c("html")).alias("excerpt"),
    )


def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", U.scheme(c("url")).alias("scheme"), U.host(c("url")).alias("host"), U.path(c("url")).alias("path"), U.query(c("url")).alias("query"), U.depth(U.path(c("url"))).cast("long").alias("depth"))


def canonical_identity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", U.canonical_identity(c("url")).alias("identity"))


def url_structure(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.array_join(U.url_issues(c("url")), ";").alias("issues"))


def pagination_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", U.page_number(c("url")).cast("long").alias("page")).where("page IS NOT NULL")


def title_bounds(spark: SparkSession, folder: str) -> DataFrame:
    n = F.length("title")
    return _pages(spark, folder).select("page_id", n.cast("long").alias("n"), F.when(n == 0, "missing").when(n.between(10, 70), "ok").otherwise("range").alias("verdict"))


def title_pattern(spark: SparkSession, folder: str) -> DataFrame:
    parts = T.title_segments(c("title"))
    verdict = F.when(c("title") == "", "fail").when(F.size(parts) < 2, "warn").when(F.length(parts[0]) < F.length(F.element_at(parts, -1)), "warn").otherwise("pass")
    return _pages(spark, folder).select("page_id", F.size(parts).cast("long").alias("segments"), verdict.alias("verdict"))


def title_boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    """Words in at least 80 % of a site's titles, where it has at least four."""
    titles = _pages(spark, folder).where("title <> ''").select("site_id", F.array_distinct(T.words_of(c("title"))).alias("w"))
    sizes = titles.groupBy("site_id").agg(F.count("*").alias("titles"))
    return titles.select("site_id", F.explode("w").alias("word")).where("length(word) > 1").groupBy("site_id", "word").agg(F.count("*").alias("n")).join(sizes, "site_id").where("titles >= 4 AND n >= titles * 0.8")


def unique_titles(spark: SparkSession, folder: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("site_id", "title"))
    pages = _pages(spark, folder).where("title <> ''").select("site_id", (n > 1).alias("same"))
    got = pages.groupBy("site_id").agg(F.count("*").alias("total"), F.count_if("same").alias("offenders"))
    return got.withColumn("status", F.when(c("offenders") == 0, "pass").when((c("total") - c("offenders")) / c("total") >= 0.8, "warn").otherwise("fail"))


def html_weight(spark: SparkSession, folder: str) -> DataFrame:
    n = F.octet_length("html")
    return table(spark, folder, "pages").select("page_id", n.cast("long").alias("bytes"), F.when(n <= 102400, "pass").when(n <= 256000, "warn").otherwise("fail").alias("verdict"))


def html_lang(spark: SparkSession, folder: str) -> DataFrame:
    lang = F.regexp_extract("html", r"(?i)<html[^>]*\slang=\"([^\"]*)\"", 1)
    return table(spark, folder, "pages").select("page_id", lang.alias("lang"), T.is_bcp47(lang).alias("valid"))


def charset_declared(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.lower(F.regexp_extract(F.substring("html", 1, 1024), r"(?i)<meta[^>]*charset=\"?([a-z0-9_-]+)", 1)).alias("charset"))


def anchors(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, site_id, url, pos, href, text) of every link with a quoted href."""
    pages = _pages(spark, folder).withColumn("hrefs", F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).withColumn("texts", F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)))
    return pages.select("page_id", "site_id", "url", F.posexplode(F.arrays_zip("hrefs", "texts")).alias("pos", "a")).select("page_id", "site_id", "url", c("pos").cast("long").alias("pos"), c("a.hrefs").alias("href"), squeezed(F.regexp_replace("a.texts", "<[^>]*>", " ")).alias("text"))


def links_edges(spark: SparkSession, folder: str) -> DataFrame:
    return anchors(spark, folder).select("page_id", "pos", "href", "text")


def anchor_generic_ratio(spark: SparkSession, folder: str) -> DataFrame:
    generic = T.is_generic_anchor(c("text"))
    got = anchors(spark, folder).groupBy("site_id").agg(F.count("*").alias("links"), F.count_if(generic).alias("generic"))
    return got.withColumn("status", F.when(c("generic") / c("links") < 0.1, "pass").when(c("generic") / c("links") < 0.5, "warn").otherwise("fail"))


def site_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(site_id, src, dst) between paths of one site, from root-relative links; no self-links."""
    a = anchors(spark, folder).where(c("href").startswith("/") & ~c("href").startswith("//"))
    dst = F.regexp_replace("href", "[?#].*$", "")
    return a.select("site_id", U.path(c("url")).alias("src"), dst.alias("dst")).where("src <> dst").distinct()


def in_degree(spark: SparkSession, folder: str) -> DataFrame:
    return site_edges(spark, folder).groupBy("site_id", c("dst").alias("node")).agg(F.count("*").alias("n"))


def dead_ends(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _pages(spark, folder).select("site_id", c("path").alias("src")).distinct()
    return nodes.join(site_edges(spark, folder), ["site_id", "src"], "left_anti").withColumnRenamed("src", "node")


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _pages(spark, folder).select("site_id", c("path").alias("dst")).distinct()
    return nodes.join(site_edges(spark, folder), ["site_id", "dst"], "left_anti").withColumnRenamed("dst", "node")


def bfs_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks from each site's shallowest path, over all paths, at most five; a recursive query."""

    links = parked(site_edges(spark, folder), "edges")
    depth = F.struct(U.depth(c("path")).alias("d"), c("path"))
    roots = _pages(spark, folder).groupBy("site_id").agg(F.min(depth).alias("m")).select("site_id", c("m.path").alias("node"), F.lit(0).cast("long").alias("depth"))
    seen = front = parked(roots, "depth")
    for d in range(1, 6):
        step = front.withColumnRenamed("node", "src").join(links, ["site_id", "src"]).select("site_id", c("dst").alias("node")).distinct().join(seen, ["site_id", "node"], "left_anti")
        front = parked(step.withColumn("depth", F.lit(d).cast("long")), "front")
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


def link_components(spark: SparkSession, folder: str) -> DataFrame:
    """Connected components of all sites' links, as the smallest node of each."""
    from ..operators.components import connected_components

    e = site_edges(spark, folder).select(F.concat_ws(" ", "site_id", "src").alias("src"), F.concat_ws(" ", "site_id", "dst").alias("dst"))
    return connected_components(e).groupBy("root").agg(F.count("*").alias("n"))


def pagerank(spark: SparkSession, folder: str) -> DataFrame:
    """Rank of the paths of each site after all rounds, rounded; dangling mass is spread evenly."""
    from ..operators import graph

    nodes = _pages(spark, folder).select("site_id", c("path").alias("url")).distinct()
    return graph.pagerank(nodes, parked(site_edges(spark, folder), "edges"), cut_every=10).withColumn("rank", F.round("rank", 6))


def static_text(spark: SparkSession, folder: str) -> DataFrame:
    t = stripped(c("html"))
    words = T.word_count(t)
    return table(spark, folder, "pages").select("page_id", F.length(t).cast("long").alias("chars"), words.cast("long").alias("words"), (F.length(t) < 200).alias("thin"), (words < 150).alias("shallow"))


def shingle_twins(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of one site whose five-word shingles have a Jaccard similarity of at least 0.5."""
    pages = parked(_pages(spark, folder).select("site_id", "page_id", T.shingles(stripped(c("html"))).alias("x")), "shingles")
    return similar_sets(pages, "site_id", "page_id", "x", 0.5).select("a", "b", F.round("jaccard", 6).alias("jaccard")).where("jaccard >= 0.5")


def title_twins(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of one site whose titles share at least 60 % of their words, titles of three words or more."""
    pages = _pages(spark, folder).select("site_id", "page_id", "title", F.array_distinct(F.filter(T.words_of(c("title")), lambda w: F.length(w) > 1)).alias("w")).where("size(w) >= 3")
    met = similar_sets(pages, "site_id", "page_id", "w", 0.6)
    side = pages.select("page_id", "title")
    wide = met.join(side.toDF("a", "ta"), "a").join(side.toDF("b", "tb"), "b").where("ta <> tb")
    return wide.select("a", "b", F.round("jaccard", 6).alias("jaccard")).where("jaccard >= 0.6")


#: A small audit that regular expressions can carry: check, family, points.
LITE = {"unique-titles": ("on-page", 5), "html-lang": ("accessibility", 4), "charset": ("on-page", 3), "html-weight": ("performance", 3), "url-structure": ("technical-seo", 3), "title-pattern": ("on-page", 3), "https": ("security", 5), "content-without-js": ("llm-content", 6)}


def lite_results(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder)
    text = stripped(c("html"))
    lang = F.regexp_extract("html", r"(?i)<html[^>]*\slang=\"([^\"]*)\"", 1)
    parts = T.title_segments(c("title"))
    first = F.row_number().over(Window.partitionBy("site_id").orderBy((c("path") != "/").cast("int"), U.depth(c("path")), "url")) == 1
    wide = pages.withColumn("home", first).withColumn("same", F.when(c("title") == "", 0).otherwise((F.count("*").over(Window.partitionBy("site_id", "title")) > 1).cast("int") * 2))
    n = F.octet_length("html")
    rules = {
        "unique-titles": ("agg", c("same")), "html-lang": ("lang", F.when(lang == "", 2).when(~T.is_bcp47(lang), 1).otherwise(0)), "url-structure": ("agg", F.when(F.size(U.url_issues(c("url"))) > 0, 2).otherwise(0)),
        "content-without-js": ("agg", F.when(F.length(text) < 200, 2).otherwise(0)), "html-weight": ("sev", F.when(c("home"), F.when(n <= 102400, 0).when(n <= 256000, 1).otherwise(2))),
        "charset": ("sev", F.when(c("home"), F.when(F.lower(F.regexp_extract(F.substring("html", 1, 1024), r"(?i)<meta[^>]*charset=\"?([a-z0-9_-]+)", 1)) == "utf-8", 0).otherwise(2))),
        "title-pattern": ("sev", F.when(c("home"), F.when(c("title") == "", 2).when(F.size(parts) < 2, 1).when(F.length(parts[0]) < F.length(F.element_at(parts, -1)), 1).otherwise(0))), "https": ("sev", F.when(c("home"), F.when(c("url").startswith("https://"), 0).otherwise(2))),
    }
    items = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(r).alias("rollup"), v.cast("int").alias("severity")) for k, (r, v) in rules.items()])
    found = wide.select("site_id", c("page_id").cast("int").alias("seq"), c("path").alias("label"), F.explode(items).alias("f")).select("site_id", "f.id", "f.rollup", "seq", "label", "f.severity")
    done = rollup.rolled(found)
    family = F.create_map(*[F.lit(x) for k, (f, _) in LITE.items() for x in (k, f)])[c("id")]
    most = F.create_map(*[F.lit(x) for k, (_, p) in LITE.items() for x in (k, p)])[c("id")]
    return done.select("site_id", "id", family.alias("family"), "status", rollup.points(c("status"), most).alias("points"), most.alias("max_points"))


def check_results(spark: SparkSession, folder: str) -> DataFrame:
    return lite_results(spark, folder).select("site_id", "id", "family", "status", c("points").cast("long").alias("points"), c("max_points").cast("long").alias("max_points"))


def family_scores(spark: SparkSession, folder: str) -> DataFrame:
    f = rollup.family_scores(lite_results(spark, folder))
    return f.select("site_id", "family", c("earned").cast("long").alias("earned"), c("max").cast("long").alias("max"), c("score").cast("long").alias("score"))


def site_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = rollup.site_scores(rollup.family_scores(lite_results(spark, folder)))
    return s.select("site_id", c("score").cast("long").alias("score"), "grade")


def score_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Points by site and family, and by site alone: one pass over grouping sets."""
    r = lite_results(spark, folder).where("status <> 'skip'")
    return r.rollup("site_id", "family").agg(F.sum("points").alias("earned"), F.sum("max_points").alias("max")).where("site_id IS NOT NULL").select("site_id", F.coalesce("family", F.lit("(all)")).alias("family"), c("earned").cast("long").alias("earned"), c("max").cast("long").alias("max"))


QUERIES = {f.__name__: f for f in (page_meta, url_parts, canonical_identity, url_structure, pagination_pages, title_bounds, title_pattern, title_boilerplate, unique_titles, html_weight, html_lang, charset_declared, links_edges, anchor_generic_ratio, in_degree, dead_ends, orphans, bfs_depth, link_components, pagerank, static_text, shingle_twins, title_twins, check_results, family_scores, site_scores, score_rollup)}

_P = r"""
    p AS (
        SELECT *, lower(regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)', 2)) AS site_id,
               CASE WHEN regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)', 3) = '' THEN '/' ELSE regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)', 3) END AS path,
               trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\x20\x09-\x0D]+', ' ', 'g')) AS title
        FROM pages
    )"""
_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|noscript)\b.*?</(?:script|style|noscript)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))"
_A = (
    _P
    + r""",
    a AS (
        SELECT page_id, site_id, url, path, i - 1 AS pos, hrefs[i] AS href, trim(regexp_replace(regexp_replace(texts[i], '<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS text
        FROM (
            SELECT *, unnest(range(1, len(hrefs) + 1)) AS i
            FROM (SELECT *, regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS hrefs, regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS texts FROM p)
        )
    ),
    e AS (SELECT DISTINCT site_id, path AS src, regexp_replace(href, '[?#].*$', '') AS dst FROM a WHERE href LIKE '/%' AND href NOT LIKE '//%' AND path <> regexp_replace(href, '[?#].*$', ''))"""
)
_DEPTH = "len(list_filter(string_split(path, '/'), lambda x: x <> ''))"
_ISSUES = r"""array_to_string(list_filter([
            CASE WHEN length(url) > 115 THEN 'too long' END, CASE WHEN regexp_matches(path, '[A-Z]') THEN 'uppercase' END, CASE WHEN contains(path, '_') THEN 'underscore' END,
            CASE WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) > 4 THEN 'too deep' END,
            CASE WHEN regexp_matches(url, '(?i)[?&](utm_[a-z]+|gclid|fbclid|sessionid|phpsessid|jsessionid|sid)=') THEN 'tracking parameter' END
        ], lambda x: x IS NOT NULL), ';')"""
_LANG = r"""regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1)"""
_CHARSET = r"""lower(regexp_extract(substring(html, 1, 1024), '(?i)<meta[^>]*charset="?([a-z0-9_-]+)', 1))"""
_RATIO = "CASE WHEN bad = 0 THEN 'pass' WHEN (total - bad)::DOUBLE / total >= 0.8 THEN 'warn' ELSE 'fail' END"
_SEGMENTS = r"string_split_regex(title, ' [|\-–—·] ')"
_LITE = (
    _P
    + rf""",
    w AS (
        SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY (path <> '/')::INT, {_DEPTH}, url) = 1 AS home, CASE WHEN title = '' THEN 0 WHEN count(*) OVER (PARTITION BY site_id, title) > 1 THEN 1 ELSE 0 END AS same,
               {_LANG} AS lang, {_CHARSET} AS cs, octet_length(encode(html)) AS bytes, {_ISSUES} AS issues, {_STRIP} AS body, {_SEGMENTS} AS seg
        FROM p
    ),
    f AS (
        SELECT site_id, 'unique-titles' AS id, count(*) AS total, count_if(same = 1) AS bad, NULL AS worst FROM w GROUP BY 1
        UNION ALL SELECT site_id, 'url-structure', count(*), count_if(issues <> ''), NULL FROM w GROUP BY 1
        UNION ALL SELECT site_id, 'content-without-js', count(*), count_if(length(body) < 200), NULL FROM w GROUP BY 1
        UNION ALL SELECT site_id, 'html-lang', count(*), count_if(NOT regexp_matches(lower(trim(lang)), '^[a-z]{{2,3}}(-[a-z0-9]{{2,8}})*$')), CASE WHEN count_if(lang = '') = 0 AND count_if(NOT regexp_matches(lower(trim(lang)), '^[a-z]{{2,3}}(-[a-z0-9]{{2,8}})*$')) > 0 THEN 1 END FROM w GROUP BY 1
        UNION ALL SELECT site_id, 'html-weight', 1, 1, CASE WHEN bytes <= 102400 THEN 0 WHEN bytes <= 256000 THEN 1 ELSE 2 END FROM w WHERE home
        UNION ALL SELECT site_id, 'charset', 1, 1, CASE WHEN cs = 'utf-8' THEN 0 ELSE 2 END FROM w WHERE home
        UNION ALL SELECT site_id, 'title-pattern', 1, 1, CASE WHEN title = '' THEN 2 WHEN len(seg) < 2 OR length(seg[1]) < length(seg[-1]) THEN 1 ELSE 0 END FROM w WHERE home
        UNION ALL SELECT site_id, 'https', 1, 1, CASE WHEN url LIKE 'https://%' THEN 0 ELSE 2 END FROM w WHERE home
    ),
    m AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{f}', {n})" for k, (f, n) in LITE.items())}) AS t(id, family, max_points)),
    s AS (SELECT site_id, id, CASE WHEN worst IS NULL THEN {_RATIO} WHEN worst = 0 THEN 'pass' WHEN worst = 1 THEN 'warn' ELSE 'fail' END AS status FROM f),
    r AS (SELECT site_id, id, family, status, (CASE status WHEN 'pass' THEN max_points WHEN 'warn' THEN max_points // 2 ELSE 0 END)::BIGINT AS points, max_points::BIGINT AS max_points FROM s JOIN m USING (id)),
    fs AS (SELECT site_id, family, sum(points)::BIGINT AS earned, sum(max_points)::BIGINT AS max, floor(100.0 * sum(points) / sum(max_points) + 0.5)::BIGINT AS score FROM r GROUP BY 1, 2)"""
)
_WEIGHT = "CASE family WHEN 'on-page' THEN 0.12 WHEN 'accessibility' THEN 0.07 WHEN 'performance' THEN 0.10 WHEN 'technical-seo' THEN 0.15 WHEN 'security' THEN 0.07 WHEN 'llm-content' THEN 0.18 END"


def _rank(rounds: int) -> str:
    out = f"""WITH {_A}, n AS (SELECT site_id, path AS node FROM p UNION SELECT site_id, src FROM e UNION SELECT site_id, dst FROM e),
        o AS (SELECT site_id, src AS node, count(*) AS outs FROM e GROUP BY 1, 2),
        b AS MATERIALIZED (SELECT n.site_id, n.node, coalesce(outs, 0) AS outs, count(*) OVER (PARTITION BY n.site_id) AS size FROM n LEFT JOIN o USING (site_id, node)),
        r0 AS (SELECT *, 1.0::DOUBLE / size AS rank FROM b)"""
    for i in range(1, rounds + 1):
        out += f""",
        r{i} AS MATERIALIZED (
            SELECT site_id, node, outs, size, 0.15::DOUBLE / size + 0.85::DOUBLE * (coalesce(given, 0) + lost / size) AS rank
            FROM (SELECT *, sum(CASE WHEN outs = 0 THEN rank ELSE 0 END) OVER (PARTITION BY site_id) AS lost FROM r{i - 1})
            LEFT JOIN (SELECT e.site_id, e.dst AS node, sum(rank / outs) AS given FROM e JOIN r{i - 1} q ON q.site_id = e.site_id AND q.node = e.src GROUP BY 1, 2) USING (site_id, node)
        )"""
    return out + f" SELECT site_id, node, round(rank, 6) AS rank FROM r{rounds}"


_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _plain_sql(html: str) -> str:
    """As ``plain``, but for numeric entities, which the test tables do not have."""
    out = f"regexp_replace({html}, '<[^>]*>', ' ', 'g')"
    for name, char in ENTITIES:
        out = f"regexp_replace({out}, '(?i){name}', '{char.replace(chr(39), 2 * chr(39))}', 'g')"
    return f"trim(regexp_replace({out}, '[\\x20\\x09-\\x0D]+', ' ', 'g'))"


def _dropped_sql(html: str) -> str:
    for pattern in _DROPPED:
        html = f"regexp_replace({html}, '{pattern}', ' ', 'g')"
    return html


_META_SQL = rf"""
    WITH {_P},
    b AS (SELECT *, coalesce(nullif(regexp_extract(html, '(?is)<body\b[^>]*>(.*?)</body>', 1), ''), html) AS body,
                 list_filter(regexp_extract_all(html, '(?i)<meta\b[^>]*>'), lambda x: regexp_matches(x, '(?i)name\s*=\s*["'']?description["'']?') AND regexp_matches(x, '(?i)content\s*=\s*[^\s>]'))[1] AS tag FROM p),
    s AS (SELECT *, CASE WHEN regexp_matches(body, '(?is)<main\b[^>]*>(.*?)</main>|<article\b[^>]*>(.*?)</article>')
                         THEN regexp_extract(body, '(?is)<main\b[^>]*>(.*?)</main>|<article\b[^>]*>(.*?)</article>', 1) || regexp_extract(body, '(?is)<main\b[^>]*>(.*?)</main>|<article\b[^>]*>(.*?)</article>', 2) ELSE body END AS scope FROM b),
    t AS (SELECT *, {_plain_sql(_dropped_sql("scope"))} AS visible FROM s),
    h AS (SELECT *, substring(visible, 1, {MOST_EXCERPT}) AS head FROM t),
    l AS (SELECT *, length(head) - length(string_split(head, ' ')[-1]) - 1 AS space FROM h)
    SELECT page_id, path, nullif(trim(substring({_plain_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, 1, {MOST_TITLE})), '') AS title,
           nullif(trim(substring({_plain_sql("regexp_extract(coalesce(tag, ''), '(?i)content" + chr(92) + "s*=" + chr(92) + "s*(?:" + chr(34) + "([^" + chr(34) + "]*)" + chr(34) + ")', 1)")}, 1, {MOST_DESCRIPTION})), '') AS description,
           nullif(trim(substring({_plain_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, 1, {MOST_TITLE})), '') AS h1,
           CASE WHEN length(visible) >= {LEAST_EXCERPT} THEN CASE WHEN length(visible) <= {MOST_EXCERPT} THEN visible WHEN space > {MOST_EXCERPT // 2} THEN rtrim(substring(head, 1, space)) ELSE rtrim(head) END END AS excerpt
    FROM l
"""
ORACLE_SQL = {
    "page_meta": _META_SQL,
    "url_parts": rf"""WITH {_P} SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, site_id AS host, path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, {_DEPTH} AS depth FROM p""",
    "canonical_identity": rf"""WITH {_P}, q AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, site_id, CASE WHEN length(path) > 1 AND path LIKE '%/' THEN path[:-2] ELSE path END AS path,
            array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_|gclid($|=)|fbclid($|=)|mc_|_ga($|=)|ref($|=)|source($|=)|yclid($|=)|msclkid($|=))')), '&') AS kept FROM p)
        SELECT page_id, scheme || '://' || site_id || path || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS identity FROM q""",
    "url_structure": f"WITH {_P} SELECT page_id, {_ISSUES} AS issues FROM p",
    "pagination_pages": rf"""WITH {_P} SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([0-9]{{1,6}})', 1), ''), nullif(regexp_extract(path, '/page/([0-9]{{1,6}})', 1), ''))::BIGINT AS page FROM p WHERE page IS NOT NULL""",
    "title_bounds": f"WITH {_P} SELECT page_id, length(title) AS n, CASE WHEN title = '' THEN 'missing' WHEN length(title) BETWEEN 10 AND 70 THEN 'ok' ELSE 'range' END AS verdict FROM p",
    "title_pattern": f"WITH {_P} SELECT page_id, len({_SEGMENTS}) AS segments, CASE WHEN title = '' THEN 'fail' WHEN len({_SEGMENTS}) < 2 THEN 'warn' WHEN length({_SEGMENTS}[1]) < length({_SEGMENTS}[-1]) THEN 'warn' ELSE 'pass' END AS verdict FROM p",
    "title_boilerplate": f"WITH {_P}, t AS (SELECT site_id, list_distinct({_WORDS.format('title')}) AS w, count(*) OVER (PARTITION BY site_id) AS titles FROM p WHERE title <> '') SELECT site_id, word, count(*) AS n, titles FROM (SELECT site_id, titles, unnest(w) AS word FROM t) WHERE length(word) > 1 AND titles >= 4 GROUP BY ALL HAVING count(*) >= titles * 0.8",
    "unique_titles": f"WITH {_P}, t AS (SELECT site_id, count(*) OVER (PARTITION BY site_id, title) > 1 AS same FROM p WHERE title <> ''), g AS (SELECT site_id, count(*) AS total, count_if(same) AS bad FROM t GROUP BY 1) SELECT site_id, total, bad AS offenders, {_RATIO} AS status FROM g",
    "html_weight": "SELECT page_id, octet_length(encode(html)) AS bytes, CASE WHEN octet_length(encode(html)) <= 102400 THEN 'pass' WHEN octet_length(encode(html)) <= 256000 THEN 'warn' ELSE 'fail' END AS verdict FROM pages",
    "html_lang": f"SELECT page_id, {_LANG} AS lang, regexp_matches(lower(trim({_LANG})), '^[a-z]{{2,3}}(-[a-z0-9]{{2,8}})*$') AS valid FROM pages",
    "charset_declared": f"SELECT page_id, {_CHARSET} AS charset FROM pages",
    "links_edges": f"WITH {_A} SELECT page_id, pos, href, text FROM a",
    "anchor_generic_ratio": rf"""WITH {_A}, g AS (SELECT site_id, count(*) AS links, count_if(lower(text) IN ('', 'click here', 'read more', 'here', 'more', 'link') OR regexp_matches(lower(text), '^(https?://|www\.)')) AS generic FROM a GROUP BY 1)
        SELECT *, CASE WHEN generic::DOUBLE / links < 0.1 THEN 'pass' WHEN generic::DOUBLE / links < 0.5 THEN 'warn' ELSE 'fail' END AS status FROM g""",
    "in_degree": f"WITH {_A} SELECT site_id, dst AS node, count(*) AS n FROM e GROUP BY 1, 2",
    "dead_ends": f"WITH {_A} SELECT DISTINCT site_id, path AS node FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.site_id = p.site_id AND e.src = p.path)",
    "orphans": f"WITH {_A} SELECT DISTINCT site_id, path AS node FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.site_id = p.site_id AND e.dst = p.path)",
    "bfs_depth": f"""WITH RECURSIVE {_A}, root AS (SELECT site_id, path AS node FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY {_DEPTH}, path) AS k FROM p) WHERE k = 1),
        d(site_id, node, depth) AS (SELECT site_id, node, 0::BIGINT FROM root UNION SELECT e.site_id, e.dst, d.depth + 1 FROM d JOIN e ON e.site_id = d.site_id AND e.src = d.node WHERE d.depth < 5)
        SELECT site_id, node, min(depth) AS depth FROM d GROUP BY 1, 2""",
    "link_components": f"""WITH RECURSIVE {_A}, g AS (SELECT site_id || ' ' || src AS s, site_id || ' ' || dst AS t FROM e), u AS MATERIALIZED (SELECT s, t FROM g UNION SELECT t, s FROM g),
        r(node, low) AS (SELECT DISTINCT s, s FROM u UNION SELECT u.t, r.low FROM r JOIN u ON u.s = r.node WHERE r.low < u.t)
        SELECT root, count(*) AS n FROM (SELECT node, min(low) AS root FROM r GROUP BY 1) GROUP BY 1""",
    "pagerank": _rank(50),
    "static_text": rf"""SELECT page_id, length(t) AS chars, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words, length(t) < 200 AS thin, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) < 150 AS shallow FROM (SELECT page_id, {_STRIP} AS t FROM pages)""",
    "shingle_twins": f"""WITH {_P}, w AS (SELECT site_id, page_id, {_WORDS.format(_STRIP)} AS w FROM p), s AS (SELECT site_id, page_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS x FROM w),
        n AS (SELECT page_id, count(*) AS n FROM s GROUP BY 1), b AS (SELECT a.page_id AS a, b.page_id AS b, count(*) AS shared FROM s a JOIN s b ON a.site_id = b.site_id AND a.x = b.x AND a.page_id < b.page_id GROUP BY 1, 2)
        SELECT a, b, round(shared::DOUBLE / (x.n + y.n - shared), 6) AS jaccard FROM b JOIN n x ON x.page_id = a JOIN n y ON y.page_id = b WHERE jaccard >= 0.5""",
    "title_twins": f"""WITH {_P}, w AS (SELECT site_id, page_id, title, list_distinct(list_filter({_WORDS.format('title')}, lambda x: length(x) > 1)) AS w FROM p), k AS (SELECT * FROM w WHERE len(w) >= 3)
        SELECT a.page_id AS a, b.page_id AS b, round(len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard FROM k a JOIN k b ON a.site_id = b.site_id AND a.page_id < b.page_id AND a.title <> b.title WHERE jaccard >= 0.6""",
    "check_results": f"WITH {_LITE} SELECT * FROM r",
    "family_scores": f"WITH {_LITE} SELECT * FROM fs",
    "site_scores": f"""WITH {_LITE}, t AS (SELECT site_id, floor(100 * sum({_WEIGHT} * (earned::DOUBLE / max)::DECIMAL(20,15))::DOUBLE / sum({_WEIGHT})::DOUBLE + 0.5)::BIGINT AS score FROM fs GROUP BY 1)
        SELECT site_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM t""",
    "score_rollup": f"WITH {_LITE} SELECT site_id, coalesce(family, '(all)') AS family, sum(points)::BIGINT AS earned, sum(max_points)::BIGINT AS max FROM r GROUP BY GROUPING SETS ((site_id, family), (site_id))",
}
