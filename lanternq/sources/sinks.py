"""Sinks: reports of sites as text in the usual formats, graph exports, generated site files. Each is a DataFrame of (site_id, text), written with ``write_text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
ICON = {"pass": "[x]", "warn": "[~]", "fail": "[ ]", "skip": "[-]"}
LEVEL = {"fail": "error", "warn": "warning"}
COLOR = {"A": "brightgreen", "B": "green", "C": "yellow", "D": "orange", "F": "red"}
INDEXNOW = 100


def _map(d: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[key]


def _lines(rows: DataFrame, order: str, line: Column) -> Column:
    """The lines of a site in order; a site has at most one line for each check."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")


def escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def json_report(results: DataFrame, scores: DataFrame) -> DataFrame:
    checks = results.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "family", "evidence", "status", "points", "max_points", "detail"))).alias("results"))
    return scores.join(checks, "site_id").select("site_id", F.to_json(F.struct("site_id", "score", "grade", "results")).alias("text"))


def markdown(results: DataFrame, scores: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- "), _map(ICON, c("status")), F.lit(" `"), c("id"), F.lit("` "), c("points").cast("string"), F.lit("/"), c("max_points").cast("string"), F.coalesce(F.concat(F.lit(": "), c("detail")), F.lit("")))
    body = results.groupBy("site_id").agg(_lines(results, "ord", line).alias("body"))
    return scores.join(body, "site_id").select("site_id", F.concat(F.lit("# "), c("site_id"), F.lit("\n\nScore: "), c("score").cast("string"), F.lit(" ("), c("grade"), F.lit(")\n\n"), c("body"), F.lit("\n")).alias("text"))


def terminal(results: DataFrame, scores: DataFrame) -> DataFrame:
    line = F.concat(F.rpad(F.upper("status"), 5, " "), F.rpad("id", 30, " "), F.coalesce("detail", F.lit("")))
    body = results.where("status <> 'skip'").groupBy("site_id").agg(_lines(results, "ord", line).alias("body"))
    return scores.join(body, "site_id", "left").select("site_id", F.concat_ws("\n", F.concat_ws(" ", "site_id", c("score").cast("string"), "grade"), "body").alias("text"))


def html(results: DataFrame, scores: DataFrame) -> DataFrame:
    line = F.concat(F.lit('<tr class="'), c("status"), F.lit('"><td>'), escaped(c("id")), F.lit("</td><td>"), c("status"), F.lit("</td><td>"), escaped(c("detail")), F.lit("</td></tr>"))
    body = results.groupBy("site_id").agg(_lines(results, "ord", line).alias("body"))
    head = F.concat(F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>'), escaped(c("site_id")), F.lit("</title></head><body><h1>"), escaped(c("site_id")), F.lit(": "), c("score").cast("string"), F.lit(" "), c("grade"), F.lit("</h1><table>"))
    return scores.join(body, "site_id").select("site_id", F.concat(head, "body", F.lit("</table></body></html>")).alias("text"))


def sarif(results: DataFrame) -> DataFrame:
    """Failed and warned checks as static analysis results."""
    item = F.struct(c("id").alias("ruleId"), _map(LEVEL, c("status")).alias("level"), F.struct(F.coalesce("detail", c("id")).alias("text")).alias("message"))
    runs = results.where("status IN ('fail', 'warn')").groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("ord", item.alias("r")))).alias("r"))
    run = F.struct(F.struct(F.struct(F.lit("lanternq").alias("name")).alias("driver")).alias("tool"), F.transform("r", lambda x: x["r"]).alias("results"))
    return runs.select("site_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("text"))


def junit(results: DataFrame) -> DataFrame:
    inner = F.when(c("status") == "fail", F.concat(F.lit('<failure message="'), escaped(c("detail")), F.lit('"/>'))).when(c("status") == "skip", "<skipped/>").otherwise("")
    line = F.concat(F.lit('<testcase classname="'), c("family"), F.lit('" name="'), c("id"), F.lit('">'), inner, F.lit("</testcase>"))
    got = results.groupBy("site_id").agg(F.count("*").alias("n"), F.count_if(c("status") == "fail").alias("bad"), F.count_if(c("status") == "skip").alias("skipped"), _lines(results, "ord", line).alias("body"))
    return got.select("site_id", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name="'), escaped(c("site_id")), F.lit('" tests="'), c("n").cast("string"), F.lit('" failures="'), c("bad").cast("string"), F.lit('" skipped="'), c("skipped").cast("string"), F.lit('">\n'), "body", F.lit("\n</testsuite>\n")).alias("text"))


def badge(scores: DataFrame) -> DataFrame:
    color = _map(COLOR, c("grade"))
    return scores.select("site_id", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="110" height="20"><rect width="110" height="20" fill="'), color, F.lit('"/><text x="8" y="14">score '), c("score").cast("string"), F.lit(" "), c("grade"), F.lit("</text></svg>")).alias("text"))


def graph_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entity graphs (site_id, id, name) and (site_id, src, dst, property) in DOT, a line for each row, so that a graph of any size can be written."""
    n = nodes.select("site_id", F.lit(0).alias("o"), F.concat(F.lit('  "'), "id", F.lit('" [label="'), F.coalesce("name", F.lit("")), F.lit('"];')).alias("text"))
    e = edges.select("site_id", F.lit(1).alias("o"), F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), "property", F.lit('"];')).alias("text"))
    return n.unionAll(e)


def graph_mermaid(edges: DataFrame) -> DataFrame:
    return edges.select("site_id", F.concat(F.lit("  "), F.md5("src"), F.lit("["), "src", F.lit("] -->|"), "property", F.lit("| "), F.md5("dst"), F.lit("["), "dst", F.lit("]")).alias("text"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("site_id", F.to_json(F.struct("id", "name")).alias("text")).unionAll(edges.select("site_id", F.to_json(F.struct("src", "dst", "property")).alias("text")))


# --- generated site files: (site_id, seq, url, title, description, excerpt) in, one file per site out ------------------------------


def robots_txt(sites: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    allow = "\n".join(f"User-agent: {a}\nAllow: /\n" for a in agents)
    return sites.select("site_id", F.concat(F.lit(allow + "\nUser-agent: *\nAllow: /\n\nSitemap: https://"), "site_id", F.lit("/sitemap.xml\n")).alias("text"))


def llms_txt(pages: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- ["), F.coalesce("title", c("url")), F.lit("]("), "url", F.lit(")"), F.coalesce(F.concat(F.lit(": "), "description"), F.lit("")))
    got = pages.groupBy("site_id").agg(_lines(pages, "seq", line).alias("body"), F.min_by("title", "seq").alias("name"), F.min_by("description", "seq").alias("what"))
    return got.select("site_id", F.concat(F.lit("# "), F.coalesce("name", c("site_id")), F.lit("\n\n> "), F.coalesce("what", F.lit("")), F.lit("\n\n## Pages\n\n"), "body", F.lit("\n")).alias("text"))


def llms_full_txt(pages: DataFrame) -> DataFrame:
    part = F.concat(F.lit("## "), F.coalesce("title", c("url")), F.lit("\n\n"), F.coalesce("excerpt", F.lit("")), F.lit("\n"))
    got = pages.groupBy("site_id").agg(_lines(pages, "seq", part).alias("body"))
    return got.select("site_id", F.concat(F.lit("# "), "site_id", F.lit("\n\n"), "body").alias("text"))


def sitemap_xml(pages: DataFrame) -> DataFrame:
    got = pages.groupBy("site_id").agg(_lines(pages, "seq", F.concat(F.lit("  <url><loc>"), escaped(c("url")), F.lit("</loc></url>"))).alias("body"))
    return got.select("site_id", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'), "body", F.lit("\n</urlset>\n")).alias("text"))


def ai_json(pages: DataFrame) -> DataFrame:
    got = pages.groupBy("site_id").agg(F.min_by("title", "seq").alias("name"), F.min_by("description", "seq").alias("description"))
    return got.select("site_id", F.to_json(F.struct("name", "description", F.concat(F.lit("https://"), "site_id", F.lit("/llms.txt")).alias("llms"))).alias("text"))


def jsonld_stub(pages: DataFrame) -> DataFrame:
    node = F.create_map(F.lit("@context"), F.lit("https://schema.org"), F.lit("@type"), F.lit("WebPage"), F.lit("url"), c("url"), F.lit("name"), F.coalesce("title", F.lit("")))
    return pages.select("site_id", F.to_json(node).alias("text"))


def indexnow(pages: DataFrame, key: str) -> DataFrame:
    """Payload of at most 100 URLs of the site's own host."""
    own = pages.where(F.lower(F.regexp_extract("url", "^https?://([^/?#]*)", 1)) == c("site_id"))
    got = own.groupBy("site_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("seq", "url"))), 1, INDEXNOW).alias("u"))
    return got.select("site_id", F.to_json(F.struct(c("site_id").alias("host"), F.lit(key).alias("key"), F.transform("u", lambda x: x["url"]).alias("urlList"))).alias("text"))


def write_text(rows: DataFrame, path: str) -> None:
    """One folder for each site, written by Spark."""
    rows.select("site_id", F.col("text").alias("value")).write.partitionBy("site_id").mode("overwrite").text(path)
