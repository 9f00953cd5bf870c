"""The tables that an audit reads. A missing table makes the checks that need it skip."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ...functions import urls
from ...sources.dom import page_features
from ...sources.jsonld import with_graph
from ...shared import parked

PAGES = "site_id string, seq int, url string, path string, status int, headers map<string,string>, body string"
RESOURCES = "site_id string, url string, path string, final_url string, status int, content_type string, headers map<string,string>, body string"
SITEMAP = "site_id string, pos int, loc string, lastmod string"
HOPS = "site_id string, chain_id string, hop int, url string, status int, location string"
UA_PROBES = "site_id string, path string, ua_label string, is_ai boolean, attempt int, status int, final_url string, body string"
TRANSPORT = "site_id string, alpn string, tls_version string, cipher string, skip_reason string"
PSI = "site_id string, strategy string, lcp double, cls double, inp double, ttfb double, overall string, perf_score double, lab_lcp double, lab_cls double, fcp double, tbt double, srt double"
EXTERNAL = "site_id string, url string, status int, body string"


@dataclass
class Sites:
    """pages as PAGES (body is HTML; site_id, url and body suffice, the rest is derived); the others as their schemas above."""

    pages: DataFrame
    resources: DataFrame | None = None
    sitemap: DataFrame | None = None
    hops: DataFrame | None = None
    ua_probes: DataFrame | None = None
    transport: DataFrame | None = None
    psi: DataFrame | None = None
    external: DataFrame | None = None
    as_of: str = "2026-01-01T00:00:00Z"

    def table(self, name: str, schema: str) -> DataFrame:
        found = getattr(self, name)
        return found if found is not None else self.pages.sparkSession.createDataFrame([], schema)


def crawled(pages: DataFrame) -> DataFrame:
    """Raw pages (url, html, ...) as PAGES: one site per host, ordered by path depth, then URL; status 200 and no headers unless the columns exist."""
    have = set(pages.columns)
    out = pages.select(
        (F.col("site_id") if "site_id" in have else urls.host(F.col("url"))).alias("site_id"), "url", F.coalesce(F.nullif(urls.path(F.col("url")), F.lit("")), F.lit("/")).alias("path"),
        (F.col("status") if "status" in have else F.lit(200)).cast("int").alias("status"), (F.col("headers") if "headers" in have else F.create_map().cast("map<string,string>")).alias("headers"), F.col("html" if "html" in have else "body").alias("body"),
    )
    order = Window.partitionBy("site_id").orderBy(urls.depth(F.col("path")), "url")
    return out.withColumn("seq", F.row_number().over(order)).select(*[x.split()[0] for x in PAGES.split(", ")])


def featured(pages: DataFrame) -> DataFrame:
    """Pages with all features, parsed once and parked. The home page is '/', else the first page."""
    rows = page_features(pages.withColumn("html_bytes", F.coalesce(F.octet_length("body"), F.lit(0)))).withColumn("host", urls.host(F.col("url"))).withColumn("origin", urls.origin(F.col("url")))
    first = Window.partitionBy("site_id").orderBy((F.col("path") != "/").cast("int"), "seq")
    return parked(with_graph(rows.withColumn("is_home", F.row_number().over(first) == 1)), "features")


def sites_of(spark: SparkSession, pages: DataFrame, **tables: DataFrame) -> Sites:
    return Sites(featured(crawled(pages)), **tables)
