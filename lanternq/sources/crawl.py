"""Sources of an audit besides Parquet: a guarded HTTP reader, page sampling, vitals payloads, saved reports and histories."""

from __future__ import annotations

import re
import socket
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import urls as U

BODY_BYTES, TIMEOUT, HOPS = 5 << 20, 10, 5
PAGES_PER_SITE = 10
CHILD_MAPS = 2

_VITAL = "struct<percentile: double, category: string>"
PSI = f"loadingExperience struct<metrics: struct<LARGEST_CONTENTFUL_PAINT_MS: {_VITAL}, CUMULATIVE_LAYOUT_SHIFT_SCORE: {_VITAL}, INTERACTION_TO_NEXT_PAINT: {_VITAL}, EXPERIMENTAL_TIME_TO_FIRST_BYTE: {_VITAL}>, overall_category: string>, lighthouseResult struct<categories: struct<performance: struct<score: double>>, audits: map<string, struct<numericValue: double>>>"
HISTORY = "date timestamp, url string, score int, families map<string,int>"


class CrawlSource(DataSource):
    """``spark.read.format("crawl").option("urls", "https://a/,https://b/")``: one row for each URL: url, final_url, status, content_type, headers, body, hops.

    Redirects are followed by hand, at most five; every host is resolved first and refused if any of its addresses is private, unless ``allowPrivate`` is true. Bodies are cut off at
    5 MB. What cannot be fetched has a null status. URLs of one host share a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> str:
        return "url string, final_url string, status int, content_type string, headers map<string,string>, body string, hops array<struct<url: string, status: int, location: string>>"

    def reader(self, schema: object) -> DataSourceReader:
        return CrawlReader(self.options)


class HostPartition(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class CrawlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in re.split(r"[\s,]+", options.get("urls", "")) if u]
        self.agent = options.get("userAgent", "Mozilla/5.0 (compatible; lanternq)")
        self.private = options.get("allowPrivate", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(urlsplit(u).netloc.lower(), []).append(u)
        return [HostPartition(x) for x in hosts.values()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in partition.urls:
            yield self.fetch(url)

    def allowed(self, host: str | None, port: int) -> str | None:
        """The address to connect to; null if the host has none or a forbidden one."""
        from ipaddress import ip_address

        try:
            found = [x[4][0] for x in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)]
        except OSError:
            return None
        if not self.private and any(not ip_address(a.partition("%")[0]).is_global for a in found):
            return None
        return found[0] if found else None

    def fetch(self, url: str) -> tuple:
        import http.client
        import ssl
        from urllib.parse import urljoin

        hops, at = [], url
        for _ in range(HOPS + 1):
            u = urlsplit(at)
            port = u.port or (443 if u.scheme == "https" else 80)
            address = self.allowed(u.hostname, port) if u.scheme in ("http", "https") else None
            if address is None:
                return url, at, None, None, {}, None, hops
            try:
                # Connects to the address that was checked, whatever the name resolves to by now.
                sock = socket.create_connection((address, port), TIMEOUT)
                if u.scheme == "https":
                    sock = ssl.create_default_context().wrap_socket(sock, server_hostname=u.hostname)
                connection = http.client.HTTPConnection(u.hostname, port, timeout=TIMEOUT)
                connection.sock = sock
                connection.request("GET", (u.path or "/") + (f"?{u.query}" if u.query else ""), headers={"User-Agent": self.agent})
                got = connection.getresponse()
                headers = {k.lower(): v for k, v in got.getheaders()}
                data = got.read(BODY_BYTES)
                connection.close()
            except (OSError, http.client.HTTPException):
                return url, at, None, None, {}, None, hops
            hops.append((at, got.status, headers.get("location")))
            if 300 <= got.status < 400 and headers.get("location"):
                at = urljoin(at, headers["location"])
                continue
            kind = headers.get("content-type", "")
            charset = (re.search(r"charset=\"?([\w-]+)", kind) or [None, "utf-8"])[1]
            try:
                body = data.decode(charset, "replace")
            except LookupError:
                body = data.decode("utf-8", "replace")
            return url, at, got.status, kind, headers, body, hops
        return url, at, None, None, {}, None, hops


def sample_pages(homes: DataFrame, sitemap: DataFrame, links: DataFrame, most: int = PAGES_PER_SITE) -> DataFrame:
    """(site_id, seq, url, source): the pages to audit. homes and links: (site_id, url); sitemap: (site_id, url, map_no).

    Candidates come from the sitemap (of an index, its first two children), else from the home page's links: same host, content, no files. They are ordered by path depth, then URL, the home
    page first, each identity once, at most ``most`` of a site.
    """
    listed = sitemap.where(F.col("map_no") < CHILD_MAPS).select("site_id", "url", F.lit("sitemap").alias("source"))
    linked = links.join(listed.select("site_id").distinct(), "site_id", "left_anti").select("site_id", "url", F.lit("links").alias("source"))
    home = homes.select("site_id", "url", F.lit("home").alias("source"))
    hosts = homes.select("site_id", U.host(F.col("url")).alias("host"))
    rows = home.unionAll(listed).unionAll(linked).join(hosts, "site_id").where((U.host(F.col("url")) == F.col("host")) & U.is_content_path(U.path(F.col("url"))))
    rank = F.when(F.col("source") == "home", 0).otherwise(1)
    once = rows.withColumn("k", F.row_number().over(Window.partitionBy("site_id", U.canonical_identity(F.col("url"))).orderBy(rank, "url"))).where("k = 1")
    order = Window.partitionBy("site_id").orderBy(rank, U.depth(U.path(F.col("url"))), "url")
    return once.withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= most).select("site_id", "seq", "url", "source")


def parse_psi(payloads: DataFrame) -> DataFrame:
    """(site_id, strategy, json) as the vitals table; the layout shift percentile comes in hundredths."""
    p = F.from_json("json", PSI)
    field = lambda x: F.col(f"p.loadingExperience.metrics.{x}.percentile")
    lab: Column = F.col("p.lighthouseResult.audits")
    audit = lambda x: lab[x]["numericValue"]
    return payloads.select("site_id", "strategy", p.alias("p")).select(
        "site_id", "strategy", field("LARGEST_CONTENTFUL_PAINT_MS").alias("lcp"), (field("CUMULATIVE_LAYOUT_SHIFT_SCORE") / 100).alias("cls"), field("INTERACTION_TO_NEXT_PAINT").alias("inp"), field("EXPERIMENTAL_TIME_TO_FIRST_BYTE").alias("ttfb"),
        F.col("p.loadingExperience.overall_category").alias("overall"), F.col("p.lighthouseResult.categories.performance.score").alias("perf_score"), audit("largest-contentful-paint").alias("lab_lcp"), audit("cumulative-layout-shift").alias("lab_cls"),
        audit("first-contentful-paint").alias("fcp"), audit("total-blocking-time").alias("tbt"), audit("server-response-time").alias("srt"),
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Check results of saved JSON reports (as ``sinks.json_report`` writes them)."""
    row = "site_id string, score int, grade string, results array<struct<ord: int, id: string, family: string, evidence: string, status: string, points: int, max_points: int, detail: string>>"
    return spark.read.schema(row).json(path).select("site_id", "score", "grade", F.explode("results").alias("r")).select("site_id", "score", "grade", "r.*")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Saved history entries; those without a date, a URL or a score are dropped."""
    return spark.read.schema(HISTORY).option("multiLine", True).json(path).where("date IS NOT NULL AND url IS NOT NULL AND score IS NOT NULL")


def localized(results: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``message`` of (template, params) in another language: dictionary (template, translation); ``{i}`` is replaced by the i-th parameter."""
    said = F.coalesce("translation", "template")
    filled = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size("params") - 1, F.lit(0))), said, lambda s, i: F.replace(s, F.concat(F.lit("{"), i.cast("string"), F.lit("}")), F.coalesce(F.get("params", i), F.lit(""))))
    return results.join(dictionary, "template", "left").withColumn("message", filled).drop("translation")
