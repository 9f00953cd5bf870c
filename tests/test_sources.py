"""Sampling, vitals payloads, translations, the DOM pass and the HTTP reader."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lanternq.sources import crawl
from lanternq.sources.dom import features, resolve, srcset_urls


def test_sample(spark):
    homes = spark.createDataFrame([("s", "https://s.com/"), ("t", "https://t.com/")], "site_id string, url string")
    maps = spark.createDataFrame([("s", f"https://s.com/{x}", 0) for x in ("b/c", "a", "a/", "i.png", "z?utm_source=1", "z")] + [("s", "https://other.com/x", 0), ("s", "https://s.com/late", 2)], "site_id string, url string, map_no int")
    links = spark.createDataFrame([("s", "https://s.com/link"), ("t", "https://t.com/k")], "site_id string, url string")
    got = {(r["site_id"], r["seq"]): (r["url"], r["source"]) for r in crawl.sample_pages(homes, maps, links, 4).collect()}
    assert [got["s", i][0] for i in (1, 2, 3, 4)] == ["https://s.com/", "https://s.com/a", "https://s.com/z", "https://s.com/b/c"]
    assert got["t", 2] == ("https://t.com/k", "links")


def test_vitals(spark):
    payload = {"loadingExperience": {"metrics": {"CUMULATIVE_LAYOUT_SHIFT_SCORE": {"percentile": 12}, "LARGEST_CONTENTFUL_PAINT_MS": {"percentile": 2500}}, "overall_category": "FAST"}, "lighthouseResult": {"categories": {"performance": {"score": 0.9}}, "audits": {"total-blocking-time": {"numericValue": 100.5}}}}
    got = crawl.parse_psi(spark.createDataFrame([("s", "mobile", json.dumps(payload)), ("t", "mobile", "broken")], "site_id string, strategy string, json string")).orderBy("site_id").collect()
    assert (got[0]["lcp"], got[0]["cls"], got[0]["overall"], got[0]["perf_score"], got[0]["tbt"]) == (2500, 0.12, "FAST", 0.9, 100.5)
    assert got[1]["lcp"] is None


def test_translation(spark):
    rows = spark.createDataFrame([("{0} of {1} pages", ["2", "3"]), ("none", [])], "template string, params array<string>")
    words = spark.createDataFrame([("{0} of {1} pages", "{1} pages, dont {0}")], "template string, translation string")
    assert {r["message"] for r in crawl.localized(rows, words).collect()} == {"3 pages, dont 2", "none"}


@pytest.mark.parametrize(
    ("href", "want"), [("/a?b#c", "http://x.com/a?b"), ("HTTP://Y.com:80", "http://y.com/"), ("mailto:a", None), ("//z.com/q", "http://z.com/q"), ("../up", "http://x.com/up"), (None, "http://x.com/d/e"), ("http://[bad", None)]
)
def test_resolve(href, want):
    assert resolve(href, "http://x.com/d/e") == want


def test_srcset():
    assert srcset_urls("a.png 1x, b,c.png 2x, d.png") == ["a.png", "b,c.png", "d.png"]
    assert srcset_urls(None) == []


def test_lenient_html():
    f = features("<title>x</title><p>a<p>b<b>c<script>var t='</p>'</script><ul><li>1<li>2</ul><table><tr><td>q<td>r</table><img src=i.png", "http://x/")
    assert f["paragraphs"][0] == "a"
    assert [b["text"] for b in f["blocks"]][-1:] == ["q | r"]
    assert "var t" not in f["main_text"]
    assert features(None, None)["main_words"] == 0


class Site(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        moved = self.path == "/old"
        self.send_response(301 if moved else 200)
        self.send_header("Location", "/new") if moved else self.send_header("Content-Type", "text/plain; charset=latin-1")
        self.end_headers()
        self.wfile.write("é".encode("latin-1"))

    def log_message(self, *_):
        pass


def test_crawl(spark):
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/old"
    spark.dataSource.register(crawl.CrawlSource)
    got = spark.read.format("crawl").option("urls", url).option("allowPrivate", "true").load().first()
    assert (got["status"], got["body"], got["final_url"][-4:], [h["status"] for h in got["hops"]]) == (200, "é", "/new", [301, 200])
    assert spark.read.format("crawl").option("urls", url).load().first()["status"] is None
    server.shutdown()
