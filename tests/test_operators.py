"""Graphs, roll-ups, robots rules, chunks, reports."""

import random

import pytest
from pyspark.sql import functions as F

from lanternq.operators import chunker, graph, robots, rollup
from lanternq.operators.components import connected_components
from lanternq.operators.similar import similar_sets
from lanternq.plans import analytics


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 530)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert connected_components(spark.createDataFrame([(1, None), (2, 2)], "src long, dst long")).count() == 0


@pytest.mark.parametrize(("total", "bad", "want"), [(5, 0, "pass"), (5, 1, "warn"), (5, 4, "fail"), (10, 2, "warn"), (10, 3, "fail")])
def test_ratio_rollup(spark, total, bad, want):
    rows = [("s", "c", "agg", i, f"/{i}", 2 if i < bad else 0) for i in range(total)]
    got = rollup.rolled(spark.createDataFrame(rows, "site_id string, id string, rollup string, seq int, label string, severity int")).first()
    assert got["status"] == want
    assert got["detail"] == (None if not bad else ", ".join(f"/{i}" for i in range(min(bad, 3))) + (f" (+{bad - 3} more)" if bad > 3 else ""))


def test_points_and_grades(spark):
    got = spark.range(1).select(*[rollup.points(F.lit(s), F.lit(m)).alias(f"{s}{m}") for s, m in (("warn", 5), ("warn", 1), ("pass", 5), ("fail", 5))], *[rollup.grade(F.lit(x)).alias(f"g{x}") for x in (90, 89, 80, 79, 70, 69, 60, 59)]).first()
    assert list(got) == [2, 0, 5, 0, "A", "B", "B", "C", "C", "D", "D", "F"]


def test_skip_changes_no_score(spark):
    rows = [("s", "on-page", "pass", 5, 5), ("s", "security", "warn", 2, 4)]
    schema = "site_id string, family string, status string, points int, max_points int"
    a = rollup.site_scores(rollup.family_scores(spark.createDataFrame(rows, schema))).collect()
    b = rollup.site_scores(rollup.family_scores(spark.createDataFrame([*rows, ("s", "performance", "skip", 0, 9)], schema))).collect()
    assert a == b and a[0]["score"] == 82


def _graph(spark, edges, nodes):
    pages = spark.createDataFrame([("s", f"http://s/{n}", n == "a") for n in nodes], "site_id string, url string, is_home boolean")
    return pages, spark.createDataFrame([("s", f"http://s/{a}", f"http://s/{b}") for a, b in edges], "site_id string, src string, dst string")


def test_depth_and_rank(spark):
    edges, nodes = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("c", "x")], "abcd"
    pages, links = _graph(spark, edges, nodes)
    depth = {r["node"][-1]: r["depth"] for r in graph.click_depth(pages, links).collect()}
    assert depth == {"a": 0, "b": 1, "c": 1, "d": None}
    names = sorted({*nodes, *(x for e in edges for x in e)})
    rank = dict.fromkeys(names, 1 / len(names))
    for _ in range(50):
        lost = sum(rank[n] for n in names if not any(a == n for a, _ in edges))
        rank = {n: 0.15 / len(names) + 0.85 * (sum(rank[a] / sum(x == a for x, _ in edges) for a, b in edges if b == n) + lost / len(names)) for n in names}
    got = {r["node"][-1]: r["rank"] for r in graph.pagerank(pages, links).collect()}
    assert got == pytest.approx(rank)


def test_robots(spark):
    body = "User-agent: GPTBot\nUser-agent: CCBot # two\nDisallow: /\nAllow: /ok$\n\nUser-agent: *\nDisallow: /private*/x\nDisallow:\nAllow: /private\n"
    parsed = robots.rules(spark.createDataFrame([("s", body)], "site_id string, body string"))
    asked = [("gptbot", "/", True), ("GPTBot", "/ok", False), ("CCBot", "/okay", True), ("Bingbot", "/", False), ("Bingbot", "/private1/x", True), ("Bingbot", "/private", False)]
    got = robots.blocked(parsed, spark.createDataFrame([("s", a, p) for a, p, _ in asked], "site_id string, agent string, path string")).collect()
    assert {(r["agent"], r["path"]): r["blocked"] for r in got} == {(a, p): b for a, p, b in asked}


def _chunks(blocks, target):
    """The packing as a plain loop."""
    out, trail, opened, held, tokens = [], [], [], [], 0
    cost = lambda t: -(-len(t) // 4)

    def close():
        nonlocal held, tokens
        if held:
            out.append((opened, held, cost("\n\n".join(held))))
        held, tokens = [], 0

    for level, text in blocks:
        if level:
            trail = [*trail[: level - 1], text]
        if held and (cost(text) >= target or tokens + cost(text) > target):
            close()
        if not held:
            opened = list(trail)
        held = [*held, text]
        tokens += cost(text)
        if cost(text) >= target:
            close()
    close()
    return out


def test_chunker_equals_loop(spark):
    r = random.Random(3)
    blocks = [(r.choice([0, 0, 0, 1, 2, 3]), "w" * r.randrange(1, 90)) for _ in range(60)] + [(0, "z" * 900)]
    df = spark.createDataFrame([(1, blocks), (2, [])], "k int, blocks array<struct<level: int, text: string>>")
    got = [(x["headings"], x["blocks"], x["tokens"]) for x in chunker.chunks(df, 50).where("k = 1").orderBy("idx").collect()]
    assert got == _chunks(blocks, 50)


def test_rate_limit_equals_loop(spark):
    from datetime import datetime, timedelta

    r = random.Random(5)
    rows = [(i, "k", datetime(2024, 1, 1) + timedelta(seconds=r.randrange(4000))) for i in range(60)]
    got = {x["event_id"]: x["allowed"] for x in analytics.rate_limited(spark.createDataFrame(rows, "event_id long, key string, ts timestamp"), 3, 300).collect()}
    kept, want = [], {}
    for i, _, t in sorted(rows, key=lambda x: (x[2], x[0])):
        kept = [k for k in kept if k > t - timedelta(seconds=300)]
        want[i] = len(kept) < 3
        if want[i]:
            kept.append(t)
    assert got == want


def test_rate_limit_crosses_midnight(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1, 22)
    rows = [(k * 100 + i, k, start + timedelta(seconds=s)) for k in range(4) for i, s in enumerate(sorted(random.Random(k).sample(range(0, 40_000, 60), 90)))]
    rows += [(900, 9, datetime(2024, 1, 1, 23, 15)), (901, 9, datetime(2024, 1, 2, 0, 10)), (902, 9, datetime(2024, 1, 2, 0, 15)), (903, 9, datetime(2024, 1, 2, 1, 10))]
    got = {x["event_id"]: x["allowed"] for x in analytics.rate_limited(spark.createDataFrame(rows, "event_id long, key long, ts timestamp"), 1, 3600).collect()}
    kept, want = {}, {}
    for i, k, t in sorted(rows, key=lambda x: (x[2], x[0])):
        live = [x for x in kept.get(k, []) if x > t - timedelta(seconds=3600)]
        want[i] = not live
        kept[k] = [*live, t] if want[i] else live
    assert got == want
    assert [got[i] for i in (900, 901, 902, 903)] == [True, False, True, False]


def test_diff(spark):
    schema = "site_id string, id string, status string"
    a = spark.createDataFrame([("s", "x", "pass"), ("s", "y", "fail"), ("s", "z", "skip"), ("s", "w", "warn")], schema)
    b = spark.createDataFrame([("s", "x", "warn"), ("s", "y", "pass"), ("s", "z", "pass"), ("s", "w", "warn")], schema)
    assert {r["id"]: r["change"] for r in analytics.diff(a, b).collect()} == {"x": "regression", "y": "improvement", "z": "added"}


def test_recommendations(spark):
    rows = [("s", "csp", "security", "fail", 0, 3, "x"), ("s", "content-depth", "llm-content", "warn", 2, 5, "on /a, /b."), ("s", "https", "security", "pass", 5, 5, "")]
    recs = analytics.recommendations(spark.createDataFrame(rows, "site_id string, id string, family string, status string, points int, max_points int, detail string"))
    assert [(r["id"], r["impact"], r["effort"]) for r in recs.orderBy("rank").collect()] == [("csp", 3, "quick"), ("content-depth", 3, "moderate")]
    assert [r["id"] for r in analytics.top_fixes(recs, 1).collect()] == ["content-depth"]
    assert recs.where("id = 'content-depth'").select(analytics.offenders(F.col("detail"))).first()[0] == ["/a", "/b"]


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8])
def test_similar_sets_equal_all_pairs(spark, threshold):
    r = random.Random(threshold)
    rows = []
    for k in range(120):
        base = set(r.sample(range(60), r.randrange(1, 14))) if k % 4 == 0 or k < 9 else set(rows[k - 2][2])
        own = {x for x in base if r.random() < 0.98} | {1000, 1001}  # what all have in common
        rows.append(("s" if k % 2 else "t", k, sorted(own)))
    rows.append(("s", 999, []))
    want = {}
    for i, (g, a, x) in enumerate(rows):
        for h, b, y in rows[i + 1 :]:
            both = len(set(x) & set(y))
            if g == h and both and both / len(set(x) | set(y)) >= threshold:
                want[g, a, b] = both / len(set(x) | set(y))
    df = spark.createDataFrame(rows, "site string, k long, v array<long>")
    got = {(x["site"], x["a"], x["b"]): x["jaccard"] for x in similar_sets(df, "site", "k", "v", threshold).where(F.col("jaccard") >= threshold).collect()}
    assert got == pytest.approx(want) and len(want) > 10
