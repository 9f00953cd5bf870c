"""Reporting operators over results: diff, comparison, recommendations, axes, projection, history, usage statistics, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rollup
from ..sources.tables import table

c = F.col
# Axes, the checks of the trust lens, effort by family and by check, the cost of an effort.
AXES = {"reachable": ("ai-access", "technical-seo"), "understood": ("llm-content", "structured-data", "on-page"), "usable": ("performance", "accessibility", "security")}
TRUST = ("content-author-eeat", "content-freshness", "freshness-coherence", "sameas-verified", "outbound-citations")
FAMILY_EFFORT = {"ai-access": "quick", "llm-content": "moderate", "structured-data": "moderate", "technical-seo": "quick", "on-page": "quick", "performance": "involved", "accessibility": "quick", "security": "quick"}
EFFORT = {
    "moderate": "content-depth content-freshness content-lead-answer content-readability content-uniqueness content-author-eeat answer-headings about-contact nap-consistency extractable-structure broken-internal-links redirect-chains custom-404 pagination-canonical internal-linking headings-outline img-dimensions img-next-gen topical-focus anchor-target-profile internal-link-context outbound-link-health",
    "involved": "content-without-js keyword-cannibalization",
    "quick": "http-protocol cdn-edge-cache open-graph asset-caching resource-hints text-compression",
}
COST = {"quick": 1, "moderate": 2, "involved": 4}
HISTORY = 500
RANKS = {"pass": 0, "warn": 1, "fail": 2}


def _map(d: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[key]


def effort_of(check: Column, family: Column) -> Column:
    return F.coalesce(_map({k: e for e, ks in EFFORT.items() for k in ks.split()}, check), _map(FAMILY_EFFORT, family))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(site_id, id, before, after, change) of checks whose status differs; a skip is as good as absent."""
    a = before.where("status <> 'skip'").select("site_id", "id", c("status").alias("before"))
    b = after.where("status <> 'skip'").select("site_id", "id", c("status").alias("after"))
    both = a.join(b, ["site_id", "id"], "full_outer").where("NOT (before <=> after)")
    change = F.when(c("before").isNull(), "added").when(c("after").isNull(), "removed").when(_map(RANKS, c("after")) > _map(RANKS, c("before")), "regression").otherwise("improvement")
    return both.withColumn("change", change)


def family_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.select("site_id", "family", c("score").alias("before")), after.select("site_id", "family", c("score").alias("after"))
    return a.join(b, ["site_id", "family"], "full_outer").withColumn("delta", c("after") - c("before"))


def regressed(before: DataFrame, after: DataFrame, tolerance: int = 0) -> DataFrame:
    """Sites whose score fell by more than ``tolerance``."""
    return before.select("site_id", c("score").alias("before")).join(after.select("site_id", "score"), "site_id").where(c("score") < c("before") - tolerance)


def compare(families: DataFrame, sites: list[str]) -> DataFrame:
    """Families by site (columns), the leaders of each and how far the first site trails the best other one."""
    wide = families.where(c("site_id").isin(*sites)).groupBy("family").pivot("site_id", sites).agg(F.first("score"))
    best = F.greatest(*[F.col(f"`{x}`") for x in sites], F.lit(None).cast("int"))
    others = F.greatest(*[F.col(f"`{x}`") for x in sites[1:]], F.lit(None).cast("int"))
    leaders = F.array_join(F.filter(F.array(*[F.when(F.col(f"`{x}`") == best, F.lit(x)) for x in sites]), lambda x: x.isNotNull()), ",")
    return wide.withColumn("leaders", leaders).withColumn("gap", F.greatest(others - F.col(f"`{sites[0]}`"), F.lit(0)))


def offenders(message: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(r"https?://[^\s,;)\"'<]+|(?<![\w/.-])/[\w./-]*"), F.lit(0))
    return F.slice(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "[.,;:)]+$", ""))), 1, 6)


def recommendations(results: DataFrame) -> DataFrame:
    """Failed and warned checks with recoverable points, weighted points, effort and a rank (fails first, then by weight)."""
    hit = results.where("status IN ('fail', 'warn')").withColumn("impact", c("max_points") - c("points"))
    hit = hit.withColumn("weighted", c("impact") * rollup.weight_of(c("family"))).withColumn("effort", effort_of(c("id"), c("family")))
    order = Window.partitionBy("site_id").orderBy("status", F.desc("weighted"), "id")
    return hit.withColumn("rank", F.row_number().over(order))


def top_fixes(recs: DataFrame, n: int = 5) -> DataFrame:
    """The n best ratios of weighted points to effort."""
    order = Window.partitionBy("site_id").orderBy(F.desc(c("weighted") / _map(COST, c("effort"))), F.desc("weighted"), "status", "id")
    return recs.withColumn("place", F.row_number().over(order)).where(c("place") <= n)


def axis_scores(families: DataFrame) -> DataFrame:
    """(site_id, axis, score); an axis all of whose families skipped has no score."""
    axis = _map({f: a for a, fs in AXES.items() for f in fs}, c("family"))
    got = families.groupBy("site_id", axis.alias("axis")).agg(rollup.blended(families).alias("score"))
    grid = families.select("site_id").distinct().withColumn("axis", F.explode(F.array(*[F.lit(a) for a in AXES])))
    return grid.join(got, ["site_id", "axis"], "left")


def trust_lens(results: DataFrame) -> DataFrame:
    got = results.where(c("id").isin(*TRUST) & (c("status") != "skip")).groupBy("site_id").agg(F.sum("points").alias("p"), F.sum("max_points").alias("m"), F.sort_array(F.collect_list("id")).alias("ids"))
    return got.select("site_id", F.when(c("m") > 0, rollup.js_round(100 * c("p") / c("m"))).alias("score"), "ids")


def project_score(families: DataFrame, recs: DataFrame) -> DataFrame:
    """Score if the recommendations were carried out: each family gains their points, up to its maximum."""
    gain = recs.groupBy("site_id", "family").agg(F.sum("impact").alias("gain"))
    wide = families.join(gain, ["site_id", "family"], "left")
    return wide.groupBy("site_id").agg(rollup.blended(wide, earned=F.least(c("max"), c("earned") + F.coalesce("gain", F.lit(0)))).alias("score"))


def verdict(axes: DataFrame) -> DataFrame:
    """(site_id, weakest, sentence): what to say first about a site."""
    low = axes.where("score IS NOT NULL").groupBy("site_id").agg(F.min_by("axis", F.struct("score", "axis")).alias("weakest"), F.min("score").alias("low"), F.max("score").alias("high"))
    said = F.when(c("low") >= 80, "strong throughout").when(c("high") < 50, "weak throughout").when(c("high") - c("low") < 10, "even").otherwise(F.concat(F.lit("held back by: "), c("weakest")))
    return low.select("site_id", "weakest", said.alias("sentence"))


def capped_history(entries: DataFrame, most: int = HISTORY) -> DataFrame:
    """The last entries of each URL, oldest first; entries without a date or score are dropped."""
    last = Window.partitionBy("url").orderBy(F.desc("date"))
    return entries.where("date IS NOT NULL AND score IS NOT NULL").withColumn("__k", F.row_number().over(last)).where(c("__k") <= most).drop("__k")


def domain_history(events: DataFrame) -> DataFrame:
    """Events with the change of the domain's score since its last one."""
    order = Window.partitionBy("domain").orderBy("ts", "event_id")
    return events.withColumn("delta", c("score") - F.lag("score").over(order))


def usage_stats(events: DataFrame, as_of: Column) -> DataFrame:
    """One row: totals, last 7 and 30 days, mean (one decimal), exact median, distinct domains and visitors, grades."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp("ts")
    grade = rollup.grade(c("score"))
    return events.agg(
        F.count("*").alias("total"), F.count_if((age >= 0) & (age < 7 * 86400)).alias("last_7d"), F.count_if((age >= 0) & (age < 30 * 86400)).alias("last_30d"), (F.floor(F.avg("score") * 10 + 0.5) / 10).alias("mean"), F.median("score").alias("median"),
        F.count_distinct("domain").alias("domains"), F.count_distinct("visitor").alias("visitors"), *[F.count_if(grade == g).alias(f"grade_{g.lower()}") for g in "ABCDF"],
    )


def top_domains(events: DataFrame, n: int = 20) -> DataFrame:
    return events.groupBy("domain").agg(F.count("*").alias("n"), F.max("ts").alias("last")).orderBy(F.desc("n"), F.desc("last"), "domain").limit(n)


def rate_limited(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Events with ``allowed``: whether fewer than ``limit`` allowed events of the same key lie in the last ``seconds``. Denied events do not count, so each key is a fold over its events in order."""
    order = F.array_sort(F.collect_list(F.struct(F.unix_micros("ts").alias("t"), c("event_id"))))
    state = "struct<kept: array<bigint>, out: array<struct<event_id: bigint, allowed: boolean>>>"
    start = F.from_json(F.lit('{"kept":[],"out":[]}'), state)

    def step(s: Column, e: Column) -> Column:
        live = F.filter(s["kept"], lambda t: t > e["t"] - seconds * 1_000_000)
        ok = F.size(live) < limit
        return F.struct(F.when(ok, F.concat(live, F.array(e["t"]))).otherwise(live).alias("kept"), F.concat(s["out"], F.array(F.struct(e["event_id"].cast("bigint").alias("event_id"), ok.alias("allowed")))).alias("out")).cast(state)

    # A key's events are cut only after a gap of at least the window, where no allowed event is live, so each run is a fold of its own from an empty state.
    by_key = Window.partitionBy("key").orderBy("ts", "event_id")
    t = F.unix_micros("ts")
    new = F.coalesce((t - F.lag(t).over(by_key) >= seconds * 1_000_000).cast("int"), F.lit(1))
    runs = events.select("key", "ts", "event_id", new.alias("new")).withColumn("run", F.sum("new").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    folded = runs.groupBy("key", "run").agg(F.aggregate(order, start, step, lambda s: s["out"]).alias("o"))
    return folded.select("key", F.explode("o").alias("o")).select("key", "o.event_id", "o.allowed")


def sessions(events: DataFrame, gap: int = 1800) -> DataFrame:
    """(visitor, session, n, first, last): runs of events no more than ``gap`` seconds apart."""
    order = Window.partitionBy("visitor").orderBy("ts", "event_id")
    new = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) > gap * 1_000_000).cast("int"), F.lit(1))
    rows = events.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("visitor", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


# --- queries over the event table: user as domain and visitor, type as kind, value as score ---------------------------------


def _events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select("event_id", c("ts").cast("timestamp").alias("ts"), F.concat(F.lit("d"), (c("user_id") % 37).cast("string")).alias("domain"), c("user_id").alias("visitor"), c("event_type").alias("kind"), F.least(c("value"), F.lit(100.0)).alias("score"), F.get_json_object("props", "$.k").cast("bigint").alias("duration"))


def stats_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return usage_stats(_events(spark, folder), F.lit("2024-01-31 00:00:00").cast("timestamp"))


def stats_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).groupBy("kind").agg(F.count("*").alias("n"), F.sum("duration").alias("duration"), F.round(F.median("score"), 6).alias("median"))


def stats_top_domains(spark: SparkSession, folder: str) -> DataFrame:
    return top_domains(_events(spark, folder)).select("domain", "n", F.unix_micros("last").alias("last_us"))


def stats_domain_history(spark: SparkSession, folder: str) -> DataFrame:
    return domain_history(_events(spark, folder)).select("event_id", "domain", F.round("delta", 6).alias("delta"))


def stats_grades(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).groupBy(rollup.grade(c("score")).alias("grade")).agg(F.count("*").alias("n"))


def stats_daily(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "kind").agg(F.count("*").alias("n"), F.count_distinct("visitor").alias("visitors"))


def history_cap(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).select(c("domain").alias("url"), c("ts").alias("date"), "score", "event_id")
    return capped_history(e).select("url", "event_id")


def rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    return rate_limited(_events(spark, folder).withColumn("key", c("visitor")), 2, 3600).groupBy("key").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"))


def rate_window(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the same visitor in the hour up to each event: the bound that a plain window gives."""
    w = Window.partitionBy("visitor").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000, 0)
    return _events(spark, folder).select("event_id", F.count("*").over(w).alias("n"))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(_events(spark, folder)).select("visitor", "session", "n", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


def _half(spark: SparkSession, folder: str, late: bool) -> DataFrame:
    """A synthetic report of each domain's month half: a check per kind, its status by the mean score."""
    e = _events(spark, folder).where((c("ts") >= F.lit("2024-01-16").cast("timestamp")) == F.lit(late))
    mean = F.avg("score")
    return e.groupBy(c("domain").alias("site_id"), c("kind").alias("id")).agg(F.when(F.count("*") < 12, "skip").when(mean > 12, "pass").when(mean > 8, "warn").otherwise("fail").alias("status"), F.round(mean, 6).alias("score"))


def report_diff(spark: SparkSession, folder: str) -> DataFrame:
    return diff(_half(spark, folder, False), _half(spark, folder, True))


def compare_pivot(spark: SparkSession, folder: str) -> DataFrame:
    f = _half(spark, folder, True).select("site_id", c("id").alias("family"), F.floor("score").cast("int").alias("score"))
    return compare(f, ["d1", "d2", "d3"])


def _lite(spark: SparkSession, folder: str) -> DataFrame:
    from .pages import lite_results

    return lite_results(spark, folder)


def axes(spark: SparkSession, folder: str) -> DataFrame:
    return axis_scores(rollup.family_scores(_lite(spark, folder))).withColumn("score", c("score").cast("long"))


def recommendations_topk(spark: SparkSession, folder: str) -> DataFrame:
    got = top_fixes(recommendations(_lite(spark, folder)), 3)
    return got.select("site_id", "id", c("impact").cast("long").alias("impact"), F.round("weighted", 6).alias("weighted"), "effort", c("place").cast("long").alias("place"))


def projection(spark: SparkSession, folder: str) -> DataFrame:
    r = _lite(spark, folder)
    return project_score(rollup.family_scores(r), top_fixes(recommendations(r), 2)).withColumn("score", c("score").cast("long"))


QUERIES = {f.__name__: f for f in (stats_kpis, stats_by_kind, stats_top_domains, stats_domain_history, stats_grades, stats_daily, history_cap, rate_limit, rate_window, event_sessions, report_diff, compare_pivot, axes, recommendations_topk, projection)}


def _sql() -> dict[str, str]:
    from .pages import _LITE, _WEIGHT

    e = "e AS (SELECT event_id, ts, 'd' || (user_id % 37)::VARCHAR AS domain, user_id AS visitor, event_type AS kind, least(value, 100.0) AS score, json_extract_string(props, '$.k')::BIGINT AS duration FROM events)"
    grade = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"
    half = lambda late: f"SELECT domain AS site_id, kind AS id, CASE WHEN count(*) < 12 THEN 'skip' WHEN avg(score) > 12 THEN 'pass' WHEN avg(score) > 8 THEN 'warn' ELSE 'fail' END AS status, round(avg(score), 6) AS score FROM e WHERE (ts >= TIMESTAMP '2024-01-16') = {late} GROUP BY 1, 2"
    rank = "CASE {0} WHEN 'pass' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END"
    quick = " ".join(EFFORT["quick"].split())
    effort = "CASE " + " ".join(f"WHEN id IN ({', '.join(repr(x) for x in ks.split())}) THEN '{k}'" for k, ks in (EFFORT | {"quick": quick}).items()) + " ELSE CASE family " + " ".join(f"WHEN '{f}' THEN '{k}'" for f, k in FAMILY_EFFORT.items()) + " END END"
    fixes = f"""q AS (SELECT *, max_points - points AS impact, ((max_points - points) * {_WEIGHT}::DOUBLE) AS weighted, {effort} AS effort FROM r WHERE status IN ('fail', 'warn')),
        k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY weighted / CASE effort WHEN 'quick' THEN 1 WHEN 'moderate' THEN 2 ELSE 4 END DESC, weighted DESC, status, id) AS place FROM q)"""
    blend = f"floor(100 * sum({_WEIGHT} * ({{0}}::DOUBLE / max)::DECIMAL(20,15))::DOUBLE / sum({_WEIGHT})::DOUBLE + 0.5)::BIGINT"
    axis = "CASE " + " ".join(f"WHEN family IN ({', '.join(repr(x) for x in fs)}) THEN '{a}'" for a, fs in AXES.items()) + " END"
    return {
        "stats_kpis": f"WITH {e} SELECT count(*) AS total, count_if(ts <= TIMESTAMP '2024-01-31' AND epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) < 604800 AND floor(epoch(ts)) <= epoch(TIMESTAMP '2024-01-31')) AS last_7d, count_if(floor(epoch(ts)) <= epoch(TIMESTAMP '2024-01-31') AND epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) < 2592000) AS last_30d, floor(avg(score) * 10 + 0.5) / 10 AS mean, median(score) AS median, count(DISTINCT domain) AS domains, count(DISTINCT visitor) AS visitors, {', '.join(f'count_if({grade} = {g!r}) AS grade_{g.lower()}' for g in 'ABCDF')} FROM e",
        "stats_by_kind": f"WITH {e} SELECT kind, count(*) AS n, sum(duration)::BIGINT AS duration, round(median(score), 6) AS median FROM e GROUP BY 1",
        "stats_top_domains": f"WITH {e} SELECT domain, count(*) AS n, epoch_us(max(ts)) AS last_us FROM e GROUP BY 1 ORDER BY n DESC, max(ts) DESC, domain LIMIT 20",
        "stats_domain_history": f"WITH {e} SELECT event_id, domain, round(score - lag(score) OVER (PARTITION BY domain ORDER BY ts, event_id), 6) AS delta FROM e",
        "stats_grades": f"WITH {e} SELECT {grade} AS grade, count(*) AS n FROM e GROUP BY 1",
        "stats_daily": f"WITH {e} SELECT strftime(ts, '%Y-%m-%d') AS day, kind, count(*) AS n, count(DISTINCT visitor) AS visitors FROM e GROUP BY 1, 2",
        "rate_limit": f"""WITH RECURSIVE {e},
            o AS (SELECT visitor, epoch_us(ts) AS t, row_number() OVER (PARTITION BY visitor ORDER BY ts, event_id) AS k FROM e),
            f AS (
                SELECT visitor, k, [t] AS kept, 1 AS ok FROM o WHERE k = 1
                UNION ALL
                SELECT visitor, k, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END, CASE WHEN len(live) < 2 THEN 1 ELSE 0 END
                FROM (SELECT o.visitor, o.k, o.t, list_filter(f.kept, lambda x: x > o.t - 3600000000) AS live FROM f JOIN o ON o.visitor = f.visitor AND o.k = f.k + 1)
            )
            SELECT visitor AS key, count(*) AS n, sum(ok)::BIGINT AS allowed FROM f GROUP BY visitor""",
        "history_cap": f"WITH {e} SELECT domain AS url, event_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC) AS k FROM e WHERE score IS NOT NULL) WHERE k <= {HISTORY}",
        "rate_window": f"WITH {e} SELECT event_id, count(*) OVER (PARTITION BY visitor ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM e",
        "event_sessions": f"WITH {e}, s AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER q <= 1800000000 THEN 0 ELSE 1 END AS new FROM e WINDOW q AS (PARTITION BY visitor ORDER BY ts, event_id)), t AS (SELECT *, (sum(new) OVER (PARTITION BY visitor ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM s) SELECT visitor, session, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM t GROUP BY 1, 2",
        "report_diff": f"WITH {e}, a AS ({half('false')}), b AS ({half('true')}), x AS (SELECT site_id, id, a.status AS before, b.status AS after FROM (SELECT * FROM a WHERE status <> 'skip') a FULL JOIN (SELECT * FROM b WHERE status <> 'skip') b USING (site_id, id)) SELECT *, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN {rank.format('after')} > {rank.format('before')} THEN 'regression' ELSE 'improvement' END AS change FROM x WHERE before IS DISTINCT FROM after",
        "compare_pivot": f"WITH {e}, b AS ({half('true')}), w AS (SELECT id AS family, max(CASE WHEN site_id = 'd1' THEN floor(score)::INT END) AS d1, max(CASE WHEN site_id = 'd2' THEN floor(score)::INT END) AS d2, max(CASE WHEN site_id = 'd3' THEN floor(score)::INT END) AS d3 FROM b WHERE site_id IN ('d1', 'd2', 'd3') GROUP BY 1) SELECT *, array_to_string(list_filter([CASE WHEN d1 = greatest(d1, d2, d3) THEN 'd1' END, CASE WHEN d2 = greatest(d1, d2, d3) THEN 'd2' END, CASE WHEN d3 = greatest(d1, d2, d3) THEN 'd3' END], lambda x: x IS NOT NULL), ',') AS leaders, greatest(greatest(d2, d3) - d1, 0) AS gap FROM w",
        "axes": f"WITH {_LITE}, g AS (SELECT site_id, {axis} AS axis, {blend.format('earned')} AS score FROM fs GROUP BY 1, 2) SELECT s.site_id, x.axis, g.score FROM (SELECT DISTINCT site_id FROM fs) s CROSS JOIN (VALUES ('reachable'), ('understood'), ('usable')) AS x(axis) LEFT JOIN g ON g.site_id = s.site_id AND g.axis = x.axis",
        "recommendations_topk": f"WITH {_LITE}, {fixes} SELECT site_id, id, impact, round(weighted, 6) AS weighted, effort, place FROM k WHERE place <= 3",
        "projection": f"WITH {_LITE}, {fixes}, g AS (SELECT site_id, family, sum(impact)::BIGINT AS gain FROM k WHERE place <= 2 GROUP BY 1, 2), t AS (SELECT fs.site_id, fs.family, max, least(max, earned + coalesce(gain, 0)) AS got FROM fs LEFT JOIN g USING (site_id, family)) SELECT site_id, {blend.format('got')} AS score FROM t GROUP BY 1",
    }


ORACLE_SQL = _sql()
