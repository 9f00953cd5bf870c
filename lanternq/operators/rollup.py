"""From findings to results to scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checks.catalog import CHECKS, WEIGHTS

#: Share of pages that must conform for a mere warning.
CONFORM = 0.8
SHOWN = 3


def first_and_rest(labels: Column, n: Column) -> Column:
    """The first three labels, then how many more there are."""
    return F.concat(F.array_join(F.slice(labels, 1, SHOWN), ", "), F.when(n > SHOWN, F.concat(F.lit(" (+"), (n - SHOWN).cast("string"), F.lit(" more)"))).otherwise(""))


def rolled(findings: DataFrame) -> DataFrame:
    """(site_id, id, status, detail) from (site_id, id, rollup, seq, label, severity). Rows with a null severity count for nothing.

    Rollups: ``agg``: fail if less than 80 % conform, else warn; ``sev``: the worst; ``warn`` and ``any``: warn or fail if there is an offender; ``lang``: as agg if a page
    fails outright, else warn. The detail names the first three offenders, then how many more there are; only three rows of each check and task
    reach the shuffle for that, so a site's size does not matter. ``findings`` is read twice: pass a written table.
    """
    bad = F.col("severity") > 0
    kept = findings.where("severity IS NOT NULL")
    per = kept.groupBy("site_id", "id", "rollup").agg(
        F.count("*").alias("total"), F.count_if(bad).alias("bad"), F.max("severity").alias("worst"),
    )
    place = F.row_number().over(Window.partitionBy("site_id", "id").orderBy("seq", "label"))
    shown = kept.where(bad).withColumn("place", place).where(F.col("place") <= SHOWN).groupBy("site_id", "id").agg(F.array_sort(F.collect_list(F.struct("place", "label"))).alias("shown"))
    per = per.join(shown, ["site_id", "id"], "left")
    ratio = F.when(F.col("bad") == 0, "pass").when((F.col("total") - F.col("bad")) / F.col("total") >= CONFORM, "warn").otherwise("fail")
    worst = F.when(F.col("worst") == 0, "pass").when(F.col("worst") == 1, "warn").otherwise("fail")
    status = (
        F.when(F.col("rollup") == "agg", ratio)
        .when((F.col("rollup") == "lang") & (F.col("worst") == 2), ratio)
        .when(F.col("rollup").isin("warn", "lang"), F.when(F.col("bad") > 0, "warn").otherwise("pass"))
        .when(F.col("rollup") == "any", F.when(F.col("bad") > 0, "fail").otherwise("pass"))
        .otherwise(worst)
    )
    detail = F.when(F.col("bad") > 0, first_and_rest(F.col("shown.label"), F.col("bad")))
    return per.select("site_id", "id", status.alias("status"), detail.alias("detail"))


def points(status: Column, most: Column) -> Column:
    """Full for a pass, half and rounded down for a warning."""
    return F.when(status == "pass", most).when(status == "warn", F.floor(most / 2)).otherwise(0).cast("int")


def results(sites: DataFrame, statuses: DataFrame, catalog: DataFrame, missing: Column) -> DataFrame:
    """A row for every site and registered check, in catalogue order; ``missing`` is the status of a check that found nothing."""
    # The catalogue is a fixed list of 145 rows.
    grid = sites.crossJoin(F.broadcast(catalog))
    out = grid.join(statuses, ["site_id", "id"], "left").withColumn("status", F.coalesce("status", missing))
    return out.withColumn("points", points(F.col("status"), F.col("max_points"))).select("site_id", "ord", "id", "family", "evidence", "status", "points", "max_points", "detail")


def weight_of(family: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[family]


def js_round(x: Column) -> Column:
    """Half up."""
    return F.floor(x + 0.5).cast("int")


def family_scores(checked: DataFrame) -> DataFrame:
    """(site_id, family, earned, max, score, weight) over checks that did not skip; families without points vanish."""
    ran = checked.where("status <> 'skip'").groupBy("site_id", "family").agg(F.sum("points").alias("earned"), F.sum("max_points").alias("max")).where(F.col("max") > 0)
    return ran.select("site_id", "family", "earned", "max", js_round(100 * F.col("earned") / F.col("max")).alias("score"), weight_of(F.col("family")).alias("weight"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def blended(families: DataFrame, *keys: str, earned: Column | None = None) -> Column:
    """Aggregate: weighted share of points, renormalised over the families present, 0 to 100."""
    earned = F.col("earned") if earned is None else earned
    # Sums over families in a fixed order: exact decimals, so that the order of rows cannot matter.
    part = (F.col("weight").cast("decimal(4,2)") * (earned / F.col("max")).cast("decimal(20,15)")).cast("decimal(25,17)")
    return js_round(100 * F.sum(part).cast("double") / F.sum(F.col("weight").cast("decimal(4,2)")).cast("double"))


def site_scores(families: DataFrame) -> DataFrame:
    """(site_id, score, grade)."""
    return families.groupBy("site_id").agg(blended(families).alias("score")).withColumn("grade", grade(F.col("score")))


FAMILIES = list(CHECKS)
