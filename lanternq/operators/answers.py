"""Which questions a site answers: subjects and zones it declares, a grid of intents, and how well a passage answers each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunker

c = F.col
SUBJECTS, ZONES = 12, 6
STATES = {"missing": 0, "buried": 1, "covered": 2}
# Intents with the kinds of site they apply to, whether they ask about an area, and where the evidence lies.
INTENTS = (
    ("price", ("local-business", "product"), True, "chunk"),
    ("hours", ("local-business",), False, "chunk"),
    ("location", ("local-business",), True, "chunk"),
    ("contact", ("local-business", "product", "article", "unknown"), False, "page"),
    ("process", ("local-business", "product", "article"), False, "chunk"),
    ("identity", ("local-business", "product", "article", "unknown"), False, "page"),
)
# An amount with its currency on either side; a time of day; a step.
MONEY = r"(?iu)[€$£¥]\s?\d+(?:[   ]\d{3})*(?:[.,]\d{1,2})?|\d+(?:[   ]\d{3})*(?:[.,]\d{1,2})?\s?[€$£¥]|\b(?:EUR|USD|GBP|CHF|CAD|AUD)\s?\d+|\d+(?:[.,]\d{1,2})?\s?(?:EUR|USD|GBP|CHF|CAD|AUD)\b"
CLOCK = r"(?i)\b\d{1,2}\s?(?:h\s?\d{2}|h|:\d{2})"
STEP = r"(?i)(?:^|[\s(])\d{1,2}[.)]|(?:étape|etape|step)\s*\d{1,2}"


def buckets(pages: DataFrame) -> DataFrame:
    """(site_id, bucket) by the types that a site's markup declares."""
    local = F.exists("node_types", lambda t: t.endswith("Business") | t.isin("Store", "Restaurant", "Bakery", "Cafe", "CafeOrCoffeeShop", "Hotel"))
    product, article = F.array_contains("node_types", "Product"), F.exists("node_types", lambda t: t.isin("Article", "NewsArticle", "BlogPosting", "TechArticle"))
    any_of = lambda x: F.bool_or(F.coalesce(x, F.lit(False)))
    return pages.groupBy("site_id").agg(F.when(any_of(local), "local-business").when(any_of(product), "product").when(any_of(article), "article").otherwise("unknown").alias("bucket"))


def subjects(pages: DataFrame) -> DataFrame:
    """(site_id, subject): services named by markup, else by navigation links, else by first headings; each once, at most twelve."""
    nodes = pages.select("site_id", "seq", F.explode("nodes").alias("n")).where(F.col("n.types").rlike("Service|Product|Offer") & (c("n.name") != "")).select("site_id", "seq", F.lit(0).alias("rank"), c("n.name").alias("subject"))
    nav = pages.where("is_home").select("site_id", "seq", F.explode("links").alias("l")).where(~c("l.in_main")).select("site_id", "seq", F.lit(1).alias("rank"), c("l.text").alias("subject"))
    head = pages.select("site_id", "seq", F.lit(2).alias("rank"), F.try_element_at("h1s", F.lit(1)).alias("subject"))
    label = T.normalize_label(c("subject"))
    fit = F.length(F.trim("subject")).between(3, 60) & (T.word_count(c("subject")) <= 5) & ~T.is_generic_anchor(c("subject")) & ~label.isin("home", "accueil", "contact", "about", "a propos", "blog", "login", "menu")
    rows = nodes.unionAll(nav).unionAll(head).where(fit).withColumn("label", label).where("label <> ''")
    once = Window.partitionBy("site_id", "label").orderBy("rank", "seq", "subject")
    order = Window.partitionBy("site_id").orderBy("rank", "seq", "label")
    return rows.withColumn("k", F.row_number().over(once)).where("k = 1").withColumn("k", F.row_number().over(order)).where(c("k") <= SUBJECTS).select("site_id", c("k").alias("subject_no"), F.trim("subject").alias("subject"))


def zones(pages: DataFrame) -> DataFrame:
    """(site_id, zone): places that markup names, each once, at most six."""
    named = pages.select("site_id", "seq", F.explode("nodes").alias("n")).where(F.col("n.types").rlike("City|Place|AdministrativeArea|State") & (c("n.name") != "")).select("site_id", "seq", F.trim("n.name").alias("zone"))
    order = Window.partitionBy("site_id").orderBy("first", "zone")
    return named.groupBy("site_id", "zone").agg(F.min("seq").alias("first")).withColumn("k", F.row_number().over(order)).where(c("k") <= ZONES).select("site_id", "zone")


def _evidence(intent: Column, text: Column, zone: Column) -> Column:
    return (
        F.when(intent == "price", text.rlike(MONEY))
        .when(intent == "hours", (F.regexp_count(text, F.lit(CLOCK)) >= 2) | c("opens"))
        .when(intent == "location", F.contains(F.lower(T.fold_diacritics(text)), F.lower(T.fold_diacritics(zone))))
        .when(intent == "contact", c("reachable"))
        .when(intent == "process", (F.regexp_count(text, F.lit(STEP)) >= 2) | F.array_contains("node_types", "HowTo"))
        .when(intent == "identity", c("known"))
        .otherwise(F.lit(False))
    )


def answer_matrix(pages: DataFrame) -> DataFrame:
    """(site_id, subject, intent, zone, state) for every question of a site: the best state of any of its passages.

    A passage answers when it names the subject and has the intent's evidence; it covers the question if it can be quoted alone, else the answer is buried. The grid
    is at most 12 subjects by 6 intents by 6 zones for a site; passages meet it by site.
    """
    spark = pages.sparkSession
    grid = spark.createDataFrame([(i, b, z, s) for i, bs, z, s in INTENTS for b in bs], "intent string, bucket string, zoned boolean, scope string")
    asked = subjects(pages).join(buckets(pages), "site_id").join(F.broadcast(grid), "bucket")
    asked = asked.join(zones(pages), "site_id", "left").withColumn("zone", F.when(c("zoned"), c("zone"))).where("NOT zoned OR zone IS NOT NULL").distinct()
    facts = pages.select(
        "site_id", "blocks", "node_types", F.exists("links", lambda x: x["href"].rlike("(?i)^(tel|mailto):")).alias("tel"), F.exists("forms", lambda f: f["submit"]).alias("form"),
        (F.size("same_as") > 0).alias("same"), c("author").isNotNull().alias("signed"), c("body_text").rlike("(?i)opening ?hours").alias("opens"),
    )
    facts = facts.withColumn("reachable", c("tel") | c("form")).withColumn("known", c("same") | c("signed") | F.array_contains("node_types", "Person"))
    parts = chunker.chunks(facts).select("site_id", "text", "headings", "lead", "survives", "node_types", "reachable", "known", "opens")
    met = asked.join(parts, "site_id", "left")
    names = F.contains(F.lower(F.concat_ws(" ", "headings", "text")), F.lower("subject"))
    evidence = _evidence(c("intent"), c("text"), c("zone"))
    state = F.when(F.coalesce(evidence & (names | (c("scope") == "page")), F.lit(False)), F.when(c("survives"), 2).otherwise(1)).otherwise(0)
    best = met.groupBy("site_id", "subject", "intent", "zone").agg(F.max(state).alias("best"))
    return best.select("site_id", "subject", "intent", "zone", F.when(c("best") == 2, "covered").when(c("best") == 1, "buried").otherwise("missing").alias("state"))


def coverage(matrix: DataFrame) -> DataFrame:
    """(site_id, ratio): covered cells."""
    return matrix.groupBy("site_id").agg(F.avg((c("state") == "covered").cast("int")).alias("ratio"))


def collapsed(matrix: DataFrame) -> DataFrame:
    """The best state of each subject and intent over zones."""
    rank = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[c("state")]
    return matrix.groupBy("site_id", "subject", "intent").agg(F.max_by("state", rank).alias("state"))
