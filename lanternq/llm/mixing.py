"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

Documents form a tree: domain, language, source. A budget of tokens runs down from the root: children share what their parent has in
proportion to their weights, none beyond the tokens that its subtree can give in ``max_epochs`` epochs. What a child cannot take goes to its
siblings; since a parent never gets more than its subtree can give, shortages reach a parent's own siblings just when all below are exhausted.
The shares have a closed form: with children in order of capacity over weight, the first ones are full, and the rest divide what
is left by weight. One window over siblings finds it.

A leaf takes whole epochs and, of the next one, the prefix of a seeded order whose tokens fit. That prefix is everything up to a cut
key, found from sums over buckets of the key, then within the bucket: no leaf is ever sorted in one task. The cuts (one row per leaf) go back
to the documents, which are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import parked

LEVELS = ("domain", "lang", "source")
#: Rows of a leaf in a bucket of the seeded order, and buckets of a leaf at most (a bucket is then larger, and sorts externally).
BUCKET_ROWS, MOST_BUCKETS = 128, 1 << 16
#: A tree of more leaves than this is joined by shuffle.
BROADCAST_LEAVES = 100_000
SEED, MAX_EPOCHS, SHARE = 17, 3, 0.6
#: Weights by node name; others have 1.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2}
LANG_WEIGHTS = {"en": 4, "de": 2}


def token_count(text: Column) -> Column:
    """Runs of characters other than ``[\\x20\\x09-\\x0D]``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The source's final number modulo four."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), (number.try_cast("bigint") % 4).cast("string")))


def _weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for k, w in weights.items():
        out = F.when(name == k, F.lit(int(w)).cast("long")).otherwise(out)
    return out


def _shares(nodes: DataFrame, parents: list[str], name: str, total: str, out: str) -> DataFrame:
    """``out``: each node's part of its parent's ``total``, by columns w and cap, rounded down."""
    wide = lambda c: c.cast("decimal(38,0)")
    order = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("w"), name) if parents else Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest, weights = F.col(total) - F.coalesce(F.sum("cap").over(before), F.lit(0)), F.sum("w").over(after)
    step = nodes.withColumn("__rest", F.greatest(rest, F.lit(0))).withColumn("__weights", weights)
    step = step.withColumn("__full", wide(F.col("cap")) * wide(F.col("__weights")) <= wide(F.col("__rest")) * wide(F.col("w")))
    # The first node that is not full fixes the rate for all that follow it.
    all_before = F.min(F.col("__full").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    step = step.withColumn("__filled", F.coalesce(all_before, F.lit(1)) == 1)
    rate = F.first(F.when(~F.col("__filled"), F.struct("__rest", "__weights")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    step = step.withColumn("__rate", rate)
    divided = F.floor(wide(F.col("__rate.__rest")) * wide(F.col("w")) / wide(F.col("__rate.__weights")))
    return step.withColumn(out, F.when(F.col("__filled"), F.col("cap")).otherwise(divided).cast("long")).drop("__rest", "__weights", "__full", "__filled", "__rate")


def budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, docs, budget) for each leaf, from (domain, lang, source, tokens, docs); ``budget`` is an expression over the total ``tokens``."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    above, parents, key = None, [], []
    for level in LEVELS:
        key = [*key, level]
        nodes = leaves.groupBy(*key).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("w", _weight(F.col(level), weights.get(level, {})))
        # The top level shares the budget itself.
        whole = nodes.withColumn("tokens", F.sum("tokens").over(Window.partitionBy(F.lit(0)))).withColumn("share", budget.cast("long"))
        joined = whole if above is None else nodes.join(above, parents)
        above, parents = _shares(joined, parents, level, "share", "own").select(*key, F.col("own").alias("share")), key
    return leaves.drop("cap").join(above, key).withColumnRenamed("share", "budget")


def _key(name: Column, epoch: Column, seed: int) -> Column:
    """Place of a document in an epoch of its leaf: hexadecimal MD5 of seed, epoch and id."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(name.cast("string"), F.lit(""))))


def mixture(docs: DataFrame, budget_share: float = SHARE, weights: dict[str, dict[str, int]] | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", out: str = "copies") -> DataFrame:
    """All columns of ``docs`` and ``out``: how often the document is taken, 0 to ``max_epochs``.

    The budget is ``budget_share`` of all tokens. Null languages and sources are nodes named ''. Documents without tokens cost nothing:
    they are taken in every epoch that comes to them. Rows that repeat an id within a leaf have one place in its order and are taken or left
    together; rows with a null id count as one id. An empty table gives no rows. ``out`` and names that begin with two underscores must not be
    columns of ``docs``.
    """
    weights = weights or {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}
    domain = domain if domain is not None else domain_of(F.coalesce(F.col("source"), F.lit("")))
    names = {"domain": domain, "lang": F.coalesce(F.col("lang"), F.lit("")), "source": F.coalesce(F.col("source"), F.lit(""))}
    narrow = parked(docs.select(*[c.alias(k) for k, c in names.items()], F.col(id_col).alias("id"), token_count(F.col(text_col)).alias("n")), "tokens")
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    tree = parked(budgets(leaves, F.floor(F.col("tokens") * F.lit(budget_share)), weights, max_epochs), "tree")
    tree = tree.withColumn("full", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(max_epochs)).cast("long")).withColumn("left", F.col("budget") - F.col("full") * F.col("tokens"))
    small = tree.count() <= BROADCAST_LEAVES
    leaf = F.broadcast(tree) if small else tree
    most = F.least(F.ceil(F.col("docs") / BUCKET_ROWS), F.lit(MOST_BUCKETS)).cast("long")
    placed = narrow.join(leaf.where("left > 0"), list(LEVELS)).select(*LEVELS, "left", _key(F.col("id"), F.col("full") + 1, seed).alias("key"), "n", most.alias("most"))
    bucket = F.expr("cast(conv(substring(key, 1, 8), 16, 10) AS bigint) * most div 4294967296")
    keys = parked(placed.groupBy(*LEVELS, "left", "key", "most").agg(F.sum("n").alias("n")).withColumn("bucket", bucket), "keys")
    sums = keys.groupBy(*LEVELS, "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parked(sums.select(*LEVELS, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    within = Window.partitionBy(*LEVELS, "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = keys.withColumn("upto", F.sum("n").over(within)).join(offsets, [*LEVELS, "bucket"])
    cuts = run.where(F.col("before") + F.col("upto") <= F.col("left")).groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    plan = parked(tree.join(cuts, list(LEVELS), "left").select(*[F.col(x).alias(f"__{x}") for x in LEVELS], F.col("full").alias("__full"), F.col("cut").alias("__cut")), "plan")
    taken = F.col("__full") + F.when(_key(F.col(id_col), F.col("__full") + 1, seed) <= F.col("__cut"), 1).otherwise(0)
    same = [names[x] == F.col(f"__{x}") for x in LEVELS]
    joined = docs.join(F.broadcast(plan) if small else plan, same)
    return joined.withColumn(out, taken.cast("long")).drop(*[f"__{x}" for x in (*LEVELS, "full", "cut")])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each document repeated as often as it is taken."""
    rows = mixture(docs, out="__copies", **options)
    return rows.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).drop("__copies", "__copy")
