"""robots.txt: groups by agent, and the longest rule that matches a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Crawlers that train models, that fetch to cite, and search engines.
TRAINING = ("GPTBot", "Google-Extended", "ClaudeBot", "anthropic-ai", "CCBot", "Applebot-Extended", "Amazonbot", "Bytespider", "PanguBot", "cohere-ai", "cohere-training-data-crawler", "meta-externalagent", "Diffbot", "Timpibot", "omgilibot")
CITATION = ("OAI-SearchBot", "ChatGPT-User", "Perplexity-User", "Claude-User", "Claude-SearchBot", "PerplexityBot", "DuckAssistBot", "MistralAI-User", "Meta-ExternalFetcher", "YouBot", "iAskBot", "LinerBot", "Google-CloudVertexBot", "Google-Agent")
SEARCH = ("Googlebot", "Bingbot", "*")


def rules(files: DataFrame) -> DataFrame:
    """(site_id, agent, ord, allow, pattern) from (site_id, body). Consecutive agent lines share the rules after them; a group without rules keeps a row with a null pattern.

    A run of agent lines begins where an agent line follows any other line; a running count numbers the runs.
    """
    clean = F.trim(F.regexp_replace("line", "#.*$", ""))
    rx = r"(?i)^(user-agent|allow|disallow)\s*:\s*(.*)$"
    lines = files.select("site_id", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line")).select("site_id", "pos", F.lower(F.regexp_extract(clean, rx, 1)).alias("key"), F.trim(F.regexp_extract(clean, rx, 2)).alias("value"))
    order = Window.partitionBy("site_id").orderBy("pos")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    runs = lines.withColumn("run", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("run > 0 AND key <> ''")
    agents = runs.where("key = 'user-agent'").select("site_id", "run", F.lower(F.trim(F.regexp_replace("value", "/.*$", ""))).alias("agent")).distinct()
    allowed = runs.where("key <> 'user-agent' AND value <> ''").select("site_id", "run", F.col("pos").alias("ord"), (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return agents.join(allowed, ["site_id", "run"], "left").select("site_id", "agent", "ord", "allow", "pattern")


def pattern_regex(pattern: Column) -> Column:
    """``*`` stands for anything, a final ``$`` for the end."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(body, r"\*", ".*"), F.when(pattern.endswith("$"), "$").otherwise(""))


def blocked(parsed: DataFrame, asked: DataFrame) -> DataFrame:
    """(site_id, agent, path, blocked) for each row of ``asked`` (site_id, agent, path): the agent's own group, else ``*``; the longest pattern wins, allow on a tie."""
    groups = parsed.select("site_id", "agent").distinct()
    named = groups.select("site_id", F.col("agent").alias("low"), F.lit(True).alias("named"))
    own = asked.withColumn("low", F.lower("agent")).join(named, ["site_id", "low"], "left").withColumn("group", F.when(F.col("named"), F.col("low")).otherwise(F.lit("*")))
    met = own.join(parsed.withColumnRenamed("agent", "group"), ["site_id", "group"], "left").where(F.col("pattern").isNull() | F.rlike("path", pattern_regex(F.col("pattern"))))
    best = met.groupBy("site_id", "agent", "path").agg(F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), F.col("allow").alias("allow")))).alias("best"))
    return asked.select("site_id", "agent", "path").distinct().join(best, ["site_id", "agent", "path"], "left").select("site_id", "agent", "path", (~F.coalesce(F.col("best.allow"), F.lit(True))).alias("blocked"))
