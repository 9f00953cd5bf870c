"""The usage log as a stream: tolerant reading, windowed statistics with late data, exact rolling limits by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "ts string, kind string, domain string, url string, lang string, score double, grade string, familyScores array<struct<family: string, score: double>>, ipHash string, durationMs bigint, cwv boolean, _corrupt_record string"


def read_log(spark: SparkSession, folder: str, stream: bool = True, files_per_trigger: int = 100) -> DataFrame:
    """Lines of JSON (rotated files are files of the folder); lines that do not parse keep their text in ``_corrupt_record``."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    rows = reader.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder)
    return rows.withColumn("at", F.try_to_timestamp("ts"))


def bad_lines(log: DataFrame) -> DataFrame:
    return log.where(F.col("_corrupt_record").isNotNull() | F.col("at").isNull()).agg(F.count("*").alias("bad"))


def window_stats(log: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and mean scores by window and kind; events later than ``late`` behind the newest are dropped."""
    rows = log.where("at IS NOT NULL").withWatermark("at", late)
    window = F.window("at", width, slide) if slide else F.window("at", width)
    return rows.groupBy(window.alias("w"), "kind").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.approx_count_distinct("ipHash").alias("visitors")).select("w.start", "w.end", "kind", "n", "mean", "visitors")


def session_stats(log: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each visitor: runs of events with no pause of ``gap``."""
    rows = log.where("at IS NOT NULL AND ipHash IS NOT NULL").withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap).alias("w"), "ipHash").agg(F.count("*").alias("n")).select("ipHash", "w.start", "w.end", "n")


def rate_limiter(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """(key, at, allowed) for a stream of (key, at): allowed if fewer than ``limit`` allowed events of the key lie in the last ``seconds``.

    Denied events are not remembered, so the state of a key is at most ``limit`` times; keys that stay silent are forgotten.
    """
    span = pd.Timedelta(seconds=seconds)

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = [pd.Timestamp(t) for t in (state.get[0] if state.exists else [])]
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        allowed = []
        for t in rows["at"]:
            kept = [k for k in kept if k > t - span]
            allowed.append(len(kept) < limit)
            if allowed[-1]:
                kept.append(t)
        state.update(([str(k) for k in kept],))
        state.setTimeoutDuration(max(1, int(seconds * 1000)))
        yield pd.DataFrame({"key": key[0], "at": rows["at"], "allowed": allowed})

    return events.select("key", "at").groupBy("key").applyInPandasWithState(step, "key string, at timestamp, allowed boolean", "kept array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)
