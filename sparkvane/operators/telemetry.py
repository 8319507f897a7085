"""Telemetry as data: metric rows (ts, name, kind, level, value) and their rollups."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("BASIC", "DETAILED", "DIAGNOSTIC")
SAMPLING = {"OFF": 0, "RARE": 1024, "LOW": 256, "HALF": 2, "ALL": 1}
#: name -> (kind, level)
CATALOGUE = {
    "search.latency": ("timer", "BASIC"), "search.count": ("counter", "BASIC"), "insert.queue": ("gauge", "DETAILED"), "insert.count": ("counter", "BASIC"),
    "insert.latency": ("timer", "BASIC"), "remove.count": ("counter", "BASIC"), "remove.latency": ("timer", "BASIC"), "documents.count": ("gauge", "BASIC"),
    "index.bytes": ("gauge", "DETAILED"), "index.recall": ("gauge", "DIAGNOSTIC"), "index.distances": ("counter", "DIAGNOSTIC"),
}
SCHEMA = "ts timestamp, name string, kind string, level string, value double"


class Recorder:
    """Collects metrics on the driver; pass it as a collection's ``telemetry``. Metrics above its level are dropped."""

    def __init__(self, level: str = "DIAGNOSTIC") -> None:
        self.level, self.rows = LEVELS.index(level), []

    def __call__(self, name: str, value: float) -> None:
        kind, level = CATALOGUE.get(name, ("timer", "BASIC"))
        if LEVELS.index(level) <= self.level:
            self.rows.append((time.time(), name, kind, level, float(value)))

    def frame(self, spark: SparkSession) -> DataFrame:
        raw = spark.createDataFrame(self.rows, "t double, name string, kind string, level string, value double")
        return raw.select(F.timestamp_seconds("t").alias("ts"), "name", "kind", "level", "value")


def at_level(metrics: DataFrame, level: str) -> DataFrame:
    return metrics.where(F.col("level").isin(*LEVELS[: LEVELS.index(level) + 1]))


def sampled(df: DataFrame, key: Column, rate: str) -> DataFrame:
    """One in so many rows, chosen by the hash of ``key``: the same rows in every run."""
    n = SAMPLING[rate]
    return df.where(F.lit(False)) if n == 0 else df if n == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(n)) == 0)


def counters(metrics: DataFrame, by: str = "name", value: str = "value") -> DataFrame:
    return metrics.groupBy(by).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def timers(metrics: DataFrame, by: str = "name", value: str = "value", exact: bool = True) -> DataFrame:
    """Count, mean, maximum and the 50th, 90th and 99th percentile; the approximate ones need bounded memory."""
    q = (lambda p: F.percentile(value, p)) if exact else (lambda p: F.percentile_approx(value, p, 10_000))
    return metrics.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"))


def gauges(metrics: DataFrame, by: str = "name", value: str = "value", ts: str = "ts") -> DataFrame:
    """The last value of each gauge; of values at one time the greatest."""
    return metrics.groupBy(by).agg(F.max(F.struct(ts, value)).alias("last")).select(by, F.col(f"last.{ts}").alias(ts), F.col(f"last.{value}").alias(value))


def exposition(metrics: DataFrame) -> DataFrame:
    """One line a metric, in the plain text format that scrapers read."""
    last = gauges(metrics.where("kind = 'gauge'")).select("name", "value", F.lit("gauge").alias("kind"))
    total = counters(metrics.where("kind <> 'gauge'")).select("name", F.col("total").alias("value"), F.lit("counter").alias("kind"))
    name = F.regexp_replace("name", "[^a-zA-Z0-9_]", "_")
    return last.unionByName(total).select(F.concat(F.lit("# TYPE "), name, F.lit(" "), "kind", F.lit("\n"), name, F.lit(" "), F.col("value").cast("string")).alias("line"))
