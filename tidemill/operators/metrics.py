"""Metrics from a log of (ts, metric, label, value): counters, gauges and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The families, the label each has, and the histogram's bounds.
COUNTERS = {"requests_total": "status", "pages_processed_total": "content_type", "bytes_transferred_total": "direction"}
GAUGES = {"crawlers_active": None, "throughput_mbps": None, "global_error_rate": None, "global_success_rate": None, "domain_ban_rate": "domain", "memory_usage_percent": None, "queue_depth": "queue"}
HISTOGRAMS = {"request_duration_seconds": "path_type"}
BOUNDS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
HELP = {
    "requests_total": "Requests by outcome", "pages_processed_total": "Pages by content type", "bytes_transferred_total": "Bytes by direction", "crawlers_active": "Crawlers at work", "throughput_mbps": "Throughput in Mbit/s",
    "global_error_rate": "Share of failed requests", "global_success_rate": "Share of successful requests", "domain_ban_rate": "Share of bans by domain", "memory_usage_percent": "Memory in use", "queue_depth": "Entries by queue",
    "request_duration_seconds": "Duration of requests",
}
FAMILIES = {k: (t, HELP[k], n) for t, own in (("counter", COUNTERS), ("gauge", GAUGES), ("histogram", HISTOGRAMS)) for k, n in own.items()}
RANGES = {"global_error_rate": (0.0, 1.0), "global_success_rate": (0.0, 1.0), "domain_ban_rate": (0.0, 1.0), "memory_usage_percent": (0.0, 100.0)}


def counters(log: DataFrame) -> DataFrame:
    return log.where(F.col("metric").isin(*COUNTERS)).groupBy("metric", "label").agg(F.sum("value").alias("value"))


def gauges(log: DataFrame) -> DataFrame:
    """Each gauge's last value, kept in its range."""
    last = log.where(F.col("metric").isin(*GAUGES)).groupBy("metric", "label").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))
    value = F.col("value")
    for name, (lo, hi) in RANGES.items():
        value = F.when(F.col("metric") == name, F.least(F.greatest(F.col("value"), F.lit(lo)), F.lit(hi))).otherwise(value)
    return last.withColumn("value", value)


def histogram(log: DataFrame, bounds: list[float] | None = None) -> DataFrame:
    """Cumulative counts: metric, label, bound (null: all), n."""
    bounds = BOUNDS if bounds is None else bounds
    counts = [F.struct(F.lit(b).cast("double").alias("bound"), F.count_if(F.col("value") <= b).alias("n")) for b in bounds]
    all_ = F.struct(F.lit(None).cast("double").alias("bound"), F.count("*").alias("n"))
    got = log.where(F.col("metric").isin(*HISTOGRAMS)).groupBy("metric", "label").agg(F.array(*counts, all_).alias("x"))
    return got.select("metric", "label", F.inline("x"))


def histogram_parts(log: DataFrame, bounds: list[float] | None = None) -> DataFrame:
    """Histograms as the exposition has them: metric, label, part (bucket, sum, count), bound (null but for bounded buckets), value."""
    buckets = histogram(log, bounds).select("metric", "label", F.lit("bucket").alias("part"), "bound", F.col("n").cast("double").alias("value"))
    totals = log.where(F.col("metric").isin(*HISTOGRAMS)).groupBy("metric", "label").agg(F.sum("value").alias("sum"), F.count("*").cast("double").alias("count"))
    return buckets.union(totals.select("metric", "label", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(None).cast("double").alias("bound"), F.col(p).alias("value")) for p in ("sum", "count")]))))


def collected(events: DataFrame) -> DataFrame:
    """success_rate (1 without requests), error_rate, total_bytes. events: success, bytes."""
    n = events.agg(F.count("success").alias("n"), F.count_if("success").alias("won"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))
    rate = F.when(F.col("n") > 0, F.col("won") / F.col("n")).otherwise(1.0)
    return n.select(rate.alias("success_rate"), (1 - rate).alias("error_rate"), "total_bytes")
