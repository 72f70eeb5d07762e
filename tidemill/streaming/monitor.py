"""The monitoring rules over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.records import enriched, missed, needs_enrichment, upserted


def success_windows(events: DataFrame, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """Tumbling success rates of a stream of (ts, success), each window once it is closed."""
    n = events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"))
    return n.select(F.col("w.start").alias("window_start"), "success_count", "failure_count", (F.col("success_count") / (F.col("success_count") + F.col("failure_count"))).alias("success_rate"))


def ban_rates(events: DataFrame) -> DataFrame:
    """Each domain's totals of a stream of (domain, success, is_ban), for update or complete mode."""
    n = events.groupBy("domain").agg(F.count("*").alias("total"), F.count_if("is_ban").alias("bans"))
    return n.withColumn("ban_rate", F.col("bans") / F.col("total"))


def circuit_counts(failures: DataFrame, most: int = 3, ttl: int = 3600, late: str = "1 hour") -> DataFrame:
    """A stream of failures (ts, seq, domain, url) with count and tripped; a domain's state ends with its period.

    State: the period's start in microseconds, and the count.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        counts = []
        for ts in rows["ts"]:
            at = int(ts.timestamp() * 1_000_000)
            if start is None or at - start >= ttl * 1_000_000:
                start, n = at, 0
            n += 1
            counts.append(n)
        state.update((start, n))
        state.setTimeoutTimestamp(max(start // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"ts": rows["ts"], "seq": rows["seq"], "domain": key[0], "url": rows["url"], "count": counts, "tripped": [c > most for c in counts]})

    schema = "ts timestamp, seq bigint, domain string, url string, count bigint, tripped boolean"
    return failures.withWatermark("ts", late).groupBy("domain").applyInPandasWithState(step, schema, "start bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def enrichment_worker(records: DataFrame, store: Callable[[], DataFrame], save: Callable[[DataFrame], None], checkpoint: str, seconds: int = 5, once: bool = False) -> StreamingQuery:
    """Enriches a stream of records and writes them back: store() gives the table as it is, save() replaces it.

    Records that can't be enriched, and those that the table doesn't hold, are left out; they don't hold up others.
    """

    def batch(df: DataFrame, _: int) -> None:
        done = enriched(df.where(needs_enrichment()), F.unix_timestamp(F.current_timestamp())).where(F.col("error").isNull()).drop("error")
        now = store()
        done = done.select(*now.columns).join(missed(now, done).select("id"), "id", "left_anti").select(*now.columns)
        save(upserted(now, done))

    w = records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{seconds} seconds")).start()
