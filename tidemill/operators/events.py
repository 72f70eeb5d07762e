"""Monitoring of crawl events: success windows, ban rates, alerts with cooldown, circuit breakers, rate limits, memory pressure.

Everything that windows and running aggregates can tell is told by them. Rules whose state depends on the order of events, and which reset
themselves, run per key over sorted rows in Arrow batches that are never gathered whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEV1_RATE, SEV1_SECONDS, SEV3_RATE, LEAST, COOLDOWN = 0.5, 300, 0.9, 10, 300
SEVERITY = {"GLOBAL_SUCCESS_RATE_LOW": "SEV-1", "DOMAIN_BAN_RATE_HIGH": "SEV-3", "MEMORY_PRESSURE": "SEV-2", "CIRCUIT_BREAKER_OPEN": "SEV-3", "RATE_LIMIT_EXCEEDED": "SEV-3", "CUSTOM_CRITICAL": "SEV-1", "CUSTOM_WARNING": "SEV-3"}


def custom_type(name: str) -> str:
    return f"CUSTOM_{name.upper()}"


def log_level(severity: Column) -> Column:
    return F.when(severity.isin("SEV-1", "SEV-2"), "error").when(severity == "SEV-3", "warn").otherwise("info")


def percent(x: Column) -> Column:
    return F.format_string("%.1f", x * 100)


def _micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


# --- success rates


def success_windows(events: DataFrame, seconds: int = SEV1_SECONDS) -> DataFrame:
    """Tumbling windows: window_start, success_count, failure_count, success_rate. events: ts, success."""
    w = F.window("ts", f"{seconds} seconds")
    n = events.groupBy(w.alias("w")).agg(F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"))
    return n.select(F.col("w.start").alias("window_start"), "success_count", "failure_count", (F.col("success_count") / (F.col("success_count") + F.col("failure_count"))).alias("success_rate"))


def sev1_windows(events: DataFrame, rate: float = SEV1_RATE, least: int = LEAST, seconds: int = SEV1_SECONDS) -> DataFrame:
    """Events that trip the rule in tumbling windows: failures after which the window so far has enough requests and too few successes."""
    so_far = Window.partitionBy("w").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("w", F.window("ts", f"{seconds} seconds")["start"]).withColumn("total", F.count("*").over(so_far)).withColumn("won", F.sum(F.col("success").cast("int")).over(so_far))
    out = out.withColumn("success_rate", F.col("won") / F.col("total"))
    return out.where(~F.col("success") & (F.col("total") >= least) & (F.col("success_rate") < rate)).select("ts", "seq", F.col("w").alias("window_start"), "total", "success_rate")


def sev1_exact(events: DataFrame, rate: float = SEV1_RATE, least: int = LEAST, seconds: int = SEV1_SECONDS) -> DataFrame:
    """The same under the resetting rule: a window starts with the first event, and the first event later than its length wipes the counts, itself included.

    The rule is one state for all events, so they pass through one task, in order, in batches; keep to sev1_windows() where tumbling windows will do.
    """
    rows = events.select("ts", "seq", F.col("success").cast("boolean").alias("success")).orderBy("ts", "seq").coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, won, total = None, 0, 0
        for b in batches:
            hit = []
            for i, (ts, ok) in enumerate(zip(b.column("ts").to_pylist(), b.column("success").to_pylist())):
                start = ts if start is None else start
                won, total = won + bool(ok), total + 1
                if (ts - start).total_seconds() > seconds:
                    start, won, total = ts, 0, 0
                if not ok and total >= least and won / total < rate:
                    hit.append((i, total, won / total))
            at = pa.array([h[0] for h in hit], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("ts").take(at), b.column("seq").take(at), pa.array([h[1] for h in hit], pa.int64()), pa.array([h[2] for h in hit], pa.float64())], names=["ts", "seq", "total", "success_rate"])

    return rows.mapInArrow(run, "ts timestamp, seq bigint, total bigint, success_rate double")


def sev1_alerts(tripped: DataFrame, rate: float = SEV1_RATE) -> DataFrame:
    message = F.concat(F.lit("Global success rate ("), percent(F.col("success_rate")), F.lit(f"%) below threshold ({rate * 100:.1f}%)"))
    context = F.create_map(F.lit("success_rate"), F.format_string("%.4f", "success_rate"), F.lit("threshold"), F.lit(f"{rate:.4f}"))
    return _alerts(tripped, "GLOBAL_SUCCESS_RATE_LOW", message, context)


def _alerts(df: DataFrame, kind: str, message: Column, context: Column) -> DataFrame:
    return df.select("ts", "seq", F.lit(kind).alias("alert_type"), F.lit(SEVERITY[kind]).alias("severity"), message.alias("message"), context.alias("context"))


# --- ban rates


def ban_rates(events: DataFrame) -> DataFrame:
    """events (ts, seq, domain, success, is_ban) with each domain's totals so far: total, bans, ban_rate."""
    so_far = Window.partitionBy("domain").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("total", F.count("*").over(so_far)).withColumn("bans", F.sum(F.col("is_ban").cast("int")).over(so_far))
    return out.withColumn("ban_rate", F.col("bans") / F.col("total"))


def sev3_events(events: DataFrame, rate: float = SEV3_RATE, least: int = LEAST) -> DataFrame:
    return ban_rates(events).where((F.col("total") >= least) & (F.col("ban_rate") > rate))


def sev3_alerts(tripped: DataFrame, rate: float = SEV3_RATE) -> DataFrame:
    message = F.concat(F.lit("Domain "), F.col("domain"), F.lit(" ban rate ("), percent(F.col("ban_rate")), F.lit(f"%) above threshold ({rate * 100:.1f}%)"))
    context = F.create_map(F.lit("domain"), F.col("domain"), F.lit("ban_rate"), F.format_string("%.4f", "ban_rate"), F.lit("threshold"), F.lit(f"{rate:.4f}"))
    return _alerts(tripped, "DOMAIN_BAN_RATE_HIGH", message, context)


def memory_alerts(samples: DataFrame) -> DataFrame:
    """samples: ts, seq, used_percent."""
    return _alerts(samples, "MEMORY_PRESSURE", F.concat(F.lit("Memory usage at "), F.format_string("%.1f", "used_percent"), F.lit("%")), F.create_map(F.lit("usage_percent"), F.format_string("%.2f", "used_percent")))


def circuit_alerts(trips: DataFrame) -> DataFrame:
    """trips: ts, seq, domain."""
    return _alerts(trips, "CIRCUIT_BREAKER_OPEN", F.concat(F.lit("Circuit breaker opened for domain "), F.col("domain")), F.create_map(F.lit("domain"), F.col("domain")))


def custom_alerts(df: DataFrame, severity: str, name: str, message: Column) -> DataFrame:
    return df.select("ts", "seq", F.lit(custom_type(name)).alias("alert_type"), F.lit(severity).alias("severity"), message.alias("message"), F.create_map().cast("map<string,string>").alias("context"))


def critical(df: DataFrame, message: Column) -> DataFrame:
    return custom_alerts(df, "SEV-1", "critical", message)


def warning(df: DataFrame, message: Column) -> DataFrame:
    return custom_alerts(df, "SEV-3", "warning", message)


def fired(alerts: DataFrame, cooldown: int = COOLDOWN) -> DataFrame:
    """The alerts that are sent: of one type none within `cooldown` seconds after one that was, whatever domain it told of.

    Cooldowns chain, so each type is scanned in order; rows stream through, a type never has to fit in memory. What is scanned are times only, of each
    the first alert; as few are sent as periods fit into the time, and these are then looked up.
    """
    alerts = alerts.select("ts", "seq", "alert_type", "severity", "message", "context")
    if cooldown <= 0:
        return alerts
    rows = alerts.groupBy("alert_type", "ts").agg(F.min("seq").alias("seq")).select("ts", "seq", "alert_type").repartition("alert_type").sortWithinPartitions("alert_type", "ts", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, last = None, None
        for b in batches:
            keep = []
            for ts, k in zip(b.column("ts").to_pylist(), b.column("alert_type").to_pylist()):
                if k != kind:
                    kind, last = k, None
                sent = last is None or (ts - last).total_seconds() >= cooldown
                last = ts if sent else last
                keep.append(sent)
            yield b.filter(pa.array(keep))

    sent = rows.mapInArrow(run, "ts timestamp, seq bigint, alert_type string")
    return alerts.join(sent, ["ts", "seq", "alert_type"], "left_semi").dropDuplicates(["ts", "seq", "alert_type"]).select("ts", "seq", "alert_type", "severity", "message", "context")


def alert_stats(events: DataFrame) -> DataFrame:
    """success_count, failure_count, success_rate (1 without requests), error_rate."""
    n = events.agg(F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"))
    total = F.col("success_count") + F.col("failure_count")
    rate = F.when(total > 0, F.col("success_count") / total).otherwise(1.0)
    return n.select("success_count", "failure_count", rate.alias("success_rate"), (1 - rate).alias("error_rate"))


# --- circuit breaker

FAILURES, FAILURE_SECONDS = 3, 3600


def failure_counts(failures: DataFrame, most: int = FAILURES, ttl: int = FAILURE_SECONDS) -> DataFrame:
    """failures (ts, seq, domain, url) with count (since the first failure of a period of ttl seconds) and tripped (count above most)."""
    rows = failures.select("ts", "seq", "domain", "url").repartition("domain").sortWithinPartitions("domain", "ts", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, n = None, None, 0
        for b in batches:
            counts = []
            for ts, d in zip(b.column("ts").to_pylist(), b.column("domain").to_pylist()):
                if d != key or (ts - start).total_seconds() >= ttl:
                    key, start, n = d, ts, 0
                n += 1
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64()), pa.array([c > most for c in counts])], names=[*b.schema.names, "count", "tripped"])

    return rows.mapInArrow(run, "ts timestamp, seq bigint, domain string, url string, count bigint, tripped boolean")


def circuit_states(counted: DataFrame, checks: DataFrame, most: int = FAILURES, ttl: int = FAILURE_SECONDS) -> DataFrame:
    """checks (ts, domain) with state, failure_count, requires_full_browser, given failure_counts(). A domain that ever tripped stays open."""
    c = counted.select("ts", F.col("seq"), "domain", "count", "tripped", F.lit(0).alias("is_check"))
    start = F.last(F.when(F.col("count") == 1, F.col("ts")), ignorenulls=True)
    q = checks.select("ts", F.lit(None).cast("long").alias("seq"), "domain", F.lit(None).cast("long").alias("count"), F.lit(None).cast("boolean").alias("tripped"), F.lit(1).alias("is_check"))
    w = Window.partitionBy("domain").orderBy("ts", "is_check", "seq").rowsBetween(Window.unboundedPreceding, 0)
    out = c.union(q).withColumn("stuck", F.coalesce(F.max(F.col("tripped").cast("int")).over(w), F.lit(0)) == 1).withColumn("n", F.last("count", ignorenulls=True).over(w)).withColumn("since", start.over(w))
    alive = (_micros("ts") - _micros("since")) < ttl * 1_000_000
    n = F.when(F.col("stuck"), F.lit(most + 1)).when(alive, F.col("n")).otherwise(0).cast("long")
    return out.where("is_check = 1").select("ts", "domain", F.when(n > most, "open").otherwise("closed").alias("state"), n.alias("failure_count"), F.col("stuck").alias("requires_full_browser"))


def handed_over(counted: DataFrame) -> DataFrame:
    """URLs for the render queue, in order."""
    return counted.where("tripped").select("ts", "seq", "domain", "url")


def without_domains(counted: DataFrame, reset: DataFrame) -> DataFrame:
    """State after a reset of some domains."""
    return counted.join(reset.select("domain").distinct(), "domain", "left_anti")


# --- robots and rates

DEFAULT_DELAY, SLOW_FACTOR = 1000, 2


def crawl_delay(robots: Column, agent: str) -> Column:
    """(standard_delay_ms, slow_path_delay_ms) of the last matching rule; 1000 and 2000 without one.

    A block holds for an agent line of * or of a part of our agent's name; each agent line begins a block of its own.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(robots, F.lit("")), r"\r?\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: (x != "") & ~x.startswith("#"))
    start = F.struct(F.lit(False).alias("on"), F.lit(None).cast("long").alias("ms"))

    def step(acc: Column, line: Column) -> Column:
        low = F.lower(line)
        name = F.btrim(F.substring(low, F.lit(12), F.length(low)))
        on = F.when(low.startswith("user-agent:"), (name == "*") | F.contains(F.lit(agent.lower()), name)).otherwise(acc["on"])
        value = F.btrim(F.get(F.split(line, ":"), F.lit(1))).try_cast("double")
        found = on & low.startswith("crawl-delay:") & value.isNotNull()
        return F.struct(on.alias("on"), F.when(found, F.greatest(value * 1000, F.lit(0.0)).cast("long")).otherwise(acc["ms"]).alias("ms"))

    ms = F.coalesce(F.aggregate(lines, start, step, lambda acc: acc["ms"]), F.lit(DEFAULT_DELAY))
    return F.struct(ms.alias("standard_delay_ms"), (ms * SLOW_FACTOR).alias("slow_path_delay_ms"))


def _allowed(robots: pd.Series, agent: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([allowed(r or "", a, p) for r, a, p in zip(robots, agent, path)])


def crawl_allowed(robots: Column, agent: Column, path: Column) -> Column:
    """Whether a path may be fetched: the longest rule of the agent's own group, else of the group of all, decides; ties allow."""
    return F.pandas_udf(_allowed, "boolean")(robots, agent, path)


def allowed(robots: str, agent: str, path: str) -> bool:
    best = (-1, True)
    for n, ok, rx in _rules(robots, agent):
        if rx.match(path):
            best = max(best, (n, ok))
    return best[1]


@lru_cache(maxsize=4096)
def _rules(robots: str, agent: str) -> list[tuple[int, bool, re.Pattern]]:
    """The rules (length, whether they allow, pattern) of a file that hold for an agent. A file is parsed once, however many paths are asked for."""
    own, every, to, fresh = [], [], [], True
    token = re.match(r"[a-zA-Z_-]*", agent)[0].lower()
    found = False
    for line in robots.splitlines():
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            to = [] if fresh else to
            name = re.match(r"[a-zA-Z_-]*", value)[0].lower()
            if value == "*":
                to = [*to, every]
            elif name and name == token:
                to, found = [*to, own], True
            fresh = False
        elif key in ("allow", "disallow"):
            fresh = True
            if value:
                for rules in to:
                    rules.append((len(value), key == "allow", value))
        elif key:
            fresh = fresh or key != "crawl-delay"
    out = []
    for n, ok, pattern in own if found else every:
        end = pattern.endswith("$")
        out.append((n, ok, re.compile(".*".join(map(re.escape, (pattern[:-1] if end else pattern).split("*"))) + ("$" if end else ""))))
    return out


def requests_per_second(delay_ms: Column) -> Column:
    return F.when(delay_ms > 0, F.greatest(F.floor(F.lit(1000) / delay_ms), F.lit(1))).otherwise(1).cast("long")


def over_limit(requests: DataFrame, delays: DataFrame) -> DataFrame:
    """Seconds in which a domain had more requests than its limit allows: domain, second, n, allowed. Unknown domains have a delay of 1000 ms."""
    n = requests.groupBy("domain", F.date_trunc("second", "ts").alias("second")).agg(F.count("*").alias("n"))
    out = n.join(delays.select("domain", "delay_ms"), "domain", "left").withColumn("allowed", requests_per_second(F.coalesce("delay_ms", F.lit(DEFAULT_DELAY))))
    return out.where("n > allowed").select("domain", "second", "n", "allowed")


def schedule(requests: DataFrame, delay_ms: str = "delay_ms", slow: str = "is_slow") -> DataFrame:
    """requests (seq, domain, delay_ms, is_slow) with ready_ms: when each may start if a domain's follow each other at its delay; slow ones wait once more."""
    before = Window.partitionBy("domain").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    delay = F.coalesce(F.col(delay_ms), F.lit(DEFAULT_DELAY))
    cost = delay + F.when(F.col(slow), delay * (SLOW_FACTOR - 1)).otherwise(0)
    return requests.withColumn("ready_ms", F.sum(cost).over(before).cast("long"))


BLACKLIST_SECONDS, BACKOFF_SECONDS = 86_400, 3_600


def while_listed(requests: DataFrame, bans: DataFrame, ttl: int = BLACKLIST_SECONDS) -> DataFrame:
    """requests (ts, seq, domain) with listed: whether the domain was banned less than ttl seconds before. An as-of look at each domain's last ban, not a join over the range."""
    q = requests.select("ts", "seq", "domain", F.lit(1).alias("ask"))
    b = bans.select("ts", F.lit(None).cast("long").alias("seq"), "domain", F.lit(0).alias("ask"))
    last = F.last(F.when(F.col("ask") == 0, F.col("ts")), ignorenulls=True).over(Window.partitionBy("domain").orderBy("ts", "ask").rowsBetween(Window.unboundedPreceding, 0))
    out = q.union(b).withColumn("banned", last).where("ask = 1")
    return out.select("ts", "seq", "domain", F.coalesce((_micros("ts") - _micros("banned")) < ttl * 1_000_000, F.lit(False)).alias("listed"))


def keys(prefix: str, domain: Column, suffix: str | None = None) -> Column:
    parts = [F.lit(prefix), F.xxhash64(domain).cast("string"), *([F.lit(suffix)] if suffix else [])]
    return F.concat_ws(":", *parts)


# --- memory


def pressure(samples: DataFrame, high: float = 90.0, low: float = 85.0, key: str | None = None, order: tuple[str, ...] = ("ts",), bucket: str = "hour") -> DataFrame:
    """samples (ts, used_percent) with under_pressure: on above high, off below low, as before in between, off at the start. key: the host's column, if samples are of many.

    The state is the last mark, so it is found within each bucket of time, in parallel; what a bucket starts with is the last mark of those before, a look over one row a bucket.
    """
    own = [key] if key else []
    mark = F.when(F.col("used_percent") > high, True).when(F.col("used_percent") < low, False)
    rows = samples.withColumn("_bucket", F.date_trunc(bucket, "ts")).withColumn("_mark", mark)
    within = F.last("_mark", ignorenulls=True).over(Window.partitionBy(*own, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.where(F.col("_mark").isNotNull()).groupBy(*own, "_bucket").agg(F.max_by("_mark", F.struct(*order)).alias("_end"))
    every = rows.select(*own, "_bucket").distinct().join(ends, [*own, "_bucket"], "left")
    before = (Window.partitionBy(*own) if own else Window.partitionBy(F.lit(0))).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = every.select(*own, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_start"))
    out = rows.withColumn("_state", within).join(starts, [*own, "_bucket"])
    return out.withColumn("under_pressure", F.coalesce("_state", "_start", F.lit(False))).select(*samples.columns, "under_pressure")


# --- keys with an end


def live_at(entries: DataFrame, at: Column) -> DataFrame:
    """entries (key, value, ts, ttl_seconds; null: for good), the last of each key, that haven't ended at a time."""
    last = entries.where(F.col("ts") <= at).groupBy("key").agg(F.max_by(F.struct("value", "ts", "ttl_seconds"), "ts").alias("x")).select("key", "x.*")
    return last.where(F.col("ttl_seconds").isNull() | (_micros("ts") + F.col("ttl_seconds").cast("long") * 1_000_000 > _micros(at)))
