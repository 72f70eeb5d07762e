"""Predicates over fetched responses, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import any_of

# What tells a ban.
BAN_PHRASES = r"(?i)(Just a moment|Attention Required|Security Check|Access Denied|Cloudflare|Captcha)"
BAN_SIGNATURES = ["captcha-delivery", "cf-turnstile", "datadome", "challenge-platform"]
BLOCKED = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".woff", ".woff2", ".ttf", ".mp4", ".webm", ".css"]
LEAST_BYTES = 500


def soft_ban_trigger(body: Column) -> Column:
    """The phrase or signature that makes a body a soft ban, null without one."""
    phrase = F.regexp_extract(body, BAN_PHRASES, 1)
    signature = F.coalesce(*[F.when(F.contains(body, F.lit(s)), F.lit(s)) for s in BAN_SIGNATURES])
    return F.when(phrase != "", phrase).otherwise(signature)


def classify(status: Column, body: Column) -> Column:
    """hard_ban, error, empty, soft_ban or ok, in this order."""
    ok = (status >= 200) & (status < 300)
    return F.when(status.isin(403, 429), "hard_ban").when(~ok, "error").when(F.octet_length(F.coalesce(body, F.lit(""))) < LEAST_BYTES, "empty").when(soft_ban_trigger(body).isNotNull(), "soft_ban").otherwise("ok")


def should_block(url: Column) -> Column:
    return any_of(F.lower(url), BLOCKED)


def escalate(attempts: DataFrame) -> DataFrame:
    """attempts (url, tier 0 to 2, outcome) -> for each url the attempt that settles it.

    Tiers are tried in order as long as the outcome is a ban or an empty response; any other outcome, or the last tier, settles.
    """
    goes_on = F.col("outcome").isin("soft_ban", "hard_ban", "empty")
    before = Window.partitionBy("url").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    reached = attempts.withColumn("_stopped", F.coalesce(F.max((~goes_on).cast("int")).over(before), F.lit(0)))
    return reached.where("_stopped = 0").groupBy("url").agg(F.max("tier").alias("tier"), F.max_by("outcome", "tier").alias("outcome"))


def round_robin(position: Column, n: int) -> Column:
    """Which of n proxies the request at a position (from 0) takes; null without proxies."""
    return F.pmod(position, F.lit(n)) if n else F.lit(None).cast("long")


def changed(df: DataFrame, key: str, order: str, fingerprint: str = "fingerprint") -> DataFrame:
    """df with changed: whether the fingerprint differs from the one before of the same key; null for the first."""
    return df.withColumn("changed", F.col(fingerprint) != F.lag(fingerprint).over(Window.partitionBy(key).orderBy(order)))
