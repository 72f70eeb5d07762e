"""Entities by regular expressions, in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_borders

# One pattern for each entity type. Digits and white space are Unicode's, written as classes that Java's and other regular expressions share;
# \b tells ASCII words apart.
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "url": r"""https?://[^\s\p{Z}\x{85}"'<>\]\)]+[^\s\p{Z}\x{85}"'<>\]\)\.,;:!?]""",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}",
    "date_iso": r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}",
    "phone_us": r"(?:\+1[-.\s\p{Z}\x{85}]?)?\(?[0-9]{3}\)?[-.\s\p{Z}\x{85}]?[0-9]{3}[-.\s\p{Z}\x{85}]?[0-9]{4}",
    "phone_intl": r"\+[1-9]\p{Nd}{1,14}",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "credit_card": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
    "ssn": r"\b\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}\b",
    "hashtag": r"#[a-zA-Z][a-zA-Z0-9_]*",
    "mention": r"@[a-zA-Z][a-zA-Z0-9_]*",
    "currency": r"[$€£][\s\p{Z}\x{85}]?\p{Nd}{1,3}(?:,\p{Nd}{3})*(?:\.\p{Nd}{2})?|\p{Nd}{1,3}(?:,\p{Nd}{3})*(?:\.\p{Nd}{2})?[\s\p{Z}\x{85}]?(?:USD|EUR|GBP)",
}


#: The types that are looked for by default: no addresses of machines and no personal numbers.
USUAL = tuple(t for t in PATTERNS if t not in ("ipv4", "credit_card", "ssn"))


def matches(text: Column, kind: str) -> Column:
    """Distinct matches of one type, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(ascii_borders(PATTERNS[kind])), F.lit(0))))


def entity_map(text: Column, types: Sequence[str] | None = None) -> Column:
    """type -> its distinct matches; types without a match are left out."""
    types = USUAL if types is None else types
    pairs = [x for t in types for x in (F.lit(t), matches(F.coalesce(text, F.lit("")), t))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0) if pairs else F.create_map().cast("map<string,array<string>>")


def entity_total(entities: Column) -> Column:
    return F.aggregate(F.map_values(entities), F.lit(0).cast("long"), lambda acc, v: acc + F.size(v))


def entities_of(df: DataFrame, text_col: str = "text", types: Sequence[str] | None = None) -> DataFrame:
    """df with entities (map) and entity_count (long)."""
    out = df.withColumn("entities", entity_map(F.col(text_col), types))
    return out.withColumn("entity_count", entity_total(F.col("entities")))


def entity_rows(df: DataFrame, keys: list[str], text_col: str = "text", types: Sequence[str] | None = None) -> DataFrame:
    """One row for each key, type and distinct match."""
    out = df.select(*keys, F.explode(entity_map(F.col(text_col), types)).alias("entity_type", "values"))
    return out.select(*keys, "entity_type", F.explode("values").alias("value"))
