"""Records: creation, lifecycle, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EMBEDDING_SIZE, VECTORS, clamped, embeddings, seed_of, sentiment

SCHEMA = (
    "id string, url string, content_hash bigint, title string, text_content string, media_json string, embedding array<float>, sentiment_score double, "
    "word_count bigint, chunk_count bigint, quality_score double, is_deleted boolean, created_at bigint, updated_at bigint"
)
MEDIA = "array<struct<url:string,alt:string,media_type:string,width:int,height:int>>"


def record_id(*parts: Column) -> Column:
    """A UUID-shaped id from the parts: the same for the same parts, so a job that runs again makes the same ids."""
    h = F.md5(F.concat_ws("\u0001", *parts))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def new_records(df: DataFrame, url: Column, content_hash: Column, text: Column, now: Column, **fields: Column) -> DataFrame:
    """Records with defaults for all fields that aren't given. Rates are kept in their ranges; an embedding of a wrong size is left out."""
    f = {
        "title": F.lit(None).cast("string"), "media_json": F.lit("[]"), "embedding": F.lit(None).cast("array<float>"), "sentiment_score": F.lit(None).cast("double"),
        "word_count": F.lit(0), "chunk_count": F.lit(0), "quality_score": F.lit(0.0),
    } | fields
    stamp = now.cast("long")
    return df.select(
        record_id(url, content_hash.cast("string")).alias("id"), url.alias("url"), content_hash.cast("long").alias("content_hash"), f["title"].alias("title"), text.alias("text_content"), f["media_json"].alias("media_json"),
        F.when(F.size(f["embedding"]) == EMBEDDING_SIZE, f["embedding"].cast("array<float>")).alias("embedding"), clamped(f["sentiment_score"], -1.0, 1.0).alias("sentiment_score"),
        f["word_count"].cast("long").alias("word_count"), f["chunk_count"].cast("long").alias("chunk_count"), clamped(f["quality_score"].cast("double"), 0.0, 1.0).alias("quality_score"),
        F.lit(False).alias("is_deleted"), stamp.alias("created_at"), stamp.alias("updated_at"),
    )


def needs_enrichment() -> Column:
    return F.col("embedding").isNull() | F.col("sentiment_score").isNull()


def unenriched(records: DataFrame, limit: int, order: str = "id", include_deleted: bool = False) -> DataFrame:
    out = records.where(needs_enrichment())
    return (out if include_deleted else out.where(~F.col("is_deleted"))).orderBy(order).limit(limit)


def touched(records: DataFrame, now: Column) -> DataFrame:
    return records.withColumn("updated_at", now.cast("long"))


def soft_deleted(records: DataFrame, which: Column, now: Column) -> DataFrame:
    hit = F.coalesce(which, F.lit(False))
    return records.withColumn("updated_at", F.when(hit, now.cast("long")).otherwise(F.col("updated_at"))).withColumn("is_deleted", F.col("is_deleted") | hit)


def upserted(records: DataFrame, updates: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """records, each replaced by the last update of the same key: that with the greatest `order`, of equal ones that with the greatest hash of all its columns."""
    last = F.max_by(F.struct(*updates.columns), F.struct(F.col(order), F.xxhash64(*[c for c in updates.columns if not c.startswith("_")])))
    new = updates.groupBy(key).agg(last.alias("_new"))
    joined = records.select(F.col(key), F.struct(*records.columns).alias("_old")).join(new, key, "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in records.columns])


def missed(records: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Updates of records that there aren't."""
    return updates.join(records.select(key), key, "left_anti")


def enriched(records: DataFrame, now: Column, with_embedding: bool = True, with_sentiment: bool = True) -> DataFrame:
    """records with what they lack, and error: why a record can't be enriched (then it stays as it is).

    The placeholder vectors are 2,000, made once and joined by the text's remainder.
    """
    text = F.coalesce(F.col("text_content"), F.lit(""))
    todo = needs_enrichment() & (text != "")
    new = {"error": F.when(needs_enrichment() & (text == ""), "Empty text"), "updated_at": F.when(todo, now.cast("long")).otherwise(F.col("updated_at"))}
    if with_embedding:
        rest = F.when(todo & F.col("embedding").isNull(), seed_of(text) % VECTORS)
        records = records.withColumn("_rest", rest).join(F.broadcast(embeddings(records.sparkSession).withColumnRenamed("rest", "_rest")), "_rest", "left")
        new["embedding"] = F.coalesce(F.col("vector"), F.col("embedding"))
    if with_sentiment:
        new["sentiment_score"] = F.when(todo & F.col("sentiment_score").isNull(), clamped(sentiment(text), -1.0, 1.0)).otherwise(F.col("sentiment_score"))
    return records.withColumns(new).drop("_rest", "vector")


def stored_counts(records: DataFrame) -> DataFrame:
    """One row: count, enriched_count and deleted_count of a store's records; enriched are those that lack nothing."""
    return records.agg(F.count("*").alias("count"), F.count_if(~needs_enrichment()).alias("enriched_count"), F.count_if("is_deleted").alias("deleted_count"))


def worker_counts(enriched_records: DataFrame) -> DataFrame:
    """One row: processed and errors, of what enriched() gave for records that lacked something."""
    return enriched_records.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def media(url: Column, kind: str, alt: Column | None = None, width: int | None = None, height: int | None = None) -> Column:
    """One reference for media_json: image, video, audio or document."""
    return F.struct(url.alias("url"), (alt if alt is not None else F.lit(None).cast("string")).alias("alt"), F.lit(kind).alias("media_type"), F.lit(width).cast("int").alias("width"), F.lit(height).cast("int").alias("height"))


def media_json(*references: Column) -> Column:
    return F.to_json(F.array(*references), {"ignoreNullFields": "false"})


def media_rows(records: DataFrame) -> DataFrame:
    return records.select("id", F.inline(F.from_json("media_json", MEDIA)))
