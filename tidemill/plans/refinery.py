"""The whole refinery over pages: content, metadata, tables, entities, chunks and statistics from one parse."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import ChunkConfig, chunk_array
from ..functions.entities import USUAL, entity_map, entity_total
from ..functions.text import words, words_uax29
from ..operators import pages as P

CHUNK = "array<struct<chunk_index:bigint,start_index:bigint,end_index:bigint,word_count:bigint,content:string>>"
TABLE = "array<struct<headers:array<string>,rows:array<array<string>>,score:int>>"


@dataclass(frozen=True)
class RefineryConfig:
    least_paragraph_bytes: int = 20
    least_area_words: int = 25
    chunks: ChunkConfig = field(default_factory=ChunkConfig)
    entities: tuple[str, ...] = USUAL
    with_tables: bool = True
    with_entities: bool = True
    with_chunks: bool = True
    exact_words: bool = True
    strict_json_ld: bool = False


def refine(pages: DataFrame, keys: list[str], config: RefineryConfig | None = None, html_col: str = "html") -> DataFrame:
    """keys, content, metadata, tables, entities, entity_count, chunks and stats. Entities and chunks are those of the cleaned text; an empty one has no chunks."""
    c = config or RefineryConfig()
    wanted = ["content", "head"] + ["tables"] * c.with_tables
    raw = P.parsed(pages, keys, wanted, html_col=html_col, least_words=c.least_area_words, strict=c.strict_json_ld)
    tables = P.scored_tables(F.col("raw_tables")) if c.with_tables else F.array().cast(TABLE)
    out = raw.select(*keys, P.content_struct(F.col("raw_content"), c.least_paragraph_bytes).alias("content"), P.metadata_struct(F.col("raw_head")).alias("metadata"), tables.alias("tables"))
    text = F.col("content.text")
    out = out.withColumn("entities", entity_map(text, c.entities) if c.with_entities else F.create_map().cast("map<string,array<string>>"))
    found = F.when(text != "", chunk_array(text, (words_uax29 if c.exact_words else words)(text), c.chunks)).otherwise(F.array().cast(CHUNK)) if c.with_chunks else F.array().cast(CHUNK)
    out = out.withColumn("entity_count", entity_total(F.col("entities"))).withColumn("chunks", found)
    size = lambda x: F.size(x).cast("long")
    stats = F.struct(
        F.col("content.word_count").alias("word_count"), size("content.paragraphs").alias("paragraph_count"), size("tables").alias("table_count"), F.col("entity_count"),
        size("chunks").alias("chunk_count"), F.col("content.quality_score").alias("quality_score"), F.col("content.found_main_content").alias("has_main_content"),
    )
    return out.withColumn("stats", stats)


def content_only(pages: DataFrame, keys: list[str], **options) -> DataFrame:
    return P.content(pages, keys, **options)


def metadata_only(pages: DataFrame, keys: list[str], **options) -> DataFrame:
    return P.metadata(pages, keys, **options)


def as_json(df: DataFrame, keys: list[str], pretty: bool = False) -> DataFrame:
    """keys and json: all other columns, nulls included."""
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])
    return df.select(*keys, F.to_json(rest, {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("json"))
