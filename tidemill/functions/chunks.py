"""Sliding windows of words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, small_batches, words, words_uax29


@dataclass(frozen=True)
class ChunkConfig:
    window: int = 2048
    overlap: int = 204
    least: int = 50

    @classmethod
    def of_window(cls, window: int) -> ChunkConfig:
        return cls(window, window // 10, 50)

    @property
    def step(self) -> int:
        return max(1, self.window - self.overlap)


def chunk_array(text: Column, word_array: Column, config: ChunkConfig | None = None) -> Column:
    """Chunks (chunk_index, start_index, end_index, word_count, content) of a text whose words are given.

    A text of at most one window is one chunk with the text as it is. A last window of fewer than `least` words joins the
    one before, its words added to those that are there.
    """
    c = config or ChunkConfig()
    long = lambda x: x.cast("long")

    def cut(w: Column) -> Column:
        n = F.size(w)
        last = F.ceil((n - c.window) / F.lit(c.step)).cast("int")  # index of the last window
        tail = n - last * c.step
        merge = (tail < c.least) & (last > 0)

        def chunk(i: Column) -> Column:
            start = i * c.step
            own = F.least(F.lit(c.window), n - start)
            more = merge & (i == last - 1)
            content = F.array_join(F.slice(w, start + 1, own), " ")
            return F.struct(
                long(i).alias("chunk_index"), long(start).alias("start_index"), long(F.when(more, n).otherwise(start + own)).alias("end_index"), long(own + F.when(more, tail).otherwise(0)).alias("word_count"),
                F.when(more, F.concat(content, F.lit(" "), F.array_join(F.slice(w, last * c.step + 1, tail), " "))).otherwise(content).alias("content"),
            )

        one = F.array(F.struct(F.lit(0).cast("long").alias("chunk_index"), F.lit(0).cast("long").alias("start_index"), long(n).alias("end_index"), long(n).alias("word_count"), text.alias("content")))
        return F.when(n <= c.window, one).otherwise(F.transform(F.sequence(F.lit(0), last - F.when(merge, 1).otherwise(0)), chunk))

    return let(word_array, cut)


def chunks(df: DataFrame, keys: list[str], text_col: str = "text", config: ChunkConfig | None = None, exact: bool = True) -> DataFrame:
    """One row for each chunk. exact: Unicode's word boundaries; else runs of letters and digits, all in the JVM."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    got = (words_uax29 if exact else words)(text)
    return small_batches(df).select(*keys, F.inline(chunk_array(text, got, config)))


def chunk_texts(df: DataFrame, keys: list[str], **options) -> DataFrame:
    return chunks(df, keys, **options).select(*keys, "chunk_index", "content")


def estimated_chunks(n_words: Column, config: ChunkConfig | None = None) -> Column:
    c = config or ChunkConfig()
    return F.when(n_words <= c.window, F.lit(1)).otherwise(1 + F.ceil((n_words - c.window) / F.lit(c.step))).cast("long")
