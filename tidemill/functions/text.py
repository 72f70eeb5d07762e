"""Column functions over text. All of them stay in the JVM, except words_uax29()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Phrases by which boilerplate is known, and those of short navigation texts.
BOILERPLATE = [
    "cookie", "privacy policy", "terms of service", "terms and conditions", "subscribe to", "sign up for", "follow us on", "share this", "related posts",
    "you may also like", "advertisement", "sponsored", "click here", "read more", "learn more", "©", "all rights reserved", "powered by",
]
NAVIGATION = ["menu", "home", "contact"]
NAVIGATION_BYTES = 15
# The sentiment lexicon.
POSITIVE = ["good", "great", "excellent", "amazing", "wonderful", "fantastic", "positive", "happy", "love", "best", "awesome", "beautiful"]
NEGATIVE = ["bad", "terrible", "awful", "horrible", "negative", "sad", "hate", "worst", "ugly", "poor", "disappointing", "failed"]

EMBEDDING_SIZE = 768


def let(value: Column, f) -> Column:
    """f(value), with value computed once a row however often, and wherever, f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def any_of(text: Column, words: list[str]) -> Column:
    """Whether text contains any of the words. One alternation, so the text is scanned once."""
    return text.rlike("|".join(rf"\Q{w}\E" for w in words))


def small_batches(df: DataFrame, most: str = "4m") -> DataFrame:
    """df; from now on Arrow batches of its session have about that many bytes at most, so what a Python worker holds depends on no table's size. Results don't depend on it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
    return df


def ascii_borders(pattern: str) -> str:
    r"""The pattern with \b as a border of ASCII words on every Java: some take letters like n with a tilde for part of the word beside them."""
    w = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))")


def is_boilerplate(text: Column) -> Column:
    low = F.lower(text)
    return any_of(low, BOILERPLATE) | ((F.octet_length(text) < NAVIGATION_BYTES) & any_of(low, NAVIGATION))


def word_count(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")).cast("long")


def normalized(text: Column) -> Column:
    """Lower case; letters, digits and single spaces only."""
    kept = F.regexp_replace(F.lower(text), r"(?U)[^\p{IsAlphabetic}\p{N}\s]", "")
    return F.btrim(F.regexp_replace(kept, r"(?U)\s+", " "))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the normalized text: shorter texts are one, empty ones none."""

    def grams(t: Column) -> Column:
        # one scan: an empty match at each character, not at a surrogate pair's second half, with what follows captured
        cut = F.regexp_extract_all(t, F.lit(rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{{n}}}))"), F.lit(1))
        return F.when(F.length(t) >= n, F.array_distinct(cut)).when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))

    return let(normalized(text), grams)


def with_shingle_codes(df: DataFrame, text: Column, out: str = "grams") -> DataFrame:
    """df with the distinct character 3-grams of the normalized text as ascending numbers: three code points of 21 bits each, so equal for equal 3-grams only.

    Shorter texts are one gram, empty and null ones none. The texts' characters are one vector, cut and sorted at once.
    """
    names = df.columns
    rows = df.withColumn("_normal", normalized(F.coalesce(text, F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                grams = []
                for t in b.column(b.num_columns - 1).to_pylist():
                    c = np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.int64)
                    if len(c) >= 3:
                        grams.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
                    else:
                        grams.append(np.array([int(sum(int(x) << 21 * k for k, x in enumerate(c[::-1])))] if len(c) else [], np.int64))
                ends = np.append(0, np.cumsum([len(g) for g in grams])).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], values], names=[*names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInArrow(run, f"{kinds}, `{out}` array<bigint>")


def words(text: Column) -> Column:
    """Runs of letters and digits: an approximation of Unicode's word boundaries that SQL can express."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _cut_uax29(text: pd.Series) -> pd.Series:
    import regex

    cut, alnum = regex.compile(r"(?w)\b"), regex.compile(r"[\p{Alphabetic}\p{N}]")
    return text.map(lambda t: "" if t is None else "\n".join(w for w in cut.split(t) if alnum.search(w)))


def words_uax29(text: Column) -> Column:
    """Words by Unicode's default word boundaries, those with a letter or digit.

    Python gives a text's words as lines of one string (there is a boundary on both sides of every line end, so no word has one), and the JVM
    makes the array: a batch takes about as much of Python's memory as its texts, and not an object for each word.
    """
    lines = F.pandas_udf(_cut_uax29, "string")(text)
    return let(lines, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, "\n")))


def sentiment(text: Column) -> Column:
    """(positive - negative) / all of the lexicon's words that the text contains, 0 without any; null for an empty text."""
    low = F.lower(text)
    count = lambda ws: sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0))
    p, n = count(POSITIVE), count(NEGATIVE)
    score = F.when(p + n == 0, F.lit(0.0)).otherwise((p - n) / (p + n))
    return F.when(text != "", score)


def seed_of(text: Column) -> Column:
    """A number from 0 to 2^60 from the text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


#: There are that many different placeholder vectors.
VECTORS = 2000


def embeddings(spark: SparkSession, size: int = EMBEDDING_SIZE) -> DataFrame:
    """(rest, vector): the placeholder vectors of texts whose seed_of() leaves that rest."""
    return spark.range(VECTORS, numPartitions=1).select(F.col("id").alias("rest"), _unit(F.col("id"), size).alias("vector"))


def _unit(seed: Column, size: int) -> Column:
    raw = let(seed, lambda s: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: ((s % VECTORS + i) % VECTORS) / F.lit(1000.0) - 1))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return let(raw, lambda v: let(norm(v), lambda m: F.transform(v, lambda x: F.when(m > 0, x / m).otherwise(x)))).cast("array<float>")


def embedding(text: Column, size: int = EMBEDDING_SIZE) -> Column:
    """A placeholder vector of unit length from the text's hash; null for an empty text."""
    return F.when(text != "", _unit(seed_of(text), size))


def checked_embedding(vector: Column, size: int = EMBEDDING_SIZE, strict: bool = True) -> Column:
    """The vector if it has that size; else an error, or null where strict is off."""
    wrong = F.raise_error(F.concat(F.lit(f"an embedding needs {size} values, not "), F.size(vector).cast("string"))).cast("array<float>") if strict else F.lit(None).cast("array<float>")
    return F.when(vector.isNull(), F.lit(None).cast("array<float>")).when(F.size(vector) == size, vector.cast("array<float>")).otherwise(wrong)


def clamped(x: Column, low: float, high: float) -> Column:
    """null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))
