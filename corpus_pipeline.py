"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.

In all stages: columns of docs other than those of documents are left out; an empty docs gives an empty result; a missing label or benchmark
row takes nothing out. A null text has no words: it scores as an empty one, falls into the class of the wordless documents, has nothing to cut and is packed as
its end alone. Null ids are ids like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontam, packing, simhash, substrings, toxicity
from tidemill.llm.common import stored, table
from tidemill.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go. Equal texts go or stay together, repeated rows too."""
    return toxicity.without_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays: of repeated rows one, of texts without words one. A null id comes last."""
    return simhash.keep_one(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat an earlier 100-byte string go, and documents of which nothing is left. Null and empty texts stay. Rows that share an id come in the order of their text's hash."""
    out = substrings.remove_repeated(docs.select(*COLUMNS))
    return _documents(out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes"))))


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, those without an item id too, and documents that are benchmark passages for the most part. Null and empty texts stay, repeated rows are cut alike."""
    items = table(spark, sf_dir, "benchmark").withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))  # passages without an id go too
    return _documents(decontam.decontaminate(docs.select(*COLUMNS), items))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenized and packed into sequences of 2048 ids; each row has its pieces, repeated ones too."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", keep_one_of_each),
    ("substrings", cut_repeats),
    ("decontamination", cut_benchmarks),
    ("packing", pack),
]

#: SQL can express none of the classifier, the components and the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
