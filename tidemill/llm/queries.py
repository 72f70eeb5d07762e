"""The subpackage's registered queries: each applies its operator, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, kneser_ney, licenses, packing, quality, rans, simhash, substrings, toxicity, warc
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_digest(decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), phrases=licenses.CONTRACT_PHRASES).drop("matches")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.encoded(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "quality", "base_failed", "kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.lm_scores(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_packing": op2_packing,
        "op3_substrings": op3_substrings,
        "op4_license_scan": op4_license_scan,
        "op5_token_ids": op5_token_ids,
        "op6_toxicity": op6_toxicity,
        "op7_quality_rules": op7_quality_rules,
        "op8_warc": op8_warc,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_simhash": op10_simhash,
        "pipeline": pipeline,
    }


WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH b AS (SELECT item_id, {WORDS_SQL} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, array_to_string(ws[i : i + size - 1], ' ') AS win FROM (SELECT item_id, ws, least(10, len(ws)) AS size, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, coalesce({WORDS_SQL}, []) AS ws FROM documents),
dw AS (SELECT doc_id, size, i, array_to_string(ws[i : i + size - 1], ' ') AS win FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM iw))),
hits AS (SELECT doc_id, i, dw.size AS size, item_id FROM dw JOIN iw USING (size, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT d, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN kept IS NOT NULL AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 1000
"""


def oracle_sql() -> dict[str, str]:
    """SQL has no tokenizers, suffix arrays, classifiers or components; those queries are tested against brute force."""
    return {"op1_decontamination": OP1_SQL, "op8_warc": OP8_SQL}
