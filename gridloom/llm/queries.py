"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, ecoc_langid, exact_dedup, ngram_join, packing, pitman_yor, spotsigs, toxicity_kn, training_order, warc
from .common import fold_of, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents) t
WINDOW w AS (PARTITION BY norm ORDER BY length(body) DESC, doc_id)
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), similarity=0.8, n=5, recall=0.9999)


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), sequence=1024, key=20_240_601)


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_of(F.col("doc_id")) == 1
    out = pitman_yor.score(table(spark, sf_dir, "documents"), ~held_out)
    return out.withColumn("held_out", held_out)


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ecoc_langid.fit(docs, fold_of(F.col("doc_id")) != 0)
    out = ecoc_langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_kn.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id")) != 0)
    out = toxicity_kn.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP10_SQL = """
SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN octet_length(encode(body)) >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(body)) >= 100 AND first <> page_id THEN first END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages) t
"""


def queries() -> dict:
    found = (
        op1_exact_dedup, op2_packing, op3_ngram_join, op4_training_order, op5_pitman_yor,
        op6_spotsigs, op7_language_id, op8_byte_bpe, op9_toxicity, op10_warc,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op10_warc": OP10_SQL}
