"""A corpus pipeline of five stages: language, toxicity, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread for the next one.  The first four return the columns of
``documents`` for the documents they keep, the last one the packed pieces.
Null and empty texts have no language and go in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import ecoc_langid, exact_dedup, ngram_join, packing, toxicity_kn
from gridloom.llm.common import fold_of, free_names, keep_rows, remove, scratch, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language and those between two languages."""
    model = ecoc_langid.fit(docs, fold_of(F.col("doc_id")) != 0)
    names = free_names(docs, "lang_pred", "score", "ambiguous")
    out = ecoc_langid.predict(docs, model, least_gap=0.01, out_cols=tuple(names))
    return out.where((F.col(names[0]) != ecoc_langid.UNDETERMINED) & ~F.col(names[2])).select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely toxic than not."""
    model = toxicity_kn.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id")) != 0)
    name = free_names(docs, "toxicity")[0]
    return toxicity_kn.score(docs, model, out_col=name).where(F.col(name) < 0.5).select(docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one stays."""
    return keep_rows(docs, exact_dedup.exact_duplicates(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are connected by a Jaccard of 0.8 or more on five-word shingles, one stays."""
    return keep_rows(docs, ngram_join.near_duplicates(docs, similarity=0.8, n=5, recall=0.9999))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


STAGES = [("language", language), ("toxicity", toxicity), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("packing", packed)]
#: No SQL expresses the trained stages and the tokenizer; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
