"""Exact duplicates by distributed MSD radix partitioning.

A normalised text is read as the digits (its length and first bytes), next
bytes, ...; each digit is eight times as wide as the one before, so a text of n
bytes has about log8(n/32) digits.  Texts are split by one digit after another;
a group that holds one text, or whose texts have ended, is done.  Groups are
compared by their bytes alone, no digest decides equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exists, maybe_broadcast, remove, scratch, stored

FIRST_BYTES, WIDER = 32, 8


def normalised(text: Column) -> Column:
    """The text without ASCII white space (space, and tab to carriage return); null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def bytes_of(text: Column, start: int, length: int | None = None) -> Column:
    """Part of a binary column from a zero-based position."""
    return F.substring(text, start + 1, 2**31 - 1 - start if length is None else length)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the most code points in the original
    text stays, then the smallest id (null ids last, of fully equal rows any
    one).  Empty and null texts are equal to each other.  Other columns are
    neither read nor returned.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "exact")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text).alias("points"), normalised(F.col(text_col)).cast("binary").alias("norm"))
    rows = rows.select("id", "points", "norm", F.octet_length("norm").alias("size"), bytes_of(F.col("norm"), 0, FIRST_BYTES).alias("digit"))
    done_columns = ["id", "points", "sha", "rid", "gid"]

    # first digit: groups of more than one, numbered as they are written; below zero, as later groups take a row's number
    first = rows.groupBy("size", "digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored(first.select("size", "digit", (-1 - F.monotonically_increasing_id()).alias("gid")), f"{folder}/first")
    groups = maybe_broadcast(first, first.count(), 128)
    with_sha = rows.withColumn("sha", F.sha2("norm", 256))
    alone = with_sha.join(groups, ["size", "digit"], "left_anti").select("id", "sha")
    level = with_sha.join(groups, ["size", "digit"]).select(
        "id", "points", "sha", "size", F.monotonically_increasing_id().alias("rid"), "gid", bytes_of(F.col("norm"), FIRST_BYTES).alias("rest"), (F.col("size") <= FIRST_BYTES).alias("done")
    )
    level.write.partitionBy("done").parquet(f"{folder}/0")
    schema = level.drop("done").schema
    read = lambda k, done: spark.read.schema(schema).parquet(f"{folder}/{k}/done={done}")
    has = lambda k, done: exists(spark, f"{folder}/{k}/done={done}")

    k, consumed, width = 0, FIRST_BYTES, FIRST_BYTES * WIDER
    ended = [0] if has(0, "true") else []
    while has(k, "false"):
        now = read(k, "false").withColumn("digit", bytes_of(F.col("rest"), 0, width))
        counts = now.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("next")).where("n > 1")
        over = F.col("next").isNull() | (F.col("size") <= consumed + width)
        level = now.join(counts, ["gid", "digit"], "left").select(
            "id", "points", "sha", "size", "rid", F.coalesce("next", "rid").alias("gid"), F.when(~over, bytes_of(F.col("rest"), width)).alias("rest"), over.alias("done")
        )
        level.write.partitionBy("done").parquet(f"{folder}/{k + 1}")
        remove(spark, f"{folder}/{k}/done=false")
        k, consumed, width = k + 1, consumed + width, width * WIDER
        if has(k, "true"):
            ended.append(k)

    single = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    if ended:
        met = read(ended[0], "true").select(done_columns)
        for j in ended[1:]:
            met = met.unionByName(read(j, "true").select(done_columns))
        rank = F.struct((-F.col("points")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("keep_id"), F.col("rid").alias("keep_rid"))
        best = met.groupBy("gid").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
        met = met.join(best, "gid").select("id", "best.keep_id", "group_size", (F.col("rid") == F.col("best.keep_rid")).alias("kept"), "sha")
        single = single.unionByName(met)
    return single.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
