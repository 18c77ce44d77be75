"""Readers of positioned pages and of table records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<text:string,x0:double,y0:double,x1:double,y1:double,font_size:double,font_name:string>"
REGION = "struct<x0:double,y0:double,x1:double,y1:double,region_text:string,context_text:string,confidence:double>"
PAGE = f"struct<page_number:int,page_width:double,page_height:double,full_text:string,text_items:array<{ITEM}>,table_regions:array<{REGION}>,is_table_page:boolean,error:string>"
DOCUMENT = f"pdf_path string, total_pages int, pages array<{PAGE}>, parse_time_sec double, error string"
TABLE = "page int, type string, data array<array<string>>, text string, extractor string, confidence double, has_border boolean, context_text string, parse_status string"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Parse results, one JSON document per file."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def pages(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("pdf_path").alias("doc_id"), F.explode("pages").alias("p")).select("doc_id", "p.*")


def text_items(pages_: DataFrame) -> DataFrame:
    """Items with text and a height, numbered within their page."""
    rows = pages_.select("doc_id", "page_number", F.posexplode("text_items").alias("item_id", "i")).select("doc_id", "page_number", "item_id", "i.*")
    return rows.where((F.trim("text") != "") & (F.col("y1") > F.col("y0"))).withColumn("y_mid", (F.col("y0") + F.col("y1")) / 2)


def tables(spark: SparkSession, path: str) -> DataFrame:
    """Table records, one JSON object per line."""
    return spark.read.schema(TABLE).json(path)


def page_spine(docs: DataFrame, pages_: DataFrame) -> DataFrame:
    """A row for every page of a document; pages that are missing get an error."""
    spine = docs.select(F.col("pdf_path").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.greatest("total_pages", F.lit(1)))).alias("page_number"))
    return spine.join(pages_, ["doc_id", "page_number"], "left").withColumn("error", F.when(F.col("full_text").isNull(), F.coalesce("error", F.lit("missing"))).otherwise(F.col("error")))


def unchanged(cached: DataFrame, current: DataFrame) -> DataFrame:
    """Cached documents whose content hash and size still hold: the others must be parsed again."""
    return cached.join(current.select("content_hash", "size"), ["content_hash", "size"], "left_semi")


MIB = 1 << 20


def content_hash(content: Column, overlapping: bool = False) -> Column:
    """MD5 of the first and last MiB of a file's content.

    Below 2 MiB that is the whole content, unless ``overlapping``, which takes the
    last MiB in any case, so the middle of a smaller file counts twice.
    """
    size = F.octet_length(content)
    tail = F.substring(content, F.greatest(size - MIB, F.lit(0)) + 1, F.lit(MIB))
    rest = F.substring(content, F.lit(MIB + 1), F.lit(MIB))
    end = tail if overlapping else F.when(size > 2 * MIB, tail).otherwise(rest)
    return F.md5(F.concat(F.substring(content, F.lit(1), F.lit(MIB)), end))


def cached_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with their size and time, the latest first; their content isn't read, and empty files don't show."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime").orderBy(F.desc("modificationTime"), "path")


def valid_cache(cached: DataFrame, current: DataFrame, version: int = 2) -> DataFrame:
    """Cached records (content_hash, size, cache_version) of ``version`` or later whose file is as it was."""
    return unchanged(cached.where(F.col("cache_version") >= version), current)


def first_filled(*channels: DataFrame) -> DataFrame:
    """Rows (doc_id, ...) of each document from the first channel that has any."""
    out = channels[0]
    for more in channels[1:]:
        out = out.unionByName(more.join(out.select("doc_id").distinct(), "doc_id", "left_anti"))
    return out
