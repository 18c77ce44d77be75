"""Writers of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sheet_names(tables: DataFrame) -> DataFrame:
    """Adds sheet: P<page>-T<number on the page>-<title> without characters that sheets forbid, at most 31 long."""
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("table_id"))
    name = F.concat(F.lit("P"), F.lpad(F.col("page").cast("string"), 3, "0"), F.lit("-T"), F.lpad(n.cast("string"), 2, "0"), F.lit("-"), F.regexp_replace(F.coalesce("title", F.lit("")), r"[\\/*?:\[\]]", "-"))
    return tables.withColumn("sheet", F.substring(name, 1, 31))


def as_text(grid: DataFrame, separator: str = "\t") -> DataFrame:
    """(table_id, line_no, value): rows of (table_id, data) joined by the separator."""
    rows = grid.select("table_id", F.posexplode("data").alias("line_no", "r"))
    return rows.select("table_id", "line_no", F.array_join(F.transform("r", lambda c: F.coalesce(c, F.lit(""))), separator).alias("value"))


def write_json(tables: DataFrame, path: str) -> None:
    tables.write.mode("overwrite").json(path)


def write_text(grid: DataFrame, path: str, files: int = 8) -> None:
    """Text lines of all tables in a bounded number of files: a line with the table's id, then its rows."""
    lines = as_text(grid).unionByName(grid.select("table_id", F.lit(-1).alias("line_no"), F.concat(F.lit("# "), F.col("table_id").cast("string")).alias("value")))
    lines.repartitionByRange(files, "table_id").sortWithinPartitions("table_id", "line_no").select("value").write.mode("overwrite").text(path)


def csv_field(text: Column) -> Column:
    """A field in quotes where it holds a comma, a quote or a line end."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def csv_lines(grid: DataFrame, marks: DataFrame) -> DataFrame:
    """(table_id, line_no, value): for each table of (table_id, data) a marker (table_id, mark) and its rows, padded to its widest."""
    width = F.array_max(F.transform("data", F.size))
    padded = F.transform("r", csv_field)
    rows = grid.select("table_id", width.alias("w"), F.posexplode("data").alias("k", "r"))
    value = F.array_join(F.concat(padded, F.array_repeat(F.lit(""), (F.col("w") - F.size("r")).cast("int"))), ",")
    return rows.select("table_id", (F.col("k") + 1).alias("line_no"), value.alias("value")).unionByName(marks.select("table_id", F.lit(0).alias("line_no"), csv_field(F.col("mark")).alias("value")))


def sheet_rows(grid: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows of a sheet for each table: its title, its source, an empty row, a blank row, the data with a blank column on both sides, a blank row.

    ``titles`` is (table_id, title, page, extractor).
    """
    width = F.array_max(F.transform("data", F.size))
    t = grid.join(titles, "table_id").withColumn("w", width + 2)
    blank = F.array_repeat(F.lit(""), F.col("w").cast("int"))
    data = F.transform("data", lambda r: F.slice(F.concat(F.array(F.lit("")), F.transform(r, lambda c: F.coalesce(c, F.lit(""))), blank), F.lit(1), F.col("w").cast("int")))
    channel = F.when(F.col("extractor").startswith("docx"), "docx精准通道").otherwise("V2快速通道")
    source = F.concat(F.lit("来源: PDF第"), F.col("page").cast("string"), F.lit("页 | 提取方式: "), channel)
    rows = F.concat(F.array(F.array("title"), F.array(source), F.array().cast("array<string>"), blank), data, F.array(blank))
    return t.select("table_id", F.posexplode(rows).alias("row_no", "values"))


def write_versioned(df: DataFrame, path: str, version: int = 2) -> None:
    """Writes records with their cache version, one folder for each version."""
    df.withColumn("cache_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_version").parquet(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages as Parquet below ``pages`` and their numbers below ``summary``."""
    pages.write.mode("overwrite").parquet(f"{path}/pages")
    pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_pages"), F.count_if("is_table_page").alias("table_pages")).write.mode("overwrite").parquet(f"{path}/summary")


def write_csv(cells: DataFrame, path: str, columns: int) -> None:
    """Rows of all tables with the given number of columns."""
    wide = cells.groupBy("table_id", "row_idx").pivot("col_idx", list(range(columns))).agg(F.first("text"))
    wide.write.mode("overwrite").option("header", True).csv(path)


def failed_pages(tables: DataFrame) -> DataFrame:
    """Pages whose tables were not extracted."""
    return tables.where("parse_status <> 'success'").select("doc_id", "page", "parse_status").distinct()
