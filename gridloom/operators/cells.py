"""Cleaning and measuring ragged tables in long form: cells(table_id, row_idx, col_idx, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def table_window():
    return Window.partitionBy("table_id")


def row_window():
    return Window.partitionBy("table_id", "row_idx")


def column_window():
    return Window.partitionBy("table_id", "col_idx")


def clean(cells: DataFrame) -> DataFrame:
    return cells.withColumn("text", T.cleaned(F.col("text")))


def renumbered(cells: DataFrame, column: str) -> DataFrame:
    """Row or column numbers without gaps, from 0."""
    return cells.withColumn(column, (F.dense_rank().over(table_window().orderBy(column)) - 1).cast("int"))


def drop_empty_rows(cells: DataFrame) -> DataFrame:
    kept = cells.withColumn("full", F.max(~T.is_blank(F.col("text"))).over(row_window())).where("full").drop("full")
    return renumbered(kept, "row_idx")


def drop_empty_columns(cells: DataFrame) -> DataFrame:
    kept = cells.withColumn("full", F.max(~T.is_blank(F.col("text"))).over(column_window())).where("full").drop("full")
    return renumbered(kept, "col_idx")


def crop_columns(cells: DataFrame) -> DataFrame:
    """Cuts all rows of a table to the range of its columns that hold text."""
    held = F.when(~T.is_blank(F.col("text")), F.col("col_idx"))
    kept = cells.withColumns({"lo": F.min(held).over(table_window()), "hi": F.max(held).over(table_window())}).where("col_idx between lo and hi")
    return kept.withColumn("col_idx", F.col("col_idx") - F.col("lo")).drop("lo", "hi")


def drop_repeated_columns(cells: DataFrame) -> DataFrame:
    """Drops a column that equals the one before it on every row; a missing cell is blank."""
    columns = cells.groupBy("table_id", "col_idx").agg(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("row_idx", "text")))).alias("content"))
    same = F.col("content") == F.lag("content").over(table_window().orderBy("col_idx"))
    kept = columns.withColumn("same", F.coalesce(same, F.lit(False))).where("not same").select("table_id", "col_idx")
    return renumbered(cells.join(kept, ["table_id", "col_idx"], "left_semi"), "col_idx")


def blank_repeats(cells: DataFrame) -> DataFrame:
    """In columns after the first, later cells with a value that the column already has become empty."""
    seen = F.row_number().over(Window.partitionBy("table_id", "col_idx", T.lookup_key(F.col("text"))).orderBy("row_idx"))
    return cells.withColumn("text", F.when((F.col("col_idx") > 0) & (seen > 1), "").otherwise(F.col("text")))


def fill_down(cells: DataFrame) -> DataFrame:
    """Blank cells take the last text above them in their column."""
    above = F.last(F.when(~T.is_blank(F.col("text")), F.col("text")), ignorenulls=True).over(column_window().orderBy("row_idx"))
    return cells.withColumn("text", F.coalesce(above, F.lit("")))


def plain_numbers(cells: DataFrame) -> DataFrame:
    """Numeric cells lose their thousands commas, others are trimmed."""
    t = T.stripped(F.col("text"))
    return cells.withColumn("text", F.when(T.is_numeric_strict(F.col("text")), F.replace(t, F.lit(","), F.lit(""))).otherwise(t))


def filter_rows(cells: DataFrame, needle: str) -> DataFrame:
    """Rows with a cell that contains the text, in any case."""
    hit = F.max(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(needle.lower()))).over(row_window())
    return cells.withColumn("hit", hit).where("hit").drop("hit")


def column_values(cells: DataFrame) -> DataFrame:
    """Distinct values of each column that are not blank."""
    return cells.select("table_id", "col_idx", T.stripped(F.col("text")).alias("value")).where("value <> ''").distinct()


def column_profile(cells: DataFrame) -> DataFrame:
    """Per column: share of numbers among filled cells after the first row, and share of its most frequent value (blank included)."""
    t = T.stripped(F.col("text"))
    counted = cells.groupBy("table_id", "col_idx", t.alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when((F.col("row_idx") > 0) & (t != ""), 1).otherwise(0)).alias("filled"), F.sum(F.when((F.col("row_idx") > 0) & T.is_numeric(F.col("text")), 1).otherwise(0)).alias("numeric")
    )
    out = counted.groupBy("table_id", "col_idx").agg(F.sum("n").alias("n_rows"), F.max("n").alias("most"), F.sum("filled").alias("filled"), F.sum("numeric").alias("numeric"))
    return out.select("table_id", "col_idx", "n_rows", F.when(F.col("filled") > 0, F.col("numeric") / F.col("filled")).otherwise(0.0).alias("numeric_ratio"), (F.col("most") / F.col("n_rows")).alias("duplicate_ratio"))


def classify(cells: DataFrame, min_rows: int = 3, numeric: float = 0.7, relaxed: float = 0.3, repeated: float = 0.6) -> DataFrame:
    """Per table: n_cols, data_rows, is_real_table and confidence, by the first rule that holds."""
    profile = column_profile(cells)
    per = profile.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("n_cols"),
        F.max("n_rows").alias("n_rows"),
        F.max(F.when(F.col("n_rows") >= 3, F.col("duplicate_ratio"))).alias("dup"),
        F.max("numeric_ratio").alias("num"),
    )
    data_rows = F.when(F.col("n_rows") > 1, F.col("n_rows") - 1).otherwise(F.col("n_rows"))
    rules = [
        (F.col("n_cols") < 2, False, 0.95),
        (F.col("data_rows") < min_rows, False, 0.9),
        (F.coalesce(F.col("dup"), F.lit(0.0)) >= repeated, False, 0.85),
        (F.col("num") >= numeric, True, 0.9),
        ((F.col("num") >= relaxed) & (F.col("data_rows") >= 5), True, 0.9),
    ]
    real, sure = F.lit(False), F.lit(0.75)
    for condition, is_real, confidence in reversed(rules):
        real, sure = F.when(condition, is_real).otherwise(real), F.when(condition, confidence).otherwise(sure)
    return per.withColumn("data_rows", data_rows).select("table_id", "n_cols", "data_rows", real.alias("is_real_table"), sure.alias("confidence"))


def selection_stats(cells: DataFrame) -> DataFrame:
    """Sum, mean and number of the parsable cells of each column."""
    v = T.number_value(F.col("text"))
    return cells.groupBy("table_id", "col_idx").agg(F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 4).alias("mean"), F.count(v).alias("n"))


def rule_checks(cells: DataFrame) -> DataFrame:
    """Per table: empty rows, whether rows differ in width, a single row, no number, cells with outer blanks."""
    row = cells.groupBy("table_id", "row_idx").agg(F.max(~T.is_blank(F.col("text"))).alias("full"), F.count(F.lit(1)).alias("width"), F.max(T.is_numeric(F.col("text"))).alias("numeric"), F.count_if(F.coalesce(F.col("text"), F.lit("")) != T.stripped(F.col("text"))).alias("outer_blanks"))
    return row.groupBy("table_id").agg(
        F.count_if(~F.col("full")).alias("empty_rows"), (F.min("width") != F.max("width")).alias("ragged"), (F.count(F.lit(1)) == 1).alias("single_row"), (~F.max("numeric")).alias("no_numeric"), F.sum("outer_blanks").alias("outer_blanks")
    )


def apply_changes(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Cells with the new text of ``changes`` (table_id, row_idx, col_idx, new_text) where there is one."""
    return cells.join(changes, ["table_id", "row_idx", "col_idx"], "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positions at which two grids differ, with both texts."""
    at = ["table_id", "row_idx", "col_idx"]
    both = left.withColumnRenamed("text", "before").join(right.withColumnRenamed("text", "after"), at, "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def fingerprint(cells: DataFrame, most: int = 5) -> DataFrame:
    """The first filled cells of each table in reading order, and its number of rows."""
    filled = cells.where(~T.is_blank(F.col("text"))).withColumn("rank", F.row_number().over(table_window().orderBy("row_idx", "col_idx")))
    first = filled.where(F.col("rank") <= most).groupBy("table_id").agg(F.array_join(F.array_sort(F.collect_set(T.lookup_key(F.col("text")))), "|").alias("tokens"))
    return first.join(cells.groupBy("table_id").agg((F.max("row_idx") + 1).alias("n_rows")), "table_id")


def to_grid(cells: DataFrame) -> DataFrame:
    """One row per table with its rows as arrays of texts, in order."""
    rows = cells.groupBy("table_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "text"))).alias("r"))
    rows = rows.select("table_id", "row_idx", F.transform("r", lambda x: x["text"]).alias("texts"))
    grid = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "texts"))).alias("rows"))
    return grid.select("table_id", F.transform("rows", lambda x: x["texts"]).alias("data"))


def from_grid(grid: DataFrame) -> DataFrame:
    """The long form of (table_id, data array<array<string>>)."""
    rows = grid.select("table_id", F.posexplode("data").alias("row_idx", "r"))
    return rows.select("table_id", "row_idx", F.posexplode("r").alias("col_idx", "text"))


def merge_to_previous(tables: DataFrame, key: list[Column] | None = None) -> DataFrame:
    """Adds ``target``: the nearest earlier table of the document with the same status (table_id, doc_id, status)."""
    return tables.withColumn("target", F.lag("table_id").over(Window.partitionBy("doc_id", "status", *(key or [])).orderBy("table_id")))
