"""Repairs of columns and merged cells, rule checks and fixes, of cells(table_id, row_idx, col_idx, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import rows as R
from .cells import apply_changes, column_window, renumbered, row_window, table_window


def dense(cells: DataFrame) -> DataFrame:
    """All positions of a table's rows and columns; missing and null cells are empty."""
    shape = cells.groupBy("table_id").agg((F.max("col_idx") + 1).alias("width"))
    slots = cells.select("table_id", "row_idx").distinct().join(shape, "table_id").select("table_id", "row_idx", F.explode(F.sequence(F.lit(0), (F.col("width") - 1).cast("int"))).alias("col_idx"))
    return slots.join(cells, ["table_id", "row_idx", "col_idx"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def crop_edges(cells: DataFrame) -> DataFrame:
    """Cuts all rows to the range of columns that hold text; a table without any text stays as it is."""
    held = F.when(~T.is_blank(F.col("text")), F.col("col_idx"))
    spanned = cells.withColumns({"lo": F.min(held).over(table_window()), "hi": F.max(held).over(table_window())})
    kept = spanned.where("lo is null or col_idx between lo and hi")
    return kept.withColumn("col_idx", F.col("col_idx") - F.coalesce("lo", F.lit(0))).drop("lo", "hi")


def label_only(filled: Column) -> Column:
    """Over the cells of a row: only its first column holds text, and the table has more columns."""
    first = F.max(filled & (F.col("col_idx") == 0)).over(row_window())
    rest = F.max(filled & (F.col("col_idx") > 0)).over(row_window())
    return first & ~rest & (F.max("col_idx").over(table_window()) > 0)


def compact_columns(cells: DataFrame) -> DataFrame:
    """Drops columns that are blank on all rows but those with a label alone, and pads rows.

    Tables of such rows only, and tables without a column that would go, stay as they are.
    """
    whole = dense(cells).withColumn("filled", ~T.is_blank(F.col("text"))).withColumn("header", label_only(F.col("filled")))
    column = whole.groupBy("table_id", "col_idx").agg(F.max(F.col("filled") & ~F.col("header")).alias("keep"), F.max(~F.col("header")).alias("some"))
    w = table_window()
    column = column.withColumns({"kept": F.count_if("keep").over(w), "all": F.count(F.lit(1)).over(w)}).withColumn("acts", F.col("some") & (F.col("kept") > 0) & (F.col("kept") < F.col("all")))
    acting = column.where("acts")
    changed = whole.join(acting.where("keep").select("table_id", "col_idx"), ["table_id", "col_idx"], "left_semi").select("table_id", "row_idx", "col_idx", "text")
    stay = cells.join(acting.select("table_id").distinct(), "table_id", "left_anti").select("table_id", "row_idx", "col_idx", "text")
    return stay.unionByName(renumbered(changed, "col_idx"))


def drop_phantom_columns(cells: DataFrame) -> DataFrame:
    """Of columns with the same first three cells, those filled below a quarter as densely as the densest go.

    Groups whose densest column is below 10 %, and evenly dense ones (deviation
    under 5 %, densest over 50 %), stay whole, as do tables of fewer than three rows.
    """
    whole = dense(cells)
    n = F.max("row_idx").over(table_window()) + 1
    whole = whole.withColumns({"n": n, "filled": ~T.is_blank(F.col("text"))}).withColumn("start", F.least(F.lit(3), F.col("n") - 1))
    head = [F.max(F.when(F.col("row_idx") == k, T.stripped(F.col("text")))) for k in range(3)]
    column = whole.groupBy("table_id", "col_idx").agg(F.max("n").alias("n"), F.array(*head).alias("head"), (F.count_if(F.col("filled") & (F.col("row_idx") >= F.col("start"))) / (F.max("n") - F.max("start"))).alias("density"))
    group = Window.partitionBy("table_id", "head")
    column = column.withColumns({"size": F.count(F.lit(1)).over(group), "most": F.max("density").over(group), "sd": F.stddev_pop("density").over(group)})
    even = (F.col("sd") < 0.05) & (F.col("most") > 0.5)
    phantom = (F.col("n") >= 3) & F.exists("head", lambda t: t != "") & (F.col("size") > 1) & (F.col("most") >= 0.1) & ~even & (F.col("density") < F.col("most") * 0.25)
    gone = column.where(F.coalesce(phantom, F.lit(False)))
    changed = whole.join(gone.select("table_id").distinct(), "table_id", "left_semi").join(gone.select("table_id", "col_idx"), ["table_id", "col_idx"], "left_anti").select("table_id", "row_idx", "col_idx", "text")
    stay = cells.join(gone.select("table_id").distinct(), "table_id", "left_anti").select("table_id", "row_idx", "col_idx", "text")
    return stay.unionByName(renumbered(changed, "col_idx"))


def drop_sparse_columns(cells: DataFrame, fill: float = 0.15, few: int = 2) -> DataFrame:
    """Drops columns with a small share of filled cells and adds their texts to the kept column on their left.

    Rows with a label alone and the first three rows don't count.  A column needs
    ``fill`` of the others filled, half of them where only ``few`` or fewer are.
    The first column of a row that would lose all its text is kept.
    """
    rows = cells.groupBy("table_id", "row_idx").agg(F.collect_list(marked(F.col("col_idx"), F.col("text"))).alias("cells"))
    return drop_sparse_columns_of_rows(rows, fill, few)


def marked(col_idx: Column, text: Column) -> Column:
    """A cell with whether ``stripped`` leaves any of its text; cells before the first column don't count."""
    return F.struct(col_idx.alias("col_idx"), text.alias("text"), ((col_idx >= 0) & F.rlike(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S"))).alias("filled"))


def drop_sparse_columns_of_rows(rows: DataFrame, fill: float = 0.15, few: int = 2) -> DataFrame:
    """``drop_sparse_columns`` of rows(table_id, row_idx, cells), cells an array of ``marked``, one a position; returns cells.

    Rows dealt by table_id are dealt once, and read twice from there: for the columns'
    counts, and for the result.  What passes between rows is as small as a table is wide.
    """
    w, width, late = table_window(), F.col("width"), F.col("row_idx") >= 3
    # a join puts this filter on one side; on both, they read the same exchange
    apart, rows = rows.where("table_id is null"), rows.where("table_id is not null")
    label = F.exists("cells", lambda x: x["filled"] & (x["col_idx"] == 0)) & ~F.exists("cells", lambda x: x["filled"] & (x["col_idx"] > 0))
    rows = rows.select("table_id", "row_idx", "cells", label.alias("label"), (F.array_max(F.col("cells")["col_idx"]) + 1).alias("own"))
    counts = F.max("own").over(w).alias("width"), F.count(F.lit(1)).over(w).alias("n"), F.count_if(late).over(w).alias("n_late"), F.count_if(late & ~F.col("label")).over(w).alias("n_full")
    rows = rows.select("table_id", "row_idx", "cells", "label", *counts)
    n_data = F.when(width > 1, F.col("n_full")).otherwise(F.col("n_late"))
    rows = rows.select("table_id", "row_idx", "cells", "width", n_data.alias("n_data"), (late & ~(F.col("label") & (width > 1))).alias("data"), ((F.col("n") >= 2) & (n_data > 0)).alias("able"))

    each = rows.where("data").select("table_id", "n_data", F.explode("cells").alias("cell")).where("cell.filled")
    column = each.groupBy("table_id", F.col("cell.col_idx").alias("col_idx")).agg(F.count(F.lit(1)).alias("held"), F.max("n_data").alias("n_data"))
    column = column.where(F.col("held") / F.col("n_data") >= F.when(F.col("held") <= few, 0.5).otherwise(fill))
    solid = column.groupBy("table_id").agg(F.collect_list("col_idx").alias("solid"))

    rows = rows.join(solid, "table_id", "left").withColumn("solid", F.coalesce("solid", F.array().cast("array<int>")))
    safe = F.exists("cells", lambda x: x["filled"] & F.array_contains(F.col("solid"), x["col_idx"]))
    first = F.array_min(F.transform(F.filter("cells", lambda x: x["filled"]), lambda x: x["col_idx"]))
    rows = rows.select("table_id", "row_idx", "cells", "width", "solid", "able", F.when(F.col("data") & F.col("able") & ~safe, first).alias("saved"))
    rows = rows.select("table_id", "row_idx", "cells", "width", "able", F.concat("solid", F.collect_set("saved").over(w)).alias("stay"))
    kept = F.when(F.col("able") & (width > 0), F.filter(F.sequence(F.lit(0), width - 1), lambda c: F.array_contains(F.col("stay"), c)))
    rows = rows.select("table_id", "row_idx", "cells", "width", kept.alias("kept"))
    acts = (F.size("kept") > 0) & (F.size("kept") < width)

    def merged(c: Column, i: Column) -> Column:
        after = F.coalesce(F.get("kept", i + 1), width)
        own = F.coalesce(F.array_max(F.transform(F.filter("cells", lambda x: x["col_idx"] == c), lambda x: F.coalesce(x["text"], F.lit("")))), F.lit(""))
        more = (after > c + 1) & F.exists("cells", lambda x: x["filled"] & (x["col_idx"] > c) & (x["col_idx"] < after))
        parts = F.array_sort(F.transform(F.filter("cells", lambda x: x["filled"] & (x["col_idx"] >= c) & (x["col_idx"] < after)), lambda x: F.struct(x["col_idx"].alias("col_idx"), T.stripped(x["text"]).alias("s"))))
        return F.struct(i.alias("col_idx"), F.when(more, F.array_join(F.transform(parts, lambda x: x["s"]), " ")).otherwise(own).alias("text"))

    out = F.when(acts, F.transform("kept", merged)).otherwise(F.transform("cells", lambda x: F.struct(x["col_idx"].alias("col_idx"), x["text"].alias("text"))))
    done = rows.select("table_id", "row_idx", F.explode_outer(out).alias("cell")).select("table_id", "row_idx", "cell.*")
    return done.unionByName(apart.select("table_id", "row_idx", F.explode("cells").alias("cell")).select("table_id", "row_idx", "cell.col_idx", "cell.text"))


def _parts(text: Column) -> Column:
    """The numbers of a cell that holds two or more, set apart by white space, and nothing else; null for other cells."""
    parts = F.filter(F.split(T.stripped(text), r"(?U)\s+"), lambda p: p != "")
    return F.when(F.contains(T.stripped(text), F.lit(" ")) & (F.size(parts) >= 2) & F.forall(parts, T.is_single_number), parts)


def split_merged_numbers(cells: DataFrame) -> DataFrame:
    """Cells of several numbers become a cell for each; blank cells to their left are used up first, then the row grows.

    Tables with such a cell are padded to their greatest width; ``unresolved``
    marks tables with a split row more than two cells longer than the most filled
    cells of a row without such a cell.  Tables of one row stay as they are.
    """
    two = F.count("row_idx").over(table_window()) > F.count("row_idx").over(Window.partitionBy("table_id", "row_idx"))
    each = cells.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({"parts": F.when(two, _parts(F.col("text"))), "filled": ~T.is_blank(F.col("text"))})
    right = Window.partitionBy("table_id", "row_idx").orderBy("col_idx").rowsBetween(1, Window.unboundedFollowing)
    next_ = F.first(F.when(F.col("filled"), F.struct("col_idx", F.coalesce(F.size("parts"), F.lit(0)).alias("n"))), True).over(right)
    each = each.withColumn("next", next_)
    used = ~F.col("filled") & (F.coalesce("next.n", F.lit(0)) >= 2) & (F.col("next.col_idx") - F.col("col_idx") <= F.col("next.n") - 1)
    each = each.where(~F.coalesce(used, F.lit(False)))
    out = each.withColumn("splits", F.max(F.col("parts").isNotNull()).over(table_window())).select("table_id", "row_idx", "splits", F.col("col_idx").alias("was"), F.col("parts").isNotNull().alias("made"), F.posexplode(F.coalesce("parts", F.array("text"))).alias("k", "text"))
    place = (F.row_number().over(Window.partitionBy("table_id", "row_idx").orderBy("was", "k")) - 1).cast("int")
    out = out.withColumn("col_idx", F.when(F.col("splits"), place).otherwise(F.col("was")))
    width = out.where("splits").groupBy("table_id").agg(F.max("col_idx").alias("last"))
    changed = out.where("splits")
    slots = changed.select("table_id", "row_idx").distinct().join(width, "table_id").select("table_id", "row_idx", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("col_idx"))
    padded = slots.join(changed.select("table_id", "row_idx", "col_idx", "text"), ["table_id", "row_idx", "col_idx"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    return out.where("not splits").select("table_id", "row_idx", "col_idx", "text").unionByName(padded)


def unresolved_splits(cells: DataFrame) -> DataFrame:
    """Tables (table_id) in which a split row is more than two cells longer than the most filled cells of other rows."""
    each = cells.withColumns({"parts": _parts(F.coalesce("text", F.lit(""))), "filled": ~T.is_blank(F.col("text"))})
    row = each.groupBy("table_id", "row_idx").agg(F.max(F.col("parts").isNotNull()).alias("merged"), F.count_if("filled").alias("filled"))
    base = row.groupBy("table_id").agg(F.coalesce(F.max(F.when(~F.col("merged"), F.col("filled"))), F.lit(0)).alias("base"))
    grown = split_merged_numbers(cells).join(row.where("merged").select("table_id", "row_idx"), ["table_id", "row_idx"], "left_semi")
    longest = grown.where(F.col("text") != "").groupBy("table_id").agg((F.max("col_idx") + 1).alias("width"))
    return longest.join(base, "table_id").where("base > 0 and width > base + 2").select("table_id")


def checks(cells: DataFrame) -> DataFrame:
    """Per table the findings of the ten rules: row and column lists as text, the others as flags."""
    t = F.coalesce("text", F.lit(""))
    each = cells.withColumns({"t": t, "number": T.is_numeric_strict(F.col("text")), "filled": ~T.is_blank(F.col("text")), "width": F.count(F.lit(1)).over(row_window()), "n": F.max("row_idx").over(table_window()) + 1})
    row = each.groupBy("table_id", "row_idx").agg(F.first("n").alias("n"), F.first("width").alias("width"), F.max("filled").alias("filled"), F.count_if("number").alias("numbers"), F.count_if(F.col("filled") & ~F.col("number")).alias("words"), F.max(F.col("t").startswith(" ")).alias("leading"), F.max(F.col("t").endswith(" ")).alias("trailing"))
    row = row.withColumn("most", F.max("width").over(table_window()))
    listed = lambda test, column: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col(column)))), ",")
    head, body = F.col("row_idx") < F.least(F.lit(3), F.col("n")), F.col("row_idx").between(3, 7)
    share = lambda where: F.sum(F.when(where, F.col("numbers"))) / F.sum(F.when(where, F.col("width")))
    per = row.groupBy("table_id").agg(
        listed(~F.col("filled"), "row_idx").alias("empty_rows"), listed(F.col("width") != F.col("most"), "row_idx").alias("inconsistent_cols"), (F.count(F.lit(1)) == 1).alias("single_row"), (F.sum("numbers") == 0).alias("no_numeric"),
        F.max("leading").alias("leading_whitespace"), F.max("trailing").alias("trailing_whitespace"), F.coalesce((F.max("n") >= 3) & (share(body) > 0.3) & (share(head) < 0.3), F.lit(False)).alias("split_header"),
        F.max(F.when(F.col("row_idx") == 0, F.col("words") == 0)).alias("orphan_numeric_row"),
    )
    comma = F.contains("t", F.lit(","))
    column = each.groupBy("table_id", "col_idx").agg((F.max(F.col("number") & comma) & F.max(F.col("number") & ~comma)).alias("mixed"), (~F.max(F.col("filled") & (F.col("row_idx") < 2))).alias("headless"))
    of_columns = column.groupBy("table_id").agg(F.max("mixed").alias("irregular_number"), listed(F.col("headless"), "col_idx").alias("null_header_col"))
    return per.join(of_columns, "table_id")


#: What is repaired by rule, and what is no fault by itself.
FIXABLE = ["empty_rows", "leading_whitespace", "trailing_whitespace", "irregular_number"]
HARMLESS = ["empty_table", "no_numeric", "single_row"]


def issues(found: DataFrame) -> DataFrame:
    """(table_id, issues): the names of the rules of ``checks`` that found something."""
    names = [c for c in found.columns if c != "table_id"]
    hit = [F.when((F.col(c) != "") if dict(found.dtypes)[c] == "string" else F.col(c), F.lit(c)) for c in names]
    return found.select("table_id", F.array_compact(F.array(*hit)).alias("issues"))


def fix_status(found: DataFrame) -> DataFrame:
    """Per table: has_issues, applied rules in order, status (clean, auto_fixed, needs_review) and confidence after the rule repairs."""
    i = F.col("issues")
    trim = F.arrays_overlap(i, F.array(F.lit("leading_whitespace"), F.lit("trailing_whitespace")))
    applied = F.array_compact(F.array(F.when(F.array_contains(i, "empty_rows"), "remove_empty_rows"), F.when(trim, "trim_whitespace"), F.when(F.array_contains(i, "irregular_number"), "normalize_numbers")))
    rest = F.size(F.array_except(i, F.array(*map(F.lit, [*FIXABLE, "empty_table"])))) > 0
    status = F.when(rest, "needs_review").when(F.size("applied") > 0, "auto_fixed").otherwise("clean")
    out = issues(found).withColumn("applied", applied)
    return out.select("table_id", (F.size(F.array_except(i, F.array(*map(F.lit, HARMLESS)))) > 0).alias("has_issues"), F.array_join("applied", ",").alias("applied"), status.alias("status"), F.when(rest, "medium").otherwise("high").alias("confidence"))


def fixed(cells: DataFrame) -> DataFrame:
    """Cells after the rule repairs: blank rows gone, then all cells trimmed where one has outer blanks, then commas out of numbers where a column mixes formats."""
    status = issues(checks(cells)).select("table_id", "issues")
    has = lambda *names: F.arrays_overlap("issues", F.array(*map(F.lit, names)))
    out = cells.join(status, "table_id").withColumn("filled", F.max(~T.is_blank(F.col("text"))).over(row_window())).where(F.col("filled") | ~has("empty_rows"))
    text = F.when(has("leading_whitespace", "trailing_whitespace"), T.stripped(F.col("text"))).otherwise(F.col("text"))
    out = out.withColumn("text", text).withColumn("text", F.when(has("irregular_number") & T.is_numeric_strict(F.col("text")), F.replace(F.col("text"), F.lit(","), F.lit(""))).otherwise(F.col("text")))
    return renumbered(out.select("table_id", "row_idx", "col_idx", "text"), "row_idx")


def fingerprint(cells: DataFrame, numbers: int = 15, words: int = 5, rows: int = 5) -> DataFrame:
    """Per table: tokens (first numbers and first other texts of two or more characters in the first rows, lower case) and widths of those rows."""
    top = cells.where(F.col("row_idx") < rows).withColumn("s", T.stripped(F.col("text")))
    number = T.without(F.replace(F.col("s"), F.lit("("), F.lit("-")), ",%)").rlike(T.NUMBER)
    held = top.where(F.length("s") >= 2).withColumn("number", number)
    held = held.withColumn("place", F.row_number().over(Window.partitionBy("table_id", "number").orderBy("row_idx", "col_idx")))
    tokens = held.where(F.col("place") <= F.when(F.col("number"), numbers).otherwise(words)).groupBy("table_id").agg(F.array_sort(F.collect_set(F.lower("s"))).alias("tokens"))
    widths = top.groupBy("table_id", "row_idx").agg(F.count(F.lit(1)).alias("w")).groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "w"))), lambda x: x["w"]).alias("widths"))
    return widths.join(tokens, "table_id")


def data_fingerprint(cells: DataFrame, most: int = 25) -> DataFrame:
    """Per table: up to ``most`` different texts of its data, numbers of three characters first, then other texts of five, in lower case.

    The first two rows of tables of more than three don't count.
    """
    n = F.max("row_idx").over(table_window()) + 1
    each = cells.withColumn("n", n).where((F.col("n") <= 3) | (F.col("row_idx") >= 2)).withColumn("s", T.stripped(F.col("text"))).where(F.length("s") >= 3)
    each = each.withColumn("word", ~T.without(F.replace(F.col("s"), F.lit("("), F.lit("-")), ",%‰)").rlike(T.NUMBER)).where(~F.col("word") | (F.length("s") >= 5))
    first = each.groupBy("table_id", F.lower("s").alias("t")).agg(F.min(F.struct("word", "row_idx", "col_idx")).alias("at"))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("table_id").orderBy("at"))).where(F.col("place") <= most)
    return first.groupBy("table_id").agg(F.array_sort(F.collect_list("t")).alias("tokens"))


def header_text(cells: DataFrame) -> DataFrame:
    """Per table: the texts of its first row, or first two of more than three, a line for each row."""
    n = F.max("row_idx").over(table_window()) + 1
    top = cells.withColumn("n", n).where(F.col("row_idx") < F.when(F.col("n") > 3, 2).otherwise(1))
    lines = R.of_cells(top).select("table_id", "row_idx", F.array_join(R.filled(F.col("texts")), " ").alias("line")).where("line <> ''")
    return lines.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]), "\n").alias("header"))


def overlay(cells: DataFrame, patch: DataFrame) -> DataFrame:
    """Cells with the texts of ``patch`` (table_id, row_idx, col_idx, text) put over them where both have a position."""
    return apply_changes(cells, patch.withColumnRenamed("text", "new_text"))


def rectangle(cells: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """The cells of a range of rows and columns, both ends included, numbered from 0."""
    cut = cells.where(F.col("row_idx").between(top, bottom) & F.col("col_idx").between(left, right))
    return cut.withColumns({"row_idx": F.col("row_idx") - top, "col_idx": F.col("col_idx") - left})


def cleared(cells: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """Cells with a range emptied."""
    inside = F.col("row_idx").between(top, bottom) & F.col("col_idx").between(left, right)
    return cells.withColumn("text", F.when(inside, "").otherwise(F.col("text")))


def copy_down(cells: DataFrame, row: int, column: int, last: int) -> DataFrame:
    """The text of one cell in all cells below it in its column, up to row ``last``."""
    source = F.max(F.when((F.col("row_idx") == row) & (F.col("col_idx") == column), F.col("text"))).over(column_window())
    return cells.withColumn("text", F.when((F.col("col_idx") == column) & F.col("row_idx").between(row + 1, last) & source.isNotNull(), source).otherwise(F.col("text")))


def delete_columns(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Without the columns (table_id, col_idx) of ``columns``; those behind move up."""
    return renumbered(cells.join(columns.select("table_id", "col_idx").distinct(), ["table_id", "col_idx"], "left_anti"), "col_idx")


def rows_with_values(cells: DataFrame, column: int, allowed: list[str]) -> DataFrame:
    """Rows whose text in a column is one of ``allowed``; an empty list filters nothing."""
    if not allowed:
        return cells
    hit = F.max((F.col("col_idx") == column) & T.stripped(F.col("text")).isin(allowed)).over(row_window())
    return cells.withColumn("hit", hit).where("hit").drop("hit")


def merge_split_headers(cells: DataFrame, most: float = 0.6) -> DataFrame:
    """Joins header cells that stand in two rows over a column of numbers; blank rows go and rows are padded.

    Of the first two pairs of neighbouring rows only the first with such a column
    is joined.  Both texts have no digit, at most 8 characters each and 15
    together.  A lower text of a sub-header stays: a short one in a row with two or
    more short texts without a digit, above which at most one text, or always the
    same, stands.  Tables of fewer than three rows are only padded.
    """
    whole = dense(cells).withColumn("s", T.stripped(F.col("text"))).withColumn("n", F.max("row_idx").over(table_window()) + 1)
    body = F.col("row_idx") >= F.least(F.lit(2), F.greatest(F.lit(1), F.floor(F.col("n") / 2)))
    held = body & (F.col("s") != "")
    numeric = whole.groupBy("table_id", "col_idx").agg((F.count_if(held & T.is_typed_number(F.col("s"))) > F.count_if(held) * most).alias("numeric"))
    plain = ~F.col("s").rlike("[0-9]")
    lower = whole.where("row_idx in (1, 2) and n >= 3").select("table_id", F.col("row_idx").alias("low"), "col_idx", F.col("s").alias("b"), plain.alias("b_plain"))
    upper = whole.where("row_idx in (0, 1) and n >= 3").select("table_id", (F.col("row_idx") + 1).alias("low"), "col_idx", F.col("s").alias("a"), plain.alias("a_plain"))
    both = lower.join(upper, ["table_id", "low", "col_idx"]).join(numeric, ["table_id", "col_idx"])
    short = (F.col("b") != "") & (F.length("b") <= 5) & F.col("b_plain")
    pair = Window.partitionBy("table_id", "low")
    parent = F.when(short & (F.col("a") != ""), F.col("a"))
    both = both.withColumns({"shorts": F.count_if(short).over(pair), "parents": F.count(parent).over(pair), "one": F.min(parent).over(pair) == F.max(parent).over(pair)})
    child = (F.length("b") <= 5) & (F.col("shorts") >= 2) & ((F.col("parents") <= 1) | F.col("one"))
    joins = (F.col("a") != "") & (F.col("b") != "") & ~child & (F.length("a") <= 8) & (F.length("b") <= 8) & (F.length("a") + F.length("b") <= 15) & F.col("numeric") & F.col("a_plain") & F.col("b_plain")
    merged = both.where(joins).withColumn("first", F.min("low").over(Window.partitionBy("table_id"))).where("low = first")
    patch = merged.select("table_id", "col_idx", F.explode(F.array(F.struct((F.col("low") - 1).alias("row_idx"), F.concat("a", "b").alias("text")), F.struct(F.col("low").alias("row_idx"), F.lit("").alias("text")))).alias("p"))
    out = overlay(whole.select("table_id", "row_idx", "col_idx", "text"), patch.select("table_id", "p.row_idx", "col_idx", "p.text"))
    full = out.withColumn("full", F.max(~T.is_blank(F.col("text"))).over(row_window())).where("full").drop("full")
    return renumbered(full, "row_idx")
