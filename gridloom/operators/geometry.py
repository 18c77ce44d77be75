"""Rows, columns and regions from positioned items: items(doc_id, page_number, item_id, text, x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = ["doc_id", "page_number"]


def islands(df: DataFrame, keys: list[str], order: Column | str, starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows; ``starts`` says whether a row begins one (null at the first row counts as yes)."""
    w = Window.partitionBy(*keys).orderBy(order)
    flagged = df.withColumn("_start", F.coalesce(starts, F.lit(True)).cast("int"))
    return flagged.withColumn(name, (F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_start")


def row_buckets(items: DataFrame, height: float = 5.0) -> DataFrame:
    """Adds row_idx: items whose rounded y0 bucket is at most one after the bucket before share a row."""
    b = items.withColumn("bucket", F.rint(F.col("y0") / height).cast("int"))
    w = Window.partitionBy(*PAGE).orderBy("bucket")
    each = b.select(*PAGE, "bucket").distinct()
    each = islands(each.withColumn("before", F.lag("bucket").over(w)), PAGE, "bucket", F.col("bucket") - F.col("before") > 1, "row_idx")
    return b.join(each.drop("before"), [*PAGE, "bucket"]).drop("bucket")


def cluster_1d(values: DataFrame, tolerance: float = 4.0, least: int = 3) -> DataFrame:
    """Chains of values (doc_id, page_number, v) with gaps of at most ``tolerance``; clusters of ``least`` or more, with size and mean."""
    w = Window.partitionBy(*PAGE).orderBy("v")
    chained = islands(values.withColumn("before", F.lag("v").over(w)), PAGE, "v", F.col("v") - F.col("before") > tolerance)
    return chained.groupBy(*PAGE, "island").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("center")).where(F.col("n") >= least)


def gap_columns(items: DataFrame) -> DataFrame:
    """Column boundaries of a page: midpoints of gaps over max(1.5 * median gap, 10) between distinct x edges."""
    edges = items.select(*PAGE, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    gaps = edges.withColumn("gap", F.lead("x").over(Window.partitionBy(*PAGE).orderBy("x")) - F.col("x")).where("gap is not null")
    limit = gaps.groupBy(*PAGE).agg(F.greatest(F.median("gap") * 1.5, F.lit(10.0)).alias("most"))
    return gaps.join(limit, PAGE).where("gap > most").select(*PAGE, F.round(F.col("x") + F.col("gap") / 2, 4).alias("boundary"))


def gap_boundaries(items: DataFrame) -> DataFrame:
    """``gap_columns`` with the outer boundaries, half-way to the page's least x0 and greatest x1; those two themselves without a wide gap."""
    inner = gap_columns(items)
    ends = items.groupBy(*PAGE).agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    found = ends.join(inner.groupBy(*PAGE).agg(F.min("boundary").alias("first"), F.max("boundary").alias("last")), PAGE, "left")
    left, right = (F.when(F.col("first").isNull(), F.col(end)).otherwise((F.col(end) + F.col(b)) / 2) for end, b in (("lo", "first"), ("hi", "last")))
    return inner.unionByName(found.select(*PAGE, F.explode(F.array(left, right)).alias("boundary")).withColumn("boundary", F.round("boundary", 4)))


def merge_ranges(numbers: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive whole numbers as first and last."""
    w = Window.partitionBy(*keys).orderBy(value)
    runs = numbers.select(*keys, value).distinct().withColumn("_run", F.col(value) - F.row_number().over(w))
    return runs.groupBy(*keys, "_run").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("_run")


def page_ranges(numbers: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs as one string, such as 1-5,10,15-20."""
    runs = merge_ranges(numbers, keys, value)
    part = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    listed = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", part.alias("part")))).alias("parts"))
    return listed.select(*keys, F.array_join(F.transform("parts", lambda p: p["part"]), ",").alias("pages"))


def page_groups(pages: DataFrame, largest: int = 5) -> DataFrame:
    """Runs of consecutive pages, cut into groups of at most ``largest``: doc_id, first, last."""
    w = Window.partitionBy("doc_id").orderBy("page_number")
    runs = pages.select(*PAGE).distinct().withColumn("_run", F.col("page_number") - F.row_number().over(w))
    place = F.floor((F.row_number().over(Window.partitionBy("doc_id", "_run").orderBy("page_number")) - 1) / largest)
    return runs.withColumn("_part", place).groupBy("doc_id", "_run", "_part").agg(F.min("page_number").alias("first"), F.max("page_number").alias("last")).drop("_run", "_part")


def density_rows(items: DataFrame, height: float, cells: int = 10, share: float = 0.8) -> DataFrame:
    """Bands of a page whose rows of a grid hold more items than share * max(mean, 3): first and last grid row, items."""
    row = F.least(F.greatest(F.floor((F.col("y0") + F.col("y1")) / 2 / height * cells), F.lit(0)), F.lit(cells - 1)).cast("int")
    counts = items.withColumn("grid_row", row).groupBy(*PAGE, "grid_row").agg(F.count(F.lit(1)).alias("n"))
    mean = F.sum("n").over(Window.partitionBy(*PAGE)) / cells
    dense = counts.withColumn("limit", share * F.greatest(mean, F.lit(3.0))).where("n > limit").drop("limit")
    run = F.col("grid_row") - F.row_number().over(Window.partitionBy(*PAGE).orderBy("grid_row"))
    return dense.withColumn("_run", run).groupBy(*PAGE, "_run").agg(F.min("grid_row").alias("first"), F.max("grid_row").alias("last"), F.sum("n").alias("n_items")).drop("_run")


def page_order(items: DataFrame) -> DataFrame:
    """Sequence number of items in reading order."""
    return items.withColumn("seq", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "item_id")))


def monotone_pages(tables: DataFrame, total: int) -> DataFrame:
    """Pages made non-decreasing by a running maximum, then clamped to 1 .. total."""
    running = F.max("page").over(Window.partitionBy("doc_id").orderBy("table_id").rowsBetween(Window.unboundedPreceding, 0))
    return tables.withColumn("page", F.least(F.greatest(running, F.lit(1)), F.lit(total)))


def interpolated_pages(tables: DataFrame) -> DataFrame:
    """Null pages between two known ones, linearly by position and rounded half to even; at the ends the nearest known page."""
    w = Window.partitionBy("doc_id").orderBy("table_id")
    t = tables.withColumn("pos", F.row_number().over(w))
    known = F.when(F.col("page").isNotNull(), F.struct("pos", "page"))
    t = t.withColumns({"a": F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    between = F.col("a.page") + (F.col("b.page") - F.col("a.page")) * (F.col("pos") - F.col("a.pos")) / F.greatest(F.col("b.pos") - F.col("a.pos"), F.lit(1))
    return t.withColumn("page", F.rint(F.coalesce(between, F.col("a.page").cast("double"), F.col("b.page").cast("double"))).cast("int")).drop("pos", "a", "b")


#: Factor, least, most and default of the row threshold; factor, least and default height of the font's.
GAP_FACTOR, GAP_LEAST, GAP_MOST, GAP_DEFAULT = 0.4, 2.0, 15.0, 5.0
FONT_FACTOR, FONT_LEAST, FONT_DEFAULT = 0.5, 4.0, 10.0


def row_threshold(items: DataFrame) -> DataFrame:
    """Per page: a share of the median gap between neighbouring y0, clamped; a default for fewer than 5 values or 3 usable gaps."""
    page = Window.partitionBy(*PAGE).orderBy("y0")
    ys = items.select(*PAGE, F.when(~T.is_blank(F.col("text")), F.col("y0")).alias("y0")).distinct()
    gap = F.col("y0") - F.lag("y0").over(page)
    gaps = ys.withColumn("gap", gap).withColumn("gap", F.when((F.col("gap") > 0.5) & (F.col("gap") < 50), F.col("gap")))
    per = gaps.groupBy(*PAGE).agg(F.count("y0").alias("n"), F.count("gap").alias("n_gaps"), F.median("gap").alias("middle"))
    clamped = F.greatest(F.lit(GAP_LEAST), F.least(F.lit(GAP_MOST), F.col("middle") * GAP_FACTOR))
    return per.select(*PAGE, F.when((F.col("n") >= 5) & (F.col("n_gaps") >= 3), clamped).otherwise(GAP_DEFAULT).alias("threshold"))


def font_threshold(items: DataFrame) -> DataFrame:
    """Per page: font size (median height of items that have one) and the row threshold that follows from it."""
    height = F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0"))
    per = items.groupBy(*PAGE).agg(F.coalesce(F.median(height), F.lit(FONT_DEFAULT)).alias("font_size"))
    return per.withColumn("threshold", F.greatest(F.col("font_size") * FONT_FACTOR, F.lit(FONT_LEAST)))


def column_spans(rows: DataFrame) -> DataFrame:
    """Per page and ordinal column: least x0 and greatest x1 over all rows (items with row_idx); coordinates of 0 or less don't count.

    Columns without a usable box are left out and the rest numbered from 0.
    """
    place = F.row_number().over(Window.partitionBy(*PAGE, "row_idx").orderBy("x0", "x1", "item_id"))
    usable = rows.withColumn("place", place).where("x0 > 0 and x1 > 0")
    spans = usable.groupBy(*PAGE, "place").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return spans.withColumn("col_idx", F.row_number().over(Window.partitionBy(*PAGE).orderBy("place")) - 1).drop("place")


def continuation_candidates(tables: DataFrame) -> DataFrame:
    """Adds ``continues``: the table before, if it is on the same or the preceding page and differs by at most two columns.

    Tables are (doc_id, table_id, page, n_cols); a table without columns is no candidate.
    """
    w = Window.partitionBy("doc_id").orderBy("table_id")
    before = {c: F.lag(c).over(w) for c in ("table_id", "page", "n_cols")}
    step = F.col("page") - before["page"]
    close = step.isin(0, 1) & (F.col("n_cols") > 0) & (before["n_cols"] > 0) & (F.abs(F.col("n_cols") - before["n_cols"]) <= 2)
    return tables.withColumn("continues", F.when(close, before["table_id"]))
