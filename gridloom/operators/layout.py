"""Rows, columns, drawings and regions of a page.

Items are (doc_id, page_number, item_id, text, x0, y0, x1, y1), drawings
(doc_id, page_number, drawing_id, x0, y0, x1, y1), regions (doc_id, page_number,
region_idx, r_x0, r_y0, r_x1, r_y1).  Everything is per page, and what has to
look at a page as a sequence folds over its sorted array.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .geometry import PAGE, cluster_1d, islands

# Least width (share of the page) and height of a table's region; context above it; margins; words that make a page financial.
MIN_WIDTH, MIN_HEIGHT, CONTEXT, MARGIN = 0.3, 20.0, 100.0, 10.0
FINANCIAL_WORDS = ["万元", "元", "百万", "十亿", "%", "比率", "资产", "负债", "收入", "利润", "现金", "股东", "资本", "充足率", "率", "额", "数"]


def page(order: str | None = None) -> Window:
    w = Window.partitionBy(*PAGE)
    return w.orderBy(order) if order else w


def is_financial(text: Column, longer_than: int = -1) -> Column:
    """Whether a page's text has a word of finance and more than so many characters."""
    return T.has_word(F.coalesce(text, F.lit("")), FINANCIAL_WORDS) & (F.length(F.coalesce(text, F.lit(""))) > longer_than)


def usable(items: DataFrame) -> DataFrame:
    """Items with text and a height, and their middle ``y_mid``."""
    return items.where(~T.is_blank(F.col("text")) & (F.col("y1") > F.col("y0"))).withColumn("y_mid", (F.col("y0") + F.col("y1")) / 2)


def _row_numbers(items: DataFrame, thresholds: DataFrame, key: str, follow: bool) -> DataFrame:
    """Adds row_idx: items in the order of ``key`` begin a row when they are further than the page's threshold from the row's place.

    The place is the row's first item, or with ``follow`` the mean of the place
    so far and each item that joins.  Items at one height are in one row, so a
    page is folded over its different heights; an item without one is a row of
    its own, after the others.
    """
    unplaced = F.col(key).isNull() | F.isnan(key)
    keyed = items.withColumns({"_y": F.when(~unplaced, F.col(key)), "_own": F.when(unplaced, F.col("item_id"))})
    heights = keyed.groupBy(*PAGE, "_y", "_own").agg(F.count(F.lit(1)).alias("n"))
    sequence = F.array_sort(F.collect_list(F.struct(F.col("_y").isNull().alias("last"), "_y", "_own", "n")))
    pages = heights.groupBy(*PAGE).agg(sequence.alias("seq")).join(thresholds.select(*PAGE, "threshold"), PAGE)
    numbered = pages.select(*PAGE, "seq", _folded(follow)(F.transform("seq", lambda x: x["_y"]), F.transform("seq", lambda x: x["n"]), F.col("threshold").cast("double")).alias("rows"))
    each = numbered.select(*PAGE, F.explode(F.arrays_zip("seq", "rows")).alias("z")).select(*(F.col(c).alias(f"_{c}") for c in PAGE), F.col("z.seq._y").alias("_at"), F.col("z.seq._own").alias("_one"), F.col("z.rows").alias("row_idx"))
    same = (F.col("_own").eqNullSafe(F.col("_one"))) & F.col("_y").eqNullSafe(F.col("_at"))
    for c in PAGE:
        same &= F.col(c) == F.col(f"_{c}")
    return keyed.join(each, same).drop(*(f"_{c}" for c in PAGE), "_at", "_one", "_y", "_own")


def _folded(follow: bool):
    """The rows of a page's heights in ascending order, each with the number of its items and nulls last."""

    @F.pandas_udf("array<int>")
    def folded(heights: pd.Series, counts: pd.Series, thresholds: pd.Series) -> pd.Series:
        out = []
        for ys, ns, threshold in zip(heights, counts, thresholds, strict=True):
            at, row, rows = math.nan, -1, []
            for y, n in zip(np.asarray(ys, float).tolist(), ns.tolist(), strict=True):
                if not abs(y - at) <= threshold:
                    at, row, n = y, row + 1, n - 1
                while follow and n and (middle := (at + y) / 2) != at:  # each item halves the way, until rounding ends it
                    at, n = middle, n - 1
                rows.append(row)
            out.append(rows)
        return pd.Series(out, dtype=object)

    return folded


def word_rows(items: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows of words by y0; the place of a row follows its words."""
    return _row_numbers(items, thresholds, "y0", True)


def leader_rows(items: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows of usable items by their middle; the place of a row is its first item."""
    return _row_numbers(usable(items), thresholds, "y_mid", False)


def row_boundaries(items: DataFrame, least: float = 5.0) -> DataFrame:
    """Middles of the gaps of more than ``least`` between different y0 of a page; the one y0 of a page that has no other."""
    ys = items.select(*PAGE, "y0").distinct().withColumns({"gap": F.lead("y0").over(page("y0")) - F.col("y0"), "n": F.count(F.lit(1)).over(page())})
    return ys.where(F.col("gap") > least).select(*PAGE, (F.col("y0") + F.col("gap") / 2).alias("boundary")).unionByName(ys.where("n = 1").select(*PAGE, F.col("y0").alias("boundary")))


def spacing_boundaries(items: DataFrame, width: float, bucket: float = 20.0) -> DataFrame:
    """Column boundaries from empty buckets of x edges; thirds of the page where fewer than three are found."""
    edges = items.select(*PAGE, F.explode(F.array("x0", "x1")).alias("x")).select(*PAGE, F.floor(F.col("x") / bucket).alias("b")).distinct()
    gaps = edges.withColumn("next", F.lead("b").over(page("b"))).where("next is not null")  # there is nothing between neighbouring buckets
    inner = gaps.select(*PAGE, ((F.col("b") * bucket + bucket / 2 + F.col("next") * bucket) / 2).alias("boundary"))
    per = edges.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"))
    found = per.join(inner.groupBy(*PAGE).agg(F.collect_list("boundary").alias("inner")), PAGE, "left")
    both = F.concat(F.coalesce("inner", F.array().cast("array<double>")), F.array(F.lit(0.0), F.lit(width)))
    thirds = F.array(F.lit(0.0), F.lit(width * 0.3), F.lit(width * 0.6), F.lit(width))
    chosen = F.when(F.col("n") < 2, F.array(F.lit(0.0), F.lit(width))).when(F.size(both) < 3, thirds).otherwise(both)
    return found.select(*PAGE, F.explode(F.array_distinct(chosen)).alias("boundary"))


# -- drawings


def classified(drawings: DataFrame) -> DataFrame:
    """Adds ``kind`` (line where one side is below 0.3 of the other, else rect) and ``direction`` (h, v or null where neither side is over five times the other)."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kind = F.when((w < h * 0.3) | (h < w * 0.3), "line").otherwise("rect")
    return drawings.withColumns({"kind": kind, "direction": F.when(w > h * 5, "h").when(h > w * 5, "v")})


def drawn_regions(drawings: DataFrame, width: float) -> DataFrame:
    """Boxes of tables: large rectangles, and the box of two or more long lines in both directions where it meets no rectangle."""
    d = classified(drawings).withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})
    wide, high = F.col("w") > width * MIN_WIDTH, F.col("h") > MIN_HEIGHT
    boxes = d.where((F.col("kind") == "rect") & wide & high).select(*PAGE, "x0", "y0", "x1", "y1")
    across, along = (F.col("kind") == "line") & (F.col("direction") == "h") & wide, (F.col("kind") == "line") & (F.col("direction") == "v") & high
    ruled = d.groupBy(*PAGE).agg(F.count_if(across).alias("nh"), F.count_if(along).alias("nv"), F.min(F.when(along, F.col("x0"))).alias("x0"), F.min(F.when(across, F.col("y0"))).alias("y0"), F.max(F.when(along, F.col("x1"))).alias("x1"), F.max(F.when(across, F.col("y1"))).alias("y1"))
    ruled = ruled.where((F.col("nh") >= 2) & (F.col("nv") >= 2) & (F.col("x1") - F.col("x0") > width * MIN_WIDTH) & (F.col("y1") - F.col("y0") > MIN_HEIGHT)).drop("nh", "nv")
    other = boxes.select(*PAGE, *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    apart = (F.col("x1") <= F.col("bx0")) | (F.col("x0") >= F.col("bx1")) | (F.col("y1") <= F.col("by0")) | (F.col("y0") >= F.col("by1"))
    free = ruled.join(ruled.join(other, PAGE).where(~apart).select(*PAGE).distinct(), PAGE, "left_anti")
    return boxes.unionByName(free)


def line_bands(drawings: DataFrame, width: float) -> DataFrame:
    """Row bands between the different heights of long horizontal lines, on pages with two or more."""
    lines = classified(drawings).where((F.col("kind") == "line") & (F.col("direction") == "h") & (F.col("x1") - F.col("x0") > width * MIN_WIDTH))
    ys = lines.select(*PAGE, F.col("y0").alias("top")).distinct()
    return ys.withColumn("bottom", F.lead("top").over(page("top"))).where("bottom is not null")


def text_bands(items: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Row bands of pages without lines: the extents of the rows of words."""
    return word_rows(items, thresholds).groupBy(*PAGE, "row_idx").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"))


def column_lines(items: DataFrame, drawings: DataFrame, width: float, tolerance: float = 4.0, factor: float = 0.3, least: float = 10.0) -> DataFrame:
    """Column boundaries of each page with items: three vertical lines or more, two of them inside; else three aligned edges or more; else wide gaps, with the page's edges."""
    pages = items.select(*PAGE).distinct()
    v = classified(drawings).where((F.col("kind") == "line") & (F.col("direction") == "v")).select(*PAGE, F.col("x0").alias("x")).distinct()
    drawn = v.groupBy(*PAGE).agg(F.array_sort(F.collect_list("x")).alias("drawn"), F.count_if((F.col("x") > width * 0.05) & (F.col("x") < width * 0.95)).alias("inner"))
    real = items.where(~T.is_blank(F.col("text")))
    aligned = [cluster_1d(real.select(*PAGE, F.col(c).alias("v")), tolerance).select(*PAGE, "center") for c in ("x0", "x1")]
    aligned = aligned[0].unionByName(aligned[1]).groupBy(*PAGE).agg(F.array_sort(F.collect_set("center")).alias("aligned"))
    xs = real.select(*PAGE, F.explode(F.array("x0", "x1")).alias("x")).distinct().withColumn("gap", F.lead("x").over(page("x")) - F.col("x"))
    limit = F.greatest(F.median("gap") + F.when(F.count("gap") >= 2, F.stddev_samp("gap")).otherwise(F.median("gap") * 0.5) * factor, F.lit(least))
    per = xs.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), limit.alias("limit"))
    wide = xs.join(per, PAGE).where((F.col("n") >= 3) & (F.col("gap") > F.col("limit"))).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.col("x") + F.col("gap") / 2)).alias("wide"))
    out = pages.join(drawn, PAGE, "left").join(aligned, PAGE, "left").join(wide, PAGE, "left")
    none = F.array().cast("array<double>")
    gaps = F.concat(F.array(F.lit(0.0)), F.coalesce("wide", none), F.array(F.lit(float(width))))
    chosen = F.when((F.coalesce(F.size("drawn"), F.lit(0)) >= 3) & (F.col("inner") >= 2), F.col("drawn")).when(F.coalesce(F.size("aligned"), F.lit(0)) >= 3, F.col("aligned")).otherwise(gaps)
    return out.select(*PAGE, F.posexplode(chosen).alias("k", "boundary"))


# -- regions from density


def density(items: DataFrame, width: float, height: float, cells: int = 10) -> DataFrame:
    """Items of each row of a page's grid; items whose centre is off the page don't count."""
    row, column = (F.floor((F.col(f"{a}0") + F.col(f"{a}1")) / 2 / (size / cells)) for a, size in (("y", height), ("x", width)))
    inside = items.withColumns({"grid_row": row.cast("int"), "column": column}).where(F.col("grid_row").between(0, cells - 1) & F.col("column").between(0, cells - 1))
    return inside.groupBy(*PAGE, "grid_row").agg(F.count(F.lit(1)).alias("n"))


def dense_bands(items: DataFrame, width: float, height: float, least: int = 0, cells: int = 10, share: float = 0.8) -> DataFrame:
    """Bands (top, bottom) of neighbouring grid rows with more than share * max(mean, 3) items, on pages with ``least`` items or more."""
    some = items.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("words")).where(F.col("words") >= least).select(*PAGE)
    counts = density(items, width, height, cells).join(some, PAGE, "left_semi")
    dense = counts.withColumn("limit", share * F.greatest(F.sum("n").over(page()) / cells, F.lit(3.0))).where("n > limit")
    run = dense.withColumn("run", F.col("grid_row") - F.row_number().over(page("grid_row")))
    bands = run.groupBy(*PAGE, "run").agg(F.min("grid_row").alias("first"), F.max("grid_row").alias("last"))
    return bands.select(*PAGE, (F.col("first") * (height / cells)).alias("top"), ((F.col("last") + 1) * (height / cells)).alias("bottom"))


def text_regions(items: DataFrame, width: float, height: float) -> DataFrame:
    """Regions of dense bands with the extent of their texts and a margin, if they are wide and high enough."""
    bands = dense_bands(items, width, height)
    middle = (F.col("y0") + F.col("y1")) / 2
    bounds = bands.join(items, PAGE).where(middle.between(F.col("top"), F.col("bottom"))).groupBy(*PAGE, "top", "bottom").agg(F.min("x0").alias("lo"), F.greatest(F.max("x1"), F.lit(0.0)).alias("hi"))
    bounds = bounds.withColumns({"lo": F.least("lo", F.lit(float(width)))})
    found = F.col("lo") < F.col("hi")
    lo, hi = F.when(found, F.col("lo")).otherwise(0.0), F.when(found, F.col("hi")).otherwise(float(width))
    kept = bounds.where((hi - lo >= width * MIN_WIDTH) & (F.col("bottom") - F.col("top") >= MIN_HEIGHT))
    kept = kept.select(*PAGE, F.greatest(F.lit(0.0), lo - MARGIN).alias("r_x0"), F.col("top").alias("r_y0"), F.least(F.lit(float(width)), hi + MARGIN).alias("r_x1"), F.col("bottom").alias("r_y1"))
    return kept.withColumn("region_idx", (F.row_number().over(page("r_y0")) - 1).cast("int"))


def _in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of each group by middle height, middle x and id, with blanks between."""
    at = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("a"), ((F.col("x0") + F.col("x1")) / 2).alias("b"), "item_id", "text")
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(at)).alias("t"), F.count(F.lit(1)).alias("n_words"))
    return listed.select(*keys, F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"), "n_words")


def region_texts(items: DataFrame, regions: DataFrame, width: float) -> DataFrame:
    """Per region: region_text (items centred in it), context_text (items above it, in no earlier region scaled by a tenth) and confidence."""
    keys = [*PAGE, "region_idx"]
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    real = items.where(~T.is_blank(F.col("text")))
    met = real.join(regions, PAGE)
    inside = _in_order(met.where(cx.between(F.col("r_x0"), F.col("r_x1")) & cy.between(F.col("r_y0"), F.col("r_y1"))), keys)
    above = cy.between(F.greatest(F.lit(0.0), F.col("r_y0") - CONTEXT), F.col("r_y0")) & (F.abs(cx - (F.col("r_x0") + F.col("r_x1")) / 2) <= (F.col("r_x1") - F.col("r_x0")) * 0.75)
    near = met.where(above)
    earlier = regions.select(*PAGE, F.col("region_idx").alias("other"), *(F.col(f"r_{c}").alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")))
    taken = near.join(earlier, PAGE).where((F.col("other") < F.col("region_idx")) & cx.between(F.col("o_x0") * 0.9, F.col("o_x1") * 1.1) & cy.between(F.col("o_y0") * 0.9, F.col("o_y1") * 1.1))
    context = _in_order(near.join(taken.select(*keys, "item_id").distinct(), [*keys, "item_id"], "left_anti"), keys)
    out = regions.join(inside.withColumnRenamed("text", "region_text"), keys, "left").join(context.select(*keys, F.col("text").alias("context_text")), keys, "left")
    out = out.na.fill("", ["region_text", "context_text"]).na.fill(0, ["n_words"])
    ratio = (F.col("r_x1") - F.col("r_x0")) / max(width, 1)
    score = F.lit(0.5) + F.when(ratio >= 0.5, 0.2).when(ratio >= 0.3, 0.1).otherwise(0.0) + F.when(F.col("n_words") >= 20, 0.2).when(F.col("n_words") >= 10, 0.1).otherwise(0.0) + F.when(F.col("context_text") != "", 0.1).otherwise(0.0)
    return out.withColumn("confidence", F.least(score, F.lit(1.0)))


def outside_scaled(items: DataFrame, regions: DataFrame, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Items whose centre is in no region of their page with its coordinates scaled."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    met = items.join(regions, PAGE).where(cx.between(F.col("r_x0") * low, F.col("r_x1") * high) & cy.between(F.col("r_y0") * low, F.col("r_y1") * high))
    return items.join(met.select(*PAGE, "item_id").distinct(), [*PAGE, "item_id"], "left_anti")


def words_above(items: DataFrame, regions: DataFrame, margin: float = 100.0, tolerance: float = 5.0) -> DataFrame:
    """Per region: the words above it as lines; a line ends where a word is further than ``tolerance`` from the line's first."""
    keys = [*PAGE, "region_idx"]
    band = F.col("y0").between(F.greatest(F.lit(0.0), F.col("r_y0") - margin), F.col("r_y0")) & (F.col("y0") < F.col("r_y0")) & (F.col("x1") > F.col("r_x0") * 0.8) & (F.col("x0") < F.col("r_x1") * 1.2)
    met = items.where(~T.is_blank(F.col("text"))).join(regions, PAGE).where(band)
    listed = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("y0").alias("y"), "x0", "item_id", "text"))).alias("seq"))
    start = F.struct(F.get("seq", 0)["y"].alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        joins = F.abs(x["y"] - a["at"]) <= tolerance
        gap = F.when(a["out"] == "", "").when(joins, " ").otherwise("\n")
        return F.struct(F.when(joins, a["at"]).otherwise(x["y"]).alias("at"), F.concat(a["out"], gap, x["text"]).alias("out"))

    return listed.select(*keys, F.aggregate("seq", start, step, lambda a: T.stripped(a["out"])).alias("context"))


# -- columns from items


def column_ranges(items: DataFrame, multiplier: float = 2.5, least: float = 8.0) -> DataFrame:
    """Columns of a page from chains of x0: (col_idx, x0, x1).

    A chain breaks at gaps over max(multiplier * mean gap, least).  Columns with
    few items (below 15 % of the largest, three at least) join the nearest of the
    others.  Without any gap the page is one column.
    """
    real = items.where("x1 > x0")
    order = Window.partitionBy(*PAGE).orderBy("x0", "item_id")
    stepped = real.withColumn("before", F.lag("x0").over(order))
    mean = stepped.where(F.col("x0") > F.col("before")).groupBy(*PAGE).agg(F.avg(F.col("x0") - F.col("before")).alias("mean"))
    stepped = stepped.join(mean, PAGE, "left").withColumn("limit", F.greatest(F.col("mean") * multiplier, F.lit(least)))
    chained = islands(stepped, PAGE, F.struct("x0", "item_id"), F.col("x0") - F.col("before") > F.col("limit"))
    ranges = chained.groupBy(*PAGE, "island").agg(F.min("x0").alias("c0"), F.max("x1").alias("c1"), F.max(F.struct("x0", "item_id", "x1"))["x1"].alias("last"), F.first("mean").alias("mean"))
    ranges = ranges.withColumn("c1", F.when(F.col("mean").isNull(), F.col("last")).otherwise(F.col("c1")))
    lists = ranges.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("island", "c0", "c1"))).alias("cols"))
    home = F.get(F.filter("cols", lambda c: F.col("x0").between(c["c0"], c["c1"])), 0)["island"]
    counts = real.join(lists, PAGE).select(*PAGE, home.alias("island")).groupBy(*PAGE, "island").agg(F.count(F.lit(1)).alias("n"))
    held = ranges.join(counts, [*PAGE, "island"], "left").na.fill(0, ["n"]).withColumn("most", F.max("n").over(page()))
    held = held.withColumn("sparse", (F.count(F.lit(1)).over(page()) > 1) & (F.col("n") < F.greatest(F.floor(F.col("most") * 0.15), F.lit(3)))).withColumn("center", (F.col("c0") + F.col("c1")) / 2)
    solid = held.where("not sparse").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("island", "center"))).alias("solid"))
    near = F.array_min(F.transform("solid", lambda s: F.struct(F.abs(s["center"] - F.col("center")).alias("d"), s["island"].alias("island"))))["island"]
    merged = held.join(solid, PAGE).withColumn("to", F.when(F.col("sparse"), near).otherwise(F.col("island")))
    out = merged.groupBy(*PAGE, "to").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    return out.withColumn("col_idx", (F.row_number().over(page("to")) - 1).cast("int")).drop("to")


def overlap_column(items: DataFrame, columns: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds col_idx: the column (col_idx, c0, c1) with the greatest overlap over union if that is ``least`` or more, else the first that holds the centre, else null."""
    lists = columns.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("col_idx", "c0", "c1"))).alias("cols"))
    x0, x1 = F.col("x0"), F.col("x1")
    scored = F.transform("cols", lambda c: F.struct((-(F.greatest(F.lit(0.0), F.least(x1, c["c1"]) - F.greatest(x0, c["c0"])) / (F.greatest(x1, c["c1"]) - F.least(x0, c["c0"])))).alias("o"), c["col_idx"].alias("col_idx")))
    best = F.array_min(scored)
    centred = F.get(F.filter("cols", lambda c: ((x0 + x1) / 2).between(c["c0"], c["c1"])), 0)["col_idx"]
    return items.join(lists, PAGE, "left").withColumn("col_idx", F.when(-best["o"] >= least, best["col_idx"]).otherwise(centred)).drop("cols")


def column_schema(items: DataFrame, columns: DataFrame) -> DataFrame:
    """Per column: its items and dominant type; below three items and 30 % of them it is mixed, without any empty.  Ties go to the type seen first."""
    typed = overlap_column(usable(items), columns).where("col_idx is not null").withColumn("kind", T.item_type(F.col("text")))
    kinds = typed.groupBy(*PAGE, "col_idx", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("y_mid", "x0", "item_id")).alias("first"))
    per = kinds.groupBy(*PAGE, "col_idx").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("n"), "first", "kind")).alias("top"))
    out = columns.join(per, [*PAGE, "col_idx"], "left")
    weak = (-F.col("top.n") < 3) & (-F.col("top.n") / F.col("total") < 0.3)
    return out.select(*PAGE, "col_idx", "c0", "c1", F.coalesce("total", F.lit(0)).alias("total_items"), F.when(F.col("total").isNull(), "empty").when(weak, "mixed").otherwise(F.col("top.kind")).alias("dominant_type"))


def widest_row(rows: DataFrame) -> DataFrame:
    """The boxes of the first row with the most items (items with row_idx), as columns."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "row_idx"))
    best = rows.withColumn("n", n).withColumn("best", F.min(F.struct((-F.col("n")).alias("n"), "row_idx")).over(page())).where("best.row_idx = row_idx and x1 > x0")
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("x0", "item_id")) - 1
    return best.select(*PAGE, place.alias("col_idx"), F.col("x0").alias("c0"), F.col("x1").alias("c1"))


def label_baseline(rows: DataFrame) -> DataFrame:
    """The most frequent x0 (one decimal) of first items with CJK text, if at least three and 40 % of such rows have it; ties go to the first row."""
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy(*PAGE, "row_idx").orderBy("x0", "item_id"))).where((F.col("k") == 1) & F.col("text").rlike(T.CJK))
    counts = first.groupBy(*PAGE, F.round("x0", 1).alias("baseline")).agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("seen")).withColumn("all", F.sum("n").over(page()))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("n"), "seen"))).where("rank = 1")
    return best.where((F.col("all") >= 3) & (F.col("n") >= F.greatest(F.lit(3.0), F.col("all") * 0.4))).select(*PAGE, "baseline")


def column_of(centre: Column, boundaries: Column) -> Column:
    """The half-open interval of sorted boundaries that a centre is in; the first or last outside them."""
    below = F.size(F.filter(boundaries, lambda b: b <= centre))
    return F.greatest(F.lit(0), F.least(below - 1, F.size(boundaries) - 2)).cast("int")


def grid(items: DataFrame, bands: DataFrame, boundaries: DataFrame, margin: float = 0.2) -> DataFrame:
    """Cells (row_idx, col_idx, text) of words in row bands (row_idx, top, bottom) and between column boundaries.

    A word goes to the first band that holds its centre, widened by ``margin`` of
    the first band's height, and to the column it overlaps most, else the nearest.
    """
    rows = bands.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("row_idx", "top", "bottom"))).alias("bands"))
    lines = boundaries.groupBy(*PAGE).agg(F.array_sort(F.collect_list("boundary")).alias("b"))
    words = items.where(~T.is_blank(F.col("text"))).join(rows, PAGE).join(lines, PAGE).where(F.size("b") >= 2)
    slack = (F.get("bands", 0)["bottom"] - F.get("bands", 0)["top"]) * margin
    cy = (F.col("y0") + F.col("y1")) / 2
    row = F.get(F.filter("bands", lambda r: cy.between(r["top"] - slack, r["bottom"] + slack)), 0)["row_idx"]
    spans = F.transform(F.sequence(F.lit(0), F.size("b") - 2), lambda k: F.struct((-F.greatest(F.lit(0.0), F.least(F.col("x1"), F.get("b", k + 1)) - F.greatest(F.col("x0"), F.get("b", k)))).alias("o"), F.abs((F.col("x0") + F.col("x1")) / 2 - (F.get("b", k) + F.get("b", k + 1)) / 2).alias("d"), k.alias("k")))
    met = F.filter(spans, lambda s: s["o"] < 0)
    column = F.when(F.size(met) > 0, F.array_min(F.transform(met, lambda s: F.struct(s["o"].alias("o"), s["k"].alias("k"))))["k"]).otherwise(F.array_min(F.transform(spans, lambda s: F.struct(s["d"].alias("d"), s["k"].alias("k"))))["k"])
    placed = words.select(*PAGE, "item_id", "text", row.alias("row_idx"), column.alias("col_idx")).where("row_idx is not null")
    out = placed.groupBy(*PAGE, "row_idx", "col_idx").agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("t"))
    return out.select(*PAGE, "row_idx", "col_idx", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def overlap_ratio(a: list[Column], b: list[Column]) -> Column:
    """Common area of two boxes (x0, y0, x1, y1) over the smaller area; 0 for boxes without an area."""
    common = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    smaller = F.least((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return F.when(smaller > 0, common / smaller).otherwise(0.0)


def captions(items: DataFrame, regions: DataFrame, margin: float = 60.0) -> DataFrame:
    """Items in the band above a region (with context_text) that contain one of the context's words, or are contained in one; an item belongs to its first region."""
    words = T.keywords(F.col("context_text"))
    met = items.join(regions.withColumn("words", words), PAGE).where((F.col("y1") >= F.col("r_y0") - margin) & (F.col("y0") <= F.col("r_y0")))
    s = T.stripped(F.col("text"))
    hit = met.where(F.exists("words", lambda w: F.contains(s, w) | F.contains(w, s)))
    return hit.groupBy(*PAGE, "item_id").agg(F.min("region_idx").alias("region_idx"))


def begins_in_regions(items: DataFrame, regions: DataFrame) -> DataFrame:
    """(item, region) where the item's upper left corner is in the region."""
    return items.join(regions, PAGE).where(F.col("x0").between(F.col("r_x0"), F.col("r_x1")) & F.col("y0").between(F.col("r_y0"), F.col("r_y1")))


def row_records(rows: DataFrame) -> DataFrame:
    """A record for each row (items with row_idx): its height, and its texts, look-up keys and x ranges from left to right."""
    item = F.struct("x0", "item_id", "x1", "text")
    per = rows.groupBy(*PAGE, "row_idx").agg(F.min("y0").alias("y_min"), F.max("y1").alias("y_max"), F.array_sort(F.collect_list(item)).alias("i"))
    each = lambda f: F.transform("i", f)
    return per.select(*PAGE, "row_idx", "y_min", "y_max", each(lambda x: x["text"]).alias("texts"), each(lambda x: T.lookup_key(x["text"])).alias("keys"), each(lambda x: F.struct(x["x0"].alias("x0"), x["x1"].alias("x1"))).alias("ranges"))
