"""Signals and decisions about whole tables, from rows(table_id, row_idx, texts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import rows as R

# Steps of an axis, words of a table, words of a page header, words of a caption that states a table's range.
NICE_STEPS = [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 100000, 1000000]
TABLE_WORDS = ["合计", "总计", "总额", "小计", "项目", "指标", "单位", "万元", "千元", "百万元"]
REPORT_WORDS = ["年度报告", "年报", "股份有限公司", "有限公司", "目录"]
RANGE_WORDS = ["截至", "截止", "单位：", "Unit:", "万元", "千元", "百万元", "财务数据", "经营业绩", "主要指标", "资产负债表", "利润表", "现金流量"]
SECTION_WORDS = ["（续）", "(续)", "附注", "注释"]
TAIL_WORDS = ["合计", "总计", "总额", "小计"]
FINANCIAL, HEADLESS, PROSE, CONTENTS, OTHER, EMPTY = "财务数据表", "数据表(缺表头)", "文本列表", "目录", "非标准表格", "空表"


def by_row() -> Window:
    return Window.partitionBy("table_id").orderBy("row_idx")


def whole() -> Window:
    return Window.partitionBy("table_id")


def share(test: Column) -> Column:
    return F.count_if(test) / F.count(F.lit(1))


def axis_ticks(rows: DataFrame) -> DataFrame:
    """Per table: whether the first numbers of its rows rise or fall in even or usual steps, as those of an axis do."""
    first = rows.select("table_id", "row_idx", F.get(F.filter(F.transform("texts", T.axis_value), lambda v: v.isNotNull()), 0).alias("v"))
    steps = first.where("v is not null").withColumn("step", F.col("v") - F.lag("v").over(by_row()))
    size = F.abs("step")
    per = steps.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("least"), F.max("step").alias("most"), F.avg(size).alias("mean"), F.stddev_pop(size).alias("sd"))
    usual = F.exists(F.array(*(F.lit(float(s)) for s in NICE_STEPS)), lambda s: F.abs(F.col("mean") - s) / s < 0.05)
    found = (F.col("n") >= 3) & ((F.col("least") > 0) | (F.col("most") < 0)) & (usual | (F.col("sd") / F.col("mean") < 0.15))
    per = per.select("table_id", F.coalesce(found, F.lit(False)).alias("axis_ticks"))
    return rows.select("table_id").distinct().join(per, "table_id", "left").withColumn("axis_ticks", F.coalesce("axis_ticks", F.lit(False)))


def chart_signals(rows: DataFrame) -> DataFrame:
    """Per table: the signals that it is the lettering of a chart, its traits of a table, their score and the verdict (2 or more)."""
    texts, own = F.col("texts"), R.filled(F.col("texts"))
    percent = R.count_where(texts, lambda t: T.stripped(t).endswith("%"))
    number, cjk = lambda t: T.is_plain_number(t), lambda t: t.rlike(T.CJK)
    numbers, labels = R.count_where(own, number), R.count_where(own, lambda t: ~number(t) & cjk(t))
    head = F.when(F.size("texts") > 0, T.stripped(F.get(texts, 0)))
    single = (F.size(own) > 0) & (F.size(own) <= 5) & F.forall(own, lambda t: t.rlike(r"^[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]{1,2}$"))
    each = rows.select(
        "table_id", "row_idx", F.size("texts").alias("width"), F.size(own).alias("filled"), percent.alias("percents"), single.alias("single"),
        ((numbers > 0) & (labels == 0)).alias("numbers_only"), (labels > 0).alias("labelled"), F.when(head != "", head).alias("head"), F.exists(texts, cjk).alias("cjk"),
        F.exists(own, lambda t: T.has_word(t, TABLE_WORDS)).alias("word"), F.exists(own, lambda t: t.rlike(T.YEAR)).alias("year"), F.exists(own, lambda t: T.cjk_count(t) >= 4).alias("long"),
    )
    n = F.count(F.lit(1))
    per = each.groupBy("table_id").agg(
        n.alias("n"), F.max("width").alias("width"), F.sum("width").alias("cells"), F.sum("filled").alias("filled"), F.sum("percents").alias("percents"), F.count_if("single").alias("single"),
        F.count_if("numbers_only").alias("numbers_only"), F.count_if("labelled").alias("labelled"), F.count("head").alias("heads"), F.count_if(T.is_plain_number(F.col("head"))).alias("numeric_heads"),
        F.max(F.when(F.col("row_idx") == 0, F.col("cjk") & (F.col("width") >= 3))).alias("wide_header"), F.count_if(F.col("filled") <= 2).alias("narrow"),
        F.max("word").alias("word"), F.max("year").alias("year"), F.max("long").alias("long"),
    )
    c = F.col
    signals = {
        "single_chars": c("single") >= F.greatest(F.lit(3.0), c("n") * 0.6),
        "isolated_numbers": (c("numbers_only") / c("n") > 0.8) & (c("labelled") <= 1),
        "no_labels": (c("heads") < 2) | (c("numeric_heads") >= c("heads") * 0.7) | (c("heads") / c("n") < 0.3),
        "pie": ((c("width") <= 3) & (c("percents") / c("cells") > 0.4)) | ((c("width") <= 1) & (c("percents") >= 3)),
        "waterfall": (c("n") >= 3) & ~c("wide_header") & (c("narrow") >= c("n") * 0.7),
        "sparse": (c("width") >= 3) & (c("n") >= 3) & (c("narrow") >= c("n") * 0.6),
    }
    traits = F.when(c("n") < 3, 0).otherwise(c("word").cast("int") + c("year").cast("int") + c("long").cast("int") + ((c("width") >= 4) & (c("filled") / c("n") >= 3)).cast("int"))
    out = per.withColumns(signals).withColumn("traits", traits).join(axis_ticks(rows), "table_id")
    weight = {"axis_ticks": 3, "single_chars": 3, "isolated_numbers": 2, "no_labels": 2, "pie": 2, "waterfall": 1, "sparse": 2}
    score = sum(c(k).cast("int") * w for k, w in weight.items()) - F.when(c("traits") >= 3, 2).when(c("traits") >= 1, 1).otherwise(0)
    out = out.withColumn("score", score).withColumn("chart_like", F.when(c("n") < 2, False).when(c("filled") == 0, True).otherwise(c("score") >= 2))
    return out.select("table_id", *weight, "traits", "score", "chart_like")


def long_columns(rows: DataFrame) -> DataFrame:
    """(table_id, row_idx, col_idx, text) of rows."""
    return rows.select("table_id", "row_idx", F.posexplode("texts").alias("col_idx", "text"))


def numeric_marks(rows: DataFrame) -> DataFrame:
    """Per table: whether a column (from the third row on) is at least half numbers, or 15 % of all cells are; no table of one row is real."""
    cells = long_columns(rows).withColumn("s", T.stripped(F.col("text")))
    late = F.col("row_idx") >= 2
    column = cells.groupBy("table_id", "col_idx").agg(F.count_if(late & (F.col("s") != "")).alias("held"), F.count_if(late & T.is_plain_number(F.col("s"))).alias("numbers"), F.count_if(F.col("s") != "").alias("all"), F.count_if(T.is_signed_number(F.col("s"))).alias("signed"), F.max("row_idx").alias("last"))
    per = column.groupBy("table_id").agg(F.max(F.when(F.col("held") > 0, F.col("numbers") / F.col("held"))).alias("best"), F.sum("all").alias("all"), F.sum("signed").alias("signed"), (F.max("last") + 1).alias("n_rows"), F.count(F.lit(1)).alias("n_cols"))
    numeric = (F.coalesce(F.col("best"), F.lit(0.0)) >= 0.5) & (F.col("n_cols") >= 2) | (F.coalesce(F.try_divide("signed", "all"), F.lit(0.0)) >= 0.15)
    return per.select("table_id", "n_rows", ((F.col("n_rows") >= 2) & numeric).alias("is_real_table"), F.when(F.col("n_rows") < 2, "行数不足").when(~numeric, "纯文本数据，无数值列").alias("quality_reason"))


def table_quality(rows: DataFrame, fallback: bool = True) -> DataFrame:
    """Per table: has_header, has_numeric_data, numeric_col_count, row_count, col_count, is_real_table, is_complete, table_category.

    The header is looked for in the first quarter of the rows (2 to 6).  Rows of
    the header from the second on don't count as data as long as they follow each
    other.  ``fallback`` counts columns again below the first row only where no
    column was numeric below a longer header.
    """
    n = F.count(F.lit(1)).over(whole())
    scan = F.greatest(F.lit(2), F.least(F.lit(6), F.floor(n / 4)))
    marked = rows.withColumns({"n": n, "header": R.is_header(F.col("texts")) & (F.col("row_idx") < scan), "scan": scan})
    broken = F.min(F.when((F.col("row_idx") >= 1) & ~F.col("header"), F.col("row_idx"))).over(whole())
    marked = marked.withColumns({"has_header": F.max("header").over(whole()), "skip_to": F.coalesce(broken, F.col("n"))})
    marked = marked.withColumn("skip", F.when(F.col("has_header"), F.greatest(F.lit(1), F.least(F.col("skip_to"), F.col("scan"), F.col("n")))).otherwise(1))
    cells = marked.select("table_id", "row_idx", "n", "has_header", "skip", F.posexplode("texts").alias("col_idx", "text")).withColumn("s", T.stripped(F.col("text")))
    keep = (F.col("s") != "") & (F.col("row_idx") >= F.col("skip"))
    later = (F.col("s") != "") & (F.col("row_idx") >= 1)
    number = T.is_numeric(F.col("s"))
    column = cells.groupBy("table_id", "col_idx").agg(
        F.first("n").alias("n"), F.first("has_header").alias("has_header"), F.first("skip").alias("skip"), F.count_if(keep).alias("held"), F.count_if(keep & number).alias("numbers"), F.count_if(later).alias("held_later"), F.count_if(later & number).alias("numbers_later"),
        F.max(F.contains("text", F.lit("目录")) & (F.col("row_idx") < 3)).alias("contents"),
    )
    least = F.when(F.col("n") - F.col("skip") <= 2, 1).otherwise(2)
    good = (F.col("held") > 0) & (F.col("numbers") / F.greatest(F.col("held"), F.lit(1)) >= 0.5) & (F.col("numbers") >= least)
    again = (F.col("numbers_later") >= 1) & (F.col("numbers_later") / F.greatest(F.col("held_later"), F.lit(1)) >= 0.3)
    per = column.groupBy("table_id").agg(F.first("n").alias("row_count"), F.first("has_header").alias("has_header"), F.first("skip").alias("skip"), F.count(F.lit(1)).alias("col_count"), F.count_if(good).alias("good"), F.count_if(again).alias("again"), F.max("contents").alias("contents"))
    c = F.col
    per = per.withColumn("good", F.when(c("col_count") >= 2, c("good")).otherwise(0))
    real = (c("good") > 0) & (c("col_count") >= 2) & (c("row_count") >= 3)
    second = F.lit(fallback) & ~real & ~c("contents") & (c("good") == 0) & c("has_header") & (c("skip") > 1) & (c("col_count") >= 2) & (c("again") > 0)
    complete = c("has_header") & (c("row_count") >= 3)
    category = F.when(real & complete, FINANCIAL).when(real, HEADLESS).when(c("contents"), CONTENTS).when(second, OTHER).when(c("good") == 0, PROSE).otherwise(OTHER)
    return per.select(
        "table_id", "has_header", ((c("good") > 0) | second).alias("has_numeric_data"), F.when(second, c("again")).otherwise(c("good")).alias("numeric_col_count"), "row_count", "col_count",
        (real | second).alias("is_real_table"), complete.alias("is_complete"), category.alias("table_category"),
    )


def financial_confidence(quality: DataFrame) -> DataFrame:
    """Adds financial_confidence (three places): for real tables from columns, header and rows, for others by category."""
    c = F.col
    columns = F.least(c("numeric_col_count") / c("col_count"), F.lit(1.0))
    real = F.lit(0.55) + columns * 0.20 + F.when(c("has_header"), 0.12).otherwise(0.0) + F.when(c("row_count") > 3, F.least((c("row_count") - 3) / 12, F.lit(1.0)) * 0.08).otherwise(0.0)
    other = F.when(c("table_category") == CONTENTS, 0.03).when(c("table_category") == PROSE, 0.08).when(c("table_category") == OTHER, 0.15 + columns * 0.25).otherwise(0.02)
    value = F.when(c("table_category") == EMPTY, 0.0).when(c("is_real_table"), F.least(real, F.lit(1.0))).otherwise(F.least(other, F.lit(0.45)))
    return quality.withColumn("financial_confidence", F.round(value, 3))


def row_shares(rows: DataFrame) -> DataFrame:
    """Per table: share of rows that are page headers or footers, and of rows that are paragraphs."""
    return rows.groupBy("table_id").agg(share(R.is_furniture(F.col("texts"))).alias("furniture"), share(R.is_paragraph(F.col("texts"))).alias("paragraphs"))


def chart_labels(rows: DataFrame, quality: DataFrame) -> DataFrame:
    """Per table: whether, without a header, at least half of three or more rows begin with a percentage and a short CJK text."""
    first, second = T.stripped(F.get("texts", 0)), T.stripped(F.get("texts", 1))
    short = second.rlike(T.CJK) & (F.length(second) <= 8)
    wide = F.size("texts") >= 2
    per = rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(wide).alias("valid"), F.count_if(wide & first.endswith("%")).alias("percent"), F.count_if(wide & short).alias("short"))
    found = (F.col("n") >= 2) & ~F.col("has_header") & (F.col("valid") >= 3) & (F.col("percent") >= F.col("valid") * 0.5) & (F.col("short") >= F.col("valid") * 0.5)
    return per.join(quality.select("table_id", "has_header"), "table_id").select("table_id", found.alias("chart_labels"))


def acceptance(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """decision (accepted, review, rejected), reason, score and flags of each table, by the first rule that holds.

    ``scored`` comes from ``financial_confidence``.
    """
    t = scored.join(row_shares(rows), "table_id").join(chart_labels(rows, scored), "table_id")
    c, sure = F.col, F.col("financial_confidence")
    noisy = F.when(c("furniture") > 0, F.array(F.lit("page_header_footer_noise"))).otherwise(F.array().cast("array<string>"))
    percent = lambda x: F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))
    flags = lambda *names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    strong = (sure >= 0.75) & (c("row_count") >= 6) & (c("col_count") >= 4)
    rules = [
        (c("table_category").isin(PROSE, CONTENTS, EMPTY), "rejected", F.concat(F.lit("非财务表类型: "), "table_category"), F.lit(0.0), flags()),
        (~c("is_real_table"), "rejected", F.lit("缺少稳定数值列"), sure, flags("no_real_table")),
        (c("furniture") > 0.3, "rejected", F.concat(F.lit("页眉页脚占比过高 ("), percent(c("furniture")), F.lit(")")), sure, flags("page_header_footer_noise")),
        (c("paragraphs") > 0.4, "rejected", F.concat(F.lit("段落文本占比过高 ("), percent(c("paragraphs")), F.lit(")")), sure, flags("paragraph_noise")),
        (c("chart_labels"), "rejected", F.lit("图表标签区域，不是结构化表格"), sure, flags("chart_label")),
        ((c("table_category") == HEADLESS) & strong, "review", F.lit("疑似续表或缺表头，需要人工确认"), sure, F.concat(noisy, flags("no_header"))),
        (c("table_category") == HEADLESS, "rejected", F.lit("缺表头且结构弱"), sure, F.concat(noisy, flags("no_header_weak"))),
        ((c("table_category") == FINANCIAL) & (sure >= 0.75), "accepted", F.lit("高可信财务数据表"), sure, noisy),
        (sure >= 0.55, "review", F.lit("中等置信度财务候选"), sure, noisy),
    ]
    out = F.struct(F.lit("rejected").alias("decision"), F.lit("置信度过低").alias("reason"), sure.alias("score"), noisy.alias("flags"))
    for condition, decision, reason, score, own in reversed(rules):
        out = F.when(condition, F.struct(F.lit(decision).alias("decision"), reason.alias("reason"), score.alias("score"), own.alias("flags"))).otherwise(out)
    return t.select("table_id", out.alias("d")).select("table_id", "d.*")


def header_fragments(rows: DataFrame) -> DataFrame:
    """Per table: whether its one to three rows are a page header rather than data."""
    own = R.filled(F.col("texts"))
    number = lambda t: T.without(t, r",%().\-").rlike("^[0-9]+$")
    per = rows.select("table_id", "row_idx", R.joined(own).alias("whole"), F.size(own).alias("held"), R.count_where(own, number).alias("numbers"))
    per = per.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("held"), F.sum("numbers").alias("numbers"), F.when(F.count(F.lit(1)) <= 3, F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("row_idx") < 3, F.struct("row_idx", "whole")))), lambda x: x["whole"]), "")).alias("whole"))
    text = F.col("whole")
    early = T.has_word(text, REPORT_WORDS) | ((T.cjk_count(text) > 10) & (F.col("n") <= 2)) | text.rlike("^[0-9]{1,3}$")
    data = (F.col("held") > 0) & (F.col("numbers") / F.greatest(F.col("held"), F.lit(1)) >= 0.1)
    return per.select("table_id", ((F.col("n") <= 3) & (early | ~data)).alias("page_header"))


def boundary_features(rows: DataFrame) -> DataFrame:
    """Per table what merging asks for: n_cols, has_header (first row), ends_with_data, no_summary_at_end, complete_header, sub_tables."""
    texts, own = F.col("texts"), R.filled(F.col("texts"))
    n = F.count(F.lit(1)).over(whole())
    label = T.stripped(F.get("texts", 0))
    rest = F.slice("texts", F.lit(2), F.greatest(F.size("texts") - 1, F.lit(0)))
    numbers = R.count_where(own, T.is_numeric)
    is_data = (numbers >= F.greatest(F.lit(1), F.floor(F.size(own) / 2))) & (numbers >= 2)
    stops = F.min(F.when(is_data, F.col("row_idx"))).over(whole())
    summary = T.has_word(R.joined(texts), T.SUMMARY_WORDS)
    ahead = lambda test: F.col("row_idx") - F.lag(F.when(test, F.col("row_idx")), 1).over(by_row())
    last = lambda test: F.last(F.when(test, F.col("row_idx")), True).over(by_row().rowsBetween(Window.unboundedPreceding, -1))
    repeated = R.is_header_like(texts) & (F.col("row_idx") >= 1)
    each = rows.withColumns({
        "n": n, "labelled": F.exists(texts, lambda t: ~T.is_numeric_or_blank(t)), "closes": (F.size("texts") > 0) & ~T.has_word(F.coalesce(label, F.lit("")), TAIL_WORDS) & F.exists(rest, T.is_numeric_or_blank),
        "summary": summary, "scanned": (F.col("row_idx") < 8) & (F.col("row_idx") <= F.coalesce(stops, F.lit(8))) & (F.size(own) > 0),
        "titled": T.has_word(R.joined(own), SECTION_WORDS) | ((numbers == 0) & (T.cjk_count(R.joined(own)) >= 6)), "years": R.count_where(own, lambda t: t.rlike(T.YEAR)) >= 2, "entity": F.exists(own, lambda t: t.isin(T.ENTITY_WORDS)),
        "blank": F.size(own) <= 1, "summary_gap": F.when(summary, F.col("row_idx") - last(summary)), "header_gap": F.when(repeated, F.col("row_idx") - last(repeated)),
    })
    c = F.col
    per = each.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("texts")).alias("n_cols"), F.max(F.when(c("row_idx") == 0, c("labelled"))).alias("has_header"), F.max(F.when(c("row_idx") == c("n") - 1, c("closes") & (c("n") >= 2))).alias("ends_with_data"),
        F.max(F.when(c("row_idx") == c("n") - 1, ~c("summary"))).alias("no_summary_at_end"), F.max(c("scanned") & c("titled")).alias("titled"), F.max(c("scanned") & c("years")).alias("years"), F.max(c("scanned") & c("entity")).alias("entity"),
        F.count_if("blank").alias("blanks"), F.count_if(c("blank") & (c("row_idx") > 1) & (c("row_idx") < c("n") - 2)).alias("inner_blanks"), F.count_if("summary").alias("summaries"), F.max("summary_gap").alias("summary_gap"), F.max("header_gap").alias("header_gap"),
    )
    several = ((c("blanks") >= 2) & (c("inner_blanks") > 0)) | (F.coalesce(c("summary_gap"), F.lit(0)) > 2) | (F.coalesce(c("header_gap"), F.lit(0)) > 3) | ((c("n_cols") >= 6) & (c("summaries") >= 1))
    return per.select("table_id", "n_cols", "has_header", "ends_with_data", "no_summary_at_end", (c("titled") | (c("years") & c("entity"))).alias("complete_header"), ((c("n") >= 5) & several).alias("sub_tables"))


def body_start(rows: DataFrame) -> DataFrame:
    """Adds ``numbers`` (cells like numbers) and ``start``: the first of two neighbouring rows with two or more; else the third row, or the last of fewer."""
    numbers = R.count_where(F.col("texts"), T.is_number_like)
    each = rows.withColumns({"numbers": numbers, "n": F.count(F.lit(1)).over(whole())})
    pair = (F.col("numbers") >= 2) & (F.lag("numbers").over(by_row()) >= 2)
    each = each.withColumn("pair", F.when(pair, F.col("row_idx") - 1))
    found = F.coalesce(F.min("pair").over(whole()), F.lit(0))
    return each.withColumn("start", F.when((found == 0) & (F.col("n") > 2), F.least(F.lit(2), F.col("n") - 1)).otherwise(found)).drop("pair")


def body_signature(rows: DataFrame) -> DataFrame:
    """Per table with rows of two or more cells: ``typical`` (the greatest number of filled cells in rows of data) and ``ratios`` (share of numbers per column)."""
    own = F.size(R.filled(F.col("texts")))
    body = body_start(rows).withColumn("items", own).where("row_idx >= start").withColumn("some", F.max(F.col("numbers") >= 1).over(whole())).where("numbers >= 1 or not some")
    typical = F.max(F.col("items")).over(whole())
    body = body.withColumn("typical", typical).where("typical >= 2")
    cells = body.select("table_id", "typical", F.posexplode(F.slice("texts", F.lit(1), F.col("typical"))).alias("col_idx", "text")).where(~T.is_blank(F.col("text")))
    column = cells.groupBy("table_id", "typical", "col_idx").agg(share(T.is_number_like(F.col("text"))).alias("ratio"))
    per = column.groupBy("table_id", "typical").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "ratio"))).alias("m"))
    return per.select("table_id", "typical", F.transform(F.sequence(F.lit(0), F.col("typical") - 1), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("ratios"))


def body_match(texts: Column, typical: Column, ratios: Column) -> Column:
    """How well a row fits a signature: 0.3 for its number of filled cells, 0.7 for numbers where the body has numbers."""
    items = F.size(R.filled(texts))
    apart = F.abs(items - typical)
    width = F.when(apart == 0, 1.0).when(apart == 1, 0.8).when(apart == 2, 0.5).otherwise(0.2)
    cells = F.transform(F.slice(texts, F.lit(1), typical), lambda t, i: F.struct(T.stripped(t).alias("t"), (F.get(ratios, i) >= 0.5).alias("numeric")))
    cells = F.filter(cells, lambda x: x["t"] != "")
    points = F.transform(cells, lambda x: F.when(T.is_number_like(x["t"]) == x["numeric"], 1.0).when(x["numeric"], F.when(T.has_word(x["t"], T.SUMMARY_WORDS), 1.0).otherwise(0.0)).otherwise(0.5))
    kind = F.when(F.size(cells) == 0, 0.5).otherwise(F.aggregate(points, F.lit(0.0), lambda a, x: a + x) / F.size(cells))
    score = (width * 0.3 + kind * 0.7) * F.when((typical >= 4) & (F.size(cells) <= 1), 0.5).otherwise(1.0)
    return F.when((apart > 3) | (F.size(texts) == 0), 0.0).otherwise(score)


def matched_rows(rows: DataFrame) -> DataFrame:
    """Adds ``match`` (``body_match`` against the table's own signature, 0 without one) and ``has_body``."""
    out = rows.join(body_signature(rows), "table_id", "left")
    match = F.coalesce(body_match(F.col("texts"), F.col("typical"), F.col("ratios")), F.lit(0.0))
    return out.withColumns({"match": match, "has_body": F.col("typical").isNotNull()}).drop("typical", "ratios")


def table_start(rows: DataFrame) -> DataFrame:
    """Per table ``first_row``: that of the first row that is a header or fits the body; 0 if there is none or only one row."""
    texts, own = F.col("texts"), R.filled(F.col("texts"))
    several = F.size(own) >= 2
    word = F.exists(own, lambda t: t.rlike(T.YEAR) | T.has_word(t, T.CHANGE_WORDS) | T.has_word(t, T.HEADER_WORDS))
    short = (F.size(own) >= 3) & F.forall(own, lambda t: (F.length(t) <= 10) & ~T.is_number_like(t))
    begins = (F.size(own) > 0) & ((several & word) | short | R.names_two_entities(own) | (F.col("has_body") & (F.col("match") >= 0.55)))
    per = matched_rows(rows).groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(begins, F.col("row_idx"))).alias("at"))
    return per.select("table_id", F.when(F.col("n") >= 2, F.coalesce("at", F.lit(0))).otherwise(0).alias("first_row"))


def without_lead(rows: DataFrame) -> DataFrame:
    """Rows from the table's start on, renumbered; nothing goes where fewer than two would stay."""
    n = F.count(F.lit(1)).over(whole())
    out = rows.withColumn("n", n).join(table_start(rows), "table_id")
    cut = F.when((F.col("first_row") > 0) & (F.col("n") - F.col("first_row") >= 2), F.col("first_row")).otherwise(0)
    return out.withColumn("cut", cut).where("row_idx >= cut").withColumn("row_idx", F.col("row_idx") - F.col("cut")).select(rows.columns)


def _tail_cut(marked: DataFrame, goes: Column) -> DataFrame:
    """Without the run of rows at the end for which ``goes`` holds, but at least three rows stay of four or more."""
    n = F.count(F.lit(1)).over(whole())
    stays = F.max(F.when(~goes, F.col("row_idx"))).over(whole())
    removed = F.least(F.col("n") - 1 - F.coalesce(F.col("stays"), F.lit(-1)), F.greatest(F.lit(0), F.col("n") - 3))
    out = marked.withColumns({"n": n, "stays": stays}).withColumn("removed", F.when(F.col("n") >= 4, removed).otherwise(0))
    return out.where("row_idx < n - removed").drop("n", "stays", "removed")


def without_tail_notes(rows: DataFrame) -> DataFrame:
    """Without notes, blank rows and short texts without a digit at the end; a row with a word of summary that is no note stops."""
    own = R.filled(F.col("texts"))
    text = R.joined(own)
    short = (F.length(text) <= 20) & ~text.rlike("[0-9]") & ~T.has_word(text, T.SUMMARY_WORDS)
    return _tail_cut(rows, (F.size(own) == 0) | R.is_note(F.col("texts")) | short)


def without_tail_prose(rows: DataFrame) -> DataFrame:
    """Without rows at the end that don't fit the body; summaries stop, tables without a body stay whole."""
    own = R.filled(F.col("texts"))
    later = F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0)))
    prose = ~F.exists(later, T.is_number_like) | (F.col("match") < 0.55)
    goes = F.col("has_body") & ((F.size(own) == 0) | (~T.has_word(R.joined(own), T.SUMMARY_WORDS) & prose))
    return _tail_cut(matched_rows(rows), goes).select(rows.columns)


def titles(rows: DataFrame) -> DataFrame:
    """Per table a title: the first text of four characters or more, cut to 12; else the beginnings of its first three texts, joined."""
    cells = long_columns(rows).withColumn("s", T.stripped(F.col("text"))).where("s <> ''")
    at = F.min(F.struct("row_idx", "col_idx")).alias("at")
    texts = cells.groupBy("table_id", "s").agg(at).withColumn("place", F.row_number().over(Window.partitionBy("table_id").orderBy("at")))
    per = texts.groupBy("table_id").agg(F.min(F.when(F.length("s") >= 4, F.struct("at", "s"))).alias("long"), F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("at", "s")))).alias("short"))
    cut = F.replace(F.replace(F.replace(F.substring(F.col("long.s"), 1, 12), F.lit("/"), F.lit("-")), F.lit("\\"), F.lit("-")), F.lit("*"), F.lit(""))
    per = per.select("table_id", F.coalesce(cut, F.substring(F.array_join(F.transform("short", lambda x: x["s"]), "-"), 1, 20)).alias("title"))
    return rows.select("table_id").distinct().join(per, "table_id", "left").withColumn("title", F.coalesce("title", F.lit("表格")))


def filtered_tables(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """Tables (table_id, page, in order of table_id) that may hold data.

    One row is enough only for the first table of a page with two or more cells
    with a digit; others need a digit and must not look like a chart.
    """
    own = R.filled(F.col("texts"))
    plain = lambda t: T.without(t, ", ").rlike(T.NUMBER)
    numbers = R.count_where(own, plain)
    per = rows.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(R.count_where(own, lambda t: t.rlike("[0-9]"))).alias("digits"), F.sum(F.size(own)).alias("held"), F.sum(R.count_where(own, lambda t: t.rlike("^" + T.CJK + "$"))).alias("single"), F.count_if(numbers.between(1, 2)).alias("narrow")
    )
    values = long_columns(rows).withColumn("v", F.replace(T.stripped(F.col("text")), F.lit(","), F.lit(""))).where(F.col("v").rlike(T.NUMBER))
    order = Window.partitionBy("table_id").orderBy("row_idx", "col_idx")
    steps = values.withColumn("step", F.abs(F.col("v").cast("double") - F.lag(F.col("v").cast("double")).over(order)))
    even = steps.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_values"), F.avg("step").alias("mean"), F.stddev_pop("step").alias("sd"))
    c = F.col
    chart = (c("n") >= 2) & ((c("held") == 0) | ((c("single") >= 3) & (c("single") >= c("held") * 0.5)) | ((c("narrow") >= c("n") * 0.8) & (c("n") >= 3) & (c("n_values") >= 3) & (c("mean") > 0) & (c("sd") / c("mean") < 0.2)))
    first = ~F.coalesce(F.lag("page").over(Window.partitionBy("doc_id").orderBy("table_id")) == c("page"), F.lit(False))
    out = tables.withColumn("first_on_page", first).join(per, "table_id", "left").join(even, "table_id", "left").na.fill(0, ["n", "digits", "held", "single", "narrow", "n_values"])
    keep = F.when(c("n") < 2, c("first_on_page") & (c("digits") >= 2)).otherwise(c("digits") > 0) & ~F.coalesce(chart, F.lit(False))
    return out.where(keep).select(tables.columns)


def nearby_data(rows: DataFrame, before: int = 5, after: int = 4) -> DataFrame:
    """Per row: how many of the rows just before and just after it are data."""
    data = F.count_if(R.is_data(F.col("texts")))
    return rows.withColumns({"data_before": data.over(by_row().rowsBetween(-before, -1)), "data_after": data.over(by_row().rowsBetween(1, after))}).select("table_id", "row_idx", "data_before", "data_after")
