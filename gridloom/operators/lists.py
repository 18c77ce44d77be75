"""Lists of tables, pages and files: filters, numbers, titles, marks, counts, batches and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import rows as R
from .quality import CONTENTS, EMPTY, FINANCIAL, HEADLESS, OTHER, PROSE

# The groups of the table list.
GROUPS = {"financial": [FINANCIAL], "headless": [HEADLESS], "prose": [PROSE], "other": [CONTENTS, OTHER, EMPTY, "图表标签"]}
#: Tables, tokens and rows of a request.
TABLES_PER_REQUEST, TOKENS_PER_TABLE, INPUT_TOKENS, ROWS_SENT = 35, 800, 48000, 40


def of_group(tables: DataFrame, group: str) -> DataFrame:
    """Tables of a group of the list (all, financial, headless, prose, other, marked, unmarked by hand), numbered on their page."""
    if group == "marked":
        tables = tables.where("manual_mark = 'table'")
    elif group == "unmarked":
        tables = tables.where("manual_mark = 'non_table'")
    elif group != "all":
        tables = tables.where(F.col("table_category").isin(GROUPS[group]))
    return tables.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("table_id")))


def title(given: Column, own: Column, context: Column, first_cell: Column) -> Column:
    """The title that is shown: the model's, its own, the first 12 characters of the context's first line, or 8 of the first cell."""
    line = F.substring(T.stripped(F.get(F.split(F.coalesce(context, F.lit("")), "\n"), 0)), 1, 12)
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(given), filled(own), filled(line), filled(F.substring(T.stripped(first_cell), 1, 8)), F.lit(""))


def for_export(tables: DataFrame) -> DataFrame:
    """Tables that are exported: extracted ones that are marked as tables or financial; where a document has none, its empty ones."""
    good = (F.col("parse_status") == "success") & ((F.coalesce("manual_mark", F.lit("")) == "table") | (F.col("table_category") == FINANCIAL))
    some = F.max(good).over(Window.partitionBy("doc_id"))
    return tables.withColumn("some", some).where(good | (~F.col("some") & (F.col("parse_status") == "empty"))).drop("some")


def page_ends(tables: DataFrame) -> DataFrame:
    """Adds first_on_page and last_on_page, in the order of tables."""
    w = Window.partitionBy("doc_id").orderBy("table_id")
    differs = lambda other: F.coalesce(other != F.col("page"), F.lit(True))
    return tables.withColumns({"first_on_page": differs(F.lag("page").over(w)), "last_on_page": differs(F.lead("page").over(w))})


def page_steps(tables: DataFrame) -> DataFrame:
    """Per page with tables: its first table, those of the pages before and after, and the list of its tables."""
    pages = tables.groupBy("doc_id", "page").agg(F.min("table_id").alias("first"), F.array_sort(F.collect_list("table_id")).alias("tables"))
    w = Window.partitionBy("doc_id").orderBy("page")
    return pages.withColumns({"previous": F.lag("first").over(w), "next": F.lead("first").over(w)})


def moved_page(tables: DataFrame, moves: DataFrame) -> DataFrame:
    """Tables with the new page of ``moves`` (doc_id, table_id, new_page), and their place in the list sorted by page."""
    out = tables.join(moves, ["doc_id", "table_id"], "left").withColumn("page", F.coalesce("new_page", "page")).drop("new_page")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "table_id")))


def toggled(mark: Column) -> Column:
    """The other mark: non_table becomes table, anything else non_table."""
    return F.when(mark == "non_table", "table").otherwise("non_table")


def latest(history: DataFrame, status: str | None = None) -> DataFrame:
    """The latest record of each file (filename, status, processed_time, record_id), of one status if given."""
    newest = history.groupBy("filename").agg(F.max(F.struct("processed_time", "record_id", "status")).alias("r")).select("filename", "r.*")
    return newest if status is None else newest.where(F.col("status") == status)


def kept_recent(entries: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Adds ``keep``: whether an entry (name, modified) is among the ``most`` latest of its group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("modified"), "name"))
    return entries.withColumn("keep", place <= most)


def top(rows: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k rows of a group with the highest score, the first in order of ``tie`` where equal."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def first_mode(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of a group, the one seen first where several are."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "seen", value)).alias("b")).select(*keys, f"b.{value}", (-F.col("b.m")).alias("n"))


def decision_counts(tables: DataFrame) -> DataFrame:
    """Tables of a document by category and decision."""
    return tables.groupBy("doc_id", "table_category", "decision").agg(F.count(F.lit(1)).alias("n"))


def document_summary(pages: DataFrame) -> DataFrame:
    """Per document: pages, pages with tables and their numbers, pages in error."""
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"), F.count_if("is_table_page").alias("table_pages"), F.count_if(F.col("error").isNotNull()).alias("error_pages"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_table_page"), F.col("page_number")))), ",").alias("table_page_numbers"),
    )


def usage_totals(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens, cost (per million tokens of input and output, six places a call) and calls of each run; a model without a price costs nothing."""
    priced = usage.join(F.broadcast(prices), "model", "left")  # a price list of a few models
    cost = F.round(F.col("prompt_tokens") / 1e6 * F.coalesce("input", F.lit(0.0)) + F.col("completion_tokens") / 1e6 * F.coalesce("output", F.lit(0.0)), 6)
    return priced.groupBy("run_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum(cost), 6).alias("cost_estimate"), F.count(F.lit(1)).alias("api_calls"))


def request_batches(tables: DataFrame, positional: bool = True) -> DataFrame:
    """Adds ``batch``: tables of a document in groups for one request each."""
    size = min(TABLES_PER_REQUEST, INPUT_TOKENS // TOKENS_PER_TABLE) if positional else min(150, INPUT_TOKENS // TOKENS_PER_TABLE)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("table_id")) - 1
    return tables.withColumn("batch", F.floor(place / size).cast("int"))


def preview(rows: DataFrame, most_rows: int = 5, most_chars: int = 20) -> DataFrame:
    """The first rows of a table as lines of cells with | between, long cells cut, and a note where rows are left out."""
    n = F.count(F.lit(1)).over(Window.partitionBy("table_id"))
    cut = F.transform("texts", lambda t: F.when(F.length(T.stripped(t)) > most_chars, F.concat(F.substring(T.stripped(t), 1, most_chars - 3), F.lit("..."))).otherwise(T.stripped(t)))
    lines = rows.withColumn("n", n).where(F.col("row_idx") < most_rows).select("table_id", "n", "row_idx", F.array_join(cut, " | ").alias("line"))
    per = lines.groupBy("table_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("row_idx", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    note = F.when(F.col("n") > most_rows, F.concat(F.lit("\n... (共"), F.col("n").cast("string"), F.lit(f"行，仅显示前{most_rows}行)"))).otherwise("")
    return per.select("table_id", F.concat(body, note).alias("preview"))


def request_text(rows: DataFrame, most: int = ROWS_SENT) -> DataFrame:
    """The rows of a table as numbered lines with tabs; of longer tables the first and last half of ``most``, with a note between."""
    n = F.count(F.lit(1)).over(Window.partitionBy("table_id"))
    line = F.concat(F.lit("  [行"), F.col("row_idx").cast("string"), F.lit("] "), F.array_join("texts", "\t"))
    each = rows.withColumn("n", n).where((F.col("n") <= most) | (F.col("row_idx") < most // 2) | (F.col("row_idx") >= F.col("n") - most // 2)).select("table_id", F.col("row_idx").cast("double").alias("at"), "n", line.alias("line"))
    note = each.where((F.col("n") > most) & (F.col("at") == 0)).select("table_id", F.lit(most // 2 - 0.5).alias("at"), "n", F.concat(F.lit("  ... (中间省略 "), (F.col("n") - most).cast("string"), F.lit(" 行) ...")).alias("line"))
    per = each.unionByName(note).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    return per.select("table_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("request"))


def file_name(table_id: Column, pages: Column, caption: Column, end: str) -> Column:
    """table_<three digits>_P<pages>_<caption>.<end>, the caption without forbidden characters and at most 30 long."""
    safe = F.trim(F.substring(F.regexp_replace(F.coalesce(caption, F.lit("")), r'[\\/:*?"<>|]', ""), 1, 30))
    number = F.when(F.length(table_id.cast("string")) >= 3, table_id.cast("string")).otherwise(F.lpad(table_id.cast("string"), 3, "0"))
    tail = F.when(F.coalesce(caption, F.lit("")) == "", "").otherwise(F.concat(F.lit("_"), safe))
    return F.concat(F.lit("table_"), number, F.lit("_P"), F.array_join(F.transform(pages, lambda p: p.cast("string")), "-"), tail, F.lit(f".{end}"))


def display_width(text: Column) -> Column:
    """Columns that a text takes up: two for each character beyond ASCII."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[^\x00-\x7F]"))


def text_lines(rows: DataFrame, most: int = 40) -> DataFrame:
    """Rows as numbered lines in columns as wide as their widest text, up to ``most``."""
    cells = rows.select("table_id", "row_idx", F.posexplode("texts").alias("col_idx", "text"))
    widths = cells.groupBy("table_id", "col_idx").agg(F.least(F.max(display_width(F.col("text"))), F.lit(most)).alias("w"))
    padded = F.when(F.length("text") >= F.col("w"), F.col("text")).otherwise(F.rpad("text", F.col("w"), F.lit(" ")))
    slots = rows.select("table_id", "row_idx").join(widths, "table_id").join(cells, ["table_id", "row_idx", "col_idx"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    lines = slots.groupBy("table_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", padded.alias("t")))).alias("l"))
    number = F.when(F.col("row_idx") >= 999, (F.col("row_idx") + 1).cast("string")).otherwise(F.lpad((F.col("row_idx") + 1).cast("string"), 3, " "))
    return lines.select("table_id", "row_idx", F.concat_ws(" ", F.concat(number, F.lit("│")), F.array_join(F.transform("l", lambda x: x["t"]), " ")).alias("line"))


def first_labels(rows: DataFrame, most: int = 5) -> DataFrame:
    """Texts of the first column in the first rows of a table, those that aren't blank."""
    first = rows.where(F.col("row_idx") < most).select("table_id", "row_idx", T.stripped(F.get("texts", 0)).alias("label")).where("label <> ''")
    return first.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "label"))), lambda x: x["label"]).alias("labels"))


def _subsets(labels: Column) -> Column:
    """Subsets of one to three elements of a sorted array."""
    after = lambda i: F.slice(labels, i + 2, F.size(labels))
    ones = F.transform(labels, lambda x: F.array(x))
    twos = F.flatten(F.transform(labels, lambda x, i: F.transform(after(i), lambda y: F.array(x, y))))
    threes = F.flatten(F.transform(labels, lambda x, i: F.flatten(F.transform(after(i), lambda y, j: F.transform(after(i + j + 1), lambda z: F.array(x, y, z))))))
    return F.concat(ones, twos, threes)


def best_region(labels: DataFrame, regions: DataFrame) -> DataFrame:
    """Per table (page_number, table_id, labels) the region of its page whose text has most of its first three labels, the first where equal; none without any.

    Different labels meet different texts once; then the first region of each
    subset of up to three labels serves all tables with those labels.
    """
    tables = labels.select("page_number", "table_id", F.array_sort(F.filter(F.slice("labels", F.lit(1), F.lit(3)), lambda t: t.isNotNull())).alias("own")).repartition("page_number", "table_id")
    # counts the ids so that both readers of the tables need the same columns and share one exchange
    kinds = tables.groupBy("page_number", "own").agg(F.count("table_id").alias("n")).where("n >= 0").drop("n")
    words = kinds.select("page_number", F.explode("own").alias("label")).distinct()
    texts = regions.groupBy("page_number", "region_text").agg(F.min("region_idx").alias("region_idx"))
    held = texts.join(words, "page_number").where(F.contains("region_text", "label")).groupBy("page_number", "region_text").agg(F.min("region_idx").alias("region_idx"), F.array_sort(F.collect_set("label")).alias("held"))
    sets = held.groupBy("page_number", "held").agg(F.min("region_idx").alias("region_idx"))
    first = sets.select("page_number", "region_idx", F.explode(_subsets(F.col("held"))).alias("part")).groupBy("page_number", "part").agg(F.min("region_idx").alias("region_idx"))
    parts = kinds.select("page_number", "own", F.explode(_subsets(F.array_distinct("own"))).alias("part"))
    n = F.size(F.filter("own", lambda t: F.array_contains("part", t)))
    chosen = parts.join(first, ["page_number", "part"]).groupBy("page_number", "own").agg(F.min(F.struct((-n).alias("m"), "region_idx")).alias("b"))
    best = tables.join(chosen, ["page_number", "own"]).groupBy("page_number", "table_id").agg(F.min("b").alias("b"))
    return best.select("page_number", "table_id", "b.region_idx")


def is_image_document(pages: DataFrame) -> DataFrame:
    """Per document: whether, among its first five pages and those around the middle of more than ten, more have only images than have text."""
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    index, middle = F.col("page_number") - 1, F.floor(F.col("total") / 2)
    sample = pages.withColumn("total", total).where((index < 5) | ((F.col("total") > 10) & index.between(middle - 2, middle + 2)))
    return sample.groupBy("doc_id").agg((F.count_if((F.col("spans") == 0) & (F.col("images") > 0)) > F.count_if(F.col("spans") > 0)).alias("is_image"))


def layer(cells: DataFrame, order: tuple[str, ...] = ("clean", "original", "raw")) -> DataFrame:
    """The cells (with ``layer``) of the first layer that a table has."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("layer"))
    return cells.withColumn("rank", rank).where("rank > 0").withColumn("best", F.min("rank").over(Window.partitionBy("table_id"))).where("rank = best").drop("rank", "best")


def accepted(results: DataFrame, rule: str) -> DataFrame:
    """Correction results that a rule accepts: all, none, or those of high confidence."""
    return results.where({"all": F.lit(True), "none": F.lit(False), "high": F.col("confidence") == "high"}[rule])


def without_key(tables: DataFrame) -> DataFrame:
    """The results of tables that no model was asked about: to be reviewed, with low confidence."""
    return tables.select("doc_id", "table_id", F.lit("needs_review").alias("status"), F.lit("low").alias("confidence"))


def labels_of(rows: DataFrame) -> DataFrame:
    return rows.select("table_id", "row_idx", R.label(F.col("texts")).alias("label"))


def confidence_counts(results: DataFrame) -> DataFrame:
    """Correction results of a document by confidence."""
    return results.groupBy("doc_id", "confidence").agg(F.count(F.lit(1)).alias("n"))


def pages_of_kind(pages: DataFrame, kind: str) -> DataFrame:
    """Pages with tables (tables) or in error (errors)."""
    return pages.where("is_table_page" if kind == "tables" else "error is not null")
