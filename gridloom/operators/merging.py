"""Decisions and edits that join tables to those before them, and the assignment of tables to pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import rows as R
from .quality import RANGE_WORDS, by_row, whole

#: Price of a page in the assignment, weight and reach of the position.
PAGE_PRICE, PRIOR, REACH = 0.002, 0.15, 25


def in_document() -> Window:
    return Window.partitionBy("doc_id").orderBy("table_id")


def adjacent_splits(tables: DataFrame) -> DataFrame:
    """Neighbouring tables of a document that may be one: (doc_id, table_id, after, verdict).

    ``tables`` has doc_id, table_id, page, n_cols, has_header, ends_with_data,
    n_regions (regions found on its page, null where the page wasn't looked at),
    shares_region (its labels and those of the table before are in one region)
    and context_lines (lines of text above it that aren't numbers).  verdict is
    confident, or the reason for a suggestion.
    """
    w = in_document()
    c = F.col
    before = tables.withColumns({"after": F.lag("table_id").over(w), "p_page": F.lag("page").over(w), "p_cols": F.lag("n_cols").over(w), "p_ends": F.lag("ends_with_data").over(w)}).where("after is not null")
    first = ~(c("p_page") == c("page"))
    close = (c("n_cols") > 0) & (c("p_cols") > 0) & (F.abs(c("n_cols") - c("p_cols")) <= 2)
    equal = c("n_cols") == c("p_cols")
    pattern = F.when(equal & ~c("has_header"), "confident").when(equal, "same_cols_no_header").when(~c("has_header"), "col_diff")
    by_region = F.when((c("n_regions") == 1) | ((c("n_regions") >= 2) & c("shares_region")), pattern)
    blocked = (first & (c("context_lines") >= 1)) | (c("context_lines") >= 2) | (first & ((c("page") != c("p_page") + 1) | ~c("p_ends")))
    by_rule = F.when(~blocked, F.when(equal & ~c("has_header"), "confident").when(equal, "same_cols_with_header").when(~c("has_header"), "col_diff"))
    verdict = F.when(close, F.when(~first & c("n_regions").isNotNull(), by_region).otherwise(by_rule))
    return before.select("doc_id", "table_id", "after", verdict.alias("verdict")).where("verdict is not null")


def kept_merges(pairs: DataFrame) -> DataFrame:
    """Of confident pairs (doc_id, table_id, after), those whose tables no kept pair before has used: every second pair of a run."""
    w = Window.partitionBy("doc_id").orderBy("table_id")
    chained = pairs.withColumn("starts", F.coalesce(F.col("after") != F.lag("table_id").over(w), F.lit(True)).cast("int")).withColumn("run", F.sum("starts").over(w))
    place = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("table_id"))
    return chained.withColumn("place", place).where("place % 2 = 1").select("doc_id", "table_id", "after")


def continues(first_row: Column, n_cols: Column, before_cols: Column, complete_header: Column, before_open: Column, before_sub_tables: Column) -> Column:
    """Whether a table goes on with the one before it: close widths, no header of its own, a first row of data, no summary at the end of the other."""
    length = F.length(R.joined(first_row))
    cjk = T.cjk_count(R.joined(first_row))
    heading = (cjk / length >= 0.4) & (F.size(first_row) >= 2) & R.is_header_like(first_row)
    close = (n_cols > 0) & (before_cols > 0) & (F.abs(n_cols - before_cols) <= 2)
    return close & ~complete_header & F.when(length == 0, before_open).otherwise(~heading & (before_open | before_sub_tables))


def cross_page_chains(tables: DataFrame) -> DataFrame:
    """Adds ``head``: the first table of the chain over pages that each table belongs to.

    A table continues the one before it if that is the last of the page before,
    it is the first of its page, and ``continues`` holds.  ``tables`` has doc_id,
    table_id, page, first_row and the columns of ``boundary_features``.
    """
    w = in_document()
    lag = lambda column: F.lag(column).over(w)
    joins = (F.col("page") == lag("page") + 1) & continues(F.col("first_row"), F.col("n_cols"), lag("n_cols"), F.col("complete_header"), lag("no_summary_at_end"), lag("sub_tables"))
    marked = tables.withColumn("joins", F.coalesce(joins, F.lit(False)))
    return marked.withColumn("head", F.last(F.when(~F.col("joins"), F.col("table_id")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("joins")


def states_range(caption: Column) -> Column:
    """Whether a caption states the range or unit of a table."""
    return T.has_word(F.trim(F.coalesce(caption, F.lit(""))), RANGE_WORDS)


def without_repeats(rows: DataFrame, before: DataFrame, least: float = 0.65) -> DataFrame:
    """Rows of continuations without what repeats the table before.

    ``rows`` is (table_id, row_idx, texts) of continuations, ``before`` the same of
    the tables they continue, under the continuation's id.  Rows like a header go;
    then those among the first 60 % that are like a row in the last 40 % of the
    table before; then, of rows that follow each other with the same label and are
    alike, the one with fewer texts, the later one if both have as many.  A
    continuation of which at most one row is no header keeps that row.
    """
    kept = rows.where(~R.repeats_header(F.col("texts")))
    kept = kept.withColumns({"place": F.row_number().over(by_row()) - 1, "n": F.count(F.lit(1)).over(whole())})
    key = F.get(F.filter(F.transform("texts", R.dedup_key), lambda t: t != ""), 0)
    kept = kept.withColumn("label", key)
    size = F.count(F.lit(1)).over(whole())
    tail = before.withColumn("size", size).where(F.col("row_idx") >= F.greatest(F.lit(0), F.col("size") - F.greatest(F.lit(1), F.floor(F.col("size") * 0.4)))).select("table_id", F.col("texts").alias("other"))
    early = kept.where((F.col("n") > 1) & (F.col("place") < F.greatest(F.lit(1), F.floor(F.col("n") * 0.6))) & F.col("label").isNotNull())
    repeated = early.join(tail, "table_id").where(R.similarity(F.col("other"), F.col("texts")) >= least).select("table_id", "row_idx").distinct()
    rest = kept.join(repeated, ["table_id", "row_idx"], "left_anti")
    w = Window.partitionBy("table_id", "label").orderBy("row_idx")
    held = F.size(R.filled(F.col("texts")))
    pairs = rest.where(F.col("label").isNotNull() & (F.col("n") > 1)).withColumns({"above": F.lag("texts").over(w), "above_row": F.lag("row_idx").over(w), "held": held}).withColumn("above_held", F.lag("held").over(w))
    alike = pairs.where(F.col("above").isNotNull() & (R.similarity(F.col("above"), F.col("texts")) >= least))
    gone = alike.select("table_id", F.when(F.col("above_held") >= F.col("held"), F.col("row_idx")).otherwise(F.col("above_row")).alias("row_idx")).distinct()
    return rest.join(gone, ["table_id", "row_idx"], "left_anti").select("table_id", "row_idx", "texts")


def append_padded(cells: DataFrame, pairs: DataFrame, separator: bool = False) -> DataFrame:
    """Rows of ``source`` tables below their ``target``, all padded to the wider of them; with ``separator`` a blank row between.

    A target has one source, and no table is both.
    """
    shape = cells.groupBy("table_id").agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("width"))
    sized = pairs.select("source", "target").join(shape.select(F.col("table_id").alias("source"), F.col("n_rows").alias("more"), F.col("width").alias("w")), "source").join(shape.select(F.col("table_id").alias("target"), "n_rows", "width"), "target")
    sized = sized.select("source", "target", F.greatest("w", "width").alias("width"), "n_rows", "more")
    between = int(separator)
    rows = cells.select("table_id", "row_idx").distinct()
    upper = rows.join(sized.withColumn("table_id", F.col("target")), "table_id").select("target", "width", "table_id", "row_idx", F.col("row_idx").alias("place"))
    lower = rows.join(sized.withColumn("table_id", F.col("source")), "table_id").select("target", "width", "table_id", "row_idx", (F.col("row_idx") + F.col("n_rows") + between).alias("place"))
    slots = upper.unionByName(lower)
    if separator:
        slots = slots.unionByName(sized.select("target", "width", F.lit(None).cast("long").alias("table_id"), F.lit(None).cast("int").alias("row_idx"), F.col("n_rows").alias("place")))
    slots = slots.select("*", F.explode(F.sequence(F.lit(0), (F.col("width") - 1).cast("int"))).alias("col_idx"))
    made = slots.join(cells, ["table_id", "row_idx", "col_idx"], "left").select(F.col("target").alias("table_id"), F.col("place").cast("int").alias("row_idx"), "col_idx", F.coalesce("text", F.lit("")).alias("text"))
    used = sized.select(F.explode(F.array("source", "target")).alias("table_id")).distinct()
    return cells.join(used, "table_id", "left_anti").select("table_id", "row_idx", "col_idx", "text").unionByName(made)


# -- pages


def position_prior(stated: Column, page: Column, total: Column) -> Column:
    """Weight of a page by its distance from the stated one; 0 beyond REACH pages."""
    apart = F.abs(stated - page)
    spread = F.greatest(F.lit(5.0), total * 0.03)
    return F.when((stated <= 0) | (page <= 0) | (apart > REACH), 0.0).when(apart == 0, PRIOR).otherwise(PRIOR * F.exp(-apart * apart / (2 * spread * spread)))


def _context_score(c: Column, p: Column, size: Column, has_region: Column) -> Column:
    """The score of a stripped context on a stripped page in lower case with so many different bigrams."""
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), T.stripped), lambda x: F.length(x) >= 3)
    longest = F.array_max(F.transform(F.filter(lines, lambda x: F.contains(p, F.lower(x))), F.length))
    of_line = F.when(longest.isNotNull(), F.least(F.lit(0.95), 0.7 + 0.03 * longest))

    def fuzzy(a: Column) -> Column:
        return T.let(F.struct(F.size(a).alias("own"), F.size(F.filter(a, lambda g: F.contains(p, g))).alias("common")), lambda n: F.struct(n["common"].alias("common"), (n["common"] / (n["own"] + size - n["common"])).alias("share")))

    met = T.let(T.char_ngrams(c, 2), fuzzy)
    of_grams = T.let(met, lambda m: F.when((m["common"] < 2) | (m["share"] < 0.08), 0.0).otherwise(F.least(F.lit(0.85), m["share"] + 0.02 * m["common"])))
    base = F.coalesce(of_line, of_grams, F.lit(0.0))
    return F.when((c == "") | (p == ""), 0.0).otherwise(base * F.when(has_region == F.lit(False), 0.5).otherwise(1.0))


def context_score(context: Column, page: Column, has_region: Column) -> Column:
    """How well a table's context fits a page's text: by its longest line there, else by common bigrams; half on pages without a region."""
    both = F.struct(T.stripped(context).alias("c"), F.lower(T.stripped(page)).alias("p"))
    return T.let(both, lambda x: _context_score(x["c"], x["p"], F.size(T.char_ngrams(x["p"], 2)), has_region))


def context_scores(tables: DataFrame) -> DataFrame:
    """(table_id, row_idx, score) of tables(table_id, page, contexts: array of row_idx, context, has_region); what is of a page alone is read once a page."""
    lowered = tables.select("table_id", "contexts", F.lower(T.stripped(F.col("page"))).alias("p"))
    each = lowered.select("table_id", "p", F.size(T.char_ngrams(F.col("p"), 2)).alias("size"), F.explode("contexts").alias("x"))
    return each.select("table_id", "x.row_idx", T.let(T.stripped(F.col("x.context")), lambda c: _context_score(c, F.col("p"), F.col("size"), F.col("x.has_region"))).alias("score"))


def page_grams(pages: DataFrame, n: int = 4) -> DataFrame:
    """Different n-grams of each page (doc_id, page_number, text), lower case and without white space."""
    clean = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s+", "")
    return pages.select("doc_id", "page_number", F.explode(T.char_ngrams(clean, n)).alias("gram"))


def common_grams(pages: DataFrame, n: int = 4, most: int = 3) -> DataFrame:
    """N-grams on more than ``most`` pages of their document."""
    return page_grams(pages, n).groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") > most)


def distinctive_share(texts: DataFrame, common: DataFrame, n: int = 4, least: float = 0.5) -> DataFrame:
    """Per text (doc_id, text_id, text): share of the n-grams, repeats included, that aren't common in the document, and whether it is ``least`` or more.

    Texts that are equal in a document are looked up once.
    """
    clean = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s+", "")
    texts = texts.select("doc_id", "text_id", clean.alias("_t"))
    each = texts.select(F.col("doc_id").alias("_d"), "_t").distinct().select("_d", "_t", F.explode_outer(T.all_ngrams(F.col("_t"), n)).alias("gram"))
    met = each.join(common.select(F.col("doc_id").alias("_d"), "gram", F.lit(1).alias("known")), ["_d", "gram"], "left")
    per = met.groupBy("_d", F.col("_t").alias("_u")).agg(F.count("gram").alias("n"), F.count_if(F.col("gram").isNotNull() & F.col("known").isNull()).alias("rare"))
    share = F.coalesce(F.try_divide("rare", "n"), F.lit(0.0))
    of_each = texts.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u")))
    return of_each.select("doc_id", "text_id", share.alias("share"), ((F.col("n") > 0) & (share >= least)).alias("distinctive"))


def anchor_segments(tables: DataFrame, total: int) -> DataFrame:
    """Tables without an anchor page (doc_id, table_id, page): the pages between the anchors around them, and the number of their segment."""
    w = in_document().rowsBetween(Window.unboundedPreceding, 0)
    # a frame that begins at the first row grows by a row at a time, one that ends at the last is read anew for each row
    back = Window.partitionBy("doc_id").orderBy(F.desc("table_id")).rowsBetween(Window.unboundedPreceding, 0)
    out = tables.withColumns({
        "low": F.coalesce(F.last("page", True).over(w), F.lit(1)), "segment": F.count("page").over(w), "high": F.coalesce(F.last("page", True).over(back), F.lit(total)),
    })
    return out.where("page is null").select("doc_id", "table_id", "segment", "low", "high")


def assign_pages(scores: DataFrame, price: float = PAGE_PRICE) -> DataFrame:
    """(doc_id, table_id, page, score): non-decreasing pages with the greatest sum of scores less the price of the pages stepped over.

    ``scores`` is (doc_id, table_id, page, score) for every table and candidate
    page of a document; a missing pair scores 0.  Documents are independent, and
    one document's tables by pages have to fit a task.  Ties go to the lower page.
    """

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        grid = frame.pivot_table(index="table_id", columns="page", values="score", aggfunc="max", fill_value=0.0)
        value, (n, m) = grid.to_numpy(float), grid.shape
        cost = price * np.arange(m)
        came = np.zeros((n, m), int)
        total = value[0].copy()
        for t in range(1, n):
            gain = total + cost
            peak = np.maximum.accumulate(gain)
            came[t] = np.maximum.accumulate(np.where(np.append(True, gain[1:] > peak[:-1]), np.arange(m), 0))
            total = value[t] + peak - cost
        at = np.zeros(n, int)
        at[-1] = int(total.argmax())
        for t in range(n - 1, 0, -1):
            at[t - 1] = came[t, at[t]]
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[0], "table_id": grid.index, "page": grid.columns.to_numpy()[at], "score": value[np.arange(n), at]})

    kind = {f.name: f.dataType.simpleString() for f in scores.schema}
    return scores.select("doc_id", "table_id", "page", "score").groupBy("doc_id").applyInPandas(best, f"doc_id {kind['doc_id']}, table_id {kind['table_id']}, page {kind['page']}, score double")


def token_pages(tokens: DataFrame, pages: DataFrame, long: int = 6) -> DataFrame:
    """On how many pages of its document each token (doc_id, token) occurs, as it is or without commas.

    A token can only be on a page with a word (between blanks) that contains the
    longest piece of the token without a blank.  Different pieces meet different
    words by the first ``long`` characters, and words lead to their pages; tokens
    with a blank are then looked up in the text.
    """
    form = F.explode(F.array_distinct(F.array(F.lower("token"), F.lower(F.replace("token", F.lit(","), F.lit(""))))))
    forms = tokens.select("doc_id", "token").where("token is not null").distinct().select("doc_id", "token", form.alias("form"))
    longest = F.array_max(F.transform(F.split("form", " "), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    forms = forms.withColumn("piece", longest)
    words = pages.select("doc_id", "page_number", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word"))
    starts = T.let(F.col("word"), lambda w: F.array_distinct(F.flatten(F.array(F.array(F.lit("")), *(T.all_ngrams(w, n) for n in range(1, long + 1))))))
    pieces = forms.select("piece").distinct().withColumn("start", F.substring("piece", 1, long))
    hits = words.select("word").distinct().select("word", F.explode(starts).alias("start")).join(pieces, "start").where(F.contains("word", "piece")).select("word", "piece")
    known = forms.join(hits, "piece").select("doc_id", "token", "word", F.when(F.col("form") != F.col("piece"), F.col("form")).alias("form")).distinct()
    met = words.join(known, ["doc_id", "word"]).select("doc_id", "token", "page_number", "form").distinct()
    whole = met.where("form is not null").join(pages.select("doc_id", "page_number", F.lower("text").alias("text")), ["doc_id", "page_number"]).where(F.contains("text", "form"))
    found = met.where("form is null").select("doc_id", "token", "page_number").unionByName(whole.select("doc_id", "token", "page_number"))
    return found.groupBy("doc_id", "token").agg(F.countDistinct("page_number").alias("pages"))
