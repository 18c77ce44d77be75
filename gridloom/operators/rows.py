"""Predicates and scores of one row, given as the array of its texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Patterns of page headers and footers, words that open a note, the context of a report's number, terms of row labels.
FURNITURE = ["(银行|公司|集团)股份有限公司$", "20[0-9]{2}年(度|半年度|年度)?报告", "管理层讨论[与和]分析", "财务回顾|经营情况讨论与分析", "财务报表附注", "（除特别注明外", "^[0-9]+$"]
NOTE_WORDS = ["注：", "注释：", "备注：", "说明：", "附注：", "资料来源：", "数据来源：", "Source:", "Note:", "Notes:"]
NUMBERED_BY = "第|号|规则|编报|披露|公告|CIRCULAR|Report|No\\."
LABEL_TERMS = [
    "资产", "负债", "收入", "支出", "费用", "利润", "成本", "收益", "贷款", "存款", "投资", "利息", "总额", "净额", "减值", "拨备",
    "资本", "权益", "现金", "同业", "金融", "债券", "借款", "回购", "发放", "存放", "吸收", "发行", "拆出", "拆入", "卖出", "买入",
    "生息", "计息", "非生息", "非计息",
]
UNIT = r"(?i)单位\s*[：:]\s*\S|Unit\s*:\s*\S|单位[：:]|Unit:"


def of_cells(cells: DataFrame) -> DataFrame:
    """rows(table_id, row_idx, texts): the texts of each row in the order of its columns."""
    rows = cells.groupBy("table_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", F.coalesce("text", F.lit("")).alias("text")))).alias("r"))
    return rows.select("table_id", "row_idx", F.transform("r", lambda x: x["text"]).alias("texts"))


def filled(texts: Column) -> Column:
    """Texts that aren't blank, stripped."""
    return F.filter(F.transform(texts, T.stripped), lambda t: t != "")


def joined(texts: Column) -> Column:
    return F.array_join(texts, "")


def count_where(texts: Column, test) -> Column:
    return F.size(F.filter(texts, test))


def label(texts: Column) -> Column:
    """The first text of a row that isn't blank, stripped; null for a blank row."""
    return F.get(filled(texts), 0)


def value_set(texts: Column) -> Column:
    """Distinct look-up keys of the texts that aren't blank."""
    return F.array_sort(F.array_distinct(F.transform(filled(texts), T.lookup_key)))


def value_map(texts: Column) -> Column:
    """The last column of each look-up key."""
    places = F.filter(F.transform(texts, lambda t, i: F.struct(T.lookup_key(t).alias("k"), i.alias("i"))), lambda x: x["k"] != "")
    keys = F.array_distinct(F.transform(places, lambda x: x["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.array_max(F.transform(F.filter(places, lambda x: x["k"] == k), lambda x: x["i"])))))


def is_header_like(texts: Column) -> Column:
    """A year and a word of change; or a year, only short texts and no long number."""
    year = F.exists(texts, lambda t: t.rlike(T.YEAR))
    change = F.exists(texts, lambda t: T.has_word(t, T.CHANGE_WORDS))
    long_number = F.exists(texts, lambda t: t.rlike("[0-9][0-9,.]{3,}"))
    return year & (change | (F.forall(texts, lambda t: F.length(t) <= 6) & ~long_number))


def is_header(texts: Column) -> Column:
    """``is_header_like``, or several cells with a word of headers among them."""
    return is_header_like(texts) | ((F.size(texts) >= 2) & T.has_word(joined(texts), T.HEADER_WORDS))


def names_two_entities(texts: Column) -> Column:
    """Two or more different words for entities in a row."""
    whole = F.array_join(texts, "\n")
    found = [F.contains(whole, F.lit(w)).cast("int") for w in T.ENTITY_WORDS]
    return sum(found[1:], found[0]) >= 2


def is_data(texts: Column) -> Column:
    """At least half (and one) of the texts that are no dashes are like numbers, and the row doesn't name two entities."""
    real = F.filter(filled(texts), lambda t: ~t.rlike(T.DASHES))
    numbers = count_where(real, T.is_number_like)
    return (F.size(real) > 0) & ~names_two_entities(filled(texts)) & (numbers >= F.greatest(F.lit(1), F.floor(F.size(real) / 2)))


def is_unit(texts: Column) -> Column:
    """A row that states the unit of the numbers."""
    whole = joined(filled(texts))
    inner = F.regexp_extract(whole, "[（(]([^）)]*)[）)]", 1)
    bracketed = whole.rlike("^[（(][^）)]*[）)]$") & (T.has_word(inner, T.UNIT_WORDS) | T.has_word(inner, T.UNIT_NOTES))
    return whole.rlike(UNIT) | bracketed | whole.isin(T.UNIT_WORDS)


def unit(texts: Column) -> Column:
    """The unit that a row states, else its whole text."""
    whole = joined(filled(texts))
    first, second = F.regexp_extract(whole, r"单位\s*[：:]\s*(.+)", 1), F.regexp_extract(whole, r"(?i)Unit\s*:\s*(.+)", 1)
    named = F.coalesce(*(F.when(F.contains(whole, F.lit(w)), F.lit(w)) for w in T.UNIT_WORDS))
    return F.coalesce(F.when(first != "", T.stripped(first)), F.when(second != "", T.stripped(second)), named, whole)


def is_furniture(texts: Column) -> Column:
    """A page header, footer or chapter title."""
    whole = joined(filled(texts))
    return (whole != "") & whole.rlike("|".join(FURNITURE))


def is_paragraph(texts: Column) -> Column:
    """One or two long texts without a number."""
    own = filled(texts)
    return (F.size(own) > 0) & (F.length(joined(own)) > 40) & (F.size(own) <= 2) & ~F.exists(own, T.is_numeric)


def loose_numbers(texts: Column) -> Column:
    """Numbers in the texts of a row, but for years and the numbers of documents and rules; the first text's marker doesn't count."""
    own = filled(texts)
    bare = F.transform(own, lambda t, i: F.when((i == 0) & T.is_marker(t), T.without_marker(t)).otherwise(t))

    def counts(t: Column, n: Column) -> Column:
        value = n.try_cast("double")
        at = F.position(n, t)
        around = F.concat(t.substr(F.greatest(at - 5, F.lit(1)), at - F.greatest(at - 5, F.lit(1))), t.substr(at + F.length(n), F.lit(3)))
        return ~value.between(1900, 2100) & ~((value <= 20) & around.rlike(NUMBERED_BY))

    each = F.transform(bare, lambda t: count_where(F.regexp_extract_all(t, F.lit(r"(-?[0-9]+\.?[0-9]*)"), 1), lambda n: counts(t, n)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def is_note(texts: Column) -> Column:
    """A footnote or remark, by its marker, its opening word, its length or its end."""
    own = filled(texts)
    whole, first, n = joined(own), F.get(own, 0), F.size(own)
    size, cjk, numbers = F.length(whole), T.cjk_count(whole), loose_numbers(texts)
    marked = T.is_marker(first) & (numbers == 0) & (cjk >= 5) & ((size >= 15) | (whole.endswith("。") & (size >= 8)))
    opened = first.rlike("^(" + T.words_pattern(NOTE_WORDS) + ")") & (numbers <= 1) & (cjk >= 5)
    long = (size >= 50) & (numbers == 0) & (n <= 2) & (cjk >= 15)
    sentence = (n <= 2) & (size >= 20) & (cjk >= 8) & whole.rlike(r"[。.）)]$") & (numbers == 0)
    return (n > 0) & (marked | opened | long | sentence | ((n <= 2) & (cjk >= 15) & (numbers <= 2)))


def score(texts: Column, kinds: Column | None = None) -> Column:
    """Points for a row of data: filled cells, share of numbers, a label of finance, cells of their column's kind (``kinds``)."""
    own = F.filter(texts, lambda t: T.stripped(t) != "")
    n = F.size(own)
    numbers = count_where(own, lambda t: T.item_type(t).isin("amount", "number", "percent", "ratio"))
    share = numbers / F.greatest(n, F.lit(1))
    cells = F.when(n >= 4, 3).when(n >= 3, 2).when(n == 2, 1).otherwise(0)
    numeric = F.when(share >= 0.5, 3).when(share >= 0.3, 2).when(numbers > 0, 1).otherwise(0)
    first = F.get(own, 0)
    named = F.when(T.item_type(first).isin("label", "mixed") & T.has_word(first, LABEL_TERMS), 2).otherwise(0)
    out = cells + numeric + F.coalesce(named, F.lit(0))
    if kinds is not None:
        fits = F.size(F.filter(F.transform(own, lambda t, i: (i < F.size(kinds)) & (T.item_type(t) == F.get(kinds, i))), lambda x: x))
        out = out + F.when(F.size(kinds) >= 2, F.least(fits, F.lit(3))).otherwise(0)
    return out


def repeats_header(texts: Column) -> Column:
    """The continuation's test of a header: a year by itself, a word of change, or only short texts with a digit."""
    own = filled(texts)
    year = F.exists(texts, lambda t: t.rlike(r"(?U)\b(19|20)[0-9]{2}年?\b"))
    change = F.exists(texts, lambda t: t.rlike("变化|增减|变动|±"))
    short = (F.size(own) > 0) & F.forall(own, lambda t: F.length(t) <= 6) & F.exists(own, lambda t: t.rlike("[0-9]"))
    return year | change | short


def dedup_key(text: Column) -> Column:
    """Text for comparing rows: without commas, spaces and superscripts, (x) as -x."""
    return F.regexp_replace(T.lookup_key(text), "[¹²³⁰-⁹]", "")


def similarity(a: Column, b: Column) -> Column:
    """0.4 for the labels (0.8 of it if one contains the other) and 0.6 for the Jaccard of the other values; labels alone if a row has no others."""
    first = [F.get(F.filter(F.transform(x, dedup_key), lambda t: t != ""), 0) for x in (a, b)]
    rest = [F.array_distinct(F.filter(F.transform(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), dedup_key), lambda t: t != "")) for x in (a, b)]
    match = F.when(first[0] == first[1], 1.0).when(F.contains(first[0], first[1]) | F.contains(first[1], first[0]), 0.8).otherwise(0.0)
    common = F.size(F.array_intersect(*rest))
    overlap = common / (F.size(rest[0]) + F.size(rest[1]) - common)
    return F.coalesce(F.when(match == 0, 0.0).when((F.size(rest[0]) == 0) | (F.size(rest[1]) == 0), match).otherwise(0.4 * match + 0.6 * overlap), F.lit(0.0))


def has_numbers(texts: Column) -> Column:
    """At least 30 % of the texts (and one) pass the filler's number test."""
    return count_where(texts, T.is_fill_number) >= F.greatest(F.lit(1.0), F.size(texts) * 0.3)
