"""Scalar functions over cell text, as Column expressions.

The numeric tests differ on purpose; merging them changes results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
CJK = r"[\x{4e00}-\x{9fff}]"


def stripped(text: Column) -> Column:
    """Text without white space of any kind at both ends; null counts as empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def is_blank(text: Column) -> Column:
    return stripped(text) == ""


def _signed(text: Column) -> Column:
    """(x) as -x."""
    return F.regexp_replace(text, r"^\((.*)\)$", "-$1")


def number_text(text: Column) -> Column:
    """Text with a trailing %, thousands commas and spaces removed and (x) as -x."""
    return _signed(F.regexp_replace(F.regexp_replace(stripped(text), "%+$", ""), "[, ]", ""))


def is_numeric(text: Column) -> Column:
    """The classifier's test: ``number_text`` is a number."""
    return number_text(text).rlike(NUMBER)


def is_numeric_strict(text: Column) -> Column:
    """The correction engine's test: inner spaces are not removed."""
    return _signed(F.replace(F.regexp_replace(stripped(text), "%+$", ""), F.lit(","), F.lit(""))).rlike(NUMBER)


def is_numeric_or_blank(text: Column) -> Column:
    """The boundary module's test: only characters of numbers, or nothing."""
    return stripped(text).rlike(r"^[0-9,.\-()（）%]*$")


def is_number_data(text: Column) -> Column:
    """No CJK or Latin letter and at least one digit."""
    t = stripped(text)
    return ~t.rlike(CJK + "|[a-zA-Z]") & t.rlike("[0-9]")


def is_fill_number(text: Column) -> Column:
    """The filler's test: digits with an optional fraction after commas and % are gone."""
    return _signed(F.regexp_replace(stripped(text), "[,%]", "")).rlike(r"^-?[0-9]+\.?[0-9]*$")


def number_value(text: Column) -> Column:
    """The number that a numeric text stands for, else null."""
    t = number_text(text)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def strict_value(text: Column) -> Column:
    """The number of a text that passes ``is_numeric_strict``, else null."""
    t = _signed(F.replace(F.regexp_replace(stripped(text), "%+$", ""), F.lit(","), F.lit("")))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def is_score_number(text: Column) -> Column:
    """The confidence score's test: every bracket counts as a sign, and one % may end the number."""
    t = F.replace(F.replace(F.replace(stripped(text), F.lit(","), F.lit("")), F.lit("("), F.lit("-")), F.lit(")"), F.lit(""))
    return t.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*%?$")


def lookup_key(text: Column) -> Column:
    """Text for comparing cells: without commas, spaces and U+3000, (x) as -x."""
    return _signed(F.regexp_replace(stripped(text), "[, 　]", ""))


def cleaned(text: Column) -> Column:
    """Blank is empty, dashes alone and texts with letters are only trimmed, others keep the characters of numbers."""
    t = stripped(text)
    keep = (t == "") | t.rlike("^[-—―─－]+$") | t.rlike(CJK + "|[a-zA-Z]")
    return F.when(keep, t).otherwise(F.trim(F.regexp_replace(t, r"[^0-9,.\-()% ]", "")))


def item_type(text: Column) -> Column:
    """empty, percent, mixed, label, amount (six digits or more), ratio (below 100 with a point) or number."""
    t = stripped(text)
    number = F.regexp_extract(_signed(F.regexp_replace(t, "[, 　]", "")), r"-?[0-9]+\.?[0-9]*", 0)
    digits = F.length(F.regexp_replace(number, "[-.]", ""))
    return (
        F.when(t == "", "empty")
        .when(t.endswith("%"), "percent")
        .when(t.rlike(CJK) & t.rlike("[0-9]"), "mixed")
        .when(t.rlike(CJK), "label")
        .when(~t.rlike("[0-9]"), "mixed")
        .when(digits >= 6, "amount")
        .when((F.abs(number.try_cast("double")) < 100) & number.contains("."), "ratio")
        .otherwise("number")
    )


def cjk_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(CJK))


def let(value: Column, body) -> Column:
    """``body`` of the value; a lambda's body reads whole expressions anew for each element, and a bound value only once."""
    return F.get(F.transform(F.array(value), body), 0)


def all_ngrams(text: Column, n: int) -> Column:
    """N-grams of characters of the text, repeats included."""
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
    return let(text, lambda t: F.filter(grams(t), lambda g: F.length(g) == n))


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams of characters of the text in lower case."""
    return F.array_distinct(all_ngrams(F.lower(text), n))


CONFIDENCE = ["high", "medium", "low", "unresolvable"]


def worse_confidence(a: Column, b: Column) -> Column:
    """The worse of two levels; unknown ones count as the worst."""
    rank = lambda c: F.when(F.array_position(F.array(*map(F.lit, CONFIDENCE)), c) > 0, F.array_position(F.array(*map(F.lit, CONFIDENCE)), c)).otherwise(len(CONFIDENCE))
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.greatest(rank(a), rank(b)).cast("int"))


def json_object(text: Column, schema: str) -> Column:
    """The first that parses of: the whole text, a fenced block, the outermost braces; else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parse = lambda c: F.when(F.try_parse_json(c).isNotNull() if hasattr(F, "try_parse_json") else F.lit(True), F.from_json(c, schema))
    return F.coalesce(parse(text), parse(F.nullif(fenced, F.lit(""))), parse(F.nullif(braces, F.lit(""))))


# Words that mark headers, changes, entities, summaries and units.
HEADER_WORDS = [
    "项目", "指标", "科目", "资产", "负债", "收入", "支出", "金额", "余额", "占比", "比重", "数量", "比例", "利率", "年利率", "利息",
    "集团", "本行", "本公司", "母公司", "子公司", "合并", "手续费", "佣金", "净值", "市值", "利润", "总额", "阶段", "风险",
    "净收入", "损失", "期末", "期初", "年末", "年初",
]
CHANGE_WORDS = ["变化", "增减", "变动", "增幅", "±", "增速"]
ENTITY_WORDS = ["本集团", "本行", "本公司", "母公司", "子公司"]
SUMMARY_WORDS = ["合计", "总计", "总额", "小计", "累计", "平均"]
SHARED_VALUE_WORDS = ["总额", "总计", "合计", "净额", "净收入", "净利息", "净利", "净收益", "净值", "小计", "余额"]
UNIT_WORDS = ["万元", "千元", "百万元", "亿元", "元", "美元", "港币", "人民币"]
UNIT_NOTES = ["除外", "列示", "注明", "披露"]
YEAR = r"(19|20)[0-9]{2}"
DATE = r"[0-9]{1,2}[/-][0-9]{1,2}[/-](19|20)[0-9]{2}|[0-9]{1,2}月[0-9]{1,2}日|[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}"
DASHES = r"^[\s\-–—]+$"
YEAR_ALONE = r"^[\s　]*(19|20)[0-9]{2}年[\s　]*$"
MARKERS = [
    r"[0-9]{1,2}[.、．)）]\s*", r"\([0-9]{1,2}\)\s*", r"[（(][0-9]{1,2}[）)]\s*", r"[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]\s*",
    r"[（(][一二三四五六七八九十]+[）)]\s*", r"[*†‡]{1,3}[\s　]*", r"\[[0-9]{1,2}\]\s*",
]
MARKER = "^(?:" + "|".join(MARKERS) + ")"


def words_pattern(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def has_word(text: Column, words: list[str]) -> Column:
    """Whether a text contains one of the words."""
    return text.rlike(words_pattern(words))


def without(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, f"[{characters}]", "")


def is_plain_number(text: Column) -> Column:
    """The filter's test of a column: a number once commas, % and spaces are gone; brackets are not a sign."""
    return without(stripped(text), ",% ").rlike(NUMBER)


def is_signed_number(text: Column) -> Column:
    """The filter's test of a whole table: as ``is_plain_number``, with (x) as -x."""
    return _signed(without(stripped(text), ",% ")).rlike(NUMBER)


def is_axis_number(text: Column) -> Column:
    """The axis test: a number once commas, spaces and brackets are gone."""
    return without(stripped(text), ", ()").rlike(NUMBER)


def axis_value(text: Column) -> Column:
    return F.when(is_axis_number(text), without(stripped(text), ", ()").try_cast("double"))


def is_typed_number(text: Column) -> Column:
    """The column typing's test: every bracket counts as a sign, per cent and per mille signs are dropped."""
    return F.replace(without(F.replace(stripped(text), F.lit("("), F.lit("-")), ",)%‰"), F.lit(" "), F.lit(" ")).rlike(NUMBER)


def is_split_number(text: Column) -> Column:
    """The mixed-table test: ``is_plain_number`` but for plain years from 1900 to 2099."""
    return is_plain_number(text) & ~without(stripped(text), ",% ").rlike(r"^(19|20)[0-9]{2}$")


def is_single_number(text: Column) -> Column:
    """One number by itself: % and currency signs around it, a sign and commas don't count."""
    t = F.regexp_replace(F.regexp_replace(stripped(text), "^%+|%+$", ""), "^[￥$€]+|[￥$€]+$", "")
    return F.replace(F.regexp_replace(stripped(t), "^[+-]", ""), F.lit(","), F.lit("")).rlike(NUMBER)


def is_number_like(text: Column) -> Column:
    """Numbers, also with a few CJK characters; dates, plain years, dashes and enumerators are not."""
    t = stripped(text)
    digits = F.regexp_count(t, F.lit("[0-9]"))
    other = t.rlike(DATE) | t.rlike(YEAR_ALONE) | t.rlike(DASHES) | t.rlike(r"^[(（][0-9]{1,3}[)）]?$") | t.rlike(r"^[0-9]{1,3}[.、]$")
    return (t != "") & ~other & (is_numeric(text) | ((digits > 0) & (cjk_count(t) <= digits)))


def is_number_loose(text: Column) -> Column:
    """The structure scan's test: a cell of data rather than a piece of prose, a year, a page number or a date."""
    t = stripped(text)
    rest = F.regexp_replace(t, r"[,，%万元亿千百人民币港美()（）\s\-.·]", "")
    cjk, digits = cjk_count(rest), F.regexp_count(rest, F.lit("[0-9]"))
    no = t.rlike(r"^(19|20)[0-9]{2}年?$") | t.rlike(r"^(19|20)[0-9]{2}年") | t.rlike(r"^[0-9]{1,3}$") | t.rlike(r"[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.]") | t.rlike("[0-9]{1,2}月[0-9]{1,2}日")
    prose = rest.rlike(f"^{CJK}{{2,}}.*[0-9]") | ((cjk >= 4) & (cjk > digits)) | ((F.length(t) > 25) & (cjk > 0))
    return (t != "") & ~no & (digits > 0) & ~prose


def is_marker(text: Column) -> Column:
    """Whether a text begins with the number or sign of a note."""
    return stripped(text).rlike(MARKER)


def without_marker(text: Column) -> Column:
    """A text without the number or sign of a note that it begins with."""
    return F.regexp_replace(text, MARKER, "")


def is_summary_label(text: Column) -> Column:
    """Labels of rows that may rightly share a value with a row above."""
    return has_word(F.coalesce(text, F.lit("")), SHARED_VALUE_WORDS)


def keywords(text: Column) -> Column:
    """Parts of two or more characters between white space."""
    return F.filter(F.split(stripped(text), r"(?U)\s+"), lambda w: F.length(w) >= 2)


def safe_name(name: Column) -> Column:
    """A file name without its folder and suffix, cut to 100 characters; what is no letter, digit, _ or - becomes _."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    base = F.regexp_replace(F.trim(F.regexp_replace(F.substring(base, 1, 100), r'[:*?"<>|]', "_")), r"\.+$", "")
    return F.regexp_replace(base, r"[^\p{L}\p{N}_\-]", "_")
