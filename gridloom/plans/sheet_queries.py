"""Queries over the sheets (longer derived tables with headers, notes, charts and prose), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality as Q
from ..operators import rows as R
from ..sources.derived import SHEET_SQL, sheets
from .queries import query

# -- SQL of the predicates; x is a stripped text
CJK = "[\\x{4e00}-\\x{9fff}]"
NUM = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"
STRIP = "regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '')"
YEAR = "(19|20)[0-9]{2}"


def m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def drop(x: str, characters: str) -> str:
    return f"regexp_replace({x}, '[{characters}]', '', 'g')"


def signed(x: str) -> str:
    return f"regexp_replace({x}, '^\\((.*)\\)$', '-\\1')"


def numeric(x: str) -> str:
    return m(signed(drop(f"regexp_replace({x}, '%+$', '')", ", ")), NUM)


def plain(x: str) -> str:
    return m(drop(x, ",% "), NUM)


def cjk_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{CJK}'))"


def number_like(x: str) -> str:
    date = "[0-9]{1,2}[/-][0-9]{1,2}[/-](19|20)[0-9]{2}|[0-9]{1,2}月[0-9]{1,2}日|[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}"
    others = [date, "^(19|20)[0-9]{2}年$", "^[\\s\\-–—]+$", "^[(（][0-9]{1,3}[)）]?$", "^[0-9]{1,3}[.、]$"]
    digits = f"len(regexp_extract_all({x}, '[0-9]'))"
    return f"({x} <> '' AND NOT (" + " OR ".join(m(x, o) for o in others) + f") AND ({numeric(x)} OR ({digits} > 0 AND {cjk_count(x)} <= {digits})))"


def words(x: str, listed: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in listed.split()) + ")"


HEADERS = "项目 指标 科目 资产 负债 收入 支出 金额 余额 占比 比重 数量 比例 利率 年利率 利息 集团 本行 本公司 母公司 子公司 合并 手续费 佣金 净值 市值 利润 总额 阶段 风险 净收入 损失 期末 期初 年末 年初"
CHANGES = "变化 增减 变动 增幅 ± 增速"
ENTITIES = "本集团 本行 本公司 母公司 子公司"
SUMMARIES = "合计 总计 总额 小计 累计 平均"
MARK = "^([0-9]{1,2}[.、．)）]\\s*|\\([0-9]{1,2}\\)\\s*|[（(][0-9]{1,2}[）)]\\s*|[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]\\s*|[（(][一二三四五六七八九十]+[）)]\\s*|[*†‡]{1,3}[\\s　]*|\\[[0-9]{1,2}\\]\\s*)"
TYPE = f"""CASE WHEN s = '' THEN 'empty' WHEN s LIKE '%\\%' ESCAPE '\\' THEN 'percent' WHEN {m('s', CJK)} AND {m('s', '[0-9]')} THEN 'mixed' WHEN {m('s', CJK)} THEN 'label' WHEN NOT {m('s', '[0-9]')} THEN 'mixed'
 WHEN length(regexp_replace(regexp_extract({signed(drop('s', ', 　'))}, '-?[0-9]+\\.?[0-9]*'), '[-.]', '', 'g')) >= 6 THEN 'amount'
 WHEN abs(TRY_CAST(regexp_extract({signed(drop('s', ', 　'))}, '-?[0-9]+\\.?[0-9]*') AS DOUBLE)) < 100 AND contains(regexp_extract({signed(drop('s', ', 　'))}, '-?[0-9]+\\.?[0-9]*'), '.') THEN 'ratio' ELSE 'number' END"""

CELLS = SHEET_SQL + f", c AS (SELECT table_id, row_idx, col_idx, text, {STRIP} AS s FROM cells)"
AT = "table_id, row_idx, col_idx"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return R.of_cells(sheets(spark, d))


LOOSE_REST = "regexp_replace(s, '[,，%万元亿千百人民币港美()（）\\s\\-.·]', '', 'g')"
LOOSE = f"""(s <> '' AND NOT ({m('s', '^(19|20)[0-9]{2}年?$')} OR {m('s', '^(19|20)[0-9]{2}年')} OR {m('s', '^[0-9]{1,3}$')} OR {m('s', '[0-9]{1,2}[/\\-.][0-9]{1,2}[/\\-.]')} OR {m('s', '[0-9]{1,2}月[0-9]{1,2}日')})
 AND {m(LOOSE_REST, '[0-9]')} AND NOT {m(LOOSE_REST, '^[\\x{4e00}-\\x{9fff}]{2,}.*[0-9]')} AND NOT ({cjk_count(LOOSE_REST)} >= 4 AND {cjk_count(LOOSE_REST)} > len(regexp_extract_all({LOOSE_REST}, '[0-9]'))) AND NOT (length(s) > 25 AND {cjk_count(LOOSE_REST)} > 0))"""
SINGLE = m("replace(regexp_replace(trim(regexp_replace(regexp_replace(s, '^%+|%+$', '', 'g'), '^[￥$€]+|[￥$€]+$', '', 'g')), '^[+-]', ''), ',', '')", NUM)


@query(f" SELECT {AT}, {numeric('s')} AS segment, {number_like('s')} AS number_like, {SINGLE} AS single, {LOOSE} AS loose, {m(drop(chr(114) + 'eplace(s, ' + chr(39) + '(' + chr(39) + ', ' + chr(39) + '-' + chr(39) + ')', ',)%‰'), NUM)} AS typed, {plain('s')} AS plain, {m(signed(drop('s', ',% ')), NUM)} AS signed, {plain('s')} AND NOT {m(drop('s', ',% '), '^(19|20)[0-9]{2}$')} AS split FROM c", CELLS)
def number_tests(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    tests = {"segment": T.is_numeric, "number_like": T.is_number_like, "single": T.is_single_number, "loose": T.is_number_loose, "typed": T.is_typed_number, "plain": T.is_plain_number, "signed": T.is_signed_number, "split": T.is_split_number}
    return sheets(spark, d).select("table_id", "row_idx", "col_idx", *(f(t).alias(n) for n, f in tests.items()))


@query(f" SELECT {AT}, {m('s', MARK)} AS marked, regexp_replace(s, '{MARK}', '') AS rest, {words('s', '总额 总计 合计 净额 净收入 净利息 净利 净收益 净值 小计 余额')} AS shared, {cjk_count('s')} AS n_cjk FROM c WHERE col_idx = 0", CELLS)
def note_markers(spark: SparkSession, d: str) -> DataFrame:
    s = T.stripped(F.col("text"))
    return sheets(spark, d).where("col_idx = 0").select("table_id", "row_idx", "col_idx", T.is_marker(s).alias("marked"), T.without_marker(s).alias("rest"), T.is_summary_label(s).alias("shared"), T.cjk_count(s).alias("n_cjk"))


# -- rows
NUMBERED = f"""regexp_matches(substr(t, greatest(pos - 5, 1), pos - greatest(pos - 5, 1)) || substr(t, pos + length(x), 3), '第|号|规则|编报|披露|公告|CIRCULAR|Report|No\\.')"""
ROWS = (
    CELLS
    + f""", f AS (SELECT *, row_number() OVER (PARTITION BY table_id, row_idx, s <> '' ORDER BY col_idx) AS place, {numeric('s')} AS num, {number_like('s')} AS liked, {TYPE} AS kind_of FROM c),
nn AS (SELECT table_id, row_idx, count(*) FILTER (NOT (v BETWEEN 1900 AND 2100) AND NOT (v <= 20 AND {NUMBERED})) AS loose FROM (SELECT *, TRY_CAST(x AS DOUBLE) AS v, strpos(t, x) AS pos FROM (SELECT table_id, row_idx, t, unnest(regexp_extract_all(t, '-?[0-9]+\\.?[0-9]*')) AS x FROM (SELECT table_id, row_idx, CASE WHEN place = 1 AND s <> '' THEN regexp_replace(s, '{MARK}', '') ELSE s END AS t FROM f) a) b) e GROUP BY 1, 2),
r0 AS (SELECT table_id, row_idx, count(*) AS w, count(*) FILTER (s <> '') AS n, string_agg(s, '' ORDER BY col_idx) AS whole, string_agg(text, '' ORDER BY col_idx) AS raw, max(CASE WHEN s <> '' AND place = 1 THEN s END) AS first, max(CASE WHEN col_idx = 0 THEN s END) AS head,
 bool_or({m('text', YEAR)}) AS year, bool_or({words('text', CHANGES)}) AS change, bool_or({m('text', '[0-9][0-9,.]{3,}')}) AS long_number, bool_and(length(text) <= 6) AS short, count(*) FILTER (num) AS nums, count(*) FILTER (liked) AS likes,
 count(*) FILTER (s <> '' AND NOT {m('s', '^[\\s\\-–—]+$')}) AS solid, """
    + " + ".join(f"CAST(bool_or(contains(s, '{w}')) AS INT)" for w in ENTITIES.split())
    + """ AS entities, bool_or(s IN ('本集团', '本行', '本公司', '母公司', '子公司')) AS entity, count(*) FILTER (regexp_matches(s, '(19|20)[0-9]{2}')) AS years, list(s ORDER BY col_idx) AS texts FROM f GROUP BY 1, 2),
r AS (SELECT r0.*, coalesce(loose, 0) AS loose, year AND (change OR (short AND NOT long_number)) AS header_like FROM r0 LEFT JOIN nn USING (table_id, row_idx)),
h AS (SELECT *, header_like OR (w >= 2 AND """
    + words("raw", HEADERS)
    + ") AS header FROM r)"
)
RI = "table_id, row_idx"
KEY = signed(drop("s", ", 　"))
NOTE = f"""(n > 0 AND (({m('first', MARK)} AND loose = 0 AND {cjk_count('whole')} >= 5 AND (length(whole) >= 15 OR (whole LIKE '%。' AND length(whole) >= 8)))
 OR ({m('first', '^(注：|注释：|备注：|说明：|附注：|资料来源：|数据来源：|Source:|Note:|Notes:)')} AND loose <= 1 AND {cjk_count('whole')} >= 5) OR (length(whole) >= 50 AND loose = 0 AND n <= 2 AND {cjk_count('whole')} >= 15)
 OR (n <= 2 AND length(whole) >= 20 AND {cjk_count('whole')} >= 8 AND {m('whole', '[。.）)]$')} AND loose = 0) OR (n <= 2 AND {cjk_count('whole')} >= 15 AND loose <= 2)))"""


@query(f" SELECT {RI}, first AS label, header_like, header, coalesce(entities, 0) >= 2 AS dual_entity, (solid > 0 AND entities < 2 AND likes >= greatest(1, solid // 2)) AS is_data FROM h", ROWS)
def row_kinds(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("texts")
    return _rows(spark, d).select("table_id", "row_idx", R.label(t).alias("label"), R.is_header_like(t).alias("header_like"), R.is_header(t).alias("header"), R.names_two_entities(t).alias("dual_entity"), R.is_data(t).alias("is_data"))


@query(f""" SELECT {RI}, {NOTE} AS is_note, CAST(loose AS INT) AS numbers, (whole <> '' AND {m('whole', '(银行|公司|集团)股份有限公司$|20[0-9]{2}年(度|半年度|年度)?报告|管理层讨论[与和]分析|财务回顾|经营情况讨论与分析|财务报表附注|（除特别注明外|^[0-9]+$')}) AS furniture,
 (n BETWEEN 1 AND 2 AND length(whole) > 40 AND nums = 0) AS paragraph, {m('whole', '单位\\s*[：:]|[Uu]nit:')} AS is_unit, CASE WHEN {m('whole', '单位\\s*[：:]')} THEN regexp_extract(whole, '单位\\s*[：:]\\s*(.+)', 1) END AS unit FROM r""", ROWS)
def row_prose(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("texts")
    return _rows(spark, d).select("table_id", "row_idx", R.is_note(t).alias("is_note"), R.loose_numbers(t).alias("numbers"), R.is_furniture(t).alias("furniture"), R.is_paragraph(t).alias("paragraph"), R.is_unit(t).alias("is_unit"), F.when(R.is_unit(t), R.unit(t)).alias("unit"))


@query(f", k AS (SELECT {RI}, {KEY} AS k, max(col_idx) AS c FROM c WHERE s <> '' GROUP BY 1, 2, 3) SELECT {RI}, string_agg(k, '|' ORDER BY k) AS held, string_agg(k || ':' || c, '|' ORDER BY k) AS places FROM k GROUP BY 1, 2", CELLS)
def row_values(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("texts")
    entries = F.array_sort(F.map_entries(R.value_map(t)))
    out = _rows(spark, d).where(F.size(R.filled(t)) > 0)
    return out.select("table_id", "row_idx", F.array_join(R.value_set(t), "|").alias("held"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), "|").alias("places"))


TERMS = "资产 负债 收入 支出 费用 利润 成本 收益 贷款 存款 投资 利息 总额 净额 减值 拨备 资本 权益 现金 同业 金融 债券 借款 回购 发放 存放 吸收 发行 拆出 拆入 卖出 买入 生息 计息 非生息 非计息"


@query(f""", p AS (SELECT table_id, row_idx, count(*) FILTER (s <> '') AS n, count(*) FILTER (kind_of IN ('amount', 'number', 'percent', 'ratio')) AS num, bool_or(s <> '' AND place = 1 AND kind_of IN ('label', 'mixed') AND {words('s', TERMS)}) AS named,
 count(*) FILTER (s <> '' AND kind_of = CASE place WHEN 1 THEN 'label' WHEN 2 THEN 'amount' WHEN 3 THEN 'number' WHEN 4 THEN 'percent' END) AS fits FROM f GROUP BY 1, 2)
 SELECT {RI}, CAST(CASE WHEN n >= 4 THEN 3 WHEN n >= 3 THEN 2 WHEN n = 2 THEN 1 ELSE 0 END + CASE WHEN num * 1.0 / greatest(n, 1) >= 0.5 THEN 3 WHEN num * 1.0 / greatest(n, 1) >= 0.3 THEN 2 WHEN num > 0 THEN 1 ELSE 0 END + CASE WHEN named THEN 2 ELSE 0 END AS INT) AS score,
 CAST(CASE WHEN n >= 4 THEN 3 WHEN n >= 3 THEN 2 WHEN n = 2 THEN 1 ELSE 0 END + CASE WHEN num * 1.0 / greatest(n, 1) >= 0.5 THEN 3 WHEN num * 1.0 / greatest(n, 1) >= 0.3 THEN 2 WHEN num > 0 THEN 1 ELSE 0 END + CASE WHEN named THEN 2 ELSE 0 END + least(fits, 3) AS INT) AS schema_score FROM p""", ROWS)
def row_scores(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("label", "amount", "number", "percent")))
    return _rows(spark, d).select("table_id", "row_idx", R.score(F.col("texts")).alias("score"), R.score(F.col("texts"), kinds).alias("schema_score"))


# -- tables
CHART = f""", ax AS (SELECT table_id, row_idx, TRY_CAST({drop('s', ', ()')} AS DOUBLE) AS v FROM (SELECT *, row_number() OVER (PARTITION BY table_id, row_idx ORDER BY col_idx) AS o FROM c WHERE {m(drop('s', ', ()'), NUM)}) x WHERE o = 1),
st AS (SELECT *, v - lag(v) OVER (PARTITION BY table_id ORDER BY row_idx) AS step FROM ax),
sx AS (SELECT table_id, count(*) AS n, min(step) AS lo, max(step) AS hi, avg(abs(step)) AS mean, stddev_pop(abs(step)) AS sd FROM st GROUP BY 1),
tick AS (SELECT table_id, n >= 3 AND (lo > 0 OR hi < 0) AND (len(list_filter([1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 100000, 1000000], lambda q: abs(mean - q) / q < 0.05)) > 0 OR sd / mean < 0.15) AS t FROM sx),
e AS (SELECT table_id, row_idx, count(*) AS w, count(*) FILTER (s <> '') AS n, count(*) FILTER (s LIKE '%\\%' ESCAPE '\\') AS pc, bool_and(s = '' OR {m('s', '^[\\x{4e00}-\\x{9fff}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}]{1,2}$')}) AS sc, count(*) FILTER (s <> '' AND {plain('s')}) AS num, count(*) FILTER (NOT {plain('s')} AND {m('s', CJK)}) AS lab, max(CASE WHEN col_idx = 0 THEN nullif(s, '') END) AS hd, bool_or({m('s', CJK)}) AS cj,
 bool_or({words('s', '合计 总计 总额 小计 项目 指标 单位 万元 千元 百万元')}) AS wd, bool_or({m('s', YEAR)}) AS yr, bool_or({cjk_count('s')} >= 4) AS lg FROM c GROUP BY 1, 2),
a AS (SELECT table_id, count(*) AS n, max(w) AS w, sum(w) AS cells, sum(n) AS held, sum(pc) AS pc, count(*) FILTER (n BETWEEN 1 AND 5 AND sc) AS sc, count(*) FILTER (num > 0 AND lab = 0) AS numo, count(*) FILTER (lab > 0) AS lab, count(hd) AS hd, count(*) FILTER (hd IS NOT NULL AND {plain('hd')}) AS nhd,
 bool_or(row_idx = 0 AND cj AND w >= 3) AS wh, count(*) FILTER (n <= 2) AS nar, bool_or(wd) AS wd, bool_or(yr) AS yr, bool_or(lg) AS lg FROM e GROUP BY 1),
sg AS (SELECT a.table_id, a.n, a.held, coalesce(t, false) AS axis_ticks, sc >= greatest(3.0, a.n * 0.6) AS single_chars, numo * 1.0 / a.n > 0.8 AND lab <= 1 AS isolated_numbers, (hd < 2 OR nhd >= hd * 0.7 OR hd * 1.0 / a.n < 0.3) AS no_labels,
 ((w <= 3 AND pc * 1.0 / cells > 0.4) OR (w <= 1 AND pc >= 3)) AS pie, a.n >= 3 AND NOT wh AND nar >= a.n * 0.7 AS waterfall, w >= 3 AND a.n >= 3 AND nar >= a.n * 0.6 AS sparse, CASE WHEN a.n < 3 THEN 0 ELSE wd::INT + yr::INT + lg::INT + (w >= 4 AND held * 1.0 / a.n >= 3)::INT END AS traits FROM a LEFT JOIN tick USING (table_id)),
so AS (SELECT *, axis_ticks::INT * 3 + single_chars::INT * 3 + isolated_numbers::INT * 2 + no_labels::INT * 2 + pie::INT * 2 + waterfall::INT + sparse::INT * 2 - CASE WHEN traits >= 3 THEN 2 WHEN traits >= 1 THEN 1 ELSE 0 END AS score FROM sg)
SELECT table_id, axis_ticks, single_chars, isolated_numbers, no_labels, pie, waterfall, sparse, CAST(traits AS INT) AS traits, CAST(score AS INT) AS score, CASE WHEN n < 2 THEN false WHEN held = 0 THEN true ELSE score >= 2 END AS chart_like FROM so"""


@query(CHART, CELLS)
def chart_signals(spark: SparkSession, d: str) -> DataFrame:
    return Q.chart_signals(_rows(spark, d))


@query(f""", col AS (SELECT table_id, col_idx, count(*) FILTER (row_idx >= 2 AND s <> '') AS held, count(*) FILTER (row_idx >= 2 AND s <> '' AND {plain('s')}) AS num, count(*) FILTER (s <> '') AS al, count(*) FILTER (s <> '' AND {m(signed(drop('s', ',% ')), NUM)}) AS sg, max(row_idx) + 1 AS n FROM c GROUP BY 1, 2),
 t AS (SELECT table_id, max(n) AS n_rows, coalesce(max(CASE WHEN held > 0 THEN num * 1.0 / held END), 0) >= 0.5 AND count(*) >= 2 OR coalesce(sum(sg) * 1.0 / nullif(sum(al), 0), 0) >= 0.15 AS num FROM col GROUP BY 1)
 SELECT table_id, n_rows, n_rows >= 2 AND num AS is_real_table, CASE WHEN n_rows < 2 THEN '行数不足' WHEN NOT num THEN '纯文本数据，无数值列' END AS quality_reason FROM t""", CELLS)
def numeric_marks(spark: SparkSession, d: str) -> DataFrame:
    return Q.numeric_marks(_rows(spark, d))


QUALITY = """, h1 AS (SELECT *, count(*) OVER t AS nr, greatest(2, least(6, count(*) OVER t // 4)) AS lim FROM h WINDOW t AS (PARTITION BY table_id)),
h2 AS (SELECT *, header AND row_idx < lim AS hd FROM h1),
h3 AS (SELECT table_id, max(nr) AS nr, bool_or(hd) AS has_header, CASE WHEN bool_or(hd) THEN greatest(1, least(coalesce(min(CASE WHEN row_idx >= 1 AND NOT hd THEN row_idx END), max(nr)), max(lim), max(nr))) ELSE 1 END AS skip FROM h2 GROUP BY 1),
cc AS (SELECT table_id, col_idx, max(nr) AS nr, bool_or(has_header) AS has_header, max(skip) AS skip, count(*) FILTER (s <> '' AND row_idx >= skip) AS held, count(*) FILTER (num AND row_idx >= skip) AS num, count(*) FILTER (s <> '' AND row_idx >= 1) AS held1, count(*) FILTER (num AND row_idx >= 1) AS num1, bool_or(contains(text, '目录') AND row_idx < 3) AS toc FROM f JOIN h3 USING (table_id) GROUP BY 1, 2),
q0 AS (SELECT table_id, max(nr) AS row_count, bool_or(has_header) AS has_header, max(skip) AS skip, count(*) AS col_count, count(*) FILTER (held > 0 AND num * 2 >= held AND num >= CASE WHEN nr - skip <= 2 THEN 1 ELSE 2 END) AS g0, count(*) FILTER (num1 >= 1 AND num1 * 1.0 / held1 >= 0.3) AS again, bool_or(toc) AS toc FROM cc GROUP BY 1),
q1 AS (SELECT *, CASE WHEN col_count >= 2 THEN g0 ELSE 0 END AS good FROM q0),
q2 AS (SELECT *, good > 0 AND col_count >= 2 AND row_count >= 3 AS rl, has_header AND row_count >= 3 AS is_complete FROM q1),
q3 AS (SELECT *, NOT rl AND NOT toc AND good = 0 AND has_header AND skip > 1 AND col_count >= 2 AND again > 0 AS sec FROM q2),
q AS (SELECT table_id, has_header, (good > 0 OR sec) AS has_numeric_data, CASE WHEN sec THEN again ELSE good END AS numeric_col_count, row_count, col_count, (rl OR sec) AS is_real_table, is_complete, CASE WHEN rl AND is_complete THEN '财务数据表' WHEN rl THEN '数据表(缺表头)' WHEN toc THEN '目录' WHEN sec THEN '非标准表格' WHEN good = 0 THEN '文本列表' ELSE '非标准表格' END AS table_category FROM q3)"""


@query(QUALITY + " SELECT * FROM q", ROWS)
def table_quality(spark: SparkSession, d: str) -> DataFrame:
    return Q.table_quality(_rows(spark, d))


CONFIDENCE = """, fc AS (SELECT *, round(CASE WHEN is_real_table THEN least(0.55 + least(numeric_col_count * 1.0 / col_count, 1.0) * 0.2 + CASE WHEN has_header THEN 0.12 ELSE 0 END + CASE WHEN row_count > 3 THEN least((row_count - 3) / 12.0, 1.0) * 0.08 ELSE 0 END, 1.0)
 ELSE least(CASE table_category WHEN '目录' THEN 0.03 WHEN '文本列表' THEN 0.08 WHEN '非标准表格' THEN 0.15 + least(numeric_col_count * 1.0 / col_count, 1.0) * 0.25 ELSE 0.02 END, 0.45) END::DOUBLE, 3) AS financial_confidence FROM q)"""


@query(QUALITY + CONFIDENCE + " SELECT * FROM fc", ROWS)
def financial_confidence(spark: SparkSession, d: str) -> DataFrame:
    return Q.financial_confidence(Q.table_quality(_rows(spark, d)))


DECISION = f""", rs AS (SELECT table_id, count(*) FILTER (whole <> '' AND {m('whole', '(银行|公司|集团)股份有限公司$|20[0-9]{2}年(度|半年度|年度)?报告|管理层讨论[与和]分析|财务回顾|经营情况讨论与分析|财务报表附注|（除特别注明外|^[0-9]+$')}) * 1.0::DOUBLE / count(*) AS fu, count(*) FILTER (n BETWEEN 1 AND 2 AND length(whole) > 40 AND nums = 0) * 1.0::DOUBLE / count(*) AS pa,
 count(*) AS nr, count(*) FILTER (w >= 2) AS va, count(*) FILTER (w >= 2 AND texts[1] LIKE '%\\%' ESCAPE '\\') AS pc, count(*) FILTER (w >= 2 AND length(texts[2]) <= 8 AND {m('texts[2]', CJK)}) AS sh FROM r GROUP BY 1),
dj AS (SELECT *, nr >= 2 AND NOT has_header AND va >= 3 AND pc >= va * 0.5 AND sh >= va * 0.5 AS ch, CASE WHEN fu > 0 THEN ['page_header_footer_noise'] ELSE [] END AS nz FROM fc JOIN rs USING (table_id)),
dd AS (SELECT table_id, financial_confidence AS fcv, CASE WHEN table_category IN ('文本列表', '目录', '空表') THEN {{'d': 'rejected', 'r': '非财务表类型: ' || table_category, 's': 0.0::DOUBLE, 'f': []::VARCHAR[]}}
 WHEN NOT is_real_table THEN {{'d': 'rejected', 'r': '缺少稳定数值列', 's': financial_confidence, 'f': ['no_real_table']}}
 WHEN fu > 0.3 THEN {{'d': 'rejected', 'r': '页眉页脚占比过高 (' || round_even(fu * 100, 0)::INT || '%)', 's': financial_confidence, 'f': ['page_header_footer_noise']}}
 WHEN pa > 0.4 THEN {{'d': 'rejected', 'r': '段落文本占比过高 (' || round_even(pa * 100, 0)::INT || '%)', 's': financial_confidence, 'f': ['paragraph_noise']}}
 WHEN ch THEN {{'d': 'rejected', 'r': '图表标签区域，不是结构化表格', 's': financial_confidence, 'f': ['chart_label']}}
 WHEN table_category = '数据表(缺表头)' AND financial_confidence >= 0.75 AND row_count >= 6 AND col_count >= 4 THEN {{'d': 'review', 'r': '疑似续表或缺表头，需要人工确认', 's': financial_confidence, 'f': list_concat(nz, ['no_header'])}}
 WHEN table_category = '数据表(缺表头)' THEN {{'d': 'rejected', 'r': '缺表头且结构弱', 's': financial_confidence, 'f': list_concat(nz, ['no_header_weak'])}}
 WHEN table_category = '财务数据表' AND financial_confidence >= 0.75 THEN {{'d': 'accepted', 'r': '高可信财务数据表', 's': financial_confidence, 'f': nz}}
 WHEN financial_confidence >= 0.55 THEN {{'d': 'review', 'r': '中等置信度财务候选', 's': financial_confidence, 'f': nz}} ELSE {{'d': 'rejected', 'r': '置信度过低', 's': financial_confidence, 'f': nz}} END AS x FROM dj)
SELECT table_id, x.d AS decision, x.r AS reason, x.s AS score, array_to_string(x.f, '|') AS flags FROM dd"""


@query(QUALITY + CONFIDENCE + DECISION, ROWS)
def acceptance(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return Q.acceptance(rows, Q.financial_confidence(Q.table_quality(rows))).withColumn("flags", F.array_join("flags", "|"))


SHORT = SHEET_SQL.replace(", cells AS (", ", all_cells AS (") + ", cells AS (SELECT * FROM all_cells WHERE row_idx <= table_id % 4)"


def _short(spark: SparkSession, d: str) -> DataFrame:
    return R.of_cells(sheets(spark, d).where("row_idx <= table_id % 4"))


@query(f""", c AS (SELECT *, {STRIP} AS s FROM cells), t AS (SELECT table_id, max(row_idx) + 1 AS n, count(*) FILTER (s <> '') AS held, count(*) FILTER ({m(drop('s', ',%().\\-'), '^[0-9]+$')}) AS num, string_agg(s, '' ORDER BY row_idx, col_idx) AS whole FROM c GROUP BY 1)
 SELECT table_id, n <= 3 AND ({words('whole', '年度报告 年报 股份有限公司 有限公司 目录')} OR ({cjk_count('whole')} > 10 AND n <= 2) OR {m('whole', '^[0-9]{1,3}$')} OR NOT (held > 0 AND num * 1.0 / greatest(held, 1) >= 0.1)) AS page_header FROM t""", SHORT)
def header_fragments(spark: SparkSession, d: str) -> DataFrame:
    return Q.header_fragments(_short(spark, d))


BOUNDARY = f""", lb AS (SELECT table_id, row_idx, bool_or(NOT regexp_matches(s, '^[0-9,.\\-()（）%]*$')) AS labelled, bool_or(col_idx > 0 AND regexp_matches(s, '^[0-9,.\\-()（）%]*$')) AS tailnum FROM c GROUP BY 1, 2),
b0 AS (SELECT h.*, labelled, tailnum, count(*) OVER t AS nr, min(CASE WHEN nums >= greatest(1, n // 2) AND nums >= 2 THEN row_idx END) OVER t AS stop, {words('raw', SUMMARIES)} AS su, header_like AND row_idx >= 1 AS hl FROM h JOIN lb USING (table_id, row_idx) WINDOW t AS (PARTITION BY table_id)),
b1 AS (SELECT *, row_idx < 8 AND row_idx <= coalesce(stop, 8) AND n > 0 AS sc, CASE WHEN su THEN row_idx - max(CASE WHEN su THEN row_idx END) OVER p END AS sg, CASE WHEN hl THEN row_idx - max(CASE WHEN hl THEN row_idx END) OVER p END AS hg FROM b0 WINDOW p AS (PARTITION BY table_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT table_id, max(w) AS n_cols, bool_or(row_idx = 0 AND labelled) AS has_header, bool_or(row_idx = nr - 1 AND nr >= 2 AND NOT {words('head', '合计 总计 总额 小计')} AND tailnum) AS ends_with_data, bool_or(row_idx = nr - 1 AND NOT su) AS no_summary_at_end,
 bool_or(sc AND ({words('whole', '（续） (续) 附注 注释')} OR (nums = 0 AND {cjk_count('whole')} >= 6))) OR (bool_or(sc AND years >= 2) AND bool_or(sc AND entity)) AS complete_header,
 max(nr) >= 5 AND ((count(*) FILTER (n <= 1) >= 2 AND count(*) FILTER (n <= 1 AND row_idx > 1 AND row_idx < nr - 2) > 0) OR coalesce(max(sg), 0) > 2 OR coalesce(max(hg), 0) > 3 OR (max(w) >= 6 AND count(*) FILTER (su) >= 1)) AS sub_tables FROM b1 GROUP BY 1)"""


@query(BOUNDARY + " SELECT * FROM b", ROWS)
def boundary_features(spark: SparkSession, d: str) -> DataFrame:
    return Q.boundary_features(_rows(spark, d))


BODY = f""", y0 AS (SELECT *, count(*) OVER (PARTITION BY table_id) AS nr, likes >= 2 AND lag(likes) OVER (PARTITION BY table_id ORDER BY row_idx) >= 2 AS pr FROM r),
y1 AS (SELECT *, coalesce(min(CASE WHEN pr THEN row_idx - 1 END) OVER (PARTITION BY table_id), 0) AS fd FROM y0),
y2 AS (SELECT *, CASE WHEN fd = 0 AND nr > 2 THEN least(2, nr - 1) ELSE fd END AS st FROM y1),
y3 AS (SELECT *, bool_or(likes >= 1) OVER (PARTITION BY table_id) AS so FROM y2 WHERE row_idx >= st), y4 AS (SELECT *, max(n) OVER (PARTITION BY table_id) AS typical FROM y3 WHERE likes >= 1 OR NOT so),
y5 AS (SELECT f.table_id, typical, col_idx, count(*) FILTER (liked) * 1.0 / count(*) AS ratio FROM f JOIN y4 ON y4.table_id = f.table_id AND y4.row_idx = f.row_idx WHERE typical >= 2 AND col_idx < typical AND f.s <> '' GROUP BY 1, 2, 3),
sig AS (SELECT table_id, typical, list(coalesce(ratio, 0) ORDER BY i) AS ratios FROM (SELECT DISTINCT table_id, typical FROM y5) u, unnest(range(typical)) z(i) LEFT JOIN (SELECT table_id AS tt, col_idx, ratio FROM y5) v ON v.tt = u.table_id AND v.col_idx = i GROUP BY 1, 2)"""


@query(BODY + " SELECT table_id, CAST(typical AS INT) AS typical, array_to_string(list_transform(ratios, lambda q: CAST(round(q * 1000) AS INT) || ''), '|') AS ratios FROM sig", ROWS)
def body_signature(spark: SparkSession, d: str) -> DataFrame:
    out = Q.body_signature(_rows(spark, d))
    return out.select("table_id", "typical", F.array_join(F.transform("ratios", lambda r: F.round(r * 1000).cast("int").cast("string")), "|").alias("ratios"))


MATCH = BODY + f""", pt AS (SELECT f.table_id, f.row_idx, count(*) AS cmp, sum(CASE WHEN liked = (ratios[col_idx + 1] >= 0.5) THEN 1.0 WHEN ratios[col_idx + 1] >= 0.5 THEN CASE WHEN {words('s', SUMMARIES)} THEN 1.0 ELSE 0.0 END ELSE 0.5 END) AS pts FROM f JOIN sig USING (table_id) WHERE col_idx < typical AND s <> '' GROUP BY 1, 2),
mt AS (SELECT r.*, typical IS NOT NULL AS body, CASE WHEN typical IS NULL OR abs(n - typical) > 3 THEN 0.0 ELSE (CASE abs(n - typical) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 ELSE 0.2 END * 0.3 + coalesce(pts::DOUBLE / cmp, 0.5) * 0.7) * CASE WHEN typical >= 4 AND coalesce(cmp, 0) <= 1 THEN 0.5 ELSE 1 END END::DOUBLE AS match FROM r LEFT JOIN sig USING (table_id) LEFT JOIN pt USING (table_id, row_idx))"""


@query(MATCH + " SELECT table_id, row_idx, round(match, 4) AS match FROM mt", ROWS)
def body_match(spark: SparkSession, d: str) -> DataFrame:
    return Q.matched_rows(_rows(spark, d)).select("table_id", "row_idx", F.round("match", 4).alias("match"))


BEGINS = f""", bg AS (SELECT f.table_id, f.row_idx, bool_or({m('s', YEAR)} OR {words('s', CHANGES)} OR {words('s', HEADERS)}) AS wd, bool_and(s = '' OR (length(s) <= 10 AND NOT liked)) AS sh FROM f GROUP BY 1, 2),
ts AS (SELECT table_id, count(*) AS nr, CASE WHEN count(*) >= 2 THEN coalesce(min(CASE WHEN n > 0 AND ((n >= 2 AND wd) OR (n >= 3 AND sh) OR entities >= 2 OR (body AND match >= 0.55)) THEN row_idx END), 0) ELSE 0 END AS first_row FROM mt JOIN bg USING (table_id, row_idx) GROUP BY 1)"""


@query(MATCH + BEGINS + " SELECT r.table_id, CAST(r.row_idx - CASE WHEN first_row > 0 AND nr - first_row >= 2 THEN first_row ELSE 0 END AS INT) AS row_idx, array_to_string(r.texts, '|') AS line FROM r JOIN ts USING (table_id) WHERE r.row_idx >= CASE WHEN first_row > 0 AND nr - first_row >= 2 THEN first_row ELSE 0 END", ROWS)
def strip_lead(spark: SparkSession, d: str) -> DataFrame:
    return Q.without_lead(_rows(spark, d)).select("table_id", "row_idx", F.array_join(F.transform("texts", T.stripped), "|").alias("line"))


def _tail(goes: str, source: str) -> str:
    return f""", tg AS (SELECT *, {goes} AS goes FROM {source}), tc AS (SELECT table_id, count(*) AS nr, coalesce(max(CASE WHEN NOT goes THEN row_idx END), -1) AS st FROM tg GROUP BY 1)
 SELECT tg.table_id, row_idx, array_to_string(texts, '|') AS line FROM tg JOIN tc USING (table_id) WHERE row_idx < nr - CASE WHEN nr >= 4 THEN least(nr - 1 - st, greatest(0, nr - 3)) ELSE 0 END"""


@query(_tail(f"(n = 0 OR {NOTE} OR (length(whole) <= 20 AND NOT {m('whole', '[0-9]')} AND NOT {words('whole', SUMMARIES)}))", "r"), ROWS)
def strip_tail_notes(spark: SparkSession, d: str) -> DataFrame:
    return Q.without_tail_notes(_rows(spark, d)).select("table_id", "row_idx", F.array_join(F.transform("texts", T.stripped), "|").alias("line"))


@query(MATCH + f", lt AS (SELECT table_id, row_idx, bool_or(liked AND place > 1) AS ln FROM f GROUP BY 1, 2), mx AS (SELECT * FROM mt JOIN lt USING (table_id, row_idx))" + _tail(f"(body AND (n = 0 OR (NOT {words('whole', SUMMARIES)} AND (NOT ln OR match < 0.55))))", "mx"), ROWS)
def strip_tail_prose(spark: SparkSession, d: str) -> DataFrame:
    return Q.without_tail_prose(_rows(spark, d)).select("table_id", "row_idx", F.array_join(F.transform("texts", T.stripped), "|").alias("line"))


@query(""", t0 AS (SELECT table_id, s, min(row_idx * 1000 + col_idx) AS pos FROM c WHERE s <> '' GROUP BY 1, 2), t1 AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY pos) AS o FROM t0),
 t2 AS (SELECT table_id, arg_min(s, pos) FILTER (length(s) >= 4) AS lg, string_agg(s, '-' ORDER BY pos) FILTER (o <= 3) AS sh FROM t1 GROUP BY 1)
 SELECT table_id, coalesce(replace(replace(replace(substr(lg, 1, 12), '/', '-'), '\\', '-'), '*', ''), substr(sh, 1, 20), '表格') AS title FROM (SELECT DISTINCT table_id FROM c) u LEFT JOIN t2 USING (table_id)""", CELLS)
def table_titles(spark: SparkSession, d: str) -> DataFrame:
    return Q.titles(_rows(spark, d))


FILTERED = f""", x AS (SELECT table_id, row_idx, count(*) FILTER ({m('s', '[0-9]')}) AS dg, count(*) FILTER (s <> '') AS held, count(*) FILTER ({m('s', '^[\\x{4e00}-\\x{9fff}]$')}) AS sg, count(*) FILTER ({m(drop('s', ', '), NUM)}) AS nu FROM c GROUP BY 1, 2),
a AS (SELECT table_id, count(*) AS n, sum(dg) AS dg, sum(held) AS held, sum(sg) AS sg, count(*) FILTER (nu BETWEEN 1 AND 2) AS nar FROM x GROUP BY 1),
v AS (SELECT table_id, abs(v - lag(v) OVER (PARTITION BY table_id ORDER BY row_idx, col_idx)) AS st FROM (SELECT table_id, row_idx, col_idx, TRY_CAST(replace(s, ',', '') AS DOUBLE) AS v FROM c WHERE regexp_matches(replace(s, ',', ''), '{NUM}')) z),
e AS (SELECT table_id, count(*) AS nv, avg(st) AS mean, stddev_pop(st) AS sd FROM v GROUP BY 1),
tb AS (SELECT table_id % 10 AS doc_id, table_id, CAST(table_id // 40 AS INT) AS page FROM a), fp AS (SELECT *, coalesce(lag(page) OVER (PARTITION BY doc_id ORDER BY table_id) <> page, true) AS fst FROM tb)
SELECT fp.doc_id, fp.table_id, page FROM fp JOIN a USING (table_id) LEFT JOIN e USING (table_id) WHERE CASE WHEN n < 2 THEN fst AND dg >= 2 ELSE dg > 0 END AND NOT coalesce(n >= 2 AND (held = 0 OR (sg >= 3 AND sg >= held * 0.5) OR (nar >= n * 0.8 AND n >= 3 AND nv >= 3 AND mean > 0 AND sd / mean < 0.2)), false)"""


@query(FILTERED, SHORT + f", c AS (SELECT *, {STRIP} AS s FROM cells)")
def filter_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = _short(spark, d)
    tables = rows.select("table_id").distinct().select((F.col("table_id") % 10).alias("doc_id"), "table_id", F.expr("cast(table_id div 40 as int)").alias("page"))
    return Q.filtered_tables(tables, rows)


@query(f""", k AS (SELECT *, lag(texts) OVER (PARTITION BY table_id ORDER BY row_idx) AS above FROM r),
 l AS (SELECT table_id, row_idx, list_transform(texts, lambda t: regexp_replace(regexp_replace(regexp_replace(t, '[, 　]', '', 'g'), '^\\((.*)\\)$', '-\\1'), '[¹²³⁰-⁹]', '', 'g')) AS b, list_transform(above, lambda t: regexp_replace(regexp_replace(regexp_replace(t, '[, 　]', '', 'g'), '^\\((.*)\\)$', '-\\1'), '[¹²³⁰-⁹]', '', 'g')) AS a FROM k WHERE above IS NOT NULL),
 s AS (SELECT table_id, row_idx, list_filter(a, lambda t: t <> '')[1] AS la, list_filter(b, lambda t: t <> '')[1] AS lb, list_distinct(list_filter(a[2:], lambda t: t <> '')) AS va, list_distinct(list_filter(b[2:], lambda t: t <> '')) AS vb FROM l),
 j AS (SELECT *, CASE WHEN la = lb THEN 1.0 WHEN contains(la, lb) OR contains(lb, la) THEN 0.8 ELSE 0.0 END AS lm, len(list_intersect(va, vb)) AS cm FROM s)
 SELECT table_id, row_idx, round(coalesce(CASE WHEN la IS NULL OR lb IS NULL THEN 0.0 WHEN lm = 0 THEN 0.0 WHEN len(va) = 0 OR len(vb) = 0 THEN lm ELSE 0.4 * lm + 0.6 * cm / (len(va) + len(vb) - cm) END, 0.0)::DOUBLE, 6) AS likeness FROM j""", ROWS)
def row_similarity(spark: SparkSession, d: str) -> DataFrame:
    out = _rows(spark, d).withColumn("above", F.lag("texts").over(Q.by_row())).where("above is not null")
    return out.select("table_id", "row_idx", F.round(R.similarity(F.col("above"), F.col("texts")), 6).alias("likeness"))


@query(QUALITY + """, qq AS (SELECT table_id, has_header, good > 0 AS has_numeric_data, good AS numeric_col_count, row_count, col_count, rl AS is_real_table, is_complete, CASE WHEN rl AND is_complete THEN '财务数据表' WHEN rl THEN '数据表(缺表头)' WHEN toc THEN '目录' WHEN good = 0 THEN '文本列表' ELSE '非标准表格' END AS table_category FROM q2) SELECT * FROM qq""", ROWS)
def table_quality_again(spark: SparkSession, d: str) -> DataFrame:
    return Q.table_quality(_rows(spark, d), fallback=False)


@query(", dt AS (SELECT *, solid > 0 AND entities < 2 AND likes >= greatest(1, solid // 2) AS is_data FROM h) SELECT table_id, row_idx, count(*) FILTER (is_data) OVER (PARTITION BY table_id ORDER BY row_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS data_before, count(*) FILTER (is_data) OVER (PARTITION BY table_id ORDER BY row_idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS data_after FROM dt", ROWS)
def nearby_data(spark: SparkSession, d: str) -> DataFrame:
    return Q.nearby_data(_rows(spark, d))


@query(f" SELECT table_id, row_idx, count(*) FILTER ({m(signed(drop('s', ',%')), '^-?[0-9]+' + chr(92) + '.?[0-9]*$')}) >= greatest(1.0, count(*) * 0.3) AS has_numbers FROM c GROUP BY 1, 2", CELLS)
def rows_with_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("table_id", "row_idx", R.has_numbers(F.col("texts")).alias("has_numbers"))
