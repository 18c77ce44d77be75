"""Queries of merging decisions, page assignment and lists of tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lists as I
from ..operators import merging as M
from ..operators import quality as Q
from ..operators import rows as R
from ..sources import sinks as S
from ..sources.derived import SHEET_SQL, sheets
from .queries import query
from .sheet_queries import BOUNDARY, CELLS, CJK, ROWS, STRIP, m, words

#: One list of tables: the columns of the view and their expressions, the same in both engines.
COLUMNS = {
    "doc_id": "o_custkey % 40", "table_id": "o_orderkey", "page": "CAST(floor(o_orderkey / 120.0) AS INT) + 1", "parse_status": "CASE o_orderkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'failed' ELSE 'success' END",
    "table_category": "CASE o_orderkey % 7 WHEN 0 THEN '财务数据表' WHEN 1 THEN '数据表(缺表头)' WHEN 2 THEN '文本列表' WHEN 3 THEN '目录' WHEN 4 THEN '非标准表格' WHEN 5 THEN '财务数据表' ELSE '空表' END",
    "manual_mark": "CASE o_custkey % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'non_table' ELSE '' END", "n_cols": "CAST(o_orderkey * 3 % 8 AS INT)", "has_header": "o_orderkey % 3 = 0", "ends_with_data": "o_orderkey % 4 <> 0",
    "n_regions": "CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 END", "shares_region": "o_orderkey % 2 = 0", "context_lines": "CAST(o_custkey % 3 AS INT)", "decision": "CASE o_orderkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'review' ELSE 'rejected' END",
    "caption": "CASE o_orderkey % 4 WHEN 0 THEN '单位：万元' WHEN 1 THEN '资产: 表/一' WHEN 2 THEN '' END", "confidence": "CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'unresolvable' END", "score": "CAST(o_orderkey * 37 % 101 AS DOUBLE)",
}
LIST = "WITH RECURSIVE t AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + " FROM orders)"
DOC = "PARTITION BY doc_id ORDER BY table_id"


def _list(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(*(F.expr(e).alias(n) for n, e in COLUMNS.items()))


SPLITS = f""", b AS (SELECT *, lag(table_id) OVER w AS aft, lag(page) OVER w AS pp, lag(n_cols) OVER w AS pc, lag(ends_with_data) OVER w AS pe FROM t WINDOW w AS ({DOC})),
 v AS (SELECT doc_id, table_id, aft AS after, CASE WHEN n_cols > 0 AND pc > 0 AND abs(n_cols - pc) <= 2 THEN CASE WHEN pp = page AND n_regions IS NOT NULL THEN CASE WHEN n_regions = 1 OR (n_regions >= 2 AND shares_region) THEN CASE WHEN n_cols = pc AND NOT has_header THEN 'confident' WHEN n_cols = pc THEN 'same_cols_no_header' WHEN NOT has_header THEN 'col_diff' END END
 WHEN NOT ((pp <> page AND context_lines >= 1) OR context_lines >= 2 OR (pp <> page AND (page <> pp + 1 OR NOT pe))) THEN CASE WHEN n_cols = pc AND NOT has_header THEN 'confident' WHEN n_cols = pc THEN 'same_cols_with_header' WHEN NOT has_header THEN 'col_diff' END END END AS verdict FROM b WHERE aft IS NOT NULL), sp AS (SELECT * FROM v WHERE verdict IS NOT NULL)"""


@query(SPLITS + " SELECT * FROM sp", LIST)
def adjacent_splits(spark: SparkSession, d: str) -> DataFrame:
    return M.adjacent_splits(_list(spark, d))


@query(SPLITS + ", pr AS (SELECT * FROM sp WHERE verdict <> 'same_cols_with_header'), ch AS (SELECT *, sum(CASE WHEN after = pv THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY table_id) AS run FROM (SELECT *, lag(table_id) OVER (PARTITION BY doc_id ORDER BY table_id) AS pv FROM pr) x), pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY table_id) AS k FROM ch) SELECT doc_id, table_id, after FROM pl WHERE k % 2 = 1", LIST)
def kept_merges(spark: SparkSession, d: str) -> DataFrame:
    return M.kept_merges(M.adjacent_splits(_list(spark, d)).where("verdict <> 'same_cols_with_header'"))


@query(BOUNDARY + f""", fr AS (SELECT table_id, raw, w, header_like FROM h WHERE row_idx = 0), tb AS (SELECT b.*, raw, w, header_like, table_id % 40 AS doc_id, CAST(floor(table_id / 40.0) AS INT) % 1000000 AS page FROM b JOIN fr USING (table_id)),
 lg AS (SELECT *, lag(page) OVER q AS pp, lag(n_cols) OVER q AS pc, lag(no_summary_at_end) OVER q AS pn, lag(sub_tables) OVER q AS ps FROM tb WINDOW q AS (PARTITION BY doc_id ORDER BY table_id)),
 jn AS (SELECT *, coalesce(page = pp + 1 AND n_cols > 0 AND pc > 0 AND abs(n_cols - pc) <= 2 AND NOT complete_header AND CASE WHEN length(raw) = 0 THEN pn ELSE NOT (len(regexp_extract_all(raw, '{CJK}')) * 1.0 / length(raw) >= 0.4 AND w >= 2 AND header_like) AND (pn OR ps) END, false) AS jo FROM lg)
 SELECT doc_id, table_id, max(CASE WHEN NOT jo THEN table_id END) OVER (PARTITION BY doc_id ORDER BY table_id) AS head FROM jn""", ROWS)
def cross_page_chains(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    first = rows.where("row_idx = 0").select("table_id", F.col("texts").alias("first_row"))
    tables = Q.boundary_features(rows).join(first, "table_id").withColumns({"doc_id": F.col("table_id") % 40, "page": F.expr("CAST(floor(table_id / 40.0) AS INT) % 1000000")})
    return M.cross_page_chains(tables).select("doc_id", "table_id", "head")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return R.of_cells(sheets(spark, d))


@query(" SELECT doc_id, table_id, " + words("coalesce(caption, '')", "截至 截止 单位： Unit: 万元 千元 百万元 财务数据 经营业绩 主要指标 资产负债表 利润表 现金流量") + " AS states_range FROM t", LIST)
def caption_ranges(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d).select("doc_id", "table_id", M.states_range(F.col("caption")).alias("states_range"))


NORM = "regexp_replace(regexp_replace(regexp_replace(t, '[, 　]', '', 'g'), '^\\((.*)\\)$', '-\\1'), '[¹²³⁰-⁹]', '', 'g')"


def _sim(a: str, b: str) -> str:
    la, lb = f"list_filter({a}, lambda t: t <> '')[1]", f"list_filter({b}, lambda t: t <> '')[1]"
    va, vb = f"list_distinct(list_filter({a}[2:], lambda t: t <> ''))", f"list_distinct(list_filter({b}[2:], lambda t: t <> ''))"
    lm = f"(CASE WHEN {la} = {lb} THEN 1.0 WHEN contains({la}, {lb}) OR contains({lb}, {la}) THEN 0.8 ELSE 0.0 END)"
    return f"coalesce(CASE WHEN {la} IS NULL OR {lb} IS NULL OR {lm} = 0 THEN 0.0 WHEN len({va}) = 0 OR len({vb}) = 0 THEN {lm} ELSE 0.4 * {lm} + 0.6 * len(list_intersect({va}, {vb})) / (len({va}) + len({vb}) - len(list_intersect({va}, {vb}))) END, 0.0)"


REPEATS = f""", x AS (SELECT table_id, row_idx, texts, list_transform(texts, lambda t: {NORM}) AS nt, n FROM r),
 hd AS (SELECT table_id, row_idx, bool_or({m('text', '(^|[^0-9A-Za-z_\\x{4e00}-\\x{9fff}])(19|20)[0-9]{2}年?($|[^0-9A-Za-z_\\x{4e00}-\\x{9fff}])')}) OR bool_or({m('text', '变化|增减|变动|±')}) OR (bool_or(s <> '') AND bool_and(length(s) <= 6) AND bool_or(s <> '' AND {m('s', '[0-9]')})) AS head FROM c GROUP BY 1, 2),
 kp AS (SELECT x.*, row_number() OVER (PARTITION BY table_id ORDER BY row_idx) - 1 AS place, count(*) OVER (PARTITION BY table_id) AS cnt, list_filter(nt, lambda t: t <> '')[1] AS lbl FROM x JOIN hd USING (table_id, row_idx) WHERE NOT head AND table_id % 9 IN (1, 6, 7)),
 tl AS (SELECT table_id + 9 AS table_id, nt AS other FROM (SELECT *, count(*) OVER (PARTITION BY table_id) AS sz FROM x) q WHERE row_idx >= greatest(0, sz - greatest(1, floor(sz * 0.4)))),
 rp AS (SELECT DISTINCT kp.table_id, row_idx FROM kp JOIN tl USING (table_id) WHERE cnt > 1 AND place < greatest(1, floor(cnt * 0.6)) AND lbl IS NOT NULL AND {_sim('other', 'nt')} >= 0.65),
 rs AS (SELECT * FROM kp WHERE NOT EXISTS (SELECT 1 FROM rp WHERE rp.table_id = kp.table_id AND rp.row_idx = kp.row_idx)),
 pr AS (SELECT *, lag(nt) OVER g AS ab, lag(row_idx) OVER g AS ar, lag(n) OVER g AS an FROM rs WHERE lbl IS NOT NULL AND cnt > 1 WINDOW g AS (PARTITION BY table_id, lbl ORDER BY row_idx)),
 gn AS (SELECT DISTINCT table_id, CASE WHEN an >= n THEN row_idx ELSE ar END AS row_idx FROM pr WHERE ab IS NOT NULL AND {_sim('ab', 'nt')} >= 0.65)
 SELECT table_id, row_idx, array_to_string(texts, '|') AS line FROM rs WHERE NOT EXISTS (SELECT 1 FROM gn WHERE gn.table_id = rs.table_id AND gn.row_idx = rs.row_idx)"""


@query(REPEATS, ROWS)
def continuation_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("texts", F.transform("texts", T.stripped))
    out = M.without_repeats(rows.where("table_id % 9 in (1, 6, 7)"), rows.withColumn("table_id", F.col("table_id") + 9))
    return out.select("table_id", "row_idx", F.array_join("texts", "|").alias("line"))


PAIRS = ", pp AS (SELECT DISTINCT table_id AS source, table_id - 1 AS target FROM cells WHERE table_id % 4 = 1 AND table_id - 1 IN (SELECT table_id FROM cells))"


def _appended(gap: int) -> str:
    blank = " UNION ALL SELECT target, nr, CAST(unnest(range(w)) AS INT), '' FROM sz" if gap else ""
    return PAIRS + f""", sh AS (SELECT table_id, max(row_idx) + 1 AS nr, max(col_idx) + 1 AS w FROM cells GROUP BY 1), sz AS (SELECT source, target, greatest(a.w, b.w) AS w, b.nr FROM pp JOIN sh a ON a.table_id = source JOIN sh b ON b.table_id = target),
 ro AS (SELECT DISTINCT table_id, row_idx FROM cells), al AS (SELECT target, w, table_id, row_idx, row_idx AS place FROM ro JOIN sz ON table_id = target UNION ALL SELECT target, w, table_id, row_idx, row_idx + nr + {gap} FROM ro JOIN sz ON table_id = source), sl AS (SELECT *, unnest(range(w)) AS i FROM al)
 SELECT * FROM cells WHERE table_id NOT IN (SELECT source FROM pp) AND table_id NOT IN (SELECT target FROM pp) UNION ALL SELECT target, CAST(place AS INT), CAST(i AS INT), coalesce(c.text, '') FROM sl LEFT JOIN cells c ON c.table_id = sl.table_id AND c.row_idx = sl.row_idx AND c.col_idx = i{blank}"""


def _pairs(cells: DataFrame) -> DataFrame:
    ids = cells.select("table_id").distinct()
    sources = ids.where("table_id % 4 = 1").select(F.col("table_id").alias("source"), (F.col("table_id") - 1).alias("target"))
    return sources.join(ids.withColumnRenamed("table_id", "target"), "target", "left_semi").select("source", "target")


@query(_appended(0), SHEET_SQL)
def append_padded(spark: SparkSession, d: str) -> DataFrame:
    c = sheets(spark, d)
    return M.append_padded(c, _pairs(c))


@query(_appended(1), SHEET_SQL)
def append_separated(spark: SparkSession, d: str) -> DataFrame:
    c = sheets(spark, d)
    return M.append_padded(c, _pairs(c), True)


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN abs(l_partkey % 60 - l_suppkey % 50) > 25 OR l_partkey % 60 = 0 OR l_suppkey % 50 = 0 THEN 0 WHEN l_partkey % 60 = l_suppkey % 50 THEN 0.15 ELSE 0.15 * exp(-power(l_partkey % 60 - l_suppkey % 50, 2) / (2 * power(greatest(5.0, 300 * 0.03), 2))) END::DOUBLE, 8) AS prior FROM lineitem")
def position_priors(spark: SparkSession, d: str) -> DataFrame:
    prior = M.position_prior(F.col("l_partkey") % 60, F.col("l_suppkey") % 50, F.lit(300))
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.round(prior, 8).alias("prior"))


def _grams(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}) - {n - 2}, 1)), lambda i: substr(lower({x}), i, {n})))"


CONTEXT = f""", a AS (SELECT table_id, row_idx, s AS ctx FROM c WHERE col_idx = 0), p AS (SELECT table_id, string_agg(s, ' ' ORDER BY row_idx, col_idx) AS page FROM c WHERE row_idx < 6 GROUP BY 1), b AS (SELECT a.table_id, a.row_idx, trim(ctx || chr(10) || '合计') AS ctx, trim(page) AS page, row_idx % 3 <> 0 AS reg FROM a JOIN p USING (table_id)),
 q AS (SELECT *, list_max(list_transform(list_filter(list_transform(string_split(ctx, chr(10)), lambda l: trim(l)), lambda l: length(l) >= 3 AND contains(lower(page), lower(l))), lambda l: length(l))) AS lg, {_grams('ctx', 2)} AS ga, {_grams('page', 2)} AS gb FROM b), z AS (SELECT *, len(list_intersect(ga, gb)) AS cm FROM q)
 SELECT table_id, row_idx, round(CASE WHEN ctx = '' OR page = '' THEN 0 ELSE CASE WHEN lg IS NOT NULL THEN least(0.95, 0.7 + 0.03 * lg) WHEN cm < 2 OR cm * 1.0 / (len(ga) + len(gb) - cm) < 0.08 THEN 0 ELSE least(0.85, cm * 1.0 / (len(ga) + len(gb) - cm) + 0.02 * cm) END * CASE WHEN reg THEN 1.0 ELSE 0.5 END END::DOUBLE, 6) AS score FROM z"""


@query(CONTEXT, CELLS)
def context_scores(spark: SparkSession, d: str) -> DataFrame:
    c = sheets(spark, d).withColumn("s", T.stripped(F.col("text")))
    context = F.struct("row_idx", F.concat("s", F.lit("\n合计")).alias("context"), (F.col("row_idx") % 3 != 0).alias("has_region"))
    cells = F.array_sort(F.collect_list(F.when(F.col("row_idx") < 6, F.struct("row_idx", "col_idx", "s"))))
    per = c.where("row_idx < 6 or col_idx = 0").groupBy("table_id").agg(F.array_join(F.transform(cells, lambda x: x["s"]), " ").alias("page"), F.collect_list(F.when(F.col("col_idx") == 0, context)).alias("contexts"), F.count_if(F.col("row_idx") < 6).alias("n"))
    return M.context_scores(per.where("n > 0")).withColumn("score", F.round("score", 6))


GRAMS = ", g AS (SELECT DISTINCT doc_id, page_number, substr(t, i, 4) AS gram FROM (SELECT doc_id, page_number, t, unnest(range(1, length(t) - 2)) AS i FROM (SELECT doc_id, page_number, regexp_replace(lower(body), '\\s+', '', 'g') AS t FROM b) y) x)"


@query(", b AS (SELECT table_id % 10 AS doc_id, table_id AS page_number, string_agg(s, ' ' ORDER BY row_idx, col_idx) AS body FROM c GROUP BY ALL)" + GRAMS + " SELECT doc_id, gram, count(*) AS pages FROM g GROUP BY 1, 2 HAVING count(*) > 3", CELLS)
def common_grams(spark: SparkSession, d: str) -> DataFrame:
    return M.common_grams(_table_pages(spark, d))


def _table_pages(spark: SparkSession, d: str) -> DataFrame:
    c = sheets(spark, d).withColumn("s", T.stripped(F.col("text")))
    per = c.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "col_idx", "s"))), lambda x: x["s"]), " ").alias("text"))
    return per.select((F.col("table_id") % 10).alias("doc_id"), F.col("table_id").alias("page_number"), "text")


@query(", b AS (SELECT table_id % 10 AS doc_id, table_id AS page_number, string_agg(s, ' ' ORDER BY row_idx, col_idx) AS body FROM c GROUP BY ALL)" + GRAMS + """, cm AS (SELECT doc_id, gram FROM g GROUP BY 1, 2 HAVING count(*) > 3), tx AS (SELECT table_id % 10 AS doc_id, table_id * 100 + row_idx AS text_id, regexp_replace(lower(s), '\\s+', '', 'g') AS t FROM c WHERE col_idx = 0),
 ex AS (SELECT doc_id, text_id, substr(t, i, 4) AS gram FROM (SELECT *, unnest(range(1, length(t) - 2)) AS i FROM tx) q), mt AS (SELECT ex.doc_id, text_id, count(*) AS n, count(*) FILTER (cm.gram IS NULL) AS rare FROM ex LEFT JOIN cm ON cm.doc_id = ex.doc_id AND cm.gram = ex.gram GROUP BY 1, 2)
 SELECT doc_id, text_id, round(coalesce(rare * 1.0::DOUBLE / n, 0), 6) AS share, coalesce(n > 0 AND rare * 1.0 / n >= 0.5, false) AS distinctive FROM tx LEFT JOIN mt USING (doc_id, text_id)""", CELLS)
def distinctive_texts(spark: SparkSession, d: str) -> DataFrame:
    texts = sheets(spark, d).where("col_idx = 0").select((F.col("table_id") % 10).alias("doc_id"), (F.col("table_id") * 100 + F.col("row_idx")).alias("text_id"), T.stripped(F.col("text")).alias("text"))
    out = M.distinctive_share(texts, M.common_grams(_table_pages(spark, d)))
    return out.withColumn("share", F.round("share", 6))


@query(f", a AS (SELECT doc_id, table_id, CASE WHEN table_id % 5 = 0 THEN page END AS page FROM t) SELECT doc_id, table_id, segment, low, high FROM (SELECT *, count(page) OVER ({DOC}) AS segment, coalesce(last_value(page IGNORE NULLS) OVER ({DOC} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS low, coalesce(first_value(page IGNORE NULLS) OVER ({DOC} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 900) AS high FROM a) x WHERE page IS NULL", LIST)
def anchor_segments(spark: SparkSession, d: str) -> DataFrame:
    return M.anchor_segments(_list(spark, d).select("doc_id", "table_id", F.when(F.col("table_id") % 5 == 0, F.col("page")).alias("page")), 900)


@query(""", o AS (SELECT doc_id, table_id, row_number() OVER (PARTITION BY doc_id ORDER BY table_id) AS pos FROM t WHERE table_id % 3 = 0), sc AS (SELECT doc_id, pos, list(((table_id * 31 + k * 17) % 97) / 97.0 ORDER BY k) AS v FROM o, (SELECT unnest(range(1, 9)) AS k) z GROUP BY 1, 2),
 dp AS (SELECT doc_id, pos, v AS best FROM sc WHERE pos = 1 UNION ALL SELECT sc.doc_id, sc.pos, list_transform(sc.v, lambda x, i: x + list_max(list_transform(dp.best[1:i], lambda y, j: y + 0.002 * j)) - 0.002 * i) FROM dp JOIN sc ON sc.doc_id = dp.doc_id AND sc.pos = dp.pos + 1)
 SELECT doc_id, round(list_max(arg_max(best, pos)), 4) AS total FROM dp GROUP BY 1""", LIST)
def assigned_totals(spark: SparkSession, d: str) -> DataFrame:
    pages = F.explode(F.sequence(F.lit(1), F.lit(8))).alias("page")
    scores = _list(spark, d).where("table_id % 3 = 0").select("doc_id", "table_id", pages).withColumn("score", (F.col("table_id") * 31 + F.col("page") * 17) % 97 / F.lit(97.0))
    chosen = M.assign_pages(scores)
    w = Q.Window.partitionBy("doc_id").orderBy("table_id")
    priced = chosen.withColumn("net", F.col("score") - M.PAGE_PRICE * F.coalesce(F.col("page") - F.lag("page").over(w), F.lit(0)))
    return priced.groupBy("doc_id").agg(F.round(F.sum("net"), 4).alias("total"))


@query(f", tk AS (SELECT DISTINCT table_id % 10 AS doc_id, s AS token FROM c WHERE col_idx = 1 AND row_idx = 3 AND length(s) >= 3 AND table_id % 7 = 0), pg AS (SELECT table_id % 10 AS doc_id, table_id AS pn, lower(string_agg(s, ' ' ORDER BY row_idx, col_idx)) AS body FROM c GROUP BY ALL) SELECT tk.doc_id, token, count(DISTINCT pn) AS pages FROM tk JOIN pg ON pg.doc_id = tk.doc_id AND (contains(body, lower(token)) OR contains(body, lower(replace(token, ',', '')))) GROUP BY 1, 2", CELLS)
def token_pages(spark: SparkSession, d: str) -> DataFrame:
    s = T.stripped(F.col("text"))
    tokens = sheets(spark, d).where("col_idx = 1 and row_idx = 3 and table_id % 7 = 0").select((F.col("table_id") % 10).alias("doc_id"), s.alias("token")).where("length(token) >= 3")
    return M.token_pages(tokens, _table_pages(spark, d))


# -- lists
@query(" SELECT doc_id, table_id, grp, CAST(row_number() OVER (PARTITION BY grp, doc_id, page ORDER BY table_id) AS INT) AS seq FROM (SELECT *, unnest(list_filter([CASE WHEN table_category = '财务数据表' THEN 'financial' END, CASE WHEN table_category IN ('目录', '非标准表格', '空表', '图表标签') THEN 'other' END, CASE WHEN manual_mark = 'table' THEN 'marked' END, 'all'], lambda x: x IS NOT NULL)) AS grp FROM t) x", LIST)
def table_groups(spark: SparkSession, d: str) -> DataFrame:
    t, out = _list(spark, d), None
    for group in ("financial", "other", "marked", "all"):
        own = I.of_group(t, group).select("doc_id", "table_id", F.lit(group).alias("grp"), "seq")
        out = own if out is None else out.unionByName(own)
    return out


@query(" SELECT doc_id, table_id, coalesce(nullif(CASE WHEN table_id % 9 = 0 THEN 'model' ELSE '' END, ''), nullif(CASE WHEN table_id % 4 = 0 THEN 'own' END, ''), nullif(substr(trim(string_split(coalesce(caption, ''), chr(10))[1]), 1, 12), ''), nullif(substr(trim(parse_status), 1, 8), ''), '') AS title FROM t", LIST)
def shown_titles(spark: SparkSession, d: str) -> DataFrame:
    given, own = F.when(F.col("table_id") % 9 == 0, "model").otherwise(""), F.when(F.col("table_id") % 4 == 0, "own")
    return _list(spark, d).select("doc_id", "table_id", I.title(given, own, F.col("caption"), F.col("parse_status")).alias("title"))


@query(" SELECT doc_id, table_id FROM (SELECT *, parse_status = 'success' AND (manual_mark = 'table' OR table_category = '财务数据表') AS good, bool_or(parse_status = 'success' AND (manual_mark = 'table' OR table_category = '财务数据表')) OVER (PARTITION BY doc_id) AS sm FROM t) x WHERE good OR (NOT sm AND parse_status = 'empty')", LIST)
def export_selection(spark: SparkSession, d: str) -> DataFrame:
    return I.for_export(_list(spark, d)).select("doc_id", "table_id")


@query(f" SELECT doc_id, table_id, coalesce(lag(page) OVER ({DOC}) <> page, true) AS first_on_page, coalesce(lead(page) OVER ({DOC}) <> page, true) AS last_on_page FROM t", LIST)
def page_ends(spark: SparkSession, d: str) -> DataFrame:
    return I.page_ends(_list(spark, d)).select("doc_id", "table_id", "first_on_page", "last_on_page")


@query(", g AS (SELECT doc_id, page, min(table_id) AS first, string_agg(table_id, ',' ORDER BY table_id) AS tables FROM t GROUP BY 1, 2) SELECT *, lag(first) OVER (PARTITION BY doc_id ORDER BY page) AS previous, lead(first) OVER (PARTITION BY doc_id ORDER BY page) AS next FROM g", LIST)
def page_steps(spark: SparkSession, d: str) -> DataFrame:
    return I.page_steps(_list(spark, d)).withColumn("tables", F.array_join(F.transform("tables", lambda x: x.cast("string")), ","))


@query(", mv AS (SELECT doc_id, table_id, CASE WHEN table_id % 10 = 0 THEN 1 ELSE page END AS page FROM t) SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, table_id) AS INT) AS place FROM mv", LIST)
def moved_pages(spark: SparkSession, d: str) -> DataFrame:
    t = _list(spark, d)
    moves = t.where("table_id % 10 = 0").select("doc_id", "table_id", F.lit(1).alias("new_page"))
    return I.moved_page(t, moves).select("doc_id", "table_id", "page", "place")


@query(" SELECT doc_id, table_id, CASE WHEN manual_mark = 'non_table' THEN 'table' ELSE 'non_table' END AS mark FROM t", LIST)
def toggled_marks(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d).select("doc_id", "table_id", I.toggled(F.col("manual_mark")).alias("mark"))


HISTORY = "WITH h AS (SELECT o_custkey || '.pdf' AS filename, o_orderkey AS record_id, o_orderdate AS processed_time, CASE o_orderkey % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'partial' ELSE 'failed' END AS status FROM orders)"


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY processed_time DESC, record_id DESC) AS k FROM h) SELECT filename, record_id, status FROM r WHERE k = 1 AND status = 'success'", HISTORY)
def latest_records(spark: SparkSession, d: str) -> DataFrame:
    h = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey || '.pdf' AS filename", "o_orderkey AS record_id", "o_orderdate AS processed_time", "CASE o_orderkey % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'partial' ELSE 'failed' END AS status")
    return I.latest(h, "success").select("filename", "record_id", "status")


@query(" SELECT filename, record_id, row_number() OVER (PARTITION BY filename ORDER BY processed_time DESC, record_id) <= 3 AS keep FROM h", HISTORY)
def retention(spark: SparkSession, d: str) -> DataFrame:
    h = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey || '.pdf' AS filename", "o_orderkey AS name", "o_orderdate AS modified")
    return I.kept_recent(h, ["filename"], 3).select("filename", F.col("name").alias("record_id"), "keep")


@query(" SELECT doc_id, table_id, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, table_id) AS k FROM t) x WHERE k <= 5", LIST)
def top_tables(spark: SparkSession, d: str) -> DataFrame:
    return I.top(_list(spark, d), ["doc_id"], "score", "table_id", 5).select("doc_id", "table_id", "rank")


@query(", g AS (SELECT doc_id, n_cols, count(*) AS n, min(table_id) AS seen FROM t GROUP BY 1, 2) SELECT doc_id, n_cols, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS k FROM g) x WHERE k = 1", LIST)
def usual_width(spark: SparkSession, d: str) -> DataFrame:
    return I.first_mode(_list(spark, d), ["doc_id"], "n_cols", "table_id")


@query(" SELECT doc_id, table_category, decision, count(*) AS n FROM t GROUP BY 1, 2, 3", LIST)
def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.decision_counts(_list(spark, d))


PAGE_LIST = "WITH p AS (SELECT o_custkey % 40 AS doc_id, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS page_number, o_orderkey % 3 = 0 AS is_table_page, CASE WHEN o_orderkey % 11 = 0 THEN 'x' END AS error, o_orderkey % 4 AS spans, o_orderkey % 3 AS images FROM orders)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Q.Window.partitionBy(F.col("o_custkey") % 40).orderBy("o_orderkey"))
    return spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 40).alias("doc_id"), place.alias("page_number"), (F.col("o_orderkey") % 3 == 0).alias("is_table_page"), F.when(F.col("o_orderkey") % 11 == 0, "x").alias("error"), (F.col("o_orderkey") % 4).alias("spans"), (F.col("o_orderkey") % 3).alias("images"))


@query(" SELECT doc_id, count(*) AS total_pages, count(*) FILTER (is_table_page) AS table_pages, count(error) AS error_pages, coalesce(string_agg(page_number, ',' ORDER BY page_number) FILTER (is_table_page), '') AS table_page_numbers FROM p GROUP BY 1", PAGE_LIST)
def document_summaries(spark: SparkSession, d: str) -> DataFrame:
    return I.document_summary(_pages(spark, d))


@query(", s AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM p) SELECT doc_id, count(*) FILTER (spans = 0 AND images > 0) > count(*) FILTER (spans > 0) AS is_image FROM s WHERE page_number <= 5 OR (n > 10 AND page_number - 1 BETWEEN n // 2 - 2 AND n // 2 + 2) GROUP BY 1", PAGE_LIST)
def image_documents(spark: SparkSession, d: str) -> DataFrame:
    return I.is_image_document(_pages(spark, d))


@query("SELECT run_id, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, round(sum(round(p / 1e6 * CASE model WHEN 'a' THEN 1.0 WHEN 'b' THEN 4.0 ELSE 0 END + c / 1e6 * CASE model WHEN 'a' THEN 2.0 WHEN 'b' THEN 16.0 ELSE 0 END, 6)), 6) AS cost_estimate, count(*) AS api_calls FROM (SELECT o_custkey % 50 AS run_id, o_orderkey % 5000 AS p, o_orderkey % 700 AS c, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS model FROM orders) x GROUP BY 1")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    usage = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey % 50 AS run_id", "o_orderkey % 5000 AS prompt_tokens", "o_orderkey % 700 AS completion_tokens", "CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS model")
    return I.usage_totals(usage, spark.createDataFrame([("a", 1.0, 2.0), ("b", 4.0, 16.0)], "model string, input double, output double"))


@query(f" SELECT doc_id, table_id, CAST((row_number() OVER ({DOC}) - 1) // 35 AS INT) AS batch FROM t", LIST)
def request_batches(spark: SparkSession, d: str) -> DataFrame:
    return I.request_batches(_list(spark, d)).select("doc_id", "table_id", "batch")


@query(", l AS (SELECT table_id, row_idx, count(*) OVER (PARTITION BY table_id) AS n, array_to_string(list_transform(texts, lambda t: CASE WHEN length(t) > 20 THEN substr(t, 1, 17) || '...' ELSE t END), ' | ') AS line FROM r) SELECT table_id, string_agg(line, chr(10) ORDER BY row_idx) || CASE WHEN max(n) > 5 THEN chr(10) || '... (共' || max(n) || '行，仅显示前5行)' ELSE '' END AS preview FROM l WHERE row_idx < 5 GROUP BY 1", ROWS)
def table_previews(spark: SparkSession, d: str) -> DataFrame:
    return I.preview(_rows(spark, d))


@query(""", l AS (SELECT table_id, row_idx::DOUBLE AS pos, count(*) OVER (PARTITION BY table_id) AS n, '  [行' || row_idx || '] ' || array_to_string(texts, chr(9)) AS line FROM r), e AS (SELECT table_id, pos, line FROM l WHERE n <= 8 OR pos < 4 OR pos >= n - 4 UNION ALL SELECT table_id, 3.5, '  ... (中间省略 ' || (n - 8) || ' 行) ...' FROM l WHERE n > 8 AND pos = 0) SELECT table_id, string_agg(line, chr(10) ORDER BY pos) AS request FROM e GROUP BY 1""", ROWS)
def request_texts(spark: SparkSession, d: str) -> DataFrame:
    return I.request_text(_rows(spark, d).withColumn("texts", F.transform("texts", T.stripped)), 8)


@query(" SELECT doc_id, table_id, 'table_' || CASE WHEN length(table_id || '') >= 3 THEN table_id || '' ELSE lpad(table_id || '', 3, '0') END || '_P' || page || '-' || (page + 1) || CASE WHEN coalesce(caption, '') = '' THEN '' ELSE '_' || trim(substr(regexp_replace(caption, '[\\\\/:*?\"<>|]', '', 'g'), 1, 30)) END || '.csv' AS name FROM t", LIST)
def table_file_names(spark: SparkSession, d: str) -> DataFrame:
    pages = F.array(F.col("page"), F.col("page") + 1)
    return _list(spark, d).select("doc_id", "table_id", I.file_name(F.col("table_id"), pages, F.col("caption"), "csv").alias("name"))


@query(""", w AS (SELECT table_id, col_idx, least(max(length(s) + len(regexp_extract_all(s, '[^\\x00-\\x7F]'))), 40) AS w FROM c GROUP BY 1, 2), sl AS (SELECT DISTINCT c.table_id, c.row_idx, w.col_idx, w FROM c JOIN w USING (table_id))
 SELECT sl.table_id, sl.row_idx, CASE WHEN sl.row_idx >= 999 THEN (sl.row_idx + 1) || '' ELSE lpad((sl.row_idx + 1) || '', 3, ' ') END || '│ ' || string_agg(CASE WHEN length(coalesce(s, '')) >= w THEN coalesce(s, '') ELSE rpad(coalesce(s, ''), w::INT, ' ') END, ' ' ORDER BY sl.col_idx) AS line FROM sl LEFT JOIN c ON c.table_id = sl.table_id AND c.row_idx = sl.row_idx AND c.col_idx = sl.col_idx GROUP BY 1, 2""", CELLS)
def text_table_lines(spark: SparkSession, d: str) -> DataFrame:
    return I.text_lines(_rows(spark, d).withColumn("texts", F.transform("texts", T.stripped)))


LABELS = ", lb AS (SELECT table_id, row_idx, s FROM c WHERE col_idx = 0 AND row_idx < 5 AND s <> '')"


@query(LABELS + " SELECT table_id, string_agg(s, '|' ORDER BY row_idx) AS labels FROM lb GROUP BY 1", CELLS)
def first_labels(spark: SparkSession, d: str) -> DataFrame:
    return I.first_labels(_rows(spark, d)).withColumn("labels", F.array_join("labels", "|"))


@query(LABELS + """, l3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_idx) AS k FROM lb) q WHERE k <= 3), rg AS (SELECT table_id AS region_idx, table_id % 20 AS page_number, string_agg(s, ' ' ORDER BY row_idx) AS body FROM lb WHERE table_id % 15 = 0 GROUP BY 1),
 sc AS (SELECT l3.table_id, page_number, region_idx, count(*) AS n FROM l3 JOIN rg ON page_number = l3.table_id % 20 AND contains(body, s) GROUP BY 1, 2, 3) SELECT page_number, table_id, region_idx FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY n DESC, region_idx) AS o FROM sc) z WHERE o = 1""", CELLS)
def best_regions(spark: SparkSession, d: str) -> DataFrame:
    first = sheets(spark, d).where("col_idx = 0").select("table_id", "row_idx", F.array("text").alias("texts"))
    labels = I.first_labels(first).withColumn("page_number", F.col("table_id") % 20)
    regions = labels.where("table_id % 15 = 0").select("page_number", F.col("table_id").alias("region_idx"), F.array_join("labels", " ").alias("region_text"))
    return I.best_region(labels, regions)


@query(", v AS (SELECT table_id, row_idx, col_idx, text, unnest(CASE WHEN table_id % 3 = 0 THEN ['raw', 'original'] WHEN table_id % 3 = 1 THEN ['raw', 'clean'] ELSE ['raw'] END) AS layer FROM cells) SELECT * FROM v WHERE layer = CASE WHEN table_id % 3 = 0 THEN 'original' WHEN table_id % 3 = 1 THEN 'clean' ELSE 'raw' END", SHEET_SQL)
def shown_layer(spark: SparkSession, d: str) -> DataFrame:
    names = F.expr("CASE WHEN table_id % 3 = 0 THEN array('raw', 'original') WHEN table_id % 3 = 1 THEN array('raw', 'clean') ELSE array('raw') END")
    return I.layer(sheets(spark, d).withColumn("layer", F.explode(names)))


@query(" SELECT doc_id, table_id, confidence FROM t WHERE confidence = 'high'", LIST)
def accepted_corrections(spark: SparkSession, d: str) -> DataFrame:
    return I.accepted(_list(spark, d), "high").select("doc_id", "table_id", "confidence")


@query(" SELECT doc_id, table_id, 'needs_review' AS status, 'low' AS confidence FROM t", LIST)
def fallback_results(spark: SparkSession, d: str) -> DataFrame:
    return I.without_key(_list(spark, d))


@query("SELECT p_partkey, regexp_replace(regexp_replace(trim(regexp_replace(substr(regexp_replace(regexp_replace('/in/' || p_name || ':x.v1.pdf', '^.*/', ''), '\\.[^.]*$', ''), 1, 100), '[:*?\"<>|]', '_', 'g')), '\\.+$', ''), '[^\\p{L}\\p{N}_\\-]', '_', 'g') AS name FROM part")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", T.safe_name(F.concat(F.lit("/in/"), "p_name", F.lit(":x.v1.pdf"))).alias("name"))


@query(f" SELECT table_id, row_idx, array_to_string(list_filter(string_split_regex(s, '\\s+'), lambda w: length(w) >= 2), '|') AS words FROM (SELECT *, {STRIP} AS s FROM cells) x WHERE col_idx = 2", SHEET_SQL)
def cell_keywords(spark: SparkSession, d: str) -> DataFrame:
    return sheets(spark, d).where("col_idx = 2").select("table_id", "row_idx", F.array_join(T.keywords(F.col("text")), "|").alias("words"))


FIELD = "CASE WHEN regexp_matches(t, '[,\"\\r\\n]') THEN '\"' || replace(t, '\"', '\"\"') || '\"' ELSE t END"


@query(f" SELECT table_id, row_idx + 1 AS line_no, array_to_string(list_concat(list_transform(texts, lambda t: {FIELD}), list_transform(range(max(w) OVER (PARTITION BY table_id) - w), lambda i: '')), ',') AS value FROM r UNION ALL SELECT DISTINCT table_id, 0, '# 表#' || table_id FROM r", ROWS)
def csv_table_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("texts", F.transform("texts", T.stripped))
    grid = rows.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "texts"))), lambda x: x["texts"]).alias("data"))
    return S.csv_lines(grid, grid.select("table_id", F.concat(F.lit("# 表#"), F.col("table_id").cast("string")).alias("mark")))


@query(""", z AS (SELECT table_id, max(w) AS mw, max(row_idx) AS last FROM r GROUP BY 1), u AS (SELECT table_id, 0 AS row_no, 'T' AS line FROM z UNION ALL SELECT table_id, 1, '来源: PDF第3页 | 提取方式: docx精准通道' FROM z UNION ALL SELECT table_id, 2, '' FROM z UNION ALL SELECT table_id, 3, repeat('|', (mw + 1)::INT) FROM z UNION ALL SELECT table_id, last + 5, repeat('|', (mw + 1)::INT) FROM z
 UNION ALL SELECT r.table_id, row_idx + 4, '|' || array_to_string(texts, '|') || repeat('|', (mw - w + 1)::INT) FROM r JOIN z USING (table_id)) SELECT * FROM u""", ROWS)
def sheet_layout(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("texts", F.transform("texts", T.stripped))
    grid = rows.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "texts"))), lambda x: x["texts"]).alias("data"))
    out = S.sheet_rows(grid, grid.select("table_id", F.lit("T").alias("title"), F.lit(3).alias("page"), F.lit("docx_based").alias("extractor")))
    return out.select("table_id", "row_no", F.array_join("values", "|").alias("line"))


@query(" SELECT doc_id, confidence, count(*) AS n FROM t GROUP BY 1, 2", LIST)
def confidence_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.confidence_counts(_list(spark, d))


@query(" SELECT doc_id, page_number, 'tables' AS kind FROM p WHERE is_table_page UNION ALL SELECT doc_id, page_number, 'errors' FROM p WHERE error IS NOT NULL", PAGE_LIST)
def pages_of_kind(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    both = [I.pages_of_kind(p, k).select("doc_id", "page_number", F.lit(k).alias("kind")) for k in ("tables", "errors")]
    return both[0].unionByName(both[1])
