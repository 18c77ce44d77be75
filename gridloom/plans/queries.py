"""Named queries over the derived views, and the DuckDB SQL that must agree with each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cells as C
from ..operators import edits as E
from ..operators import geometry as G
from ..operators import joins as J
from ..operators import repairs as P
from ..sources.derived import CELLS_SQL, ITEMS_SQL, cells, items

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, prefix: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = prefix + sql
        return f

    return register


# DuckDB expressions of the scalar functions
S = "regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '')"


def _signed(x: str) -> str:
    return f"regexp_replace({x}, '^\\((.*)\\)$', '-\\1')"


NUMBER_TEXT = _signed(f"regexp_replace(regexp_replace({S}, '%+$', ''), '[, ]', '', 'g')")
IS_NUMBER = f"regexp_matches({NUMBER_TEXT}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')"
KEY = _signed(f"regexp_replace({S}, '[, 　]', '', 'g')")
CJK = "[\\x{4e00}-\\x{9fff}]"
CLEANED = f"CASE WHEN {S} = '' OR regexp_matches({S}, '^[-—―─－]+$') OR regexp_matches({S}, '{CJK}|[a-zA-Z]') THEN {S} ELSE trim(regexp_replace({S}, '[^0-9,.\\-()% ]', '', 'g')) END"
AT = "table_id, row_idx, col_idx"


@query(f" SELECT {AT}, {CLEANED} AS text FROM cells", CELLS_SQL)
def cells_clean(spark: SparkSession, d: str) -> DataFrame:
    return C.clean(cells(spark, d))


@query(f" SELECT {AT}, {KEY} AS k FROM cells", CELLS_SQL)
def cells_lookup_key(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).select("table_id", "row_idx", "col_idx", T.lookup_key(F.col("text")).alias("k"))


NUM = f"regexp_extract({KEY}, '-?[0-9]+\\.?[0-9]*')"
TYPE = f"""CASE WHEN {S} = '' THEN 'empty' WHEN {S} LIKE '%\\%' ESCAPE '\\' THEN 'percent' WHEN regexp_matches({S}, '{CJK}') AND regexp_matches({S}, '[0-9]') THEN 'mixed'
WHEN regexp_matches({S}, '{CJK}') THEN 'label' WHEN NOT regexp_matches({S}, '[0-9]') THEN 'mixed' WHEN length(regexp_replace({NUM}, '[-.]', '', 'g')) >= 6 THEN 'amount'
WHEN abs(TRY_CAST({NUM} AS DOUBLE)) < 100 AND contains({NUM}, '.') THEN 'ratio' ELSE 'number' END"""


@query(f" SELECT col_idx, {TYPE} AS kind, count(*) AS n FROM cells GROUP BY 1, 2", CELLS_SQL)
def item_types(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).groupBy("col_idx", T.item_type(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


STRICT = f"regexp_matches({_signed(f'replace(regexp_replace({S}, ' + chr(39) + '%+$' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + ',' + chr(39) + ', ' + chr(39) * 2 + ')')}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')"
LOOSE = f"regexp_matches({S}, '^[0-9,.\\-()（）%]*$')"
DATA = f"(NOT regexp_matches({S}, '{CJK}|[a-zA-Z]') AND regexp_matches({S}, '[0-9]'))"
FILL = "regexp_matches(" + _signed(f"regexp_replace({S}, '[,%]', '', 'g')") + ", '^-?[0-9]+\\.?[0-9]*$')"


@query(f" SELECT col_idx, count(*) FILTER ({IS_NUMBER}) AS classifier, count(*) FILTER ({STRICT}) AS strict, count(*) FILTER ({LOOSE}) AS loose, count(*) FILTER ({DATA}) AS data, count(*) FILTER ({FILL}) AS fill FROM cells GROUP BY 1", CELLS_SQL)
def numeric_variants(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    tests = {"classifier": T.is_numeric, "strict": T.is_numeric_strict, "loose": T.is_numeric_or_blank, "data": T.is_number_data, "fill": T.is_fill_number}
    return cells(spark, d).groupBy("col_idx").agg(*(F.count_if(f(t)).alias(n) for n, f in tests.items()))


@query(f", full_rows AS (SELECT table_id, row_idx, dense_rank() OVER (PARTITION BY table_id ORDER BY row_idx) - 1 AS r FROM (SELECT DISTINCT table_id, row_idx FROM cells WHERE {S} <> '') x) SELECT table_id, CAST(r AS INT) AS row_idx, col_idx, text FROM cells JOIN full_rows USING (table_id, row_idx)", CELLS_SQL)
def drop_empty_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_empty_rows(cells(spark, d))


@query(f", full_columns AS (SELECT table_id, col_idx, dense_rank() OVER (PARTITION BY table_id ORDER BY col_idx) - 1 AS c FROM (SELECT DISTINCT table_id, col_idx FROM cells WHERE {S} <> '') x) SELECT table_id, row_idx, CAST(c AS INT) AS col_idx, text FROM cells JOIN full_columns USING (table_id, col_idx)", CELLS_SQL)
def compact_columns(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_empty_columns(cells(spark, d))


@query(f", span AS (SELECT table_id, min(col_idx) AS lo, max(col_idx) AS hi FROM cells WHERE {S} <> '' GROUP BY 1) SELECT table_id, row_idx, col_idx - lo AS col_idx, text FROM cells JOIN span USING (table_id) WHERE col_idx BETWEEN lo AND hi", CELLS_SQL)
def crop_edges(spark: SparkSession, d: str) -> DataFrame:
    return C.crop_columns(cells(spark, d))


@query(", col AS (SELECT table_id, col_idx, string_agg(CASE WHEN text <> '' THEN row_idx || ':' || text ELSE '' END, '|' ORDER BY row_idx) AS body FROM cells GROUP BY 1, 2), kept AS (SELECT *, dense_rank() OVER (PARTITION BY table_id ORDER BY col_idx) - 1 AS c FROM (SELECT *, coalesce(body = lag(body) OVER (PARTITION BY table_id ORDER BY col_idx), false) AS same FROM col) x WHERE NOT same) SELECT table_id, row_idx, CAST(c AS INT) AS col_idx, text FROM cells JOIN kept USING (table_id, col_idx)", CELLS_SQL)
def dedup_columns(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_repeated_columns(cells(spark, d))


@query(f" SELECT {AT}, CASE WHEN col_idx > 0 AND row_number() OVER (PARTITION BY table_id, col_idx, {KEY} ORDER BY row_idx) > 1 THEN '' ELSE text END AS text FROM cells", CELLS_SQL)
def bleed_clear(spark: SparkSession, d: str) -> DataFrame:
    return C.blank_repeats(cells(spark, d))


@query(f" SELECT {AT}, coalesce(last_value(CASE WHEN {S} <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY table_id, col_idx ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS text FROM cells", CELLS_SQL)
def fill_down(spark: SparkSession, d: str) -> DataFrame:
    return C.fill_down(cells(spark, d))


@query(f" SELECT {AT}, CASE WHEN {STRICT} THEN replace({S}, ',', '') ELSE {S} END AS text FROM cells", CELLS_SQL)
def plain_numbers(spark: SparkSession, d: str) -> DataFrame:
    return C.plain_numbers(cells(spark, d))


@query(" SELECT table_id, row_idx, col_idx, text FROM (SELECT *, bool_or(contains(lower(text), '备注1')) OVER (PARTITION BY table_id, row_idx) AS hit FROM cells) x WHERE hit", CELLS_SQL)
def filter_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.filter_rows(cells(spark, d), "备注1")


@query(f" SELECT DISTINCT table_id, col_idx, {S} AS value FROM cells WHERE {S} <> ''", CELLS_SQL)
def column_values(spark: SparkSession, d: str) -> DataFrame:
    return C.column_values(cells(spark, d))


PROFILE = f""", v AS (SELECT table_id, col_idx, {S} AS value, count(*) AS n, count(*) FILTER (row_idx > 0 AND {S} <> '') AS filled, count(*) FILTER (row_idx > 0 AND {IS_NUMBER}) AS num FROM cells GROUP BY 1, 2, 3),
profile AS (SELECT table_id, col_idx, CAST(sum(n) AS BIGINT) AS n_rows, CASE WHEN sum(filled) > 0 THEN sum(num) * 1.0 / sum(filled) ELSE 0.0 END AS numeric_ratio, max(n) * 1.0 / sum(n) AS duplicate_ratio FROM v GROUP BY 1, 2)"""


@query(PROFILE + " SELECT table_id, col_idx, n_rows, round(CAST(numeric_ratio AS DOUBLE), 6) AS numeric_ratio, round(CAST(duplicate_ratio AS DOUBLE), 6) AS duplicate_ratio FROM profile", CELLS_SQL)
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    p = C.column_profile(cells(spark, d))
    return p.withColumns({c: F.round(c, 6) for c in ("numeric_ratio", "duplicate_ratio")})


CLASSIFY = """, per AS (SELECT table_id, count(*) AS n_cols, max(n_rows) AS n_rows, max(CASE WHEN n_rows >= 3 THEN duplicate_ratio END) AS dup, max(numeric_ratio) AS num FROM profile GROUP BY 1),
t AS (SELECT *, CASE WHEN n_rows > 1 THEN n_rows - 1 ELSE n_rows END AS data_rows FROM per)
SELECT table_id, n_cols, data_rows, CASE WHEN n_cols < 2 OR data_rows < 3 OR coalesce(dup, 0) >= 0.6 THEN false WHEN num >= 0.7 OR (num >= 0.3 AND data_rows >= 5) THEN true ELSE false END AS is_real_table,
CAST(CASE WHEN n_cols < 2 THEN 0.95 WHEN data_rows < 3 THEN 0.9 WHEN coalesce(dup, 0) >= 0.6 THEN 0.85 WHEN num >= 0.7 OR (num >= 0.3 AND data_rows >= 5) THEN 0.9 ELSE 0.75 END AS DOUBLE) AS confidence FROM t"""


@query(PROFILE + CLASSIFY, CELLS_SQL)
def classify_tables(spark: SparkSession, d: str) -> DataFrame:
    return C.classify(cells(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Clean, drop empty rows, classify, and count the tables by outcome."""
    done = C.classify(C.drop_empty_rows(C.clean(cells(spark, d))))
    return done.groupBy("is_real_table", "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("data_rows").alias("data_rows"))


QUERIES["flagship"] = flagship


@query(f" SELECT table_id, col_idx, round(sum(CASE WHEN {IS_NUMBER} THEN TRY_CAST({NUMBER_TEXT} AS DOUBLE) END), 4) AS total, round(avg(CASE WHEN {IS_NUMBER} THEN TRY_CAST({NUMBER_TEXT} AS DOUBLE) END), 4) AS mean, count(*) FILTER ({IS_NUMBER}) AS n FROM cells GROUP BY 1, 2", CELLS_SQL)
def selection_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.selection_stats(cells(spark, d))


@query(f", r AS (SELECT table_id, row_idx, bool_or({S} <> '') AS f, count(*) AS w, bool_or({IS_NUMBER}) AS num, count(*) FILTER (text <> {S}) AS ob FROM cells GROUP BY 1, 2) SELECT table_id, count(*) FILTER (NOT f) AS empty_rows, min(w) <> max(w) AS ragged, count(*) = 1 AS single_row, NOT bool_or(num) AS no_numeric, CAST(sum(ob) AS BIGINT) AS outer_blanks FROM r GROUP BY 1", CELLS_SQL)
def rule_checks(spark: SparkSession, d: str) -> DataFrame:
    return C.rule_checks(cells(spark, d))


@query(f" SELECT {AT}, CASE WHEN col_idx = 3 AND row_idx = 0 THEN 'fixed' ELSE text END AS text FROM cells", CELLS_SQL)
def apply_changes(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    changes = c.where("col_idx = 3 and row_idx = 0").select("table_id", "row_idx", "col_idx", F.lit("fixed").alias("new_text"))
    return C.apply_changes(c, changes)


@query(f" SELECT {AT}, text AS before, {CLEANED} AS after FROM cells WHERE text <> {CLEANED}", CELLS_SQL)
def grid_difference(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return C.difference(c, C.clean(c))


@query(f", first AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_idx, col_idx) AS rk FROM cells WHERE {S} <> ''), tok AS (SELECT table_id, string_agg(k, '|' ORDER BY k) AS tokens FROM (SELECT DISTINCT table_id, {KEY} AS k FROM first WHERE rk <= 5) x GROUP BY 1) SELECT table_id, tokens, n_rows FROM tok JOIN (SELECT table_id, max(row_idx) + 1 AS n_rows FROM cells GROUP BY 1) n USING (table_id)", CELLS_SQL)
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return C.fingerprint(cells(spark, d))


@query(f" SELECT table_id, row_idx, string_agg(coalesce(text, ''), chr(9) ORDER BY col_idx) AS line FROM cells GROUP BY 1, 2", CELLS_SQL)
def grid_lines(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.sinks import as_text

    lines = as_text(C.to_grid(cells(spark, d)))
    return lines.select("table_id", F.col("line_no").alias("row_idx"), F.col("value").alias("line"))


PG = "doc_id, page_number"


@query(f", b AS (SELECT *, CAST(round_even(y0 / 5, 0) AS INT) AS bucket FROM items), e AS (SELECT {PG}, bucket, sum(CASE WHEN bucket - prev > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {PG} ORDER BY bucket) AS row_idx FROM (SELECT DISTINCT {PG}, bucket, lag(bucket) OVER (PARTITION BY {PG} ORDER BY bucket) AS prev FROM (SELECT DISTINCT {PG}, bucket FROM b) y) x) SELECT {PG}, item_id, CAST(row_idx AS INT) AS row_idx FROM b JOIN e USING ({PG}, bucket)", ITEMS_SQL)
def row_buckets(spark: SparkSession, d: str) -> DataFrame:
    return G.row_buckets(items(spark, d)).select("doc_id", "page_number", "item_id", "row_idx")


@query(f", v AS (SELECT {PG}, x0 AS v, sum(CASE WHEN x0 - prev > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY {PG} ORDER BY x0, item_id) AS island FROM (SELECT *, lag(x0) OVER (PARTITION BY {PG} ORDER BY x0, item_id) AS prev FROM items) x) SELECT {PG}, CAST(island AS INT) AS island, count(*) AS n, round(avg(v), 4) AS center FROM v GROUP BY 1, 2, 3 HAVING count(*) >= 3", ITEMS_SQL)
def cluster_1d(spark: SparkSession, d: str) -> DataFrame:
    return G.cluster_1d(items(spark, d).select("doc_id", "page_number", F.col("x0").alias("v")))


@query(f", e AS (SELECT DISTINCT {PG}, x FROM (SELECT {PG}, x0 AS x FROM items UNION ALL SELECT {PG}, x1 FROM items) u), g AS (SELECT *, lead(x) OVER (PARTITION BY {PG} ORDER BY x) - x AS gap FROM e), l AS (SELECT {PG}, greatest(median(gap) * 1.5, 10.0) AS most FROM g WHERE gap IS NOT NULL GROUP BY 1, 2) SELECT {PG}, round(x + gap / 2, 4) AS boundary FROM g JOIN l USING ({PG}) WHERE gap > most", ITEMS_SQL)
def gap_columns(spark: SparkSession, d: str) -> DataFrame:
    return G.gap_columns(items(spark, d))


@query(f", e AS (SELECT DISTINCT {PG}, x FROM (SELECT {PG}, x0 AS x FROM items UNION ALL SELECT {PG}, x1 FROM items) u), g AS (SELECT *, lead(x) OVER (PARTITION BY {PG} ORDER BY x) - x AS gap FROM e), l AS (SELECT {PG}, greatest(median(gap) * 1.5, 10.0) AS most FROM g WHERE gap IS NOT NULL GROUP BY 1, 2), b AS (SELECT {PG}, round(x + gap / 2, 4) AS boundary FROM g JOIN l USING ({PG}) WHERE gap > most)"
       f", o AS (SELECT {PG}, min(x0) AS lo, max(x1) AS hi FROM items GROUP BY 1, 2), f AS (SELECT {PG}, min(boundary) AS first, max(boundary) AS last FROM b GROUP BY 1, 2)"
       f" SELECT * FROM b UNION ALL SELECT {PG}, round(CASE WHEN first IS NULL THEN lo ELSE (lo + first) / 2 END, 4) FROM o LEFT JOIN f USING ({PG})"
       f" UNION ALL SELECT {PG}, round(CASE WHEN last IS NULL THEN hi ELSE (last + hi) / 2 END, 4) FROM o LEFT JOIN f USING ({PG})", ITEMS_SQL)
def gap_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return G.gap_boundaries(items(spark, d))


RUNS = "SELECT DISTINCT l_suppkey AS doc_id, l_partkey % 97 + 1 AS page_number FROM lineitem"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 97 + 1).alias("page_number")).distinct()


ISLAND = f"WITH p AS ({RUNS}), r AS (SELECT *, page_number - row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS run FROM p)"


@query(" SELECT doc_id, min(page_number) AS first, max(page_number) AS last FROM r GROUP BY doc_id, run", ISLAND)
def merge_ranges(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_ranges(_pages(spark, d), ["doc_id"], "page_number")


@query(", m AS (SELECT doc_id, min(page_number) AS a, max(page_number) AS b FROM r GROUP BY doc_id, run) SELECT doc_id, string_agg(CASE WHEN a = b THEN a || '' ELSE a || '-' || b END, ',' ORDER BY a) AS pages FROM m GROUP BY 1", ISLAND)
def page_range_text(spark: SparkSession, d: str) -> DataFrame:
    return G.page_ranges(_pages(spark, d), ["doc_id"], "page_number")


@query(", c AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY page_number) - 1) // 5 AS part FROM r) SELECT doc_id, min(page_number) AS first, max(page_number) AS last FROM c GROUP BY doc_id, run, part", ISLAND)
def page_groups(spark: SparkSession, d: str) -> DataFrame:
    return G.page_groups(_pages(spark, d))


@query(f", g AS (SELECT {PG}, CAST(least(greatest(floor((y0 + y1) / 2 / 730.0 * 10), 0), 9) AS INT) AS grid_row, count(*) AS n FROM items GROUP BY 1, 2, 3), dn AS (SELECT * FROM (SELECT *, 0.8 * greatest(sum(n) OVER (PARTITION BY {PG}) / 10.0, 3.0) AS lim FROM g) x WHERE n > lim), rn AS (SELECT *, grid_row - row_number() OVER (PARTITION BY {PG} ORDER BY grid_row) AS run FROM dn) SELECT {PG}, min(grid_row) AS first, max(grid_row) AS last, CAST(sum(n) AS BIGINT) AS n_items FROM rn GROUP BY {PG}, run", ITEMS_SQL)
def density_regions(spark: SparkSession, d: str) -> DataFrame:
    return G.density_rows(items(spark, d), 730.0)


@query(f" SELECT {PG}, item_id, CAST(row_number() OVER (PARTITION BY {PG} ORDER BY y0, x0, item_id) AS INT) AS seq FROM items", ITEMS_SQL)
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return G.page_order(items(spark, d)).select("doc_id", "page_number", "item_id", "seq")


COLS = f", cols AS (SELECT DISTINCT {PG}, c AS col_idx, c * 120.0 AS c0, c * 120.0 + 100 AS c1 FROM items, (SELECT unnest(range(5)) AS c) z)"


@query(COLS + f", s AS (SELECT items.*, col_idx, row_number() OVER (PARTITION BY items.{PG.replace(', ', ', items.')}, item_id ORDER BY greatest(least(x1, c1) - greatest(x0, c0), 0) DESC, abs((x0 + x1) / 2 - (c0 + c1) / 2), col_idx) AS rk FROM items JOIN cols USING ({PG})) SELECT {PG}, item_id, CAST(col_idx AS INT) AS col_idx FROM s WHERE rk = 1", ITEMS_SQL)
def nearest_column(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    c = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("col_idx")
    columns = i.select("doc_id", "page_number").distinct().select("*", c).select("*", (F.col("col_idx") * 120.0).alias("c0"), (F.col("col_idx") * 120.0 + 100).alias("c1"))
    return J.nearest_column(i, columns).select("doc_id", "page_number", "item_id", "col_idx")


REG = f", regions AS (SELECT DISTINCT {PG}, k AS region_idx, 0.0 AS r_x0, 300.0 AS r_x1, 100.0 + 250 * k AS r_y0, 200.0 + 250 * k AS r_y1 FROM items, (SELECT unnest(range(2)) AS k) z)"


def _regions(i: DataFrame) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0), F.lit(1))).alias("region_idx")
    r = i.select("doc_id", "page_number").distinct().select("*", k)
    return r.select("*", F.lit(0.0).alias("r_x0"), F.lit(300.0).alias("r_x1"), (F.col("region_idx") * 250 + 100.0).alias("r_y0"), (F.col("region_idx") * 250 + 200.0).alias("r_y1"))


@query(REG + f" SELECT {PG}, item_id, CAST(region_idx AS INT) AS region_idx FROM items JOIN regions USING ({PG}) WHERE (x0 + x1) / 2 BETWEEN r_x0 AND r_x1 AND (y0 + y1) / 2 BETWEEN r_y0 - 30 AND r_y1", ITEMS_SQL)
def region_scope(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return J.in_regions(i, _regions(i)).select("doc_id", "page_number", "item_id", "region_idx")


@query(REG + f", fd AS (SELECT i.*, region_idx FROM items i JOIN regions USING ({PG}) WHERE x1 > x0 AND y1 > y0 AND (x0 + x1) / 2 BETWEEN r_x0 AND r_x1 AND (y0 + y1) / 2 BETWEEN r_y0 - 30 AND r_y1) SELECT {PG}, item_id, CAST(region_idx AS INT) AS region_idx FROM fd UNION ALL SELECT i.doc_id, i.page_number, i.item_id, CAST(r.region_idx AS INT) FROM items i JOIN regions r USING ({PG}) WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.doc_id = r.doc_id AND fd.page_number = r.page_number AND fd.region_idx = r.region_idx)", ITEMS_SQL)
def scoped_items(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return J.scoped_items(i, _regions(i)).select("doc_id", "page_number", "item_id", "region_idx")


@query(f""", k AS (SELECT *, {S} AS s, regexp_replace({S}, '[, ]', '', 'g') AS key, (y0 + y1) / 2 AS mid FROM items), e AS (SELECT doc_id, page_number, item_id AS table_id, CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN s ELSE 'R' END AS label, substr(s, 2) || CASE WHEN item_id % 4 = 0 THEN 'x' ELSE '' END AS key FROM k WHERE item_id % 2 = 0),
 a AS (SELECT e.doc_id, e.page_number, table_id, arg_min(k.mid, k.item_id) AS spot FROM e JOIN k USING (doc_id, page_number) WHERE label <> '' AND contains(s, label) GROUP BY 1, 2, 3),
 b AS (SELECT a.doc_id, a.page_number, table_id, spot, min(y0) AS lo, max(y1) AS hi FROM a JOIN k USING (doc_id, page_number) WHERE abs(mid - spot) <= 5 GROUP BY 1, 2, 3, 4)
 SELECT DISTINCT e.doc_id, e.page_number, e.table_id FROM e LEFT JOIN b USING (doc_id, page_number, table_id) JOIN k ON k.doc_id = e.doc_id AND k.page_number = e.page_number AND contains(k.key, e.key) AND (spot IS NULL OR (k.y1 >= lo AND k.y0 <= hi))""", ITEMS_SQL)
def restore_in_rows(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d).withColumn("key", T.lookup_key(F.col("text")))
    label = F.when(F.col("item_id") % 3 == 0, "").when(F.col("item_id") % 3 == 1, F.col("text")).otherwise("R")
    key = F.concat(F.expr("substr(text, 2)"), F.when(F.col("item_id") % 4 == 0, "x").otherwise(""))
    erased = i.where("item_id % 2 = 0").select("doc_id", "page_number", F.col("item_id").alias("table_id"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), key.alias("key"), label.alias("label"))
    return J.restore_in_rows(erased, i).select("doc_id", "page_number", "table_id")


@query(REG + f" SELECT {PG}, item_id FROM items i WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.doc_id = i.doc_id AND r.page_number = i.page_number AND (x0 + x1) / 2 BETWEEN r_x0 AND r_x1 AND (y0 + y1) / 2 BETWEEN r_y0 AND r_y1)", ITEMS_SQL)
def orphan_items(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return J.outside_regions(i, _regions(i)).select("doc_id", "page_number", "item_id")


#: Every table (id below zero: the other channel's, every third one, on the next page and with another first cell), its document and page.
CHANNELS = f""", ch AS (SELECT table_id, row_idx, col_idx, text FROM cells UNION ALL SELECT -table_id, row_idx, col_idx, CASE WHEN row_idx = 0 AND col_idx = 1 THEN 'changed' ELSE text END FROM cells WHERE table_id % 3 = 0 AND table_id > 0),
 c AS (SELECT *, {S} AS s FROM ch), tp AS (SELECT *, regexp_matches(regexp_replace(replace(s, '(', '-'), '[,%)]', '', 'g'), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') AS nm FROM c WHERE row_idx < 5),
 hl AS (SELECT *, row_number() OVER (PARTITION BY table_id, nm ORDER BY row_idx, col_idx) AS o FROM tp WHERE length(s) >= 2), tk AS (SELECT DISTINCT table_id, lower(s) AS tok FROM hl WHERE o <= CASE WHEN nm THEN 15 ELSE 5 END), sz AS (SELECT table_id, count(*) AS size FROM tk GROUP BY 1),
 wd AS (SELECT table_id, string_agg(w, ',' ORDER BY row_idx) AS widths FROM (SELECT table_id, row_idx, count(*) AS w FROM tp GROUP BY 1, 2) z GROUP BY 1),
 f AS (SELECT table_id, abs(table_id) % 100 AS doc_id, abs(table_id) // 100 + CASE WHEN table_id < 0 AND table_id % 2 = 0 THEN 2 WHEN table_id < 0 THEN 1 ELSE 0 END AS page, widths, size FROM wd JOIN sz USING (table_id)),
 met AS (SELECT a.table_id, b.table_id AS other, count(*) AS common FROM f fa JOIN f fb ON fa.doc_id = fb.doc_id AND fa.widths = fb.widths AND abs(fa.page - fb.page) <= 1 AND fa.table_id >= 0 AND fb.table_id < 0 JOIN tk a ON a.table_id = fa.table_id JOIN tk b ON b.table_id = fb.table_id AND a.tok = b.tok GROUP BY 1, 2),
 rep AS (SELECT DISTINCT m.table_id FROM met m JOIN sz sa ON sa.table_id = m.table_id JOIN sz sb ON sb.table_id = m.other WHERE common >= 3 AND common >= 0.4 * least(sa.size, sb.size))"""


@query(CHANNELS + " SELECT doc_id, table_id, page FROM f WHERE table_id < 0 OR table_id NOT IN (SELECT table_id FROM rep)", CELLS_SQL)
def dedup_channels(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    changed = F.when((F.col("row_idx") == 0) & (F.col("col_idx") == 1), "changed").otherwise(F.col("text"))
    both = c.unionByName(c.where("table_id % 3 = 0 and table_id > 0").select((-F.col("table_id")).alias("table_id"), "row_idx", "col_idx", changed.alias("text")))
    later = F.expr("CASE WHEN table_id < 0 AND table_id % 2 = 0 THEN 2 WHEN table_id < 0 THEN 1 ELSE 0 END")
    t = P.fingerprint(both).withColumns({"doc_id": F.abs("table_id") % 100, "page": F.expr("abs(table_id) div 100") + later})
    return J.union_of_channels(t.where("table_id < 0"), t.where("table_id >= 0")).select("doc_id", "table_id", "page")


TABS = "WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS table_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey * 7 % 60 AS INT) END AS page, o_orderstatus AS status FROM orders)"


def _tables(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table_id"), F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") * 7 % 60).cast("int")).alias("page"), F.col("o_orderstatus").alias("status"))


@query(" SELECT doc_id, table_id, least(greatest(max(page) OVER (PARTITION BY doc_id ORDER BY table_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 50) AS page, status FROM t", TABS)
def monotone_pages(spark: SparkSession, d: str) -> DataFrame:
    return G.monotone_pages(_tables(spark, d), 50)


@query(", p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY table_id) AS pos FROM t), w AS (SELECT *, last_value(CASE WHEN page IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS ap, last_value(page IGNORE NULLS) OVER a AS av, first_value(CASE WHEN page IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS bp, first_value(page IGNORE NULLS) OVER b AS bv FROM p WINDOW a AS (PARTITION BY doc_id ORDER BY table_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY doc_id ORDER BY table_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT doc_id, table_id, status, CAST(round_even(coalesce(av + (bv - av) * (pos - ap) / CAST(greatest(bp - ap, 1) AS DOUBLE), av, bv), 0) AS INT) AS page FROM w", TABS)
def interpolate_pages(spark: SparkSession, d: str) -> DataFrame:
    return G.interpolated_pages(_tables(spark, d))


@query(" SELECT *, lag(table_id) OVER (PARTITION BY doc_id, status ORDER BY table_id) AS target FROM t", TABS)
def merge_previous(spark: SparkSession, d: str) -> DataFrame:
    return C.merge_to_previous(_tables(spark, d))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def llm_json_parse(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Result: "), "props", F.lit(" done.")))
    return e.select("event_id", T.json_object(raw, "k int")["k"].alias("k"))


LEVEL = "CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'unresolvable' END"
LEVEL2 = LEVEL.replace("event_id % 4", "user_id % 4")


@query(f"SELECT event_id, CASE greatest(event_id % 4, user_id % 4) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'unresolvable' END AS level FROM events")
def min_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", T.worse_confidence(F.expr(LEVEL), F.expr(LEVEL2)).alias("level"))


@query("SELECT g AS gram, count(DISTINCT item_id) AS n FROM (SELECT item_id, lower(text)[i:i+3] AS g FROM benchmark, (SELECT unnest(range(1, 100000)) AS i) r WHERE i <= length(text) - 3) x GROUP BY 1 HAVING count(DISTINCT item_id) > 3")
def ngram_pages(spark: SparkSession, d: str) -> DataFrame:
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    return b.select("item_id", F.explode(T.char_ngrams(F.col("text"), 4)).alias("gram")).groupBy("gram").agg(F.countDistinct("item_id").alias("n")).where("n > 3")


@query(f" SELECT DISTINCT c.table_id, c.row_idx, c.col_idx FROM cells c JOIN (SELECT table_id % 10 AS pg, {KEY} AS k FROM cells WHERE col_idx = 3 AND row_idx = 0) o ON o.pg = c.table_id % 10 AND o.k = {KEY.replace('text', 'c.text')} WHERE c.col_idx = 3 AND c.row_idx > 0", CELLS_SQL)
def restore_cells(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).where("col_idx = 3").withColumns({"page_number": F.col("table_id") % 10, "key": T.lookup_key(F.col("text"))})
    return J.restore(c.where("row_idx > 0"), c.where("row_idx = 0")).select("table_id", "row_idx", "col_idx")


SPAN = f", span AS (SELECT *, min(CASE WHEN {S} <> '' THEN col_idx END) OVER (PARTITION BY table_id, row_idx) AS lo, max(CASE WHEN {S} <> '' THEN col_idx END) OVER (PARTITION BY table_id, row_idx) AS hi FROM cells)"
#: The cells with a seventh taken out, so that rows differ in width.
RAGGED = CELLS_SQL.replace(", cells AS (", ", whole AS (") + ", cells AS (SELECT * FROM whole WHERE (table_id + row_idx + col_idx) % 7 <> 0)"


def _ragged(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).where("(table_id + row_idx + col_idx) % 7 <> 0")


@query(SPAN + " SELECT table_id, row_idx, col_idx - coalesce(lo, 0) AS col_idx, text FROM span WHERE lo IS NULL OR col_idx BETWEEN lo AND hi", CELLS_SQL)
def trim_row_edges(spark: SparkSession, d: str) -> DataFrame:
    return E.trim_row_edges(cells(spark, d))


@query(SPAN + ", moved AS (SELECT table_id, row_idx, col_idx, lo, list(text) OVER (PARTITION BY table_id, row_idx ORDER BY col_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS texts, hi FROM span) SELECT table_id, row_idx, col_idx, coalesce(CASE WHEN lo IS NULL OR col_idx + lo <= hi THEN texts[col_idx + coalesce(lo, 0) + 1] END, '') AS text FROM moved", CELLS_SQL)
def shift_rows_left(spark: SparkSession, d: str) -> DataFrame:
    return E.shift_rows_left(cells(spark, d))


@query(f", shape AS (SELECT table_id, max(col_idx) + 1 AS width, min(CASE WHEN {S} <> '' THEN row_idx END) AS top, max(CASE WHEN {S} <> '' THEN row_idx END) AS bottom FROM cells GROUP BY 1), r AS (SELECT table_id, width, top, unnest(range(top, bottom + 1)) AS rr FROM shape WHERE top IS NOT NULL), slots AS (SELECT table_id, top, rr, unnest(range(width)) AS cc FROM r) SELECT s.table_id, CAST(rr - top AS INT) AS row_idx, CAST(cc AS INT) AS col_idx, text FROM slots s LEFT JOIN cells c ON c.table_id = s.table_id AND c.row_idx = rr AND c.col_idx = cc", RAGGED)
def pad_to_width(spark: SparkSession, d: str) -> DataFrame:
    return E.pad_to_width(_ragged(spark, d))


#: Every second row repeats the row above it in part.
ECHO = "CASE WHEN row_idx % 2 = 0 THEN text WHEN col_idx < 3 THEN lag(text) OVER (PARTITION BY table_id, col_idx ORDER BY row_idx) ELSE '' END"
ECHO_SQL = CELLS_SQL.replace(", cells AS (", ", whole AS (") + f", cells AS (SELECT table_id, row_idx, col_idx, {ECHO} AS text FROM whole)"
SUBSET = f""", r AS (SELECT table_id, row_idx, max(CASE WHEN col_idx = 0 THEN {S} END) AS label, coalesce(list(DISTINCT {KEY}) FILTER ({S} <> ''), []) AS held FROM cells GROUP BY 1, 2),
n AS (SELECT *, lead(label) OVER w AS nl, lead(held) OVER w AS nh FROM r WINDOW w AS (PARTITION BY table_id ORDER BY row_idx)),
o AS (SELECT *, coalesce(label <> '' AND label = nl AND len(held) > 0 AND list_has_all(nh, held) AND len(nh) > len(held), false) AS fg, coalesce(label <> '' AND label = nl AND len(nh) > 0 AND list_has_all(held, nh) AND len(held) > len(nh), false) AS sg FROM n),
g AS (SELECT *, count(*) FILTER (NOT sg) OVER (PARTITION BY table_id ORDER BY row_idx) AS run FROM o),
a AS (SELECT *, sg AND count(*) FILTER (sg) OVER (PARTITION BY table_id, run ORDER BY row_idx) % 2 = 1 AS acts FROM g),
kept AS (SELECT table_id, row_idx FROM (SELECT *, fg OR coalesce(lag(acts) OVER (PARTITION BY table_id ORDER BY row_idx), false) AS gone FROM a) x WHERE NOT gone),
m AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_idx) - 1 AS place FROM kept)
SELECT table_id, CAST(place AS INT) AS row_idx, col_idx, text FROM cells JOIN m USING (table_id, row_idx)"""


@query(SUBSET, ECHO_SQL)
def drop_subset_rows(spark: SparkSession, d: str) -> DataFrame:
    return E.drop_subset_rows(cells(spark, d).withColumn("text", F.expr(ECHO)))


@query(f" SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id, col_idx ORDER BY row_idx) - 1 AS INT) AS row_idx, col_idx, text FROM cells WHERE (table_id + row_idx) % 3 <> 0", CELLS_SQL)
def delete_rows(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return E.delete_rows(c, c.where("(table_id + row_idx) % 3 = 0"))


@query(" , e AS (SELECT *, least(2, max(row_idx) OVER (PARTITION BY table_id) + 1) AS spot FROM cells) SELECT table_id, row_idx + CAST(row_idx >= spot AS INT) AS row_idx, col_idx, text FROM e UNION ALL SELECT DISTINCT table_id, spot, col_idx, '' FROM e", CELLS_SQL)
def insert_row(spark: SparkSession, d: str) -> DataFrame:
    return E.insert_blank(cells(spark, d), "row_idx", 2)


@query(" SELECT table_id, row_idx, col_idx + CAST(col_idx >= 1 AS INT) AS col_idx, text FROM cells UNION ALL SELECT DISTINCT table_id, row_idx, 1, '' FROM cells", CELLS_SQL)
def insert_column(spark: SparkSession, d: str) -> DataFrame:
    return E.insert_blank(cells(spark, d), "col_idx", 1)


SCORED = f"regexp_matches(replace(replace(replace({S}, ',', ''), '(', '-'), ')', ''), '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*%?$')"


@query(f""", r AS (SELECT table_id, row_idx, count(*) AS w, count(*) FILTER ({S} = '') AS e, count(*) FILTER ({SCORED}) AS num FROM cells GROUP BY 1, 2),
p AS (SELECT table_id, count(*) AS n, stddev_samp(w) AS sd, avg(w) AS mean, sum(e) * 1.0 / sum(w) AS e, sum(num) * 1.0 / sum(w) AS num FROM r GROUP BY 1)
SELECT table_id, CASE WHEN n < 2 THEN 0.0 ELSE round(least(1.0, (greatest(0.0, 1 - 2 * sd / mean) * 0.35 + CASE WHEN e < 0.05 THEN 0.7 WHEN e > 0.5 THEN 0.3 ELSE 1 - e END * 0.25 + least(num * 2, 1.0) * 0.25) / 0.85 + CASE WHEN table_id % 4 = 0 THEN 0.15 ELSE 0 END), 6) END AS confidence FROM p""", RAGGED)
def table_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = _ragged(spark, d)
    return E.table_confidence(c, c.where("table_id % 4 = 0").select("table_id").distinct()).withColumn("confidence", F.round("confidence", 6))


STRICT_VALUE = "TRY_CAST(" + _signed(f"replace(regexp_replace({S}, '%+$', ''), ',', '')") + " AS DOUBLE)"


@query(f""", v AS (SELECT table_id, row_idx, col_idx, {STRICT_VALUE} AS value FROM cells WHERE {STRICT}),
t AS (SELECT table_id, min(col_idx) AS col_idx, arg_min(value, col_idx) AS total FROM v WHERE row_idx = 0 GROUP BY 1),
s AS (SELECT t.table_id, t.col_idx, total, sum(value) AS cs FROM t JOIN v ON v.table_id = t.table_id AND v.col_idx = t.col_idx AND v.row_idx BETWEEN 1 AND 2 GROUP BY ALL)
SELECT table_id, 0 AS total_row, col_idx, total, round(cs, 4) AS child_sum, CASE WHEN abs(total) > 0.01 THEN abs(cs - total) / abs(total) ELSE abs(cs - total) END <= 0.01 AS verified FROM s""", CELLS_SQL)
def check_totals(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    entries = c.select("table_id").distinct().select("table_id", F.lit(0).alias("total_row"), F.array(F.lit(1), F.lit(2)).alias("children"))
    return E.check_totals(c, entries).withColumn("child_sum", F.round("child_sum", 4)).drop("children")


@query(f", g AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY {PG} ORDER BY y0) AS gap FROM (SELECT DISTINCT {PG}, y0 FROM items WHERE {S} <> '') x), p AS (SELECT {PG}, count(*) AS n, count(*) FILTER (gap > 0.5 AND gap < 50) AS n_gaps, median(gap) FILTER (gap > 0.5 AND gap < 50) AS middle FROM g GROUP BY 1, 2) SELECT {PG}, round(CASE WHEN n >= 5 AND n_gaps >= 3 THEN greatest(2.0, least(15.0, middle * 0.4)) ELSE 5.0 END, 6) AS threshold FROM p", ITEMS_SQL)
def row_threshold(spark: SparkSession, d: str) -> DataFrame:
    return G.row_threshold(items(spark, d)).withColumn("threshold", F.round("threshold", 6))


@query(f" SELECT {PG}, font_size, greatest(font_size * 0.5, 4.0) AS threshold FROM (SELECT {PG}, coalesce(median(y1 - y0) FILTER (y1 > y0), 10.0) AS font_size FROM items GROUP BY 1, 2) x", ITEMS_SQL)
def font_threshold(spark: SparkSession, d: str) -> DataFrame:
    return G.font_threshold(items(spark, d))


@query(f", r AS (SELECT *, row_number() OVER (PARTITION BY {PG}, y0 ORDER BY x0, x1, item_id) AS place FROM items), s AS (SELECT {PG}, place, min(x0) AS x0, max(x1) AS x1 FROM r WHERE x0 > 0 AND x1 > 0 GROUP BY 1, 2, 3) SELECT {PG}, CAST(row_number() OVER (PARTITION BY {PG} ORDER BY place) - 1 AS INT) AS col_idx, x0, x1 FROM s", ITEMS_SQL)
def column_spans(spark: SparkSession, d: str) -> DataFrame:
    return G.column_spans(items(spark, d).withColumn("row_idx", F.col("y0")))


SHAPED = TABS + ", s AS (SELECT doc_id, table_id, CAST(table_id * 7 % 5 AS INT) AS page, CAST(table_id * 3 % 8 AS INT) AS n_cols FROM t)"


@query(", b AS (SELECT *, lag(table_id) OVER w AS pt, lag(page) OVER w AS pp, lag(n_cols) OVER w AS pc FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY table_id)) SELECT doc_id, table_id, page, n_cols, CASE WHEN page IN (pp, pp + 1) AND n_cols > 0 AND pc > 0 AND abs(n_cols - pc) <= 2 THEN pt END AS continues FROM b", SHAPED)
def continuation_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d).select("doc_id", "table_id", (F.col("table_id") * 7 % 5).cast("int").alias("page"), (F.col("table_id") * 3 % 8).cast("int").alias("n_cols"))
    return G.continuation_candidates(t)


@query(f" SELECT {AT}, trim(regexp_replace({S}, '[^0-9,.\\-()%\\s]', '', 'g')) AS text FROM cells", CELLS_SQL)
def numeric_characters(spark: SparkSession, d: str) -> DataFrame:
    return E.numeric_characters(cells(spark, d))


@query(f""", c AS (SELECT table_id, dense_rank() OVER (PARTITION BY table_id ORDER BY row_idx) - 1 AS r, col_idx, {S} AS text FROM cells WHERE EXISTS (SELECT 1 FROM cells o WHERE o.table_id = cells.table_id AND o.row_idx = cells.row_idx AND {S.replace('text', 'o.text')} <> '')),
w AS (SELECT table_id, max(col_idx) AS last FROM c WHERE r = 0 GROUP BY 1), n AS (SELECT c.* FROM c JOIN w USING (table_id) WHERE col_idx <= last),
k AS (SELECT table_id, col_idx, row_number() OVER (PARTITION BY table_id ORDER BY col_idx) - 1 AS place FROM (SELECT DISTINCT table_id, col_idx FROM n WHERE text <> '') x)
SELECT s.table_id, CAST(s.r AS INT) AS row_idx, CAST(place AS INT) AS col_idx, coalesce(n.text, '') AS text FROM (SELECT DISTINCT table_id, r FROM n) s JOIN k USING (table_id) LEFT JOIN n ON n.table_id = s.table_id AND n.r = s.r AND n.col_idx = k.col_idx""", RAGGED)
def dense_grid(spark: SparkSession, d: str) -> DataFrame:
    return E.dense_grid(_ragged(spark, d))


@query(""", sh AS (SELECT table_id, max(row_idx) + 1 AS n_rows, max(col_idx) + 1 AS width FROM cells GROUP BY 1),
mv AS (SELECT a.table_id AS source, b.table_id AS target, b.width, b.n_rows + coalesce(sum(a.n_rows) OVER (PARTITION BY b.table_id ORDER BY a.table_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sh a JOIN sh b ON b.table_id = a.table_id // 4 * 4 WHERE a.table_id % 4 IN (1, 3)),
sl AS (SELECT *, unnest(range(width)) AS c FROM (SELECT DISTINCT table_id, row_idx FROM cells) x JOIN mv ON source = table_id)
SELECT * FROM cells WHERE table_id NOT IN (SELECT source FROM mv)
UNION ALL SELECT target, CAST(sl.row_idx + below AS INT), CAST(c AS INT), CASE WHEN o.table_id IS NULL THEN '' ELSE o.text END FROM sl LEFT JOIN cells o ON o.table_id = source AND o.row_idx = sl.row_idx AND o.col_idx = c""", RAGGED)
def append_tables(spark: SparkSession, d: str) -> DataFrame:
    c = _ragged(spark, d)
    pairs = c.where("table_id % 4 in (1, 3)").select(F.col("table_id").alias("source"), F.expr("table_id div 4 * 4").alias("target")).distinct()
    return E.append_tables(c, pairs)


from . import layout_queries, list_queries, repair_queries, sheet_queries  # noqa: E402, F401  (register their queries)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

