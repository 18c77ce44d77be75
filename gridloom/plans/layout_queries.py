"""Queries of page layout: rows, columns, drawings, regions and grids, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import geometry as G
from ..operators import joins as J
from ..operators import layout as L
from ..sources.derived import DRAWINGS_SQL, ITEMS_SQL, drawings, items
from .queries import query
from .sheet_queries import CJK, drop, m, signed

PG = "doc_id, page_number"
WIDTH, HEIGHT = 600.0, 730.0
RECURSIVE = ITEMS_SQL.replace("WITH items", "WITH RECURSIVE items")
GAPS = f", g AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY {PG} ORDER BY y0) AS gap FROM (SELECT DISTINCT {PG}, y0 FROM items) x), th AS (SELECT {PG}, CASE WHEN count(*) >= 5 AND count(*) FILTER (gap > 0.5 AND gap < 50) >= 3 THEN greatest(2.0, least(15.0, median(gap) FILTER (gap > 0.5 AND gap < 50) * 0.4)) ELSE 5.0 END AS lim FROM g GROUP BY 1, 2)"
FONT = f", th AS (SELECT {PG}, greatest(coalesce(median(y1 - y0) FILTER (y1 > y0), 10.0) * 0.5, 4.0) AS lim FROM items GROUP BY 1, 2)"


def _fold(key: str, follow: bool) -> str:
    place = f"(f.spot + s.{key}) / 2" if follow else "f.spot"
    return f""", s AS (SELECT items.*, (y0 + y1) / 2 AS y_mid, row_number() OVER (PARTITION BY {PG} ORDER BY {'y0' if key == 'y0' else '(y0 + y1) / 2'}, item_id) AS pos FROM items),
 f AS (SELECT {PG}, item_id, pos, {key} AS spot, 0 AS row_idx FROM s WHERE pos = 1 UNION ALL SELECT s.doc_id, s.page_number, s.item_id, s.pos, CASE WHEN abs(s.{key} - f.spot) <= lim THEN {place} ELSE s.{key} END, f.row_idx + CASE WHEN abs(s.{key} - f.spot) <= lim THEN 0 ELSE 1 END
 FROM f JOIN s ON s.doc_id = f.doc_id AND s.page_number = f.page_number AND s.pos = f.pos + 1 JOIN th ON th.doc_id = s.doc_id AND th.page_number = s.page_number)"""


@query(GAPS + _fold("y0", True) + f" SELECT {PG}, item_id, row_idx FROM f", RECURSIVE)
def word_rows(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return L.word_rows(i, G.row_threshold(i)).select("doc_id", "page_number", "item_id", "row_idx")


@query(FONT + _fold("y_mid", False) + f" SELECT {PG}, item_id, row_idx FROM f", RECURSIVE)
def leader_rows(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return L.leader_rows(i, G.font_threshold(i)).select("doc_id", "page_number", "item_id", "row_idx")


@query(GAPS + _fold("y0", True) + f" SELECT {PG}, row_idx, min(y0) AS top, max(y1) AS bottom FROM f JOIN items USING ({PG}, item_id) GROUP BY ALL", RECURSIVE)
def text_bands(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return L.text_bands(i, G.row_threshold(i))


@query(f", y AS (SELECT *, lead(y0) OVER (PARTITION BY {PG} ORDER BY y0) - y0 AS gap, count(*) OVER (PARTITION BY {PG}) AS n FROM (SELECT DISTINCT {PG}, y0 FROM items) x) SELECT {PG}, y0 + gap / 2 AS boundary FROM y WHERE gap > 5 UNION ALL SELECT {PG}, y0 FROM y WHERE n = 1", ITEMS_SQL)
def row_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return L.row_boundaries(items(spark, d))


@query(f", b AS (SELECT DISTINCT {PG}, floor(x / 20) AS b FROM (SELECT {PG}, x0 AS x FROM items UNION ALL SELECT {PG}, x1 FROM items) u), n AS (SELECT *, lead(b) OVER (PARTITION BY {PG} ORDER BY b) AS nx FROM b), p AS (SELECT {PG}, count(*) AS n FROM b GROUP BY 1, 2) SELECT {PG}, (b * 20 + 10 + nx * 20) / 2 AS boundary FROM n WHERE nx IS NOT NULL UNION ALL SELECT {PG}, unnest(CASE WHEN n = 1 THEN [0.0, {WIDTH}] ELSE [0.0, {WIDTH}] END) FROM p", ITEMS_SQL)
def spacing_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return L.spacing_boundaries(items(spark, d), WIDTH)


KINDS = ", d0 AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM drawings), d AS (SELECT *, CASE WHEN w < h * 0.3 OR h < w * 0.3 THEN 'line' ELSE 'rect' END AS kind, CASE WHEN w > h * 5 THEN 'h' WHEN h > w * 5 THEN 'v' END AS direction FROM d0)"


@query(KINDS + f" SELECT {PG}, drawing_id, kind, direction FROM d", ITEMS_SQL + DRAWINGS_SQL)
def drawing_kinds(spark: SparkSession, d: str) -> DataFrame:
    return L.classified(drawings(spark, d)).select("doc_id", "page_number", "drawing_id", "kind", "direction")


@query(KINDS + f""", bx AS (SELECT {PG}, x0, y0, x1, y1 FROM d WHERE kind = 'rect' AND w > {WIDTH * 0.3} AND h > 20), hl AS (SELECT {PG}, count(*) AS n, min(y0) AS y0, max(y1) AS y1 FROM d WHERE kind = 'line' AND direction = 'h' AND w > {WIDTH * 0.3} GROUP BY 1, 2), vl AS (SELECT {PG}, count(*) AS n, min(x0) AS x0, max(x1) AS x1 FROM d WHERE kind = 'line' AND direction = 'v' AND h > 20 GROUP BY 1, 2),
 rl AS (SELECT hl.doc_id, hl.page_number, vl.x0, hl.y0, vl.x1, hl.y1 FROM hl JOIN vl USING ({PG}) WHERE hl.n >= 2 AND vl.n >= 2 AND vl.x1 - vl.x0 > {WIDTH * 0.3} AND hl.y1 - hl.y0 > 20)
 SELECT * FROM bx UNION ALL SELECT * FROM rl WHERE NOT EXISTS (SELECT 1 FROM bx WHERE bx.doc_id = rl.doc_id AND bx.page_number = rl.page_number AND bx.x1 > rl.x0 AND bx.x0 < rl.x1 AND bx.y1 > rl.y0 AND bx.y0 < rl.y1)""", ITEMS_SQL + DRAWINGS_SQL)
def drawn_regions(spark: SparkSession, d: str) -> DataFrame:
    return L.drawn_regions(drawings(spark, d), WIDTH)


@query(KINDS + f" SELECT * FROM (SELECT {PG}, y0 AS top, lead(y0) OVER (PARTITION BY {PG} ORDER BY y0) AS bottom FROM (SELECT DISTINCT {PG}, y0 FROM d WHERE kind = 'line' AND direction = 'h' AND w > {WIDTH * 0.3}) x) z WHERE bottom IS NOT NULL", ITEMS_SQL + DRAWINGS_SQL)
def line_bands(spark: SparkSession, d: str) -> DataFrame:
    return L.line_bands(drawings(spark, d), WIDTH)


def _cluster(x: str) -> str:
    return f"SELECT {PG}, round(avg({x}), 4) AS center FROM (SELECT {PG}, {x}, sum(CASE WHEN {x} - prev > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY {PG} ORDER BY {x}, item_id) AS isl FROM (SELECT *, lag({x}) OVER (PARTITION BY {PG} ORDER BY {x}, item_id) AS prev FROM items) a) b GROUP BY {PG}, isl HAVING count(*) >= 3"


@query(KINDS + f""", vd AS (SELECT {PG}, list(x ORDER BY x) AS drawn, count(*) FILTER (x > {WIDTH * 0.05} AND x < {WIDTH * 0.95}) AS inr FROM (SELECT DISTINCT {PG}, x0 AS x FROM d WHERE kind = 'line' AND direction = 'v') q GROUP BY 1, 2), al AS (SELECT {PG}, list(center ORDER BY center) AS al FROM ({_cluster('x0')} UNION {_cluster('x1')}) c GROUP BY 1, 2),
 xs AS (SELECT *, lead(x) OVER (PARTITION BY {PG} ORDER BY x) - x AS gap FROM (SELECT {PG}, x0 AS x FROM items UNION SELECT {PG}, x1 FROM items) u), pr AS (SELECT {PG}, count(*) AS n, greatest(median(gap) + CASE WHEN count(gap) >= 2 THEN stddev_samp(gap) ELSE median(gap) * 0.5 END * 0.3, 10.0) AS lim FROM xs GROUP BY 1, 2),
 wd AS (SELECT {PG}, list(x + gap / 2 ORDER BY x) AS wd FROM xs JOIN pr USING ({PG}) WHERE n >= 3 AND gap > lim GROUP BY 1, 2),
 o AS (SELECT {PG}, CASE WHEN len(drawn) >= 3 AND inr >= 2 THEN drawn WHEN len(al) >= 3 THEN al ELSE list_concat([0.0], coalesce(wd, []), [{WIDTH}]) END AS b FROM (SELECT DISTINCT {PG} FROM items) i LEFT JOIN vd USING ({PG}) LEFT JOIN al USING ({PG}) LEFT JOIN wd USING ({PG}))
 SELECT {PG}, CAST(unnest(range(len(b))) AS INT) AS k, unnest(b) AS boundary FROM o""", ITEMS_SQL + DRAWINGS_SQL)
def column_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.column_lines(items(spark, d), drawings(spark, d), WIDTH)


BANDS = f""", cn AS (SELECT {PG}, floor((y0 + y1) / 2 / 73) AS gr, count(*) AS n FROM items WHERE floor((y0 + y1) / 2 / 73) BETWEEN 0 AND 9 AND floor((x0 + x1) / 2 / 60) BETWEEN 0 AND 9 GROUP BY 1, 2, 3),
 wc AS (SELECT {PG}, count(*) AS words FROM items GROUP BY 1, 2), dn AS (SELECT *, gr - row_number() OVER (PARTITION BY {PG} ORDER BY gr) AS run FROM (SELECT *, 0.8 * greatest(sum(n) OVER (PARTITION BY {PG}) / 10.0, 3) AS lim FROM cn) q WHERE n > lim),
 bd AS (SELECT {PG}, min(gr) * 73.0 AS top, (max(gr) + 1) * 73.0 AS bottom FROM dn GROUP BY {PG}, run)"""


@query(BANDS + f" SELECT {PG}, top, bottom FROM bd JOIN wc USING ({PG}) WHERE words >= 20", ITEMS_SQL)
def dense_bands(spark: SparkSession, d: str) -> DataFrame:
    return L.dense_bands(items(spark, d), WIDTH, HEIGHT, 20)


REGIONS = BANDS + f""", bo AS (SELECT bd.doc_id, bd.page_number, top, bottom, least(min(x0), {WIDTH}) AS lo, greatest(max(x1), 0.0) AS hi FROM bd JOIN items USING ({PG}) WHERE (y0 + y1) / 2 BETWEEN top AND bottom GROUP BY ALL),
 bx AS (SELECT {PG}, top, bottom, CASE WHEN lo < hi THEN lo ELSE 0 END AS lo, CASE WHEN lo < hi THEN hi ELSE {WIDTH} END AS hi FROM bo),
 rg AS (SELECT {PG}, CAST(row_number() OVER (PARTITION BY {PG} ORDER BY top) - 1 AS INT) AS region_idx, greatest(0.0, lo - 10) AS r_x0, top AS r_y0, least({WIDTH}, hi + 10) AS r_x1, bottom AS r_y1 FROM bx WHERE hi - lo >= {WIDTH * 0.3} AND bottom - top >= 20)"""


@query(REGIONS + " SELECT * FROM rg", ITEMS_SQL)
def text_regions(spark: SparkSession, d: str) -> DataFrame:
    return L.text_regions(items(spark, d), WIDTH, HEIGHT)


MET = f""", mt AS (SELECT i.*, r.region_idx, r_x0, r_y0, r_x1, r_y1, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM items i JOIN rg r ON r.doc_id = i.doc_id AND r.page_number = i.page_number),
 ins AS (SELECT {PG}, region_idx, string_agg(text, ' ' ORDER BY cy, cx, item_id) AS t, count(*) AS n FROM mt WHERE cx BETWEEN r_x0 AND r_x1 AND cy BETWEEN r_y0 AND r_y1 GROUP BY 1, 2, 3),
 ctx AS (SELECT {PG}, region_idx, string_agg(text, ' ' ORDER BY cy, cx, item_id) AS t FROM mt WHERE cy BETWEEN greatest(0.0, r_y0 - 100) AND r_y0 AND abs(cx - (r_x0 + r_x1) / 2) <= (r_x1 - r_x0) * 0.75
 AND NOT EXISTS (SELECT 1 FROM rg o WHERE o.doc_id = mt.doc_id AND o.page_number = mt.page_number AND o.region_idx < mt.region_idx AND cx BETWEEN o.r_x0 * 0.9 AND o.r_x1 * 1.1 AND cy BETWEEN o.r_y0 * 0.9 AND o.r_y1 * 1.1) GROUP BY 1, 2, 3)"""


@query(REGIONS + MET + f" SELECT {PG}, region_idx, coalesce(ins.t, '') AS region_text, coalesce(ctx.t, '') AS context_text, round(least(0.5 + CASE WHEN (r_x1 - r_x0) / {WIDTH} >= 0.5 THEN 0.2 WHEN (r_x1 - r_x0) / {WIDTH} >= 0.3 THEN 0.1 ELSE 0 END + CASE WHEN n >= 20 THEN 0.2 WHEN n >= 10 THEN 0.1 ELSE 0 END + CASE WHEN ctx.t <> '' THEN 0.1 ELSE 0 END, 1.0)::DOUBLE, 4) AS confidence FROM rg LEFT JOIN ins USING ({PG}, region_idx) LEFT JOIN ctx USING ({PG}, region_idx)", ITEMS_SQL)
def region_texts(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return L.region_texts(i, L.text_regions(i, WIDTH, HEIGHT), WIDTH).select("doc_id", "page_number", "region_idx", "region_text", "context_text", F.round("confidence", 4).alias("confidence"))


REG = f", rg AS (SELECT DISTINCT {PG}, k AS region_idx, 20.0 AS r_x0, 300.0 AS r_x1, 100.0 + 250 * k AS r_y0, 200.0 + 250 * k AS r_y1 FROM items, (SELECT unnest(range(2)) AS k) z)"


def _regions(i: DataFrame) -> DataFrame:
    r = i.select("doc_id", "page_number").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("region_idx"))
    return r.select("*", F.lit(20.0).alias("r_x0"), F.lit(300.0).alias("r_x1"), (F.col("region_idx") * 250 + 100.0).alias("r_y0"), (F.col("region_idx") * 250 + 200.0).alias("r_y1"))


@query(REG + f" SELECT {PG}, item_id FROM items i WHERE NOT EXISTS (SELECT 1 FROM rg r WHERE r.doc_id = i.doc_id AND r.page_number = i.page_number AND (x0 + x1) / 2 BETWEEN r_x0 * 0.9 AND r_x1 * 1.1 AND (y0 + y1) / 2 BETWEEN r_y0 * 0.9 AND r_y1 * 1.1)", ITEMS_SQL)
def outside_scaled_regions(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return L.outside_scaled(i, _regions(i)).select("doc_id", "page_number", "item_id")


@query(REG + f""", w AS (SELECT i.doc_id, i.page_number, region_idx, y0, text, row_number() OVER (PARTITION BY i.doc_id, i.page_number, region_idx ORDER BY y0, x0, item_id) AS pos FROM items i JOIN rg r ON r.doc_id = i.doc_id AND r.page_number = i.page_number WHERE y0 >= greatest(0.0, r_y0 - 100) AND y0 < r_y0 AND x1 > r_x0 * 0.8 AND x0 < r_x1 * 1.2),
 f AS (SELECT {PG}, region_idx, pos, y0 AS spot, text AS out FROM w WHERE pos = 1 UNION ALL SELECT w.doc_id, w.page_number, w.region_idx, w.pos, CASE WHEN abs(w.y0 - f.spot) <= 5 THEN f.spot ELSE w.y0 END, f.out || CASE WHEN abs(w.y0 - f.spot) <= 5 THEN ' ' ELSE chr(10) END || w.text FROM f JOIN w ON w.doc_id = f.doc_id AND w.page_number = f.page_number AND w.region_idx = f.region_idx AND w.pos = f.pos + 1)
 SELECT {PG}, region_idx, arg_max(out, pos) AS context FROM f GROUP BY 1, 2, 3""", RECURSIVE)
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return L.words_above(i, _regions(i))


COLS = f""", st AS (SELECT *, lag(x0) OVER (PARTITION BY {PG} ORDER BY x0, item_id) AS bf FROM items WHERE x1 > x0), mn AS (SELECT {PG}, avg(x0 - bf) AS mean FROM st WHERE x0 > bf GROUP BY 1, 2),
 ch AS (SELECT st.*, mean, sum(CASE WHEN x0 - bf > greatest(mean * 2.5, 8.0) THEN 1 ELSE 0 END) OVER (PARTITION BY {PG} ORDER BY x0, item_id) AS isl FROM st LEFT JOIN mn USING ({PG})),
 r0 AS (SELECT {PG}, isl, min(x0) AS c0, CASE WHEN max(mean) IS NULL THEN arg_max(x1, item_id) ELSE max(x1) END AS c1 FROM ch GROUP BY 1, 2, 3),
 hm AS (SELECT i.doc_id, i.page_number, i.item_id, min(isl) AS isl FROM items i JOIN r0 ON r0.doc_id = i.doc_id AND r0.page_number = i.page_number AND x0 BETWEEN c0 AND c1 WHERE x1 > x0 GROUP BY 1, 2, 3),
 ct AS (SELECT {PG}, isl, count(*) AS n FROM hm GROUP BY 1, 2, 3), r1 AS (SELECT r0.*, coalesce(n, 0) AS n, (c0 + c1) / 2 AS ce, max(coalesce(n, 0)) OVER (PARTITION BY {PG}) AS mx, count(*) OVER (PARTITION BY {PG}) AS k FROM r0 LEFT JOIN ct USING ({PG}, isl)),
 r2 AS (SELECT *, k > 1 AND n < greatest(floor(mx * 0.15), 3) AS sp FROM r1),
 tg AS (SELECT a.doc_id, a.page_number, a.c0, a.c1, CASE WHEN a.sp THEN (SELECT b.isl FROM r2 b WHERE b.doc_id = a.doc_id AND b.page_number = a.page_number AND NOT b.sp ORDER BY abs(b.ce - a.ce), b.isl LIMIT 1) ELSE a.isl END AS home FROM r2 a),
 cols AS (SELECT {PG}, CAST(row_number() OVER (PARTITION BY {PG} ORDER BY home) - 1 AS INT) AS col_idx, c0, c1 FROM (SELECT {PG}, home, min(c0) AS c0, max(c1) AS c1 FROM tg WHERE home IS NOT NULL GROUP BY 1, 2, 3) z)"""


@query(COLS + " SELECT * FROM cols", ITEMS_SQL)
def column_ranges(spark: SparkSession, d: str) -> DataFrame:
    return L.column_ranges(items(spark, d))


IOU = f""", ov AS (SELECT i.*, col_idx, greatest(0.0, least(x1, c1) - greatest(x0, c0)) / (greatest(x1, c1) - least(x0, c0)) AS o, (x0 + x1) / 2 BETWEEN c0 AND c1 AS ce FROM items i JOIN cols c ON c.doc_id = i.doc_id AND c.page_number = i.page_number),
 pk AS (SELECT {PG}, item_id, CASE WHEN max(o) >= 0.5 THEN arg_max(col_idx, o - col_idx * 1e-9) ELSE min(col_idx) FILTER (ce) END AS col_idx FROM ov GROUP BY 1, 2, 3)"""


@query(COLS + IOU + f" SELECT {PG}, item_id, col_idx FROM pk", ITEMS_SQL)
def overlap_columns(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return L.overlap_column(i, L.column_ranges(i)).select("doc_id", "page_number", "item_id", "col_idx")


LABELLED = "CASE item_id % 5 WHEN 0 THEN '资产' WHEN 1 THEN '1,234' WHEN 2 THEN '3.5%' WHEN 3 THEN '1234567' ELSE text END"
LABELLED_SQL = ITEMS_SQL.replace("WITH items", "WITH plain_items") + f", items AS (SELECT doc_id, page_number, item_id, {LABELLED} AS text, x0, y0, x1, y1 FROM plain_items)"
KIND = f"CASE WHEN {m('text', '%$')} THEN 'percent' WHEN {m('text', CJK)} THEN 'label' WHEN NOT {m('text', '[0-9]')} THEN 'mixed' WHEN length(regexp_replace(regexp_extract({signed(drop('text', ', '))}, '-?[0-9]+\\.?[0-9]*'), '[-.]', '', 'g')) >= 6 THEN 'amount' ELSE 'number' END"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).withColumn("text", F.expr(LABELLED))


@query(COLS + IOU + f""", kd AS (SELECT {PG}, pk.col_idx, {KIND} AS kind, count(*) AS n, min(seen) AS fs FROM pk JOIN (SELECT *, row_number() OVER (PARTITION BY {PG} ORDER BY (y0 + y1) / 2, x0, item_id) AS seen FROM items) items USING ({PG}, item_id) WHERE pk.col_idx IS NOT NULL GROUP BY 1, 2, 3, 4),
 tp AS (SELECT *, row_number() OVER (PARTITION BY {PG}, col_idx ORDER BY n DESC, fs) AS o, sum(n) OVER (PARTITION BY {PG}, col_idx) AS total FROM kd)
 SELECT {PG}, col_idx, c0, c1, coalesce(total, 0)::BIGINT AS total_items, CASE WHEN total IS NULL THEN 'empty' WHEN n < 3 AND n * 1.0 / total < 0.3 THEN 'mixed' ELSE kind END AS dominant_type FROM cols LEFT JOIN (SELECT * FROM tp WHERE o = 1) t USING ({PG}, col_idx)""", LABELLED_SQL)
def column_schema(spark: SparkSession, d: str) -> DataFrame:
    i = _labelled(spark, d)
    return L.column_schema(i, L.column_ranges(i))


@query(f", w AS (SELECT *, count(*) OVER (PARTITION BY {PG}, y0) AS n FROM items), b AS (SELECT {PG}, arg_min(y0, -n * 1e6 + y0) AS best FROM w GROUP BY 1, 2) SELECT {PG}, CAST(row_number() OVER (PARTITION BY {PG} ORDER BY x0, item_id) - 1 AS INT) AS col_idx, x0 AS c0, x1 AS c1 FROM w JOIN b USING ({PG}) WHERE y0 = best AND x1 > x0", ITEMS_SQL)
def widest_row(spark: SparkSession, d: str) -> DataFrame:
    return L.widest_row(items(spark, d).withColumn("row_idx", F.col("y0")))


@query(f", f AS (SELECT *, row_number() OVER (PARTITION BY {PG}, y0 ORDER BY floor(x0 / 90), item_id) AS k FROM items), c AS (SELECT {PG}, round(floor(x0 / 90) * 90, 1) AS baseline, count(*) AS n, min(y0) AS seen FROM f WHERE k = 1 AND {m('text', CJK)} GROUP BY 1, 2, 3), o AS (SELECT *, sum(n) OVER (PARTITION BY {PG}) AS al, row_number() OVER (PARTITION BY {PG} ORDER BY n DESC, seen) AS rk FROM c) SELECT {PG}, baseline FROM o WHERE rk = 1 AND al >= 3 AND n >= greatest(3.0, al * 0.4)", LABELLED_SQL)
def label_baseline(spark: SparkSession, d: str) -> DataFrame:
    return L.label_baseline(_labelled(spark, d).withColumns({"row_idx": F.col("y0"), "x0": (F.floor(F.col("x0") / 90) * 90).cast("double")}))


@query(f" SELECT {PG}, item_id, CAST(greatest(0, least(len(list_filter([0.0, 95.0, 200.0, 330.0, 500.0], lambda b: b <= (x0 + x1) / 2)) - 1, 3)) AS INT) AS col_idx FROM items", ITEMS_SQL)
def interval_columns(spark: SparkSession, d: str) -> DataFrame:
    boundaries = F.array(*(F.lit(b) for b in (0.0, 95.0, 200.0, 330.0, 500.0)))
    return items(spark, d).select("doc_id", "page_number", "item_id", L.column_of((F.col("x0") + F.col("x1")) / 2, boundaries).alias("col_idx"))


GRID = f""", bands AS (SELECT DISTINCT {PG}, k AS row_idx, k * 40.0 AS top, k * 40.0 + 30 AS bottom FROM items, (SELECT unnest(range(18)) AS k) z), bs AS (SELECT unnest(range(5)) AS k, unnest([0.0, 95.0, 200.0, 330.0, 480.0]) AS b0, unnest([95.0, 200.0, 330.0, 480.0, 500.0]) AS b1),
 rw AS (SELECT i.doc_id, i.page_number, i.item_id, min(row_idx) AS row_idx FROM items i JOIN bands b ON b.doc_id = i.doc_id AND b.page_number = i.page_number AND (y0 + y1) / 2 BETWEEN top - 6 AND bottom + 6 GROUP BY 1, 2, 3),
 cl AS (SELECT {PG}, item_id, text, k, row_number() OVER (PARTITION BY {PG}, item_id ORDER BY greatest(0.0, least(x1, b1) - greatest(x0, b0)) DESC, CASE WHEN greatest(0.0, least(x1, b1) - greatest(x0, b0)) > 0 THEN 0 ELSE abs((x0 + x1) / 2 - (b0 + b1) / 2) END, k) AS o FROM items, bs)
 SELECT {PG}, CAST(row_idx AS INT) AS row_idx, CAST(k AS INT) AS col_idx, string_agg(text, ' ' ORDER BY item_id) AS text FROM rw JOIN cl USING ({PG}, item_id) WHERE o = 1 GROUP BY 1, 2, 3, 4"""


@query(GRID, ITEMS_SQL)
def word_grid(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    pages = i.select("doc_id", "page_number").distinct()
    bands = pages.select("*", F.explode(F.sequence(F.lit(0), F.lit(17))).alias("row_idx")).select("*", (F.col("row_idx") * 40.0).alias("top"), (F.col("row_idx") * 40.0 + 30).alias("bottom"))
    lines = pages.select("*", F.explode(F.array(*(F.lit(b) for b in (0.0, 95.0, 200.0, 330.0, 480.0, 500.0)))).alias("boundary"))
    return L.grid(i, bands, lines)


@query(KINDS + f", a AS (SELECT a.doc_id, a.page_number, a.drawing_id, b.drawing_id AS other, greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS common, least(a.w * a.h, b.w * b.h) AS small FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.drawing_id < b.drawing_id) SELECT {PG}, drawing_id, other, round(CASE WHEN small > 0 THEN common / small ELSE 0 END, 6) AS ratio FROM a", ITEMS_SQL + DRAWINGS_SQL)
def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    a = drawings(spark, d)
    b = a.select("doc_id", "page_number", F.col("drawing_id").alias("other"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    met = a.join(b, ["doc_id", "page_number"]).where("drawing_id < other")
    return met.select("doc_id", "page_number", "drawing_id", "other", F.round(L.overlap_ratio(box, [F.col(f"b_{c}") for c in ("x0", "y0", "x1", "y1")]), 6).alias("ratio"))


@query(REG + f" SELECT i.doc_id, i.page_number, item_id, CAST(min(region_idx) AS INT) AS region_idx FROM items i JOIN rg r ON r.doc_id = i.doc_id AND r.page_number = i.page_number WHERE y1 >= r_y0 - 60 AND y0 <= r_y0 AND text IN ('A1', 'A2', 'R3') GROUP BY 1, 2, 3", ITEMS_SQL)
def region_captions(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return L.captions(i, _regions(i).withColumn("context_text", F.lit("A1 x  A2\nR3"))).select("doc_id", "page_number", "item_id", "region_idx")


@query("SELECT doc_id, regexp_matches(text, '万元|元|百万|十亿|%|比率|资产|负债|收入|利润|现金|股东|资本|充足率|率|额|数') AS any_length, regexp_matches(text, '万元|元|百万|十亿|%|比率|资产|负债|收入|利润|现金|股东|资本|充足率|率|额|数') AND length(text) > 50 AS over_50, regexp_matches(text, '万元|元|百万|十亿|%|比率|资产|负债|收入|利润|现金|股东|资本|充足率|率|额|数') AND length(text) >= 50 AS from_50 FROM (SELECT l_orderkey * 10 + l_linenumber AS doc_id, CASE l_partkey % 4 WHEN 0 THEN '资产' WHEN 1 THEN 'none' WHEN 2 THEN repeat('利润 1,234 ', CAST(l_linenumber AS INT)) ELSE repeat('text ', 20) END AS text FROM lineitem) x")
def financial_pages(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("CASE l_partkey % 4 WHEN 0 THEN '资产' WHEN 1 THEN 'none' WHEN 2 THEN repeat('利润 1,234 ', CAST(l_linenumber AS INT)) ELSE repeat('text ', 20) END")
    pages = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), t.alias("text"))
    return pages.select("doc_id", L.is_financial(F.col("text")).alias("any_length"), L.is_financial(F.col("text"), 50).alias("over_50"), L.is_financial(F.col("text"), 49).alias("from_50"))


@query(f", lb AS (SELECT DISTINCT {PG}, substr(text, 1, 1) AS label FROM items WHERE item_id % 3 = 0), mi AS (SELECT *, (y0 + y1) / 2 AS mid FROM items), an AS (SELECT lb.doc_id, lb.page_number, label, arg_min(mid, item_id) AS spot FROM lb JOIN mi USING ({PG}) WHERE contains(text, label) GROUP BY 1, 2, 3) SELECT an.doc_id, an.page_number, label, min(y0) AS lo, max(y1) AS hi FROM an JOIN mi USING ({PG}) WHERE abs(mid - spot) <= 5 GROUP BY 1, 2, 3", ITEMS_SQL)
def label_rows(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return J.label_rows(i, i.where("item_id % 3 = 0").select("doc_id", "page_number", F.expr("substr(text, 1, 1)").alias("label")))


@query(f""", tx AS (SELECT DISTINCT {PG}, item_id % 3 AS table_id, CASE WHEN item_id % 2 = 0 THEN text || '0' ELSE text END AS own FROM items WHERE item_id % 11 = 0), mt AS (SELECT DISTINCT tx.doc_id, tx.page_number, table_id, item_id, (y0 + y1) / 2 AS mid FROM tx JOIN items USING ({PG}) WHERE contains(text, own) OR contains(own, text)),
 rk AS (SELECT *, count(*) OVER (PARTITION BY {PG}, table_id) AS n, row_number() OVER (PARTITION BY {PG}, table_id ORDER BY mid, item_id) AS k FROM mt), co AS (SELECT {PG}, table_id, min(mid) AS lo, max(mid) AS hi FROM rk WHERE n >= 3 AND k > floor(n * 0.1) AND k <= n - floor(n * 0.1) GROUP BY 1, 2, 3)
 SELECT {PG}, table_id, greatest(0.0, lo - greatest(60.0, (hi - lo) * 0.2)) AS top, hi + greatest(60.0, (hi - lo) * 0.2) AS bottom FROM co""", ITEMS_SQL)
def table_heights(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    own = F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit("0"))).otherwise(F.col("text"))
    return J.table_heights(i.where("item_id % 11 = 0").select("doc_id", "page_number", (F.col("item_id") % 3).alias("table_id"), own.alias("text")), i)


@query(REG + f" SELECT i.doc_id, i.page_number, item_id, CAST(region_idx AS INT) AS region_idx FROM items i JOIN rg r ON r.doc_id = i.doc_id AND r.page_number = i.page_number AND x0 BETWEEN r_x0 AND r_x1 AND y0 BETWEEN r_y0 AND r_y1", ITEMS_SQL)
def begins_in_regions(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return L.begins_in_regions(i, _regions(i)).select("doc_id", "page_number", "item_id", "region_idx")


@query(FONT + _fold("y_mid", False) + f" SELECT {PG}, row_idx, min(y0) AS y_min, max(y1) AS y_max, string_agg(text, '|' ORDER BY x0, item_id) AS texts, string_agg(x0 || '-' || x1, '|' ORDER BY x0, item_id) AS ranges FROM f JOIN items USING ({PG}, item_id) GROUP BY 1, 2, 3", RECURSIVE)
def row_records(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    out = L.row_records(L.leader_rows(i, G.font_threshold(i)))
    ranges = F.transform("ranges", lambda x: F.concat(x["x0"].cast("string"), F.lit("-"), x["x1"].cast("string")))
    return out.select("doc_id", "page_number", "row_idx", "y_min", "y_max", F.array_join("texts", "|").alias("texts"), F.array_join(ranges, "|").alias("ranges"))
