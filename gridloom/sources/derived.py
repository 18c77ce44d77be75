"""Views of cells, items, tables and JSON texts that are derived from the relational tables by plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = """
SELECT l_orderkey AS table_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS INT) AS row_idx,
       l_partkey AS k, CAST(l_quantity AS DECIMAL(18,2)) || '' AS q, CAST(l_extendedprice AS DECIMAL(18,2)) || '' AS p,
       CAST(l_discount * 100 AS DECIMAL(18,2)) || '' AS d, l_returnflag || l_linestatus AS f
FROM {lineitem}
"""
#: Text of each column of the derived tables; column 0 is a label, 4 is sparse and 5 repeats 1.
COLUMNS = [
    "CASE WHEN k % 11 = 0 THEN '' WHEN k % 5 = 0 THEN '资产' || f ELSE f END",
    "CASE WHEN k % 13 = 0 THEN '  ' ELSE q END",
    "CASE WHEN k % 3 = 0 THEN '(' || p || ')' WHEN k % 17 = 0 THEN '--' ELSE ' ' || p || '_ ' END",
    "d || '%'",
    "CASE WHEN k % 19 = 0 THEN '备注' || (k % 4) ELSE '' END",
    "CASE WHEN k % 13 = 0 THEN '  ' ELSE q END",
]
CELLS_SQL = f"WITH base AS ({BASE.format(lineitem='lineitem')}), cells AS (" + " UNION ALL ".join(f"SELECT table_id, row_idx, {c} AS col_idx, {t} AS text FROM base" for c, t in enumerate(COLUMNS)) + ")"

ITEMS = """
SELECT l_suppkey % 50 AS doc_id, l_linenumber AS page_number, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS item_id,
       l_returnflag || l_linenumber AS text, CAST((l_partkey % 6) * 90 + l_quantity / 10 AS DOUBLE) AS x0, CAST((l_orderkey % 40) * 18 + l_linenumber AS DOUBLE) AS y0,
       CAST((l_partkey % 6) * 90 + l_quantity / 10 + 30 AS DOUBLE) AS x1, CAST((l_orderkey % 40) * 18 + l_linenumber + 9 AS DOUBLE) AS y1
FROM {lineitem} WHERE l_orderkey % 10 = 0
"""
ITEMS = ITEMS.replace("row_number() OVER (ORDER BY l_orderkey, l_linenumber,", "l_orderkey * 100000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,").replace(" WHERE l_orderkey % 10 = 0", "")
ITEMS_SQL = f"WITH items AS ({ITEMS.format(lineitem='lineitem')})"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.sql(BASE, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("col_idx"), F.expr(t).alias("text")) for c, t in enumerate(COLUMNS))))
    return base.select("table_id", "row_idx", each.alias("cell")).select("table_id", "row_idx", "cell.*")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ITEMS, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


# Sheets: longer tables with headers, notes, units, charts and prose, whose kind is table_id % 9.
_TABLE = "l_partkey * 3 + l_linenumber % 3"
_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
_TEXTS = "l_orderkey AS k, CAST(l_quantity AS DECIMAL(18,0)) || '' AS q, CAST(l_extendedprice AS DECIMAL(18,2)) || '' AS p, CAST(l_discount * 100 AS DECIMAL(18,1)) || '%' AS d"
SHEET_BASE = f"""
SELECT {_TABLE} AS table_id, ({_TABLE}) % 9 AS kind,
       CAST(row_number() OVER (PARTITION BY {_TABLE} ORDER BY {_ORDER}) - 1 AS INT) AS row_idx,
       {_TEXTS}
FROM {{lineitem}}
"""
#: The same in steps: Spark knows rows dealt by a column as dealt by it, and texts made after the numbering aren't dealt at all.
_SHEET_STEPS = f"""
SELECT table_id, table_id % 9 AS kind, row_idx, {_TEXTS}
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY table_id ORDER BY {_ORDER}) - 1 AS INT) AS row_idx FROM (SELECT *, {_TABLE} AS table_id FROM {{lineitem}}))
"""


def _case(value: str, texts: list[str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts)) + " ELSE '' END"


_LABELS = _case("k % 13", ["发放贷款和垫款总额", "存放同业款项", "合计", "其中：公司贷款", "利息收入", "小计", "减：损失准备", "其他资产", " ", "注", "(1)", "第9号文件", "2023年12月31日"])
SHEET_COLUMNS = [
    f"""CASE WHEN kind = 1 THEN {_case("k % 4", ["经营情况讨论与分析的主要内容以及风险管理的具体说明和下一年度的工作安排以及经营目标的详细阐述", "风险管理", "", "目录"])}
 WHEN kind = 2 THEN d WHEN kind = 3 THEN {_case("k % 5", ["业", "税", "金", "附", "加"])} WHEN kind = 4 THEN row_idx * 10 || ''
 WHEN kind = 5 AND row_idx = 0 THEN '华夏股份有限公司' WHEN row_idx = 0 AND kind IN (0, 6, 7) THEN '项目' WHEN row_idx = 1 AND kind = 6 THEN '单位：人民币百万元'
 WHEN k % 23 = 0 THEN '注：本表数据口径包括境内外全部机构及附属公司的信贷资产情况说明。' WHEN k % 29 = 0 THEN '1. 净利润除以年初及年末总资产平均值的比率计算所得出的结果。' WHEN k % 31 = 0 THEN '22' ELSE {_LABELS} END""",
    f"""CASE WHEN kind IN (1, 3, 4) THEN '' WHEN kind = 2 THEN {_case("k % 3", ["公司贷款", "零售", "其他"])} WHEN row_idx = 0 AND kind IN (0, 6, 7) THEN '2024年'
 WHEN (row_idx = 1 AND kind = 6) OR k % 23 = 0 OR k % 29 = 0 THEN '' ELSE CASE k % 7 WHEN 0 THEN '--' WHEN 1 THEN '(' || p || ')' WHEN 2 THEN p || '万元' WHEN 3 THEN '–' WHEN 4 THEN ' ' || p || ' ' ELSE p END END""",
    """CASE WHEN row_idx = 0 AND kind = 0 THEN '2023年' WHEN row_idx = 0 AND kind = 6 THEN '本集团' WHEN row_idx = 0 AND kind = 7 THEN '本行' WHEN (row_idx = 1 AND kind = 6) OR k % 23 = 0 OR k % 29 = 0 THEN ''
 ELSE CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN q WHEN 2 THEN p || ' ' || q ELSE p END END""",
    "CASE WHEN row_idx = 0 AND kind = 0 THEN '变化' WHEN row_idx = 0 AND kind = 6 THEN '本行' WHEN row_idx = 0 AND kind = 7 THEN '本集团' WHEN (row_idx = 1 AND kind = 6) OR k % 23 = 0 OR k % 29 = 0 THEN '' ELSE d END",
]
#: Which tables have a column at all.
SHEET_HAS = ["true", "true", "kind NOT IN (1, 2, 3, 4)", "kind NOT IN (1, 2, 3, 4, 8)"]
SHEET_SQL = f"WITH base AS ({SHEET_BASE.format(lineitem='lineitem')}), cells AS (" + " UNION ALL ".join(f"SELECT table_id, row_idx, {c} AS col_idx, {t} AS text FROM base WHERE {h}" for c, (t, h) in enumerate(zip(SHEET_COLUMNS, SHEET_HAS, strict=True))) + ")"


def _sheet_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SHEET_STEPS, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def sheet_rows(spark: SparkSession, sf_dir: str, more: dict[int, str], cell) -> DataFrame:
    """The sheets row by row: table_id, row_idx, cells (an array of ``cell(col_idx, text)``); ``more`` has the texts of further columns, made of column 1's."""
    # a lambda beside the texts has Spark split their code; in one method of over 8000 bytes it would stay interpreted in the JVM
    kind = F.transform(F.array("kind"), lambda x: x)[0].alias("kind")
    base = _sheet_base(spark, sf_dir).select("table_id", "row_idx", kind, *(F.expr(t).alias(f"t{c}") for c, t in enumerate(SHEET_COLUMNS)))
    base = base.withColumn("text", F.col("t1")).select("*", *(F.expr(t).alias(f"t{c}") for c, t in more.items()))
    # none within a lambda, which would interpret them
    each = [(h, F.array(cell(F.lit(c), F.col(f"t{c}")))) for c, h in [*enumerate(SHEET_HAS), *((c, "true") for c in more)]]
    return base.select("table_id", "row_idx", F.concat(*(F.when(F.expr(h), x).otherwise(F.slice(x, 1, 0)) for h, x in each)).alias("cells"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*(F.when(F.expr(h), F.struct(F.lit(c).alias("col_idx"), F.expr(t).alias("text"))) for c, (t, h) in enumerate(zip(SHEET_COLUMNS, SHEET_HAS, strict=True))))
    return _sheet_base(spark, sf_dir).select("table_id", "row_idx", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("cell")).select("table_id", "row_idx", "cell.*")


DRAWINGS = """
SELECT l_suppkey % 50 AS doc_id, l_linenumber AS page_number, l_orderkey * 100000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS drawing_id,
       CAST(l_partkey % 7 * 60 AS DOUBLE) AS x0, CAST(l_orderkey % 30 * 20 AS DOUBLE) AS y0,
       CAST(l_partkey % 7 * 60 + CASE l_partkey % 9 WHEN 0 THEN 400 WHEN 1 THEN 300 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 250 ELSE 20 END AS DOUBLE) AS x1,
       CAST(l_orderkey % 30 * 20 + CASE l_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 30 WHEN 2 THEN 120 WHEN 3 THEN 2 ELSE 60 END AS DOUBLE) AS y1
FROM {lineitem} WHERE l_partkey % 31 = 0 AND l_suppkey % 50 < 40
"""
DRAWINGS_SQL = f", drawings AS ({DRAWINGS.format(lineitem='lineitem')})"


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DRAWINGS, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
