"""Row, table, layout and merging operators on hand-made cases, and the page assignment against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.operators import layout as L
from gridloom.operators import lists as I
from gridloom.operators import merging as M
from gridloom.operators import quality as Q
from gridloom.operators import repairs as P
from gridloom.operators import rows as R


def cells_of(spark, tables):
    rows = [(t, r, c, x) for t, data in tables.items() for r, row in enumerate(data) for c, x in enumerate(row)]
    return spark.createDataFrame(rows, "table_id long, row_idx int, col_idx int, text string")


def grid_of(cells):
    out = {}
    for r in cells.orderBy("table_id", "row_idx", "col_idx").collect():
        out.setdefault(r.table_id, {}).setdefault(r.row_idx, []).append(r.text)
    return {t: [rows[k] for k in sorted(rows)] for t, rows in out.items()}


def test_number_tests(spark):
    texts = ["2024年", "12月31日", "(1)", "1,234万元", "第9号", "–", "1.", "-5", "12.5%", "", None, "18/11/2014", "599"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.is_number_like(F.col("t")).alias("like"), T.is_single_number(F.col("t")).alias("one"), T.is_number_loose(F.col("t")).alias("loose")).orderBy("k").collect()
    assert [r.like for r in got] == [False, False, False, True, False, False, False, True, True, False, False, False, True]
    assert [r.one for r in got] == [False, False, False, False, False, False, True, True, True, False, False, False, True]
    assert [r.loose for r in got][3] and not any(got[k].loose for k in (0, 1, 5, 9, 10, 11, 12))


def test_clean_steps(spark):
    c = cells_of(spark, {
        1: [["", ""], [" ", ""]], 2: [["", "a", ""], ["", "", "b"]],
        3: [["t", "", ""], ["x", "", "1"], ["y", "", "2"]], 4: [["h", "", "p q"], ["资产", "", "1 2"], ["k", "", ""]],
    })
    assert grid_of(P.crop_edges(c.where("table_id <= 2"))) == {1: [["", ""], [" ", ""]], 2: [["a", ""], ["", "b"]]}
    assert grid_of(P.compact_columns(c.where("table_id = 3"))) == {3: [["t", ""], ["x", "1"], ["y", "2"]]}
    assert grid_of(P.split_merged_numbers(c.where("table_id = 4"))) == {4: [["h", "", "p q"], ["资产", "1", "2"], ["k", "", ""]]}
    wide = cells_of(spark, {1: [["a", "1 2 3", "x"], ["b", "4", "y"], ["c", "", "1 2"]]})
    assert grid_of(P.split_merged_numbers(wide)) == {1: [["a", "1", "2", "3", "x"], ["b", "4", "y", "", ""], ["c", "1", "2", "", ""]]}
    phantom = [["i", "n", "n", "n"], ["", "", "", ""], ["", "", "", ""]] + [["l", str(k), "", "7" if k % 2 else ""] for k in range(10)]
    assert {len(r) for r in grid_of(P.drop_phantom_columns(cells_of(spark, {1: phantom})))[1]} == {3}
    sparse = [["h", "", "v"], ["", "", ""], ["", "", ""]] + [[f"r{k}", "(2)" if k == 1 else "", str(k)] for k in range(6)]
    assert grid_of(P.drop_sparse_columns(cells_of(spark, {1: sparse})))[1][4] == ["r1 (2)", "1"]


def test_checks_and_fixes(spark):
    c = cells_of(spark, {1: [["a", "1,000"], ["", ""], [" b", "1000"]], 2: [["1", "2"]], 3: [["a", "1"], ["b"]]})
    got = {r.table_id: r for r in P.checks(c).collect()}
    assert got[1].empty_rows == "1" and got[1].leading_whitespace and got[1].irregular_number and not got[1].single_row
    assert got[2].single_row and got[2].orphan_numeric_row and got[3].inconsistent_cols == "1"
    status = {r.table_id: (r.applied, r.status, r.confidence) for r in P.fix_status(P.checks(c)).collect()}
    assert status[1] == ("remove_empty_rows,trim_whitespace,normalize_numbers", "auto_fixed", "high") and status[3][1] == "needs_review"
    assert grid_of(P.fixed(c))[1] == [["a", "1000"], ["b", "1000"]]


def test_acceptance(spark):
    good = [["项目", "2024年", "2023年"]] + [[f"资产{k}", "1,234", "12.5%"] for k in range(9)]
    c = cells_of(spark, {1: good, 2: [[f"甲{k}", "1,234", "2"] for k in range(4)], 3: [["目录", ""], ["一", "二"]], 4: [["甲" * 50, ""], ["乙" * 50, ""], ["x", "1"]], 5: [["银行股份有限公司", ""], ["2024年度报告", ""], ["a", "1"], ["b", "2"]]})
    rows = R.of_cells(c)
    quality = Q.table_quality(rows)
    assert {r.table_id: r.table_category for r in quality.collect()} == {1: "财务数据表", 2: "数据表(缺表头)", 3: "目录", 4: "数据表(缺表头)", 5: "数据表(缺表头)"}
    got = {r.table_id: r for r in Q.acceptance(rows, Q.financial_confidence(quality)).collect()}
    assert got[1].decision == "accepted" and got[1].score == pytest.approx(0.55 + 0.2 * 2 / 3 + 0.12 + 0.08 * 7 / 12, abs=1e-3)
    assert got[2].decision == "rejected" and got[3].reason == "非财务表类型: 目录" and got[5].flags == ["page_header_footer_noise"]


def test_row_folds(spark):
    ys = [0, 4, 8, 30]
    items = spark.createDataFrame([(1, 1, k, "a", 0.0, float(y), 5.0, float(y)) for k, y in enumerate(ys)], "doc_id int, page_number int, item_id int, text string, x0 double, y0 double, x1 double, y1 double")
    limit = spark.createDataFrame([(1, 1, 5.0)], "doc_id int, page_number int, threshold double")
    assert [r.row_idx for r in L.word_rows(items, limit).orderBy("item_id").collect()] == [0, 0, 1, 2]  # 8 is 6 from the mean of 0 and 4
    high = items.withColumns({"y0": F.col("y0") - 1, "y1": F.col("y1") + 1})
    assert [r.row_idx for r in L.leader_rows(high, limit).orderBy("item_id").collect()] == [0, 0, 1, 2]


def test_chains_and_prior(spark):
    schema = "doc_id int, table_id int, page int, n_cols int, complete_header boolean, no_summary_at_end boolean, sub_tables boolean, first_row array<string>"
    rows = [(1, k, k, 4, False, True, False, ["a", "1"]) for k in (1, 2, 3)] + [(1, 4, 4, 9, False, True, False, ["a", "1"]), (1, 5, 5, 9, True, True, False, ["a", "1"])]
    assert [r.head for r in M.cross_page_chains(spark.createDataFrame(rows, schema)).orderBy("table_id").collect()] == [1, 1, 1, 4, 5]
    prior = spark.range(1).select(M.position_prior(F.lit(3), F.lit(3), F.lit(100)).alias("a"), M.position_prior(F.lit(3), F.lit(29), F.lit(100)).alias("b")).first()
    assert (prior.a, prior.b) == (0.15, 0.0)


def test_assign_pages(spark):
    rng, rows, best = random.Random(4), [], {}
    for doc in range(12):
        tables, pages = rng.randint(1, 4), sorted(rng.sample(range(1, 30), rng.randint(1, 5)))
        score = {(t, p): rng.choice((0.0, 0.1, 0.5, rng.random())) for t in range(tables) for p in pages}
        rows += [(doc, t, p, s) for (t, p), s in score.items()]
        ways = itertools.combinations_with_replacement(range(len(pages)), tables)
        best[doc] = max(sum(score[t, pages[p]] for t, p in enumerate(way)) - M.PAGE_PRICE * (way[-1] - way[0]) for way in ways), pages
    out = {}
    for r in M.assign_pages(spark.createDataFrame(rows, "doc_id int, table_id int, page int, score double")).orderBy("doc_id", "table_id").collect():
        out.setdefault(r.doc_id, []).append((r.page, r.score))
    for doc, (value, pages) in best.items():
        own = [p for p, _ in out[doc]]
        assert own == sorted(own)
        assert sum(s for _, s in out[doc]) - M.PAGE_PRICE * (pages.index(own[-1]) - pages.index(own[0])) == pytest.approx(value)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "table_id long, row_idx int, col_idx int, text string")
    rows = R.of_cells(none)
    for df in (P.compact_columns(none), P.drop_sparse_columns(none), P.split_merged_numbers(none), P.checks(none), Q.chart_signals(rows), Q.table_quality(rows), Q.without_tail_prose(rows), I.preview(rows)):
        assert df.count() == 0
    blank = R.of_cells(cells_of(spark, {1: [[None, ""], ["", None]]}))
    assert Q.chart_signals(blank).first().chart_like and not Q.table_quality(blank).first().is_real_table
