from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.operators import cells as C
from gridloom.operators import geometry as G
from gridloom.operators import joins as J

CELLS = "table_id long, row_idx int, col_idx int, text string"


def grid(spark, rows):
    return C.from_grid(spark.createDataFrame([(1, rows)], "table_id long, data array<array<string>>"))


def back(df):
    return C.to_grid(df).first().data


def test_text_functions(spark):
    texts = ["25,228,241", " (12.5)% ", "", None, "资产", "2024年", "1.51", "589", "--", "a_1", "1 2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(T.item_type(F.col("t")).alias("kind"), T.is_numeric(F.col("t")).alias("num"), T.number_value(F.col("t")).alias("v"), T.cleaned(F.col("t")).alias("c")).collect()
    assert [r.kind for r in rows] == ["amount", "percent", "empty", "empty", "label", "mixed", "ratio", "number", "mixed", "number", "number"]
    assert [r.num for r in rows] == [True, True, False, False, False, False, True, True, False, False, True]
    assert rows[0].v == 25228241 and rows[1].v == -12.5 and rows[2].v is None
    assert [r.c for r in rows[:2]] == ["25,228,241", "(12.5)%"] and rows[8].c == "--"


def test_cleaning(spark):
    g = [["a", "", "1", "1"], ["", "", "", ""], ["b", "", "2", "2"]]
    assert back(C.drop_empty_rows(grid(spark, g))) == [g[0], g[2]]
    assert back(C.drop_empty_columns(grid(spark, g))) == [["a", "1", "1"], ["", "", ""], ["b", "2", "2"]]
    assert back(C.drop_repeated_columns(grid(spark, g))) == [["a", "", "1"], ["", "", ""], ["b", "", "2"]]
    assert back(C.crop_columns(grid(spark, [["", "x", ""], ["", "y", "z"]]))) == [["x", ""], ["y", "z"]]
    assert back(C.blank_repeats(grid(spark, [["a", "5"], ["a", "5"]]))) == [["a", "5"], ["a", ""]]
    assert back(C.fill_down(grid(spark, [["", "1"], ["x", ""], [None, "2"]]))) == [["", "1"], ["x", "1"], ["x", "2"]]


def test_empty_table(spark):
    none = spark.createDataFrame([], CELLS)
    for f in (C.clean, C.drop_empty_rows, C.drop_empty_columns, C.drop_repeated_columns, C.column_profile, C.classify, C.rule_checks, C.fingerprint):
        assert f(none).count() == 0


def test_chain_not_leader(spark):
    values = spark.createDataFrame([(1, 1, float(v)) for v in (0, 4, 8, 30, 31)], "doc_id long, page_number int, v double")
    assert [(r.n, r.center) for r in G.cluster_1d(values, 4.0, 2).orderBy("center").collect()] == [(3, 4.0), (2, 30.5)]


def test_pages(spark):
    p = spark.createDataFrame([(1, n) for n in (1, 2, 3, 5, 9, 10)], "doc_id long, page_number int")
    assert G.page_ranges(p, ["doc_id"], "page_number").first().pages == "1-3,5,9-10"
    t = spark.createDataFrame([(1, k, v) for k, v in enumerate([None, 2, None, None, 8, None])], "doc_id long, table_id long, page int")
    assert [r.page for r in G.interpolated_pages(t).orderBy("table_id").collect()] == [2, 2, 4, 6, 8, 8]


def test_unmatched_by_fingerprint(spark):
    schema = "doc_id long, table_id long, page int, widths array<int>, tokens array<string>"
    left = [(1, 1, 1, [2, 2], list("abc")), (1, 2, 5, [2, 2], list("abc")), (1, 3, 1, [2, 3], list("abc")), (2, 4, 1, [2, 2], list("abc")), (1, 5, 1, [2, 2], list("abxyzuvw")), (1, 6, 1, [2, 2], list("ab"))]
    left, right = spark.createDataFrame(left, schema), spark.createDataFrame([(1, 9, 2, [2, 2], list("abcd"))], schema)
    assert sorted(r.table_id for r in J.unmatched_by_fingerprint(left, right).collect()) == [2, 3, 4, 5, 6]
    assert sorted(r.table_id for r in J.union_of_channels(right, left).collect()) == [2, 3, 4, 5, 6, 9]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_scope_and_restore(spark):
    items = spark.createDataFrame([(1, 1, 1, "total", "total", 0.0, 100.0, 30.0, 110.0), (1, 1, 2, "(1,234) x", "(1234)x", 40.0, 101.0, 70.0, 111.0), (1, 1, 3, "other", "other", 0.0, 120.0, 30.0, 130.0), (1, 1, 4, "77", "77", 40.0, 120.0, 70.0, 130.0)], "doc_id int, page_number int, item_id int, text string, key string, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame([(1, 1, 0, 0.0, 50.0, 119.0, 131.0), (1, 1, 1, 500.0, 600.0, 500.0, 600.0)], "doc_id int, page_number int, region_idx int, r_x0 double, r_x1 double, r_y0 double, r_y1 double")
    got = {(r.region_idx, r.item_id) for r in J.scoped_items(items, regions).collect()}
    assert got == {(0, 1), (0, 3)} | {(1, k) for k in (1, 2, 3, 4)}
    cells = [(1, 1, 1, 0, 1, "1234", "total"), (1, 1, 1, 0, 2, "77", "total"), (1, 1, 1, 1, 1, "77", "other"), (1, 1, 1, 2, 1, "77", "nowhere"), (1, 1, 1, 3, 1, "99", None)]
    erased = spark.createDataFrame(cells, "doc_id int, page_number int, table_id int, row_idx int, col_idx int, key string, label string")
    assert {(r.row_idx, r.col_idx) for r in J.restore_in_rows(erased, items).collect()} == {(0, 1), (1, 1), (2, 1)}


def test_gap_boundaries(spark):
    items = spark.createDataFrame([(1, 1, 0.0, 30.0), (1, 1, 2.0, 32.0), (1, 1, 100.0, 130.0), (1, 1, 102.0, 132.0), (1, 2, 5.0, 9.0)], "doc_id int, page_number int, x0 double, x1 double")
    inner = {(r.page_number, r.boundary) for r in G.gap_columns(items).collect()}
    got = {(r.page_number, r.boundary) for r in G.gap_boundaries(items).collect()}
    found = sorted(b for p, b in inner if p == 1)
    assert got == inner | {(1, found[0] / 2), (1, (found[-1] + 132) / 2), (2, 5.0), (2, 9.0)}
