import math

from gridloom.operators import cells as C
from gridloom.operators import edits as E
from gridloom.operators import geometry as G


def grid(spark, rows, table=1):
    return C.from_grid(spark.createDataFrame([(table, rows)], "table_id long, data array<array<string>>"))


def back(df):
    return {r.table_id: r.data for r in C.to_grid(df).collect()}


def page(spark, ys, text="a"):
    rows = [(1, 1, i, text, 10.0 * i, y, 10.0 * i + 5, y + 9) for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "doc_id long, page_number int, item_id long, text string, x0 double, y0 double, x1 double, y1 double")


def test_thresholds(spark):
    value = lambda ys, text="a": G.row_threshold(page(spark, ys, text)).first().threshold
    assert math.isclose(value([0.0, 10.0, 20.0, 30.0, 45.0]), 4.0)
    assert value([0.0, 10.0, 20.0, 30.0]) == value([0.0, 10.0, 20.0, 30.0, 45.0], " ") == 5.0  # too few values, blank words
    assert value([0.0, 100.0, 200.0, 300.0, 310.0, 320.0]) == 5.0  # two usable gaps
    assert value([0.0, 1.0, 2.0, 3.0, 4.0]) == 2.0 and value([0.0, 48.0, 96.0, 144.0, 192.0]) == 15.0
    assert tuple(G.font_threshold(page(spark, [0.0, 50.0])).first())[2:] == (9.0, 4.5)
    flat = page(spark, [0.0]).selectExpr("doc_id", "page_number", "item_id", "text", "x0", "y0", "x1", "y0 as y1")
    assert tuple(G.font_threshold(flat).first())[2:] == (10.0, 5.0)
    assert G.row_threshold(page(spark, [0.0]).limit(0)).count() == 0


def test_column_spans(spark):
    rows = [(1, 1, 0, 0, 0.0, 5.0), (1, 1, 1, 0, 20.0, 30.0), (1, 1, 2, 1, 18.0, 25.0), (1, 1, 3, 1, 40.0, 60.0)]
    items = spark.createDataFrame(rows, "doc_id long, page_number int, item_id long, row_idx int, x0 double, x1 double")
    assert [(r.col_idx, r.x0, r.x1) for r in G.column_spans(items).orderBy("col_idx").collect()] == [(0, 18.0, 25.0), (1, 20.0, 60.0)]


def test_continuation(spark):
    rows = [(1, 1, 1, 3), (1, 2, 2, 5), (1, 3, 4, 5), (1, 4, 4, 8), (1, 5, 4, 0), (2, 6, 4, 1)]
    tables = spark.createDataFrame(rows, "doc_id long, table_id long, page int, n_cols int")
    assert [r.continues for r in G.continuation_candidates(tables).orderBy("table_id").collect()] == [None, 1, None, None, None, None]


def test_dense_grid(spark):
    g = [["", " "], [" a ", "", "b"], ["c", None, "", "beyond"], ["", "", "d"]]
    assert back(E.dense_grid(grid(spark, g))) == {1: [["a", "b"], ["c", ""], ["", "d"]]}
    assert back(E.dense_grid(grid(spark, [["", None]]))) == {}
    assert back(E.numeric_characters(grid(spark, [["约 1,234.5元", None, "(3)%"]]))) == {1: [["1,234.5", "", "(3)%"]]}


def test_append(spark):
    cells = grid(spark, [["a", "b"]]).unionByName(grid(spark, [["c"], ["d", "e", "f"]], 2)).unionByName(grid(spark, [["g", "h"]], 3)).unionByName(grid(spark, [["i"]], 4))
    pairs = spark.createDataFrame([(3, 1), (2, 1), (2, 1)], "source long, target long")
    assert back(E.append_tables(cells, pairs)) == {1: [["a", "b"], ["c", ""], ["d", "e"], ["g", "h"]], 4: [["i"]]}
    assert back(E.append_tables(cells, pairs.limit(0))) == back(cells)
