"""Readers, writers and the incremental reading on small files."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from gridloom.operators import joins as J
from gridloom.sources import readers as Rd
from gridloom.sources import sinks as S
from gridloom.streaming import ingest


def _document(name, numbers):
    item = {"text": "a", "x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0, "font_size": 9.0, "font_name": "f"}
    pages = [{"page_number": n, "page_width": 600.0, "page_height": 700.0, "full_text": f"page {n}", "text_items": [item, item | {"text": " "}, item | {"y1": 1.0}], "table_regions": [], "is_table_page": n == 2, "error": None} for n in numbers]
    return {"pdf_path": name, "total_pages": 3, "pages": pages, "parse_time_sec": 1.0, "error": None}


def test_documents_pages_items(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(_document("a", [1, 2])))
    (tmp_path / "b.json").write_text(json.dumps(_document("b", [1, 2, 3])))
    docs = Rd.documents(spark, str(tmp_path))
    pages = Rd.pages(docs)
    assert pages.count() == 5 and sorted((r.doc_id, r.item_id, r.y_mid) for r in Rd.text_items(pages).collect()) == [("a", 0, 3.0)] * 2 + [("b", 0, 3.0)] * 3
    spine = {(r.doc_id, r.page_number): r.error for r in Rd.page_spine(docs, pages).collect()}
    assert len(spine) == 6 and spine["a", 3] == "missing" and spine["b", 3] is None
    S.write_pages(pages, str(tmp_path / "out"))
    assert {(r.doc_id, r.total_pages, r.table_pages) for r in spark.read.parquet(str(tmp_path / "out/summary")).collect()} == {("a", 2, 1), ("b", 3, 1)}


def test_tables_and_channels(spark, tmp_path):
    (tmp_path / "t.json").write_text("\n".join(json.dumps({"page": p, "data": [["x", None], ["y"]], "extractor": "docx", "parse_status": s}) for p, s in ((1, "success"), (2, "failed"))))
    tables = Rd.tables(spark, str(tmp_path / "t.json"))
    assert [r.data for r in tables.orderBy("page").collect()] == [[["x", None], ["y"]]] * 2
    failed = S.failed_pages(tables.withColumn("doc_id", F.lit(7)))
    assert [(r.doc_id, r.page, r.parse_status) for r in failed.collect()] == [(7, 2, "failed")]
    one, two = spark.createDataFrame([(1, "a")], "doc_id int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "doc_id int, v string")
    assert sorted(tuple(r) for r in Rd.first_filled(one, two).collect()) == [(1, "a"), (2, "c")]


def test_content_hash_and_cache(spark, tmp_path):
    sizes = {"small": 10, "one": Rd.MIB, "between": Rd.MIB + 7, "two": 2 * Rd.MIB, "large": 2 * Rd.MIB + 9}
    for k, (name, size) in enumerate(sizes.items()):
        (tmp_path / name).write_bytes(os.urandom(size))
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", Rd.content_hash(F.col("content")).alias("h"), Rd.content_hash(F.col("content"), True).alias("o"))
    for r in files.collect():
        data = (tmp_path / os.path.basename(r.path)).read_bytes()
        head, tail = data[: Rd.MIB], data[max(0, len(data) - Rd.MIB) :]
        assert r.o == hashlib.md5(head + tail).hexdigest()
        assert r.h == hashlib.md5(head + (tail if len(data) > 2 * Rd.MIB else data[Rd.MIB :])).hexdigest()
    assert [os.path.basename(r.path) for r in Rd.cached_files(spark, str(tmp_path)).collect()] == list(sizes)[::-1]
    cached = spark.createDataFrame([("a", 1, 2), ("b", 1, 1), ("c", 1, 3)], "content_hash string, size long, cache_version int")
    current = spark.createDataFrame([("a", 1), ("b", 1), ("c", 9)], "content_hash string, size long")
    assert [r.content_hash for r in Rd.valid_cache(cached, current).collect()] == ["a"]


def test_writers(spark, tmp_path):
    grid = spark.createDataFrame([(1, [["a", 'b"c'], ["d"]]), (2, [["x,y"]])], "table_id int, data array<array<string>>")
    marks = spark.createDataFrame([(1, "# one"), (2, "# two")], "table_id int, mark string")
    assert [r.value for r in S.csv_lines(grid, marks).orderBy("table_id", "line_no").collect()] == ["# one", 'a,"b""c"', "d,", "# two", '"x,y"']
    S.write_text(grid, str(tmp_path / "text"), 2)
    lines = [line for f in sorted((tmp_path / "text").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ["# 1", 'a\tb"c', "d", "# 2", "x,y"]
    S.write_json(grid, str(tmp_path / "json"))
    assert spark.read.schema(grid.schema).json(str(tmp_path / "json")).count() == 2
    cells = spark.createDataFrame([(1, 0, 0, "p"), (1, 0, 1, "q"), (1, 1, 0, "r")], "table_id int, row_idx int, col_idx int, text string")
    S.write_csv(cells, str(tmp_path / "csv"), 2)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    for version in (2, 3):
        S.write_versioned(grid, str(tmp_path / "cache"), version)
    assert sorted(r.cache_version for r in spark.read.parquet(str(tmp_path / "cache")).collect()) == [2, 2, 3, 3]
    named = S.sheet_names(spark.createDataFrame([(1, 5, 3, "a/b"), (1, 6, 3, "x" * 40)], "doc_id int, table_id int, page int, title string"))
    assert [r.sheet for r in named.orderBy("table_id").collect()] == ["P003-T01-a-b", "P003-T02-" + "x" * 22]


def test_positional_order(spark):
    tables = spark.createDataFrame([(1, 1, 10), (1, 1, 11), (1, 2, 12)], "doc_id int, page_number int, table_id int")
    regions = spark.createDataFrame([(1, 1, 0, 50.0), (1, 1, 1, 20.0), (1, 2, 0, 1.0), (1, 2, 1, 2.0)], "doc_id int, page_number int, region_idx int, r_y0 double")
    assert {(r.table_id, r.region_idx) for r in J.positional_order(tables, regions).collect()} == {(10, 1), (11, 0)}


def test_ingest_reads_each_content_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, text in (("a", "one"), ("b", "two"), ("c", "one")):
        (source / name).write_text(text)
    files = ingest.new_files(spark, str(source))
    parse = lambda f: f.select("content_hash", F.col("content").cast("string").alias("text"))
    for _ in range(2):
        ingest.ingest(files, parse, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "two"]
