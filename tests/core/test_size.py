"""Operators on groups so large that work growing with their square would show, and against plain loops."""

import random
import re
import time

from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.operators import layout as L
from gridloom.operators import lists as I
from gridloom.operators import merging as M
from gridloom.operators import repairs as P
from gridloom.plans import queries as plans


def done_within(seconds, df):
    began = time.time()
    rows = df.collect()
    assert time.time() - began < seconds
    return rows


def test_anchor_segments(spark):
    t = spark.range(200000).select(F.lit(1).alias("doc_id"), F.col("id").alias("table_id"), F.when(F.col("id") == 100000, 7).alias("page"))
    got = done_within(60, M.anchor_segments(t, 900).groupBy("segment", "low", "high").count())
    assert {tuple(r) for r in got} == {(0, 1, 7, 100000), (1, 7, 900, 99999)}


def test_row_folds(spark):
    ys = "double(id % 3 * 10)"
    items = spark.range(400000).selectExpr("1 AS doc_id", "1 AS page_number", "id AS item_id", "'a' AS text", "0D AS x0", f"{ys} AS y0", "5D AS x1", f"{ys} + 2 AS y1")
    limit = spark.createDataFrame([(1, 1, 5.0)], "doc_id int, page_number int, threshold double")
    for rows in (L.word_rows, L.leader_rows):
        got = done_within(60, rows(items, limit).groupBy("row_idx").agg(F.min("y0"), F.max("y0"), F.count("item_id")))
        assert {tuple(r) for r in got} == {(0, 0.0, 0.0, 133334), (1, 10.0, 10.0, 133333), (2, 20.0, 20.0, 133333)}
    odd = items.where("item_id < 3").withColumn("y0", F.expr("CASE item_id WHEN 0 THEN NULL WHEN 1 THEN double('NaN') ELSE y0 END"))
    assert [tuple(r) for r in L.word_rows(odd, limit).select("item_id", "row_idx").orderBy("row_idx").collect()] == [(2, 0), (0, 1), (1, 2)]
    dealt = random.Random(1)
    heights = [dealt.randrange(60) / 4 for _ in range(300)]
    some = spark.createDataFrame([(1, 1, k, "a", 0.0, y, 5.0, y + 1) for k, y in enumerate(heights)], items.schema)
    narrow = spark.createDataFrame([(1, 1, 0.6)], "doc_id int, page_number int, threshold double")
    for rows, follow, add in ((L.word_rows, True, 0.0), (L.leader_rows, False, 0.5)):
        expected, at, row = {}, None, -1
        for y, k in sorted((y + add, k) for k, y in enumerate(heights)):
            joins = at is not None and abs(y - at) <= 0.6
            at, row = ((at + y) / 2 if follow else at, row) if joins else (y, row + 1)
            expected[k] = row
        assert {r.item_id: r.row_idx for r in rows(some, narrow).collect()} == expected


def test_best_region(spark):
    dealt = random.Random(2)
    words = ["a", "ab", "b", "c d", "d", "ef", "f"]
    labels = [(p, t, [dealt.choice(words) for _ in range(dealt.randrange(5))]) for p in (1, 2) for t in range(p * 100, p * 100 + 60)]
    regions = [(dealt.choice((1, 2)), k, " ".join(dealt.choice(words) for _ in range(dealt.randrange(4)))) for k in range(30)]
    expected = set()
    for p, t, own in labels:
        scored = [(-sum(x in text for x in own[:3]), k) for q, k, text in regions if q == p]
        if min(scored)[0]:
            expected.add((p, t, min(scored)[1]))
    tables, texts = spark.createDataFrame(labels, "page_number int, table_id long, labels array<string>"), spark.createDataFrame(regions, "page_number int, region_idx long, region_text string")
    assert {tuple(r) for r in I.best_region(tables, texts).collect()} == expected
    tables = spark.range(100000).selectExpr("1 AS page_number", "id AS table_id", "array('x', string(id % 9)) AS labels")
    texts = spark.range(100000).selectExpr("1 AS page_number", "id AS region_idx", "repeat(string(id % 7), 60) AS region_text")
    got = done_within(60, I.best_region(tables, texts).groupBy("region_idx").count())
    assert {r.region_idx for r in got} == set(range(7)) and sum(r["count"] for r in got) == sum(1 for k in range(100000) if k % 9 < 7)


def test_context_score(spark):
    page = "page 12 net 合计数 ABC " * 20
    cases = [("net", True), ("xx\nnet", False), ("AB\nzz", True), ("qqq", True), ("", True)]
    per = spark.range(200).select(F.col("id").alias("table_id"), F.lit(page).alias("page"), F.array(*(F.struct(F.lit(k).alias("row_idx"), F.lit(c).alias("context"), F.lit(h).alias("has_region")) for k, (c, h) in enumerate(cases))).alias("contexts"))
    got = done_within(60, M.context_scores(per).groupBy("row_idx").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy("row_idx"))
    one = spark.createDataFrame([(k, c, h, page) for k, (c, h) in enumerate(cases)], "k int, c string, h boolean, p string").select("k", M.context_score(F.col("c"), F.col("p"), F.col("h")).alias("s")).orderBy("k").collect()
    assert [r.lo for r in got] == [r.hi for r in got] == [r.s for r in one] and [round(r.s, 3) for r in one] == [0.79, 0.395, 0.0, 0.0, 0.0]


def test_ngrams_read_the_text_once(spark):
    df = spark.range(12).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("é x"), 10000)).alias("t"))
    got = done_within(60, df.select(F.size(T.char_ngrams(F.regexp_replace("t", r"\s+", ""), 2)).alias("n")))
    assert {r.n for r in got} == {3, 4}


def test_distinctive_share(spark):
    texts = spark.range(200000).select(F.lit(1).alias("doc_id"), F.col("id").alias("text_id"), F.expr("repeat(concat('total ', id % 2), 30)").alias("text")).unionByName(spark.createDataFrame([(1, -1, ""), (None, -2, "abcde")], "doc_id int, text_id long, text string"))
    common = spark.createDataFrame([(1, g) for g in ("tota", "otal", "tal0", "al0t", "l0to", "0tot")], "doc_id int, gram string")
    got = done_within(60, M.distinctive_share(texts, common).groupBy("share", "distinctive").count())
    assert {(round(r.share, 3), r.distinctive, r["count"]) for r in got} == {(0.0, False, 100001), (round((177 - 60) / 177, 3), True, 100000), (1.0, True, 1)}


def test_token_pages(spark):
    tokens = [(1, "1,234.50"), (1, "a b"), (1, "b c1"), (1, "Net"), (1, "none"), (2, "2345"), (1, ""), (1, "34.5")]
    pages = [(1, 1, "x 1234.50万元 a"), (1, 2, "b 1,234.50 a b"), (1, 3, "a b c1 net"), (2, 4, "12345678"), (2, 5, "1 2 345"), (1, 6, ""), (1, 7, None)]
    expected = {}
    for d, t in tokens:
        hit = {p for e, p, text in pages if e == d and text is not None and any(f in text.lower() for f in (t.lower(), t.lower().replace(",", "")))}
        if hit:
            expected[d, t] = len(hit)
    got = M.token_pages(spark.createDataFrame(tokens, "doc_id int, token string"), spark.createDataFrame(pages, "doc_id int, page_number int, text string"))
    assert {(r.doc_id, r.token): r.pages for r in got.collect()} == expected
    tokens = spark.range(30000).selectExpr("1 AS doc_id", "string(id + 100000) AS token")
    pages = spark.range(30000).selectExpr("1 AS doc_id", "id AS page_number", "concat('no ', id + 100000, '.50 end') AS text")
    assert [tuple(r) for r in done_within(60, M.token_pages(tokens, pages).groupBy("pages").count())] == [(1, 30000)]


def test_sparse_columns_deal_rows_by_table_only(spark):
    plan = plans.queries()["drop_sparse_columns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange (hashpartitioning\([^)]*\))", plan)
    assert dealt and all(re.fullmatch(r"hashpartitioning\(table_id#\d+L, \d+\)", x) for x in dealt)


def _without_sparse(rows):
    """rows: {row_idx: {col_idx: text}} of a table."""
    width = max(c for row in rows.values() for c in row) + 1
    s = {r: [(row.get(c) or "").strip() for c in range(width)] for r, row in rows.items()}
    data = [r for r in rows if r >= 3 and not (width > 1 and s[r][0] and not any(s[r][1:]))]
    held = [sum(s[r][c] != "" for r in data) for c in range(width)]
    sparse = {c for c in range(width) if len(rows) >= 2 and data and held[c] / len(data) < (0.5 if held[c] <= 2 else 0.15)}
    full = {r: [c for c in range(width) if s[r][c]] for r in data}
    gone = sparse - {full[r][0] for r in data if full[r] and not set(full[r]) - sparse}
    kept = [c for c in range(width) if c not in gone]
    if not gone or not kept:
        return {(r, c, t) for r, row in rows.items() for c, t in row.items()}
    ends = [*kept[1:], width]
    return {(r, k, " ".join(filter(None, s[r][c:e])) if any(s[r][c + 1 : e]) else rows[r].get(c) or "") for r in rows for k, (c, e) in enumerate(zip(kept, ends))}


def test_sparse_columns(spark):
    dealt = random.Random(3)
    tables = {}
    for t in range(120):
        rates = [dealt.choice((0.02, 0.1, 0.2, 0.6, 0.95)) for _ in range(dealt.randrange(1, 7))]
        tables[t] = {r: {c: dealt.choice(("a", " b ", "\u3000c")) if dealt.random() < x else dealt.choice(("", " ", None)) for c, x in enumerate(rates) if not c or dealt.random() < 0.9} for r in range(dealt.randrange(1, 30))}
    cells = [(t, r, c, x) for t, rows in tables.items() for r, row in rows.items() for c, x in row.items()]
    got = P.drop_sparse_columns(spark.createDataFrame([*cells, (None, 0, 1, "n")], "table_id long, row_idx int, col_idx int, text string")).collect()
    expected = {(t, *x) for t, rows in tables.items() for x in _without_sparse(rows)} | {(None, 0, 1, "n")}
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
