"""Links as ranges: any size, overlaps, links on records, and what a link says."""

from __future__ import annotations

from pyspark.sql import functions as F

from colophon.operators import tables

SHEET = ("'b' AS workbook", "'k' AS sheet_key", "'s' AS sheet")
RELS = "workbook string, sheet_key string, rel_id string, target string, external boolean"
LINKS = "workbook string, sheet_key string, sheet string, ord long, ref string, location string, rel_id string, display string"


def links_of(spark, *rows):
    links = spark.createDataFrame([("b", "k", "s", n, *r) for n, r in enumerate(rows)], LINKS)
    return links, spark.createDataFrame([("b", "k", "r1", "https://x.example", True)], RELS)


def test_range_keys_are_a_partition(spark):
    """Every row of a range has exactly one of the range's keys, rows outside have none."""
    spans = [(0, 0), (0, 63), (1, 64), (5, 4500), (63, 64), (4096, 8191), (4095, 300_000), (17, 1_048_575), (0, 9_999_999)]
    ranges = spark.createDataFrame([("b", "k", "s", a, b) for a, b in spans], "workbook string, sheet_key string, sheet string, row_from int, row_to int")
    picks = sorted({max(0, x + d) for a, b in spans for x in (a, b, (a + b) // 2) for d in (-1, 0, 1)})
    rows = spark.createDataFrame([("b", "k", "s", r) for r in picks], "workbook string, sheet_key string, sheet string, row int")
    got = sorted((r.row_from, r.row_to, r.row) for r in tables.rows_in_ranges(rows, ranges).collect())
    assert got == sorted((a, b, r) for a, b in spans for r in picks if a <= r <= b)
    keys = ranges.select(F.size(tables._range_keys(F.col("row_from"), F.col("row_to"))).alias("n")).agg(F.max("n")).first()[0]
    assert keys <= 126 * tables.ROW_LEVELS


def test_a_link_over_many_cells_reaches_all(spark):
    links, rels = links_of(
        spark, ("A1:CV100000", None, "r1", "all"), ("B5:B7", " Other!A1 ", None, " "), ("nowhere", "x", None, None),
        ("C1", None, "missing", None), ("A100:not", None, "r1", "one"), ("D9:$D$3", "Name", None, "named"),
    )
    ranges = tables.link_ranges(links, rels)
    cells = spark.range(100_000).selectExpr(*SHEET, "CAST(id AS INT) AS row", "CAST(id % 4 AS INT) AS col")
    found = tables.expand_links(cells, ranges)
    assert found.count() == 100_000  # ten million covered cells, each given one linked once
    by = {(r.row, r.col): (r.target, r.internal, r.label) for r in found.filter("row < 120").collect()}
    assert by[5, 1] == ("Other!A1", True, None) and by[9, 1] == ("https://x.example", False, "all")
    assert by[7, 3] == ("Name", True, "named") and by[3, 3] == ("Name", True, "named") and by[11, 3][2] == "all"
    limited = tables.link_ranges(links, rels, max_cells=1024).collect()
    assert [(r.row_from, r.row_to, r.col_from, r.col_to) for r in limited if r.ord == 0] == [(0, 0, 0, 0)]
    assert {r.ord: (r.row_from, r.row_to, r.col_from) for r in ranges.collect()}[4] == (99, 99, 0)
    assert tables.expand_links(cells.limit(0), ranges).count() == tables.expand_links(cells, ranges.limit(0)).count() == 0


def test_links_on_records(spark):
    links, rels = links_of(spark, ("A2:C3", None, "r1", "all"), ("B3", "'My sheet'!C4", None, None))
    columns = spark.range(3).selectExpr(*SHEET, "0 AS header_row", "CAST(id AS INT) AS idx", "CAST(id AS INT) AS col", "concat('h', id) AS name", "3 AS labels")
    table = spark.range(1, 5).selectExpr(*SHEET, "CAST(id AS INT) AS row", "0 AS idx", "0 AS col", "'h0' AS name", "'t' AS text", "'t' AS shown")
    records = tables.table_records(table, columns, tables.record_links(table, columns, tables.link_ranges(links, rels)))
    got = {r.row: r["links"] for r in records.collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[3] == got[4] == {}
    assert sorted(got[1]) == [0, 1, 2] and got[2][1].target == "'My sheet'!C4" and got[2][2].label == "all"  # blank cells too


def test_what_a_link_says(spark):
    rows = [("https://a", False, None), ("MAILTO:x@y", False, "me"), ("file.xlsx", False, None), ("#'My sheet'!A5", True, None), ("LIST!B4", True, None), ("A5", True, None), ("!A", True, None), (" ", True, None)]
    df = spark.createDataFrame([((*r,),) for r in rows], "l struct<target:string,internal:boolean,label:string>")
    found = df.select(tables.link_label(F.col("l")).alias("a"), tables.link_is_openable(F.col("l")).alias("o"), tables.internal_target(F.col("l")).alias("t")).collect()
    assert [r.a for r in found][:2] == ["https://a", "me"]
    assert [r.o for r in found] == [True, True, False, True, True, True, True, False]
    assert [tuple(r.t) if r.t else None for r in found] == [None, None, None, ("My sheet", "A5"), ("LIST", "B4"), None, None, None]
