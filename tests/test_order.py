"""Ordered results in the order that they promise, ties included: collected rows, not sets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from colophon.operators import facets, linkage, numbering, timeline
from colophon.functions.text import default_order_key, natural_sort_key
from colophon.sources import workbooks


def shuffled(df):
    return df.repartition(5, F.rand(3))


def test_natural_order_and_places(spark):
    names = ["image2", "image10", "Image1", "image01", "image1", "b", "A2", "a10", "", "image", "image2x"]
    want = ["", "A2", "a10", "b", "image", "Image1", "image01", "image1", "image2", "image2x", "image10"]
    df = shuffled(spark.createDataFrame([(n,) for n in names], "name string")).withColumn("key", natural_sort_key(F.col("name")))
    assert [r.name for r in df.orderBy("key", "name").collect()] == want
    assert [r.name for r in numbering.ranked(df, ["key", "name"]).orderBy("place").collect()] == want


def test_dated_entries_by_date_then_order_then_id(spark):
    rows = [("a", 20240517, "10"), ("b", 20240517, "9"), ("c", 20230101, None), ("d", None, "1"), ("e", 20240517, None), ("f", 20240517, "9"), ("g", 20250000, "x")]
    df = spark.createDataFrame([(i, (k,) if k else None, o) for i, k, o in rows], "id string, date struct<sort_key:int>, default_order string")
    assert [r.id for r in timeline.order_dated(shuffled(df)).collect()] == ["g", "b", "f", "a", "e", "c"]
    assert [r.id for r in timeline.order_dated(shuffled(df), ascending=True).collect()] == ["c", "b", "f", "a", "e", "g"]


def test_default_order_puts_numbers_first_and_blanks_last(spark):
    values = ["b", "10", "9.5", None, " ", "A", "1e1", "-2"]
    df = shuffled(spark.createDataFrame([(v,) for v in values], "v string"))
    got = [r.v for r in df.orderBy(default_order_key(F.col("v")), F.col("v").asc_nulls_last()).collect()]
    assert got == ["-2", "9.5", "10", "1e1", "A", "b", " ", None]


def test_matches_by_verdict_score_and_key(spark):
    rows = [("c", "l1", 90, "POSSIBLE_MATCH", 1, "k1"), ("c", "l2", 60, "LIKELY_MATCH", 1, "k9"), ("c", "l3", 60, "LIKELY_MATCH", 1, "k2"), ("b", "l1", 50, "POSSIBLE_MATCH", 1, "k1")]
    df = spark.createDataFrame(rows, "c string, l string, score int, verdict string, copies long, first_key string")
    assert [(r.c, r.l) for r in linkage.rank_matches(shuffled(df)).collect()] == [("b", "l1"), ("c", "l3"), ("c", "l2"), ("c", "l1")]


def test_workbooks_pinned_first(spark):
    at = lambda d: int(datetime(2024, 1, d).timestamp())
    rows = [("a", False, at(3), at(1)), ("b", True, None, at(1)), ("c", False, None, at(9)), ("d", False, at(3), at(2)), ("e", True, at(1), at(1)), ("f", False, None, at(9))]
    df = spark.createDataFrame(rows, "id string, pinned boolean, last_opened long, imported_at long")
    assert [r.id for r in workbooks.list_workbooks(shuffled(df)).collect()] == ["e", "b", "d", "a", "c", "f"]


def test_a_filter_on_another_sheet_excludes_a_record(spark):
    rows = [("b", s, s, r, c, v) for s in ("s1", "s2") for r in (1, 2) for c, v in ((0, f"x{r}"), (1, "same"))]
    table = spark.createDataFrame(rows, "workbook string, sheet_key string, sheet string, row int, col int, shown string").withColumn("text", F.col("shown"))
    pick = lambda *f: sorted((r.sheet, r.row) for r in facets.facet_filter(table, spark.createDataFrame(f, "sheet string, col int, value string")).collect())
    assert pick(("s1", 1, "same")) == [("s1", 1), ("s1", 2)] and pick(("s1", 1, "same"), ("s1", 0, "x2")) == [("s1", 2)]
    assert pick(("s1", 1, "same"), ("s2", 1, "same")) == [] and pick(("s1", 0, "x1"), ("s1", 0, "x2")) == []
