"""Findings of the third round: 64-bit signatures, late serials, long references, hints, spread feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from colophon.functions import cellref, formats
from colophon.operators import images, linkage, similarity, tables
from colophon.plans.inputs import Inputs
from colophon.streaming import capture

CELLS = "workbook string, sheet_key string, sheet string, row int, col int, text string"


def _broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_rows_made_of_ranges_and_targets_are_not_broadcast(spark):
    cells = spark.createDataFrame([("b", "k", "s", 3, 1, "x")], CELLS)
    targets = spark.range(3).selectExpr("id AS target_id", "'b' AS workbook", "'k' AS sheet_key", "'s' AS sheet", "2 AS target_row", "1 AS target_col")
    assert _broadcasts(tables.window_cells(cells, targets)) == 0 and tables.window_cells(cells, targets).count() == 3
    ranges = spark.sql("SELECT 'b' AS workbook, 'k' AS sheet_key, 's' AS sheet, 0 AS row_from, 999999 AS row_to")
    assert _broadcasts(tables.rows_in_ranges(cells, ranges)) == 0 and tables.rows_in_ranges(cells, ranges).count() == 1


def test_signatures_keep_all_64_bits(spark):
    big = 2**60 + 1
    rows = [(1, f"2024-01-01 00:00:0{n}", 60.0, None if n == 2 else 120.0, big) for n in range(4)]
    frames = spark.createDataFrame(rows, "device long, ts string, blur double, mean_lum double, signature long")
    got = [r.signature for r in capture.capture_events_batch(frames).orderBy("ts").collect()]
    assert got == [big, big, None, big]


def test_serials_beyond_the_year_9999(spark):
    show = lambda raw, kind="DATE", d1904=False: one(spark, formats.display_value(F.lit(kind), F.lit(raw), F.lit(True), d1904))
    assert show("2958465") == "9999-12-31" and show("2958466") == "10000-01-01"
    assert show("3000000.5", "DATE_TIME") == "10113-09-19 12:00" and show("2958465", d1904=True) == "10004-01-01"
    assert show("1000000000000") == "1000000000000"


def test_references_below_row_ten_million(spark):
    parse = lambda ref: one(spark, cellref.a1_parse(F.lit(ref)))
    assert parse("ZZ12000001").asDict() == {"row": 12_000_000, "col": 701}
    assert parse("A2147483648").row == 2**31 - 1 and parse("A2147483649") is None and parse("A0") is None
    assert one(spark, cellref.parse_range(F.lit("A1:ZZ12000001"))).row_to == 12_000_000


def test_spread_feeds_reach_every_task(spark):
    i = Inputs(spark, "/root/testdata/sf0.01")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("shop_pages", "search_log", "goods_pages", "ocr_truth", "cells"):
        assert i.spread(name).rdd.getNumPartitions() >= tasks, name
        assert i.spread(name).count() == i.feed(name).count()


def test_spelled_out_keeps_evidence_and_leaves_covered_pairs_to_their_own_rows(spark):
    rows = [("a", "red fox", "den", "ann", "RJ1"), ("b", "red fox", "den", "ann", "RJ2"), ("d", "red fox", "den", "ann", "RJ3")]
    names = "key string, title string, circle string, author string, identifier string"
    locals_ = linkage.profiles(spark.createDataFrame(rows, names))
    asked = linkage.profiles(spark.createDataFrame([("x", "red fox", "den", "ann", ""), ("y", "red fox", "den", "", "")], names))
    one_pair = asked.filter("author IS NOT NULL").crossJoin(locals_.filter("first_key = 'b'").select(F.col("profile").alias("l")))
    covers = one_pair.select(F.col("profile").alias("c"), "l", F.lit(0.9).alias("cover_similarity"))
    views = linkage.match_views(asked, locals_, covers)
    got = linkage.spelled_out(views, locals_, covers, ("evidence",)).withColumn("cover", F.col("evidence")[4]["similarity"])
    found = sorted((r.c, r.first_key, r.cover or 0.0) for r in got.collect())
    ids = {r.first_key: r.profile for r in asked.collect()}
    assert found == sorted([(ids[o], k, 0.9 if (o, k) == ("x", "b") else 0.0) for o in "xy" for k in "abd"])
    pairs = linkage.block_pairs(asked, locals_, covers)
    plain = {(r.c, r.l): r.evidence for r in linkage.pair_evidence(pairs, asked, locals_, covers).collect()}
    assert {(r.c, r.l): r.evidence for r in got.collect()} == plain


def test_images_group_places_once(spark):
    places = spark.createDataFrame(
        [("m/a.png", "s", "A1", 2, "m/a.png", "a", None), ("m/a.png", "s", "B1", 1, "m/a.png", "a", None), ("unresolved:x", "s", "C1", 3, None, "x", "gone")],
        "key string, sheet string, cell string, pos long, media_path string, reference string, detail string",
    )
    media = spark.createDataFrame([("m/a.png", 5), ("m/b.JPG", 6), ("unresolved:x", 7), (None, 8)], "path string, size_bytes int")
    found = images.image_index(media, places)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [key") == 1
    assert sorted(((r.key or "", r.state, r.size_bytes, r.cell, r.places) for r in found.collect())) == [
        ("", "UNREFERENCED", 8, None, 0), ("m/a.png", "LINKED", 5, "B1", 2), ("m/b.JPG", "UNREFERENCED", 6, None, 0),
        ("unresolved:x", "LINKED", 7, "C1", 1), ("unresolved:x", "UNRESOLVED", -1, "C1", 1),
    ]


def test_references_without_a_path_are_not_one_key(spark):
    refs = spark.range(50).selectExpr("id % 7 AS shape_id", "id AS pos", "'SRC' AS kind", "concat('http://x/', id) AS reference", "'xl/d.vml' AS part")
    rels = spark.createDataFrame([], "part string, rel_id string, target string, external boolean")
    media = spark.createDataFrame([("xl/a.png",)], "path string")
    found = images.resolve_media_refs(refs, rels, media)
    assert "Join LeftOuter, (wanted" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.detail for r in found.collect()} == {"external reference, not a package part"} and found.count() == 50


def test_a_block_of_signatures_is_ranked_in_bounded_memory():
    import tracemalloc

    import numpy as np
    import pandas as pd

    values = np.repeat(np.arange(4, dtype=np.int64), 256)  # most signatures tie
    right = pd.DataFrame({"id": np.arange(1024), "tie": [f"c{i:04}" for i in range(1024)], "signature": values})
    left = pd.DataFrame({"query": np.arange(1024), "signature": values})
    tracemalloc.start()
    got = similarity._nearest(left, right, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = similarity._nearest(left, right, 3, rows=1024)
    assert got.reset_index(drop=True).equals(whole.reset_index(drop=True)) and len(got) == 3 * 1024
    assert peak < 8 << 20 and (got["score"] == 1).all() and (got["id"] // 256 == got["query"] // 256).all()
