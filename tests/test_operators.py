"""Operators against brute force and scripted cases on small tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from colophon.functions.vectors import hamming
from colophon.operators import library as lib, linkage, similarity, tables
from colophon.sources import exports, library as store
from colophon.sources.cells import clean_cells
from colophon.streaming import capture


def sheet(spark, rows, name="s"):
    cells = [("w", name, "", r, c, t, 0, False) for r, line in rows.items() for c, t in enumerate(line) if t is not None]
    return clean_cells(spark.createDataFrame(cells, "workbook string, sheet string, sheet_key string, row int, col int, text string, style int, numeric boolean"))


def test_table_with_late_header_gap_and_repeat(spark):
    rows = {0: ["Shop list"], 2: ["Title", "Circle", None, "Price"], 4: ["a", "x", "note", "1"], 5: ["Title", "Circle", None, "Price"],
            6: ["b"], 8: ["lost"], 9: ["lost too"]}
    cells = sheet(spark, rows)
    headers = tables.detect_header(cells)
    assert headers.first()["header_row"] == 2
    columns = tables.table_columns(cells, headers)
    assert [(r.idx, r.name) for r in columns.orderBy("idx").collect()] == [(0, "Title"), (1, "Circle"), (2, ""), (3, "Price")]
    table = tables.table_cells(cells, columns)
    records = {r.row: list(r["values"]) for r in tables.table_records(table, columns).collect()}
    assert records == {4: ["a", "x", "note", "1"], 6: ["b", "", "", ""]}
    cut = tables.table_truncation(cells, columns).first()
    assert (cut.blank_row, cut.skipped_rows, cut.first_skipped_row) == (7, 2, 8)


def test_topk_is_exact_over_blocks(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8)).round(3)
    m[7] = m[3]  # a tie
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")
    got = similarity.topk_inner_product(df.withColumnRenamed("id", "query"), df, 4, block_rows=16).collect()
    scores = m @ m.T
    for q in range(60):
        want = sorted(range(60), key=lambda j: (-scores[q, j], j))[:4]
        mine = [r.id for r in sorted((r for r in got if r.query == q), key=lambda r: r["rank"])]
        assert np.allclose(scores[q, mine], scores[q, want])
    assert similarity.topk_inner_product(df.withColumnRenamed("id", "query"), df, 0).count() == 0


def test_dense_index_numbers_every_row_once(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    rows = similarity.dense_index(df, "id", ["g"]).collect()
    for g in range(3):
        assert sorted(r.idx for r in rows if r.g == g) == list(range(sum(1 for r in rows if r.g == g)))


def test_hamming_pairs_lose_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 40)
    values = [int(v) for v in base] + [int(v) ^ int(sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 11), replace=False))) for v in base]
    df = spark.createDataFrame(list(enumerate(values)), "id long, signature long")
    got = {(r.signature_a, r.signature_b) for r in similarity.hamming_pairs(df, 8).collect()}
    bits = lambda a, b: ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count()
    assert got == {(a, b) for a in set(values) for b in set(values) if a < b and bits(a, b) <= 8}
    assert df.select(F.max(hamming(F.col("signature"), F.col("signature")))).first()[0] == 0


def test_similar_texts_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    words = ["red", "blue", "ring", "night", "train", "of", "the", "star", "ab", "abc"]
    texts = sorted({" ".join(rng.choice(words, rng.integers(1, 6))) for _ in range(120)} | {"ab", "abc", "a", "xabcx"})
    df = spark.createDataFrame([("t", t) for t in texts], "kind string, value string")
    got = {(r.left_value, r.right_value): r.similarity for r in linkage.similar_texts(df, df).collect()}

    def grams(s):
        return {s[i : i + 2] for i in range(len(s) - 1)}

    def score(a, b):
        if a == b:
            return 1.0
        short, long = sorted((a, b), key=len)
        if len(short) >= 3 and short in long:
            return 0.68 + 0.22 * len(short) / len(long)
        x, y = grams(a), grams(b)
        return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0

    want = {(a, b): score(a, b) for a in texts for b in texts if score(a, b) >= 0.6}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_frames_script():
    config = capture.DEFAULT

    def play(frames):
        state, phases = capture.START, []
        for now, gate, signature in frames:
            state, tick = capture.step(state, now, gate, signature, config)
            phases.append(tick[0])
        return phases

    steady = [(t * 400, "OK", 7) for t in range(4)]
    assert play(steady) == ["STABILIZING"] * 3 + ["CAPTURED"]
    again = steady + [(1300, "OK", 7)] + [(3000 + t * 400, "OK", 7) for t in range(4)]
    assert play(again)[4:] == ["CAPTURED"] + ["STABILIZING"] * 3 + ["SAME_COVER"]
    forgiven = steady[:2] + [(800, "TOO_DARK", 7)] + [(1200 + t * 400, "OK", 7) for t in range(2)]
    assert play(forgiven)[-1] == "CAPTURED"
    rearmed = steady + [(3000 + t, "TOO_DARK", 7) for t in range(5)] + [(4000 + t * 400, "OK", 7) for t in range(4)]
    assert play(rearmed)[-1] == "CAPTURED"


def test_stream_equals_batch(spark):
    from colophon.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    stream, batch = (QUERIES[n](spark, sf) for n in ("capture_events", "capture_events_batch"))
    columns = ["device", "ts_us", "phase", "stable_count", "capture", "steady", "signature"]
    a, b = stream.select(columns), batch.select(columns)
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


def small_library(spark):
    make = spark.createDataFrame
    return lib.Library(
        make([("b", "Bookmarks", "RESERVED", "BOOKMARKS", 0), ("f", "Shelf", "PROFILE", None, 1), ("g", "Shelf (copy)", "PROFILE", None, 2)],
             "id string, name string, kind string, reserved string, created_at long"),
        make([("s", "f", "ONLINE_SEARCH", "S", None, 5)], "id string, folder_id string, kind string, title string, query string, created_at long"),
        make([("i1", "ONLINE_RESULT", "One", "x:1"), ("i2", "WORKBOOK_MATCH", "Two", "x:2"), ("i3", "ONLINE_RESULT", "Three", "x:3")],
             "id string, kind string, title string, fingerprint string"),
        make([("s", "i1", 0, 5), ("s", "i2", 1, 5)], "session_id string, item_id string, position int, added_at long"),
        make([("i3", "f", 7), ("i3", "b", 8)], "item_id string, folder_id string, added_at long"),
    )


def test_library_operations(spark):
    library = small_library(spark)
    ids = spark.createDataFrame([("i1",), ("i2",), ("nope",)], "item_id string")
    out, report = lib.copy_items(library, ids, "g", 9)
    assert report.first()[:] == (3, 1, 2, 0) and out.memberships.filter("folder_id = 'g'").count() == 1
    assert lib.copy_items(library, ids, "b", 9)[1].first()["failed"] == 3
    gone, _ = lib.delete_folders(library, spark.createDataFrame([("f",), ("b",)], "folder_id string"))
    assert {r.id for r in gone.items.collect()} == {"i3"} and gone.entries.count() == 0
    copied, _ = lib.copy_folders(library, spark.createDataFrame([("f",)], "folder_id string"), 9)
    assert "Shelf (copy) 2" in {r.name for r in copied.folders.collect()} and copied.entries.count() == 4
    moved, report = lib.move_entries(library, ids, "s", "g", 9)
    assert {r.item_id for r in moved.entries.collect()} == {"i2"} and report.first()["changed"] == 1


def test_snapshot_round_trip(spark, tmp_path):
    library = small_library(spark)
    store.write_library(library, str(tmp_path / "snapshot"))
    again = store.load_library(spark, str(tmp_path / "snapshot"))
    assert again.items.exceptAll(library.items).count() == 0 and again.entries.count() == 2


def test_manifest_file(spark, tmp_path):
    rows = spark.createDataFrame([('a, "b".png', "", "x")], "exported_file string, media_file string, format string")
    exports.write_image_manifest(rows.coalesce(1), str(tmp_path / "m"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "m").glob("*.csv")).decode()
    assert text == 'exported_file,media_file,format\r\n"a, ""b"".png",,x\r\n'


def test_export_names_are_unique(spark):
    names = ["a.jpg", "a.jpg", "a (1).jpg", "a.jpg", "d/a.jpg", "x", "x", "..", "n" * 130 + ".png"]
    df = spark.createDataFrame(list(enumerate(names)), "n long, name string")
    got = [r.exported_file for r in exports.export_names(df, "name", "n").orderBy("n").collect()]
    assert got[:7] == ["a.jpg", "a (2).jpg", "a (1).jpg", "a (3).jpg", "a (4).jpg", "x", "x (1)"]
    assert got[7] == "image" and len(got[8]) == 120 and got[8].endswith(".png")
