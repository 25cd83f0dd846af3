"""Sheets beyond any reader's limits, page fields inside their element, and streams cut into any number of triggers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colophon.functions.vectors import l2_normalize
from colophon.operators import images, pages, similarity, tables
from colophon.sources.cells import clean_cells
from colophon.streaming import capture


def test_oversized_sheet_is_whole(spark):
    rows = spark.range(25_000).select(F.col("id").cast("int").alias("row"))
    cols = spark.range(600).select(F.col("id").cast("int").alias("col"))
    body = rows.filter("row > 0 AND row NOT IN (24000)").withColumn("col", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumn("text", F.concat_ws("-", "row", "col"))
    head = cols.withColumn("row", F.lit(0)).withColumn("text", F.concat(F.lit("h"), "col"))
    cells = clean_cells(body.unionByName(head).selectExpr("'b' AS workbook", "'s' AS sheet", "'k' AS sheet_key", "row", "col", "text", "0 AS style", "false AS numeric"))
    columns = tables.table_columns(cells, tables.detect_header(cells))
    assert columns.count() == 600
    kept = tables.table_cells(cells, columns)
    assert kept.agg(F.min("row"), F.max("row"), F.count("*")).first() == (1, 23_999, 3 * 23_999)
    left = tables.table_truncation(cells, columns).first()
    assert (left.blank_row, left.skipped_rows, left.first_skipped_row) == (24_000, 999, 24_001)
    some = tables.table_truncation(cells, columns, max_records=10_000).first()
    assert (some.blank_row, some.skipped_rows) == (10_001, 24_998 - 10_000)


def test_every_floating_picture_has_a_place(spark):
    many = spark.range(900).selectExpr("id AS image_id", "'FLOATING' AS kind", "CAST(id DIV 30 AS INT) AS row", "CAST(id % 30 AS INT) AS col", "id AS pos")
    assert images.place_images(many, "A1:AD30").count() == 900
    assert images.place_images(many, "A1:AD30", max_floating=10).count() == 10


def listing(work, maker='<dd class="maker_name"><a title="Circle X" href="/m">Circle X</a></dd>'):
    return f'<ul id="search_result_list"><li data-list_item_product_id="RJ1234">{work}{maker}</li></ul>'


LINK = "https://www.dlsite.com/x/work/=/product_id/RJ1234.html"


@pytest.mark.parametrize("work,title", [
    (f'<dd class="work_name"><a href="{LINK}">Real title</a></dd>', "Real title"),
    (f'<dd class="work_name"><a href="{LINK}" title="Named">Shown</a></dd>', "Named"),
    (f'<dd class="work_name"><a href="{LINK}" title=" ">Shown</a></dd>', "Shown"),
    (f'<dd class="work_name"><i>{"x" * 5000}</i><a href="{LINK}">{"long " * 400}end</a></dd>', "long " * 400 + "end"),
    ('<dd class="work_name">no link</dd>', None),
])
def test_work_fields_stay_in_their_element(spark, work, title):
    page = spark.createDataFrame([(1, listing(work))], "page_id long, html string")
    got = pages.extract_listing(page, pages.DL, "page_id", 10).collect()
    assert [r.title for r in got] == ([] if title is None else [title])
    if title:
        assert got[0].detail_url == LINK and got[0].circle == "Circle X"


def test_normalising_is_linear_in_the_dimension(spark):
    plan = spark.createDataFrame([([1.0, 2.0],)], "v array<double>").select(l2_normalize(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(SQRT(" in plan  # the norm is an argument, not part of the step per component
    assert spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>").select(l2_normalize(F.col("v"))).collect() == [([0.6, 0.8],), ([0.0, 0.0],), (None,)]


def frames_of(spark):
    rows = []
    for device in range(3):
        for k in range(240):
            at = 1_700_000_000 + k * 0.4 + (5000 if k >= 120 else 0) + device * 40
            rows.append((device, at, 10.0 if k % 17 == 0 else 90.0, 120.0, (k // 20) * 0x0F0F0F0F))
    return spark.createDataFrame(rows, "device long, at double, blur double, mean_lum double, signature long").withColumn("ts", F.col("at").cast("timestamp"))


@pytest.mark.parametrize("triggers", [1, 4, 24])
def test_ticks_do_not_depend_on_triggers(spark, tmp_path, triggers):
    frames = frames_of(spark)
    ordered = frames.orderBy("ts").collect()
    size = -(-len(ordered) // triggers)
    for n in range(triggers):
        spark.createDataFrame(ordered[n * size : (n + 1) * size], frames.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = (capture.capture_events(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    got, want = spark.read.parquet(f"{tmp_path}/out"), capture.capture_events_batch(frames)
    assert got.count() == want.count() == len(ordered)
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_exact_baseline_is_a_grid(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(n, 8)) + 0.5)
    copies = np.repeat(unit(1), 40, axis=0)
    apart = np.vstack([np.repeat(unit(1), 6, axis=0), unit(1)])
    groups = {"a": unit(120), "b": unit(3), "c": unit(2), None: unit(31), "copies": copies, "apart": apart}
    rows = [(g, f"{g}{i}", [float(x) for x in v]) for g, m in groups.items() for i, v in enumerate(m)]
    vectors = spark.createDataFrame(rows, "label string, id string, embedding array<double>")
    exact = similarity.baseline_exact(vectors, "label", block_rows=16, few=20)
    got = {r.label: (r.vectors, r.baseline) for r in exact.collect()}
    for g, m in groups.items():
        cosines = (m @ m.T)[np.triu_indices(len(m), 1)]
        want = 0.5 if len(m) < 3 else min(max(float(np.median(cosines)), 0.0), 0.9)
        assert got[g][0] == len(m) and abs(got[g][1] - want) < 1e-9, g
    left, right = similarity._pair_cells(vectors, "label", 16)
    for side in (left, right):  # no task holds a group
        assert side.groupBy("_g", "_b", "_c").count().agg(F.max("count")).first()[0] < 40
