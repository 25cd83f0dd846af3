"""Steps whose work or traffic grew faster than their input."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from colophon.operators import linkage, similarity, tables
from colophon.plans import QUERIES, inputs


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_signatures_that_share_bands_never_become_rows(spark):
    df = spark.range(50).selectExpr("id", "id * 7919 AS signature")
    plan = plan_of(similarity.hamming_pairs(df))
    # the one join looks up which bands are hot: candidates are compared inside a task
    assert "FlatMapGroupsInPandas" in plan and "SortMergeJoin" not in plan and plan.count("HashJoin") == 1


def test_pairs_by_two_bands_equal_brute_force(monkeypatch):
    monkeypatch.setattr(similarity, "FEW_PAIRS", 0)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (4, 300), dtype=np.uint64)
    values = np.unique(np.concatenate([base, base ^ flips[0] ^ flips[1], base ^ flips[0] ^ flips[1] ^ flips[2] ^ flips[3], base[:100] | np.uint64(0x3FFFFFF)]))
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    want = sorted(zip(*(p.tolist() for p in np.nonzero(np.triu(apart <= 8, 1)))))
    cuts = similarity._bands(10)
    for parts in (1, 2):  # a set with itself, and two parts with each other
        side = np.arange(len(values)) % parts
        found = []
        for i in range(len(cuts) - 1):
            for u in range(parts):
                for v in range(u, parts):
                    p, q = np.nonzero(side == u)[0], np.nonzero(side == v)[0]
                    x, y = similarity._near_pairs(values[p], values[q], u == v, cuts, i, 8)
                    found += [tuple(sorted(pair)) for pair in zip(p[x].tolist(), q[y].tolist())]
        assert sorted(found) == want and len(want) > 800


def test_the_table_is_not_built_where_only_columns_are_asked(spark, tmp_path):
    for source in Path("/root/testdata/sf0.001").iterdir():
        (tmp_path / source.name).symlink_to(source)
    kept = set(inputs._STORED)
    QUERIES["resolve_mapping"](spark, str(tmp_path)).count()
    QUERIES["health_structure"](spark, str(tmp_path)).count()
    assert {name for _, _, name in set(inputs._STORED) - kept} == {"clean_cells", "columns"}


def test_cells_do_not_move_for_columns(spark):
    cells = spark.createDataFrame(
        [("b", "k", "s", r, c, f"h{c}" if r == 1 else "x" * 50) for r in (0, 1, 30) for c in range(1, 5) if r != 0 or c == 1]
        + [("b", "k", "s", 40, 9, "outside"), ("b", "k", "s", 0, 2, "above")],
        "workbook string, sheet_key string, sheet string, row int, col int, text string",
    )
    columns = tables.table_columns(cells, tables.detect_header(cells))
    plan = plan_of(columns)
    assert plan.count("partial_max(row") == 1  # beyond the first rows, a task adds up before anything is exchanged
    got = sorted((r.idx, r.col, r["name"], r.labels) for r in columns.collect())
    assert got == [(c - 1, c, f"h{c}", 4) for c in range(1, 5)]


def test_vectors_move_once_whatever_the_number_of_blocks(spark):
    rng = np.random.default_rng(8)
    m = rng.integers(-2, 3, (60, 5)).astype(float)  # small whole numbers: many equal scores
    rows = [(i, f"c{(i * 37) % 60:02}", [float(x) for x in v]) for i, v in enumerate(m)]
    vectors = spark.createDataFrame(rows, "id long, cell string, embedding array<double>")
    asked = vectors.filter("id % 3 = 0").selectExpr("id AS query", "id AS true_id", "transform(embedding, x -> x + 1) AS embedding")
    scores = (m[::3] + 1) @ m.T
    want = {}
    for n, q in enumerate(range(0, 60, 3)):
        true = scores[n, q]
        ahead = [j for j in range(60) if j != q and (scores[n, j] > true or (scores[n, j] == true and rows[j][1] < rows[q][1]))]
        want[q] = (len(ahead) + 1, true, scores[n].max())
    for block_rows in (7, 4096):
        found = similarity.true_ranks(asked, vectors, block_rows)
        plan = plan_of(found)
        assert "CartesianProduct" in plan and "CoGroup" not in plan and "explode" not in plan
        assert {r["query"]: (r["rank"], r.true_score, r.top_score) for r in found.collect()} == want
    none = vectors.filter("id < 0")
    assert similarity.true_ranks(asked.limit(0), vectors).count() == 0 and similarity.topk_inner_product(asked, none, 2).count() == 0


def test_true_ranks_hand_on_a_query_only_where_its_true_score_may_be_reached(spark, monkeypatch):
    grids, over_blocks = [], similarity._over_blocks
    monkeypatch.setattr(similarity, "_over_blocks", lambda *a: grids.append(over_blocks(*a)) or grids[-1])
    rng = np.random.default_rng(4)
    m = rng.normal(size=(120, 16))
    m /= np.linalg.norm(m, axis=1)[:, None]
    m[50], m[51] = m[49], m[49] + 1e-9 * m[7]  # a copy, and one that single precision cannot tell from it
    rows = [(i, f"c{(i * 37) % 120:03}", [float(x) for x in v]) for i, v in enumerate(m)]
    vectors = spark.createDataFrame(rows, "id long, cell string, embedding array<double>")
    asked = m + 0.01 * m[::-1]
    asked[:3] = m[60:63]  # three queries whose true vector is not the nearest
    queries = spark.createDataFrame([(i, i, [float(x) for x in q]) for i, q in enumerate(asked)], "query long, true_id long, embedding array<double>")
    scores = asked @ m.T
    own = scores.diagonal()[:, None]
    before = np.array([[rows[j][1] < rows[i][1] for j in range(120)] for i in range(120)])
    beats = (scores - own > 1e-12) | ((abs(scores - own) <= 1e-12) & before)
    np.fill_diagonal(beats, False)
    found = similarity.true_ranks(queries, vectors, 10).collect()
    assert {r["query"]: r["rank"] for r in found} == {i: int(n) + 1 for i, n in enumerate(beats.sum(axis=1))}
    assert all(abs(r.top_score - scores[r["query"]].max()) < 1e-14 and abs(r.true_score - own[r["query"], 0]) < 1e-14 for r in found)
    assert grids[0].count() <= 120 + 3 * 12 + 3 * 2  # of 120 queries x 12 blocks


def test_no_row_that_reaches_the_least_score_is_left_out():
    rng = np.random.default_rng(5)
    for scale_a, scale_b in ((1.0, 1.0), (1e-60, 1e60), (1e40, 1e40), (1e-25, 1e-25)):
        a, b = rng.normal(size=(700, 33)) * scale_a, rng.normal(size=(90, 33)) * scale_b * rng.uniform(0.01, 1.0, (90, 1))
        top = (a @ b.T).max(axis=1)
        assert similarity._may_reach(a, b, top).all() and not similarity._may_reach(a, b, top + 0.01 * abs(top).max()).any()
    a, b = rng.normal(size=(6, 4)), rng.normal(size=(5, 4))
    a[0], a[1], a[2, 0], a[3, 0], a[4] = 0.0, 1e200, np.nan, np.inf, 1e-200
    assert similarity._may_reach(a, b, np.array([0.0, *[np.inf] * 3, 0.0, np.inf])).tolist() == [True] * 5 + [False]
    b[1, 2] = np.nan
    assert similarity._may_reach(a, b, np.full(6, np.inf)).all()


def test_a_join_of_few_bytes_is_dealt_by_the_rows_it_makes(spark):
    left = spark.range(400).selectExpr("id AS a", "if(id % 20 = 0, NULL, if(id < 300, 'hot', 'k' || id % 7)) AS k")
    right = spark.range(90).selectExpr("id AS b", "if(id % 9 = 0, NULL, if(id < 60, 'hot', 'k' || id % 11)) AS k")
    want = sorted(map(tuple, left.join(right, "k").select("a", "b", "k").collect()))
    for x, y in ((left, right), (right, left)):  # either side may be the larger one
        met = linkage._dealt_join(x, y, ["k"], cell_rows=1000)
        tasks = {r.t for r in met.filter("k = 'hot'").select(F.spark_partition_id().alias("t")).collect()}
        assert sorted(map(tuple, met.select("a", "b", "k").collect())) == want and len(tasks) > 1
