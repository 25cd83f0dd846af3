"""What must hold when one key has a third of all rows: places, free numbers, links of texts, signatures, indexes, imports."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colophon.operators import linkage, numbering, similarity
from colophon.sources import exports, vectors, workbooks


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_places_spread_over_ranges(spark):
    rows = [("hot" if i % 3 == 0 else f"g{i % 50}", (i * 7919) % 6000, i) for i in range(6000)] + [(None, 5, -1), (None, 3, -2)]
    df = spark.createDataFrame(rows, "g string, n long, id long")
    placed = {(r.g, r.id): r.at for r in numbering.place_in_group(df, ["g"], "n", "at", ["id"], range_rows=256).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for at, (_, i) in enumerate(sorted((n, i) for h, n, i in rows if h == g), 1):
            want[g, i] = at
    assert placed == want
    total = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[2]))
    ranked = numbering.ranked(df, ["g", "id"], "place", ranges=7)
    assert {r.id: r.place for r in ranked.collect()} == {r[2]: at for at, r in enumerate(total, 1)}
    assert "SinglePartition" not in plan_of(ranked)
    inside = {r.id: r.at for r in numbering.place_in_order(df, ["g"], ["id"], "at").collect()}
    assert inside == {i: at for g in {r[0] for r in rows} for at, i in enumerate(sorted(r[2] for r in rows if r[0] == g), 1)}


@pytest.mark.parametrize("ranges", [4, 1000])
def test_free_numbers(spark, ranges):
    rng = random.Random(5)
    taken = {f"k{k}": {rng.randint(-3, 60) for _ in range(rng.randint(0, 40))} for k in range(12)}
    taken["dense"], taken["none"] = set(range(1, 41)), set()
    wanted = [(k, n, f"{k}/{n}") for k in taken for n in range(1, 30)]
    got = numbering.free_numbers(
        spark.createDataFrame(wanted, "k string, nth long, extra string"),
        spark.createDataFrame([(k, n) for k, v in taken.items() for n in [*v, *v]], "k string, number int"), "k", "nth", range_rows=ranges,
    )
    free = lambda k: [n for n in range(1, 200) if n not in taken[k]]
    assert {r.extra: r.number for r in got.collect()} == {e: free(k)[n - 1] for k, n, e in wanted}
    assert got.columns == ["k", "nth", "extra", "number"]


def test_export_names_of_one_name(spark):
    names = ["a.jpg"] * 400 + [f"a ({n}).jpg" for n in (2, 3, 7, 399)] + ["b"] * 3 + ["b (1)"]
    df = spark.createDataFrame(list(enumerate(names)), "n long, name string")
    got = {r.n: r.exported_file for r in exports.export_names(df, "name", "n").collect()}
    free = iter(x for x in range(1, 1000) if x not in (2, 3, 7, 399))
    assert [got[i] for i in range(400)] == ["a.jpg"] + [f"a ({next(free)}).jpg" for _ in range(399)]
    assert [got[i] for i in range(404, 408)] == ["b", "b (2)", "b (3)", "b (1)"] and len(set(got.values())) == len(names)


def similar(a, b):
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and short in long:
        return 0.68 + 0.22 * len(short) / len(long)
    x, y = grams(a), grams(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def test_similar_texts_equal_brute_force_with_hot_tokens(spark, monkeypatch):
    monkeypatch.setattr(linkage, "HOT_TOKEN", 16)
    rng = random.Random(3)
    make = lambda n, k: list({"".join(rng.choice("abcdef ") for _ in range(rng.randint(1, k))).strip() or "x" for _ in range(n)})
    left, right = make(60, 40) + ["abcabc" * 30, "q"], make(150, 60) + ["q" + "abc" * n for n in range(1, 40)] + ["q"]
    side = lambda values: spark.createDataFrame([("t", v) for v in values], "kind string, value string")
    got = {(r.left_value, r.right_value): r.similarity for r in linkage.similar_texts(side(left), side(right)).collect()}
    want = {(a, b): s for a in left for b in right if (s := similar(a, b)) >= 0.6}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 100


def products_of(spark, rows):
    return linkage.profiles(spark.createDataFrame(rows, "key string, title string, circle string, author string, identifier string"))


def test_states_are_bounded_and_equal_the_pairs(spark):
    """A catalogue of one text with many codes is one view; states, near matches and statuses follow from the pairs."""
    rng = random.Random(11)
    title = lambda: rng.choice(["old map of rome", "old map of roma", "new map", "atlas", "", "old mapp of rome"])
    other = lambda: rng.choice(["press one", "press onee", "house", ""])
    local = [(f"l{i:04}", "old map of rome" if i % 3 == 0 else title(), "press one" if i % 3 == 0 else other(), "ann" if i % 3 == 0 else other(), f"AB{i}" if i % 2 else "") for i in range(300)]
    offers = [(f"c{i:03}", title(), other(), other(), f"ab {rng.randint(0, 320)}" if i % 4 == 0 else "") for i in range(60)]
    c, l = products_of(spark, offers), products_of(spark, local)
    pick = c.filter("rand(3) < 0.4").select(F.col("profile").alias("c")).crossJoin(l.filter("rand(4) < 0.05").select(F.col("profile").alias("l")))
    covers = numbering.written(pick.withColumn("cover_similarity", F.rand(5)), "covers")
    views = numbering.written(linkage.match_views(c, l, covers), "views")
    pairs = linkage.pair_verdict(linkage.pair_evidence(linkage.block_pairs(c, l, covers), c, l, covers)).filter("verdict IN ('LIKELY_MATCH', 'POSSIBLE_MATCH')")
    pairs = pairs.join(l.select(F.col("profile").alias("l"), "copies", "first_key"), "l").select("c", "l", "score", "verdict", "copies", "first_key").collect()
    got = linkage.spelled_out(views, l, covers).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, pairs)) and len(pairs) > 300
    assert views.agg(F.max("n"), F.sum("n")).first() == (50, len(pairs))  # all codes of one text are one row per candidate
    want, near_pairs = {}, set()
    for key in {r.c for r in pairs}:
        mine = sorted((r for r in pairs if r.c == key), key=lambda r: (-linkage.QUALITY[r.verdict], -r.score, r.first_key))
        near = [r for r in mine if mine[0].score - r.score <= 8]
        near_pairs |= {(r.c, r.l) for r in near}
        want[key] = (mine[0].verdict, mine[0].score, mine[0].first_key, len(near), sum(r.copies for r in near), len(mine) - len(near))
    states = linkage.match_states(views)
    assert {r.c: tuple(r)[1:] for r in states.collect()} == want
    assert {(r.c, r.l) for r in linkage.ambiguous_matches(views, states, l, covers).collect()} == near_pairs


def test_hamming_pairs_with_a_hot_band(spark):
    rng = random.Random(9)
    hot = [(rng.getrandbits(46) << 18) | 0x2AAAA for _ in range(300)]
    base = [rng.getrandbits(64) for _ in range(300)] + hot
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(2)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    values = [signed(v) for v in base + near + base[:50]]
    df = spark.createDataFrame(list(enumerate(values)), "id long, signature long")
    got = similarity.hamming_pairs(df, hot_rows=64).collect()
    distinct = np.array(sorted(set(values)), dtype=np.int64)
    apart = np.bitwise_count(distinct.view(np.uint64)[:, None] ^ distinct.view(np.uint64)[None, :])
    want = {(int(distinct[i]), int(distinct[j])): int(apart[i, j]) for i, j in zip(*np.nonzero(np.triu(apart <= 8, 1)))}
    assert len(got) == len(want) and {(r.signature_a, r.signature_b): r.distance for r in got} == want
    copies = {v: values.count(v) for v in set(values)}
    assert all(r.copies_a == copies[r.signature_a] and r.first_id_b == values.index(r.signature_b) for r in got)


def test_sampled_baseline_moves_only_what_is_drawn(spark):
    rng = np.random.default_rng(2)
    rows = [("g" if i % 3 else "h", i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(3000, 6)) + 0.4)]
    df = spark.createDataFrame(rows + [("two", -1, [1.0] + [0.0] * 5), ("two", -2, [1.0] + [0.0] * 5)], "g string, id long, embedding array<double>")
    exact = {r.g: r.baseline for r in similarity.baseline_exact(df, "g").collect()}
    whole = {r.g: (r.vectors, r.baseline) for r in similarity.baseline_sampled(df, "g", draws=20_000).collect()}
    few = {r.g: (r.vectors, r.baseline) for r in similarity.baseline_sampled(df, "g", draws=300).collect()}
    assert set(whole) == set(few) == {"g", "h"} and [whole[g][0] for g in "gh"] == [few[g][0] for g in "gh"] == [2000, 1000]
    assert all(abs(whole[g][1] - exact[g]) < 0.02 and abs(few[g][1] - exact[g]) < 0.1 for g in "gh")
    assert few == {r.g: (r.vectors, r.baseline) for r in similarity.baseline_sampled(df.repartition(9), "g", draws=300).collect()}


def test_vector_index_is_replaced_and_pruned(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 12)) * 4
    points = np.repeat(centres, 80, axis=0) + rng.normal(size=(480, 12)) * 0.2
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    make = lambda ids: spark.createDataFrame([("k" if i % 5 else "other", i, f"c{i}", [float(x) for x in points[i]]) for i in ids], "cache_key string, id long, cell string, embedding array<double>")
    path = str(tmp_path / "index")
    vectors.write_vector_index(make(range(480)), path, at=1, blocks=12)
    vectors.write_vector_index(make(range(480)).filter("cache_key = 'k'"), path, at=2, blocks=9)
    assert vectors.read_vector_index(spark, path).count() == 480 and vectors.read_vector_index(spark, path, "k").count() == 384
    assert vectors.read_vector_index(spark, path, "missing").count() == 0
    vectors.write_vector_index(make(range(101)).filter("cache_key = 'k'"), path, at=3, blocks=4)
    assert vectors.read_vector_index(spark, path).count() == 96 + 80 and {r.last_used for r in vectors.kept_indexes(spark, path).collect()} == {1, 3}
    vectors.touch(spark, path, "other", 9)
    assert vectors.kept_indexes(spark, path, 1).first().cache_key == "other"
    vectors.write_vector_index(make(range(480)).filter("cache_key = 'k'"), path, at=4, blocks=12)
    queries = spark.createDataFrame([(i, [float(x) for x in points[i]]) for i in (3, 90)], "query long, embedding array<double>")
    blocks = vectors.needed_blocks(spark, path, "k", queries, 5)
    assert 0 < len(blocks) < 12
    read = vectors.pruned(spark, path, "k", blocks)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    filters = read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("PushedFilters:")[0]
    assert all(c in filters for c in ("cache_key", "version", "block")), filters
    got = [(r["query"], r.id) for r in vectors.search_vector_index(spark, path, "k", queries, 5).orderBy("query", "rank").collect()]
    inside = [i for i in range(480) if i % 5]
    want = [(q, i) for q in (3, 90) for i in sorted(inside, key=lambda i: (-float(points[q] @ points[i]), i))[:5]]
    assert got == want
    assert vectors.search_vector_index(spark, path, "k", queries, 0).count() == 0
    with pytest.raises(FileNotFoundError):
        vectors.search_vector_index(spark, str(tmp_path / "none"), "k", queries, 1)


def test_two_passes_register_each_content_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write = lambda name, data: (folder / name).write_bytes(data)
    write("a.xlsx", b"PK\x03\x04one"), write("b.XLSM", b"PK\x03\x04one"), write("c.csv", b"PK\x03\x04two"), write("d.xlsx", b""), write("e.xlsx", b"not a zip")
    where = [str(folder), str(tmp_path / "registry"), str(tmp_path / "state")]
    assert workbooks.read_registry(spark, where[1]).count() == 0
    first = {r.name: r.outcome for r in workbooks.import_workbooks(spark, *where, at=1, files_per_batch=2).collect()}
    assert sorted(first.pop(n) for n in ("a.xlsx", "b.XLSM")) == ["ADDED", "ALREADY_SAVED"]
    assert first == {"c.csv": "UNSUPPORTED", "e.xlsx": "NOT_A_WORKBOOK"}  # readers have no row for the file without bytes
    write("f.xlsx", b"PK\x03\x04one"), write("g.xlsx", b"PK\x03\x04new")
    again = workbooks.import_workbooks(spark, *where, at=2)
    assert {r.name: (r.outcome, r.imported_at) for r in again.filter("imported_at = 2").collect()} == {"f.xlsx": ("ALREADY_SAVED", 2), "g.xlsx": ("ADDED", 2)}
    assert again.filter("outcome = 'ADDED'").select("sha256").distinct().count() == again.filter("outcome = 'ADDED'").count() == 2
    assert workbooks.import_workbooks(spark, *where, at=3).count() == 6


def test_similar_texts_move_texts_only(spark):
    """No token, and no pair that merely shares one, is shuffled: what is exchanged are texts and blocks."""
    df = spark.createDataFrame([("t", v) for v in ("abc abd", "abc abe", "é", "日本語の本", "日本語の本棚", "")], "kind string, value string")
    found = linkage.similar_texts(df, df)
    assert "regexp_extract_all" not in plan_of(found) and "FlatMapCoGroupsInPandas" in plan_of(found)
    got = {(r.left_value, r.right_value): r.similarity for r in found.collect()}
    texts = [r.value for r in df.collect()]
    assert got == {(a, b): pytest.approx(similar(a, b), abs=1e-12) for a in texts for b in texts if a and similar(a, b) >= 0.6}
