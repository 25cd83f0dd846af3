"""Targets against round-by-round resharing; every source's budget is met to the word."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colophon.llm import mixing


def reshared(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    fixed, left = {}, set(names)
    while left:
        rest, all_weight = sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in left)
        share = {s: rest * weight[s] / all_weight for s in left}
        over = {s for s in left if share[s] > 3 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}
        left -= over
    return fixed


@pytest.fixture(scope="module")
def rows():
    big = [(i, "w " * (1 + i % 37), "en", "b", 0) for i in range(400)]
    small = [(1000 + i, "x y", "en", s, 0) for i, s in enumerate(["a", "c", "c", "d", None, "e", "f", None])]
    odd = [(None, None, None, "b", None), (None, "", "en", "nothing", 0), (7, "same row", "en", "b", 0), (7, "same row", "en", "b", 0), (5000, "long " * 50_000, "en", "g", 0)]
    return big + small + odd


def test_budgets_are_met(docs_of, rows):
    mixed = mixing.mix(docs_of(rows), buckets=16)
    got = mixed.collect()
    assert len(got) == len(rows) and "key" in mixed.columns
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"] and r["size"] == len((r.text or "").split())
    want = reshared(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and taken[s] == round(target[s])
    again = mixing.mix(docs_of(rows).repartition(7), buckets=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_epochs_never_differ_by_more_than_one(docs_of, rows):
    for r in mixing.mix(docs_of(rows)).withColumn("n", mixing.copies(F.col("size"), F.col("taken"))).collect():
        if r["size"]:
            low = round(r.target) // r.source_size
            assert low * r["size"] <= r.taken <= (low + 1) * r["size"] and r.n in (low, low + 1)
        else:
            assert r.n == 0


def test_empty_table(docs_of):
    assert mixing.mix(docs_of([])).count() == 0


def test_clashing_names_are_replaced(docs_of, rows):
    docs = docs_of(rows[:60])
    for name in ("target", "taken", "source_size", "size", "place", "name", "weight"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = mixing.mix(docs, buckets=4)
    plain = mixing.mix(docs_of(rows[:60]), buckets=4)
    pick = lambda df: sorted(str(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect())
    assert pick(got) == pick(plain) and {r.weight for r in got.collect()} == {"clash"}


def test_many_sources(spark):
    """A source per host: places, levels and caps as by resharing."""
    sizes = {f"s{i:05}": (i * 7919) % 97 + 1 for i in range(3000)} | {"big": 40_000, None: 12}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(6)
    found = {r.source: r.target for r in mixing.targets(df).collect()}
    want = reshared(sizes)
    assert found.keys() == want.keys() and all(found[s] == pytest.approx(want[s]) for s in want)
    assert "SinglePartition" not in mixing.ranked(df, ["source"])._jdf.queryExecution().toString()
