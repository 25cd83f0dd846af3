"""Fingerprints against a plain count, components against all pairs, and clusters that would be quadratic in pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colophon.llm import blocks, simhash
from colophon.llm.components import components


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(values, distance):
    v = np.array(values, dtype=np.uint64)
    label = np.arange(len(v))
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= distance):
            label[label == label[j]] = label[i]
    return label


def test_fingerprints(spark, docs_of):
    texts = [None, "", " \n", "one", "One\x1fTWO three", "a b c d", "É é E e à la À LA", " ".join(f"w{i % 900}" for i in range(70_000))]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i].fingerprint == f"{brute_fingerprint(t):016x}"
    assert got[0].component_id == got[1].component_id == got[2].component_id == 0
    in_spark = spark.sql("SELECT xxhash64('a b c d') AS h").first().h
    assert got[5].fingerprint == f"{in_spark % (1 << 64):016x}"


@pytest.mark.parametrize("parts,block_rows", [(3, 4096), (4, 50)])
def test_links_connect_what_all_pairs_connect(spark, parts, block_rows):
    rng = random.Random(parts)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in list(values):
        for _ in range(8):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                v ^= 1 << b
            values.append(v)
    values += [0x0F0F << 20 | 1 << i for i in range(20)]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.root for r in components(simhash.links(table, 4, parts, block_rows)).collect()}
    want = brute_components(values, 4)
    groups = {}
    for v, label in zip(signed, want, strict=True):
        groups.setdefault(label, set()).add(v)
    for members in groups.values():
        assert {got.get(v, v) for v in members} == {min(members)}


def test_copies_nulls_and_near_copies(docs_of):
    rng = random.Random(4)
    base = [f"word{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = [(10, " ".join(base)), (11, " ".join(base)), (None, " ".join(base)), (10, " ".join(base)), (5, " ".join([*base[:200], "other", *base[201:]])), (99, "quite another text of its own")]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id != 99} == {5}
    assert simhash.near_duplicates(docs_of([])).count() == 0
    lone = simhash.near_duplicates(docs_of([(None, "x y z")])).collect()
    assert lone[0].component_id is None


def test_thresholds_meet_the_general_pigeonhole():
    rng = np.random.default_rng(0)
    groups = [list(range(0, 21)), list(range(21, 42)), list(range(42, 64))]
    p = np.r_[np.full(21, 0.5), np.full(21, 0.02), np.full(22, 0.5)]
    t = simhash.allocate(10**6, p, groups, 4)
    assert sum(t) == 2 and t[1] == -1  # the part of fixed bits tells nothing apart and is not probed
    for _ in range(2000):
        x = rng.choice(64, size=rng.integers(0, 5), replace=False)
        assert any(len(set(x) & set(g)) <= k for g, k in zip(groups, t, strict=True))


def test_hot_buckets_are_split(spark):
    rows = spark.range(2000).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("fp")).unionByName(spark.range(50).select((F.col("id") + 10).alias("key"), F.col("id").alias("fp")))
    sizes = blocks.dealt(rows, "key", "fp", 100).groupBy("key").count()
    assert sizes.agg(F.max("count")).first()[0] <= 400 and sizes.filter("count = 1").count() == 50
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, None), (7, 7), (1000, 2000), (2000, 1000)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert len(got) == 303 and all(got[i] == 0 for i in range(301)) and got[2000] == 1000
