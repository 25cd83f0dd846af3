"""The kernel machine: table form against landmark form, gapped insults, odd rows and held-out accuracy."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from colophon.llm import toxicity
from colophon.llm.queries import QUERIES


def test_kernel_is_symmetric_positive_and_tolerates_gaps():
    words = ["idiot", "idxiot", "i-d-i-o-t", "garden", "Ünter", "a", "", "x" * 300]
    k = toxicity.kernel(words, words)
    assert np.allclose(k, k.T, atol=1e-5) and np.linalg.eigvalsh(k).min() > -1e-5
    assert k[0, 1] > 3 * k[0, 3] and k[0, 2] > k[0, 3] and k[0, 0] > k[0, 1]


def test_table_gives_the_decision_of_the_landmarks():
    dense = np.random.default_rng(0).normal(size=toxicity.CODES**3).astype(np.float32)
    for word in ["idiot", "garden2", "é", ""]:
        key, value = toxicity.sparse(word)
        assert abs(toxicity.decisions([word], dense, 0.5)[0] - (dense[key] @ value + 0.5)) < 1e-4


def test_long_words_give_the_same_sum():
    dense = np.random.default_rng(1).normal(size=toxicity.CODES**3).astype(np.float32)
    for word in ["ab", "idiot" * 700, "xyz" * 1000]:
        want = toxicity.decisions([word], dense, 0.0)[0]
        assert abs(toxicity._long_decision(word, dense, 50) - want) < 1e-3 * max(1, abs(want))
    assert np.isfinite(toxicity.decisions(["x" * 300_000], dense, 0.0)[0])


def sample(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["th", "er", "on", "an", "re", "he"], k=rng.randint(1, 4)))
    bad = ["idiot", "moron", "scumbag"]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        sentences = [" ".join(word() for _ in range(8)) for _ in range(6)]
        if toxic:
            for j in range(3):
                sentences[j] += " " + rng.choice(bad)
        rows.append((i, ". ".join(sentences), int(toxic)))
    return rows


def test_scores_of_unseen_and_odd_texts(spark, docs_of):
    rows = sample(400, 1)
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    machine = toxicity.fit(docs_of([(i, t) for i, t, _ in rows]), labels, landmarks=64)
    fresh = sample(100, 2)
    odd = [(900, None), (901, ""), (902, "the ther idxiot, so"), (903, "er " * 50_000), (None, "m-o-r-o-n and mor0n idi.ot"), (905, "an i d i o t he is"), (905, "an i d i o t he is")]
    got = toxicity.score(docs_of([(1000 + i, t) for i, t, _ in fresh] + odd), machine).select("doc_id", "score").collect()
    assert len(got) == 107 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert all((by[1000 + i] >= 0.3) == bool(t) for i, _, t in fresh)
    assert by[900] < 0.3 and by[901] < 0.3 and by[903] < 0.3 and by[905] >= 0.3 and by[902] > 10 * by[903]


def test_separators_inside_words_are_read(spark, docs_of):
    assert {"st!upid", "stupid", "mo,ron", "moron"} <= toxicity.words_of('A (St!upid) and "mo,ron".')
    assert "idiot" in toxicity.words_of("an i.d.i.o.t, he is") and "idiot" in toxicity.words_of("(i d i o t)")
    for long in ("a" * 300_000, "a" + "!" * 300_000, "!" * 300_000 + "a", "a!" * 150_000):  # one look at each place
        assert toxicity.words_of(long)
    rows = sample(400, 1)
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    machine = toxicity.fit(docs_of([(i, t) for i, t, _ in rows]), labels, landmarks=64)
    gapped = ["idi.ot", "mo,ron", "scum!bag", "i.d.i.o.t,", "(m o r o n)", "idxiot"]
    texts = [(i, f"the ther {w} on an here") for i, w in enumerate(gapped)] + [(100, "the ther er.on, an:here on"), (101, "he.re 3.14 th.er (on.an)")]
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(texts), machine).collect()}
    assert all(got[i] >= 0.3 for i in range(len(gapped))) and got[100] < 0.3 and got[101] < 0.3


def test_without_labels_nothing_is_toxic(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    machine = toxicity.fit(docs_of([(1, "idiot")]), none)
    assert toxicity.score(docs_of([(1, "idiot"), (2, None)]), machine).filter("score >= 0.3").count() == 0
    assert toxicity.score(docs_of([]), machine).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op8_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.03 * n[0, 0]
    assert scored.filter(F.col("score").isNull()).count() == 0
