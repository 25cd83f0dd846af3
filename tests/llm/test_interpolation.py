"""Counts and scores against a plain model over the same texts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colophon.llm import interpolation as ip


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    vocab = ["the", "The", "of", "é", "É", "x\x1fy", *[f"w{i}" for i in range(60)]]
    rows = [(i, " ".join(rng.choices(vocab, weights=[30, 5, 20] + [1] * 63, k=rng.randint(1, 60)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, "the of " * 4000), (None, "the x"), (7, rows[7][1])]


def role_of(i):
    return 0 if i is None or i % 5 == 2 else 2 if i % 5 == 3 else 1


def test_scores(docs_of, corpus):
    role = F.when(F.col("doc_id").isNull() | (F.col("doc_id") % 5 == 2), 0).when(F.col("doc_id") % 5 == 3, 2).otherwise(1)
    kept = {}
    learn = ip.learn
    ip.learn = lambda *a: kept.setdefault("w", learn(*a))
    try:
        got = ip.score(docs_of(corpus), role, chunk_tokens=500, part_tokens=300).collect()
    finally:
        ip.learn = learn
    train = [t for i, text in corpus if role_of(i) for t in [tokens(text)]]
    one, two = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["\n", *t], t))
    n, v, w = sum(one.values()), len(one), kept["w"]
    assert len(got) == len(corpus) and (abs(w.sum(axis=1) - 1) < 1e-9).all()
    texts = {i: text for i, text in corpus}
    for r in got:
        t = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(one[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((one[x] + 1) / (n + v + 1)) for x in t))
        p = 0.0
        for a, b in zip(["\n", *t], t):
            k = int(ip.bucket(__import__("numpy").array([one[a]]))[0])
            p += math.log10(w[k, 0] * two[a, b] / max(1, one[a]) + w[k, 1] * one[b] / n + w[k, 2] / (v + 1))
        assert r.score == pytest.approx(p)


def test_weights_beat_the_base_on_unseen_texts(docs_of):
    rng = random.Random(8)
    after = {a: rng.choices("bcdefgh", k=2) for a in "abcdefgh"}

    def text():
        out = ["a"]
        for _ in range(50):
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    rows = [(i, text()) for i in range(200)]
    role = F.when(F.col("doc_id") % 5 == 0, 0).when(F.col("doc_id") % 5 == 1, 2).otherwise(1)
    scored = ip.score(docs_of(rows), role).filter("doc_id % 5 = 0")
    s = scored.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    unseen = [t.split() for i, t in rows if i % 5 == 0]
    truth = sum(math.log10(after[a].count(b) / 2) for t in unseen for a, b in zip(t, t[1:], strict=False))
    ends = len(unseen) * 2 * math.log10(1 / 50)
    assert s.b < s.s and s.s > 1.1 * (truth + ends)


def test_no_training_text_and_no_text(docs_of):
    got = ip.score(docs_of([(1, "a b"), (2, None)]), F.lit(0)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert ip.score(docs_of([]), F.lit(1)).count() == 0


def test_counts_beyond_32_bits_do_not_wrap(spark):
    """Two chunks that each hold a word three thousand million times: sums, and the counts that chunks get back."""
    import numpy as np

    codes, many = np.array([5, 9, 1 << 63], dtype=np.uint64), np.array([3_000_000_000, 7, 4_294_967_295], dtype=np.uint32)
    unique, both, fit = ip._added([codes, codes[1:]], [many, many[1:]], [False, True])
    assert unique.tolist() == codes.tolist() and both.tolist() == [3_000_000_000, 14, 2 * 4_294_967_295] and fit.tolist() == [int(x) for x in many]
    plane = lambda a: bytearray(ip._planes(a))
    rows = [(0, c, d, plane(codes), plane(many), plane(codes), plane(many)) for c, d in (("a", False), ("b", True))]
    asked = spark.createDataFrame(rows, "part int, chunk string, deleted boolean, words binary, word_counts binary, pairs binary, pair_counts binary")
    got = {r.chunk: r for r in ip.answers(asked).collect()}
    assert ip._plain(bytes(got["a"].words), np.uint64).tolist() == [6_000_000_000, 14, 8_589_934_590]
    assert ip._plain(bytes(got["b"].pairs_fit), np.uint64).tolist() == [int(x) for x in many]
    assert sum(r.tokens for r in got.values()) == 2 * int(many.sum(dtype=np.int64))
