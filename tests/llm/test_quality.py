"""Quality figures against a plain count, binomial bounds against exact sums, and the guarantee of the cutoffs."""

from __future__ import annotations

import random
import re
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from colophon.llm import quality

TEXTS = [
    None, "", " \n ", "a b c d e a b c d e", "one\ntwo\none\n\n one\n", "x " * 3000, "a b c d e f a b c d e g b c d e g",
    "# symbols | and <b> & more * $ %", "É é \x0b tab\tand\x1f unit  space", "u0 " * 4, "plain words only " + "z" * 50_000,
]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)} if len(grams) < 5000 else set()
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n_repeat = len(covered)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n_repeat, len(w) < 10 or 100 * n_repeat > 20 * len(w)


def test_figures(docs_of):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choices("abcd", k=60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, TEXTS[3]), (3, TEXTS[3])]
    got = quality.figures(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[3] if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), text


@pytest.mark.parametrize("n,p", [(1, 0.01), (30, 0.2), (400, 0.01), (20_000, 0.01)])
def test_binomial_bound(spark, n, p):
    exact = lambda k: float(sum(Fraction(comb(n, i)) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))) if n < 1000 else None
    ks = [k for k in (0, 1, 3, 150, 200) if k <= n]
    rows = spark.createDataFrame([(k, n) for k in ks], "k long, n long").select("k", quality.below(F.col("k"), F.col("n"), p).alias("v")).collect()
    for r in rows:
        assert r.v == pytest.approx(exact(r.k), rel=1e-9) if n < 1000 else 0 <= r.v <= 1
    assert [r.v for r in rows] == sorted(r.v for r in rows)


def test_cutoffs_hold_on_good_documents_and_catch_junk(spark, docs_of):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    good = [(i, " ".join(word() for _ in range(40))) for i in range(1500)]
    junk = [(5000 + i, " ".join(word() + "###" for _ in range(40))) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk] + [(None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs_of(good + junk), labels).collect()}
    assert sum(not got[i].kept for i, _ in good) <= 0.05 * len(good) and not any(got[i].kept for i, _ in junk)
    few = quality.judge(docs_of(good[:20] + junk), labels.limit(20)).collect()
    assert all(r.kept for r in few)  # nothing can be proven on twenty labels


def test_the_walk_stops_at_the_first_unsafe_level(spark):
    """Cutoffs per stratum against exact sums: levels count all rules together, strata share the error."""
    rng = random.Random(12)
    rows, want = [], {}
    for stratum, n, tail in (("de", 90, 0), ("en", 2000, 40), ("es", 70, 0), ("fr", 400, 9), ("other", 300, 30)):
        worst = [0.0] * (n - tail) + [rng.choice([0.03, 0.07, 0.18, 0.33]) for _ in range(tail)]
        for w in worst:
            shares = [0.0] * len(quality.RULES)
            shares[rng.randrange(len(shares))] = w
            rows.append((stratum, 1, *shares))
        rows += [(stratum, 0, *[0.9] * len(quality.RULES))] * 50  # junk has no say
        for cutoff in quality.GRID:
            k = sum(w > cutoff for w in worst)
            if sum(comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)) > 0.1 / 5:
                break
            want[stratum] = cutoff
    df = spark.createDataFrame(rows, ["stratum", "quality", *quality.RULES])
    assert {r.stratum: r.cutoff for r in quality.safe_cutoffs(df).collect()} == want
    assert set(want) == {"de", "en", "fr", "other"} and want["de"] == min(quality.GRID) < want["other"]


def test_every_language_has_a_proven_cutoff(spark):
    """On the given labels each listed language rejects junk, and far fewer than the risk of its good documents."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    judged = quality.judge(docs, labels).join(labels, "doc_id").filter("NOT base_failed")
    lost = judged.groupBy("stratum", "quality").agg(F.avg((~F.col("kept")).cast("double")).alias("lost")).collect()
    rate = {(r.stratum, r.quality): r.lost for r in lost}
    assert all(rate[s, 1] <= 0.05 and rate[s, 0] > 0.3 for s in quality.STRATA), rate


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(docs_of([]), none).count() == 0
    assert [r.kept for r in quality.judge(docs_of([(1, "a b c d e f g h i j k l")]), none).collect()] == [True]
