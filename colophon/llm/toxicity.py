"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

**Kernel.** Two words are as alike as the three-character subsequences they share; a subsequence that spans more
characters counts less (``DECAY`` to the power of its span) and spans over ``SPAN`` not at all, so gapped words and words
with inserted characters stay close to the plain ones. Words carry a start and an end mark; each is scaled by a function of
its length, which keeps the kernel positive.

**Nyström.** ``landmarks`` words span the feature space: K_mm^-1/2 k(x, landmarks). A squared-hinge machine is trained on
those features. Its decision is a sum over landmarks of kernel values, each of which is a sum over shared subsequences, so
the sums can be swapped: one weight per subsequence (64^3, a bounded table) gives the same decision without comparing a
word with every landmark. That table is all that executors need.

**Training.** From at most ``sample_docs`` toxic and ``CLEAN`` times as many clean labelled documents (the lowest hashes of
their ids): their sentences inherit the label, copies of a sentence count once. Words seen in toxic sentences only, and in
more of them than chance explains (``false_words`` bounds the expected share of chance finds), are positive; words of clean
sentences are negative, weighted by their sentences, first those the machine gets wrong.

**Scoring.** A text is scored by its three highest words through a logistic curve fitted on the sampled documents. Whole
texts are read where they lie: scoring has no shuffle. Runs of single characters ("i d i o t") are read as one word too,
and so are tokens with punctuation inside ("idi.ot"), with and without it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from colophon.llm.shared import written

DECAY, SPAN, CODES = 0.7, 6, 64
CLEAN = 4
START, END = 62, 63
CACHE_ENTRIES = 1 << 17
LONG_WORD = 4096  # characters from which a word is summed in slices; the result is the same
LOWEST = -2.0  # decision where a text has fewer than three words
PURITY, SURE = 0.7, 1.645  # share of its sentences that are toxic at least for a word of both kinds, and the quantile that says so
_SPLIT = re.compile(r"[^\s\"(),.;:!?|]+")
_SPELLED = re.compile(r"(?<![^\s\"(])[^\s\"(),.;:!?|](?:[ .\-_*][^\s\"(),.;:!?|]){2,}(?=[\"(),.;:!?|]*(?!\S))")
_INSIDE = re.compile(r"[\"(),.;:!?|]+")
# A word with such characters put in; every place is looked at once, however long the runs are.
_BROKEN = re.compile(r"(?<![^\s\"(),.;:!?|])[^\s\"(),.;:!?|]++(?:[\"(),.;:!?|]++[^\s\"(),.;:!?|]++)++")


def word_codes(word: str) -> np.ndarray:
    """Letters to 1-26, digits to 27-36, all else by code point to 37-61, between the marks."""
    points = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    out = 37 + points % 25
    letter, digit = (points >= 97) & (points <= 122), (points >= 48) & (points <= 57)
    out[letter], out[digit] = points[letter] - 96, points[digit] - 21
    return np.concatenate(([START], out, [END]))


def _offsets() -> np.ndarray:
    """(second, third, weight exponent) of every subsequence that starts at 0 and spans at most SPAN characters."""
    return np.array([(a, b) for a, b in combinations(range(1, SPAN), 2)], dtype=np.int64)


OFFSETS = _offsets()


def subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (k, 3) of the subsequences of n characters, and their weights scaled for a word of that length."""
    first = np.arange(n)[:, None]
    places = np.stack([np.broadcast_to(first, (n, len(OFFSETS))), first + OFFSETS[:, 0], first + OFFSETS[:, 1]], axis=-1).reshape(-1, 3)
    places = places[places[:, 2] < n]
    weight = DECAY ** (places[:, 2] - places[:, 0] + 1).astype(float)
    return places, weight / max(1e-12, float(np.sqrt((weight**2).sum())))


def sparse(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence codes of a word and their values."""
    codes = word_codes(word)
    places, weight = subsequences(len(codes))
    key = (codes[places[:, 0]] * CODES + codes[places[:, 1]]) * CODES + codes[places[:, 2]]
    unique, at = np.unique(key, return_inverse=True)
    return unique, np.bincount(at, weights=weight, minlength=len(unique))


def decisions(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision for every word; words of one length are handled together, in slices of bounded size."""
    out = np.empty(len(words))
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, members in by_length.items():
        if n > LONG_WORD:
            out[members] = [_long_decision(words[i], weights) + bias for i in members]
            continue
        places, scale = subsequences(n + 2)
        step = max(1, 500_000 // max(1, len(places)))
        scale = scale.astype(np.float32)
        for at in range(0, len(members), step):
            some = members[at : at + step]
            raw = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le"), dtype="<u4").reshape(len(some), n).astype(np.int32)
            codes = np.empty((len(some), n + 2), dtype=np.int32)
            codes[:, 0], codes[:, -1] = START, END
            body = 37 + raw % 25
            letter, digit = (raw >= 97) & (raw <= 122), (raw >= 48) & (raw <= 57)
            body[letter], body[digit] = raw[letter] - 96, raw[digit] - 21
            codes[:, 1:-1] = body
            key = (codes[:, places[:, 0]] * CODES + codes[:, places[:, 1]]) * CODES + codes[:, places[:, 2]]
            out[some] = weights[key] @ scale + bias
    return out


def _long_decision(word: str, weights: np.ndarray, step: int = 1 << 14) -> float:
    """The same sum for a word of any length, over slices of its starting places: memory stays bounded."""
    codes = word_codes(word)
    total, squares = 0.0, 0.0
    for at in range(0, len(codes), step):
        piece = codes[at : at + step + SPAN - 1]
        first = np.arange(min(step, len(codes) - at))[:, None]
        second, third = first + OFFSETS[:, 0], first + OFFSETS[:, 1]
        inside = third < len(piece)
        value = np.broadcast_to(DECAY ** (OFFSETS[:, 1] + 1.0), third.shape)[inside]
        key = (np.broadcast_to(piece[first], third.shape)[inside] * CODES + piece[second[inside]]) * CODES + piece[third[inside]]
        total += float(weights[key].astype(np.float64) @ value)
        squares += float((value**2).sum())
    return total / max(1e-12, squares**0.5)


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    out, dense = np.empty((len(left), len(right))), np.zeros(CODES**3, dtype=np.float32)
    for j, word in enumerate(right):
        key, value = sparse(word)
        dense[key] = value
        out[:, j] = decisions(left, dense, 0.0)
        dense[key] = 0.0
    return out


def words_of(text: str) -> set[str]:
    """Distinct lower-case words, blank-separated tokens that separators split (whole and without them), and runs of single characters joined."""
    text = text.lower()
    found = set(_SPLIT.findall(text))
    for token in _BROKEN.findall(text):
        found.add(token)
        found.add(_INSIDE.sub("", token))
    for run in _SPELLED.findall(text):
        found.add(re.sub(r"[ .\-_*]", "", run))
    return found


@dataclass(frozen=True)
class Machine:
    """What scoring needs: subsequence weights, bias, and the curve from the three highest decisions to a probability."""

    weights: np.ndarray
    bias: float
    curve: tuple[float, float, float, float] = (0.0, 1.0, 0.0, 0.0)

    def probability(self, top: np.ndarray) -> np.ndarray:
        z = self.curve[0] + top @ np.array(self.curve[1:])
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def train_words(positive: dict[str, float], negative: dict[str, float], near: list[str] = (), landmarks: int = 256) -> Machine:
    """A machine over weighted words; landmarks are the heaviest positives, the clean words ``near`` them and the heaviest clean ones."""
    if not positive or not negative:
        return Machine(np.zeros(CODES**3, dtype=np.float32), -1.0)
    pos = sorted(positive, key=lambda w: (-positive[w], w))
    neg = sorted(negative, key=lambda w: (-negative[w], w))
    marks = list(dict.fromkeys([*pos[: landmarks // 2], *near[: landmarks // 4], *neg[: landmarks // 4]]))
    value, vector = np.linalg.eigh(kernel(marks, marks))
    root = vector * (1.0 / np.sqrt(np.maximum(value, 1e-4))) @ vector.T
    x = kernel([*pos, *neg], marks) @ root
    y = np.array([1.0] * len(pos) + [-1.0] * len(neg))
    c = np.array([positive[w] for w in pos] + [negative[w] for w in neg])
    c[y > 0] *= 0.5 / c[y > 0].sum()
    c[y < 0] *= 0.5 / c[y < 0].sum()
    w, b = _squared_hinge(x, y, c)
    weights = np.zeros(CODES**3)
    for word, a in zip(marks, root @ w, strict=True):
        key, v = sparse(word)
        weights[key] += a * v
    return Machine(weights.astype(np.float32), float(b))


def _squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, float]:
    """Primal Newton steps on c * max(0, 1 - y f)^2 + penalty * |w|^2; the bias is not penalised."""
    z = np.hstack([x, np.ones((len(x), 1))])
    keep = np.diag([*([penalty] * x.shape[1]), 1e-9])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        active = y * (z @ w) < 1
        za, ca = z[active], c[active]
        new = np.linalg.solve((za * ca[:, None]).T @ za + keep, za.T @ (ca * y[active]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = 0.5 * w + 0.5 * new if np.linalg.norm(new) > 1e6 else new
    return w[:-1], w[-1]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 50) -> tuple[float, ...]:
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (y - p) - penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(w)), gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def top_decisions(text: Column, machine: Machine) -> Column:
    """array<double>: the three highest word decisions of a whole text, highest first; null is read as empty."""
    weights, bias = machine.weights, machine.bias

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def top(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            out = []
            for at in range(0, len(texts), 64):
                bags = [words_of(t or "") for t in texts.iloc[at : at + 64]]
                new = list(set().union(*bags).difference(known))
                if len(known) + len(new) > CACHE_ENTRIES:
                    known.clear()
                    new = list(set().union(*bags))
                known.update(zip(new, decisions(new, weights, bias).tolist(), strict=True))
                for bag in bags:
                    best = sorted(map(known.__getitem__, bag), reverse=True)[:3]
                    out.append([*best, *[LOWEST] * (3 - len(best))])
            yield pd.Series(out, dtype=object)

    return top(text)


def _decision(word: Column, machine: Machine) -> Column:
    weights, bias = machine.weights, machine.bias

    @F.pandas_udf(T.DoubleType())
    def decide(values: pd.Series) -> pd.Series:
        return pd.Series(decisions(values.tolist(), weights, bias))

    return decide(word)


def probability(top: Column, machine: Machine) -> Column:
    z = F.lit(machine.curve[0])
    for i, w in enumerate(machine.curve[1:]):
        z = z + F.lit(w) * top[i]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"[.!?\n]+"), lambda s: F.length(F.trim(s)) > 0)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, max_words: int = 40_000, false_words: float = 0.1, landmarks: int = 256, rounds: int = 2) -> Machine:
    """Train from labelled documents: ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), both already limited to the rows
    that may teach.

    At most ``sample_docs`` toxic and ``CLEAN * sample_docs`` clean ids are used, and at most ``max_words`` words of either kind reach the driver. Rows
    without id, text or label teach nothing; an id with several labels counts as toxic if one says so. Without both labels
    the machine scores everything alike, as not toxic.
    """
    one = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    pick = [one.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((0, CLEAN * sample_docs), (1, sample_docs))]
    chosen = pick[0].unionByName(pick[1])  # at most 5 * sample_docs ids and labels: a bounded broadcast
    texts = written(docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxicity_sample")
    of_text = texts.select("toxic", F.explode(sentences(F.lower("text"))).alias("s"))
    once = of_text.groupBy(F.xxhash64("s").alias("h")).agg(F.first("s").alias("s"), F.max("toxic").alias("toxic"), F.min("toxic").alias("least"))
    split = F.array_distinct(F.filter(F.split("s", r"[\s\"(),.;:!?|]+"), lambda w: w != ""))
    # A sentence of both kinds of documents is clean: it doesn't tell them apart.
    counted = once.select(F.col("least").alias("toxic"), F.explode(split).alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine"))
    counted = written(counted, "toxicity_words")
    # One quoted or mislabelled sentence doesn't clear an insult: of words that clean sentences have too, those count whose toxic
    # share is surely high, so the rule gets no harsher with more labels.
    counted = counted.withColumn("insult", ((F.col("fine") == 0) & (F.col("bad") >= _least_sentences(counted, false_words))) | (_surely(F.col("bad"), F.col("fine")) >= PURITY))
    bad = counted.filter("insult").orderBy(F.desc("bad"), "word").limit(max_words // 20).collect()
    clean = counted.filter("fine > 0 AND NOT insult")
    fine = clean.orderBy(F.desc("fine"), F.xxhash64("word")).limit(max_words // 4).collect()
    positive, negative = {r.word: float(r.bad) for r in bad}, {r.word: 1.0 for r in fine}
    machine = train_words(positive, negative, landmarks=landmarks)
    for _ in range(rounds if positive and negative else 0):  # the clean words that look worst, of all there are
        worst = clean.withColumn("d", _decision(F.col("word"), machine)).orderBy(F.desc("d"), "word").limit(max_words // 8).collect()
        negative.update({r.word: 1.0 for r in worst})
        machine = train_words(positive, negative, [r.word for r in worst], landmarks)
    scored = texts.select("toxic", top_decisions(F.col("text"), machine).alias("top")).limit(2 * (1 + CLEAN) * sample_docs).collect()
    if len({r.toxic for r in scored}) < 2:
        return Machine(machine.weights, machine.bias, (-3.0, 0.0, 0.0, 0.0))
    curve = _logistic(np.array([r.top for r in scored]), np.array([r.toxic for r in scored], dtype=float))
    return Machine(machine.weights, machine.bias, curve)


def _surely(bad: Column, fine: Column) -> Column:
    """Lower end of the Wilson interval of bad / (bad + fine)."""
    n, z = bad + fine, SURE
    middle = bad / n + z * z / (2 * n)
    return (middle - z * F.sqrt(bad * fine / (n * n * n) + z * z / (4 * n * n))) / (1 + z * z / n)


def _least_sentences(counted: DataFrame, false_words: float, longest: int = 40) -> int:
    """Fewest toxic sentences at which words seen in toxic sentences only are chance finds at a share of ``false_words`` at most.

    A word of n sentences is in toxic ones only by chance with probability p^n, p being their share of all word sightings.
    """
    n = F.least(F.col("bad") + F.col("fine"), F.lit(longest))
    rows = counted.groupBy(n.alias("n")).agg(F.count("*").alias("words"), F.sum((F.col("fine") == 0).cast("int")).alias("only"),
                                             F.sum("bad").alias("bad"), F.sum("fine").alias("fine")).collect()
    seen = sum(r.bad + r.fine for r in rows)
    p = sum(r.bad for r in rows) / max(1, seen)
    for least in range(2, longest):
        chance = sum(r.words * p**r.n for r in rows if r.n >= least)
        if chance <= false_words * sum(r.only for r in rows if r.n >= least):
            return least
    return 2


def score(docs: DataFrame, machine: Machine, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a toxicity score in [0, 1]; null and empty texts get the score of a text without words."""
    return docs.withColumn(into, probability(top_decisions(F.col(text), machine), machine))
