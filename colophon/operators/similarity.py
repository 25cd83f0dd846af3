"""Exact top-k search, catalogue baselines, near-equal signatures and ranking quality.

Exact search has to look at every (query, vector) combination. It is laid out as a grid of blocks of
bounded size: every task multiplies one query block with one vector block and hands on only k rows per
query, so neither all pairs nor a whole side ever sits in one place.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colophon.functions.vectors import (
    BASELINE_CAP, DEFAULT_BASELINE, HIGH_PERCENT, MID_PERCENT, SAME_COVER_DISTANCE, SIGNATURE_BITS,
    dot, hamming, l2_normalize, match_level, score_percent,
)
from colophon.operators.numbering import written
from colophon.session import checkpoint_dir

BLOCK_ROWS = 4096
DRAWS = 50_000  # fixed value: pairs that a sampled baseline draws
BUCKETS = 4096
TIE = 1e-12  # scores this close are equal
HOT_ROWS = 1 << 15  # signatures under one value of a band that a task compares
DEALT_BITS, FEW_PAIRS = 7, 1 << 22  # bits of a band that signatures are dealt by, pairs that are compared outright
BINS, FEW, REFINED = 4096, 1 << 16, 4  # histogram of an exact baseline: bins, pairs that need no finer bins, passes at most


def _packed(df: DataFrame, key: str, block_rows: int, side: str) -> DataFrame:
    """One row per block: an array of each column, vectors end to end; written, a file per block.

    A block is a hash slice of the key, so its size is about block_rows whatever the keys look like.
    """
    blocks = max(1, math.ceil(df.count() / block_rows))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks))).repartition(blocks, "_b")
    whole = dealt.groupBy("_b").agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
    column = lambda c: F.flatten(F.col(f"rows.{c}")) if c == "embedding" else F.col(f"rows.{c}")
    return written(whole.select(*[column(c).alias(f"{side}_{c}") for c in df.columns]), f"{side}_blocks")


def _over_blocks(
    queries: DataFrame, vectors: DataFrame, cell: Callable[[dict, dict], pd.DataFrame], schema: str, block_rows: int
) -> DataFrame:
    """``cell`` of every query block with every vector block, each as a dict of arrays (embedding: one row per vector).

    Each side moves once, to be packed; a task then reads the packed blocks that it multiplies, so what is shuffled
    and written does not grow with the number of pairs of blocks.
    """
    left, right = _packed(queries, "query", block_rows, "q"), _packed(vectors, "id", block_rows, "v")

    def block(row: dict, side: str) -> dict:
        found = {c[2:]: v for c, v in row.items() if c.startswith(side)}
        if "embedding" in found:
            found["embedding"] = found["embedding"].astype(np.float64).reshape(len(next(iter(found.values()))), -1)
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.iloc[at].to_dict()
                yield cell(block(row, "q_"), block(row, "v_"))

    return left.crossJoin(right.hint("shuffle_replicate_nl")).mapInPandas(run, schema)


def _best(score: np.ndarray, ids: np.ndarray, ties: np.ndarray, queries, k: int) -> pd.DataFrame:
    """k best per row of a score block; equal scores by the tie key. One sort of what reaches the k-th score of its row."""
    n = score.shape[1]
    floor = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(score), -np.inf)
    row, at = np.nonzero(score >= floor[:, None])  # every tie of the k-th stays in until the order is known
    tie_rank = np.argsort(np.argsort(ties, kind="stable"), kind="stable")
    order = np.lexsort((tie_rank[at], -score[row, at], row))
    row, at = row[order], at[order]
    first = np.searchsorted(row, np.arange(len(score)))
    keep = np.arange(len(row)) - first[row] < k
    row, at = row[keep], at[keep]
    return pd.DataFrame({"query": np.asarray(queries)[row], "id": ids[at], "tie": ties[at], "score": score[row, at]})


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query").orderBy(F.desc("score"), F.asc("tie"))
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("tie")


def topk_inner_product(
    queries: DataFrame, vectors: DataFrame, k: int, *, tie: str = "id", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query, embedding) x (id, embedding) -> query, id, score, rank; exact, ties by ``tie`` ascending."""
    if k <= 0:
        return _ranked(queries.limit(0).select("query").join(vectors.limit(0).select("id")).selectExpr(
            "query", "id", "id AS tie", "0D AS score"), 1)
    v = vectors.select("id", F.col(tie).alias("tie"), "embedding")
    q = queries.select("query", F.col("embedding"))

    def cell(left: dict, right: dict) -> pd.DataFrame:
        return _best(left["embedding"] @ right["embedding"].T, right["id"], right["tie"], left["query"], k)

    schema = "query {}, id {}, tie {}, score double".format(
        q.schema["query"].dataType.simpleString(), v.schema["id"].dataType.simpleString(),
        v.schema["tie"].dataType.simpleString(),
    )
    return _ranked(_over_blocks(q, v, cell, schema, block_rows), k)


def dense_index(df: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """Number the rows of each group 0..n-1 without sorting a group in one task.

    Rows are numbered inside hash buckets; the bucket offsets are a running sum over at most BUCKETS rows.
    """
    bucketed = df.withColumn("bucket", F.substring(F.md5(F.col(key).cast("string")), 1, 3))
    sizes = bucketed.groupBy(*groups, "bucket").agg(F.count("*").alias("in_bucket"))
    before = W.partitionBy(*groups).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy(*groups, "bucket").orderBy(key)
    return (
        bucketed.withColumn("n", F.row_number().over(inside))
        .join(offsets, [*groups, "bucket"])
        .withColumn("idx", F.col("offset") + F.col("n") - 1)
        .drop("bucket", "offset", "n")
    )


def _hash_number(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")


def _pair_cells(vectors: DataFrame, group: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the grid cells (_g, _b, _c), b <= c, of each group; _g is the group as JSON, so null is a group too."""
    keyed = vectors.select(F.to_json(F.struct(group)).alias("_g"), F.xxhash64("id").alias("_h"), "embedding")
    blocks = keyed.groupBy("_g").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"))
    dealt = keyed.join(blocks, "_g").withColumn("_own", F.pmod("_h", F.col("_blocks")).cast("int"))
    left = dealt.withColumn("_c", F.explode(F.sequence("_own", F.col("_blocks") - 1))).withColumnRenamed("_own", "_b")
    right = dealt.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_own")))).withColumnRenamed("_own", "_c")
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in ("_g", "_b", "_c", "_h", "embedding")])
    return fresh(left), fresh(right)


def _cosines(left: pd.DataFrame, right: pd.DataFrame, rows: int = 256) -> Iterator[np.ndarray]:
    """The cosines of a cell in slices, each pair once and every pass alike: rows are in the order of their key."""
    left, right = left.sort_values("_h"), right.sort_values("_h")
    a, b = (np.stack(x["embedding"].to_numpy()).astype(np.float64) for x in (left, right))
    same = left["_b"].iloc[0] == left["_c"].iloc[0]
    for at in range(0, len(a), rows):
        product = a[at : at + rows] @ b.T
        yield product[np.arange(len(b)) > np.arange(at, at + len(product))[:, None]] if same else product.ravel()


def _tally(left: DataFrame, right: DataFrame, bounds: DataFrame, values: bool) -> DataFrame:
    """Pairs per group, middle rank _r and place: a bin of [lo, hi] (-1 below, BINS above) or the cosine itself (-infinity below)."""

    def cell(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"_g": [], "_r": [], "place": [], "n": []})]
        edges = [(l[f"lo{k}"].iloc[0], l[f"hi{k}"].iloc[0]) for k in (0, 1)] if len(l) and len(r) else []
        bins, inside, below = np.zeros((2, BINS + 2), dtype=np.int64), ([], []), [0, 0]
        for x in _cosines(l, r) if edges else ():
            for k, (lo, hi) in enumerate(edges):
                if values:
                    inside[k].append(x[(x >= lo) & (x <= hi)])
                    below[k] += int((x < lo).sum())
                else:
                    at = np.clip(np.floor((x - lo) * (BINS / (hi - lo))), -1, BINS).astype(np.int64)
                    bins[k] += np.bincount(at + 1, minlength=BINS + 2)
        for k in range(len(edges)):
            if values:
                place, n = np.unique(np.concatenate(inside[k]), return_counts=True)
                place, n = np.append(place, -np.inf), np.append(n, below[k])
            else:
                place, n = np.arange(-1.0, BINS + 1), bins[k]
            parts.append(pd.DataFrame({"_g": l["_g"].iloc[0], "_r": k, "place": place, "n": n})[n > 0])
        return pd.concat(parts)

    bounded = left.join(bounds.select("_g", "lo0", "hi0", "lo1", "hi1"), "_g").groupBy("_g", "_b", "_c")
    cells = bounded.cogroup(right.join(bounds.select("_g"), "_g").groupBy("_g", "_b", "_c"))
    return cells.applyInPandas(cell, "_g string, _r int, place double, n long").groupBy("_g", "_r", "place").agg(F.sum("n").alias("n"))


def _at_ranks(tally: DataFrame, bounds: DataFrame) -> DataFrame:
    """``bounds`` with the places of the two middle ranks, p0 and p1, and the pairs there; the places of a group are few."""
    for r in (0, 1):
        upto = F.sum("n").over(W.partitionBy("_g").orderBy("place"))
        one = tally.filter(F.col("_r") == r).withColumn("upto", upto).join(bounds.select("_g", f"rank{r}"), "_g")
        found = one.filter(F.col("upto") > F.col(f"rank{r}")).groupBy("_g").agg(F.min_by(F.struct("place", "n"), "place").alias("x"))
        bounds = bounds.join(found.select("_g", F.col("x.place").alias(f"p{r}"), F.col("x.n").alias(f"n{r}")), "_g")
    return bounds


def baseline_exact(vectors: DataFrame, group: str, block_rows: int = BLOCK_ROWS, few: int = FEW) -> DataFrame:
    """Median of all pair cosines per group of (group, id, embedding); fewer than three vectors give the default.

    A grid of blocks: a task multiplies two blocks of a group and returns a histogram. The bins of the two middle ranks are
    refined, one pass over the grid each, until they hold ``few`` pairs or are about as narrow as a double; the last pass
    returns the different values there. Groups of ``few`` pairs need the last pass only.
    """
    spark = vectors.sparkSession
    sizes = vectors.groupBy(group).agg(F.count("*").alias("vectors"), F.max(dot(F.col("embedding"), F.col("embedding"))).alias("_m"))
    sizes = sizes.withColumn("_g", F.to_json(F.struct(group)))
    bounds = sizes.filter("vectors >= 3").select(
        "_g", F.expr("(vectors * (vectors - 1) div 2 - 1) div 2").alias("rank0"), F.expr("vectors * (vectors - 1) div 2 div 2").alias("rank1"),
        *[(F.lit(sign) * (F.col("_m") + 1e-6)).alias(f"{side}{r}") for r in (0, 1) for side, sign in (("lo", -1.0), ("hi", 1.0))],
        F.expr("vectors * (vectors - 1) div 2").alias("most"),
    )
    left, right = _pair_cells(vectors, group, block_rows)
    folder = f"{checkpoint_dir(spark)}/baseline/{uuid.uuid4().hex}"
    for turn in range(REFINED + 1):  # one row per group, written so that no pass is made twice
        bounds.write.parquet(f"{folder}/{turn}")
        bounds = spark.read.schema(bounds.schema).parquet(f"{folder}/{turn}")
        wide = bounds.filter(F.col("most") > few)
        if turn == REFINED or wide.isEmpty():
            break
        at = _at_ranks(_tally(left, right, wide, False), wide)
        width = lambda r: (F.col(f"hi{r}") - F.col(f"lo{r}")) / BINS
        edge = lambda r, k: (F.col(f"lo{r}") + (F.col(f"p{r}") + k) * width(r)).alias(f"{'hi' if k else 'lo'}{r}")
        finer = at.select("_g", "rank0", "rank1", edge(0, 0), edge(0, 1), edge(1, 0), edge(1, 1), F.greatest("n0", "n1").alias("most"))
        bounds = bounds.filter(F.col("most") <= few).unionByName(finer)
    # Rounding may put a pair on the other side of an edge than the pass before did.
    padded = bounds.withColumns({f"{side}{r}": F.col(f"{side}{r}") + by for r in (0, 1) for side, by in (("lo", -1e-12), ("hi", 1e-12))})
    middle = _at_ranks(_tally(left, right, padded, True), padded).select("_g", ((F.col("p0") + F.col("p1")) / 2).alias("_v"))
    value = F.when(F.col("vectors") < 3, DEFAULT_BASELINE).otherwise(F.least(F.greatest("_v", F.lit(0.0)), F.lit(BASELINE_CAP)))
    return sizes.join(middle, "_g", "left").select(group, "vectors", value.alias("baseline"))


def baseline_sampled(vectors: DataFrame, group: str, draws: int = DRAWS, seed: int = 7) -> DataFrame:
    """Median cosine of ``draws`` seeded ordered pairs i != j per group of (group, id, embedding).

    At most about 2 x ``draws`` rows of a group can be drawn, so only rows whose hash lies below that share of their group are
    numbered, and only drawn rows move their vectors: past the scan the work does not grow with the catalogue. A group of up
    to 2 x ``draws`` rows is numbered whole.
    """
    sizes = vectors.groupBy(group).agg(F.count("*").alias("vectors")).filter("vectors >= 3")
    sizes = written(sizes, "sizes")  # one row per group, of known size when it is joined
    most = 2 * draws
    share = F.lit(float(most + 8 * math.isqrt(most))) / F.col("vectors")
    spot = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), F.col("id")), F.lit(11)).cast("double") / 2.0**53
    picked = vectors.select(group, "id", "embedding").join(sizes, group).filter((F.col("vectors") <= most) | (spot < share))
    indexed = written(dense_index(picked.select(group, "id", "vectors"), "id", [group]).select(group, "id", "idx"), "numbers")
    among = indexed.groupBy(group).agg(F.count("*").alias("n"))
    drawn = among.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select(
        group, "n", "draw",
        F.pmod(_hash_number(F.lit(seed), F.col("draw"), F.lit("i")), F.col("n")).alias("i"),
        F.pmod(_hash_number(F.lit(seed), F.col("draw"), F.lit("j")), F.col("n") - 1).alias("step"),
    ).withColumn("j", F.pmod(F.col("i") + 1 + F.col("step"), F.col("n"))).select(group, "draw", "i", "j")
    drawn = written(drawn, "draws")
    wanted = drawn.select(group, F.col("i").alias("idx")).unionByName(drawn.select(group, F.col("j").alias("idx"))).distinct()
    rows = picked.select(group, "id", "embedding").join(indexed.join(wanted, [group, "idx"], "left_semi"), [group, "id"])
    side = lambda name, vec: rows.select(group, F.col("idx").alias(name), F.col("embedding").alias(vec))
    cosines = drawn.join(side("i", "a"), [group, "i"]).join(side("j", "b"), [group, "j"])
    clamp = F.least(F.greatest(F.percentile("cosine", F.lit(0.5)), F.lit(0.0)), F.lit(BASELINE_CAP))
    found = cosines.select(group, dot(F.col("a"), F.col("b")).alias("cosine")).groupBy(group).agg(clamp.alias("baseline"))
    return sizes.join(found, group).select(group, "vectors", "baseline")


def baselines(vectors: DataFrame, group: str, method: str = "sampled", draws: int = DRAWS) -> DataFrame:
    """Baseline per group by the named method, whatever the size of the group; under three vectors it is the default."""
    if method == "exact":
        return baseline_exact(vectors, group)
    if method != "sampled":
        raise ValueError(f"unknown method {method}")
    few = vectors.groupBy(group).agg(F.count("*").alias("vectors")).filter("vectors < 3")
    return baseline_sampled(vectors, group, draws).unionByName(few.withColumn("baseline", F.lit(DEFAULT_BASELINE)))


def rank_catalogue(queries: DataFrame, vectors: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top-k records per query with the catalogue-relative percent and level; ties by cell text.

    vectors: id, cell, embedding. The baseline is one row, joined after the top-k has shrunk the data.
    """
    unit = vectors.withColumn("embedding", l2_normalize(F.col("embedding")))
    base = baselines(unit.withColumn("catalogue", F.lit(1)), "catalogue").select("catalogue", "baseline")
    asked = queries.withColumn("embedding", l2_normalize(F.col("embedding")))
    top = topk_inner_product(asked, unit, k, tie="cell", block_rows=block_rows)
    percent = score_percent(F.col("score"), F.col("baseline"))
    return (
        top.withColumn("catalogue", F.lit(1)).join(F.broadcast(base), "catalogue").drop("catalogue")
        .withColumn("percent", percent).withColumn("level", match_level(percent))
    )


def signature_groups(signatures: DataFrame) -> DataFrame:
    """Equal signatures as one row: signature, copies, first_id."""
    return signatures.groupBy("signature").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))


def _bands(count: int) -> list[tuple[int, int]]:
    edges = [round(i * SIGNATURE_BITS / count) for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _close(a: np.ndarray, b: np.ndarray, same: bool, max_distance: int, cells: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of two sets within ``max_distance`` bits, a slice at a time; of one set with itself each pair once."""
    rows = max(1, cells // max(len(b), 1))
    for at in range(0, len(a), rows):
        first = at if same else 0
        near = np.bitwise_count(a[at : at + rows, None] ^ b[None, first:]) <= max_distance
        x, y = np.nonzero(near)
        x, y = x + at, y + first
        yield (x[x < y], y[x < y]) if same else (x, y)


def _near_pairs(a: np.ndarray, b: np.ndarray, same: bool, cuts: list[tuple[int, int]], i: int, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs within ``max_distance`` bits whose first equal band is ``i``.

    Few signatures are compared outright. Of many only those that share band i and a later band j meet: both sides are sorted
    by these bands, and a pair counts where j is the first equal band after i.
    """
    part = lambda v, cut: (v >> np.uint64(cut[0])) & np.uint64((1 << cut[1]) - 1)
    equal = lambda v, k: part(v, cuts[k]) == 0
    found = [(np.zeros(0, dtype=np.int64),) * 2]

    def keep(x: np.ndarray, y: np.ndarray, unequal: list[int]) -> None:
        differ = a[x] ^ b[y]
        once = equal(differ, i)
        for k in unequal:
            once &= ~equal(differ, k)
        found.append((x[once], y[once]))

    if len(a) * len(b) <= FEW_PAIRS:
        for x, y in _close(a, b, same, max_distance):
            keep(x, y, list(range(i)))
    else:
        for j in range(i + 1, len(cuts)):
            unequal = [k for k in range(j) if k != i]
            shared = lambda v, j=j: part(v, cuts[i]) << np.uint64(cuts[j][1]) | part(v, cuts[j])
            key_a, key_b = shared(a), shared(b)
            order_a, order_b = np.argsort(key_a, kind="stable"), np.argsort(key_b, kind="stable")
            key_b = key_b[order_b]
            values, starts, sizes = np.unique(key_a[order_a], return_index=True, return_counts=True)
            low, high = np.searchsorted(key_b, values, "left"), np.searchsorted(key_b, values, "right")
            for s, n, lo, hi in zip(starts, sizes, low, high):
                left, right = order_a[s : s + n], order_b[lo:hi]
                if len(right) > same:
                    for x, y in _close(a[left], b[right], same, max_distance):
                        if len(x):
                            keep(left[x], right[y], unequal)
    return tuple(np.concatenate(side) for side in zip(*found))


def hamming_pairs(signatures: DataFrame, max_distance: int = SAME_COVER_DISTANCE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of distinct signatures within ``max_distance`` bits, each with its number of copies.

    With max_distance + 2 bands at least two bands of a qualifying pair are equal. Signatures are dealt by one band, once for
    each band but the last, and a task looks for a second equal band among those that share the first: nothing is lost, and
    pairs of signatures never become rows before they are known to be near. A pair counts only under its first equal bands,
    so nothing is de-duplicated. Copies are folded before; a band value of more than ``hot_rows`` signatures is a
    grid of parts of that size, each cell a task of its own.
    """
    groups = written(signature_groups(signatures).filter(F.col("signature").isNotNull()), "signatures")  # read twice
    cuts = _bands(max_distance + 2)
    high = lambda lo, width: F.call_function("shiftrightunsigned", F.col("signature"), F.lit(lo + max(width - DEALT_BITS, 0)))
    dealt_by = F.array(*[
        F.struct(F.lit(i).alias("i"), high(lo, width).bitwiseAND(F.lit((1 << min(width, DEALT_BITS)) - 1)).alias("x"))
        for i, (lo, width) in enumerate(cuts[:-1])
    ])
    key = ["i", "x"]
    keyed = groups.withColumn("key", F.explode(dealt_by)).select("key.*", "signature", "copies", "first_id")
    hot = keyed.groupBy(*key).agg(F.ceil(F.count("*") / hot_rows).cast("int").alias("parts")).filter("parts > 1")
    dealt = keyed.join(written(hot, "hot"), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("signature"), F.col("parts")).cast("int"))
    # a cell (u, v), u <= v, holds parts u and v
    placed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *key, F.least("part", "other").alias("u"), F.greatest("part", "other").alias("v"), "part", "signature", "copies", "first_id"
    )
    columns = ["signature", "copies", "first_id"]

    def cell(df: pd.DataFrame) -> pd.DataFrame:
        same = df["u"].iloc[0] == df["v"].iloc[0]
        p = df[df["part"] == df["u"].iloc[0]]
        q = p if same else df[df["part"] == df["v"].iloc[0]]
        a, b = (x["signature"].to_numpy().astype(np.int64) for x in (p, q))
        x, y = _near_pairs(a.view(np.uint64), b.view(np.uint64), bool(same), cuts, int(df["i"].iloc[0]), max_distance)
        first = a[x] < b[y]
        of = lambda c, low: np.where(first == low, p[c].to_numpy()[x], q[c].to_numpy()[y])
        out = {f"{c}_{name}": of(c, low) for name, low in (("a", True), ("b", False)) for c in columns}
        return pd.DataFrame(out | {"distance": np.bitwise_count(a[x].view(np.uint64) ^ b[y].view(np.uint64)).astype(np.int32)})

    kinds = {c: groups.schema[c].dataType.simpleString() for c in columns}
    schema = ", ".join([*[f"{c}_{name} {kinds[c]}" for name in "ab" for c in columns], "distance int"])
    return placed.groupBy(*key, "u", "v").applyInPandas(cell, schema)


def _nearest(left: dict, right: dict, k: int, rows: int = 128) -> pd.DataFrame:
    """k nearest signatures of a block per query, a slice of queries at a time: few distances are told apart, so most of a
    block may tie with the k-th, and every tie is held until the order is known."""
    a, b = (np.asarray(x["signature"]).astype(np.int64).view(np.uint64) for x in (left, right))
    ids, ties, queries = (np.asarray(x) for x in (right["id"], right["tie"], left["query"]))
    score = lambda at: 1 - np.bitwise_count(a[at : at + rows, None] ^ b[None, :]).astype(np.float64) / 32.0
    return pd.concat([_best(score(at), ids, ties, queries[at : at + rows], k) for at in range(0, len(a), rows)])


def rank_by_hamming(queries: DataFrame, signatures: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """k nearest signatures per query: distance, then cell; score = 1 - distance / 32."""
    v = signatures.select("id", F.col("cell").alias("tie"), "signature")
    q = queries.select("query", "signature")

    def cell(left: dict, right: dict) -> pd.DataFrame:
        return _nearest(left, right, k)

    schema = "query {}, id {}, tie string, score double".format(
        q.schema["query"].dataType.simpleString(), v.schema["id"].dataType.simpleString()
    )
    ranked = _ranked(_over_blocks(q, v, cell, schema, block_rows), k)
    return ranked.withColumn("distance", F.round((1 - F.col("score")) * 32).cast("int"))


def _may_reach(a: np.ndarray, b: np.ndarray, least: np.ndarray, rows: int = 256) -> np.ndarray:
    """Which rows of ``a`` may have a product of at least ``least`` with a row of ``b``; none that has is left out.

    Products are made in single precision of vectors scaled to length 1 at most, so their rounding is below ``slack``. Whatever
    is not finite, or has no length, may.
    """
    slack = (a.shape[1] + 8) * 2.0**-23  # twice what conversion and summing of so many terms can lose
    with np.errstate(all="ignore"):
        of_a, of_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1).max()
        x, y = (a / of_a[:, None]).astype(np.float32), (b / of_b).astype(np.float32)
        top = np.concatenate([(x[at : at + rows] @ y.T).max(axis=1) for at in range(0, len(x), rows)]).astype(np.float64)
        return ~((top + slack) * of_a * of_b < least)


def true_ranks(queries: DataFrame, vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Where the right record landed: query, rank, true_score, top_score.

    queries: query, true_id, embedding; vectors: id, cell, embedding. Each grid cell only counts how many of its
    vectors beat the true one. A query is handed on by the cell of its true vector and by those where some vector may reach
    the true score: elsewhere nothing is ahead and the top is lower, so the sum does not need one row per query and block.
    """
    v = vectors.select("id", "cell", "embedding")
    truth = v.select(F.col("id").alias("true_id"), F.col("cell").alias("true_cell"), F.col("embedding").alias("truth"))
    true_score = dot(F.col("embedding"), F.col("truth")).alias("true_score")
    q = queries.select("query", "true_id", "embedding").join(truth, "true_id").select("query", "true_id", "true_cell", true_score, "embedding")

    def cell(left: dict, right: dict, rows: int = 128) -> pd.DataFrame:
        place = lambda ids, name: pd.DataFrame({"id": ids, name: np.arange(len(ids))})
        own = place(left["true_id"], "i").merge(place(right["id"], "j"), on="id")  # the true vectors among these
        may = _may_reach(left["embedding"], right["embedding"], left["true_score"] - TIE)
        may[own["i"].to_numpy()] = True
        asked = np.nonzero(may)[0]
        true_score, true_cell = left["true_score"][asked], left["true_cell"][asked]
        own_i, own_j = np.searchsorted(asked, own["i"].to_numpy()), own["j"].to_numpy()
        ahead, top = np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked))
        for at in range(0, len(asked), rows):
            scores = left["embedding"][asked[at : at + rows]] @ right["embedding"].T
            top[at : at + rows] = scores.max(axis=1)
            scores -= true_score[at : at + rows, None]
            here = (own_i >= at) & (own_i < at + rows)
            scores[own_i[here] - at, own_j[here]] = -np.inf
            ahead[at : at + rows] = (scores > TIE).sum(axis=1)
            i, j = np.nonzero(np.abs(scores) <= TIE)  # ties are few: by cell
            np.add.at(ahead, i[right["cell"][j] < true_cell[at + i]] + at, 1)
        return pd.DataFrame({"query": left["query"][asked], "ahead": ahead, "true_score": true_score, "top_score": top})

    kind = q.schema["query"].dataType.simpleString()
    counted = _over_blocks(q, v, cell, f"query {kind}, ahead long, true_score double, top_score double", block_rows)
    return counted.groupBy("query").agg(
        (F.sum("ahead") + 1).alias("rank"), F.max("true_score").alias("true_score"), F.max("top_score").alias("top_score")
    )


def evaluate_ranking(ranks: DataFrame, baseline: float | Column = DEFAULT_BASELINE, k: int = 5) -> DataFrame:
    """One row per ranker of (ranker, rank, true_score, top_score): top-1, top-k, MRR and level shares."""
    base = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
    percent = score_percent(F.col("top_score"), base)
    right = F.col("rank") == 1
    share = lambda level, of: F.coalesce(F.avg(F.when(of, F.when(percent >= level, 1.0).otherwise(0.0))), F.lit(0.0))
    return ranks.groupBy("ranker").agg(
        F.count("*").alias("queries"),
        F.avg(F.when(right, 1.0).otherwise(0.0)).alias("top1"),
        F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias("topk"),
        F.avg(1.0 / F.col("rank")).alias("mrr"),
        F.percentile("true_score", F.lit(0.05)).alias("true_p5"),
        F.percentile("true_score", F.lit(0.5)).alias("true_p50"),
        share(HIGH_PERCENT, right).alias("high_correct"), share(HIGH_PERCENT, ~right).alias("high_wrong"),
        share(MID_PERCENT, right).alias("mid_correct"), share(MID_PERCENT, ~right).alias("mid_wrong"),
    )
