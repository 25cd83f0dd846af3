"""SimHash near-dedup by the general pigeonhole principle.

**Fingerprints.** 64 bits per text from the XXH64 values of its shingles: a bit is set if more than half of them set it.
Equal fingerprints are one class; everything below runs over classes.

**Parts.** The bits are grouped into ``parts`` by their correlation over all fingerprints (correlated bits go together, so the
other parts stay selective). By the general pigeonhole principle, two fingerprints within ``distance`` differ in some part i by
at most t_i, for any thresholds t_i >= -1 with sum(t_i) = distance - parts + 1. The thresholds are unequal: dynamic programming
picks those with the fewest estimated candidates plus probes. The estimate takes the chance that two fingerprints agree in a
bit from the bit counts over all fingerprints.

**Probes.** Two values of a part differ in at most t bits if they agree after removing some t bits, so each fingerprint is
filed under its part with every choice of t bits masked. Rows in one file are compared exactly; links leave as a spanning forest
(:mod:`colophon.llm.blocks`), so thousands of near copies never become all pairs; hot files are split into pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from colophon.llm import blocks
from colophon.llm.components import components
from colophon.llm.shared import written

BITS, SHINGLE, SEED = 64, 4, 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text; one without words has 0. Splitting bytes splits at the six ASCII blanks only."""
    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return 0
    joined = b" ".join(w)
    n = max(1, len(w) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n]
    stops = ends[min(shingle, len(w)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    step = 1 << 15
    for at in range(0, n, step):  # bounded memory for very long texts
        spans = zip(starts[at : at + step].tolist(), stops[at : at + step].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf(T.LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([text_fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def bit_counts(fingerprints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for all pairs of bits how many have both set: 64 x 64 sums, whatever the rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(h)
        cell = np.arange(BITS * BITS + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.r_[total.ravel(), n])], names=["cell", "n"])

    rows = fingerprints.select("fp").mapInArrow(partial, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for r in rows:
        flat[r.cell] = r.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, each grown from its start by the most correlated bit left."""
    p = np.diag(both) / max(1, n)
    covariance = both / max(1, n) - np.outer(p, p)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs(covariance / np.outer(spread, spread))
    left, groups = set(range(BITS)), []
    for size in (len(x) for x in np.array_split(np.arange(BITS), parts)):
        rest = sorted(left)
        start = max(rest, key=lambda b: (correlation[b, rest].sum(), -b))
        group = [start]
        left.remove(start)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (correlation[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(n: int, p: np.ndarray, groups: list[list[int]], distance: int, probe_cost: float = 4.0) -> list[int]:
    """Thresholds per part with sum distance - parts + 1 and the least estimated cost, by dynamic programming.

    Candidates of a part at threshold t: pairs of fingerprints times the chance that they differ in at most t of its bits.
    """
    goal = distance - len(groups) + 1
    cost = []
    for group in groups:
        differ = np.zeros(len(group) + 1)
        differ[0] = 1.0
        for b in group:
            d = 2 * p[b] * (1 - p[b])
            differ[1:] = differ[1:] * (1 - d) + differ[:-1] * d
            differ[0] *= 1 - d
        row, masks = [0.0], 1.0
        for t in range(distance + 1):
            masks = masks * (len(group) - t + 1) / t if t else 1.0
            row.append(n * n / 2 * float(differ[: t + 1].sum()) + probe_cost * n * masks)
        cost.append(row)  # thresholds -1, 0, 1, ...
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (value, chosen) in best.items():
            for t, c in enumerate(row, start=-1):
                if total + t not in new or value + c < new[total + t][0]:
                    new[total + t] = (value + c, [*chosen, t])
        best = new
    return best[goal][1]


def files(fingerprints: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(key, fp): every fingerprint under each masked value of each part."""
    masks = []
    for i, (group, t) in enumerate(zip(groups, thresholds, strict=True)):
        for removed in combinations(group, t) if t >= 0 else ():
            kept = sum(1 << b for b in group if b not in removed)
            masks.append((i * 1_000_000 + len(masks), kept - (1 << 64) if kept >= 1 << 63 else kept))
    listed = F.array(*[F.struct(F.lit(m).alias("i"), F.lit(v).cast("long").alias("mask")) for m, v in masks])
    return fingerprints.select("fp", F.explode(listed).alias("m")).select("fp", F.xxhash64("m.i", F.col("fp").bitwiseAND(F.col("m.mask"))).alias("key"))


def links(fingerprints: DataFrame, distance: int, parts: int, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """(a, b): links that connect just what all pairs within ``distance`` connect; ``fingerprints`` has distinct ``fp``."""
    n, both = bit_counts(fingerprints)
    groups = group_bits(n, both, parts)
    thresholds = allocate(n, np.diag(both) / max(1, n), groups, distance)
    filed = blocks.dealt(files(fingerprints, groups, thresholds), "key", "fp", block_rows)

    def work(table: pa.Table) -> pa.Table:
        key, fp, side = (table.column(c).to_numpy() for c in ("key", "fp", "_side"))
        fp = fp.astype(np.int64)
        close = ((i[ok], j[ok]) for i, j in blocks.same_key_pairs(key, side) if len(ok := np.flatnonzero(np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= distance)))
        root = blocks.forest(close, len(fp))
        at = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": fp[at], "b": fp[root[at]]})

    partitions = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.linked(filed.select("key", "fp", "_side"), "key", partitions, work, "a long, b long")


def _classed(own: DataFrame, distance: int, parts: int) -> DataFrame:
    """(fp, root, component_id, class_rows) per fingerprint; ``root`` is the smallest fingerprint of the component."""
    classes = written(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_rows")), "classes")
    roots = components(links(classes.select("fp"), distance, parts)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id", "class_rows")


def near_duplicates(docs: DataFrame, text: str = "text", distance: int = 4, parts: int = 3, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id, class_rows) for every row of ``docs``.

    A component is all texts reachable by links of at most ``distance`` bits; its id is its smallest doc_id (null if it has
    none). Null and blank texts have fingerprint zero and are linked like any other. Repeated rows stay.
    """
    own = written(docs.select("doc_id", fingerprint(F.col(text), shingle).alias("fp")), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(_classed(own, distance, parts), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id", "class_rows")


def representatives(docs: DataFrame, text: str = "text", distance: int = 4, parts: int = 3, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` per component: that of the smallest doc_id (null last), of the smallest text hash where ids repeat."""
    key = {"_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_th": F.coalesce(F.xxhash64(text), F.lit(0))}
    own = written(docs.select("doc_id", *[c.alias(k) for k, c in key.items()], fingerprint(F.col(text), shingle).alias("fp")), "fingerprints")
    least = own.groupBy("fp").agg(F.min(F.struct(*key)).alias("k"))
    chosen = least.join(_classed(own, distance, parts).select("fp", "root"), "fp").groupBy("root").agg(F.min("k").alias("k")).select("k.*")
    return docs.withColumns(key).join(chosen, list(key), "left_semi").dropDuplicates(list(key)).drop(*key)
