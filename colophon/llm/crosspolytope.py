"""Embedding near-dedup by cross-polytope hashing.

A vector is turned by three rounds of random signs and the fast Hadamard transform, which costs n log n and behaves like a
random rotation; its hash is the nearest of the 2n signed axes. Two such hashes make a bucket of a table. Besides its own
bucket, a vector is filed under the ``probes`` - 1 buckets that are next best: those that lose least by taking the second or
third axis of one of the hashes.

Equal vectors are one class first. Classes that meet in a bucket are compared by cosine in double precision. A pair may meet
often but counts once, in the smallest bucket that both are filed under; every bucket adds up links per class on the spot and
hands on a spanning forest, so a cluster of thousands of near vectors never becomes a table of all its pairs. Buckets over
``block_rows`` classes are split into pairs of blocks (:mod:`colophon.llm.blocks`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from colophon.llm import blocks
from colophon.llm.components import components
from colophon.llm.shared import written

TABLES, PROBES, SEED = 8, 3, 20
BLOCK_ROWS = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix, by halves; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        pairs = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def buckets(vectors: np.ndarray, tables: int, probes: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables * probes) bucket numbers; unit vectors of any width are padded to a power of two."""
    n, width = vectors.shape
    full = 1 << max(1, (width - 1).bit_length())
    padded = np.zeros((n, full))
    padded[:, :width] = vectors
    rng = np.random.default_rng(seed)
    out = np.empty((n, tables, probes), dtype=np.int64)
    rows = np.arange(n)
    for t in range(tables):
        axis, loss = [], []
        for _ in range(2):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), size=full))
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, : max(3, probes)]
            best = np.take_along_axis(size, top, axis=1)
            axis.append(2 * top + (np.take_along_axis(y, top, axis=1) < 0))
            loss.append((best[:, :1] - best) ** 2)
        # Own bucket, then those in which one of the two axes is the next best.
        choice = [(0, 0), *((k, 0) for k in range(1, axis[0].shape[1])), *((0, k) for k in range(1, axis[1].shape[1]))]
        total = np.stack([loss[0][:, a] + loss[1][:, b] for a, b in choice], axis=1)
        order = np.argsort(total, axis=1, kind="stable")[:, :probes]
        first, second = np.array([c[0] for c in choice]), np.array([c[1] for c in choice])
        for p in range(probes):
            a, b = first[order[:, p]], second[order[:, p]]
            out[:, t, p] = (t * 2 * full + axis[0][rows, a]) * 2 * full + axis[1][rows, b]
    return out.reshape(n, tables * probes)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    d = vector.cast("array<double>")
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(d, lambda x: x != 0), F.lit(False))


def _unit(flat: pa.Array, width: int) -> np.ndarray:
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def links(classes: DataFrame, least: float, tables: int, probes: int, block_rows: int) -> DataFrame:
    """(a, b, n): forest links with n null, and per class a the number n of rows that it links to; ``classes`` has class,
    copies and embedding (array<double>) of one width."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("embedding")
            lengths = np.diff(column.offsets.to_numpy())
            for width in np.unique(lengths):  # vectors of different widths are never compared
                some = batch.filter(pa.array(lengths == width))
                unit = _unit(some.column("embedding").flatten(), int(width))
                keys = np.sort(buckets(unit, tables, probes) * 4099 + int(width), axis=1)
                n, k = keys.shape
                at = np.repeat(np.arange(n), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), some.column("class").take(pa.array(at)), some.column("copies").take(pa.array(at)),
                     pa.array([keys[i].tobytes() for i in at.tolist()]), pa.array([unit[i].tobytes() for i in at.tolist()])],
                    names=["key", "class", "copies", "keys", "unit"])

    filed = classes.select("class", "copies", "embedding").mapInArrow(file, "key long, class long, copies long, keys binary, unit binary")
    # Ordered keys of a class travel with it: a pair counts in the smallest bucket that it shares.
    rows = blocks.dealt(filed.withColumn("bucket", F.col("key")), "key", "class", block_rows)

    def work(table: pa.Table) -> pa.Table:
        key, side, bucket = (table.column(c).to_numpy() for c in ("key", "_side", "bucket"))
        ids, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
        unit = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(len(ids), -1) if len(ids) else np.empty((0, 1))
        shared = np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype=np.int64).reshape(len(ids), -1)
        counts, kept = np.zeros(len(ids), dtype=np.int64), []
        for i, j in blocks.same_key_pairs(key, side, 1 << 15):
            close = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
            i, j = i[close], j[close]
            step = 1 << 12
            for at in range(0, len(i), step):
                a, b = i[at : at + step], j[at : at + step]
                in_both = (shared[a][:, :, None] == shared[b][:, None, :]).any(axis=2)
                once = np.where(in_both, shared[a], np.iinfo(np.int64).max).min(axis=1) == bucket[a]
                a, b = a[once], b[once]
                np.add.at(counts, a, copies[b])
                np.add.at(counts, b, copies[a])
                kept.append((a, b))
        root = blocks.forest(iter(kept), len(ids))
        at, n = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(counts)
        none = lambda k, kind: pa.nulls(k, kind)
        return pa.table({
            "a": np.r_[ids[at], ids[n]], "b": pa.concat_arrays([pa.array(ids[root[at]], pa.int64()), none(len(n), pa.int64())]),
            "n": pa.concat_arrays([none(len(at), pa.int64()), pa.array(counts[n], pa.int64())]),
        })

    partitions = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.linked(rows, "key", partitions, work, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, tables: int = TABLES, probes: int = PROBES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding and more).

    Links join vectors with cosine >= ``least``; n_links counts the other rows a row is linked to, copies included. Null or
    zero vectors and those with null, NaN or infinite components link with nothing: a component of their own. Repeated ids are
    rows of their own in the counts and share what they link. The hash may miss a pair, most likely near ``least``; it never adds one.
    """
    d = F.col("embedding").cast("array<double>")
    own = vectors.select("vec_id", F.when(usable(F.col("embedding")), d).alias("embedding"))
    own = own.withColumn("class", F.xxhash64("embedding")).withColumn("ok", F.col("embedding").isNotNull())
    # The class number is a 64-bit hash of the vector: two of 10^8 vectors share one with a chance of about 1 in 4,000.
    grouped = own.filter("ok").groupBy("class", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    classes = written(grouped, "vector_classes")
    found = written(links(classes, least, tables, probes, block_rows), "vector_links")
    counts = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "class")
    rooted = classes.select("class", "copies", "least_id").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = rooted.join(named, "root").join(counts, "class", "left").select(
        "class", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    joined = own.select("vec_id", "class", "ok").withColumn("class", F.when(F.col("ok"), F.col("class"))).join(of_class, "class", "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
