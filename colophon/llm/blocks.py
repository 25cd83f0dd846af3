"""Links inside buckets of rows with equal keys, without listing all pairs of a bucket.

Rows with a key meet in sorted order and are compared in numpy, a bucket at a time. What leaves is not every linked pair but
a spanning forest (each linked row with the smallest row of its cluster), so a bucket of g rows yields at most g - 1 links.

A bucket over ``block_rows`` rows is *hot*: its rows are cut into blocks by hash, and every pair of its blocks becomes a
bucket of its own, so no task holds more than two blocks and the work of one hot key is spread. The number of blocks follows
from the counted rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colophon.llm.shared import written

BLOCK_ROWS = 4096


def dealt(rows: DataFrame, key: str, order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``key`` replaced by one that holds at most about 2 * block_rows rows, and ``_side`` (0 or 1).

    Rows of an ordinary bucket have side 0. In a pair of different blocks the two have sides 0 and 1 and only rows of
    different sides need to be compared; in a block with itself all have side 0. ``rows`` is read twice.
    """
    counted = rows.groupBy(key).count().filter(F.col("count") > block_rows)
    # Written, so that its size is known when the join is planned: a short table of hot keys saves moving all rows for it.
    hot = written(counted.select(key, F.ceil(F.col("count") / block_rows).cast("int").alias("_n")), "hot_keys")
    marked = rows.join(hot, key, "left")
    block = F.pmod(F.xxhash64(order), F.col("_n")).cast("int")
    one = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side")))
    all_of = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda j: F.struct(
        F.least(j, block).alias("i"), F.greatest(j, block).alias("j"), (block > j).cast("int").alias("side")))
    spread = marked.withColumn("_b", F.explode(F.when(F.col("_n").isNull(), one).otherwise(all_of)))
    dealt_key = F.when(F.col("_b.i") < 0, F.xxhash64(key)).otherwise(F.xxhash64(key, F.col("_b.i"), F.col("_b.j")))
    return spread.withColumn(key, dealt_key).withColumn("_side", F.col("_b.side")).drop("_n", "_b")


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Smallest row of each row's cluster from chunks of linked row pairs; only links that join two clusters cost a step."""
    parent = np.arange(n)

    def flatten():
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                return
            parent[:] = up

    for i, j in pairs:
        while len(i):
            a, b = parent[i], parent[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            flatten()
    return parent


def same_key_pairs(keys: np.ndarray, sides: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (i, j), i < j, of rows with equal keys (sorted by key); pairs of a two-sided bucket have different sides."""
    two_sided = np.zeros(len(keys), dtype=bool)
    if sides.any():
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        has = np.add.reduceat(sides, starts) > 0
        two_sided = np.repeat(has, np.diff(np.r_[starts, len(keys)]))
    at, d = np.arange(len(keys) - 1), 1
    held_i, held_j, held = [], [], 0
    while len(at):
        at = at[at + d < len(keys)]
        at = at[keys[at + d] == keys[at]]
        i, j = at, at + d
        use = ~two_sided[i] | (sides[i] != sides[j])
        held_i.append(i[use])
        held_j.append(j[use])
        held += int(use.sum())
        if held >= limit:
            yield np.concatenate(held_i), np.concatenate(held_j)
            held_i, held_j, held = [], [], 0
        d += 1
    if held:
        yield np.concatenate(held_i), np.concatenate(held_j)


def whole_buckets(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole buckets from batches sorted by key; only the last, open bucket is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut or held and held[-1].column(key)[-1].as_py() != keys[0]:
            head = [*held, batch.slice(0, cut)]
            yield pa.Table.from_batches([x for x in head if x.num_rows])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def linked(rows: DataFrame, key: str, partitions: int, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` over tables of whole buckets, wherever they land."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in whole_buckets(batches, key):
            yield from work(found).to_batches()

    return rows.repartition(partitions, key).sortWithinPartitions(key).mapInArrow(run, schema)
