"""Connected components of a table of links, by alternating large and small stars.

Every step is a partial aggregate (the smallest neighbour of a node) and a join with one row per node, so a node of a third of
all links is never a group in one task. Each round is a written table: lineage is cut and survives lost executors. Links only
shrink towards the smallest node of their component; a round that changes nothing ends it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colophon.llm.shared import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _hook(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or all in a table of smaller ones) hang on its smallest neighbour."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = pairs.join(least, "a")
    if larger_only:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): every node that has a link to another node, with the smallest node of its component.

    Ids are long; null ends and loops are ignored; repeated and reversed links don't matter.
    """
    proper = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(proper.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        large = _hook(_both(now), True).filter("a != b").distinct()  # (larger, smallest neighbour)
        small = _hook(large, False).filter("a != b").distinct()
        now = written(small, "links")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
