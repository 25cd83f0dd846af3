"""Mixing sources to target weights by distributed prefix sums.

Every row gets a hash-random key from its id and text. The key's leading bits deal a source over ``buckets`` equal ranges, so
sorting by (source, bucket, key) is a range sort whose borders need no sampling and are the same in every run. Words before
a row = words of earlier buckets of its source (a sum over at most ``buckets`` totals) + words before it in its bucket.
A source of a third of all rows is spread over all buckets. A source is read in key order until its budget is spent: whole
epochs first, then up to the exact word.

Targets: sources by code point, null last, weigh ``weights`` in turn and share all words; no target exceeds ``most`` times its
source, and what lies above is shared again by weight. The level at which nothing is above is found from sums over sources
sorted by the level where each stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colophon.llm.shared import words, written
from colophon.operators.numbering import ranked, running_totals

WEIGHTS = (1, 2, 3)
BUCKETS = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, target) from rows with source and size. Sources may be many: their places and running sums are
    found by ranges, never in one task."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = per.withColumn("none", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    placed = ranked(named, ["none", "name"], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    # A source stops once the level (words per weight) reaches its stop; below that, target = level * weight.
    stops = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("stop", F.col("cap") / F.col("weight"))
    summed = running_totals(stops, ["stop", "place"], {"capped": F.col("cap"), "spent": F.col("weight")})
    summed = written(summed, "mixing_sources")
    one = F.lit(1).alias("_one")
    every = summed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("all_weight"), one)
    before = F.col("capped") - F.col("cap") + F.col("stop") * (F.col("all_weight") - F.col("spent") + F.col("weight"))
    # Sources that are full at the common level: those whose stop needs no more than all words.
    marked = summed.withColumn("_one", F.lit(1)).join(F.broadcast(every), "_one").withColumn("full", before <= F.col("words"))
    rest = marked.agg(
        F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).alias("_c"), F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))).alias("_w"), one
    )
    level = marked.join(F.broadcast(rest), "_one")  # one row
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("words") - F.col("_c")) * F.col("weight") / F.col("_w"))
    return level.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """``docs`` (doc_id, source, text and more) with size, source_size, target, taken (words, repeats counted).

    Sizes are words between ASCII blanks; a null text has none and takes none. Null sources are a source of their own. Rows
    that are equal in id, source and text have equal keys; which comes first makes no difference between them. Columns of the
    new names are replaced, other columns come along.
    """
    sized = docs.drop("source_size", "target", "taken").withColumn("size", F.size(words(F.col(text))).cast("long"))
    key = F.xxhash64(F.col("doc_id"), F.col("source"), F.coalesce(F.xxhash64(text), F.lit(0)))
    keyed = sized.withColumn("_key", key).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_key", 40), F.lit(buckets)).cast("int"))
    return _taken(keyed, weights, most)


def _taken(keyed: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    source_key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    totals = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("size"))
    totals = written(totals, "mixing_totals")  # at most buckets rows per source
    earlier = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    plan = offsets.join(targets(totals, weights, most).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    plan = plan.select(source_key.alias("_k"), F.col("_bucket").alias("_b"), "_before", "source_size", "target")
    inside = W.partitionBy("source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.withColumn("_sk", source_key).join(plan, (F.col("_sk") == F.col("_k")) & (F.col("_bucket") == F.col("_b")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("_before") - F.col("_within")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return joined.withColumn("taken", taken.cast("long")).drop("_key", "_bucket", "_within", "_before", "_k", "_sk", "_b")


def copies(size: Column, taken: Column) -> Column:
    """How often the whole document stands in the mix: full epochs, and the last one if at least half of it is taken."""
    return F.when(size > 0, F.floor((taken + size / 2) / size)).otherwise(0).cast("int")

