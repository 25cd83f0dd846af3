"""A stored vector index per catalogue: its blocks of vectors, its baseline and which indexes are kept.

Layout: vectors by (cache_key, version, block), and per key a table of its blocks (centre, reach, version) and one row with its
baseline. A block holds vectors that lie near one pivot, so a search can tell from the centre and the reach which blocks cannot
hold any of the k best, and never opens their files. Writing a key again adds a version and then replaces the key's block table,
which names the version that counts; readers see the old rows or the new ones, never both.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.utils import AnalysisException

from colophon.functions.vectors import dot
from colophon.operators.numbering import written
from colophon.operators.similarity import baselines, topk_inner_product
from colophon.sources.workbooks import recent

VERSION, KEPT = 1, 8  # fixed values: layout version and number of indexes kept
BLOCKS = 64  # blocks of an index; pivots are sent to every task, so their number is a bound


def cache_key(sha: Column, cell_range: Column, model: Column, floating: Column) -> Column:
    """Key of an index: anything that changes its vectors changes the key."""
    flag = F.concat(F.lit("floating="), F.lower(floating.cast("string")))
    return F.sha2(F.concat_ws("|", F.lit(f"v{VERSION}"), sha, cell_range, model, flag), 256)


def _replace(rows: DataFrame, path: str, *keys: str) -> None:
    """Write partitions; a key that is written again gets its new rows instead of its old ones, other keys stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def in_blocks(vectors: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Adds ``block``: the nearest of the key's pivots, which are the ``blocks`` vectors with the smallest hashes."""
    first = W.partitionBy("cache_key").orderBy("_h", "id")
    pivots = (
        vectors.select("cache_key", "id", "embedding", F.xxhash64(F.col("id").cast("string")).alias("_h"))
        .withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= blocks)
        .groupBy("cache_key").agg(F.collect_list("embedding").alias("pivots"))  # ``blocks`` vectors a key
    )
    pivots = written(pivots, "pivots")
    nearest = lambda: F.array_max(F.transform("pivots", lambda p, n: F.struct(dot(p, F.col("embedding")).alias("s"), (-n).alias("n"))))
    return vectors.join(pivots, "cache_key").withColumn("block", (-nearest()["n"]).cast("int")).drop("pivots")


def block_bounds(placed: DataFrame) -> DataFrame:
    """cache_key, block, vectors, centre, reach: no vector of a block is further than ``reach`` from its centre."""
    sums = placed.select("cache_key", "block", "id", F.posexplode("embedding").alias("i", "x")).groupBy("cache_key", "block", "i").agg(
        F.avg("x").alias("m"), F.count("*").alias("n")
    )
    centres = sums.groupBy("cache_key", "block").agg(
        F.max("n").alias("vectors"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre")
    )
    apart = F.sqrt(F.aggregate(F.zip_with("embedding", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    reach = placed.join(centres, ["cache_key", "block"]).groupBy("cache_key", "block").agg(F.max(apart).alias("reach"))
    return centres.join(reach, ["cache_key", "block"])


def write_vector_index(vectors: DataFrame, path: str, at: int, blocks: int = BLOCKS) -> None:
    """vectors: cache_key, id, cell, embedding. Replaces the indexes of the keys that it holds."""
    rows = vectors.select("cache_key", "id", "cell", F.col("embedding").cast("array<double>").alias("embedding"))
    placed = written(in_blocks(rows, blocks).withColumn("version", F.lit(uuid.uuid4().hex)), "placed")
    placed.repartition("cache_key", "block").write.mode("append").partitionBy("cache_key", "version", "block").parquet(f"{path}/vectors")
    bounds = block_bounds(placed).join(placed.select("cache_key", "version").distinct(), "cache_key")
    _replace(bounds.withColumn("key", F.col("cache_key")), f"{path}/blocks", "key")
    _replace(baselines(rows, "cache_key").withColumns({"last_used": F.lit(at).cast("long"), "key": F.col("cache_key")}), f"{path}/indexes", "key")


def touch(spark: SparkSession, path: str, key: str, at: int) -> None:
    """Note the use of an index."""
    row = written(read_baselines(spark, path).filter(F.col("cache_key") == key), "touched")
    _replace(row.withColumns({"last_used": F.lit(at).cast("long"), "key": F.col("cache_key")}), f"{path}/indexes", "key")


def _versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/blocks").select("cache_key", "version").distinct()


def read_vector_index(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Vectors of one index (partition filters prune the others) or of the indexes still kept."""
    vectors = spark.read.parquet(f"{path}/vectors")
    if key is not None:
        return pruned(spark, path, key)
    counting = _versions(spark, path).join(kept_indexes(spark, path).select("cache_key"), "cache_key")
    return vectors.join(counting, ["cache_key", "version"], "left_semi")


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/indexes").drop("key")


def kept_indexes(spark: SparkSession, path: str, keep: int = KEPT) -> DataFrame:
    """cache_key, last_used of the most recently used indexes; removing the others is the store's work."""
    return recent(read_baselines(spark, path), keep)


def needed_blocks(spark: SparkSession, path: str, key: str, queries: DataFrame, k: int) -> list[int]:
    """Blocks of an index that may hold one of the k best of some query.

    A vector of a block scores at most query . centre + |query| reach, and at least that with the reach taken off. The k-th
    best of a query is at least the lower bound of the block at which, by falling lower bounds, k vectors are reached.
    """
    bounds = spark.read.parquet(f"{path}/blocks").filter(F.col("key") == key)
    bounds = bounds.agg(F.collect_list(F.struct("block", "vectors", "centre", "reach")).alias("all")).withColumn("one", F.lit(1))
    length = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    asked = queries.select("query", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(1).alias("one")).withColumn("length", length)
    each = asked.join(F.broadcast(bounds), "one").withColumn("b", F.explode("all"))  # one row of at most BLOCKS bounds
    score, margin = dot(F.col("embedding"), F.col("b.centre")), F.col("length") * F.col("b.reach") + 1e-9 * (1 + F.col("length"))
    met = each.select("query", "b.block", "b.vectors", (score - margin).alias("low"), (score + margin).alias("high"))
    falling = W.partitionBy("query").orderBy(F.desc("low"), "block").rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = met.withColumn("upto", F.sum("vectors").over(falling))
    floor = reached.groupBy("query").agg(F.max(F.when(F.col("upto") >= k, F.col("low"))).alias("floor"))
    open_ = met.join(floor, "query").filter(F.col("floor").isNull() | (F.col("high") >= F.col("floor")))
    return sorted(r.block for r in open_.select("block").distinct().collect())  # at most BLOCKS numbers


def search_vector_index(spark: SparkSession, path: str, key: str, queries: DataFrame, k: int, tie: str = "id") -> DataFrame:
    """query, id, score, rank: the exact top k of an index; files of blocks that cannot hold any are not opened."""
    try:
        blocks = needed_blocks(spark, path, key, queries, k) if k > 0 else []
    except AnalysisException as e:
        raise FileNotFoundError(f"no vector index at {path}") from e
    return topk_inner_product(queries, pruned(spark, path, key, blocks), k, tie=tie)


def pruned(spark: SparkSession, path: str, key: str, blocks: list[int] | None = None) -> DataFrame:
    """The vectors of an index, or of some of its blocks; all filters are on partition columns."""
    now = _versions(spark, path).filter(F.col("cache_key") == key).first()
    rows = spark.read.parquet(f"{path}/vectors").filter((F.col("cache_key") == key) & (F.col("version") == (now.version if now else "")))
    return rows if blocks is None else rows.filter(F.col("block").isin(blocks) if blocks else F.lit(False))
