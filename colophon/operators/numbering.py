"""Numbers for rows of large tables without one task that sees them all: ranks, places in a group, free numbers.

Each function cuts its order into ranges, counts inside them and adds up the counts of the ranges before. What is added up is
one row per range.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colophon.session import checkpoint_dir

RANGE_ROWS = 65_536


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that a later step reads what an earlier one saw."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranges(df: DataFrame, order: list[str], ranges: int | None) -> DataFrame:
    """``df`` sorted into ranges of the total order by sampled borders, with the number of the range; written, as a range of a
    second run may begin elsewhere."""
    count = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running_totals(df: DataFrame, order: list[str], totals: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """Adds running totals in the total order of the ``order`` columns, each row's own value included.

    Rows are summed inside their range, and the totals of the ranges before are added. Null values count nothing.
    """
    cut = _ranges(df.withColumns({f"_v_{n}": v for n, v in totals.items()}), order, ranges)
    per = cut.groupBy("_range").agg(*[F.coalesce(F.sum(f"_v_{n}"), F.lit(0)).alias(n) for n in totals]).orderBy("_range").collect()  # one row per range
    start, so_far = [], [0] * len(totals)
    for r in per:
        start.append((r["_range"], *so_far))
        so_far = [a + r[n] for a, n in zip(so_far, totals)]
    kinds = ", ".join(f"_b_{n} {cut.agg(F.sum(f'_v_{n}').alias('s')).schema['s'].dataType.simpleString()}" for n in totals)
    before = df.sparkSession.createDataFrame(start, f"_range int, {kinds}", verifySchema=False)
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = {n: F.col(f"_b_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in totals}
    return cut.join(F.broadcast(before), "_range").withColumns(sums).select(*[c for c in df.columns if c not in totals], *totals)


def ranked(df: DataFrame, order: list[str], into: str = "place", ranges: int | None = None) -> DataFrame:
    """Adds the place (from 1) of every row in the total order of the ``order`` columns; equal rows are told apart arbitrarily."""
    return running_totals(df, order, {into: F.lit(1)}, ranges)


def place_in_group(df: DataFrame, group: list[str], number: str, into: str, ties: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds the place (from 1) of every row among its group's rows by a whole ``number`` and, where equal, ``ties``.

    Numbers are cut into ranges of ``range_rows``; a group of any size is spread over its ranges.
    """
    cut = df.withColumn("_range", F.floor(F.col(number) / range_rows))
    sizes = cut.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.sum("_n").over(earlier)).filter("_before > 0").drop("_n")
    same = [F.col(f"_l.{g}").eqNullSafe(F.col(f"_r.{g}")) for g in group]
    same.append(F.col("_l._range").eqNullSafe(F.col("_r._range")))
    inside = F.row_number().over(W.partitionBy(*group, "_range").orderBy(number, *(ties or [])))
    placed = cut.withColumn("_inside", inside).alias("_l").join(offsets.alias("_r"), same, "left")
    at = (F.col("_l._inside") + F.coalesce("_r._before", F.lit(0))).cast("long")
    return placed.select(*[F.col(f"_l.{c}") for c in df.columns], at.alias(into))


def free_numbers(wanted: DataFrame, taken: DataFrame, key: str, nth: str, into: str = "number", first: int = 1, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds the ``nth`` (from 1) whole number from ``first`` on that its key has not taken.

    taken: key, number. The taken numbers of a key become runs, each with the count of free numbers before it, so the nth free
    number is nth plus the taken numbers of the runs up to there. Runs are found by places, not by listing a key's numbers:
    a free number's run is the last one whose ``free`` count is below nth, and both sides meet by ranges of that count.
    """
    used = taken.filter(F.col("number") >= first).select(key, F.col("number").cast("long").alias("number")).distinct()
    placed = place_in_group(used, [key], "number", "_at", range_rows=range_rows)
    free_before = F.col("number") - F.lit(first) - (F.col("_at") - 1)  # the same along a run
    runs = placed.groupBy(key, free_before.alias("_free")).agg(F.max("_at").alias("_taken"))
    # Per range of free counts: the taken numbers of all runs before the range, then those inside it.
    ends = runs.withColumn("_range", F.floor(F.col("_free") / range_rows))
    reach = ends.groupBy(key, "_range").agg(F.max("_taken").alias("_taken"))
    asked = wanted.withColumn("_range", F.floor((F.col(nth) - 1) / range_rows))
    steps = W.partitionBy(key).orderBy("_range", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    places = asked.select(key, "_range").distinct().withColumn("_kind", F.lit(0)).withColumn("_taken", F.lit(None).cast("long"))
    before = (
        reach.withColumn("_kind", F.lit(1)).select(key, "_range", "_kind", "_taken").unionByName(places)
        .withColumn("_before", F.max("_taken").over(steps)).filter("_kind = 0").select(key, "_range", "_before")
    )
    # Inside a range: a wanted number follows the runs with a smaller free count, in one order with them.
    both = W.partitionBy(key, "_range").orderBy("_free", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    row = F.struct(*[F.col(c) for c in wanted.columns])
    events = ends.select(key, "_range", "_free", F.lit(0).alias("_kind"), "_taken", F.lit(None).cast(wanted.schema).alias("_row")).unionByName(
        asked.select(key, "_range", (F.col(nth) - 1).cast("long").alias("_free"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_taken"), row.alias("_row"))
    )
    met = events.withColumn("_inside", F.max("_taken").over(both)).filter("_kind = 1").join(before, [key, "_range"], "left")
    skipped = F.coalesce(F.greatest("_inside", "_before"), F.lit(0))
    return met.select("_row.*", (F.lit(first - 1) + F.col("_row")[nth] + skipped).alias(into))


def place_in_order(df: DataFrame, group: list[str], order: list[str], into: str) -> DataFrame:
    """Adds the place (from 1) of every row among its group's rows by columns of any kind: its rank among all rows by group and
    order, less that of the group's first row. Groups are few rows here, or one of them is any share of all; both spread."""
    placed = ranked(df, [*group, *order], "_place")
    first = placed.groupBy(*group).agg(F.min("_place").alias("_first"))
    same = [F.col(f"_l.{g}").eqNullSafe(F.col(f"_r.{g}")) for g in group]
    return placed.alias("_l").join(first.alias("_r"), same).select("_l.*", (F.col("_l._place") - F.col("_r._first") + 1).alias(into)).drop("_place")
