"""Merging what several providers returned for the same search.

Searches are independent: every table carries the ``search`` it belongs to. ``pos`` is the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colophon.functions.text import normalize_code, strip
from colophon.functions.urls import item_fingerprint, normalise_url
from colophon.operators.search import PROVIDERS, SELECTABLE

# Ranks of result kinds and priorities of picture searches.
RANK_MARKETPLACE, RANK_CATALOGUE = 1, 4
REVERSE_PRIORITY = {"saucenao": 1, "iqdb": 2}
MARKETPLACES = [p[0] for p in PROVIDERS if p[0] not in SELECTABLE] + ["dl"]


def result_key(provider: Column, source: Column, id_: Column, url: Column, title: Column) -> Column:
    """Identity of a result: provider and id, else its URL, else its title."""
    known = F.coalesce(
        F.nullif(strip(provider), F.lit("")), F.when(F.lower(source) == "open library", F.lit("ol"))
    )
    return item_fingerprint(F.concat_ws(":", known, F.when(known.isNotNull(), id_)), url, F.lit(None).cast("string"), title)


def result_rank(provider: Column) -> Column:
    return F.when(F.lower(provider).isin(MARKETPLACES), RANK_MARKETPLACE).otherwise(RANK_CATALOGUE)


def merge_results(results: DataFrame, promoted: DataFrame | None = None, limit: int | None = 10) -> DataFrame:
    """One row per search and key, the best-ranked one, at the place where the key first arrived.

    results: search, pos, provider, source, id, url, title (more columns are carried). Promoted keys
    (search, key) come first. Grouping combines on the map side; the limit per search is a ranked window whose
    partial form keeps at most ``limit`` rows per task.
    """
    carried = [c for c in results.columns if c != "search"]
    keyed = results.withColumn("key", result_key(*[F.col(c) for c in ("provider", "source", "id", "url", "title")]))
    merged = keyed.groupBy("search", "key").agg(
        F.min_by(F.struct(*carried), F.struct(result_rank(F.col("provider")), "pos")).alias("r"), F.min("pos").alias("first_pos")
    )
    if promoted is not None:
        flags = promoted.select("search", "key").distinct().withColumn("promoted", F.lit(0))
        merged = merged.join(flags, ["search", "key"], "left")
    else:
        merged = merged.withColumn("promoted", F.lit(None).cast("int"))
    order = W.partitionBy("search").orderBy(F.coalesce("promoted", F.lit(1)), "first_pos")
    placed = merged.withColumn("place", F.row_number().over(order)).filter(F.lit(True) if limit is None else F.col("place") <= limit)
    return placed.select("search", "key", "place", "r.*")


def _priority(provider: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, rank in REVERSE_PRIORITY.items():
        out = out.when(F.lower(strip(provider)) == name, rank)
    return out.otherwise(2**31 - 1)


def reverse_key(product_id: Column, url: Column, provider: Column, result_id: Column, pos: Column) -> Column:
    """Identity of a picture hit: its product code, else its URL, else its own row."""
    return F.coalesce(
        F.concat(F.lit("id:"), F.when(strip(product_id) != "", normalize_code(product_id))),
        F.concat(F.lit("url:"), normalise_url(url)),
        F.concat_ws(":", F.lit("row"), provider, F.coalesce(result_id, pos.cast("string"))),
    )


def merge_reverse_hits(hits: DataFrame, limit: int | None = 20) -> DataFrame:
    """One candidate per search and identity, best first.

    hits: search, pos, provider, result_id, similarity, source_url, image_url, title, circle, author, product_id of
    the runs that contributed. Texts come from the first hit that has them; the primary hit has the best provider
    priority, then the higher similarity.
    """
    keyed = hits.withColumn("key", reverse_key(*[F.col(c) for c in ("product_id", "source_url", "provider", "result_id", "pos")]))
    filled = lambda c: F.coalesce(
        F.min_by(c, F.when(strip(F.coalesce(F.col(c), F.lit(""))) != "", F.col("pos"))), F.lit("")
    ).alias(c)
    strength = F.coalesce("similarity", F.lit(-1.0))
    merged = keyed.groupBy("search", "key").agg(
        *[filled(c) for c in ("title", "circle", "author", "product_id")],
        F.min_by("image_url", F.when(F.col("image_url").isNotNull(), F.col("pos"))).alias("image_url"),
        F.min(F.struct(_priority(F.col("provider")).alias("priority"), (-strength).alias("weak"), "pos", "provider", "source_url")).alias("p"),
        F.count("*").alias("refs"), F.count_distinct("provider").alias("providers"),
    )
    order = W.partitionBy("search").orderBy("p.priority", "p.weak", "key")
    return (
        merged.withColumn("place", F.row_number().over(order)).filter(F.lit(True) if limit is None else F.col("place") <= limit)
        .select(
            "search", "key", "place", "title", "circle", "author", "product_id", "image_url", "p.provider", "p.source_url",
            F.when(-F.col("p.weak") >= 0, -F.col("p.weak")).alias("similarity"), "refs", "providers",
        )
    )


def classify_run(runs: DataFrame) -> DataFrame:
    """Adds state and contributed to (elapsed_ms, timeout_ms, outcome FOUND|NO_RESULTS|FAILED, hits, failure).

    A late answer is a timeout even when it came; only a success with hits contributes.
    """
    state = (
        F.when(F.col("elapsed_ms") > F.col("timeout_ms"), "TIMEOUT")
        .when((F.col("outcome") == "FOUND") & (F.col("hits") > 0), "SUCCESS")
        .when(F.col("outcome").isin("FOUND", "NO_RESULTS"), "NO_RESULTS")
        .otherwise(F.col("failure"))
    )
    return runs.withColumn("state", state).withColumn("contributed", F.col("state") == "SUCCESS")


def prepend_candidates(new: DataFrame, existing: DataFrame, decisions: DataFrame) -> DataFrame:
    """New candidates before existing ones, the first of each key, with its decision.

    new, existing: search, key, pos; decisions: key, decision.
    """
    both = new.withColumn("old", F.lit(0)).unionByName(existing.withColumn("old", F.lit(1)))
    carried = [c for c in both.columns if c not in ("search", "key")]
    first = both.groupBy("search", "key").agg(F.min_by(F.struct(*carried), F.struct("old", "pos")).alias("c"))
    return first.select("search", "key", "c.*").join(decisions.select("key", "decision"), "key", "left").withColumn(
        "decision", F.coalesce("decision", F.lit("SUGGESTED"))
    ).orderBy("search", "old", "pos")
