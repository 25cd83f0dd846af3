"""Workbook figures and the difference of two workbooks.

Comparisons run for any number of workbook pairs at once: every input carries the ``pair`` it belongs to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

SHEET_KEYS = ["workbook", "sheet"]


def sheet_metrics(sheets: DataFrame, comments: DataFrame, images: DataFrame, places: DataFrame) -> DataFrame:
    """workbook, sheet, visibility, dimension, comments, linked, unresolved per declared sheet."""
    noted = comments.groupBy(*SHEET_KEYS).agg(F.count("*").alias("comments"))
    placed = (
        places.select("key", *SHEET_KEYS).distinct().join(images.select("key", "state"), "key")
        .groupBy(*SHEET_KEYS).agg(
            F.count_if(F.col("state") == "LINKED").alias("linked"),
            F.count_if(F.col("state") == "UNRESOLVED").alias("unresolved"),
        )
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("comments", "linked", "unresolved")]
    return sheets.join(noted, SHEET_KEYS, "left").join(placed, SHEET_KEYS, "left").select(
        *SHEET_KEYS, "pos", "visibility", "dimension", *zero
    )


def workbook_metrics(workbooks: DataFrame, sheets: DataFrame, images: DataFrame, records: DataFrame) -> DataFrame:
    """One row per workbook; a figure that cannot be established stays null, never 0.

    workbooks: workbook, sha256, failure; sheets: sheet_metrics; images: workbook, state, media_path;
    records: workbook (one row per catalogue record).
    """
    by_sheet = sheets.groupBy("workbook").agg(F.count("*").alias("sheets"), F.sum("comments").alias("comments"))
    by_image = images.groupBy("workbook").agg(
        F.count("media_path").alias("media"),
        *[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("LINKED", "UNREFERENCED", "UNRESOLVED")],
    )
    by_record = records.groupBy("workbook").agg(F.count("*").alias("records"))
    joined = workbooks
    for part in (by_sheet, by_image, by_record):
        joined = joined.join(part, "workbook", "left")
    known = lambda c: F.when(F.col("failure").isNull(), F.coalesce(c, F.lit(0))).alias(c)
    return joined.select(
        "workbook", "sha256", "failure",
        *[known(c) for c in ("sheets", "comments", "linked", "media", "unreferenced", "unresolved")],
        F.when(F.col("failure").isNull(), F.col("records")).alias("records"),
    )


def _sides(left: DataFrame, right: DataFrame, columns: list[str]):
    side = lambda df, s: df.select("pair", F.lower("sheet").alias("name"), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return side(left, "l"), side(right, "r")


def compare_sheets(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair, name, presence, changes: sheets matched by lower-case name, changed figures only.

    Inputs are sheet_metrics with a pair column.
    """
    a, b = _sides(left, right, ["sheet", "visibility", "dimension", "comments", "linked", "unresolved"])
    joined = a.join(b, ["pair", "name"], "full_outer")
    both = F.col("sheet_l").isNotNull() & F.col("sheet_r").isNotNull()

    def change(label: str, c: str, fold: bool = False):
        x, y = F.col(f"{c}_l"), F.col(f"{c}_r")
        same = F.lower(x).eqNullSafe(F.lower(y)) if fold else x.eqNullSafe(y)
        show = lambda v: F.coalesce(v.cast("string"), F.lit("not declared"))
        return F.when(both & ~same, F.concat(F.lit(f"{label}: "), show(x), F.lit(" -> "), show(y)))

    changes = F.array_compact(F.array(
        change("Visibility", "visibility", fold=True), change("Comments", "comments"), change("Linked images", "linked"),
        change("Unresolved references", "unresolved"), change("Used range", "dimension"),
    ))
    return joined.select(
        "pair", F.coalesce("sheet_l", "sheet_r").alias("sheet"),
        F.when(both, "BOTH").when(F.col("sheet_l").isNotNull(), "LEFT_ONLY").otherwise("RIGHT_ONLY").alias("presence"),
        changes.alias("changes"),
    )


def sheet_order_changed(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair, order_changed: the sheets both sides have come in another order."""
    a, b = _sides(left, right, ["pos"])
    common = a.join(b, ["pair", "name"])
    before = F.lag("pos_r").over(W.partitionBy("pair").orderBy("pos_l"))
    stepped = common.withColumn("before", before)
    return stepped.groupBy("pair").agg(F.coalesce(F.bool_or(F.col("before") > F.col("pos_r")), F.lit(False)).alias("order_changed"))


def headers_changed(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair, headers_changed for (pair, idx, name) header lists; case does not count."""
    side = lambda df, s: df.select("pair", "idx", F.lower("name").alias(s))
    joined = side(left, "l").join(side(right, "r"), ["pair", "idx"], "full_outer")
    return joined.groupBy("pair").agg(F.bool_or(~F.col("l").eqNullSafe(F.col("r"))).alias("headers_changed"))


TOTALS = {
    "Worksheets": "sheets", "Legacy comments": "comments", "Linked images": "linked", "Media files": "media",
    "Unreferenced media": "unreferenced", "Unresolved references": "unresolved", "Catalogue records": "records",
}


def compare_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair, same_file, changes: workbook_metrics of both sides (with pair), differing totals only."""
    keep = [*TOTALS.values(), "sha256", "failure"]
    side = lambda df, s: df.select("pair", *[F.col(c).alias(f"{c}_{s}") for c in keep])
    joined = side(left, "l").join(side(right, "r"), "pair")
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    changes = [
        F.when(~F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r")), F.concat(F.lit(f"{label}: "), show(f"{c}_l"), F.lit(" -> "), show(f"{c}_r")))
        for label, c in TOTALS.items()
    ]
    same = (
        F.col("failure_l").isNull() & F.col("failure_r").isNull() & (F.col("sha256_l") != "")
        & (F.col("sha256_l") == F.col("sha256_r"))
    )
    return joined.select("pair", F.coalesce(same, F.lit(False)).alias("same_file"), F.array_compact(F.array(*changes)).alias("changes"))
