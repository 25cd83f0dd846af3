"""Facets, record search and the gallery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from colophon.functions.cellref import column_letter
from colophon.functions.text import contains_ci, strip
from colophon.operators.mapping import FIELD_NAMES, REQUIRED, scope
from colophon.sources.cells import SHEET

LAST = "￿"  # fixed value: missing text sorts after every other text
OPTIONAL = [f for f in FIELD_NAMES if f != REQUIRED]


def _shown(table: DataFrame) -> DataFrame:
    return table.withColumn("value", strip(F.col("shown"))).filter(F.col("value") != "")


def facet_fields(table: DataFrame, columns: DataFrame, min_values: int = 2) -> DataFrame:
    """SHEET, col, label, values: columns with enough distinct shown values to filter on."""
    counted = _shown(table).groupBy(*SHEET, "col").agg(F.count_distinct("value").alias("values"))
    name, letter = strip(F.col("name")), column_letter(F.col("col"))
    labels = columns.withColumn("folded", F.lower(name))
    same = labels.groupBy(*SHEET, "folded").agg(F.count("*").alias("same_name"))
    label = (
        F.when(name == "", F.concat(F.lit("Column "), letter))
        .when(F.col("same_name") > 1, F.concat(name, F.lit(" ("), letter, F.lit(")"))).otherwise(name)
    )
    return (
        labels.join(same, [*SHEET, "folded"]).join(counted, [*SHEET, "col"]).filter(F.col("values") >= min_values)
        .select(*SHEET, "col", label.alias("label"), "values")
    )


def facet_values(table: DataFrame, sheet: str, col: int, needle: str = "") -> DataFrame:
    """Distinct shown values of one column, sorted; the needle narrows them."""
    rows = _shown(table).filter((F.col("sheet") == sheet) & (F.col("col") == col))
    if needle.strip():
        rows = rows.filter(contains_ci(F.col("value"), needle.strip()))
    return rows.select("value").distinct().orderBy("value")


def facet_filter(table: DataFrame, filters: DataFrame) -> DataFrame:
    """SHEET, row of the records that satisfy every filter (sheet, col, value): relational division.

    filters is the user's selection, one row per chosen facet.
    """
    wanted = filters.select("sheet", "col", strip(F.col("value")).alias("value")).distinct()
    hits = _shown(table).join(wanted, ["sheet", "col", "value"]).groupBy(*SHEET, "row").agg(F.count("*").alias("met"))
    needed = wanted.agg(F.count("*").alias("needed"))
    return hits.join(F.broadcast(needed), F.col("met") == F.col("needed")).select(*SHEET, "row")


def facet_filters(table: DataFrame, filters: DataFrame, selection: str) -> DataFrame:
    """selection, SHEET, row: as :func:`facet_filter` for many selections at once; filters carry the selection they belong to."""
    wanted = filters.select(selection, "sheet", "col", strip(F.col("value")).alias("value")).distinct()
    needed = wanted.groupBy(selection).agg(F.count("*").alias("needed"))
    hits = _shown(table).join(wanted, ["sheet", "col", "value"]).groupBy(selection, *SHEET, "row").agg(F.count("*").alias("met"))
    return hits.join(needed, selection).filter("met = needed").select(selection, *SHEET, "row")


def search_records(table: DataFrame, needle: str) -> DataFrame:
    """SHEET, row of the records with the needle in any stored or shown text; a blank needle keeps all."""
    rows = table
    if needle.strip():
        rows = table.filter(contains_ci(F.col("text"), needle.strip()) | contains_ci(F.col("shown"), needle.strip()))
    return rows.select(*SHEET, "row").distinct()


def categorical_fields(table: DataFrame, max_values: int = 40) -> DataFrame:
    """SHEET, col, values: columns with 2..max_values distinct stored values, fewer than records."""
    records = table.groupBy(*SHEET).agg(F.count_distinct("row").alias("records"))
    values = (
        table.withColumn("value", strip(F.col("text"))).filter(F.col("value") != "")
        .groupBy(*SHEET, "col").agg(F.count_distinct("value").alias("values"))
    )
    return (
        values.join(records, SHEET)
        .filter(F.col("values").between(2, max_values) & (F.col("values") < F.col("records")))
        .select(*SHEET, "col", "values")
    )


def browse_records(
    table: DataFrame, hits: DataFrame, images: DataFrame, needle: str = "", filters: DataFrame | None = None
) -> DataFrame:
    """SHEET, row, has_image for the records that pass search and facets."""
    rows = search_records(table, needle)
    if filters is not None:
        rows = rows.join(facet_filter(table, filters), [*SHEET, "row"], "left_semi")
    linked = hits.join(images.filter("state = 'LINKED'").select("key"), "key", "left_semi").select(*SHEET, "row").distinct()
    return rows.join(linked.withColumn("has_image", F.lit(True)), [*SHEET, "row"], "left").withColumn(
        "has_image", F.coalesce("has_image", F.lit(False))
    )


def missing_metadata_count():
    """Optional fields of an entry whose cell is blank."""
    return reduce(lambda a, b: a + b, [F.when(F.col(f"{f}.state") == "MISSING", 1).otherwise(0) for f in OPTIONAL])


def location_label():
    return F.concat(F.col("sheet"), F.lit("!"), (F.col("row") + 1).cast("string"))


GALLERY_SORTS = {
    "TITLE": lambda: [F.coalesce(F.lower(strip(F.col("title.text"))), F.lit(LAST)), F.col("id")],
    "CIRCLE": lambda: [F.coalesce(F.lower(strip(F.col("circle.text"))), F.lit(LAST)), F.col("id")],
    "ARTIST": lambda: [F.coalesce(F.lower(strip(F.col("artist.text"))), F.lit(LAST)), F.col("id")],
    "ROW": lambda: [F.lower("sheet"), F.col("row"), F.col("id")],
}


def gallery(
    entries: DataFrame, *, sheets: list[str] | None = None, needle: str = "", cover: bool | None = None,
    missing_title: bool = False, missing_metadata: bool = False, sort: str = "TITLE", ascending: bool = True,
) -> DataFrame:
    """Filtered, ordered entries; missing sort text comes last and descending reverses the whole order."""
    out, needle = scope(entries, sheets), needle.strip()
    if needle:
        texts = [F.col(f"{f}.text") for f in ("title", "circle", "artist", "identifier", "url")] + [location_label()]
        out = out.filter(reduce(lambda a, b: a | b, [contains_ci(c, needle) for c in texts]))
    if cover is not None:
        out = out.filter(F.col("verified_cover") == cover)
    if missing_title:
        out = out.filter(F.coalesce(strip(F.col("title.text")), F.lit("")) == "")
    if missing_metadata:
        out = out.filter(missing_metadata_count() > 0)
    return out.orderBy(*[k.asc() if ascending else k.desc() for k in GALLERY_SORTS[sort]()])
