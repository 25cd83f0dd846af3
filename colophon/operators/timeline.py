"""Chosen date columns and the timelines built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colophon.functions.dates import parse_partial_date
from colophon.functions.text import contains_ci, default_order_key, normalize_header, strip
from colophon.operators.facets import location_label
from colophon.sources.cells import SHEET

SAMPLES = 4  # fixed value: sample dates shown per column
MODES = {"PUBLICATION": "published_header", "ACQUISITION": "acquired_header"}


def _chosen(columns: DataFrame, choices: DataFrame, mode: str) -> DataFrame:
    """SHEET, header, matches, col for every sheet with a table."""
    wanted = choices.select("workbook", "sheet_key", strip(F.col(MODES[mode])).alias("header")).filter("header <> ''")
    sheets = columns.select(*SHEET).distinct().join(wanted, ["workbook", "sheet_key"], "left")
    known = columns.withColumn("norm", normalize_header(F.col("name"))).groupBy(*SHEET, "norm").agg(
        F.count("*").alias("matches"), F.min("col").alias("col")
    )
    return sheets.withColumn("norm", normalize_header(F.col("header"))).join(known, [*SHEET, "norm"], "left").select(
        *SHEET, "header", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("col")).alias("col")
    )


def _readings(table: DataFrame, chosen: DataFrame, date1904: bool) -> DataFrame:
    """The cells of the chosen columns with their parsed date."""
    cells = table.join(chosen.filter("col IS NOT NULL").select(*SHEET, "col"), [*SHEET, "col"])
    return cells.select(*SHEET, "row", strip(F.col("text")).alias("raw")).withColumn(
        "date", parse_partial_date(F.col("raw"), True, date1904)
    )


def inspect_date_columns(
    table: DataFrame, columns: DataFrame, choices: DataFrame, mode: str, date1904: bool = False
) -> DataFrame:
    """SHEET, header, col, state, readable, blank, malformed for every sheet with a table."""
    chosen = _chosen(columns, choices, mode)
    readings = _readings(table, chosen, date1904).groupBy(*SHEET).agg(
        F.count("date").alias("readable"), F.count("*").alias("filled")
    )
    records = table.groupBy(*SHEET).agg(F.count_distinct("row").alias("records"))
    readable, filled = F.coalesce("readable", F.lit(0)), F.coalesce("filled", F.lit(0))
    usable = F.col("matches") == 1
    state = (
        F.when(F.col("header").isNull(), "NOT_SET").when(F.col("matches") == 0, "HEADER_MISSING")
        .when(~usable, "HEADER_AMBIGUOUS").when(readable > 0, "READY").otherwise("NO_READABLE_DATES")
    )
    only = lambda c: F.when(usable, c).otherwise(F.lit(0))
    return chosen.join(readings, SHEET, "left").join(records, SHEET, "left").select(
        *SHEET, "header", "col", state.alias("state"), only(readable).alias("readable"),
        only(F.coalesce("records", F.lit(0)) - filled).alias("blank"), only(filled - readable).alias("malformed"),
    )


def date_samples(table: DataFrame, columns: DataFrame, choices: DataFrame, mode: str, date1904: bool = False) -> DataFrame:
    """SHEET, n, raw, label: the first four filled values of each chosen column."""
    first = W.partitionBy(*SHEET).orderBy("row")
    return (
        _readings(table, _chosen(columns, choices, mode), date1904)
        .withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SAMPLES)
        .select(*SHEET, "n", "raw", F.col("date.label").alias("label"))
    )


def timeline(
    entries: DataFrame, table: DataFrame, columns: DataFrame, choices: DataFrame, mode: str, date1904: bool = False
) -> DataFrame:
    """One row per entry with the date of its sheet's chosen column; entries without a readable date stay."""
    dates = _readings(table, _chosen(columns, choices, mode), date1904).select(*SHEET, "row", "date")
    text = lambda f: F.col(f"{f}.text").alias(f)
    return entries.join(dates, [*SHEET, "row"], "left").select(
        "id", F.coalesce("title.text", F.lit("")).alias("title"), text("circle"), text("artist"), text("identifier"),
        "cover_path", "date", *SHEET, "row", text("default_order"),
    )


def order_dated(rows: DataFrame, ascending: bool = False) -> DataFrame:
    """Dated rows by date in the asked direction; ties always ascend by default order, then id."""
    key = F.col("date.sort_key")
    return rows.filter(F.col("date").isNotNull()).orderBy(
        key.asc() if ascending else key.desc(), default_order_key(F.col("default_order")), "id"
    )


def order_undated(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("date").isNull()).orderBy(F.lower("sheet"), "row", "id")


def timeline_sections(rows: DataFrame) -> DataFrame:
    """year, entries, first_day, last_day: one row per year; the members are the ordered rows of that year."""
    return rows.filter(F.col("date").isNotNull()).groupBy(F.col("date.year").alias("year")).agg(
        F.count("*").alias("entries"), F.min("date.sort_key").alias("first_key"), F.max("date.sort_key").alias("last_key")
    )


def timeline_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("date").alias("dated"), F.count_if(F.col("date").isNull()).alias("undated"))


def _matches(needle: str) -> Column:
    if not needle.strip():
        return F.lit(True)
    texts = [F.col(c) for c in ("title", "circle", "artist", "identifier")] + [location_label()]
    return reduce(lambda a, b: a | b, [contains_ci(c, needle.strip()) for c in texts])


def _bounds(year_from: int | None, year_to: int | None) -> tuple[int | None, int | None]:
    if year_from is not None and year_to is not None:
        return min(year_from, year_to), max(year_from, year_to)
    return year_from, year_to


def filter_timeline(rows: DataFrame, needle: str = "", year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Rows that contain the needle and lie in the years; bounds may be open or reversed.

    With a year bound, undated rows leave; :func:`excluded_without_date` counts them.
    """
    lo, hi = _bounds(year_from, year_to)
    out = rows.filter(_matches(needle))
    if lo is not None:
        out = out.filter(F.col("date.year") >= lo)
    if hi is not None:
        out = out.filter(F.col("date.year") <= hi)
    return out


def excluded_without_date(
    rows: DataFrame, needle: str = "", year_from: int | None = None, year_to: int | None = None
) -> DataFrame:
    ranged = year_from is not None or year_to is not None
    return rows.agg(F.count_if(_matches(needle) & F.col("date").isNull() & F.lit(ranged)).alias("excluded"))


def timeline_years(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("date").isNotNull()).select(F.col("date.year").alias("year")).distinct().orderBy("year")
