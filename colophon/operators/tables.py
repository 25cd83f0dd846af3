"""Worksheet cells to tables: header, columns, records, gaps, shown text, links and windows.

Cells stay in long form, keyed by (workbook, sheet_key, sheet). A sheet may hold any share of all cells, so
work inside a sheet goes through keyed aggregates and equi-joins on (sheet, row) or (sheet, col); the only
per-sheet windows run over its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from colophon.functions.cellref import a1_format, a1_parse, column_letter, parse_range
from colophon.functions.formats import display_value
from colophon.functions.text import strip
from colophon.operators.numbering import written
from colophon.sources.cells import SHEET

# Fixed values of table detection.
HEADER_SCAN_ROWS, MIN_HEADER_CELLS, MAX_HEADER_CHARS = 12, 3, 40
CONTEXT_ROWS, MAX_WINDOW_COLUMNS = 6, 96
ROW_LEVELS = 5  # stretches of up to 64^4 rows, more than a reference can name


def detect_header(cells: DataFrame) -> DataFrame:
    """SHEET, header_row, header_cells: the early row with most usable labels; the first row wins ties."""
    text = strip(F.col("text"))
    usable = F.length(text).between(1, MAX_HEADER_CHARS) & ~F.rlike(text, F.lit(r"^\p{Nd}+$"))
    per_row = (
        cells.filter((F.col("row") < HEADER_SCAN_ROWS) & usable)
        .groupBy(*SHEET, "row").agg(F.count_distinct("col").alias("n"))
    )
    best = F.max(F.struct("n", (-F.col("row")).alias("up"))).alias("best")
    return (
        per_row.groupBy(*SHEET).agg(best).filter(F.col("best.n") >= MIN_HEADER_CELLS)
        .select(*SHEET, (-F.col("best.up")).cast("int").alias("header_row"), F.col("best.n").alias("header_cells"))
    )


def table_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """SHEET, header_row, idx, col, name, labels: columns between the outer header cells that have a label or data.

    Headers lie in the scanned first rows, as :func:`detect_header` finds them. Of all other cells only the last row of each
    column is asked, which is added up before anything moves.
    """
    heads = headers.select(*SHEET, "header_row")
    reach = cells.groupBy(*SHEET, "col").agg(F.max("row").alias("reach")).join(heads, SHEET).filter(F.col("reach") >= F.col("header_row"))
    labels = (
        cells.filter(F.col("row") < HEADER_SCAN_ROWS).join(heads.withColumnRenamed("header_row", "row"), [*SHEET, "row"])
        .groupBy(*SHEET, "col").agg(F.max("text").alias("label"))
    )
    seen = reach.drop("reach").join(labels, [*SHEET, "col"], "left")
    sheet = W.partitionBy(*SHEET)
    labelled = F.when(F.col("label").isNotNull(), F.col("col"))
    return (
        seen.withColumn("lo", F.min(labelled).over(sheet)).withColumn("hi", F.max(labelled).over(sheet))
        .filter(F.col("col").between(F.col("lo"), F.col("hi")))
        .select(
            *SHEET, "header_row",
            (F.row_number().over(sheet.orderBy("col")) - 1).alias("idx"),
            "col", F.coalesce("label", F.lit("")).alias("name"), F.count("label").over(sheet).alias("labels"),
        )
    )


def _table_rows(cells: DataFrame, columns: DataFrame):
    """Cells below the header in table columns, and one row per sheet row that has any."""
    known = columns.select(*SHEET, "header_row", "idx", "col", "name", "labels")
    body = cells.join(known, [*SHEET, "col"]).filter(F.col("row") > F.col("header_row"))
    rows = (
        body.groupBy(*SHEET, "row")
        .agg(
            F.count("*").alias("filled"), F.count_if(F.col("text") == F.col("name")).alias("equal"),
            F.max("labels").alias("labels"),
        )
        .select(*SHEET, "row", ((F.col("filled") == F.col("equal")) & (F.col("equal") == F.col("labels"))).alias("repeat"))
    )
    return body, rows


def table_extent(rows: DataFrame, max_records: int | None = None) -> DataFrame:
    """SHEET, first_row, last_row: a table ends before the first blank row after a record.

    A row ends a run if the row after it is missing: an equi-join on (sheet, row), so a sheet of any length is spread over
    tasks. The table ends at the first such row from its first record on; an explicit limit may end it before.
    """
    first = rows.filter(~F.col("repeat")).groupBy(*SHEET).agg(F.min("row").alias("first_row"))
    after = rows.select(*SHEET, (F.col("row") - 1).alias("row"))
    ends = rows.select(*SHEET, "row").join(after, [*SHEET, "row"], "left_anti")
    extent = ends.join(first, SHEET).filter(F.col("row") >= F.col("first_row")).groupBy(*SHEET, "first_row").agg(F.min("row").alias("last_row"))
    if max_records is None:
        return extent
    return extent.withColumn("last_row", F.least("last_row", F.col("first_row") + (max_records - 1)))


def table_cells(
    cells: DataFrame, columns: DataFrame, styles: DataFrame | None = None, max_records: int | None = None
) -> DataFrame:
    """SHEET, row, idx, col, name, text, shown: the filled cells of the table's records; rows that repeat the header are none."""
    body, rows = _table_rows(cells, columns)
    inside = F.col("row").between(F.col("first_row"), F.col("last_row"))
    kept = body.join(table_extent(rows, max_records), SHEET).filter(inside)
    kept = kept.join(rows.filter("repeat").select(*SHEET, "row"), [*SHEET, "row"], "left_anti")
    if styles is not None:
        kept = display_cells(kept, styles)
    else:
        kept = kept.withColumn("shown", F.col("text"))
    return kept.select(*SHEET, "row", "idx", "col", "name", "text", "shown")


def table_records(table: DataFrame, columns: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """SHEET, row, values, shown: one array per record in field order, blanks as empty text.

    With ``links`` (as from :func:`record_links`) each record also has its links by sheet column, empty where it has none.
    """
    width = columns.groupBy(*SHEET).agg(F.count("*").alias("width"))
    packed = table.groupBy(*SHEET, "row").agg(
        F.map_from_entries(F.collect_list(F.struct("idx", F.struct("text", "shown")))).alias("at")
    )
    every = F.sequence(F.lit(0), (F.col("width") - 1).cast("int"))
    pick = lambda part: F.transform(every, lambda i: F.coalesce(F.col("at")[i][part], F.lit("")))
    joined = packed.join(width, SHEET)
    if links is None:
        return joined.select(*SHEET, "row", pick("text").alias("values"), pick("shown").alias("shown"))
    none = F.create_map().cast(links.schema["links"].dataType)
    return joined.hint("merge").join(links.hint("merge"), [*SHEET, "row"], "left").select(
        *SHEET, "row", pick("text").alias("values"), pick("shown").alias("shown"), F.coalesce("links", none).alias("links")
    )


def table_truncation(cells: DataFrame, columns: DataFrame, max_records: int | None = None) -> DataFrame:
    """SHEET, blank_row, skipped_rows, first_skipped_row where rows with data follow the end of the table.

    What an explicit limit leaves out counts as skipped too.
    """
    _, rows = _table_rows(cells, columns)
    rows = written(rows, "table_rows")  # read four times; the cells move once
    after = F.col("row") > F.col("last_row") + (1 if max_records is None else 0)
    return (
        rows.join(table_extent(rows, max_records), SHEET).filter(after)
        .groupBy(*SHEET, (F.col("last_row") + 1).alias("blank_row"))
        .agg(F.count("*").alias("skipped_rows"), F.min("row").alias("first_skipped_row"))
    )


def exclude_pivot_sheets(sheets: DataFrame, relationships: DataFrame) -> DataFrame:
    """Sheets without a pivot-table relationship; relationships: SHEET keys and kind."""
    pivots = relationships.filter(F.lower("kind") == "pivottable").select("workbook", "sheet_key")
    return sheets.join(pivots, ["workbook", "sheet_key"], "left_anti")


def unreadable_sheets(sheets: DataFrame, cells: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Declared sheets whose part could not be parsed and that therefore delivered no cell."""
    return sheets.filter(~F.col(parsed)).join(cells.select("workbook", "sheet_key"), ["workbook", "sheet_key"], "left_anti")


def display_cells(cells: DataFrame, styles: DataFrame) -> DataFrame:
    """Adds ``shown``; styles: workbook, style, kind, date1904. The style table is small and joins by key."""
    joined = cells.join(styles.select("workbook", "style", "kind", "date1904"), ["workbook", "style"], "left")
    shown = display_value(
        F.coalesce("kind", F.lit("GENERAL")), F.col("text"), F.coalesce("numeric", F.lit(False)),
        F.coalesce("date1904", F.lit(False)),
    )
    return joined.withColumn("shown", shown).drop("kind", "date1904")


def link_ranges(links: DataFrame, relationships: DataFrame, max_cells: int | None = None) -> DataFrame:
    """SHEET, ord, row_from, row_to, col_from, col_to, target, internal, label of the links that can be followed.

    links: SHEET, ord, ref, location, rel_id, display; relationships: workbook, sheet_key, rel_id, target,
    external. A location wins over a relationship; without either, or with an unreadable reference, a link is none.
    With ``max_cells`` a larger range is reduced to the cell its reference starts with.
    """
    rels = relationships.select("workbook", "sheet_key", "rel_id", F.col("target").alias("rel_target"), "external")
    location = F.nullif(strip(F.col("location")), F.lit(""))
    start = F.split_part("ref", F.lit(":"), F.lit(1))
    one = F.struct(
        F.col("start.row").alias("row_from"), F.col("start.row").alias("row_to"),
        F.col("start.col").alias("col_from"), F.col("start.col").alias("col_to"),
    )
    covered = (F.col("a.row_to") - F.col("a.row_from") + 1).cast("long") * (F.col("a.col_to") - F.col("a.col_from") + 1)
    whole = F.coalesce(parse_range(F.col("ref")), one)
    return (
        links.join(rels.hint("merge"), ["workbook", "sheet_key", "rel_id"], "left")
        .withColumn("target", F.coalesce(location, F.col("rel_target")))
        .withColumn("internal", F.when(location.isNotNull(), True).otherwise(~F.col("external")))
        .withColumn("start", a1_parse(start))
        .filter(F.col("target").isNotNull() & F.col("start").isNotNull())
        .withColumn("a", whole)
        .withColumn("a", F.col("a") if max_cells is None else F.when(covered <= max_cells, F.col("a")).otherwise(one))
        .select(*SHEET, "ord", "a.*", "target", "internal", F.nullif(strip(F.col("display")), F.lit("")).alias("label"))
    )


def _on_level(slots: Column, level: int) -> Column:
    return F.transform(slots, lambda s: F.struct(F.lit(level).alias("level"), s.alias("slot")))


def _range_keys(low: Column, high: Column) -> Column:
    """array<struct<level,slot>>: the aligned stretches of 64^level rows that make up low..high, at most 126 of a level."""
    keys, end = [], high.cast("long") + 1
    lows = [F.ceil(low / 64**k).cast("long") for k in range(ROW_LEVELS + 1)]
    highs = [F.floor(end / 64**k).cast("long") for k in range(ROW_LEVELS + 1)]
    none = F.array().cast("array<bigint>")
    steps = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    for k in range(ROW_LEVELS):
        a, b, c, d = lows[k], highs[k], lows[k + 1] * 64, highs[k + 1] * 64
        inner = F.lit(k + 1 < ROW_LEVELS) & (c < d)  # what longer stretches cover is left to them
        slots = F.when(inner, F.concat(steps(a, c), steps(d, b))).otherwise(steps(a, b))
        keys.append(_on_level(slots, k))
    return F.concat(*keys)


def rows_in_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (SHEET, row) with each range (SHEET, row_from, row_to, ...) that holds them.

    A range is cut into aligned stretches of 1, 64, 4096, ... rows, a row asks for the stretch of each length around it; they
    meet by equality, exactly once. A range of a million rows is a few hundred keys, and small ranges side by side never
    meet each other's rows. Stretches are many more rows than their ranges' file lets Spark guess: they are never broadcast.
    """
    cut = ranges.withColumn("_k", F.explode(_range_keys(F.col("row_from"), F.col("row_to")))).select("*", "_k.*").drop("_k")
    around = F.array(*[
        F.struct(F.lit(k).alias("level"), F.floor(F.col("row") / 64**k).cast("long").alias("slot")) for k in range(ROW_LEVELS)
    ])
    asked = rows.select(*SHEET, "row", F.explode(around).alias("_k")).select(*SHEET, "row", "_k.*")
    return asked.hint("merge").join(cut.hint("merge"), [*SHEET, "level", "slot"]).drop("level", "slot")


def expand_links(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """SHEET, row, col, target, internal, label: the link of each given cell, the later one where links overlap.

    cells: SHEET, row, col; ranges as from :func:`link_ranges`. Ranges are never spelled out cell by cell.
    """
    at = cells.select(*SHEET, "row", "col").distinct()
    over = rows_in_ranges(at.select(*SHEET, "row").distinct(), ranges)
    inside = F.col("col").between(F.col("col_from"), F.col("col_to"))
    return (
        at.join(over, [*SHEET, "row"]).filter(inside).groupBy(*SHEET, "row", "col")
        .agg(F.max_by(F.struct("target", "internal", "label"), "ord").alias("l")).select(*SHEET, "row", "col", "l.*")
    )


def record_links(table: DataFrame, columns: DataFrame, ranges: DataFrame) -> DataFrame:
    """SHEET, row, links map<col, struct<target,internal,label>> of records with a link in any table column, blank cells too.

    The record's rows meet the ranges first; only rows under a range are paired with the columns of their sheet.
    """
    over = rows_in_ranges(table.select(*SHEET, "row").distinct(), ranges)
    inside = F.col("col").between(F.col("col_from"), F.col("col_to"))
    last = (
        over.join(columns.select(*SHEET, "col"), SHEET).filter(inside).groupBy(*SHEET, "row", "col")
        .agg(F.max_by(F.struct("target", "internal", "label"), "ord").alias("link"))
    )
    return last.groupBy(*SHEET, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "link"))).alias("links"))


def link_label(link: Column) -> Column:
    """What is shown for a link: its own display text, else where it leads."""
    return F.coalesce(link["label"], link["target"])


def link_is_openable(link: Column) -> Column:
    """A web or mail address, or any place inside the workbook."""
    web = F.rlike(link["target"], F.lit(r"(?i)^(https?://|mailto:)"))
    return F.when(link["internal"], strip(link["target"]) != "").otherwise(web)


def internal_target(link: Column) -> Column:
    """struct<sheet,cell> of an internal link that names a sheet; null for outside links, bare cells and defined names."""
    text = strip(link["target"])
    at = lambda group: strip(F.regexp_extract(text, r"(?s)^#?(.+)!([^!]+)$", group))
    sheet = F.regexp_replace(at(1), r"(?s)^'(.*)'$", "$1")
    return F.when(link["internal"] & (sheet != "") & (at(2) != ""), F.struct(sheet.alias("sheet"), at(2).alias("cell")))


def window_cells(cells: DataFrame, targets: DataFrame, context: int = CONTEXT_ROWS) -> DataFrame:
    """Cells within ``context`` rows of each target, joined by equality on the row, not by a range.

    The size that Spark guesses for ``around`` is that of the file under it, so a hint keeps it from being broadcast.
    """
    around = targets.withColumn(
        "row", F.explode(F.sequence(F.greatest(F.col("target_row") - context, F.lit(0)), F.col("target_row") + context))
    )
    return around.hint("merge").join(cells.select(*SHEET, "row", "col", "text"), [*SHEET, "row"])


def cell_window(
    cells: DataFrame, targets: DataFrame, context: int = CONTEXT_ROWS, max_cols: int = MAX_WINDOW_COLUMNS
) -> DataFrame:
    """The cells shown around each target: its rows, and the used columns nearest to it.

    targets: target_id, SHEET, target_row, target_col. A window never sees more than 2*context+1 rows of 512.
    """
    near = window_cells(cells, targets, context)
    chosen = _window_columns(near, targets).filter(F.col("distance_rank") <= max_cols).select("target_id", "col")
    return near.hint("merge").join(chosen, ["target_id", "col"]).select("target_id", "target_row", "target_col", *SHEET, "row", "col", "text")


def _window_columns(near: DataFrame, targets: DataFrame) -> DataFrame:
    used = near.select("target_id", "target_col", "col").unionByName(
        targets.select("target_id", "target_col", F.col("target_col").alias("col"))
    ).distinct()
    nearest = W.partitionBy("target_id").orderBy(F.abs(F.col("col") - F.col("target_col")), "col")
    return used.withColumn("distance_rank", F.row_number().over(nearest))


def window_summary(
    cells: DataFrame, targets: DataFrame, headers: DataFrame, context: int = CONTEXT_ROWS,
    max_cols: int = MAX_WINDOW_COLUMNS,
) -> DataFrame:
    """Per target: row span, visible rows, shown and hidden columns, and whether the header is repeated above."""
    near = window_cells(cells, targets, context)
    columns = _window_columns(near, targets).groupBy("target_id").agg(F.count("*").alias("used"))
    rows = near.select("target_id", "row").unionByName(
        targets.select("target_id", F.col("target_row").alias("row"))
    ).groupBy("target_id").agg(F.count_distinct("row").alias("rows"))
    last = cells.groupBy(*SHEET).agg(F.max("row").alias("max_row"))
    first_row = F.greatest(F.col("target_row") - context, F.lit(0))
    last_row = F.greatest(F.col("target_row"), F.least(F.coalesce("max_row", "target_row"), F.col("target_row") + context))
    return (
        targets.hint("merge").join(columns, "target_id").join(rows.hint("merge"), "target_id").join(last, SHEET, "left")
        .join(headers.select(*SHEET, "header_row"), SHEET, "left")
        .select(
            "target_id", first_row.alias("first_row"), last_row.alias("last_row"), "rows",
            F.least("used", F.lit(max_cols)).alias("columns"),
            F.greatest(F.col("used") - max_cols, F.lit(0)).alias("hidden"),
            F.coalesce(~F.col("header_row").between(first_row, last_row), F.lit(False)).alias("header_above"),
        )
    )


def window_headers(window: DataFrame, columns: DataFrame) -> DataFrame:
    """Labels of the shown columns: target_id, col, letter, name."""
    shown = window.select("target_id", *SHEET, "col").distinct()
    labels = columns.filter(F.col("name") != "").select(*SHEET, "col", "name")
    return shown.join(labels, [*SHEET, "col"]).select("target_id", "col", column_letter(F.col("col")).alias("letter"), "name")


def record_locations(table: DataFrame, columns: DataFrame) -> DataFrame:
    """SHEET, row, cell: a record is found at the first column of its table."""
    anchor = columns.groupBy(*SHEET).agg(F.min("col").alias("col"))
    return table.select(*SHEET, "row").distinct().join(anchor, SHEET).withColumn("cell", a1_format(F.col("row"), F.col("col")))
