"""A1 references as columns: ``$B$7`` <-> (row 6, col 1), zero based."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colophon.functions.text import strip

REF_PATTERN, MAX_ROW = r"^([A-Z]{1,3})(\d+)$", 2**31  # rows are whole numbers of 32 bits, as in the reference


def _clean(ref: Column) -> Column:
    return F.upper(F.regexp_replace(strip(ref), r"\$", ""))


def column_number(letters: Column) -> Column:
    """Bijective base 26, zero based; letters is upper case and not empty."""
    return F.aggregate(
        F.split(letters, ""),
        F.lit(0),
        lambda acc, ch: F.when(ch == "", acc).otherwise(acc * 26 + F.ascii(ch) - F.lit(64)),
    ) - 1


def column_letter(col: Column) -> Column:
    """Letters of a zero-based column up to three letters; ``?`` below zero."""
    digit = lambda n: F.chr((n % 26 + 65).cast("long"))
    second = F.floor(col / 26) - 1
    third = F.floor((col - 702) / 676)
    return (
        F.when(col < 0, F.lit("?"))
        .when(col < 26, digit(col))
        .when(col < 702, F.concat(digit(second), digit(col)))
        .otherwise(F.concat(digit(third), digit(F.floor((col - 702) / 26)), digit(col)))
    )


def a1_parse(ref: Column) -> Column:
    """struct<row,col>, or null when the text is not a cell reference."""
    text = _clean(ref)
    row = F.regexp_extract(text, REF_PATTERN, 2).try_cast("long")
    return F.when(
        row.between(1, MAX_ROW),
        F.struct(
            (row - 1).cast("int").alias("row"),
            column_number(F.regexp_extract(text, REF_PATTERN, 1)).cast("int").alias("col"),
        ),
    )


def a1_format(row: Column, col: Column) -> Column:
    return F.concat(column_letter(col), (row + 1).cast("string"))


def parse_range(ref: Column) -> Column:
    """``A1:Z50`` in any corner order as struct<row_from,row_to,col_from,col_to>; one cell is a range."""
    a = a1_parse(F.split_part(ref, F.lit(":"), F.lit(1)))
    second = F.split_part(ref, F.lit(":"), F.lit(2))
    b = F.when(second == "", a).otherwise(a1_parse(second))
    return F.when(
        a.isNotNull() & b.isNotNull(),
        F.struct(
            F.least(a["row"], b["row"]).alias("row_from"),
            F.greatest(a["row"], b["row"]).alias("row_to"),
            F.least(a["col"], b["col"]).alias("col_from"),
            F.greatest(a["col"], b["col"]).alias("col_to"),
        ),
    )


def range_bounds(ref: str) -> tuple[int, int, int, int]:
    """Bounds of a literal range, so the filter is a pushed-down BETWEEN on plain columns."""
    import re

    def cell(text: str) -> tuple[int, int]:
        m = re.fullmatch(r"([A-Z]{1,3})([1-9]\d{0,6})", text.strip().upper().replace("$", ""))
        if not m:
            raise ValueError(f"not a cell reference: {text!r}")
        col = 0
        for ch in m.group(1):
            col = col * 26 + ord(ch) - 64
        return int(m.group(2)) - 1, col - 1

    first, _, second = ref.partition(":")
    (r1, c1), (r2, c2) = cell(first), cell(second or first)
    return min(r1, r2), max(r1, r2), min(c1, c2), max(c1, c2)


def range_filter(df, ref: str, row: str = "row", col: str = "col"):
    """Rows whose cell lies inside the range, both corners included."""
    r1, r2, c1, c2 = range_bounds(ref)
    return df.filter(F.col(row).between(r1, r2) & F.col(col).between(c1, c2))
