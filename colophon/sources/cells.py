"""Reading worksheet cells in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colophon.functions.text import strip

CELLS_DDL = (
    "workbook string, sheet string, sheet_key string, row int, col int, text string, style int, numeric boolean"
)
SHEET = ["workbook", "sheet_key", "sheet"]


def clean_cells(raw: DataFrame, max_rows: int | None = None, max_cols: int | None = None) -> DataFrame:
    """Stripped, non-empty cells; a missing sheet key falls back on the name. Only a given limit cuts a sheet."""
    inside = (F.col("row") >= 0) & (F.col("col") >= 0)
    for name, limit in (("row", max_rows), ("col", max_cols)):
        inside = inside if limit is None else inside & (F.col(name) < limit)
    return (
        raw.filter(inside)
        .withColumn("text", strip(F.col("text")))
        .filter(F.col("text") != "")
        .withColumn("sheet_key", sheet_key("sheet_key", "sheet"))
    )


def sheet_key(path: str, name: str):
    return F.coalesce(F.nullif(F.col(path), F.lit("")), F.concat(F.lit("name:"), F.col(name)))


def read_cells(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Cells from parquet, csv, json or orc with the fixed schema, so filters and columns reach the scan."""
    return clean_cells(spark.read.schema(CELLS_DDL).options(**options).format(fmt).load(path))
