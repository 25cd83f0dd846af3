"""Image manifests and the names exported files get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colophon.functions.text import strip
from colophon.operators.numbering import free_numbers, place_in_group, written

# The columns of the manifest and the longest file name.
MANIFEST = [
    "exported_file", "media_file", "format", "bytes", "width", "height", "status", "worksheet", "cell", "title", "author",
    "circle",
]
MAX_NAME = 120


def safe_file_name(c: Column, fallback: str = "image") -> Column:
    """Last path step without control or reserved characters or climbing dots, at most 120 characters."""
    base = F.regexp_replace(F.regexp_replace(c, r"^[\s\S]*/", ""), r"^[\s\S]*\\", "")
    clean = F.regexp_replace(strip(F.regexp_replace(base, r'[\x00-\x1f/\\:*?"<>|]', "_")), r"^\.+", "")
    name = F.coalesce(F.nullif(F.replace(clean, F.lit(".."), F.lit("_")), F.lit("")), F.lit(fallback))
    name = F.when(strip(name) == "", F.lit(fallback)).otherwise(name)
    suffix = F.regexp_extract(name, r"^[\s\S]+(\.[^.]{0,7})$", 1)
    return F.when(F.length(name) <= MAX_NAME, name).otherwise(
        F.concat(F.substr(name, F.lit(1), F.lit(MAX_NAME) - F.length(suffix)), suffix)
    )


def export_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds ``exported_file``: safe names, ``stem (n).ext`` from the second occurrence on.

    ``order`` is the arrival number. Numbers that some given name already spells out are passed over. Places and free numbers
    are found by ranges, so a name that a third of all files share is spread over tasks.
    """
    named = written(df.withColumn("safe", safe_file_name(F.col(name))), "names")  # read by every step below
    numbered = place_in_group(named, ["safe"], order, "_at")
    parts, spelled = r"^([\s\S]+?)(\.[^.]*)?$", r"^([\s\S]*) \(([1-9]\d{0,8})\)(\.[^.]*)?$"
    part = lambda group: F.regexp_extract("safe", spelled, group)
    taken = numbered.select(F.concat(part(1), part(3)).alias("safe"), part(2).try_cast("long").alias("number")).filter("number IS NOT NULL")
    later = numbered.filter("_at > 1").withColumn("_nth", F.col("_at") - 1)
    stem, suffix = F.regexp_extract("safe", parts, 1), F.regexp_extract("safe", parts, 2)
    renamed = F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), suffix)
    more = free_numbers(later, taken, "safe", "_nth", "_n").withColumn("exported_file", renamed)
    first = numbered.filter("_at = 1").withColumn("exported_file", F.col("safe"))
    return first.select(*df.columns, "exported_file").unionByName(more.select(*df.columns, "exported_file"))


def image_manifest(images: DataFrame, hits: DataFrame) -> DataFrame:
    """The twelve text columns of the manifest; of several catalogue hits the first one is named.

    images: key, exported_file, file_name, format, size_bytes, width, height, state, sheet, cell;
    hits: key, pos, title, author, circle.
    """
    first = hits.groupBy("key").agg(F.min_by(F.struct("title", "author", "circle"), "pos").alias("hit"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    size = F.when(F.col("size_bytes") >= 0, F.col("size_bytes"))
    columns = [
        F.col("exported_file"), F.col("file_name"), F.col("format"), size, F.col("width"), F.col("height"), F.lower("state"),
        F.col("sheet"), F.col("cell"), F.col("hit.title"), F.col("hit.author"), F.col("hit.circle"),
    ]
    return images.join(first, "key", "left").select(*[text(c).alias(n) for n, c in zip(MANIFEST, columns)])


def write_image_manifest(manifest: DataFrame, path: str) -> None:
    """CSV with a header, doubled quotes and CRLF line ends."""
    (
        manifest.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
        .option("lineSep", "\r\n").option("emptyValue", "").csv(path)
    )
