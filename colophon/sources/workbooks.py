"""The registry of imported workbook files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from colophon.functions.text import strip

SUPPORTED = ["xlsx", "xlsm"]  # fixed value: accepted file extensions


FILE = "path string, modificationTime timestamp, length long, content binary"
REGISTRY = "batch long, path string, name string, format string, size long, sha256 string, outcome string, imported_at long"


def _facts(files: DataFrame) -> DataFrame:
    return files.select(
        "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"),
        (F.hex(F.substring("content", 1, 2)) == "504B").alias("zip_magic"),
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256, zip_magic of stored files; the bytes stay inside the scan's own projection."""
    return _facts(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def read_registry(spark: SparkSession, registry: str) -> DataFrame:
    """All outcomes so far, one row per offered file (``REGISTRY``); a registry that does not exist yet is empty."""
    try:
        return spark.read.schema(REGISTRY).parquet(registry)
    except AnalysisException:
        return spark.createDataFrame([], REGISTRY)


def import_workbooks(spark: SparkSession, folder: str, registry: str, checkpoint: str, at: int, files_per_batch: int = 10_000) -> DataFrame:
    """Register the files of a folder that no earlier pass has seen; returns the registry.

    A file stream remembers which files it has read, so a pass costs what is new. Each batch is judged against the contents
    registered by earlier batches and written as a partition of its own: a batch that is run again after a failure replaces
    what it wrote and never finds itself. Two batches of one pass follow each other, so a content is registered once. A file of
    no bytes has no row in Spark's file readers and gets none here.
    """

    def judge(files: DataFrame, batch: int) -> None:
        known = read_registry(spark, registry).filter((F.col("batch") < batch) & (F.col("outcome") == "ADDED"))
        rows = register_workbooks(_facts(files), known.select("sha256"), at)
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(registry)

    stream = (
        spark.readStream.schema(FILE).format("binaryFile").option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(folder)
    )
    run = stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return read_registry(spark, registry)


def register_workbooks(files: DataFrame, registry: DataFrame, at: int) -> DataFrame:
    """path, name, format, size, sha256, outcome of every offered file.

    outcome is ADDED, ALREADY_SAVED or the reason it is refused. Of several new files with the same content the
    first path is added. registry: sha256.
    """
    name = strip(F.regexp_extract("path", r"([^/\\]*)$", 1))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]*)$", 1))
    reason = (
        F.when(~suffix.isin(SUPPORTED), "UNSUPPORTED").when(F.col("size") <= 0, "EMPTY")
        .when((F.col("size") < 4) | ~F.col("zip_magic"), "NOT_A_WORKBOOK")
    )
    saved = registry.select("sha256").distinct().withColumn("saved", F.lit(True))
    judged = files.withColumn("name", name).withColumn("format", suffix).withColumn("reason", reason)
    judged = judged.join(saved, "sha256", "left")
    fresh = F.col("reason").isNull() & F.col("saved").isNull()
    first = judged.filter(fresh).groupBy("sha256").agg(F.min("path").alias("first_path"))
    outcome = F.coalesce(
        "reason", F.when(F.col("saved") | (F.col("path") != F.col("first_path")), F.lit("ALREADY_SAVED")), F.lit("ADDED")
    )
    return judged.join(first, "sha256", "left").select(
        "path", "name", "format", "size", "sha256", outcome.alias("outcome"), F.lit(at).cast("long").alias("imported_at")
    )


def list_workbooks(registry: DataFrame) -> DataFrame:
    """Pinned first, then last opened, last imported, id."""
    return registry.orderBy(
        F.desc("pinned"), F.desc(F.coalesce("last_opened", F.lit(0))), F.desc("imported_at"), F.asc("id")
    )


def total_bytes(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("workbooks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def recent(entries: DataFrame, keep: int, key: str = "cache_key", used: str = "last_used") -> DataFrame:
    """The ``keep`` most recently used keys, newest first."""
    return entries.groupBy(key).agg(F.max(used).alias(used)).orderBy(F.desc(used), F.asc(key)).limit(keep)
