"""Reading, migrating and writing library snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colophon.functions.text import strip
from colophon.operators.library import Library
from colophon.operators.numbering import place_in_group

_MATCH = "struct<cell string, cosine double, percent double, source string, thumb string>"
_RECORD = f"struct<id string, name string, createdAt double, scanThumb string, matches array<{_MATCH}>>"
_FOLDER = "struct<id string, name string, kind string, reserved string, createdAt double>"
_SESSION = "struct<id string, folderId string, kind string, title string, query string, createdAt double>"
_ITEM = (
    "struct<id string, kind string, title string, url string, domain string, provider string, cell string, "
    "createdAt double, fingerprint string>"
)
_ENTRY = "struct<sessionId string, itemId string, position double, addedAt double>"
_MEMBER = "struct<itemId string, folderId string, collectionId string, addedAt double>"
SNAPSHOT_DDL = (
    f"version double, legacy array<{_RECORD}>, records array<{_RECORD}>, folders array<{_FOLDER}>, "
    f"collections array<{_FOLDER}>, sessions array<{_SESSION}>, items array<{_ITEM}>, entries array<{_ENTRY}>, "
    f"memberships array<{_MEMBER}>"
)
# Accepted kinds; anything else becomes the first one.
ITEM_KINDS = ["ONLINE_RESULT", "WORKBOOK_MATCH", "MANUAL_BOOKMARK"]
SESSION_KINDS = ["OFFLINE_MATCH", "ONLINE_SEARCH", "RESULT_PROFILE"]
TABLES = ["folders", "sessions", "items", "entries", "memberships"]


def _one_of(c: str, names: list[str]):
    return F.when(F.col(c).isin(names), F.col(c)).otherwise(names[0])


def _time(c: str):
    return F.coalesce(F.col(c).cast("long"), F.lit(0))


def _rows(snapshots: DataFrame, field: str, key: list[str]) -> DataFrame:
    return snapshots.select(*key, F.explode(field).alias("r")).select(*key, "r.*")


def _folders(rows: DataFrame, key: list[str]) -> DataFrame:
    reserved = F.when(F.col("reserved") == "BOOKMARKS", F.col("reserved"))
    kind = F.when(F.col("kind").isin("RESERVED", "PROFILE"), F.col("kind")).when(reserved.isNotNull(), "RESERVED").otherwise("PROFILE")
    return rows.filter("id IS NOT NULL").select(
        *key, "id", F.coalesce("name", F.lit("")).alias("name"), kind.alias("kind"), reserved.alias("reserved"), _time("createdAt").alias("created_at")
    )


def _items(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.filter("id IS NOT NULL AND title IS NOT NULL").select(
        *key, "id", _one_of("kind", ITEM_KINDS).alias("kind"), "title", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
        "url", "domain", "provider", "cell", _time("createdAt").alias("created_at"),
    )


def _memberships(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.select(
        *key, F.col("itemId").alias("item_id"), F.coalesce("folderId", "collectionId").alias("folder_id"), _time("addedAt").alias("added_at")
    ).filter("item_id IS NOT NULL AND folder_id IS NOT NULL")


def decode_library(snapshots: DataFrame, key: str | None = None) -> Library:
    """Five tables of current snapshots; rows that are not usable are dropped one by one.

    ``key`` names the column that tells libraries apart: every table carries it, and rows refer to each other inside their own
    library only, whatever ids others use. Without it all snapshots are one library.
    """
    own = [key] if key else []
    folders, items = _folders(_rows(snapshots, "folders", own), own), _items(_rows(snapshots, "items", own), own)
    sessions = _rows(snapshots, "sessions", own).filter("id IS NOT NULL").select(
        *own, "id", F.col("folderId").alias("folder_id"), _one_of("kind", SESSION_KINDS).alias("kind"),
        F.coalesce("title", F.lit("Session")).alias("title"), "query", _time("createdAt").alias("created_at"),
    )
    entries = _rows(snapshots, "entries", own).select(
        *own, F.col("sessionId").alias("session_id"), F.col("itemId").alias("item_id"),
        F.coalesce(F.col("position").cast("int"), F.lit(0)).alias("position"), _time("addedAt").alias("added_at"),
    )
    named = lambda df, c: df.select(*own, F.col("id").alias(c))
    entries = entries.join(named(sessions, "session_id"), [*own, "session_id"], "left_semi").join(
        named(items, "item_id"), [*own, "item_id"], "left_semi"
    ).select(*own, "session_id", "item_id", "position", "added_at")
    members = _memberships(_rows(snapshots, "memberships", own), own).join(named(folders, "folder_id"), [*own, "folder_id"], "left_semi")
    return Library(folders, sessions, items, entries, members.select(*own, "item_id", "folder_id", "added_at"))


def one_library(library: Library, key: str, value: object) -> Library:
    """The tables of one library of many, without the key: what the operations on a library take."""
    pick = lambda df: df.filter(F.col(key) == F.lit(value)).drop(key)
    return Library(*[pick(getattr(library, name)) for name in TABLES])


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots with ``library``, the file each comes from."""
    rows = spark.read.schema(SNAPSHOT_DDL).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("library", F.input_file_name())


def read_library(spark: SparkSession, path: str) -> Library:
    """The library of one snapshot file."""
    return decode_library(read_snapshots(spark, path))


def read_libraries(spark: SparkSession, path: str) -> Library:
    """The libraries of all snapshot files under a path, told apart by ``library``."""
    return decode_library(read_snapshots(spark, path), "library")


def write_library(library: Library, path: str) -> None:
    """Every table once; the whole snapshot replaces the previous one."""
    for name in TABLES:
        getattr(library, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_library(spark: SparkSession, path: str) -> Library:
    return Library(*[spark.read.parquet(f"{path}/{name}") for name in TABLES])


def migrate_library_v1(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sessions, items, entries of legacy records (id, name, created_at, seq, matches array).

    Every record is a session, every match an item at its position. Of records with one id the first counts.
    """
    carried = ["name", "created_at", "seq", "matches"]
    first = records.groupBy("id").agg(F.min_by(F.struct(*carried), "seq").alias("r")).select("id", "r.*")
    title = F.when(strip(F.coalesce("name", F.lit(""))) != "", F.col("name")).otherwise(
        F.concat(F.lit("#"), (F.col("seq") + 1).cast("string"))
    )
    text = F.lit(None).cast("string")
    sessions = first.select(
        "id", text.alias("folder_id"), F.lit("OFFLINE_MATCH").alias("kind"), title.alias("title"), text.alias("query"), "created_at"
    )
    matches = first.select("id", "created_at", F.posexplode("matches").alias("at", "m")).filter("m.cell IS NOT NULL")
    item_id = F.concat_ws("_", F.lit("itm"), "id", "at")
    items = matches.select(
        item_id.alias("id"), F.lit("WORKBOOK_MATCH").alias("kind"), F.col("m.cell").alias("title"),
        F.concat_ws(":", F.lit("wb"), "id", F.upper(strip(F.col("m.cell"))), "at").alias("fingerprint"),
        text.alias("url"), text.alias("domain"), text.alias("provider"), F.col("m.cell").alias("cell"), "created_at",
    )
    entries = matches.select(F.col("id").alias("session_id"), item_id.alias("item_id"), F.col("at").alias("position"), F.col("created_at").alias("added_at"))
    return sessions, items, entries


def migrate_library_v2(library: Library, legacy: DataFrame) -> Library:
    """Workbook items that were direct members of a folder become entries of a session.

    A folder that a legacy record (id, name, created_at) names gets that record's session; every other folder
    gets one "Imported scan". Positions follow the time of adding.
    """
    workbook = library.items.filter("kind = 'WORKBOOK_MATCH'").select(F.col("id").alias("item_id"))
    folders = library.folders.select(F.col("id").alias("folder_id"))
    placed = library.memberships.join(workbook, "item_id", "left_semi").join(folders, "folder_id", "left_semi")
    records = legacy.select(F.col("id").alias("folder_id"), "name", "created_at")
    known = records.join(folders.withColumn("known", F.lit(True)), "folder_id", "left")
    text = F.lit(None).cast("string")
    named = known.select(
        F.col("folder_id").alias("id"), F.when(F.col("known"), F.col("folder_id")).alias("folder_id"),
        F.lit("OFFLINE_MATCH").alias("kind"),
        F.when(strip(F.coalesce("name", F.lit(""))) != "", F.col("name")).otherwise("Scan").alias("title"),
        text.alias("query"), "created_at",
    )
    rest = placed.join(records.select("folder_id"), "folder_id", "left_anti")
    imported_id = F.concat(F.lit("ses_"), F.substring(F.sha2("folder_id", 256), 1, 16))
    imported = rest.groupBy("folder_id").agg(F.min("added_at").alias("created_at")).select(
        imported_id.alias("id"), "folder_id", F.lit("OFFLINE_MATCH").alias("kind"), F.lit("Imported scan").alias("title"),
        text.alias("query"), "created_at",
    )
    numbered = place_in_group(placed, ["folder_id"], "added_at", "_place", ["item_id"]).withColumn("position", (F.col("_place") - 1).cast("int"))
    entries = numbered.join(records.select("folder_id", "created_at"), "folder_id", "left").select(
        F.when(F.col("created_at").isNotNull(), F.col("folder_id")).otherwise(imported_id).alias("session_id"), "item_id",
        "position", F.coalesce("created_at", "added_at").alias("added_at"),
    )
    members = library.memberships.join(placed.select("item_id", "folder_id"), ["item_id", "folder_id"], "left_anti")
    columns = library.sessions.columns
    return Library(
        library.folders, library.sessions.unionByName(named.select(*columns)).unionByName(imported.select(*columns)),
        library.items, library.entries.unionByName(entries.select(*library.entries.columns)),
        members.select(*library.memberships.columns),
    )
