"""A library of folders, sessions and saved items as set-based table operations.

Tables: folders(id, name, kind, reserved, created_at), sessions(id, folder_id, kind, title, query, created_at),
items(id, kind, title, fingerprint, ...), entries(session_id, item_id, position, added_at) and
memberships(item_id, folder_id, added_at). An operation takes a table of requests, returns the new versions of
the tables it changes, and a one-row report (requested, changed, skipped, failed). Everything is semi-, anti- and
equi-joins on ids.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from colophon.functions.text import contains_ci, strip
from colophon.functions.urls import item_fingerprint, url_domain
from colophon.operators.numbering import free_numbers, place_in_group, place_in_order, ranked

WORKBOOK, RESERVED, PROFILE = "WORKBOOK_MATCH", "RESERVED", "PROFILE"
# Default session titles.
SESSION_TITLES = {"OFFLINE_MATCH": "Scan #", "ONLINE_SEARCH": "Search #", "RESULT_PROFILE": "Result profile #"}
DASH = "—"


@dataclass(frozen=True)
class Library:
    folders: DataFrame
    sessions: DataFrame
    items: DataFrame
    entries: DataFrame
    memberships: DataFrame


def new_id(prefix: str, *parts: Column) -> Column:
    """Reproducible id of a new row, so a retried task writes the same one."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x01", *parts), 256), 1, 24))


def report(outcomes: DataFrame) -> DataFrame:
    """requested, changed, skipped, failed from one row per request with its outcome."""
    return outcomes.agg(
        F.count("*").alias("requested"),
        *[F.count_if(F.col("outcome") == o.upper()).alias(o) for o in ("changed", "skipped", "failed")],
    )


def validate_drafts(drafts: DataFrame, direct: bool = True) -> DataFrame:
    """Adds fingerprint and reason (null = valid). ``direct`` drafts may not be workbook matches.

    drafts: kind, title, url, provider_key, cell.
    """
    title, url = F.coalesce(strip(F.col("title")), F.lit("")), F.coalesce(strip(F.col("url")), F.lit(""))
    manual = F.col("kind") == "MANUAL_BOOKMARK"
    reason = (
        F.when(title == "", "NO_TITLE").when(manual & (url == ""), "NO_URL")
        .when(manual & ~F.rlike(url, F.lit("(?i)^https://")), "NOT_HTTPS")
        .when(manual & url_domain(url).isNull(), "BAD_URL")
        .when(F.lit(direct) & (F.col("kind") == WORKBOOK), "WORKBOOK_MATCH")
    )
    return drafts.withColumn("reason", reason).withColumn(
        "fingerprint", item_fingerprint(*[F.col(c) for c in ("provider_key", "url", "cell", "title")])
    )


def _materialise(drafts: DataFrame, items: DataFrame) -> DataFrame:
    """Rows for drafts whose fingerprint is not saved yet, in the shape of items."""
    fresh = drafts.join(items.select("fingerprint"), "fingerprint", "left_anti")
    first = fresh.groupBy("fingerprint").agg(F.min_by(F.struct("kind", "title", "url", "provider", "cell", "added_at"), "pos").alias("d"))
    rows = first.select(
        new_id("itm", F.col("fingerprint")).alias("id"), "d.kind", strip(F.col("d.title")).alias("title"), "fingerprint",
        "d.url", url_domain(F.col("d.url")).alias("domain"), "d.provider", "d.cell", F.col("d.added_at").alias("created_at"),
    )
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in items.schema if f.name not in rows.columns]
    return rows.select("*", *missing).select(*items.columns)


def _known(drafts: DataFrame, items: DataFrame) -> DataFrame:
    return drafts.join(items.select("fingerprint", F.col("id").alias("item_id")), "fingerprint")


def add_items(library: Library, drafts: DataFrame, reserved: bool = False) -> tuple[Library, DataFrame]:
    """Save validated drafts (pos, folder_id, added_at, ...) to their folders; saved items are reused.

    Returns the library and per folder added and already_there. Bookmarks take drafts with ``reserved``.
    """
    allowed = library.folders.filter((F.col("kind") == RESERVED) == reserved).select(F.col("id").alias("folder_id"))
    valid = drafts.filter("reason IS NULL").join(allowed, "folder_id", "left_semi")
    items = library.items.unionByName(_materialise(valid, library.items))
    once = valid.groupBy("folder_id", "fingerprint").agg(
        F.min("pos").alias("pos"), F.min("added_at").alias("added_at"), F.count("*").alias("asked")
    )
    wanted = _known(once, items)
    there = library.memberships.select("item_id", "folder_id", F.lit(True).alias("there"))
    marked = wanted.join(there, ["item_id", "folder_id"], "left")
    inserts = marked.filter("there IS NULL").select("item_id", "folder_id", "added_at")
    counts = marked.groupBy("folder_id").agg(
        F.count_if(F.col("there").isNull()).alias("added"),
        F.sum(F.col("asked") - F.when(F.col("there").isNull(), 1).otherwise(0)).alias("already_there"),
    )
    return replace(library, items=items, memberships=library.memberships.unionByName(inserts)), counts


def save_sessions(library: Library, sessions: DataFrame, results: DataFrame) -> tuple[Library, DataFrame]:
    """Save sessions with their results; the position of an entry is its index in the request.

    sessions: id, folder_id, kind, title, query, created_at, seq; results: validated drafts with session_id and pos.
    Sessions without results or for a reserved folder are refused; a fingerprint counts once per session.
    """
    ordinary = library.folders.filter(F.col("kind") != RESERVED).select(F.col("id").alias("folder_id"))
    valid = results.filter("reason IS NULL")
    filled = valid.select(F.col("session_id").alias("id")).distinct()
    accepted = sessions.join(ordinary, "folder_id", "left_semi").join(filled, "id", "left_semi")
    valid = valid.join(accepted.select(F.col("id").alias("session_id"), "created_at"), "session_id")
    valid = valid.withColumn("added_at", F.col("created_at"))
    items = library.items.unionByName(_materialise(valid, library.items))
    once = valid.groupBy("session_id", "fingerprint").agg(
        F.min("pos").alias("position"), F.min("added_at").alias("added_at"), F.count("*").alias("asked")
    )
    entries = _known(once, items).select("session_id", "item_id", F.col("position").cast("int").alias("position"), "added_at")
    before = library.sessions.groupBy("folder_id").agg(F.count("*").alias("before"))
    numbered = place_in_group(accepted, ["folder_id"], "seq", "nth").join(before, "folder_id", "left")
    prefix = F.when(F.lit(False), "")
    for kind, text in SESSION_TITLES.items():
        prefix = prefix.when(F.col("kind") == kind, text)
    number = F.coalesce("before", F.lit(0)) + F.col("nth")
    titled = numbered.withColumn("title", F.coalesce(F.nullif(strip(F.col("title")), F.lit("")), F.concat(prefix, number.cast("string"))))
    rows = titled.withColumn("query", F.nullif(strip(F.col("query")), F.lit(""))).select(*library.sessions.columns)
    counts = once.groupBy("session_id").agg(F.count("*").alias("added"), F.sum(F.col("asked") - 1).alias("already_there"))
    saved = replace(library, sessions=library.sessions.unionByName(rows), items=items, entries=library.entries.unionByName(entries))
    return saved, counts


def create_folders(library: Library, requests: DataFrame, at: int) -> tuple[Library, DataFrame]:
    """New ordinary folders, one per request (seq, name), in the order of ``seq``; a blank name becomes ``#n``, n counting
    ordinary folders. Returns the library and the report."""
    numbered = ranked(requests.select("seq", "name"), ["seq", "name"], "nth")
    ordinary = library.folders.agg(F.count_if(F.col("kind") == PROFILE).alias("before")).withColumn("one", F.lit(1))
    named = numbered.withColumn("one", F.lit(1)).join(F.broadcast(ordinary), "one").withColumn(
        "name", F.coalesce(F.nullif(strip(F.col("name")), F.lit("")), F.concat(F.lit("#"), (F.col("before") + F.col("nth")).cast("string")))
    )
    rows = named.select(
        new_id("fld", F.lit("new"), F.col("nth").cast("string"), F.col("name"), F.lit(str(at))).alias("id"), "name", F.lit(PROFILE).alias("kind"),
        F.lit(None).cast("string").alias("reserved"), F.lit(at).cast("long").alias("created_at"),
    )
    outcome = report(requests.withColumn("outcome", F.lit("CHANGED")))
    return replace(library, folders=library.folders.unionByName(rows.select(*library.folders.columns))), outcome


def _renamed(table: DataFrame, requests: DataFrame, key: str, column: str, allowed: Column) -> tuple[DataFrame, DataFrame]:
    """``table`` with the last non-blank name asked for each allowed id, and the report over the requests."""
    asked = requests.select(F.col(key).alias("id"), "seq", F.nullif(strip(F.col("name")), F.lit("")).alias("asked"))
    known = table.select("id", allowed.alias("allowed"))
    judged = asked.join(known, "id", "left").withColumn("outcome", F.when(F.coalesce("allowed", F.lit(False)), "CHANGED").otherwise("SKIPPED"))
    last = judged.filter("outcome = 'CHANGED' AND asked IS NOT NULL").groupBy("id").agg(F.max_by("asked", "seq").alias("asked"))
    changed = table.join(last, "id", "left").withColumn(column, F.coalesce("asked", column)).select(*table.columns)
    return changed, report(judged)


def rename_folders(library: Library, requests: DataFrame) -> tuple[Library, DataFrame]:
    """New names of ordinary folders (folder_id, name, seq), later requests last; a blank name keeps the old one."""
    folders, outcome = _renamed(library.folders, requests, "folder_id", "name", F.col("kind") != RESERVED)
    return replace(library, folders=folders), outcome


def rename_sessions(library: Library, requests: DataFrame) -> tuple[Library, DataFrame]:
    """New titles of sessions (session_id, name, seq), later requests last; a blank name keeps the old one."""
    sessions, outcome = _renamed(library.sessions, requests, "session_id", "title", F.lit(True))
    return replace(library, sessions=sessions), outcome


def with_bookmarks(library: Library, at: int) -> Library:
    """The library with its reserved folder, added where it is missing."""
    missing = library.folders.agg(F.count_if(F.col("reserved") == "BOOKMARKS").alias("n")).filter("n = 0").select(
        new_id("fld", F.lit("BOOKMARKS")).alias("id"), F.lit("Bookmarks").alias("name"), F.lit(RESERVED).alias("kind"),
        F.lit("BOOKMARKS").alias("reserved"), F.lit(at).cast("long").alias("created_at"),
    )
    return replace(library, folders=library.folders.unionByName(missing.select(*library.folders.columns)))


def bookmark_items(library: Library, item_ids: DataFrame, at: int) -> tuple[Library, DataFrame]:
    """Add saved items to the reserved folder; unknown ids, workbook matches and bookmarked items are skipped."""
    library = with_bookmarks(library, at)
    reserved = library.folders.filter(F.col("reserved") == "BOOKMARKS").agg(F.min("id").alias("folder_id"))  # one row
    there = bookmarked(library).select("item_id").distinct().withColumn("there", F.lit(True))
    judged = _requested(library, item_ids).join(there, "item_id", "left")
    refused = F.col("item_kind").isNull() | (F.col("item_kind") == WORKBOOK) | F.col("there").isNotNull()
    judged = judged.withColumn("outcome", F.when(refused, "SKIPPED").otherwise("CHANGED"))
    rows = judged.filter("outcome = 'CHANGED'").withColumn("one", F.lit(1)).join(F.broadcast(reserved.withColumn("one", F.lit(1))), "one")
    rows = rows.select("item_id", "folder_id", F.lit(at).cast("long").alias("added_at")).select(*library.memberships.columns)
    return replace(library, memberships=library.memberships.unionByName(rows)), report(judged)


def update_bookmarks(library: Library, drafts: DataFrame) -> tuple[Library, DataFrame]:
    """New title, url and provider of saved items from drafts (item_id, seq, title, url, provider), the last valid one each.

    Id, kind, fingerprint, time and memberships stay; a blank provider keeps the old one. Unknown items and workbook matches
    are skipped; a draft without title or with an address that may not be saved fails.
    """
    none = F.lit(None).cast("string")
    checked = validate_drafts(drafts.withColumns({"kind": F.lit("MANUAL_BOOKMARK"), "provider_key": none, "cell": none}))
    known = library.items.select(F.col("id").alias("item_id"), F.col("kind").alias("item_kind"))
    outcome = (
        F.when(F.col("item_kind").isNull() | (F.col("item_kind") == WORKBOOK), "SKIPPED").when(F.col("reason").isNotNull(), "FAILED").otherwise("CHANGED")
    )
    judged = checked.join(known, "item_id", "left").withColumn("outcome", outcome)
    filled = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    last = judged.filter("outcome = 'CHANGED'").groupBy(F.col("item_id").alias("id")).agg(
        F.max_by(F.struct(strip(F.col("title")).alias("title"), filled("url").alias("url"), filled("provider").alias("provider")), "seq").alias("d")
    )
    joined = library.items.join(last, "id", "left")
    given = F.col("d").isNotNull()
    new = {
        "title": F.when(given, F.col("d.title")).otherwise(F.col("title")), "url": F.when(given, F.col("d.url")).otherwise(F.col("url")),
        "domain": F.when(given, url_domain(F.col("d.url"))).otherwise(F.col("domain")), "provider": F.coalesce("d.provider", "provider"),
    }
    return replace(library, items=joined.withColumns(new).select(*library.items.columns)), report(judged)


def prune(library: Library) -> Library:
    """Drop the items nothing refers to any more."""
    used = library.entries.select("item_id").unionByName(library.memberships.select("item_id"))
    return replace(library, items=library.items.join(used, F.col("id") == F.col("item_id"), "left_semi"))


def _requested(library: Library, item_ids: DataFrame) -> DataFrame:
    """Distinct requested ids with the kind of the saved item."""
    return item_ids.select("item_id").distinct().join(
        library.items.select(F.col("id").alias("item_id"), F.col("kind").alias("item_kind")), "item_id", "left"
    )


def _reserved(library: Library, folder_id: str) -> bool:
    """Whether the target may not be used; looks at one row of the folder table."""
    row = library.folders.filter(F.col("id") == folder_id).select("kind").first()
    return row is None or row["kind"] == RESERVED


def _refused(item_ids: DataFrame) -> DataFrame:
    return report(item_ids.withColumn("outcome", F.lit("FAILED")))


def copy_items(library: Library, item_ids: DataFrame, target: str, at: int) -> tuple[Library, DataFrame]:
    """Add items to a folder; workbook matches, unknown ids and present members are skipped."""
    if _reserved(library, target):
        return library, _refused(item_ids)
    present = library.memberships.filter(F.col("folder_id") == target).select("item_id", F.lit(True).alias("present"))
    judged = _requested(library, item_ids).join(present, "item_id", "left").withColumn(
        "outcome",
        F.when(F.col("item_kind").isNull() | (F.col("item_kind") == WORKBOOK) | F.col("present"), "SKIPPED").otherwise("CHANGED"),
    )
    inserts = judged.filter("outcome = 'CHANGED'").select("item_id", F.lit(target).alias("folder_id"), F.lit(at).cast("long").alias("added_at"))
    return replace(library, memberships=library.memberships.unionByName(inserts)), report(judged)


def move_items(library: Library, item_ids: DataFrame, source: str, target: str, at: int) -> tuple[Library, DataFrame]:
    """Move members from one folder to another; other memberships stay."""
    if _reserved(library, target) or source == target:
        return library, _refused(item_ids)
    m = library.memberships
    members = m.filter(F.col("folder_id") == source).select("item_id", F.lit(True).alias("member"))
    judged = item_ids.select("item_id").distinct().join(members, "item_id", "left").withColumn(
        "outcome", F.when(F.col("member"), "CHANGED").otherwise("SKIPPED")
    )
    moving = judged.filter("outcome = 'CHANGED'").select("item_id")
    kept = m.join(moving.withColumn("folder_id", F.lit(source)), ["item_id", "folder_id"], "left_anti")
    inserts = moving.join(kept.filter(F.col("folder_id") == target).select("item_id"), "item_id", "left_anti").select(
        "item_id", F.lit(target).alias("folder_id"), F.lit(at).cast("long").alias("added_at")
    )
    return prune(replace(library, memberships=kept.unionByName(inserts))), report(judged)


def remove_items(library: Library, item_ids: DataFrame, folder_id: str) -> tuple[Library, DataFrame]:
    """Take items out of a folder; items nothing refers to any more go."""
    m = library.memberships
    doomed = item_ids.select("item_id").distinct().withColumn("folder_id", F.lit(folder_id))
    there = m.select("item_id", "folder_id", F.lit(True).alias("there"))
    judged = doomed.join(there, ["item_id", "folder_id"], "left").withColumn(
        "outcome", F.when(F.col("there"), "CHANGED").otherwise("SKIPPED")
    )
    return prune(replace(library, memberships=m.join(doomed, ["item_id", "folder_id"], "left_anti"))), report(judged)


def delete_bookmarks(library: Library, item_ids: DataFrame) -> tuple[Library, DataFrame]:
    """Take items out of the reserved folder."""
    bookmarks = library.folders.filter(F.col("reserved") == "BOOKMARKS").select("id").first()
    if bookmarks is None:
        return library, _refused(item_ids)
    return remove_items(library, item_ids, bookmarks["id"])


def _entry_outcomes(library: Library, item_ids: DataFrame, session_id: str) -> DataFrame:
    there = library.entries.filter(F.col("session_id") == session_id).select("item_id", F.lit(True).alias("there"))
    return _requested(library, item_ids).join(there, "item_id", "left").withColumn(
        "outcome",
        F.when(F.col("there") & F.col("item_kind").isNotNull() & (F.col("item_kind") != WORKBOOK), "CHANGED").otherwise("SKIPPED"),
    )


def transfer_entries(
    library: Library, item_ids: DataFrame, session_id: str, target: str, at: int, move: bool
) -> tuple[Library, DataFrame]:
    """Copy or move results of a session into a folder; workbook matches are skipped."""
    if _reserved(library, target):
        return library, _refused(item_ids)
    judged = _entry_outcomes(library, item_ids, session_id)
    going = judged.filter("outcome = 'CHANGED'").select("item_id")
    m = library.memberships
    inserts = going.join(m.filter(F.col("folder_id") == target).select("item_id"), "item_id", "left_anti").select(
        "item_id", F.lit(target).alias("folder_id"), F.lit(at).cast("long").alias("added_at")
    )
    entries = library.entries
    if move:
        entries = entries.join(going.withColumn("session_id", F.lit(session_id)), ["item_id", "session_id"], "left_anti").select(*entries.columns)
    return prune(replace(library, entries=entries, memberships=m.unionByName(inserts))), report(judged)


def copy_entries(library: Library, item_ids: DataFrame, session_id: str, target: str, at: int):
    return transfer_entries(library, item_ids, session_id, target, at, move=False)


def move_entries(library: Library, item_ids: DataFrame, session_id: str, target: str, at: int):
    return transfer_entries(library, item_ids, session_id, target, at, move=True)


def remove_entries(library: Library, item_ids: DataFrame, session_id: str) -> tuple[Library, DataFrame]:
    """Take results out of a session; workbook matches stay."""
    judged = _entry_outcomes(library, item_ids, session_id)
    gone = judged.filter("outcome = 'CHANGED'").select("item_id").withColumn("session_id", F.lit(session_id))
    entries = library.entries.join(gone, ["item_id", "session_id"], "left_anti").select(*library.entries.columns)
    return prune(replace(library, entries=entries)), report(judged)


def move_sessions(library: Library, session_ids: DataFrame, target: str) -> tuple[Library, DataFrame]:
    """File sessions under another folder; unknown ones and those already there are skipped."""
    if _reserved(library, target):
        return library, _refused(session_ids)
    asked = session_ids.select(F.col("session_id").alias("id")).distinct()
    known = library.sessions.select("id", F.lit(True).alias("known"), F.col("folder_id").alias("at"))
    judged = asked.join(known, "id", "left").withColumn(
        "outcome", F.when(F.col("known") & ~F.col("at").eqNullSafe(F.lit(target)), "CHANGED").otherwise("SKIPPED")
    )
    moved = library.sessions.join(asked.withColumn("asked", F.lit(True)), "id", "left").withColumn(
        "folder_id", F.when(F.col("asked"), F.lit(target)).otherwise(F.col("folder_id"))
    )
    return replace(library, sessions=moved.select(*library.sessions.columns)), report(judged)


def copied_title(c: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("Untitled")), F.lit(" (copy)"))


def copy_sessions(library: Library, session_ids: DataFrame, target: str, at: int) -> tuple[Library, DataFrame]:
    """Copy sessions into a folder; the copies share the items at the same positions."""
    if _reserved(library, target):
        return library, _refused(session_ids)
    asked = session_ids.select(F.col("session_id").alias("id")).distinct()
    known = library.sessions.withColumn("known", F.lit(True))
    judged = asked.join(known, "id", "left").withColumn("outcome", F.when(F.col("known"), "CHANGED").otherwise("SKIPPED"))
    copies = judged.filter("known").withColumn("new_id", new_id("ses", F.col("id"), F.lit(target), F.lit(at)))
    rows = copies.select(
        F.col("new_id").alias("id"), F.lit(target).alias("folder_id"), "kind", copied_title(F.col("title")).alias("title"),
        "query", F.lit(at).cast("long").alias("created_at"),
    ).select(*library.sessions.columns)
    entries = library.entries.join(copies.select(F.col("id").alias("session_id"), "new_id"), "session_id").select(
        F.col("new_id").alias("session_id"), "item_id", "position", F.lit(at).cast("long").alias("added_at")
    )
    return replace(
        library, sessions=library.sessions.unionByName(rows), entries=library.entries.unionByName(entries)
    ), report(judged)


def delete_sessions(library: Library, session_ids: DataFrame) -> tuple[Library, DataFrame]:
    """Drop sessions with their entries, then the items nothing refers to any more."""
    asked = session_ids.select("session_id").distinct()
    known = library.sessions.select(F.col("id").alias("session_id"), F.lit(True).alias("known"))
    judged = asked.join(known, "session_id", "left").withColumn("outcome", F.when(F.col("known"), "CHANGED").otherwise("SKIPPED"))
    sessions = library.sessions.join(asked, F.col("id") == F.col("session_id"), "left_anti")
    entries = library.entries.join(asked, "session_id", "left_anti")
    return prune(replace(library, sessions=sessions, entries=entries)), report(judged)


def copy_folders(library: Library, folder_ids: DataFrame, at: int) -> tuple[Library, DataFrame]:
    """Copy folders with their memberships, sessions and entries; a taken name gets a number."""
    asked = folder_ids.select(F.col("folder_id").alias("id")).distinct()
    judged = asked.join(library.folders, "id", "left").withColumn(
        "outcome", F.when(F.col("kind").isNull() | (F.col("kind") == RESERVED), "SKIPPED").otherwise("CHANGED")
    )
    copies = judged.filter("outcome = 'CHANGED'").withColumn("new_folder", new_id("fld", F.col("id"), F.lit(at))).withColumn(
        "wanted", copied_title(F.col("name"))
    )
    # Names taken by the saved folders: "wanted", "wanted 2", ...; the copies of one name follow each other. The plain name is number 1.
    pattern = r"(?s)^(.*?\(copy\))(?: (\d+))?$"
    saved = F.lower(library.folders["name"])
    taken = library.folders.select(
        F.regexp_extract(saved, pattern, 1).alias("base"), F.coalesce(F.nullif(F.regexp_extract(saved, pattern, 2), F.lit("")).try_cast("long"), F.lit(1)).alias("number")
    ).filter("base <> ''")
    wanted = place_in_order(copies.select("id", "new_folder", "kind", "wanted", F.lower("wanted").alias("base")), ["base"], ["id"], "nth")
    named = free_numbers(wanted, taken, "base", "nth")
    folders = named.select(
        F.col("new_folder").alias("id"),
        F.when(F.col("number") == 1, F.col("wanted")).otherwise(F.concat_ws(" ", "wanted", "number")).alias("name"),
        "kind", F.lit(None).cast("string").alias("reserved"), F.lit(at).cast("long").alias("created_at"),
    ).select(*library.folders.columns)
    to_new = copies.select(F.col("id").alias("folder_id"), "new_folder")
    members = library.memberships.join(to_new, "folder_id").select(
        "item_id", F.col("new_folder").alias("folder_id"), F.lit(at).cast("long").alias("added_at")
    )
    inside = library.sessions.join(to_new, "folder_id").withColumn("new_session", new_id("ses", F.col("id"), F.col("new_folder")))
    sessions = inside.select(
        F.col("new_session").alias("id"), F.col("new_folder").alias("folder_id"), "kind", "title", "query", "created_at"
    ).select(*library.sessions.columns)
    entries = library.entries.join(inside.select(F.col("id").alias("session_id"), "new_session"), "session_id").select(
        F.col("new_session").alias("session_id"), "item_id", "position", F.lit(at).cast("long").alias("added_at")
    )
    return Library(
        library.folders.unionByName(folders), library.sessions.unionByName(sessions), library.items,
        library.entries.unionByName(entries), library.memberships.unionByName(members),
    ), report(judged)


def delete_folders(library: Library, folder_ids: DataFrame) -> tuple[Library, DataFrame]:
    """Drop folders with their memberships, sessions and entries; reserved ones are skipped."""
    asked = folder_ids.select("folder_id").distinct()
    known = library.folders.select(F.col("id").alias("folder_id"), F.col("kind").alias("folder_kind"))
    judged = asked.join(known, "folder_id", "left").withColumn(
        "outcome", F.when(F.col("folder_kind").isNull() | (F.col("folder_kind") == RESERVED), "SKIPPED").otherwise("CHANGED")
    )
    doomed = judged.filter("outcome = 'CHANGED'").select("folder_id")
    gone = library.sessions.join(doomed, "folder_id", "left_semi").select(F.col("id").alias("session_id"))
    return prune(Library(
        library.folders.join(doomed, F.col("id") == F.col("folder_id"), "left_anti"),
        library.sessions.join(doomed, "folder_id", "left_anti").select(*library.sessions.columns), library.items,
        library.entries.join(gone, "session_id", "left_anti"), library.memberships.join(doomed, "folder_id", "left_anti").select(*library.memberships.columns),
    )), report(judged)


def bookmarked(library: Library) -> DataFrame:
    """item_id, added_at of the members of the reserved folder."""
    reserved = library.folders.filter(F.col("reserved") == "BOOKMARKS").select(F.col("id").alias("folder_id"))
    return library.memberships.join(reserved, "folder_id", "left_semi").select("item_id", "added_at")


def _flagged(rows: DataFrame, library: Library) -> DataFrame:
    marks = bookmarked(library).select("item_id").distinct().withColumn("bookmarked", F.lit(True))
    return rows.join(marks, "item_id", "left").withColumn("bookmarked", F.coalesce("bookmarked", F.lit(False)))


def session_items(library: Library) -> DataFrame:
    """session_id, item_id, position, bookmarked in display order: bookmarked first, then position."""
    present = library.items.select(F.col("id").alias("item_id"))
    rows = library.entries.join(present, "item_id", "left_semi").select("session_id", "item_id", "position")
    return _flagged(rows, library).orderBy("session_id", F.desc("bookmarked"), "position", "item_id")


def folder_items(library: Library) -> DataFrame:
    """folder_id, item_id in display order: sessions newest first, then direct members; the first occurrence stays.

    The place of an occurrence is a sortable struct, so keeping the first one is a minimum, not a window over the
    whole folder.
    """
    sessions = library.sessions.filter("folder_id IS NOT NULL").select(F.col("id").alias("session_id"), "folder_id", "created_at")
    through = library.entries.join(sessions, "session_id").select(
        "folder_id", "item_id", F.lit(0).alias("part"), (-F.col("created_at")).alias("newest"), F.col("session_id").alias("session"),
        F.col("position").cast("long").alias("at"),
    )
    direct = library.memberships.select(
        "folder_id", "item_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("newest"), F.lit("").alias("session"),
        F.col("added_at").alias("at"),
    )
    present = library.items.select(F.col("id").alias("item_id"))
    both = _flagged(through.unionByName(direct).join(present, "item_id", "left_semi"), library)
    place = F.struct("part", "newest", "session", (~F.col("bookmarked")).alias("plain"), "at", "item_id")
    return both.groupBy("folder_id", "item_id").agg(F.min(place).alias("place")).orderBy("folder_id", "place").select(
        "folder_id", "item_id", F.col("place.part").alias("part"), F.col("place.session").alias("session"), F.col("place.at").alias("at")
    )


def bookmarked_items(library: Library, descending: bool = False) -> DataFrame:
    """Bookmarked items in the order they were added."""
    rows = bookmarked(library).join(library.items, F.col("item_id") == F.col("id"))
    keys = [F.col("added_at"), F.col("item_id")]
    return rows.orderBy(*[k.desc() if descending else k.asc() for k in keys])


def item_folders(library: Library) -> DataFrame:
    """item_id, folder_id, kind: the folders an item is in, directly or through a session."""
    through = library.entries.join(
        library.sessions.select(F.col("id").alias("session_id"), "folder_id"), "session_id"
    ).select("item_id", "folder_id")
    both = library.memberships.select("item_id", "folder_id").unionByName(through).distinct()
    return both.join(library.folders.select(F.col("id").alias("folder_id"), "kind"), "folder_id").select("item_id", "folder_id", "kind")


def wishlist_flags(library: Library) -> DataFrame:
    """item_id, bookmarked, wishlisted of every item."""
    marked = item_folders(library).groupBy("item_id").agg(F.bool_or(F.col("kind") == "PROFILE").alias("wishlisted"))
    rows = library.items.select(F.col("id").alias("item_id")).join(marked, "item_id", "left")
    return _flagged(rows.withColumn("wishlisted", F.coalesce("wishlisted", F.lit(False))), library)


def folder_counts(library: Library) -> DataFrame:
    """folder_id, sessions, items of every folder."""
    sessions = library.sessions.groupBy("folder_id").agg(F.count("*").alias("sessions"))
    present = library.items.select(F.col("id").alias("item_id"))
    items = item_folders(library).join(present, "item_id", "left_semi").groupBy("folder_id").agg(F.count("*").alias("items"))
    ids = library.folders.select(F.col("id").alias("folder_id"))
    return ids.join(sessions, "folder_id", "left").join(items, "folder_id", "left").select(
        "folder_id", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("items", F.lit(0)).alias("items")
    )


# Labels of item kinds and match types.
MATCH_LABELS = {"WORKBOOK": ("Workbook match",) * 2, "TEXT_QUERY": ("Text match", "Unverified match"),
                "VISUAL": ("Visual match", "Unverified match"), "MANUAL": ("Manual",) * 2}


def display_columns(items: DataFrame, kind_label: str = "kind") -> DataFrame:
    """Adds author_line, meta_line, source_label and match_label; authors is an array of texts."""
    filled = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    artists = F.array_join(F.array_distinct(F.filter(F.transform("authors", strip), lambda a: a != "")), ", ")
    label = F.when(F.lit(False), "")
    for kind, (verified, unverified) in MATCH_LABELS.items():
        label = label.when(F.col("match_type") == kind, F.when(F.col("verified"), verified).otherwise(unverified))
    return items.select(
        "*", F.coalesce(F.nullif(artists, F.lit("")), filled("circle"), F.lit(DASH)).alias("author_line"),
        F.coalesce(filled("price"), filled("identifier"), F.lit(DASH)).alias("meta_line"),
        F.coalesce(filled("provider"), filled("domain"), F.col(kind_label)).alias("source_label"), label.alias("match_label"),
    )


def remote_changes(saved: DataFrame, remote: DataFrame) -> DataFrame:
    """id, change UNCHANGED|CHANGED|UNKNOWN by e-tag, then content tag, then time and size, then size.

    saved, remote: id, etag, ctag, modified, size. The first mark both sides have decides.
    """
    s = saved.select("id", *[F.col(c).alias(f"s_{c}") for c in ("etag", "ctag", "modified", "size")])
    r = remote.select("id", *[F.col(c).alias(f"r_{c}") for c in ("etag", "ctag", "modified", "size")])
    tag = lambda c: F.when(strip(F.col(c)) != "", F.col(c))
    verdict = lambda same: F.when(same, "UNCHANGED").otherwise("CHANGED")
    both = lambda c, f=F.col: f(f"s_{c}").isNotNull() & f(f"r_{c}").isNotNull()
    size_differs = both("size") & (F.col("s_size") != F.col("r_size"))
    change = (
        F.when(both("etag", tag), verdict(F.col("s_etag") == F.col("r_etag")))
        .when(both("ctag", tag), verdict(F.col("s_ctag") == F.col("r_ctag")))
        .when(both("modified"), verdict((F.col("s_modified") == F.col("r_modified")) & ~size_differs))
        .when(size_differs, "CHANGED").otherwise("UNKNOWN")
    )
    return s.join(r, "id").select("id", change.alias("change"))


def eligible_drafts(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates not rejected that have a title, code or address, with the label of their providers.

    candidates: key, title, product_id, source_url, providers array<string>.
    """
    rejected = decisions.filter("decision = 'REJECTED'").select("key")
    given = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) != ""
    known = F.transform("providers", lambda p: F.lower(strip(p)))
    names = F.array_compact(F.array(*[  # in order of priority
        F.when(F.array_contains(known, i), n) for i, n in (("saucenao", "SauceNAO"), ("iqdb", "IQDB"))
    ]))
    label = F.coalesce(F.nullif(F.array_join(names, " + "), F.lit("")), F.lit("Discovery"))
    return (
        candidates.filter(given("title") | given("product_id") | given("source_url")).join(rejected, "key", "left_anti")
        .withColumn("provider_label", label).withColumn("fingerprint", F.lower(strip(F.col("key"))))
    )


def browse_bookmarks(items: DataFrame, needle: str = "", sort: str = "ADDED") -> DataFrame:
    """Bookmarks whose title or domain contains the needle; ADDED keeps the stored order."""
    out = items
    if needle.strip():
        out = out.filter(contains_ci(F.col("title"), needle.strip()) | contains_ci(F.col("domain"), needle.strip()))
    keys = {
        "ADDED": ["added_at", "item_id"], "TITLE": [F.lower("title"), "item_id"],
        "DOMAIN": [F.lower(F.coalesce("domain", F.lit(""))), F.lower("title"), "item_id"],
    }[sort]
    return out.orderBy(*keys)


def compose_profile(ranked: DataFrame, online: DataFrame, discovery: DataFrame) -> DataFrame:
    """session_id, pos, fingerprint, ... of three result sets in that order, the first of each fingerprint kept.

    Inputs share their columns: session_id, fingerprint, provider, pos.
    """
    parts = [df.withColumn("part", F.lit(n)) for n, df in enumerate((ranked, online, discovery))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    carried = [c for c in rows.columns if c not in ("session_id", "fingerprint")]
    first = rows.groupBy("session_id", "fingerprint").agg(F.min_by(F.struct(*carried), F.struct("part", "pos")).alias("r"))
    return first.select("session_id", "fingerprint", "r.*")


def provider_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("session_id", "provider").agg(F.count("*").alias("results"))
