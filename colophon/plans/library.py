"""Queries over library tables, migrations, exports, the registry, plug-ins and the capture stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from colophon.operators import library as lib
from colophon.plans.inputs import FEEDS, Inputs, query
from colophon.session import checkpoint_dir
from colophon.sources import exports, library as store, plugins, workbooks
from colophon.streaming import capture

# Folders are nations (one reserved), sessions are conversations, items are what was said, documents and passages.
FEEDS["folders"] = """
SELECT 'f' || cast(n_nationkey AS string) AS id, CASE n_nationkey % 6 WHEN 1 THEN 'Shelf' WHEN 2 THEN 'Shelf (copy)' WHEN 3 THEN 'SHELF (copy) 2' ELSE n_name END AS name, CASE WHEN n_nationkey = 0 THEN 'RESERVED' ELSE 'PROFILE' END AS kind,
  CASE WHEN n_nationkey = 0 THEN 'BOOKMARKS' END AS reserved, cast(n_nationkey AS bigint) AS created_at FROM {nation}
"""
FEEDS["sessions"] = """
SELECT 's' || cast(conv_id AS string) AS id, CASE WHEN conv_id % 7 = 6 THEN NULL ELSE 'f' || cast(1 + conv_id % 24 AS string) END AS folder_id, CASE conv_id % 3 WHEN 0 THEN 'ONLINE_SEARCH' WHEN 1 THEN 'OFFLINE_MATCH' ELSE 'RESULT_PROFILE' END AS kind,
  'Session ' || cast(conv_id AS string) AS title, cast(NULL AS string) AS query, 1000 - conv_id AS created_at FROM {conversations} GROUP BY conv_id
"""
FEEDS["items"] = """
SELECT 'd' || cast(doc_id AS string) AS id, CASE doc_id % 5 WHEN 0 THEN 'WORKBOOK_MATCH' WHEN 1 THEN 'MANUAL_BOOKMARK' ELSE 'ONLINE_RESULT' END AS kind, split_part(text, '.', 1) AS title, 'fp' || cast(doc_id AS string) AS fingerprint, 'https://' || source || '.example/' || cast(doc_id AS string) AS url,
  source || '.example' AS domain, source AS provider, cast(NULL AS string) AS cell, doc_id AS created_at FROM {documents}
"""
FEEDS["entries"] = """
SELECT session_id, item_id, min(position) AS position, 5 AS added_at FROM (SELECT 's' || cast(conv_id AS string) AS session_id, 'd' || cast((conv_id * 3 + turn) % 700 AS string) AS item_id, cast(turn AS int) AS position FROM {conversations}) e GROUP BY session_id, item_id
"""
FEEDS["memberships"] = """
SELECT item_id, folder_id, min(added_at) AS added_at FROM (
  SELECT 'd' || cast(doc_id AS string) AS item_id, 'f' || cast(doc_id % 11 AS string) AS folder_id, 2 * doc_id AS added_at FROM {labels} UNION ALL SELECT 'd' || cast(doc_id AS string), 'f' || cast(quality AS string), 3 * doc_id FROM {labels}) m GROUP BY item_id, folder_id
"""
TABLES = ["folders", "sessions", "items", "entries", "memberships"]
FEEDS["wanted_items"] = "SELECT 'd' || cast(doc_id * 2 AS string) AS item_id FROM {documents}"
FEEDS["wanted_sessions"] = "SELECT DISTINCT 's' || cast(conv_id * 2 AS string) AS session_id FROM {conversations}"
FEEDS["wanted_folders"] = "SELECT 'f' || cast(n_nationkey * 2 AS string) AS folder_id FROM {nation}"


def _library(i: Inputs) -> lib.Library:
    return lib.Library(*[i.feed(t) for t in TABLES])


def library_query(name: str, sql: str | None, more: list[str] | None = None):
    return query(name, sql, [*TABLES, *(more or [])] if sql else None)




JUDGE = "SELECT count(*) AS requested, count(*) FILTER (o = 'C') AS changed, count(*) FILTER (o = 'S') AS skipped, 0 AS failed FROM"
COPY = "(SELECT CASE WHEN i.kind IS NULL OR i.kind = 'WORKBOOK_MATCH' OR m.item_id IS NOT NULL THEN 'S' ELSE 'C' END AS o, w.item_id FROM wanted_items w LEFT JOIN items i ON i.id = w.item_id LEFT JOIN memberships m ON m.item_id = w.item_id AND m.folder_id = 'f3')"


@library_query("copy_items_report", f"{JUDGE} {COPY}", ["wanted_items"])
def _(i):
    return lib.copy_items(_library(i), i.feed("wanted_items"), "f3", 9)[1]


@library_query("copy_items", f"SELECT item_id, folder_id FROM memberships UNION ALL SELECT item_id, 'f3' FROM {COPY} WHERE o = 'C'", ["wanted_items"])
def _(i):
    return lib.copy_items(_library(i), i.feed("wanted_items"), "f3", 9)[0].memberships.select("item_id", "folder_id")


MOVED = "moved AS (SELECT w.item_id FROM wanted_items w JOIN memberships m ON m.item_id = w.item_id AND m.folder_id = 'f1')"


@library_query("move_items", f"WITH {MOVED} SELECT item_id, folder_id FROM memberships WHERE NOT (folder_id = 'f1' AND item_id IN (FROM moved)) UNION SELECT item_id, 'f4' FROM moved", ["wanted_items"])
def _(i):
    return lib.move_items(_library(i), i.feed("wanted_items"), "f1", "f4", 9)[0].memberships.select("item_id", "folder_id")


@library_query("remove_items", """
WITH m AS (SELECT * FROM memberships WHERE NOT (folder_id = 'f1' AND item_id IN (SELECT item_id FROM wanted_items))) SELECT id FROM items WHERE id IN (SELECT item_id FROM m) OR id IN (SELECT item_id FROM entries)
""", ["wanted_items"])
def _(i):
    return lib.remove_items(_library(i), i.feed("wanted_items"), "f1")[0].items.select("id")


@library_query("delete_bookmarks", "SELECT item_id, folder_id FROM memberships WHERE NOT (folder_id = 'f0' AND item_id IN (SELECT item_id FROM wanted_items))", ["wanted_items"])
def _(i):
    return lib.delete_bookmarks(_library(i), i.feed("wanted_items"))[0].memberships.select("item_id", "folder_id")


@library_query("prune", "SELECT id FROM items WHERE id IN (SELECT item_id FROM entries) OR id IN (SELECT item_id FROM memberships)")
def _(i):
    return lib.prune(_library(i)).items.select("id")


GOING = "going AS (SELECT w.item_id FROM wanted_items w JOIN entries e ON e.item_id = w.item_id AND e.session_id = 's4' JOIN items i ON i.id = w.item_id AND i.kind <> 'WORKBOOK_MATCH')"


@library_query("copy_entries", f"WITH {GOING} SELECT item_id, folder_id FROM memberships UNION SELECT item_id, 'f2' FROM going", ["wanted_items"])
def _(i):
    return lib.copy_entries(_library(i), i.feed("wanted_items"), "s4", "f2", 9)[0].memberships.select("item_id", "folder_id")


@library_query("move_entries", f"WITH {GOING} SELECT session_id, item_id, position FROM entries WHERE NOT (session_id = 's4' AND item_id IN (FROM going))", ["wanted_items"])
def _(i):
    return lib.move_entries(_library(i), i.feed("wanted_items"), "s4", "f2", 9)[0].entries.select("session_id", "item_id", "position")


@library_query("remove_entries", f"WITH {GOING} SELECT (SELECT count(*) FROM wanted_items) AS requested, count(*) AS changed, (SELECT count(*) FROM wanted_items) - count(*) AS skipped, 0 AS failed FROM going", ["wanted_items"])
def _(i):
    return lib.remove_entries(_library(i), i.feed("wanted_items"), "s4")[1]


@library_query("move_sessions", "SELECT id, CASE WHEN id IN (SELECT session_id FROM wanted_sessions) THEN 'f5' ELSE folder_id END AS folder_id FROM sessions", ["wanted_sessions"])
def _(i):
    return lib.move_sessions(_library(i), i.feed("wanted_sessions"), "f5")[0].sessions.select("id", "folder_id")


@library_query("copy_sessions", """
WITH c AS (SELECT s.id, s.title FROM sessions s WHERE id IN (SELECT session_id FROM wanted_sessions))
SELECT title, count(item_id) AS items, coalesce(sum(position), 0) AS positions FROM (SELECT s.id, s.title, e.item_id, e.position FROM sessions s LEFT JOIN entries e ON e.session_id = s.id UNION ALL SELECT 'n' || c.id, c.title || ' (copy)', e.item_id, e.position FROM c LEFT JOIN entries e ON e.session_id = c.id) GROUP BY id, title
""", ["wanted_sessions"])
def _(i):
    out = lib.copy_sessions(_library(i), i.feed("wanted_sessions"), "f5", 9)[0]
    joined = out.sessions.join(out.entries.withColumnRenamed("session_id", "id"), "id", "left")
    return joined.groupBy("id", "title").agg(
        F.count("item_id").alias("items"), F.coalesce(F.sum("position"), F.lit(0)).alias("positions")
    ).drop("id")


@library_query("delete_sessions", """
WITH e AS (SELECT * FROM entries WHERE session_id NOT IN (SELECT session_id FROM wanted_sessions)) SELECT id FROM items WHERE id IN (SELECT item_id FROM e) OR id IN (SELECT item_id FROM memberships)
""", ["wanted_sessions"])
def _(i):
    return lib.delete_sessions(_library(i), i.feed("wanted_sessions"))[0].items.select("id")


@library_query("delete_folders", """
WITH d AS (SELECT w.folder_id FROM wanted_folders w JOIN folders f ON f.id = w.folder_id WHERE f.kind <> 'RESERVED'), s AS (SELECT id FROM sessions WHERE folder_id IN (FROM d)), e AS (SELECT * FROM entries WHERE session_id NOT IN (FROM s)), m AS (SELECT * FROM memberships WHERE folder_id NOT IN (FROM d))
SELECT 'item' AS what, id FROM items WHERE id IN (SELECT item_id FROM e) OR id IN (SELECT item_id FROM m) UNION ALL SELECT 'folder', id FROM folders WHERE id NOT IN (FROM d) UNION ALL SELECT 'session', id FROM sessions WHERE id NOT IN (FROM s)
""", ["wanted_folders"])
def _(i):
    out = lib.delete_folders(_library(i), i.feed("wanted_folders"))[0]
    named = lambda df, what: df.select(F.lit(what).alias("what"), "id")
    return named(out.items, "item").unionByName(named(out.folders, "folder")).unionByName(named(out.sessions, "session"))


@library_query("copy_folders", """
WITH c AS (SELECT f.*, CASE WHEN lower(name) = 'shelf' THEN row_number() OVER (PARTITION BY lower(name) ORDER BY id) WHEN name LIKE '%(copy)%' THEN row_number() OVER (PARTITION BY lower(name) ORDER BY id) ELSE 1 END AS nth FROM folders f JOIN wanted_folders w ON w.folder_id = f.id WHERE kind <> 'RESERVED')
SELECT 'members' AS what, count(*) AS n FROM (SELECT * FROM memberships UNION ALL SELECT m.* FROM memberships m JOIN c ON c.id = m.folder_id) UNION ALL SELECT 'sessions', count(*) FROM (SELECT id FROM sessions UNION ALL SELECT s.id FROM sessions s JOIN c ON c.id = s.folder_id)
UNION ALL SELECT 'entries', count(*) FROM (SELECT item_id FROM entries UNION ALL SELECT e.item_id FROM entries e JOIN sessions s ON s.id = e.session_id JOIN c ON c.id = s.folder_id) UNION ALL SELECT 'folders', (SELECT count(*) FROM folders) + (SELECT count(*) FROM c) UNION ALL SELECT 'names', (SELECT count(DISTINCT lower(name)) FROM folders) + (SELECT count(*) FROM c)
""", ["wanted_folders"])
def _(i):
    out = lib.copy_folders(_library(i), i.feed("wanted_folders"), 9)[0]
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    names = out.folders.agg(F.count_distinct(F.lower("name")).alias("n")).select(F.lit("names").alias("what"), "n")
    parts = [count(out.memberships, "members"), count(out.sessions, "sessions"), count(out.entries, "entries"), count(out.folders, "folders"), names]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


MARKS = "marks AS (SELECT DISTINCT item_id FROM memberships WHERE folder_id = 'f0')"


@library_query("session_items", f"WITH {MARKS} SELECT session_id, e.item_id, position, m.item_id IS NOT NULL AS bookmarked FROM entries e JOIN items i ON i.id = e.item_id LEFT JOIN marks m ON m.item_id = e.item_id")
def _(i):
    return lib.session_items(_library(i))


@library_query("folder_items", """
WITH o AS (SELECT s.folder_id, e.item_id, 0 AS part, -s.created_at AS newest, s.id AS session, e.position::BIGINT AS at_ FROM entries e JOIN sessions s ON s.id = e.session_id WHERE s.folder_id IS NOT NULL UNION ALL SELECT folder_id, item_id, 1, 0, '', added_at FROM memberships)
SELECT folder_id, item_id, part, session, at_ AS "at" FROM (SELECT o.*, row_number() OVER (PARTITION BY folder_id, item_id ORDER BY part, newest, session, at_) AS rn FROM o JOIN items i ON i.id = o.item_id) WHERE rn = 1
""")
def _(i):
    return lib.folder_items(_library(i))


@library_query("bookmarked_items", "SELECT i.id, m.added_at FROM memberships m JOIN items i ON i.id = m.item_id WHERE m.folder_id = 'f0'")
def _(i):
    return lib.bookmarked_items(_library(i), descending=True).select("id", "added_at")


THROUGH = "through AS (SELECT item_id, folder_id FROM memberships UNION SELECT e.item_id, s.folder_id FROM entries e JOIN sessions s ON s.id = e.session_id WHERE s.folder_id IS NOT NULL)"


@library_query("item_folders", f"WITH {THROUGH} SELECT t.item_id, t.folder_id, f.kind FROM through t JOIN folders f ON f.id = t.folder_id")
def _(i):
    return lib.item_folders(_library(i))


@library_query("wishlist_flags", f"WITH {THROUGH}, {MARKS} SELECT i.id AS item_id, i.id IN (SELECT item_id FROM through WHERE folder_id <> 'f0') AS wishlisted, i.id IN (FROM marks) AS bookmarked FROM items i")
def _(i):
    return lib.wishlist_flags(_library(i))


@library_query("folder_counts", f"WITH {THROUGH} SELECT f.id AS folder_id, (SELECT count(*) FROM sessions s WHERE s.folder_id = f.id) AS sessions, (SELECT count(*) FROM through t JOIN items i ON i.id = t.item_id WHERE t.folder_id = f.id) AS items FROM folders f")
def _(i):
    return lib.folder_counts(_library(i))


FEEDS["drafts"] = """
SELECT doc_id AS pos, 'f' || cast(doc_id % 26 AS string) AS folder_id, 's' || cast(doc_id % 90 AS string) AS session_id, CASE doc_id % 6 WHEN 0 THEN 'WORKBOOK_MATCH' WHEN 1 THEN 'MANUAL_BOOKMARK' ELSE 'ONLINE_RESULT' END AS kind, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE lang || cast(doc_id % 400 AS string) END AS title,
  CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'http://a.example/x' WHEN 2 THEN 'https://' ELSE 'https://A.example/' || cast(doc_id % 300 AS string) END AS url, source AS provider, CASE WHEN doc_id % 4 = 0 THEN 'FP' || cast(doc_id AS string) END AS provider_key, cast(NULL AS string) AS cell, doc_id AS added_at FROM {documents}
"""
VALID = """
SELECT *, CASE WHEN trim(title) = '' THEN 'NO_TITLE' WHEN kind = 'MANUAL_BOOKMARK' AND url = '' THEN 'NO_URL' WHEN kind = 'MANUAL_BOOKMARK' AND NOT starts_with(url, 'https://') THEN 'NOT_HTTPS' WHEN kind = 'MANUAL_BOOKMARK' AND url = 'https://' THEN 'BAD_URL' WHEN kind = 'WORKBOOK_MATCH' AND {direct} THEN 'WORKBOOK_MATCH' END AS reason,
  coalesce(lower(provider_key), CASE WHEN url IN ('', 'https://') THEN NULL ELSE 'url:https://' || lower(substr(replace(url, 'http://', 'https://'), 9, 9)) || substr(replace(url, 'http://', 'https://'), 18) END, 'title:' || lower(trim(title))) AS fingerprint FROM drafts
"""
DIRECT = VALID.replace("{direct}", "true")


@query("validate_drafts", f"SELECT pos, reason, fingerprint FROM ({DIRECT})", ["drafts"])
def _(i):
    return lib.validate_drafts(i.feed("drafts")).select("pos", "reason", "fingerprint")


ADDED = f"""
WITH v AS (SELECT d.* FROM ({DIRECT}) d JOIN folders f ON f.id = d.folder_id AND f.kind <> 'RESERVED' WHERE reason IS NULL), all_items AS (SELECT id, fingerprint FROM items UNION ALL SELECT NULL, fingerprint FROM v WHERE fingerprint NOT IN (SELECT fingerprint FROM items) GROUP BY fingerprint
), once AS (SELECT v.folder_id, v.fingerprint, count(*) AS asked, max(m.item_id) AS there FROM v LEFT JOIN items i ON i.fingerprint = v.fingerprint LEFT JOIN memberships m ON m.item_id = i.id AND m.folder_id = v.folder_id GROUP BY ALL)
"""


@library_query("add_items", ADDED + " SELECT folder_id, count(*) FILTER (there IS NULL) AS added, sum(asked - CASE WHEN there IS NULL THEN 1 ELSE 0 END) AS already_there FROM once GROUP BY ALL", ["drafts"])
def _(i):
    return lib.add_items(_library(i), lib.validate_drafts(i.feed("drafts")))[1]


@library_query("add_items_saved", ADDED + " SELECT fingerprint FROM all_items", ["drafts"])
def _(i):
    return lib.add_items(_library(i), lib.validate_drafts(i.feed("drafts")))[0].items.select("fingerprint")


FEEDS["new_sessions"] = """
SELECT 's' || cast(s_suppkey AS string) AS id, 'f' || cast(s_nationkey AS string) AS folder_id, CASE s_suppkey % 3 WHEN 0 THEN 'ONLINE_SEARCH' WHEN 1 THEN 'OFFLINE_MATCH' ELSE 'RESULT_PROFILE' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN ' ' ELSE s_name END AS title, '' AS query, s_suppkey AS created_at, s_suppkey AS seq FROM {supplier}
"""


@library_query("save_sessions", f"""
WITH v AS (SELECT * FROM ({VALID.replace('{direct}', 'false')}) WHERE reason IS NULL), a AS (SELECT n.* FROM new_sessions n JOIN folders f ON f.id = n.folder_id AND f.kind <> 'RESERVED' WHERE n.id IN (SELECT session_id FROM v)
), b AS (SELECT folder_id, count(*) AS n FROM sessions GROUP BY ALL), t AS (SELECT a.*, coalesce(b.n, 0) + row_number() OVER (PARTITION BY a.folder_id ORDER BY seq) AS number FROM a LEFT JOIN b USING (folder_id))
SELECT t.id, t.folder_id, CASE WHEN trim(t.title) <> '' THEN t.title ELSE CASE t.kind WHEN 'OFFLINE_MATCH' THEN 'Scan #' WHEN 'ONLINE_SEARCH' THEN 'Search #' ELSE 'Result profile #' END || number END AS title, count(DISTINCT v.fingerprint) AS added, count(*) - count(DISTINCT v.fingerprint) AS already_there FROM t JOIN v ON v.session_id = t.id GROUP BY ALL
""", ["drafts", "new_sessions"])
def _(i):
    base = _library(i)
    saved, counts = lib.save_sessions(base, i.feed("new_sessions"), lib.validate_drafts(i.feed("drafts"), direct=False))
    rows = saved.sessions.join(base.sessions.select("id", "title"), ["id", "title"], "left_anti")
    return rows.join(counts, rows["id"] == counts["session_id"]).select("id", "folder_id", "title", "added", "already_there")


@library_query("create_folders", """
WITH r AS (SELECT p_partkey AS seq, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_name END AS name FROM part), o AS (SELECT count(*) AS n FROM folders WHERE kind = 'PROFILE')
SELECT CASE WHEN trim(name) = '' THEN '#' || (o.n + row_number() OVER (ORDER BY seq)) ELSE trim(name) END AS name, 'PROFILE' AS kind FROM r, o
""")
def _(i):
    base = _library(i)
    asked = i.table("part").select(F.col("p_partkey").alias("seq"), F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_name")).alias("name"))
    made, _ = lib.create_folders(base, asked, 77)
    return made.folders.filter("created_at = 77 AND id LIKE 'fld%'").select("name", "kind")


@library_query("rename_folders", """
WITH r AS (SELECT 'f' || s_nationkey AS id, max_by(s_name, s_suppkey) FILTER (s_suppkey % 2 = 0) AS name FROM supplier GROUP BY ALL)
SELECT f.id, CASE WHEN f.kind <> 'RESERVED' THEN coalesce(r.name, f.name) ELSE f.name END AS name FROM folders f LEFT JOIN r USING (id)
""")
def _(i):
    return lib.rename_folders(_library(i), _new_names(i))[0].folders.select("id", "name")


@query("rename_folders_report", "SELECT count(*) AS requested, count(*) FILTER (s_nationkey > 0) AS changed, count(*) FILTER (s_nationkey = 0) AS skipped, 0 AS failed FROM supplier")
def _(i):
    return lib.rename_folders(_library(i), _new_names(i))[1]


def _new_names(i):
    return i.table("supplier").select(
        F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("folder_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(" ").alias("name"), F.col("s_suppkey").alias("seq"))


@library_query("rename_sessions", """
SELECT s.id, coalesce(o.name, s.title) AS title FROM sessions s LEFT JOIN (SELECT 's' || (o_custkey % 300) AS id, max_by(o_orderpriority, o_orderkey) AS name FROM orders GROUP BY ALL) o USING (id)
""")
def _(i):
    asked = i.table("orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 300).cast("string")).alias("session_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("seq"))
    return lib.rename_sessions(_library(i), asked)[0].sessions.select("id", "title")


@library_query("bookmark_items", """
SELECT item_id FROM memberships WHERE folder_id = 'f0' UNION SELECT w.item_id FROM wanted_items w JOIN items i ON i.id = w.item_id WHERE i.kind <> 'WORKBOOK_MATCH'
""", ["wanted_items"])
def _(i):
    return lib.bookmark_items(_library(i), i.feed("wanted_items"), 9)[0].memberships.filter("folder_id = 'f0'").select("item_id")


FEEDS["bookmark_edits"] = """
SELECT 'd' || cast(p_partkey AS string) AS item_id, p_partkey + p_size AS seq, CASE WHEN p_size % 9 = 0 THEN ' ' ELSE ' ' || p_name || ' ' END AS title, CASE WHEN p_size % 4 = 1 THEN 'http://plain.example' ELSE 'https://shop.example/' || cast(p_size AS string) END AS url, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE ' ' END AS provider FROM {part}
"""


@library_query("update_bookmarks", """
WITH e AS (SELECT * FROM bookmark_edits WHERE trim(title) <> '' AND url LIKE 'https://%')
SELECT i.id, CASE WHEN e.item_id IS NOT NULL AND i.kind <> 'WORKBOOK_MATCH' THEN trim(e.title) ELSE i.title END AS title, CASE WHEN e.item_id IS NOT NULL AND i.kind <> 'WORKBOOK_MATCH' THEN e.url ELSE i.url END AS url,
  CASE WHEN e.item_id IS NOT NULL AND i.kind <> 'WORKBOOK_MATCH' THEN 'shop.example' ELSE i.domain END AS domain, CASE WHEN i.kind <> 'WORKBOOK_MATCH' THEN coalesce(nullif(trim(e.provider), ''), i.provider) ELSE i.provider END AS provider, i.fingerprint
FROM items i LEFT JOIN e ON e.item_id = i.id
""", ["bookmark_edits"])
def _(i):
    return lib.update_bookmarks(_library(i), i.feed("bookmark_edits"))[0].items.select("id", "title", "url", "domain", "provider", "fingerprint")


@library_query("update_bookmarks_report", """
SELECT count(*) AS requested, count(*) FILTER (o = 'C') AS changed, count(*) FILTER (o = 'S') AS skipped, count(*) FILTER (o = 'F') AS failed
FROM (SELECT CASE WHEN i.id IS NULL OR i.kind = 'WORKBOOK_MATCH' THEN 'S' WHEN trim(e.title) = '' OR e.url NOT LIKE 'https://%' THEN 'F' ELSE 'C' END AS o FROM bookmark_edits e LEFT JOIN items i ON i.id = e.item_id)
""", ["bookmark_edits"])
def _(i):
    return lib.update_bookmarks(_library(i), i.feed("bookmark_edits"))[1]


FEEDS["shown_items"] = """
SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS author, p_type AS circle, CASE WHEN p_size % 2 = 0 THEN cast(p_retailprice AS string) ELSE ' ' END AS price, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS identifier,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE 'shop' END AS provider, CASE WHEN p_size % 8 = 0 THEN '' ELSE 'd.example' END AS domain, 'Saved' AS kind, CASE p_partkey % 4 WHEN 0 THEN 'WORKBOOK' WHEN 1 THEN 'TEXT_QUERY' WHEN 2 THEN 'VISUAL' ELSE 'MANUAL' END AS match_type, p_size > 20 AS verified FROM {part}
"""


@query("display_columns", """
SELECT id, CASE WHEN author <> '' THEN author || ', z' ELSE 'z' END AS author_line, coalesce(nullif(trim(price), ''), nullif(identifier, ''), '—') AS meta_line, coalesce(nullif(provider, ''), nullif(domain, ''), 'Saved') AS source_label,
  CASE match_type WHEN 'WORKBOOK' THEN 'Workbook match' WHEN 'MANUAL' THEN 'Manual' ELSE CASE WHEN NOT verified THEN 'Unverified match' WHEN match_type = 'VISUAL' THEN 'Visual match' ELSE 'Text match' END END AS match_label FROM shown_items
""", ["shown_items"])
def _(i):
    shown = i.feed("shown_items").withColumn("authors", F.array("author", F.lit(" "), F.lit("z "), F.col("author")))
    return lib.display_columns(shown).select("id", "author_line", "meta_line", "source_label", "match_label")


FEEDS["remote_saved"] = "SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority ELSE ' ' END AS etag, CASE WHEN o_custkey % 3 = 1 THEN o_orderstatus END AS ctag, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS modified, o_custkey AS size FROM {orders}"
FEEDS["remote_now"] = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '2-HIGH' ELSE '' END AS etag, CASE WHEN o_orderkey % 5 > 0 THEN 'F' END AS ctag, o_custkey + o_orderkey % 2 AS modified, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey + o_orderkey % 3 END AS size FROM {orders}"


@query("remote_changes", """
SELECT s.id, CASE WHEN trim(s.etag) <> '' AND trim(r.etag) <> '' THEN CASE WHEN s.etag = r.etag THEN 'UNCHANGED' ELSE 'CHANGED' END WHEN trim(s.ctag) <> '' AND trim(r.ctag) <> '' THEN CASE WHEN s.ctag = r.ctag THEN 'UNCHANGED' ELSE 'CHANGED' END
  WHEN s.modified IS NOT NULL AND r.modified IS NOT NULL THEN CASE WHEN s.modified <> r.modified OR coalesce(s.size <> r.size, false) THEN 'CHANGED' ELSE 'UNCHANGED' END WHEN s.size <> r.size THEN 'CHANGED' ELSE 'UNKNOWN' END AS change FROM remote_saved s JOIN remote_now r USING (id)
""", ["remote_saved", "remote_now"])
def _(i):
    return lib.remote_changes(i.feed("remote_saved"), i.feed("remote_now"))


@query("eligible_drafts", """
SELECT 'k' || p_partkey AS fingerprint, CASE p_partkey % 4 WHEN 0 THEN 'SauceNAO + IQDB' WHEN 1 THEN 'IQDB' WHEN 2 THEN 'Discovery' ELSE 'SauceNAO' END AS provider_label FROM part WHERE p_size <= 40 AND NOT (p_size % 3 = 0 AND p_partkey % 2 = 0)
""")
def _(i):
    found = i.table("part").select(
        F.expr("'K' || p_partkey").alias("key"), F.expr("CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_name END").alias("title"),
        F.expr("CASE WHEN p_partkey % 2 = 1 THEN 'RJ1' ELSE '' END").alias("product_id"), F.lit(None).cast("string").alias("source_url"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN array('iqdb', ' SauceNAO ') WHEN 1 THEN array('IQDB') WHEN 2 THEN array('other') ELSE array('saucenao', 'x') END").alias("providers"),
    )
    rejected = i.table("part").filter("p_size > 40").selectExpr("'K' || p_partkey AS key", "'REJECTED' AS decision")
    return lib.eligible_drafts(found, rejected).select("fingerprint", "provider_label")


@library_query("browse_bookmarks", "SELECT i.id FROM memberships m JOIN items i ON i.id = m.item_id WHERE m.folder_id = 'f0' AND (contains(lower(title), 'the') OR contains(lower(domain), 'the'))")
def _(i):
    return lib.browse_bookmarks(lib.bookmarked_items(_library(i)), " The ", "DOMAIN").select("id")


FEEDS["profile_rows"] = "SELECT 's' || cast(l_suppkey AS string) AS session_id, 'fp' || cast(l_partkey % 70 AS string) AS fingerprint, l_shipdate IS NOT NULL AS saved, 'p' || l_linestatus AS provider, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS pos, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS part FROM {lineitem}"
COMPOSED = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, fingerprint ORDER BY part, pos) AS rn FROM profile_rows) WHERE rn = 1)"


def _composed(i):
    rows = i.feed("profile_rows").drop("saved")
    return lib.compose_profile(*[rows.filter(F.col("part") == n).drop("part") for n in range(3)])


@query("compose_profile", f"WITH {COMPOSED} SELECT session_id, fingerprint, provider, pos FROM first", ["profile_rows"])
def _(i):
    return _composed(i).select("session_id", "fingerprint", "provider", "pos")


@query("provider_counts", f"WITH {COMPOSED} SELECT session_id, provider, count(*) AS results FROM first GROUP BY ALL", ["profile_rows"])
def _(i):
    return lib.provider_counts(_composed(i))


# Snapshots and migrations.
FEEDS["snapshot_json"] = """
SELECT conv_id AS snapshot, '~"version":3,"folders":[~"id":"f","name":"F","createdAt":1!,~"name":"no id"!,~"id":"b","reserved":"BOOKMARKS"!],"sessions":[~"id":"s' || cast(conv_id AS string) || '","folderId":"f","kind":"ODD"!],"items":[~"id":"i' || cast(conv_id AS string) || '","title":"t","kind":"MANUAL_BOOKMARK","createdAt":' || cast(count(*) AS string) || '!,~"id":"x"!],"entries":[~"sessionId":"s' || cast(conv_id AS string) || '","itemId":"i' || cast(conv_id AS string) || '","position":' || cast(max(turn) AS string) || '!,~"sessionId":"gone","itemId":"i"!],"memberships":[~"itemId":"m' || cast(conv_id AS string) || '","collectionId":"f","addedAt":2!,~"itemId":"i","folderId":"none"!]!' AS body FROM {conversations} GROUP BY conv_id
"""
FEEDS["snapshot_json"] = FEEDS["snapshot_json"].replace("~", "{{").replace("!", "}}")
ROWS = """
SELECT conv_id AS snapshot, 'session' AS what, 's' || conv_id AS id, 'OFFLINE_MATCH' AS detail, 0 AS n FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, 'item', 'i' || conv_id, 'MANUAL_BOOKMARK', count(*) FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, 'entry', 'i' || conv_id, 's' || conv_id, max(turn) FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, 'member', 'm' || conv_id, 'f', 2 FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, 'folder', unnest(['f', 'b']), unnest(['PROFILE', 'RESERVED']), unnest([1, 0]) FROM conversations GROUP BY conv_id
"""


def _flat(library, key: str):
    rows = lambda df, what, id_, detail, n: df.select(F.col(key).alias("snapshot"), F.lit(what).alias("what"), F.col(id_).alias("id"), F.col(detail).alias("detail"), n.cast("long").alias("n"))
    return (
        rows(library.sessions, "session", "id", "kind", F.lit(0)).unionByName(rows(library.items, "item", "id", "kind", F.col("created_at")))
        .unionByName(rows(library.entries, "entry", "item_id", "session_id", F.col("position")))
        .unionByName(rows(library.memberships, "member", "item_id", "folder_id", F.col("added_at")))
        .unionByName(rows(library.folders, "folder", "id", "kind", F.col("created_at")))
    )


@query("read_library", ROWS)
def _(i):
    """Every snapshot is a library of its own; all of them use the same folder ids."""
    parsed = i.feed("snapshot_json").select("snapshot", F.from_json("body", store.SNAPSHOT_DDL).alias("j")).select("snapshot", "j.*")
    return _flat(store.decode_library(parsed, "snapshot"), "snapshot")


@query("read_libraries", ROWS)
def _(i):
    """The same snapshots as JSON files, one each, read from their folder."""
    base = f"{checkpoint_dir(i.spark)}/snapshots-{i.spark.range(1).select(F.uuid()).first()[0]}"
    i.feed("snapshot_json").repartition(4, "snapshot").select("snapshot", F.col("body").alias("value")).write.partitionBy("snapshot").text(base)
    rows = _flat(store.read_libraries(i.spark, base), "library")
    return rows.withColumn("snapshot", F.regexp_extract("snapshot", r"snapshot=(\d+)", 1).cast("long"))


@query("write_library", f"SELECT folder_id AS what, count(*) AS n FROM memberships GROUP BY ALL", ["memberships"])
def _(i):
    path = f"{checkpoint_dir(i.spark)}/library-{i.spark.range(1).select(F.uuid()).first()[0]}"
    store.write_library(_library(i), path)
    return store.load_library(i.spark, path).memberships.groupBy(F.col("folder_id").alias("what")).agg(F.count("*").alias("n"))


@query("migrate_library_v1", """
SELECT 'itm_' || l_orderkey || '_' || (rn - 1) AS id, 'wb:' || l_orderkey || ':B' || l_partkey || ':' || (rn - 1) AS fingerprint, CASE WHEN l_orderkey % 5 = 0 THEN '#' || (l_orderkey + 1) ELSE 'rec' || l_orderkey END AS session_title, rn - 1 AS position
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem)
""")
def _(i):
    # A legacy record is an order with its lines as matches; an order has few lines.
    match = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.concat(F.lit(" b"), F.col("l_partkey").cast("string")).alias("cell"))
    records = i.table("lineitem").groupBy(F.col("l_orderkey").alias("n")).agg(F.array_sort(F.collect_list(match)).alias("matches")).select(
        F.col("n").cast("string").alias("id"), F.when(F.col("n") % 5 == 0, " ").otherwise(F.concat(F.lit("rec"), F.col("n").cast("string"))).alias("name"),
        F.col("n").alias("created_at"), F.col("n").alias("seq"), "matches",
    )
    sessions, items, entries = store.migrate_library_v1(records)
    titled = entries.join(sessions.select(F.col("id").alias("session_id"), F.col("title").alias("session_title")), "session_id")
    return items.select(F.col("id").alias("item_id"), "fingerprint").join(titled, "item_id").select(
        F.col("item_id").alias("id"), "fingerprint", "session_title", "position"
    )


@library_query("migrate_library_v2", """
WITH w AS (SELECT m.* FROM memberships m JOIN items i ON i.id = m.item_id AND i.kind = 'WORKBOOK_MATCH' JOIN folders f ON f.id = m.folder_id), legacy AS (SELECT 'f' || r_regionkey AS id, r_name AS name, 77 + r_regionkey AS created_at FROM region)
SELECT coalesce(l.name, 'Imported scan') AS title, w.folder_id, w.item_id, row_number() OVER (PARTITION BY w.folder_id ORDER BY w.added_at, w.item_id) - 1 AS position, coalesce(l.created_at, w.added_at) AS added_at FROM w LEFT JOIN legacy l ON l.id = w.folder_id
""")
def _(i):
    base = _library(i)
    legacy = i.table("region").select(
        F.concat(F.lit("f"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), (F.col("r_regionkey") + 77).cast("long").alias("created_at")
    )
    empty = lib.Library(base.folders, base.sessions.filter("false"), base.items, base.entries.filter("false"), base.memberships)
    out = store.migrate_library_v2(empty, legacy)
    joined = out.entries.join(out.sessions.select(F.col("id").alias("session_id"), "title", "folder_id"), "session_id")
    return joined.select("title", "folder_id", "item_id", "position", "added_at")


# Exports, registry, plug-ins.
FEEDS["files"] = """
SELECT p_partkey AS n, CASE p_partkey % 9 WHEN 0 THEN p_name || ' (2).jpg' WHEN 1 THEN 'dir/' || p_name || '.jpg' WHEN 2 THEN '..\\\\..\\\\a<b>.png' WHEN 3 THEN ' ' WHEN 4 THEN '.hidden..x' ELSE p_name || '.jpg' END AS name FROM {part}
"""


@query("export_names", """
WITH s AS (SELECT n, CASE WHEN name = ' ' THEN 'image' WHEN name LIKE '%a<b>.png' THEN 'a_b_.png' WHEN name = '.hidden..x' THEN 'hidden_x' ELSE replace(name, 'dir/', '') END AS safe FROM files
), o AS (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY n) - 1 AS k FROM s
), taken AS (SELECT DISTINCT regexp_extract(safe, '^(.*) \\((\\d+)\\)(\\.[^.]*)?$', 1) || regexp_extract(safe, '^(.*) \\((\\d+)\\)(\\.[^.]*)?$', 3) AS base, regexp_extract(safe, '\\((\\d+)\\)', 1)::INT AS t FROM s WHERE regexp_matches(safe, ' \\(\\d+\\)(\\.[^.]*)?$')
), free AS (SELECT b.safe, x, row_number() OVER (PARTITION BY b.safe ORDER BY x) AS k FROM (SELECT DISTINCT safe FROM s) b, (SELECT unnest(range(1, 3000)) AS x) WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.base = b.safe AND t.t = x))
SELECT o.n, CASE WHEN o.k = 0 THEN o.safe ELSE regexp_extract(o.safe, '^(.+?)(\\.[^.]*)?$', 1) || ' (' || f.x || ')' || regexp_extract(o.safe, '^(.+?)(\\.[^.]*)?$', 2) END AS exported_file FROM o LEFT JOIN free f ON f.safe = o.safe AND f.k = o.k
""", ["files"])
def _(i):
    return exports.export_names(i.feed("files"), "name", "n").select("n", "exported_file")


@query("image_manifest", """
SELECT s_name || '.png' AS exported_file, s_name AS media_file, 'png' AS format, CASE WHEN s_acctbal >= 0 THEN floor(s_acctbal)::BIGINT::VARCHAR ELSE '' END AS bytes, '' AS width, '10' AS height, CASE WHEN s_suppkey % 2 = 0 THEN 'linked' ELSE 'unresolved' END AS status, 'S' AS worksheet, '' AS cell,
  coalesce(p_name, '') AS title, coalesce(p_brand, '') AS author, '' AS circle FROM supplier LEFT JOIN (SELECT p_partkey % 70 AS k, arg_min(p_name, p_partkey) AS p_name, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1) p ON k = s_suppkey
""")
def _(i):
    images = i.table("supplier").select(
        F.col("s_suppkey").alias("key"), F.concat("s_name", F.lit(".png")).alias("exported_file"), F.col("s_name").alias("file_name"), F.lit("png").alias("format"),
        F.floor("s_acctbal").alias("size_bytes"), F.lit(None).cast("int").alias("width"), F.lit(10).alias("height"),
        F.when(F.col("s_suppkey") % 2 == 0, "LINKED").otherwise("UNRESOLVED").alias("state"), F.lit("S").alias("sheet"), F.lit(None).cast("string").alias("cell"),
    )
    hits = i.table("part").select((F.col("p_partkey") % 70).alias("key"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.lit(None).cast("string").alias("circle"))
    return exports.image_manifest(images, hits)


FEEDS["offered_files"] = """
SELECT '/in/' || cast(p_partkey AS string) || CASE p_partkey % 5 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.XLSM' WHEN 2 THEN '.csv' ELSE '.b.xlsx' END AS path, CASE WHEN p_size = 7 THEN 0 ELSE p_size END AS size, 'h' || cast(p_partkey % 300 AS string) AS sha256, p_size % 4 <> 1 AS zip_magic FROM {part}
"""


@query("register_workbooks", """
WITH j AS (SELECT *, CASE WHEN path LIKE '%.csv' THEN 'UNSUPPORTED' WHEN size <= 0 THEN 'EMPTY' WHEN size < 4 OR NOT zip_magic THEN 'NOT_A_WORKBOOK' END AS reason, sha256 IN (SELECT 'h' || s_suppkey * 2 FROM supplier) AS saved FROM offered_files)
SELECT path, coalesce(reason, CASE WHEN saved OR path <> min(CASE WHEN reason IS NULL AND NOT saved THEN path END) OVER (PARTITION BY sha256) THEN 'ALREADY_SAVED' ELSE 'ADDED' END) AS outcome FROM j
""", ["offered_files"])
def _(i):
    registry = i.table("supplier").selectExpr("'h' || s_suppkey * 2 AS sha256")
    return workbooks.register_workbooks(i.feed("offered_files"), registry, 1).select("path", "outcome")


@query("import_workbooks", """
WITH n AS (SELECT s_nationkey AS nation, sum(octet_length(encode('PK ' || s_name)) + 1)::BIGINT AS size, sha256(string_agg('PK ' || s_name || chr(10), '' ORDER BY s_suppkey)) AS sha FROM supplier GROUP BY ALL)
SELECT 'a' AS folder, nation, size, sha AS sha256, 'ADDED' AS outcome, 1 AS imported_at FROM n WHERE nation % 2 = 0
UNION ALL SELECT 'b', nation, size, sha, CASE WHEN nation % 2 = 0 THEN 'ALREADY_SAVED' ELSE 'ADDED' END, 2 FROM n UNION ALL SELECT 'c', nation, size, sha, 'UNSUPPORTED', 2 FROM n WHERE nation % 3 = 0
""")
def _(i):
    """Files of suppliers' names by nation: a first pass over some nations, a second one over all, some with another suffix."""
    base = f"{checkpoint_dir(i.spark)}/books-{i.spark.range(1).select(F.uuid()).first()[0]}"
    lines = i.table("supplier").select("s_nationkey", "s_suppkey", F.concat(F.lit("PK "), "s_name").alias("line"))

    def save(rows, folder: str, suffix: str) -> None:
        ordered = rows.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey").drop("s_suppkey")
        ordered.write.partitionBy("s_nationkey").option("extension", suffix).csv(f"{base}/in/{folder}")

    where = [f"{base}/in", f"{base}/registry", f"{base}/state"]
    save(lines.filter("s_nationkey % 2 = 0"), "a", "xlsx")
    workbooks.import_workbooks(i.spark, *where, at=1, files_per_batch=5)
    save(lines, "b", "xlsx")
    save(lines.filter("s_nationkey % 3 = 0"), "c", "txt")
    found = workbooks.import_workbooks(i.spark, *where, at=2)
    part = lambda pattern: F.regexp_extract("path", pattern, 1)
    return found.select(part("/in/([abc])/").alias("folder"), part("s_nationkey=(\\d+)").cast("int").alias("nation"), "size", "sha256", "outcome", F.col("imported_at").cast("int").alias("imported_at"))


@query("list_workbooks", "SELECT c_custkey AS id FROM customer")
def _(i):
    books = i.table("customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_nationkey") == 3).alias("pinned"), F.when(F.col("c_acctbal") > 0, F.col("c_custkey") % 100).alias("last_opened"), (F.col("c_custkey") % 9).alias("imported_at")
    )
    return workbooks.list_workbooks(books).select("id")


@query("total_bytes", "SELECT count(*) AS workbooks, sum(c_custkey) AS bytes FROM customer")
def _(i):
    return workbooks.total_bytes(i.table("customer").select(F.col("c_custkey").alias("size")))


def _length_model():
    import numpy as np

    return lambda texts: np.array([[len(t), t.count("e"), 1.0] for t in texts], dtype="float32")


@query("with_embedding", "SELECT doc_id, length(text) AS a, length(text) - length(replace(text, 'e', '')) AS b FROM documents")
def _(i):
    model = plugins.Embedder(_length_model, 3, "length-v1")
    rows = plugins.with_embedding(i.table("documents").select("doc_id", "text"), "text", model)
    return rows.select("doc_id", F.col("embedding")[0].cast("long").alias("a"), F.col("embedding")[1].cast("long").alias("b"))


def _echo(text: str, limit: int):
    if "bolt" in text:
        raise ConnectionError("refused")
    return ("FOUND" if "ring" in text else "NO_RESULTS"), '{"q": 1}', limit


@query("provider_answers", """
SELECT p_partkey::VARCHAR AS search, p.provider, CASE WHEN contains(p_name, 'bolt') THEN 'FAILED' WHEN contains(p_name, 'ring') THEN 'FOUND' ELSE 'NO_RESULTS' END AS outcome, CASE WHEN contains(p_name, 'bolt') THEN 'ConnectionError' END AS failure, CASE WHEN contains(p_name, 'bolt') THEN 0 ELSE p.hits END AS hits, p.timeout_ms
FROM part CROSS JOIN (SELECT 'echo' AS provider, 5 AS hits, 20000 AS timeout_ms UNION ALL SELECT 'pictures', 3, 500) p
""")
def _(i):
    known = plugins.Providers()
    known.register_provider("echo", _echo)
    known.register_reverse_provider("pictures", _echo, priority=1, timeout_ms=500, max_results=3)
    known.register_reverse_provider("later", _echo, priority=2, ready=False)
    asked = i.table("part").select(F.col("p_partkey").alias("search"), F.col("p_name").alias("query"))
    return known.answers(asked).select("search", "provider", "outcome", "failure", "hits", "timeout_ms")


# The capture stream: events as frames of the user's device.
FEEDS["frames"] = """
SELECT CASE WHEN user_id % 40 <> 7 THEN user_id END AS device, ts, event_id, CASE WHEN value < 8 THEN 20.0 ELSE 60.0 END AS blur, CASE event_type WHEN 'error' THEN CASE WHEN value > 60 THEN 10.0 ELSE 120.0 END WHEN 'signup' THEN CASE WHEN value > 80 THEN 250.0 ELSE 120.0 END ELSE 120.0 END AS mean_lum,
  CASE WHEN value > 150 THEN event_id * 2654435761 ELSE cast(floor(event_id / 4000) AS bigint) * 1023 + event_id % 4 END AS signature FROM {events}
"""


@query("frame_gates", """
SELECT event_id, blur >= 40 AS sharp, mean_lum < 45 AS too_dark, mean_lum > 215 AS too_bright, NOT (mean_lum < 45 OR mean_lum > 215) AS lit, round(least(blur / 80, 1), 6) AS sharpness, round(mean_lum / 255, 6) AS brightness FROM frames
""", ["frames"])
def _(i):
    gates = capture.frame_gates(i.feed("frames"))
    return gates.select("event_id", "sharp", "too_dark", "too_bright", "lit", F.round("sharpness", 6).alias("sharpness"), F.round("brightness", 6).alias("brightness"))


# The state machine step by step: one recursion per frame of a device.
TICKS_SQL = """
WITH RECURSIVE f AS (
  SELECT device, epoch_us(ts) AS ts_us, epoch_ms(ts) AS now, signature AS sig, row_number() OVER (PARTITION BY device ORDER BY epoch_ms(ts), signature) AS rn,
    CASE WHEN blur >= 40 THEN CASE WHEN mean_lum < 45 THEN 'TOO_DARK' WHEN mean_lum > 215 THEN 'TOO_BRIGHT' ELSE 'OK' END ELSE 'HOLD_STILL' END AS gate FROM frames
), run AS (
  SELECT device, 0::BIGINT AS rn, NULL::BIGINT AS ts_us, NULL::BIGINT AS last_seen, NULL::BIGINT AS previous, 0 AS stable, 0::BIGINT AS cooldown, NULL::BIGINT AS accepted, 0 AS bad, 0 AS streak, 'CAPTURED' AS outcome, false AS steady,
    ''::VARCHAR AS t_phase, 0 AS t_stable, false AS t_capture, false AS t_steady, NULL::BIGINT AS t_signature FROM (SELECT DISTINCT device FROM f)
  UNION ALL
  SELECT device, rn, ts_us, now, CASE WHEN cool THEN previous WHEN gate <> 'OK' THEN CASE WHEN streak + 1 > 1 THEN NULL ELSE previous END WHEN up < 3 THEN sig END,
    CASE WHEN cool THEN stable WHEN gate <> 'OK' THEN CASE WHEN streak + 1 > 1 THEN 0 ELSE stable END WHEN up < 3 THEN up ELSE 0 END,
    CASE WHEN NOT cool AND gate = 'OK' AND up >= 3 THEN now + 1500 ELSE cooldown END,
    CASE WHEN cool THEN accepted WHEN gate <> 'OK' THEN CASE WHEN bad + 1 >= 5 THEN NULL ELSE accepted END WHEN up < 3 OR known THEN accepted ELSE sig END,
    CASE WHEN cool THEN bad WHEN gate <> 'OK' THEN CASE WHEN bad + 1 >= 5 THEN 0 ELSE bad + 1 END ELSE 0 END, CASE WHEN cool THEN streak WHEN gate <> 'OK' THEN streak + 1 ELSE 0 END,
    CASE WHEN NOT cool AND gate = 'OK' AND up >= 3 THEN CASE WHEN known THEN 'SAME_COVER' ELSE 'CAPTURED' END ELSE outcome END, CASE WHEN cool THEN steady WHEN gate <> 'OK' THEN false ELSE still END,
    CASE WHEN cool THEN outcome WHEN gate <> 'OK' THEN gate WHEN up < 3 THEN 'STABILIZING' WHEN known THEN 'SAME_COVER' ELSE 'CAPTURED' END,
    CASE WHEN cool THEN 0 WHEN gate <> 'OK' THEN CASE WHEN streak + 1 > 1 THEN 0 ELSE stable END WHEN up < 3 THEN up WHEN known THEN 0 ELSE 3 END,
    NOT cool AND gate = 'OK' AND up >= 3 AND NOT known, CASE WHEN cool THEN steady WHEN gate <> 'OK' THEN false ELSE still END, CASE WHEN NOT cool AND gate = 'OK' THEN sig END
  FROM (SELECT *, now < cooldown AS cool, CASE WHEN still THEN stable + 1 ELSE 0 END AS up, coalesce(bit_count(xor(accepted, sig)) <= 8, false) AS known
    FROM (SELECT *, coalesce(bit_count(xor(previous, sig)) <= 4, false) AS still FROM (
      SELECT f.device, f.rn, f.ts_us, f.now, f.sig, f.gate, CASE WHEN gone THEN NULL ELSE previous END AS previous, CASE WHEN gone THEN 0 ELSE stable END AS stable, CASE WHEN gone THEN 0 ELSE cooldown END AS cooldown,
        CASE WHEN gone THEN NULL ELSE accepted END AS accepted, CASE WHEN gone THEN 0 ELSE bad END AS bad, CASE WHEN gone THEN 0 ELSE streak END AS streak, CASE WHEN gone THEN 'CAPTURED' ELSE outcome END AS outcome, NOT gone AND steady AS steady
      FROM (SELECT r.*, n.now - r.last_seen > 600000 AND r.last_seen IS NOT NULL AS gone FROM run r JOIN f n ON n.device IS NOT DISTINCT FROM r.device AND n.rn = r.rn + 1) r
      JOIN f ON f.device IS NOT DISTINCT FROM r.device AND f.rn = r.rn + 1)))
)
SELECT device, ts_us, t_phase AS phase, t_stable AS stable_count, t_capture AS capture, t_steady AS steady, t_signature AS signature FROM run WHERE rn > 0
"""


def _ticks(ticks):
    return ticks.select("device", F.unix_micros("ts").alias("ts_us"), "phase", "stable_count", "capture", "steady", "signature")


@query("capture_events_batch", TICKS_SQL, ["frames"])
def _(i):
    return _ticks(capture.capture_events_batch(i.feed("frames")))


@query("capture_events", TICKS_SQL, ["frames"])
def _(i):
    """The frames as a file stream, run to its end; equals the batch twin."""
    spark, mark = i.spark, i.spark.range(1).select(F.uuid()).first()[0]
    base = f"{checkpoint_dir(spark)}/capture-{mark}"
    frames = i.feed("frames").select("device", "ts", "blur", "mean_lum", "signature")
    frames.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(frames.schema).parquet(f"{base}/in")
    ticks = capture.capture_events(stream)
    run = (
        ticks.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return _ticks(spark.read.schema(ticks.schema).parquet(f"{base}/out"))
