"""Queries over notes, images, entries, timelines, analytics, health and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from colophon.operators import analytics, compare, facets, health, images, mapping, tables, timeline
from colophon.plans.inputs import FEEDS, Inputs, query
from colophon.plans.tables import MAPPING, MAPPING_FEEDS, Workbook, book_query, strip_sql
from colophon.sources.cells import SHEET

PART_ROW = "3 + p_partkey % 400 + CASE WHEN p_partkey % 400 >= 200 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 400 >= 350 THEN 1 ELSE 0 END"
PART_SHEET = "'Parts ' || cast(cast(floor(p_partkey / 400) AS bigint) AS string)"
PART_KEY = "'xl/parts' || cast(cast(floor(p_partkey / 400) AS bigint) AS string) || '.xml'"

FEEDS["comments"] = f"""
SELECT p_partkey AS comment_id, 'book' AS workbook, {PART_KEY} AS sheet_key, {PART_SHEET} AS sheet,
  cast({PART_ROW} AS int) AS row, 1 AS col, chr(10) || 'Note on ' || p_name || chr(10) || 'size ' || cast(p_size AS string) AS text,
  p_brand AS author, cast(floor(p_partkey / 400) AS int) AS sheet_order
FROM {{part}}
UNION ALL SELECT 10000000 + s_suppkey, 'book', 'name:Suppliers ' || cast(cast(floor(s_suppkey / 50) AS bigint) AS string),
  'Suppliers ' || cast(cast(floor(s_suppkey / 50) AS bigint) AS string), cast(1 + s_suppkey % 50 AS int), 1, 'about ' || s_name, 'editor', 1000 FROM {{supplier}}
"""
FEEDS["shapes"] = f"""
SELECT p_partkey AS shape_id, 'book' AS workbook, {PART_KEY} AS sheet_key, {PART_SHEET} AS sheet,
  cast({PART_ROW} + CASE WHEN p_partkey % 17 = 0 THEN 10000 ELSE 0 END AS int) AS row, 1 AS col, p_partkey AS pos FROM {{part}}
UNION ALL SELECT 20000000 + p_partkey, 'book', {PART_KEY}, {PART_SHEET}, cast({PART_ROW} AS int), 1, 20000000 + p_partkey FROM {{part}} WHERE p_size < 10
UNION ALL SELECT 30000000 + c_custkey, 'book', 'xl/customers' || cast(cast(floor(c_custkey / 500) AS bigint) AS string) || '.xml',
  'Customers ' || cast(cast(floor(c_custkey / 500) AS bigint) AS string), cast(1 + c_custkey % 500 AS int), 1, 30000000 + c_custkey FROM {{customer}}
"""
FEEDS["refs"] = """
SELECT l_partkey AS shape_id, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_returnflag = 'N' THEN 'RELID' ELSE 'SRC' END AS kind,
  CASE WHEN l_returnflag = 'N' THEN 'rId' || cast(l_suppkey + l_linenumber AS string)
    WHEN l_linenumber = 1 OR l_partkey % 3 = 0 THEN 'http://x.example/' || cast(l_suppkey AS string) || '.png'
    WHEN l_linenumber = 2 THEN '../../../up' || cast(l_suppkey AS string) || '.png' ELSE '../media/./image' || cast(l_suppkey AS string) || '.png' END AS reference,
  'xl/drawings/notes.vml' AS part
FROM {lineitem}
"""
FEEDS["drawing_rels"] = """
SELECT 'xl/drawings/notes.vml' AS part, 'rId' || cast(s_suppkey AS string) AS rel_id,
  CASE WHEN s_suppkey % 5 = 4 THEN '/xl/media/image' || cast(s_suppkey AS string) || '.png' ELSE '../media/image' || cast(s_suppkey AS string) || '.png' END AS target,
  s_acctbal > 8000 AS external FROM {supplier}
"""
FEEDS["media"] = """
SELECT CASE WHEN s_suppkey % 10 = 9 THEN 'xl/media/spare' || cast(s_suppkey AS string) || '.JPG' ELSE 'xl/media/image' || cast(s_suppkey AS string) || '.png' END AS path,
  cast(floor(s_acctbal) AS bigint) AS size_bytes FROM {supplier}
"""

REFS = """
judged AS (
  SELECT j.*, CASE WHEN detail IS NULL THEN wanted END AS media_path FROM (
    SELECT q.*, CASE WHEN kind = 'SRC' AND contains(reference, '://') THEN 'external reference, not a package part'
        WHEN kind = 'SRC' AND wanted LIKE '../%' THEN 'not a valid package path'
        WHEN kind = 'RELID' AND target IS NULL THEN 'relationship ''' || reference || ''' is not declared by this drawing'
        WHEN kind = 'RELID' AND external THEN 'external relationship'
        WHEN m.path IS NULL THEN 'the package has no part ''' || wanted || '''' END AS detail
    FROM (SELECT r.*, d.target, d.external, CASE WHEN kind = 'RELID' THEN replace(ltrim(d.target, '/'), '../media', 'xl/media')
        ELSE replace(replace(replace(reference, '/./', '/'), '../media', 'xl/media'), '../../../', '../') END AS wanted
      FROM refs r LEFT JOIN drawing_rels d ON d.part = r.part AND d.rel_id = r.reference) q LEFT JOIN media m ON m.path = q.wanted) j
), kept AS (
  SELECT * FROM judged j WHERE kind = 'SRC' OR NOT EXISTS (SELECT 1 FROM judged x WHERE x.shape_id = j.shape_id AND x.kind = 'SRC' AND x.media_path IS NOT NULL)
), media_refs AS (
  SELECT shape_id, pos, kind, reference, media_path, detail FROM (
    SELECT *, row_number() OVER (PARTITION BY shape_id, coalesce(media_path, kind || ':' || reference) ORDER BY CASE kind WHEN 'SRC' THEN 0 ELSE 1 END, pos) AS rn FROM kept) WHERE rn = 1
), first_shapes AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_key, row, col ORDER BY pos) AS rn FROM shapes) WHERE rn = 1
), matched AS (
  SELECT c.*, s.shape_id FROM comments c LEFT JOIN first_shapes s USING (sheet_key, row, col)
), notes AS (
  SELECT m.*, r.pos, r.kind, r.reference, r.media_path, r.detail FROM matched m JOIN media_refs r USING (shape_id)
), places AS (
  SELECT coalesce(media_path, 'unresolved:' || sheet || '!' || chr(65 + col) || (row + 1) || ':' || reference) AS key, 'book' AS workbook, sheet_key, sheet, row, col,
    chr(65 + col) || (row + 1) AS cell, trim(split_part(text, chr(10), 2)) AS preview, pos, media_path, reference, detail FROM notes
), first_places AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS rn, count(*) OVER (PARTITION BY key) AS n FROM places) WHERE rn = 1
), images AS (
  SELECT m.path AS key, m.path AS media_path, replace(m.path, 'xl/media/', '') AS file_name, CASE WHEN m.path LIKE '%.JPG' THEN 'jpeg' ELSE 'png' END AS format, m.size_bytes,
    CASE WHEN f.key IS NULL THEN 'UNREFERENCED' ELSE 'LINKED' END AS state, NULL AS detail, f.sheet, f.cell, coalesce(f.n, 0) AS places
  FROM media m LEFT JOIN first_places f ON f.key = m.path
  UNION ALL SELECT key, NULL, reference, 'unknown', -1, 'UNRESOLVED', detail, sheet, cell, n FROM first_places WHERE media_path IS NULL
)"""
IMAGE_FEEDS = ["comments", "shapes", "refs", "drawing_rels", "media"]
HITS = """
, record_rows AS (SELECT DISTINCT workbook, sheet_key, sheet, row FROM tcells
), hits AS (
  SELECT p.key, p.sheet_key, p.sheet, p.row, min(p.pos) AS pos FROM places p JOIN record_rows r USING (sheet_key, row) GROUP BY ALL
), per_record AS (
  SELECT sheet_key, row, count(*) AS images, sum(CASE WHEN state = 'LINKED' THEN 1 ELSE 0 END) AS verified,
    min(CASE WHEN state = 'LINKED' THEN media_path END) AS cover_path, sum(CASE WHEN state = 'UNRESOLVED' THEN 1 ELSE 0 END) AS unresolved_images
  FROM (SELECT DISTINCT h.sheet_key, h.row, i.media_path, i.detail, i.state FROM hits h JOIN images i USING (key)) GROUP BY ALL
), covered AS (
  SELECT e.*, coalesce(p.images, 0) AS images, coalesce(p.verified, 0) > 0 AS verified_cover, p.cover_path, coalesce(p.unresolved_images, 0) AS unresolved_images
  FROM entries e LEFT JOIN per_record p USING (sheet_key, row)
)"""
CATALOG = f"{MAPPING}, {REFS}{HITS}"


class Catalog(Workbook):
    """The workbook with its notes and images."""

    def __init__(self, inputs: Inputs):
        super().__init__(inputs)
        self.comments = inputs.feed("comments")
        self.matched = lambda: images.match_comments_to_shapes(self.comments, inputs.feed("shapes"))

    def media_refs(self):
        i = self.inputs
        return images.resolve_media_refs(i.feed("refs"), i.feed("drawing_rels"), i.feed("media"))

    def notes(self):
        return self.matched().join(self.media_refs(), "shape_id")

    def places(self):
        return self.inputs.keep("places", lambda: images.image_places(self.notes()))

    def images(self):
        return self.inputs.keep("images", lambda: images.image_index(self.inputs.feed("media"), self.places()))

    def hits(self):
        return self.inputs.keep("hits", lambda: images.image_hits(self.places(), self.table))

    def covered(self):
        def build():
            rows = self.hits().join(self.images().select("key", "media_path", "state", "detail"), "key")
            return mapping.attach_images(self.entries(), rows)

        return self.inputs.keep("entries", build)


def image_query(name: str, sql: str):
    return query(name, f"WITH {REFS}{sql}", IMAGE_FEEDS)


def catalog_query(name: str, sql: str, more: list[str] | None = None):
    return query(name, f"WITH {CATALOG}{sql}", [*MAPPING_FEEDS, *IMAGE_FEEDS, *(more or [])])


@image_query("match_comments_to_shapes", "SELECT comment_id, sheet_key, row, col, shape_id FROM matched")
def _(i):
    return images.match_comments_to_shapes(i.feed("comments"), i.feed("shapes")).select(
        "comment_id", "sheet_key", "row", "col", "shape_id"
    )


@image_query("shape_diagnostics", """
SELECT sheet_key, 'SECOND_SHAPE' AS problem, row, col, 1 AS n FROM (SELECT *, row_number() OVER (PARTITION BY sheet_key, row, col ORDER BY pos) AS rn FROM shapes) WHERE rn > 1
UNION ALL SELECT f.sheet_key, 'SHAPE_WITHOUT_COMMENT', f.row, f.col, 1 FROM first_shapes f WHERE f.sheet_key IN (SELECT sheet_key FROM comments)
  AND NOT EXISTS (SELECT 1 FROM comments c WHERE c.sheet_key = f.sheet_key AND c.row = f.row AND c.col = f.col)
UNION ALL SELECT sheet_key, 'NO_COMMENTS_PART', NULL, NULL, count(*) FROM first_shapes WHERE sheet_key NOT IN (SELECT sheet_key FROM comments) GROUP BY sheet_key
UNION ALL SELECT DISTINCT sheet_key, 'NO_DRAWING', NULL::INT, NULL::INT, 1 FROM comments WHERE sheet_key NOT IN (SELECT sheet_key FROM shapes)
""")
def _(i):
    return images.shape_diagnostics(i.feed("comments"), i.feed("shapes")).drop("workbook", "sheet")


@image_query("resolve_media_refs", "SELECT * FROM media_refs")
def _(i):
    return images.resolve_media_refs(i.feed("refs"), i.feed("drawing_rels"), i.feed("media"))


@image_query("image_index", "SELECT key, media_path, file_name, format, size_bytes, state, detail, sheet, cell, places FROM images")
def _(i):
    return Catalog(i).images()


@image_query("comment_state", """
SELECT c.comment_id, CASE WHEN count(n.media_path) > 0 THEN 'WITH_IMAGES' WHEN count(n.pos) > 0 THEN 'UNRESOLVED_IMAGE' ELSE 'TEXT_ONLY' END AS state
FROM comments c LEFT JOIN notes n USING (comment_id) GROUP BY ALL
""")
def _(i):
    c = Catalog(i)
    return images.comment_state(c.comments, c.notes())


@image_query("comment_counts", """
SELECT count(*) AS comments, count(*) FILTER (resolved > 0) AS with_images, count(*) FILTER (resolved = 0 AND refs > 0) AS unresolved_image, count(*) FILTER (refs = 0) AS text_only
FROM (SELECT c.comment_id, count(n.media_path) AS resolved, count(n.pos) AS refs FROM comments c LEFT JOIN notes n USING (comment_id) GROUP BY ALL)
""")
def _(i):
    c = Catalog(i)
    return images.comment_counts(images.comment_state(c.comments, c.notes()))


FEEDS["placed"] = """
SELECT l_orderkey * 10 + l_linenumber AS image_id, CASE WHEN l_returnflag = 'R' THEN 'FLOATING' ELSE 'NOTE' END AS kind,
  cast(l_partkey % 60 AS int) AS row, cast(l_suppkey % 30 AS int) AS col, l_orderkey * 10 + l_linenumber AS pos FROM {lineitem}
"""


@query("place_images", """
WITH inside AS (SELECT * FROM placed WHERE row BETWEEN 4 AND 39 AND col BETWEEN 1 AND 19),
both_kinds AS (SELECT * FROM inside WHERE kind = 'FLOATING' UNION ALL SELECT * FROM inside WHERE kind = 'NOTE')
SELECT chr(65 + col) || (row + 1) AS cell, row, col, image_id, kind FROM (
  SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY CASE kind WHEN 'FLOATING' THEN 0 ELSE 1 END, pos) AS rn FROM both_kinds) WHERE rn = 1
""", ["placed"])
def _(i):
    return images.place_images(i.feed("placed"), "T40:$B$5")


@query("range_filter", "SELECT image_id, row, col FROM placed WHERE row BETWEEN 1 AND 9 AND col BETWEEN 0 AND 27", ["placed"])
def _(i):
    from colophon.functions.cellref import range_filter

    return range_filter(i.feed("placed"), "AB2:A10").select("image_id", "row", "col")


@catalog_query("image_hits", "SELECT key, sheet_key, row, pos FROM hits")
def _(i):
    c = Catalog(i)
    return images.image_hits(c.places(), c.table).select("key", "sheet_key", "row", "pos")


@catalog_query("image_coverage", """
SELECT count(*) AS records, count(*) FILTER (covered) AS with_image, count(*) FILTER (NOT covered) AS without_image,
  (SELECT count(*) FROM images WHERE state = 'UNRESOLVED') AS unresolved, (SELECT count(*) FROM images WHERE state = 'UNREFERENCED') AS unreferenced
FROM (SELECT r.*, EXISTS (SELECT 1 FROM hits h JOIN images m USING (key) WHERE m.state = 'LINKED' AND h.sheet_key = r.sheet_key AND h.row = r.row) AS covered FROM record_rows r)
""")
def _(i):
    c = Catalog(i)
    return images.image_coverage(c.table.select(*SHEET, "row").distinct(), c.images(), c.hits())


@catalog_query("query_images", """
, named_keys AS (SELECT DISTINCT h.key FROM hits h JOIN tcells t ON t.sheet_key = h.sheet_key AND t.row = h.row WHERE contains(lower(t.text), 'ring')),
placed_at AS (SELECT DISTINCT key FROM places WHERE contains(lower(sheet), 'ring') OR contains(lower(cell), 'ring') OR contains(lower(preview), 'ring')),
typed AS (SELECT DISTINCT h.key FROM hits h JOIN tcells t ON t.sheet_key = h.sheet_key AND t.row = h.row WHERE t.sheet = 'Parts 0' AND t.col = 3 AND t.shown = 'SMALL')
SELECT key, state FROM images WHERE state IN ('LINKED', 'UNRESOLVED') AND (key IN (FROM named_keys) OR key IN (FROM placed_at) OR contains(lower(file_name), 'ring') OR contains(lower(detail), 'ring')) AND key IN (FROM typed)
""")
def _(i):
    c = Catalog(i)
    return images.query_images(
        c.images(), c.places(), c.hits(), c.table, needle=" RING", states=["LINKED", "UNRESOLVED"],
        facets=[("Parts 0", 3, "SMALL")], sort="CELL", ascending=False,
    ).select("key", "state")


@catalog_query("source_location", """
SELECT i.key, CASE WHEN state = 'LINKED' THEN CASE WHEN n > 0 THEN 'VERIFIED' ELSE 'UNKNOWN' END ELSE state END AS location, CASE WHEN state = 'LINKED' THEN coalesce(n, 0) ELSE 0 END AS destinations
FROM images i LEFT JOIN (SELECT key, count(DISTINCT sheet_key || '!' || cell) AS n FROM places WHERE sheet_key IN (SELECT sheet_key FROM header_rows WHERE sheet <> 'Parts 1') GROUP BY key) p USING (key)
""")
def _(i):
    c = Catalog(i)
    return images.source_location(c.images(), c.places(), c.headers.filter("sheet <> 'Parts 1'"))


@catalog_query("attach_images", "SELECT id, images, verified_cover, cover_path, unresolved_images FROM covered")
def _(i):
    return Catalog(i).covered().select("id", "images", "verified_cover", "cover_path", "unresolved_images")


@catalog_query("browse_records", """
SELECT r.sheet_key, r.row, EXISTS (SELECT 1 FROM hits h JOIN images m USING (key) WHERE m.state = 'LINKED' AND h.sheet_key = r.sheet_key AND h.row = r.row) AS has_image
FROM (SELECT DISTINCT sheet_key, row FROM tcells WHERE contains(lower(text), 'o') OR contains(lower(shown), 'o')) r
""")
def _(i):
    c = Catalog(i)
    return facets.browse_records(c.table, c.hits(), c.images(), "O").select("sheet_key", "row", "has_image")


OPTIONAL_MISSING = " + ".join(f"CASE WHEN {f}_state = 'MISSING' THEN 1 ELSE 0 END" for f in facets.OPTIONAL)


@catalog_query("gallery", f"""
SELECT id FROM covered WHERE ({OPTIONAL_MISSING}) > 0 AND verified_cover AND (contains(lower(title_text), 'blue') OR contains(lower(circle_text), 'blue') OR contains(lower(artist_text), 'blue')
  OR contains(lower(identifier_text), 'blue') OR contains(lower(url_text), 'blue') OR contains(lower(sheet || '!' || (row + 1)), 'blue'))
""")
def _(i):
    return facets.gallery(Catalog(i).covered(), needle="Blue", cover=True, missing_metadata=True, sort="CIRCLE").select("id")


@catalog_query("missing_metadata_count", f"SELECT id, {OPTIONAL_MISSING} AS missing FROM covered")
def _(i):
    return Workbook(i).entries().select("id", facets.missing_metadata_count().alias("missing"))


# Dates: the chosen column of a sheet, read at the precision it is written in.
FEEDS["date_choices"] = """
SELECT 'book' AS workbook, 'xl/parts' || cast(cast(floor(p_partkey / 400) AS bigint) AS string) || '.xml' AS sheet_key,
  CASE WHEN min(p_partkey) % 1200 = 800 THEN 'Gone' ELSE ' 発行日 ' END AS published_header, 'ACQUIRED on' AS acquired_header FROM {part} GROUP BY cast(floor(p_partkey / 400) AS bigint)
UNION ALL SELECT DISTINCT 'book', 'name:Suppliers ' || cast(cast(floor(s_suppkey / 50) AS bigint) AS string), 'title', 'price' FROM {supplier}
"""


def date_sql(c: str) -> str:
    """Year, month, day and order key of a text in SQL; serial numbers included."""
    t = strip_sql(c)
    y, m = f"try_cast(regexp_extract({t}, '^(\\d{{4}})', 1) AS int)", "'^\\d{4}\\s*[-/.年]\\s*(\\d{1,2})\\s*月?$'"
    d = "'^\\d{4}\\s*[-/.年]\\s*(\\d{1,2})\\s*[-/.月]\\s*(\\d{1,2})\\s*日?$'"
    mm, dm, dd = (f"try_cast(regexp_extract({t}, {p}, {g}) AS int)" for p, g in ((m, 1), (d, 1), (d, 2)))
    s = f"try_cast(regexp_extract({t}, '^(\\d{{5,7}})(\\.\\d+)?$', 1) AS int)"
    return (
        f"CASE WHEN regexp_full_match({t}, '\\d{{4}}\\s*年?') THEN CASE WHEN {y} BETWEEN 1900 AND 2100 THEN {y} * 10000 END "
        f"WHEN {mm} IS NOT NULL THEN CASE WHEN {y} BETWEEN 1900 AND 2100 AND {mm} BETWEEN 1 AND 12 THEN {y} * 10000 + {mm} * 100 END "
        f"WHEN {dd} IS NOT NULL THEN CASE WHEN {y} BETWEEN 1900 AND 2100 AND try_cast({y} || '-' || {dm} || '-' || {dd} AS date) IS NOT NULL THEN {y} * 10000 + {dm} * 100 + {dd} END "
        f"WHEN {s} BETWEEN 10000 AND 2958465 THEN CASE WHEN year(DATE '1899-12-30' + {s}) BETWEEN 1900 AND 2100 THEN cast(strftime(DATE '1899-12-30' + {s}, '%Y%m%d') AS int) END END"
    )


def chosen_sql(header: str) -> str:
    norm = "regexp_replace(lower({}), '\\s+', ' ', 'g')"
    return f"""
, known_names AS (SELECT workbook, sheet_key, {norm.format(strip_sql('name'))} AS norm, count(*) AS matches, min(col) AS col FROM cols GROUP BY ALL
), chosen AS (
  SELECT s.workbook, s.sheet_key, s.sheet, d.header, coalesce(k.matches, 0) AS matches, CASE WHEN k.matches = 1 THEN k.col END AS col
  FROM sheet_list s LEFT JOIN (SELECT workbook, sheet_key, {strip_sql(header)} AS header FROM date_choices WHERE {strip_sql(header)} <> '') d USING (workbook, sheet_key)
  LEFT JOIN known_names k ON k.sheet_key = s.sheet_key AND k.norm = {norm.format(strip_sql('d.header'))}
), readings AS (SELECT t.sheet_key, t.row, t.text AS raw, {date_sql('t.text')} AS sort_key FROM tcells t JOIN chosen c USING (sheet_key, col)
), dated AS (
  SELECT e.id, e.sheet_key, e.sheet, e.row, e.title_text, e.circle_text, e.artist_text, e.identifier_text, e.default_order_text, e.cover_path, r.sort_key
  FROM covered e LEFT JOIN readings r USING (sheet_key, row)
)"""


INSPECT = """
SELECT c.sheet_key, c.header, c.col, CASE WHEN c.header IS NULL THEN 'NOT_SET' WHEN c.matches = 0 THEN 'HEADER_MISSING' WHEN c.matches > 1 THEN 'HEADER_AMBIGUOUS'
    WHEN coalesce(r.readable, 0) > 0 THEN 'READY' ELSE 'NO_READABLE_DATES' END AS state,
  CASE WHEN c.matches = 1 THEN coalesce(r.readable, 0) ELSE 0 END AS readable, CASE WHEN c.matches = 1 THEN n.records - coalesce(r.filled, 0) ELSE 0 END AS blank,
  CASE WHEN c.matches = 1 THEN coalesce(r.filled, 0) - coalesce(r.readable, 0) ELSE 0 END AS malformed
FROM chosen c LEFT JOIN (SELECT sheet_key, count(sort_key) AS readable, count(*) AS filled FROM readings GROUP BY ALL) r USING (sheet_key)
LEFT JOIN (SELECT sheet_key, count(DISTINCT row) AS records FROM tcells GROUP BY ALL) n USING (sheet_key)
"""
for _mode, _header in timeline.MODES.items():

    @catalog_query(f"inspect_date_columns_{_mode.lower()}", chosen_sql(_header) + INSPECT, ["date_choices"])
    def _(i, mode=_mode):
        c = Workbook(i)
        return timeline.inspect_date_columns(c.table, c.columns, i.feed("date_choices"), mode).drop("workbook", "sheet")


@catalog_query("date_samples", chosen_sql("published_header") + """
SELECT sheet_key, n, raw, sort_key FROM (SELECT *, row_number() OVER (PARTITION BY sheet_key ORDER BY row) AS n FROM readings) WHERE n <= 4
""", ["date_choices"])
def _(i):
    from colophon.functions.dates import parse_partial_date

    c = Workbook(i)
    samples = timeline.date_samples(c.table, c.columns, i.feed("date_choices"), "PUBLICATION")
    return samples.select("sheet_key", "n", "raw", parse_partial_date(F.col("raw"), True)["sort_key"].alias("sort_key"))


def _timeline(i, mode="PUBLICATION"):
    c = Catalog(i)
    return timeline.timeline(c.covered(), c.table, c.columns, i.feed("date_choices"), mode)


@catalog_query("timeline_published", chosen_sql("published_header") + """
SELECT id, sort_key, circle_text AS circle, cover_path FROM dated WHERE sort_key IS NOT NULL
""", ["date_choices"])
def _(i):
    return timeline.order_dated(_timeline(i)).select("id", "date.sort_key", "circle", "cover_path")


@catalog_query("timeline_acquired", chosen_sql("acquired_header") + """
SELECT id, sort_key FROM dated WHERE sort_key IS NOT NULL
""", ["date_choices"])
def _(i):
    return timeline.order_dated(_timeline(i, "ACQUISITION"), ascending=True).select("id", "date.sort_key")


@catalog_query("timeline_undated", chosen_sql("published_header") + "SELECT id FROM dated WHERE sort_key IS NULL", ["date_choices"])
def _(i):
    return timeline.order_undated(_timeline(i)).select("id")


@catalog_query("timeline_sections", chosen_sql("published_header") + """
SELECT sort_key // 10000 AS year, count(*) AS entries, min(sort_key) AS first_key, max(sort_key) AS last_key FROM dated WHERE sort_key IS NOT NULL GROUP BY ALL
""", ["date_choices"])
def _(i):
    return timeline.timeline_sections(_timeline(i))


@catalog_query("timeline_counts", chosen_sql("published_header") + """
SELECT count(sort_key) AS dated, count(*) - count(sort_key) AS undated FROM dated
""", ["date_choices"])
def _(i):
    return timeline.timeline_counts(_timeline(i))


IN_TIMELINE = " OR ".join(f"contains(lower({c}), 'bolt')" for c in (
    "title_text", "circle_text", "artist_text", "identifier_text", "sheet || '!' || (row + 1)"))


@catalog_query("filter_timeline", chosen_sql("published_header") + f"""
SELECT id, sort_key FROM dated WHERE ({IN_TIMELINE}) AND sort_key // 10000 BETWEEN 1975 AND 1999
""", ["date_choices"])
def _(i):
    return timeline.filter_timeline(_timeline(i), " Bolt ", 1999, 1975).select("id", "date.sort_key")


@catalog_query("excluded_without_date", chosen_sql("published_header") + f"""
SELECT count(*) AS excluded FROM dated WHERE ({IN_TIMELINE}) AND sort_key IS NULL
""", ["date_choices"])
def _(i):
    return timeline.excluded_without_date(_timeline(i), "bolt", None, 1990)


@catalog_query("timeline_years", chosen_sql("published_header") + "SELECT DISTINCT sort_key // 10000 AS year FROM dated WHERE sort_key IS NOT NULL", ["date_choices"])
def _(i):
    return timeline.timeline_years(_timeline(i))


# Analytics.
@catalog_query("collection_summary", f"""
SELECT count(*) AS records, count(DISTINCT sheet_key) AS sheets, count(*) FILTER (verified_cover) AS with_cover, count(*) FILTER (NOT verified_cover) AS without_cover,
{", ".join(f"count(*) FILTER ({f}_state = 'MISSING') AS missing_{f}, coalesce(bool_or({f}_state IN ('MAPPED', 'MISSING')), false) AS mapped_{f}" for f in mapping.FIELD_NAMES)} FROM covered
""")
def _(i):
    return analytics.collection_summary(Catalog(i).covered())


for _field in ("circle", "artist"):

    @catalog_query(f"top_values_{_field}", f"""
SELECT * FROM (SELECT {_field}_text AS value, count(*) AS records FROM covered WHERE {_field}_text IS NOT NULL GROUP BY 1) ORDER BY records DESC, lower(value), value LIMIT 50
""")
    def _(i, field=_field):
        return analytics.top_values(Workbook(i).entries(), field)


@catalog_query("tag_counts", """
SELECT * FROM (SELECT tag AS value, count(*) AS records FROM (SELECT trim(unnest(regexp_split_to_array(tags_text, '[,、;；]'))) AS tag FROM covered) WHERE tag <> '' GROUP BY 1) ORDER BY records DESC, lower(value), value LIMIT 50
""")
def _(i):
    return analytics.tag_counts(Workbook(i).entries())


@catalog_query("year_histogram", f"""
SELECT y // 10000 AS year, count(*) AS records FROM (SELECT {date_sql('published_text')} AS y FROM covered WHERE published_text IS NOT NULL) GROUP BY ALL
""")
def _(i):
    return analytics.year_histogram(Workbook(i).entries())


GROUPS = """
, id_groups AS (
  SELECT k AS identifier, count(*) AS records, string_agg(place, ', ' ORDER BY n) FILTER (n <= 5) AS places, min_by(sheet, n) AS sheet FROM (
    SELECT lower(identifier_text) AS k, sheet || '!' || (row + 1) AS place, sheet, row_number() OVER (PARTITION BY lower(identifier_text) ORDER BY sheet, row) AS n
    FROM covered WHERE identifier_text IS NOT NULL) GROUP BY k HAVING count(*) > 1
), text_groups AS (
  SELECT title, circle, artist, count(*) AS records, string_agg(place, ', ' ORDER BY n) FILTER (n <= 5) AS places, min_by(sheet, n) AS sheet FROM (
    SELECT *, row_number() OVER (PARTITION BY title, circle, artist ORDER BY sheet, row) AS n FROM (
      SELECT lower(title_text) AS title, coalesce(lower(circle_text), '') AS circle, coalesce(lower(artist_text), '') AS artist, sheet || '!' || (row + 1) AS place, sheet, row FROM covered WHERE title_text <> '')
  ) GROUP BY title, circle, artist HAVING count(*) > 1
)"""


@catalog_query("duplicate_identifiers", GROUPS + " SELECT * FROM id_groups")
def _(i):
    return analytics.duplicate_identifiers(Workbook(i).entries())


@catalog_query("possible_duplicates", GROUPS + " SELECT * FROM text_groups")
def _(i):
    return analytics.possible_duplicates(Workbook(i).entries())


@catalog_query("duplicate_totals", GROUPS + " SELECT count(*) AS groups, coalesce(sum(records), 0) AS records FROM text_groups")
def _(i):
    return analytics.duplicate_totals(analytics.possible_duplicates(Workbook(i).entries()))


# Health.
FEEDS["declared_sheets"] = """
SELECT 'book' AS workbook, 'xl/lost' || cast(n_nationkey AS string) || '.xml' AS sheet_key, n_name AS sheet, n_regionkey <> 2 AS parsed FROM {nation}
"""
FEEDS["diagnostics"] = """
SELECT o_orderkey AS pos, CASE WHEN o_orderstatus = 'F' THEN 'INFO' ELSE 'WARNING' END AS level, 'part' || cast(o_custkey AS string) AS part, o_orderpriority AS message FROM {orders}
"""
STRUCTURE = """
, f_structure AS (
  SELECT 'structure:unreadable:' || sheet AS id, 'STRUCTURE' AS category, 'ERROR' AS severity, sheet, NULL::VARCHAR AS record_id, NULL::INT AS row, NULL::VARCHAR AS field, 1 AS n, NULL::VARCHAR AS evidence FROM declared_sheets WHERE NOT parsed
  UNION ALL SELECT 'structure:blank-row:' || sheet, 'STRUCTURE', 'WARNING', sheet, NULL, last_row + 1, NULL, count(*), min(row)::VARCHAR FROM data_rows JOIN extent USING (workbook, sheet_key, sheet) WHERE row > last_row + 1 GROUP BY sheet, last_row
  UNION ALL SELECT 'structure:diagnostic:' || pos, 'STRUCTURE', 'WARNING', NULL, NULL, NULL, part, 1, message FROM (SELECT * FROM diagnostics WHERE level = 'WARNING' ORDER BY pos LIMIT 20)
  UNION ALL SELECT 'structure:diagnostic:more', 'STRUCTURE', 'INFO', NULL, NULL, NULL, NULL, count(*) - 20, NULL FROM diagnostics WHERE level = 'WARNING' HAVING count(*) > 20
)"""
_ORD = " ".join(f"WHEN '{f}' THEN {n}" for n, f in enumerate(mapping.FIELD_NAMES))
_MISSING = " UNION ALL ".join(
    f"SELECT id, sheet, row, '{f}' AS field FROM covered WHERE {f}_state = 'MISSING'" for f in facets.OPTIONAL)
RECORDS = f"""
, missing AS ({_MISSING}
), f_records AS (
  SELECT CASE title_state WHEN 'MISSING' THEN 'record:title-empty:' WHEN 'UNMAPPED' THEN 'record:title-unmapped:' ELSE 'record:title-ambiguous:' END || id AS id,
    'RECORDS' AS category, 'ERROR' AS severity, sheet, id AS record_id, row, 'title' AS field, 1 AS n, NULL AS evidence FROM covered WHERE title_state <> 'MAPPED'
  UNION ALL SELECT 'record:missing:' || upper(field) || ':' || id, 'RECORDS', 'INFO', sheet, id, row, field, 1, NULL FROM (SELECT * FROM missing ORDER BY sheet, row, id, CASE field {_ORD} END LIMIT 400)
  UNION ALL SELECT 'record:missing:more', 'RECORDS', 'INFO', NULL, NULL, NULL, NULL, count(*) - 400, NULL FROM missing HAVING count(*) > 400
  UNION ALL SELECT 'record:url:' || id, 'RECORDS', 'WARNING', sheet, id, row, 'url', 1, url_text FROM covered WHERE url_text IS NOT NULL AND NOT regexp_matches(url_text, '(?i)^https?://[^/?.][^/?]*\\.[^/?]*[^/?.]([/?]|$)')
  UNION ALL SELECT 'record:date:' || id, 'RECORDS', 'WARNING', sheet, id, row, 'published', 1, published_text FROM covered WHERE published_text IS NOT NULL AND {date_sql('published_text')} IS NULL
  UNION ALL SELECT 'record:price:' || id, 'RECORDS', 'WARNING', sheet, id, row, 'price', 1, price_text FROM covered WHERE price_text IS NOT NULL AND NOT regexp_matches(price_text, '\\p{{Nd}}')
)"""
IMAGE_FINDINGS = """
, f_images AS (
  SELECT 'image:unresolved:' || key AS id, 'IMAGES' AS category, 'WARNING' AS severity, sheet, NULL AS record_id, NULL AS row, NULL AS field, 1 AS n, detail AS evidence FROM images WHERE state = 'UNRESOLVED'
  UNION ALL SELECT 'image:no-cover:' || sheet, 'IMAGES', 'INFO', sheet, NULL, NULL, NULL, count(*), NULL FROM covered WHERE NOT verified_cover GROUP BY sheet
  UNION ALL SELECT 'image:unreferenced:' || key, 'IMAGES', 'INFO', NULL, NULL, NULL, NULL, 1, media_path FROM (SELECT * FROM images WHERE state = 'UNREFERENCED' ORDER BY key LIMIT 200)
  UNION ALL SELECT 'image:unreferenced:more', 'IMAGES', 'INFO', NULL, NULL, NULL, NULL, count(*) - 200, NULL FROM images WHERE state = 'UNREFERENCED' HAVING count(*) > 200
)"""
CONSISTENCY = GROUPS + """
, f_duplicates AS (
  SELECT 'consistency:duplicate-id:' || identifier AS id, 'CONSISTENCY' AS category, 'WARNING' AS severity, sheet, NULL AS record_id, NULL AS row, NULL AS field, records AS n, places || CASE WHEN records > 5 THEN '…' ELSE '' END AS evidence FROM id_groups
  UNION ALL SELECT 'consistency:possible-duplicate:' || title || '|' || circle || '|' || artist, 'CONSISTENCY', 'INFO', sheet, NULL, NULL, NULL, records, places || CASE WHEN records > 5 THEN '…' ELSE '' END FROM text_groups
), f_mapping AS (
  SELECT DISTINCT 'consistency:mapping:' || kind || ':' || sheet || ':' || upper(field) || ':' || coalesce(header, '-') AS id, 'CONSISTENCY' AS category, CASE WHEN kind = 'REQUIRED_UNMAPPED' THEN 'ERROR' ELSE 'WARNING' END AS severity,
    sheet, NULL AS record_id, NULL AS row, field, 1 AS n, header AS evidence FROM issues
)"""
ALL_FINDINGS = STRUCTURE + RECORDS + IMAGE_FINDINGS + CONSISTENCY + """
, findings AS (SELECT * FROM f_structure UNION ALL SELECT * FROM f_records UNION ALL SELECT * FROM f_images UNION ALL SELECT * FROM f_duplicates UNION ALL SELECT * FROM f_mapping)
"""
HEALTH_FEEDS = ["declared_sheets", "diagnostics"]


def _structure(c):
    lost = tables.unreadable_sheets(c.inputs.feed("declared_sheets"), c.cells)
    return health.health_structure(
        lost, tables.table_truncation(c.cells, c.columns), c.columns.select("sheet").distinct(), c.inputs.feed("diagnostics")
    )


def _issues(c):
    return mapping.mapping_issues(c.columns, c.mapping(), c.profile())


def _findings(i):
    c = Catalog(i)
    entries = c.entries()  # only the findings about images need the covers
    return health.health_report([
        _structure(c), health.health_records(entries), health.health_images(c.covered(), c.images()),
        health.health_duplicates(entries), health.health_mapping(_issues(c)),
    ])


@catalog_query("health_structure", STRUCTURE + " SELECT * FROM f_structure", HEALTH_FEEDS)
def _(i):
    return _structure(Catalog(i))


@catalog_query("health_records", RECORDS + " SELECT * FROM f_records")
def _(i):
    return health.health_records(Workbook(i).entries())


@catalog_query("health_images", IMAGE_FINDINGS + " SELECT * FROM f_images")
def _(i):
    c = Catalog(i)
    return health.health_images(c.covered(), c.images())


@catalog_query("health_duplicates", CONSISTENCY + " SELECT * FROM f_duplicates")
def _(i):
    return health.health_duplicates(Workbook(i).entries())


@catalog_query("health_mapping", CONSISTENCY + " SELECT * FROM f_mapping")
def _(i):
    return health.health_mapping(_issues(Catalog(i)))


@catalog_query("health_report", ALL_FINDINGS + " SELECT * FROM findings", HEALTH_FEEDS)
def _(i):
    return _findings(i)


@catalog_query("health_summary", ALL_FINDINGS + """
SELECT count(*) AS total, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'INFO') AS infos,
  count(*) FILTER (category = 'STRUCTURE') AS structure, count(*) FILTER (category = 'RECORDS') AS records, count(*) FILTER (category = 'IMAGES') AS images, count(*) FILTER (category = 'CONSISTENCY') AS consistency FROM findings
""", HEALTH_FEEDS)
def _(i):
    return health.health_summary(_findings(i))


# Comparison: each nation's workbook of suppliers against its workbook of customers.
FEEDS["left_sheets"] = """
SELECT n.n_nationkey AS pair, 'S' || cast(s.s_suppkey % 40 AS string) AS sheet, min(s.s_suppkey) AS pos, CASE WHEN max(s.s_acctbal) > 5000 THEN 'visible' ELSE 'Hidden' END AS visibility,
  CASE WHEN min(s.s_acctbal) > 2000 THEN 'A1:B' || cast(count(*) AS string) END AS dimension, count(*) AS comments, min(s.s_suppkey) % 3 AS linked, 0 AS unresolved
FROM {nation} n JOIN {supplier} s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_nationkey, s.s_suppkey % 40
"""
FEEDS["right_sheets"] = """
SELECT c_nationkey AS pair, 's' || cast(c_custkey % 40 AS string) AS sheet, -min(c_custkey) AS pos, CASE WHEN max(c_acctbal) > 5000 THEN 'Visible' ELSE 'hidden' END AS visibility,
  CASE WHEN min(c_acctbal) > 2000 THEN 'A1:B' || cast(count(*) AS string) END AS dimension, count(*) AS comments, min(c_custkey) % 3 AS linked, min(c_custkey) % 2 AS unresolved
FROM {customer} GROUP BY c_nationkey, c_custkey % 40
"""


def _change(label: str, c: str, fold: bool = False) -> str:
    x, y = (f"lower(l.{c})", f"lower(r.{c})") if fold else (f"l.{c}", f"r.{c}")
    return (
        f"CASE WHEN l.sheet IS NOT NULL AND r.sheet IS NOT NULL AND {x} IS DISTINCT FROM {y} THEN '{label}: ' || coalesce(l.{c}::VARCHAR, 'not declared') "
        f"|| ' -> ' || coalesce(r.{c}::VARCHAR, 'not declared') END"
    )


@query("compare_sheets", f"""
SELECT coalesce(l.pair, r.pair) AS pair, coalesce(l.sheet, r.sheet) AS sheet, CASE WHEN l.sheet IS NULL THEN 'RIGHT_ONLY' WHEN r.sheet IS NULL THEN 'LEFT_ONLY' ELSE 'BOTH' END AS presence,
  concat_ws('; ', {_change('Visibility', 'visibility', True)}, {_change('Comments', 'comments')}, {_change('Linked images', 'linked')}, {_change('Unresolved references', 'unresolved')}, {_change('Used range', 'dimension')}) AS changes
FROM left_sheets l FULL JOIN right_sheets r ON l.pair = r.pair AND lower(l.sheet) = lower(r.sheet)
""", ["left_sheets", "right_sheets"])
def _(i):
    return compare.compare_sheets(i.feed("left_sheets"), i.feed("right_sheets")).withColumn(
        "changes", F.array_join("changes", "; ")
    )


@query("sheet_order_changed", """
SELECT pair, bool_or(a <> b) AS order_changed FROM (SELECT l.pair, row_number() OVER (PARTITION BY l.pair ORDER BY l.pos) AS a, row_number() OVER (PARTITION BY l.pair ORDER BY r.pos) AS b
  FROM left_sheets l JOIN right_sheets r ON l.pair = r.pair AND lower(l.sheet) = lower(r.sheet)) GROUP BY pair
""", ["left_sheets", "right_sheets"])
def _(i):
    return compare.sheet_order_changed(i.feed("left_sheets"), i.feed("right_sheets"))


FEEDS["header_lists"] = """
SELECT n.n_nationkey AS pair, n.n_regionkey AS side_key, p.p_size AS idx, min(p.p_name) AS name FROM {nation} n JOIN {part} p ON p.p_partkey % 25 = n.n_nationkey GROUP BY n.n_nationkey, n.n_regionkey, p.p_size
"""


@query("headers_changed", """
WITH r AS (SELECT pair, idx, CASE WHEN side_key = 1 THEN name ELSE upper(name) END AS name FROM header_lists WHERE side_key <> 2 OR idx <> 7)
SELECT coalesce(l.pair, r.pair) AS pair, bool_or(lower(l.name) || (CASE WHEN l.pair % 2 = 0 THEN '!' ELSE '' END) IS DISTINCT FROM lower(r.name)) AS headers_changed FROM header_lists l FULL JOIN r ON l.pair = r.pair AND l.idx = r.idx GROUP BY ALL
""", ["header_lists"])
def _(i):
    lists = i.feed("header_lists")
    right = lists.filter("side_key <> 2 OR idx <> 7").withColumn("name", F.expr("CASE WHEN side_key = 1 THEN name ELSE upper(name) END"))
    left = lists.withColumn("name", F.expr("concat(name, CASE WHEN pair % 2 = 0 THEN '!' ELSE '' END)"))
    return compare.headers_changed(left, right)


FEEDS["left_totals"] = """
SELECT s_nationkey AS pair, cast(min(s_suppkey) AS string) AS sha256, CASE WHEN min(s_acctbal) < 500 THEN 'unreadable' END AS failure, count(*) AS sheets, count(*) * 2 AS comments,
  count(*) AS linked, count(*) AS media, 0 AS unreferenced, 1 AS unresolved, CASE WHEN count(*) > 3 THEN count(*) END AS records FROM {supplier} GROUP BY s_nationkey
"""
FEEDS["right_totals"] = """
SELECT c_nationkey AS pair, cast(min(c_custkey) AS string) AS sha256, CASE WHEN min(c_acctbal) < -999 THEN 'unreadable' END AS failure, count(*) AS sheets, count(*) AS comments,
  min(c_custkey) AS linked, count(*) AS media, 0 AS unreferenced, min(c_custkey) % 2 AS unresolved, CASE WHEN count(*) > 60 THEN count(*) END AS records FROM {customer} GROUP BY c_nationkey
"""
_TOTALS = ", ".join(
    f"CASE WHEN l.{c} IS DISTINCT FROM r.{c} THEN '{label}: ' || coalesce(l.{c}::VARCHAR, 'unknown') || ' -> ' || coalesce(r.{c}::VARCHAR, 'unknown') END"
    for label, c in compare.TOTALS.items()
)


@query("compare_totals", f"""
SELECT pair, coalesce(l.failure IS NULL AND r.failure IS NULL AND l.sha256 = r.sha256, false) AS same_file, concat_ws('; ', {_TOTALS}) AS changes FROM left_totals l JOIN right_totals r USING (pair)
""", ["left_totals", "right_totals"])
def _(i):
    return compare.compare_totals(i.feed("left_totals"), i.feed("right_totals")).withColumn("changes", F.array_join("changes", "; "))


@catalog_query("sheet_metrics", """
SELECT s.sheet, s.pos, s.visibility, s.dimension, coalesce(c.n, 0) AS comments, coalesce(p.linked, 0) AS linked, coalesce(p.unresolved, 0) AS unresolved
FROM (SELECT sheet, header_row AS pos, 'visible' AS visibility, NULL AS dimension FROM header_rows) s LEFT JOIN (SELECT sheet, count(*) AS n FROM comments GROUP BY ALL) c USING (sheet)
LEFT JOIN (SELECT sheet, count(*) FILTER (state = 'LINKED') AS linked, count(*) FILTER (state = 'UNRESOLVED') AS unresolved FROM (SELECT DISTINCT p.key, p.sheet, i.state FROM places p JOIN images i USING (key)) GROUP BY ALL) p USING (sheet)
""")
def _(i):
    c = Catalog(i)
    sheets = c.headers.select("workbook", "sheet", F.col("header_row").alias("pos"), F.lit("visible").alias("visibility"),
                              F.lit(None).cast("string").alias("dimension"))
    return compare.sheet_metrics(sheets, c.comments, c.images(), c.places()).drop("workbook")


@catalog_query("workbook_metrics", """
SELECT w.workbook, w.failure, CASE WHEN w.failure IS NULL THEN coalesce(b.sheets, 0) END AS sheets, CASE WHEN w.failure IS NULL THEN coalesce(b.media, 0) END AS media, CASE WHEN w.failure IS NULL THEN coalesce(b.linked, 0) END AS linked,
  CASE WHEN w.failure IS NULL THEN coalesce(b.unresolved, 0) END AS unresolved, CASE WHEN w.failure IS NULL THEN b.records END AS records
FROM (SELECT 'book' AS workbook, NULL AS failure UNION ALL SELECT 'gone', 'not a package') w
LEFT JOIN (SELECT 'book' AS workbook, (SELECT count(*) FROM header_rows) AS sheets, (SELECT count(media_path) FROM images) AS media, (SELECT count(*) FROM images WHERE state = 'LINKED') AS linked,
  (SELECT count(*) FROM images WHERE state = 'UNRESOLVED') AS unresolved, (SELECT count(*) FROM record_rows) AS records) b USING (workbook)
""")
def _(i):
    c = Catalog(i)
    sheets = c.headers.select("workbook", "sheet", F.lit(0).alias("comments"))
    books = i.spark.sql("SELECT 'book' AS workbook, 'x' AS sha256, cast(NULL AS string) AS failure UNION ALL SELECT 'gone', 'y', 'not a package'")
    metrics = compare.workbook_metrics(
        books, sheets, c.images().withColumn("workbook", F.lit("book")), c.table.select("workbook", "sheet_key", "row").distinct()
    )
    return metrics.select("workbook", "failure", "sheets", "media", "linked", "unresolved", "records")
