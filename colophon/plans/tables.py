"""Queries over worksheet cells: detection, records, shown text, windows and mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from colophon.operators import facets, mapping, tables
from colophon.plans.inputs import FEEDS, Inputs, query
from colophon.session import checkpoint_dir
from colophon.sources.cells import SHEET, clean_cells, read_cells

STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def strip_sql(c: str) -> str:
    return STRIP.format(c)


FEEDS["styles"] = """
SELECT DISTINCT 'book' AS workbook, s.style, s.kind, false AS date1904
FROM (SELECT 0 AS style, 'GENERAL' AS kind UNION ALL SELECT 1, 'DATE' UNION ALL SELECT 2, 'NUMBER' UNION ALL SELECT 3, 'PERCENT') s
"""

# The same table, step by step, in SQL.
GRID = f"""
clean AS (
  SELECT workbook, sheet, coalesce(nullif(sheet_key, ''), 'name:' || sheet) AS sheet_key, row, col, {strip_sql('text')} AS text, style, numeric
  FROM cells WHERE row BETWEEN 0 AND 19999 AND col BETWEEN 0 AND 511 AND {strip_sql('text')} <> ''
), header_rows AS (
  SELECT workbook, sheet_key, sheet, row AS header_row, n AS header_cells FROM (
    SELECT workbook, sheet_key, sheet, row, count(DISTINCT col) AS n,
      row_number() OVER (PARTITION BY workbook, sheet_key, sheet ORDER BY count(DISTINCT col) DESC, row) AS rn
    FROM clean WHERE row < 12 AND length(text) BETWEEN 1 AND 40 AND NOT regexp_full_match(text, '\\p{{Nd}}+')
    GROUP BY workbook, sheet_key, sheet, row) WHERE rn = 1 AND n >= 3
), seen AS (
  SELECT c.workbook, c.sheet_key, c.sheet, h.header_row, c.col, max(CASE WHEN c.row = h.header_row THEN c.text END) AS label
  FROM clean c JOIN header_rows h USING (workbook, sheet_key, sheet) WHERE c.row >= h.header_row GROUP BY ALL
), cols AS (
  SELECT workbook, sheet_key, sheet, header_row, col, coalesce(label, '') AS name,
    row_number() OVER (PARTITION BY workbook, sheet_key, sheet ORDER BY col) - 1 AS idx
  FROM (SELECT *, min(CASE WHEN label IS NOT NULL THEN col END) OVER w AS lo, max(CASE WHEN label IS NOT NULL THEN col END) OVER w AS hi
        FROM seen WINDOW w AS (PARTITION BY workbook, sheet_key, sheet)) WHERE col BETWEEN lo AND hi
), body AS (
  SELECT c.*, k.header_row, k.idx, k.name FROM clean c JOIN cols k USING (workbook, sheet_key, sheet, col)
  WHERE c.row > k.header_row AND c.row <= k.header_row + 5000
), named AS (
  SELECT workbook, sheet_key, sheet, sum(CASE WHEN name <> '' THEN 1 ELSE 0 END) AS named FROM cols GROUP BY ALL
), data_rows AS (
  SELECT b.workbook, b.sheet_key, b.sheet, b.row, count(*) = sum(CASE WHEN b.text = b.name THEN 1 ELSE 0 END) AND count(*) = max(n.named) AS repeat
  FROM body b JOIN named n USING (workbook, sheet_key, sheet) GROUP BY ALL
), extent AS (
  SELECT workbook, sheet_key, sheet, min(first_row) AS first_row, min(row) AS last_row FROM (
    SELECT *, lead(row) OVER w AS nxt, min(CASE WHEN NOT repeat THEN row END) OVER (PARTITION BY workbook, sheet_key, sheet) AS first_row
    FROM data_rows WINDOW w AS (PARTITION BY workbook, sheet_key, sheet ORDER BY row)
  ) WHERE row >= first_row AND (nxt IS NULL OR nxt > row + 1) GROUP BY workbook, sheet_key, sheet
), tcells AS (
  SELECT b.*, CASE WHEN b.numeric AND s.kind = 'DATE' THEN strftime(DATE '1899-12-30' + cast(b.text AS integer), '%Y-%m-%d')
    WHEN b.numeric AND s.kind = 'NUMBER' AND try_cast(b.text AS double) IS NOT NULL
      THEN regexp_replace(printf('%.2f', cast(b.text AS double)), '\\.?0+$', '')
    WHEN b.numeric AND s.kind = 'PERCENT' THEN regexp_replace(printf('%.2f', cast(b.text AS double) * 100), '\\.?0+$', '') || '%'
    ELSE b.text END AS shown
  FROM body b JOIN data_rows d USING (workbook, sheet_key, sheet, row) JOIN extent e USING (workbook, sheet_key, sheet)
  LEFT JOIN styles s USING (workbook, style)
  WHERE NOT d.repeat AND b.row BETWEEN e.first_row AND e.last_row
)
"""


class Grid:
    """Cells, header, columns and table of the derived workbook."""

    def __init__(self, inputs: Inputs):
        self.cells = clean_cells(inputs.stored("cells"))
        self.headers = tables.detect_header(self.cells)
        self.columns = tables.table_columns(self.cells, self.headers)
        self.styles = inputs.feed("styles")
        self.table = tables.table_cells(self.cells, self.columns, self.styles)


def grid_query(name: str, sql: str):
    return query(name, f"WITH {GRID}{sql}", ["cells", "styles"])


@grid_query("read_cells", "SELECT * FROM clean")
def _(i):
    return clean_cells(i.stored("cells"))


@grid_query("read_cells_files", "SELECT * FROM clean")
def _(i):
    """The cells as CSV files, read back from their folder with the fixed schema."""
    path = f"{checkpoint_dir(i.spark)}/cells-{i.spark.range(1).select(F.uuid()).first()[0]}"
    quoted = {"quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    i.stored("cells").write.options(**quoted).csv(path)
    return read_cells(i.spark, path, "csv", escape='"')


@grid_query("detect_header", "SELECT sheet_key, sheet, header_row, header_cells FROM header_rows")
def _(i):
    return Grid(i).headers.select("sheet_key", "sheet", "header_row", "header_cells")


@grid_query("table_columns", "SELECT sheet_key, header_row, idx, col, name FROM cols")
def _(i):
    return Grid(i).columns.select("sheet_key", "header_row", "idx", "col", "name")


@grid_query("table_cells", "SELECT sheet_key, row, idx, col, name, text, shown FROM tcells")
def _(i):
    return Grid(i).table.select("sheet_key", "row", "idx", "col", "name", "text", "shown")


@grid_query("table_records", """
, width AS (SELECT workbook, sheet_key, sheet, count(*) AS n FROM cols GROUP BY ALL)
SELECT c.sheet_key, d.row, string_agg(coalesce(t.text, ''), '|' ORDER BY c.idx) AS stored, string_agg(coalesce(t.shown, ''), '|' ORDER BY c.idx) AS shown
FROM (SELECT DISTINCT workbook, sheet_key, sheet, row FROM tcells) d JOIN cols c USING (workbook, sheet_key, sheet)
LEFT JOIN tcells t USING (workbook, sheet_key, sheet, row, col) GROUP BY c.sheet_key, d.row
""")
def _(i):
    g = Grid(i)
    return tables.table_records(g.table, g.columns).select(
        "sheet_key", "row", F.array_join("values", "|").alias("stored"), F.array_join("shown", "|").alias("shown")
    )


FEEDS["sheet_links"] = """
SELECT 'book' AS workbook, 'xl/parts' || cast(cast(floor(p_partkey / 400) AS bigint) AS string) || '.xml' AS sheet_key,
  'Parts ' || cast(cast(floor(p_partkey / 400) AS bigint) AS string) AS sheet, p_partkey AS ord,
  CASE p_partkey % 50 WHEN 0 THEN 'A1:B1000000' WHEN 7 THEN 'D' || cast(1 + p_partkey % 400 AS string) || ':C' || cast(3 + p_partkey % 90 AS string)
    ELSE 'E' || cast(1 + p_partkey % 400 AS string) END AS ref,
  CASE WHEN p_partkey % 10 = 3 THEN '#''Parts 0''!A' || cast(p_size AS string) END AS location, 'rId' || cast(p_partkey % 3 AS string) AS rel_id, p_brand AS display
FROM {part}
"""
FEEDS["sheet_rels"] = """
SELECT DISTINCT 'book' AS workbook, 'xl/parts' || cast(cast(floor(p_partkey / 400) AS bigint) AS string) || '.xml' AS sheet_key, 'rId' || cast(p_partkey % 2 AS string) AS rel_id,
  'https://x.example/' || cast(p_partkey % 2 AS string) AS target, p_partkey % 2 = 0 AS external FROM {part}
"""


@query("record_links", f"""WITH {GRID}, l AS (
  SELECT k.sheet_key, k.ord, coalesce(nullif(k.location, ''), r.target) AS target, coalesce(k.location, '') <> '' OR NOT r.external AS internal, k.display,
    CASE k.ord % 50 WHEN 0 THEN 0 WHEN 7 THEN least(k.ord % 400, 2 + k.ord % 90) ELSE k.ord % 400 END AS r0,
    CASE k.ord % 50 WHEN 0 THEN 999999 WHEN 7 THEN greatest(k.ord % 400, 2 + k.ord % 90) ELSE k.ord % 400 END AS r1,
    CASE k.ord % 50 WHEN 0 THEN 0 WHEN 7 THEN 2 ELSE 4 END AS c0, CASE k.ord % 50 WHEN 0 THEN 1 WHEN 7 THEN 3 ELSE 4 END AS c1
  FROM sheet_links k LEFT JOIN sheet_rels r USING (sheet_key, rel_id)
), records AS (SELECT DISTINCT sheet_key, row FROM tcells), found AS (
  SELECT d.sheet_key, d.row, c.col, max_by(l.target, l.ord) AS target, max_by(l.internal, l.ord) AS internal, max_by(l.display, l.ord) AS display
  FROM records d JOIN cols c USING (sheet_key) JOIN l ON l.sheet_key = d.sheet_key AND d.row BETWEEN l.r0 AND l.r1 AND c.col BETWEEN l.c0 AND l.c1
  WHERE l.target IS NOT NULL GROUP BY ALL
)
SELECT d.sheet_key, d.row, count(f.col) AS n_links, count(f.col) FILTER (f.internal AND f.target LIKE '#%') AS n_sheets,
  coalesce(string_agg(f.col || '>' || f.target || '>' || f.internal || '>' || f.display, '|' ORDER BY f.col), '') AS links
FROM records d LEFT JOIN found f USING (sheet_key, row) GROUP BY d.sheet_key, d.row
""", ["cells", "styles", "sheet_links", "sheet_rels"])
def _(i):
    g = Grid(i)
    found = tables.record_links(g.table, g.columns, tables.link_ranges(i.spread("sheet_links"), i.feed("sheet_rels")))
    records = tables.table_records(g.table, g.columns, found)
    each = F.array_sort(F.map_entries("links"))
    spelled = F.transform(each, lambda e: F.concat_ws(">", e["key"], e["value"]["target"], e["value"]["internal"], tables.link_label(e["value"])))
    sheets = F.size(F.filter(F.map_values("links"), lambda v: tables.internal_target(v)["sheet"] == "Parts 0"))
    return records.select("sheet_key", "row", F.size("links").alias("n_links"), sheets.alias("n_sheets"), F.array_join(spelled, "|").alias("links"))


@grid_query("table_truncation", """
SELECT d.sheet_key, e.last_row + 1 AS blank_row, count(*) AS skipped_rows, min(d.row) AS first_skipped_row
FROM data_rows d JOIN extent e USING (workbook, sheet_key, sheet) WHERE d.row > e.last_row + 1 GROUP BY d.sheet_key, e.last_row
""")
def _(i):
    g = Grid(i)
    return tables.table_truncation(g.cells, g.columns).select("sheet_key", "blank_row", "skipped_rows", "first_skipped_row")


class Workbook:
    """The same stages, kept as tables: what mapping, facets, analytics and health start from. Each is made when first asked for."""

    def __init__(self, inputs: Inputs):
        self.inputs = inputs

    @property
    def cells(self):
        return self.inputs.keep("clean_cells", lambda: clean_cells(self.inputs.spread("cells")))

    @property
    def headers(self):
        return tables.detect_header(self.cells)

    @property
    def columns(self):
        return self.inputs.keep("columns", lambda: tables.table_columns(self.cells, self.headers))

    @property
    def table(self):
        return self.inputs.keep("table", lambda: tables.table_cells(self.cells, self.columns, self.inputs.feed("styles")))

    def profile(self):
        return mapping.effective_profile(
            self.columns, edits=self.inputs.feed("sheet_edits"), own=self.inputs.feed("sheet_profiles")
        )

    def mapping(self):
        return self.inputs.keep("mapping", lambda: mapping.resolve_mapping(self.columns, self.profile()))

    def entries(self):
        return self.inputs.keep("bare_entries", lambda: mapping.build_entries(self.table, self.mapping()))


FEEDS["sheet_edits"] = """
SELECT 'book' AS workbook, s.sheet_key, f.field, f.header
FROM (SELECT DISTINCT 'name:Suppliers ' || cast(cast(floor(s_suppkey / 50) AS bigint) AS string) AS sheet_key FROM {supplier}) s
CROSS JOIN (SELECT 'title' AS field, ' Title ' AS header UNION ALL SELECT 'circle', 'CIRCLE' UNION ALL SELECT 'price', 'Price' UNION ALL SELECT 'artist', 'Author' UNION ALL SELECT 'url', ' ') f
"""
FEEDS["sheet_profiles"] = """
SELECT 'book' AS workbook, s.sheet_key, f.field, f.header
FROM (SELECT DISTINCT 'xl/customers' || cast(2 * cast(floor(c_custkey / 1000) AS bigint) AS string) || '.xml' AS sheet_key FROM {customer}) s
CROSS JOIN (SELECT 'title' AS field, 'Customer' AS header UNION ALL SELECT 'circle', 'Segment' UNION ALL SELECT 'tags', 'segment' UNION ALL SELECT 'price', 'Balance') f
"""
FEEDS["shared_profile"] = """
SELECT 'book' AS workbook, f.field, f.header
FROM (SELECT 'title' AS field, 'タイトル' AS header UNION ALL SELECT 'price', 'price' UNION ALL SELECT 'identifier', 'Product  ID') f
WHERE EXISTS (SELECT 1 FROM {region})
"""


def _detected_sql() -> str:
    names = lambda xs: ", ".join(f"'{x}'" for x in xs)
    parts = []
    for field, (_, aliases) in mapping.FIELDS.items():
        lead = mapping.LEADING.get(field)
        first = f"WHEN regexp_matches(lower(name), '{'|'.join(lead)}') THEN 0 " if lead else ""
        parts.append(
            f"SELECT workbook, sheet_key, sheet, '{field}' AS field, name, col, CASE {first}"
            f"WHEN lower({strip_sql('name')}) IN ({names(aliases)}) THEN 1 "
            f"WHEN regexp_matches(lower({strip_sql('name')}), '{'|'.join(aliases)}') THEN 2 END AS rule FROM cols"
        )
    return " UNION ALL ".join(parts)


NORM = "regexp_replace(lower({}), '\\s+', ' ', 'g')"
FIELD_ROWS = " UNION ALL ".join(f"SELECT '{f}' AS field" for f in mapping.FIELD_NAMES)
MAPPING = GRID + f"""
, detected AS (
  SELECT workbook, sheet_key, sheet, field, name AS header FROM (
    SELECT *, row_number() OVER (PARTITION BY workbook, sheet_key, sheet, field ORDER BY rule, col) AS rn
    FROM ({_detected_sql()}) WHERE rule IS NOT NULL) WHERE rn = 1
), sheet_list AS (SELECT DISTINCT workbook, sheet_key, sheet FROM cols
), candidates AS (
  SELECT l.workbook, l.sheet_key, l.sheet, e.field, e.header, 1 AS rank, 'EDIT' AS origin FROM sheet_list l JOIN sheet_edits e USING (workbook, sheet_key) WHERE trim(e.header) <> ''
  UNION ALL SELECT l.workbook, l.sheet_key, l.sheet, e.field, e.header, 2, 'PROFILE_SHEET' FROM sheet_list l JOIN sheet_profiles e USING (workbook, sheet_key)
  UNION ALL SELECT workbook, sheet_key, sheet, field, header, 4, 'DETECTED' FROM detected
), profile AS (
  SELECT * EXCLUDE (best) FROM (SELECT *, min(rank) OVER (PARTITION BY workbook, sheet_key, sheet) AS best FROM candidates) WHERE rank = best
), known AS (
  SELECT workbook, sheet_key, sheet, {NORM.format(strip_sql('name'))} AS norm, count(*) AS matches, min(col) AS only_col, min(name) AS only_name FROM cols GROUP BY ALL
), resolved AS (
  SELECT p.workbook, p.sheet_key, p.sheet, p.field, CASE WHEN k.matches = 1 THEN k.only_name ELSE p.header END AS header,
    CASE WHEN k.matches IS NULL THEN 'HEADER_MISSING' WHEN k.matches = 1 THEN 'RESOLVED' ELSE 'HEADER_AMBIGUOUS' END AS outcome,
    CASE WHEN k.matches = 1 THEN k.only_col END AS col, coalesce(k.matches, 0) AS matches
  FROM profile p LEFT JOIN known k ON k.workbook = p.workbook AND k.sheet_key = p.sheet_key AND k.sheet = p.sheet AND k.norm = {NORM.format(strip_sql('p.header'))}
), issues AS (
  SELECT workbook, sheet_key, sheet, outcome AS kind, field, header FROM resolved WHERE outcome <> 'RESOLVED'
  UNION ALL SELECT workbook, sheet_key, sheet, 'SHARED_HEADER', field, header FROM (
    SELECT *, count(*) OVER (PARTITION BY workbook, sheet_key, sheet, col) AS users FROM resolved WHERE outcome = 'RESOLVED') WHERE users > 1
  UNION ALL SELECT l.workbook, l.sheet_key, l.sheet, 'REQUIRED_UNMAPPED', 'title', p.header FROM sheet_list l
    LEFT JOIN profile p ON p.workbook = l.workbook AND p.sheet_key = l.sheet_key AND p.sheet = l.sheet AND p.field = 'title'
    WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.workbook = l.workbook AND r.sheet_key = l.sheet_key AND r.field = 'title' AND r.outcome = 'RESOLVED')
), entry_fields AS (
  SELECT d.workbook, d.sheet_key, d.sheet, d.row, f.field,
    CASE WHEN r.outcome = 'HEADER_AMBIGUOUS' THEN 'AMBIGUOUS' WHEN r.outcome IS NULL OR r.outcome <> 'RESOLVED' THEN 'UNMAPPED'
      WHEN t.text IS NULL THEN 'MISSING' ELSE 'MAPPED' END AS state, CASE WHEN r.outcome = 'RESOLVED' THEN t.text END AS text
  FROM (SELECT DISTINCT workbook, sheet_key, sheet, row FROM tcells) d CROSS JOIN ({FIELD_ROWS}) f
  LEFT JOIN resolved r ON r.workbook = d.workbook AND r.sheet_key = d.sheet_key AND r.sheet = d.sheet AND r.field = f.field
  LEFT JOIN tcells t ON t.workbook = d.workbook AND t.sheet_key = d.sheet_key AND t.sheet = d.sheet AND t.row = d.row AND t.col = r.col
), entries AS (
  SELECT workbook, sheet_key, sheet, row, sheet_key || '#' || row AS id,
    {", ".join(f"max(state) FILTER (field = '{f}') AS {f}_state, max(text) FILTER (field = '{f}') AS {f}_text" for f in mapping.FIELD_NAMES)}
  FROM entry_fields GROUP BY ALL
)
"""
MAPPING_FEEDS = ["cells", "styles", "sheet_edits", "sheet_profiles"]


def book_query(name: str, sql: str, more: list[str] | None = None):
    return query(name, f"WITH {MAPPING}{sql}", [*MAPPING_FEEDS, *(more or [])])


@book_query("detect_mapping", "SELECT sheet_key, field, header FROM detected")
def _(i):
    return mapping.detect_mapping(Workbook(i).columns).select("sheet_key", "field", "header")


@book_query("effective_profile", "SELECT sheet_key, field, header, origin FROM profile")
def _(i):
    return Workbook(i).profile().select("sheet_key", "field", "header", "origin")


@book_query("effective_profile_shared", """
, shared_candidates AS (
  SELECT l.sheet_key, e.field, e.header, 1 AS rank, 'EDIT' AS origin FROM sheet_list l JOIN sheet_edits e USING (workbook, sheet_key) WHERE trim(e.header) <> ''
  UNION ALL SELECT l.sheet_key, e.field, e.header, 3, 'PROFILE' FROM sheet_list l JOIN shared_profile e USING (workbook)
) SELECT sheet_key, field, header, origin FROM (SELECT *, min(rank) OVER (PARTITION BY sheet_key) AS best FROM shared_candidates) WHERE rank = best
""", ["shared_profile"])
def _(i):
    book = Workbook(i)
    profile = mapping.effective_profile(book.columns, edits=i.feed("sheet_edits"), shared=i.feed("shared_profile"))
    return profile.select("sheet_key", "field", "header", "origin")


@book_query("resolve_mapping", "SELECT sheet_key, field, header, outcome, col, matches FROM resolved")
def _(i):
    book = Workbook(i)
    return mapping.resolve_mapping(book.columns, book.profile()).select(
        "sheet_key", "field", "header", "outcome", "col", "matches"
    )


@book_query("mapping_issues", "SELECT sheet_key, kind, field, header FROM issues")
def _(i):
    book = Workbook(i)
    return mapping.mapping_issues(book.columns, book.mapping(), book.profile()).select("sheet_key", "kind", "field", "header")


ENTRY_COLUMNS = ", ".join(f"{f}_state, {f}_text" for f in mapping.FIELD_NAMES)


@book_query("build_entries", f"SELECT id, row, {ENTRY_COLUMNS} FROM entries")
def _(i):
    book = Workbook(i)
    flat = [F.col(f"{f}.{p}").alias(f"{f}_{p}") for f in mapping.FIELD_NAMES for p in ("state", "text")]
    return mapping.build_entries(book.table, book.mapping()).select("id", "row", *flat)


@book_query("mapping_diff", f"""
, a AS (SELECT workbook, sheet_key, field, {NORM.format(strip_sql('header'))} AS header FROM detected),
b AS (SELECT workbook, sheet_key, field, {NORM.format(strip_sql('header'))} AS header FROM profile)
SELECT *, 'LEFT' AS side FROM (SELECT * FROM a WHERE header <> '' EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT *, 'RIGHT' FROM (SELECT * FROM b WHERE header <> '' EXCEPT ALL SELECT * FROM a)
""")
def _(i):
    book = Workbook(i)
    return mapping.mapping_diff(mapping.detect_mapping(book.columns), book.profile())


@book_query("sheet_choices", """
SELECT l.sheet_key, l.sheet, count(e.id) AS records FROM (SELECT DISTINCT workbook, sheet_key, sheet FROM clean UNION SELECT 'book', 'xl/empty.xml', 'Empty') l
LEFT JOIN entries e USING (workbook, sheet_key) GROUP BY ALL
""")
def _(i):
    book = Workbook(i)
    empty = i.spark.sql("SELECT 'book' AS workbook, 'xl/empty.xml' AS sheet_key, 'Empty' AS sheet")
    sheets = book.cells.select(*SHEET).distinct().unionByName(empty)
    return mapping.sheet_choices(sheets, book.entries()).select("sheet_key", "sheet", "records")


@book_query("scope", """
SELECT id FROM entries WHERE sheet_key IN (SELECT DISTINCT sheet_key FROM cols WHERE lower(name) LIKE 'circle')
""")
def _(i):
    book = Workbook(i)
    chosen = book.columns.filter(F.lower("name") == "circle").select("workbook", "sheet_key")
    wanted = mapping.reconcile_scope(chosen, book.columns.select(*SHEET))
    return mapping.scope(book.entries(), wanted).select("id")


@book_query("facet_fields", f"""
, v AS (SELECT sheet_key, col, count(DISTINCT {strip_sql('shown')}) AS n FROM tcells WHERE {strip_sql('shown')} <> '' GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY sheet_key, lower(name)) AS same FROM cols)
SELECT n.sheet_key, n.col, CASE WHEN n.name = '' THEN 'Column ' || chr(65 + n.col) WHEN n.same > 1 THEN n.name || ' (' || chr(65 + n.col) || ')' ELSE n.name END AS label, v.n AS "values"
FROM n JOIN v USING (sheet_key, col) WHERE v.n >= 2
""")
def _(i):
    book = Workbook(i)
    return facets.facet_fields(book.table, book.columns).select("sheet_key", "col", "label", "values")


@book_query("facet_values", """
SELECT DISTINCT shown AS value FROM tcells WHERE sheet = 'Parts 0' AND col = 8 AND contains(lower(shown), 'shelf 1')
""")
def _(i):
    return facets.facet_values(Workbook(i).table, "Parts 0", 8, " SHELF 1")


FEEDS["facet_choice"] = """
SELECT 'Parts ' || cast(cast(floor(p_partkey / 400) AS bigint) AS string) AS sheet, 3 AS col, max(p_type) AS value FROM {part} GROUP BY 1
UNION ALL SELECT 'Parts ' || cast(cast(floor(p_partkey / 400) AS bigint) AS string), 8, 'shelf ' || cast(min(p_size) AS string) FROM {part} GROUP BY 1
"""


@book_query("facet_filter", """
, met AS (SELECT t.sheet_key, t.sheet, t.row, count(DISTINCT t.col) AS met FROM tcells t JOIN (SELECT sheet, col, value FROM facet_choice WHERE value IS NOT NULL) c ON t.sheet = c.sheet AND t.col = c.col AND t.shown = c.value GROUP BY ALL)
SELECT f.sheet AS chosen, m.sheet_key, m.row FROM (SELECT DISTINCT sheet FROM facet_choice) f JOIN met m ON m.sheet = f.sheet WHERE m.met = 2
""", ["facet_choice"])
def _(i):
    """For every sheet the records that satisfy both of its filters; a selection is one sheet's choice."""
    table, choices = Workbook(i).table, i.feed("facet_choice")
    return facets.facet_filters(table, choices.withColumn("selection", F.col("sheet")), "selection").select(F.col("selection").alias("chosen"), "sheet_key", "row")


@book_query("search_records", """
SELECT DISTINCT sheet_key, row FROM tcells WHERE contains(lower(text), 'ring') OR contains(lower(shown), 'ring')
""")
def _(i):
    return facets.search_records(Workbook(i).table, " Ring ").select("sheet_key", "row")


@book_query("categorical_fields", """
, r AS (SELECT sheet_key, count(DISTINCT row) AS records FROM tcells GROUP BY ALL)
SELECT sheet_key, col, count(DISTINCT text) AS "values" FROM tcells JOIN r USING (sheet_key) GROUP BY sheet_key, col, records
HAVING count(DISTINCT text) BETWEEN 2 AND 40 AND count(DISTINCT text) < records
""")
def _(i):
    return facets.categorical_fields(Workbook(i).table).select("sheet_key", "col", "values")


FEEDS["window_targets"] = """
SELECT p_partkey AS target_id, 'book' AS workbook, 'xl/parts' || cast(cast(floor(p_partkey / 400) AS bigint) AS string) || '.xml' AS sheet_key,
  'Parts ' || cast(cast(floor(p_partkey / 400) AS bigint) AS string) AS sheet, cast(p_partkey % 420 AS int) AS target_row, cast(p_size % 12 AS int) AS target_col
FROM {part}
"""
WINDOW = """
, near AS (
  SELECT t.*, c.row, c.col, c.text FROM window_targets t JOIN clean c ON c.sheet_key = t.sheet_key AND c.row BETWEEN t.target_row - 6 AND t.target_row + 6
), used AS (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY abs(col - target_col), col) AS rn FROM (
    SELECT DISTINCT target_id, target_col, col FROM near UNION SELECT target_id, target_col, target_col FROM window_targets)
)
"""


@book_query("cell_window", WINDOW + """
SELECT n.target_id, n.row, n.col, n.text FROM near n JOIN used u ON u.target_id = n.target_id AND u.col = n.col WHERE u.rn <= 4
""", ["window_targets"])
def _(i):
    return tables.cell_window(Workbook(i).cells, i.feed("window_targets"), max_cols=4).select("target_id", "row", "col", "text")


@book_query("window_summary", WINDOW + """
, m AS (SELECT sheet_key, max(row) AS max_row FROM clean GROUP BY ALL),
r AS (SELECT target_id, count(DISTINCT row) AS rows FROM (SELECT target_id, row FROM near UNION SELECT target_id, target_row FROM window_targets) GROUP BY ALL),
u AS (SELECT target_id, count(*) AS used FROM used GROUP BY ALL)
SELECT t.target_id, greatest(t.target_row - 6, 0) AS first_row, greatest(t.target_row, least(m.max_row, t.target_row + 6)) AS last_row, r.rows,
  least(u.used, 4) AS columns, greatest(u.used - 4, 0) AS hidden,
  NOT (h.header_row BETWEEN greatest(t.target_row - 6, 0) AND greatest(t.target_row, least(m.max_row, t.target_row + 6))) AS header_above
FROM window_targets t JOIN m USING (sheet_key) JOIN r USING (target_id) JOIN u USING (target_id) JOIN header_rows h USING (sheet_key)
""", ["window_targets"])
def _(i):
    book = Workbook(i)
    return tables.window_summary(book.cells, i.feed("window_targets"), book.headers, max_cols=4)


@book_query("cell_window_whole", WINDOW + """
SELECT n.target_id, n.row, n.col, n.text FROM near n JOIN used u ON u.target_id = n.target_id AND u.col = n.col WHERE u.rn <= 96
""", ["window_targets"])
def _(i):
    """As many columns as a window shows unless asked otherwise."""
    return tables.cell_window(Workbook(i).cells, i.feed("window_targets")).select("target_id", "row", "col", "text")


@book_query("window_headers", WINDOW + """
SELECT DISTINCT n.target_id, n.col, chr(cast(65 + n.col AS int)) AS letter, c.name FROM near n JOIN used u ON u.target_id = n.target_id AND u.col = n.col
JOIN cols c ON c.sheet_key = n.sheet_key AND c.col = n.col WHERE u.rn <= 96 AND c.name <> ''
""", ["window_targets"])
def _(i):
    book = Workbook(i)
    return tables.window_headers(tables.cell_window(book.cells, i.feed("window_targets")), book.columns)


@book_query("record_locations", """
SELECT t.sheet_key, t.row, chr(65 + cast(min(c.col) AS int)) || (t.row + 1) AS cell FROM (SELECT DISTINCT sheet_key, row FROM tcells) t JOIN cols c USING (sheet_key) GROUP BY t.sheet_key, t.row
""")
def _(i):
    book = Workbook(i)
    return tables.record_locations(book.table, book.columns).select("sheet_key", "row", "cell")
