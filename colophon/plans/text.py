"""Queries over texts: normal forms, similarity, dates, references, formats, URLs and record linkage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from colophon.functions import cellref, dates, formats, text, urls
from colophon.operators import linkage, tables
from colophon.operators.numbering import ranked
from colophon.plans.catalog import date_sql
from colophon.plans.inputs import FEEDS, query
from colophon.plans.tables import strip_sql

WIDE = "'ＡＢＣＤＥＲＪａｂｃｄｅ０１２３４５６７８９＃－　'"
NARROW = "'ABCDERJabcde0123456789#- '"
FOLD = f"translate({{}}, {WIDE}, {NARROW})"


def fold_sql(c: str) -> str:
    return FOLD.format(c)


def code_sql(c: str) -> str:
    return f"regexp_replace(upper({fold_sql(c)}), '[\\s\\-_]', '', 'g')"


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({fold_sql(c)}), '[^\\p{{L}}\\p{{Nd}} #+&]', ' ', 'g'), '\\s+', ' ', 'g'))"


def grams_sql(c: str, n: int = 2) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({c}) - {n - 2}, 1)), lambda k: substr({c}, k, {n})))"


def similarity_sql(a: str, b: str, ga: str, gb: str) -> str:
    """Similarity of normalised texts with their bigram lists."""
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 "
        f"WHEN least(length({a}), length({b})) >= 3 AND CASE WHEN length({a}) <= length({b}) THEN contains({b}, {a}) ELSE contains({a}, {b}) END "
        f"THEN 0.68 + 0.22 * (least(length({a}), length({b})) / greatest(length({a}), length({b}))) "
        f"WHEN len({ga}) = 0 OR len({gb}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({ga}, {gb})) / (len({ga}) + len({gb})) END"
    )


FEEDS["wide_texts"] = """
SELECT p_partkey AS id, replace(replace(p_name, 'a', 'ａ'), 'b', 'Ｂ') || CASE p_partkey % 5 WHEN 0 THEN '　＃' || cast(p_size AS string) WHEN 1 THEN '!!  (' || p_type || ')' WHEN 2 THEN '' WHEN 3 THEN ' & ' || p_brand ELSE '…' END AS text,
  CASE WHEN p_partkey % 3 = 0 THEN ' rj-' || cast(100000 + p_partkey AS string) ELSE 'ＲＪ　' || cast(p_partkey AS string) || '_x' END AS code FROM {part}
"""


@query("normalize_text", f"""
SELECT id, {norm_sql('text')} AS normal, {code_sql('code')} AS code, {fold_sql('text')} AS folded FROM wide_texts
""", ["wide_texts"])
def _(i):
    t, c = F.col("text"), F.col("code")
    return i.feed("wide_texts").select(
        "id", text.normalize_text(t).alias("normal"), text.normalize_code(c).alias("code"), text.fold_width(t).alias("folded")
    )


@query("normalize_header", f"SELECT item_id, regexp_replace(lower({strip_sql('text')}), '\\s+', ' ', 'g') AS header FROM benchmark")
def _(i):
    return i.table("benchmark").select("item_id", text.normalize_header(F.col("text")).alias("header"))


@query("nfkc", "SELECT id, replace(translate(text, 'ａＢ　＃', 'aB #'), '…', '...') AS searchable FROM wide_texts", ["wide_texts"])
def _(i):
    return i.feed("wide_texts").select("id", text.nfkc(F.col("text")).alias("searchable"))


FEEDS["text_pairs"] = """
SELECT a.doc_id AS a, b.doc_id AS b, a.text AS x, b.text AS y FROM {documents} a JOIN {documents} b ON b.doc_id = a.doc_id + 1
UNION ALL SELECT p_partkey, -1, p_name, p_name || ' ' || p_type FROM {part} UNION ALL SELECT p_partkey, -2, p_brand, upper(p_type) FROM {part} UNION ALL SELECT s_suppkey, -3, s_name, '  ' FROM {supplier}
"""


@query("text_similarity", f"""
WITH n AS (SELECT a, b, {norm_sql('x')} AS x, {norm_sql('y')} AS y FROM text_pairs), g AS (SELECT *, {grams_sql('x')} AS gx, {grams_sql('y')} AS gy FROM n)
SELECT a, b, round({similarity_sql('x', 'y', 'gx', 'gy')}, 6) AS similarity FROM g
""", ["text_pairs"])
def _(i):
    return i.feed("text_pairs").select("a", "b", F.round(text.text_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("similar_texts", f"""
WITH s AS (SELECT DISTINCT {norm_sql('text')} AS v FROM (SELECT unnest(string_split(text, '.')) AS text FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)) WHERE trim(text) <> ''),
p AS (SELECT DISTINCT {norm_sql('text')} AS v FROM (SELECT unnest(string_split(text, '.')) AS text FROM benchmark) WHERE trim(text) <> ''),
lg AS MATERIALIZED (SELECT v, {grams_sql('v')} AS g, length(v) AS n FROM p), rg AS MATERIALIZED (SELECT v, {grams_sql('v')} AS g, length(v) AS n FROM s)
SELECT md5(left_value) AS a, md5(right_value) AS b, round(similarity, 6) AS similarity FROM (
  SELECT lg.v AS left_value, rg.v AS right_value, {similarity_sql('lg.v', 'rg.v', 'lg.g', 'rg.g')} AS similarity FROM lg CROSS JOIN rg
  WHERE 3 * (len(lg.g) + len(rg.g)) <= 10 * least(len(lg.g), len(rg.g)) OR contains(lg.v, rg.v) OR contains(rg.v, lg.v)) WHERE similarity >= 0.6
""")
def _(i):
    """Every sentence of the benchmark against every sentence of all documents and turns."""
    sentences = lambda *names: reduce(lambda a, b: a.unionByName(b), [i.table(n).select("text") for n in names]).select(
        F.explode(F.split("text", r"\.")).alias("text")
    ).filter("trim(text) <> ''").select(F.lit("t").alias("kind"), text.normalize_text(F.col("text")).alias("value"))
    found = linkage.similar_texts(sentences("benchmark"), sentences("documents", "conversations"))
    return found.select(F.md5("left_value").alias("a"), F.md5("right_value").alias("b"), F.round("similarity", 6).alias("similarity"))


# Natural order: the rank of a name is how many distinct names sort before it.
FEEDS["file_names"] = """
SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'Image' ELSE 'image' END || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE '00' END || cast(p_partkey AS string) || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '.part' || cast(p_size AS string) END AS name FROM {part}
"""


@query("natural_sort", """
SELECT name, row_number() OVER (ORDER BY cast(regexp_extract(name, '(\\d+)', 1) AS int), CASE WHEN contains(name, '.part') THEN 1 ELSE 0 END, try_cast(regexp_extract(name, 'part(\\d+)', 1) AS int), name) AS place FROM file_names
""", ["file_names"])
def _(i):
    names = i.feed("file_names").withColumn("key", text.natural_sort_key(F.col("name")))
    return ranked(names, ["key", "name"], "place").select("name", "place")


@query("default_order_key", """
SELECT l_orderkey, l_linenumber, CASE WHEN t IS NULL THEN 2 WHEN try_cast(t AS double) IS NOT NULL THEN 0 ELSE 1 END AS kind, round(try_cast(t AS double), 4) AS number, CASE WHEN try_cast(t AS double) IS NULL THEN lower(t) END AS folded
FROM (SELECT l_orderkey, l_linenumber, nullif(trim(CASE l_linenumber % 4 WHEN 0 THEN ' ' || l_quantity || ' ' WHEN 1 THEN l_returnflag || l_suppkey WHEN 2 THEN '  ' ELSE '-7' || l_discount || 'e1' END), '') AS t FROM lineitem)
""")
def _(i):
    raw = F.expr("CASE l_linenumber % 4 WHEN 0 THEN ' ' || l_quantity || ' ' WHEN 1 THEN l_returnflag || l_suppkey WHEN 2 THEN '  ' ELSE '-7' || l_discount || 'e1' END")
    keyed = i.table("lineitem").withColumn("k", text.default_order_key(raw))
    return keyed.select("l_orderkey", "l_linenumber", "k.kind", F.round("k.approx", 4).alias("number"), "k.folded")


FEEDS["date_texts"] = """
SELECT o_orderkey AS id, CASE o_orderkey % 9
  WHEN 0 THEN cast(year(o_orderdate) AS string) WHEN 1 THEN cast(year(o_orderdate) AS string) || ' 年' WHEN 2 THEN cast(year(o_orderdate) AS string) || '-' || cast(month(o_orderdate) AS string)
  WHEN 3 THEN cast(year(o_orderdate) AS string) || '年' || cast(month(o_orderdate) AS string) || '月' || cast(day(o_orderdate) AS string) || '日'
  WHEN 4 THEN ' ' || cast(year(o_orderdate) AS string) || '/' || cast(month(o_orderdate) AS string) || '/' || cast(28 + o_custkey % 5 AS string) || ' '
  WHEN 5 THEN cast(9000 + o_orderkey * 3 AS string) || '.5' WHEN 6 THEN cast(1800 + o_custkey AS string) || '.' || cast(o_custkey % 15 AS string)
  WHEN 7 THEN '' ELSE o_orderpriority END AS raw FROM {orders}
"""


@query("parse_partial_date", f"SELECT id, {date_sql('raw')} AS sort_key FROM date_texts", ["date_texts"])
def _(i):
    parsed = dates.parse_partial_date(F.col("raw"), serial=True)
    return i.feed("date_texts").select("id", parsed["sort_key"].alias("sort_key"))


SERIAL_1904 = "try_cast(regexp_extract(trim(raw), '^(\\d{5,7})(\\.\\d+)?$', 1) AS int)"


@query("parse_serial_date", f"""
SELECT id, CASE WHEN {SERIAL_1904} BETWEEN 10000 AND 2958465 AND year(DATE '1904-01-01' + {SERIAL_1904}) <= 2100 THEN strftime(DATE '1904-01-01' + {SERIAL_1904}, '%Y-%m-%d') END AS label FROM date_texts
""", ["date_texts"])
def _(i):
    return i.feed("date_texts").select("id", dates.parse_serial_date(F.col("raw"), date1904=True)["label"].alias("label"))


@query("date_is_malformed", f"SELECT id, trim(raw) <> '' AND ({date_sql('raw')}) IS NULL AS malformed FROM date_texts", ["date_texts"])
def _(i):
    return i.feed("date_texts").select("id", dates.date_is_malformed(F.col("raw"), True).alias("malformed"))


LETTERS = (
    "CASE WHEN col < 26 THEN chr((65 + col)::INT) WHEN col < 702 THEN chr((65 + col // 26 - 1)::INT) || chr((65 + col % 26)::INT) "
    "ELSE chr((65 + (col - 702) // 676)::INT) || chr((65 + (col - 702) // 26 % 26)::INT) || chr((65 + (col - 702) % 26)::INT) END"
)


@query("a1_format", f"""
SELECT p_partkey, ref, row_number, col FROM (SELECT p_partkey, {LETTERS} || (p_partkey + 1) AS ref, p_partkey AS row_number, col FROM (SELECT p_partkey, p_partkey * 7 % 16384 AS col FROM part))
""")
def _(i):
    ref = cellref.a1_format(F.col("p_partkey"), F.col("p_partkey") * 7 % 16384)
    parsed = i.table("part").select("p_partkey", ref.alias("ref")).withColumn(
        "at", cellref.a1_parse(F.concat(F.lit(" $"), F.lower("ref"), F.lit(" ")))
    )
    return parsed.select("p_partkey", "ref", F.col("at.row").alias("row_number"), F.col("at.col").alias("col"))


@query("parse_range", """
SELECT s_suppkey, s_nationkey + 1 - 1 AS row_from, s_suppkey + s_nationkey AS row_to, least(1, s_nationkey) AS col_from, greatest(1, s_nationkey) AS col_to FROM supplier
""")
def _(i):
    s = i.table("supplier")
    ref = F.concat(
        cellref.a1_format(F.col("s_suppkey") + F.col("s_nationkey"), F.lit(1)), F.lit(":"), cellref.a1_format(F.col("s_nationkey"), F.col("s_nationkey"))
    )
    return s.select("s_suppkey", cellref.parse_range(ref).alias("r")).select("s_suppkey", "r.*")


FEEDS["links"] = """
SELECT 'book' AS workbook, 'xl/s' || cast(s_nationkey AS string) || '.xml' AS sheet_key, 's' || cast(s_nationkey AS string) AS sheet, s_suppkey AS ord,
  CASE s_suppkey % 4 WHEN 0 THEN 'B' || cast(1 + s_suppkey % 9 AS string) WHEN 1 THEN 'D9:$B$' || cast(1 + s_suppkey % 9 AS string) WHEN 2 THEN 'A1:ZZ' || cast(1 + 200 * s_suppkey AS string) ELSE 'not a cell' END AS ref,
  CASE WHEN s_suppkey % 3 = 0 THEN ' Sheet1!A1 ' ELSE '' END AS location, 'rId' || cast(s_suppkey % 5 AS string) AS rel_id, CASE WHEN s_acctbal > 5000 THEN s_name END AS display
FROM {supplier}
"""
FEEDS["link_rels"] = """
SELECT 'book' AS workbook, 'xl/s' || cast(n_nationkey AS string) || '.xml' AS sheet_key, 'rId' || cast(n_regionkey AS string) AS rel_id, 'https://x.example/' || n_name AS target, n_nationkey % 2 = 0 AS external FROM {nation}
"""


FEEDS["link_cells"] = """
SELECT 'book' AS workbook, 'xl/s' || cast(c_nationkey AS string) || '.xml' AS sheet_key, 's' || cast(c_nationkey AS string) AS sheet,
  cast(c_custkey * 7 AS int) AS row, cast(c_custkey % 5 AS int) AS col FROM {customer}
UNION ALL
SELECT 'book', 'xl/s' || cast(s_nationkey AS string) || '.xml', 's' || cast(s_nationkey AS string), cast(s_suppkey % 9 AS int), 1 FROM {supplier}
"""
RANGES = """
WITH l AS (
  SELECT k.sheet_key, k.ord, coalesce(nullif(trim(k.location), ''), r.target) AS target, CASE WHEN trim(k.location) <> '' THEN true ELSE NOT r.external END AS internal, k.display AS label,
    CASE k.ord % 4 WHEN 0 THEN k.ord % 9 WHEN 1 THEN least(8, k.ord % 9) ELSE 0 END AS row_from, CASE k.ord % 4 WHEN 0 THEN k.ord % 9 WHEN 1 THEN greatest(8, k.ord % 9) ELSE 200 * k.ord END AS row_to,
    CASE k.ord % 4 WHEN 2 THEN 0 ELSE 1 END AS col_from, CASE k.ord % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 701 END AS col_to
  FROM links k LEFT JOIN link_rels r USING (sheet_key, rel_id) WHERE k.ord % 4 <> 3
)
"""


@query("link_ranges", RANGES + """
SELECT sheet_key, ord, row_from, CASE WHEN (row_to - row_from + 1) * (col_to - col_from + 1) > 1024 THEN row_from ELSE row_to END AS row_to, col_from,
  CASE WHEN (row_to - row_from + 1) * (col_to - col_from + 1) > 1024 THEN col_from ELSE col_to END AS col_to, target, internal, label FROM l WHERE target IS NOT NULL
""", ["links", "link_rels"])
def _(i):
    return tables.link_ranges(i.feed("links"), i.feed("link_rels"), max_cells=1024).drop("workbook", "sheet")


@query("expand_links", RANGES + """
SELECT sheet_key, row, col, target, internal, label FROM (
  SELECT c.sheet_key, c.row, c.col, l.target, l.internal, l.label, row_number() OVER (PARTITION BY c.sheet_key, c.row, c.col ORDER BY l.ord DESC) AS rn
  FROM (SELECT DISTINCT sheet_key, row, col FROM link_cells) c
  JOIN l ON l.sheet_key = c.sheet_key AND c.row BETWEEN l.row_from AND l.row_to AND c.col BETWEEN l.col_from AND l.col_to WHERE l.target IS NOT NULL) WHERE rn = 1
""", ["links", "link_rels", "link_cells"])
def _(i):
    ranges = tables.link_ranges(i.feed("links"), i.feed("link_rels"))
    return tables.expand_links(i.feed("link_cells"), ranges).select("sheet_key", "row", "col", "target", "internal", "label")


@query("exclude_pivot_sheets", """
SELECT sheet_key FROM (SELECT DISTINCT sheet_key FROM links) WHERE sheet_key NOT IN (SELECT sheet_key FROM link_rels WHERE rel_id = 'rId3')
""", ["links", "link_rels"])
def _(i):
    from colophon.operators.tables import exclude_pivot_sheets

    sheets = i.feed("links").select("workbook", "sheet_key", "sheet").distinct()
    kinds = i.feed("link_rels").withColumn("kind", F.when(F.col("rel_id") == "rId3", "pivotTable").otherwise("drawing"))
    return exclude_pivot_sheets(sheets, kinds).select("sheet_key")


FEEDS["format_codes"] = """
SELECT l_orderkey AS a, l_linenumber AS b, cast(l_partkey % 60 AS int) AS format_id, CASE l_suppkey % 16 WHEN 0 THEN 'yyyy-mm-dd' WHEN 1 THEN 'h:mm AM/PM' WHEN 2 THEN '[h]:mm:ss' WHEN 3 THEN '0.00%' WHEN 4 THEN '#,##0.00'
  WHEN 5 THEN '"yes";d' WHEN 6 THEN '"mdy" 0' WHEN 7 THEN '[Red]0.0;[Blue]-0.0' WHEN 8 THEN '@' WHEN 9 THEN 'mmm' WHEN 10 THEN 'd/m/yy h:mm' WHEN 11 THEN '0.0E+00' WHEN 12 THEN '_-* #,##0' WHEN 13 THEN 'General' ELSE ' ' END AS code,
  CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE cast(round(l_quantity * l_partkey / 7, 4) AS string) END AS raw, l_linenumber % 5 <> 0 AS numeric, l_returnflag = 'A' AS date1904 FROM {lineitem}
"""
KIND = """
CASE WHEN trim(code) <> '' THEN CASE l WHEN 'yyyy-mm-dd' THEN 'DATE' WHEN 'h:mm AM/PM' THEN 'TIME' WHEN '[h]:mm:ss' THEN 'TIME' WHEN '0.00%' THEN 'PERCENT' WHEN '#,##0.00' THEN 'NUMBER' WHEN '"yes";d' THEN 'GENERAL' WHEN '"mdy" 0' THEN 'GENERAL'
    WHEN '[Red]0.0;[Blue]-0.0' THEN 'NUMBER' WHEN 'mmm' THEN 'DATE' WHEN 'd/m/yy h:mm' THEN 'DATE_TIME' WHEN '0.0E+00' THEN 'NUMBER' ELSE 'GENERAL' END
  WHEN format_id IN (9, 10) THEN 'PERCENT' WHEN format_id BETWEEN 14 AND 17 THEN 'DATE' WHEN format_id BETWEEN 18 AND 21 OR format_id BETWEEN 32 AND 36 OR format_id BETWEEN 45 AND 47 OR format_id BETWEEN 55 AND 58 THEN 'TIME'
  WHEN format_id = 22 OR format_id BETWEEN 27 AND 31 OR format_id BETWEEN 50 AND 54 THEN 'DATE_TIME' WHEN format_id IN (2, 4) OR format_id BETWEEN 39 AND 44 THEN 'NUMBER' ELSE 'GENERAL' END
"""


@query("classify_format", f"SELECT a, b, {KIND.replace('CASE l ', 'CASE code ').replace(chr(10), ' ')} AS kind FROM format_codes", ["format_codes"])
def _(i):
    return i.feed("format_codes").select("a", "b", formats.classify_format(F.col("format_id"), F.col("code")).alias("kind"))


@query("display_value", f"""
WITH k AS (SELECT *, {KIND.replace('CASE l ', 'CASE code ').replace(chr(10), ' ')} AS kind, try_cast(raw AS double) AS v FROM format_codes
), p AS (SELECT *, floor(v)::BIGINT AS whole, round((v - floor(v)) * 86400)::BIGINT AS s0 FROM k
), q AS (SELECT *, CASE WHEN s0 >= 86400 THEN whole + 1 ELSE whole END AS days, CASE WHEN s0 >= 86400 THEN s0 - 86400 ELSE s0 END AS s FROM p
), d AS (SELECT *, CASE WHEN date1904 THEN DATE '1904-01-01' + days::INT WHEN days >= 61 THEN DATE '1899-12-30' + days::INT WHEN days BETWEEN 1 AND 59 THEN DATE '1899-12-31' + days::INT END AS day FROM q
), t AS (SELECT *, strftime(day, '%Y-%m-%d') AS dt, CASE WHEN s > 0 THEN printf('%02d:%02d', (s // 3600)::INT, (s % 3600 // 60)::INT) || CASE WHEN s % 60 = 0 THEN '' ELSE printf(':%02d', (s % 60)::INT) END END AS tm FROM d
)
SELECT a, b, CASE WHEN NOT numeric OR v IS NULL THEN raw WHEN kind = 'PERCENT' THEN regexp_replace(printf('%.2f', v * 100), '\\.?0+$', '') || '%' WHEN kind = 'NUMBER' THEN raw_number
  WHEN kind = 'DATE' THEN coalesce(dt, raw) WHEN kind = 'TIME' AND NOT (dt IS NULL AND s = 0) THEN coalesce(tm, '00:00') WHEN kind = 'DATE_TIME' AND NOT (dt IS NULL AND s = 0) THEN concat_ws(' ', dt, tm) ELSE raw END AS shown
FROM (SELECT *, CASE WHEN regexp_matches(f2, '\\.') THEN regexp_replace(f2, '\\.?0+$', '') ELSE f2 END AS raw_number FROM (SELECT *, printf('%.2f', v) AS f2 FROM t))
""", ["format_codes"])
def _(i):
    kind = formats.classify_format(F.col("format_id"), F.col("code"))
    shown = formats.display_value(kind, F.col("raw"), F.col("numeric"), F.col("date1904"))
    return i.feed("format_codes").select("a", "b", shown.alias("shown"))


# Web addresses: the pages' own and awkward ones made from them.
FEEDS["addresses"] = """
SELECT page_id * 10 AS id, url FROM {pages} UNION ALL SELECT page_id * 10 + 1, replace(replace(url, 'https://', 'HTTPS://USER@'), 'http://', 'http://') FROM {pages}
UNION ALL SELECT page_id * 10 + 2, replace(replace(url, '.com/', '.com:443/'), '.org/', '.ORG:8080/') || CASE WHEN url LIKE '%?%' THEN '&utm_x=1&gclid=2&k=v' ELSE '/' END FROM {pages}
UNION ALL SELECT page_id * 10 + 3, CASE page_id % 8 WHEN 0 THEN 'https://10.1.2.3/a.png' WHEN 1 THEN 'https://172.20.0.1/a' WHEN 2 THEN 'https://8.8.8.8/x' WHEN 3 THEN 'https://printer.local/x.jpg' WHEN 4 THEN 'https://nodot/x' WHEN 5 THEN ' https://img.example.org/a b.png' WHEN 6 THEN 'ftp://f.example.org/' ELSE 'just text' END FROM {pages}
"""
HOST = "lower(regexp_extract(trim(url), '^[A-Za-z]+://(?:[^@/?#]*@)?([^/?#:]+)', 1))"
CLEAN_URL = "regexp_full_match(trim(url), '[A-Za-z]+://\\S+')"


@query("normalise_url", f"""
WITH p AS (SELECT id, trim(url) AS u, {HOST} AS host, lower(regexp_extract(trim(url), '^([A-Za-z]+)://', 1)) AS scheme, regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*?(?::(\\d+))?(?:[/?#]|$)', 1) AS port,
    regexp_replace(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(trim(url), '\\?([^#]*)', 1) AS q, {CLEAN_URL} AS fine FROM addresses
), k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ('gclid', 'fbclid', 'ref_src', 'spm')), '&') AS kept FROM p)
SELECT id, CASE WHEN fine AND scheme IN ('http', 'https') AND host <> '' THEN 'https://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END || path || CASE WHEN kept = '' THEN '' ELSE '?' || kept END END AS normal,
  CASE WHEN fine THEN nullif(host, '') END AS domain FROM k
""", ["addresses"])
def _(i):
    u = F.col("url")
    return i.feed("addresses").select("id", urls.normalise_url(u).alias("normal"), urls.url_domain(u).alias("domain"))


@query("valid_url", """
SELECT id, regexp_matches(trim(url), '(?i)^https?://[^/?]*') AND contains(h, '.') AND NOT starts_with(h, '.') AND NOT ends_with(h, '.') AS valid FROM (SELECT *, regexp_extract(trim(url), '(?i)^https?://([^/?]*)', 1) AS h FROM addresses)
""", ["addresses"])
def _(i):
    return i.feed("addresses").select("id", urls.valid_url(F.col("url")).alias("valid"))


@query("is_safe_image_url", f"""
SELECT id, fine AND scheme = 'https' AND NOT contains(u, '@') AND NOT regexp_matches(u, ':\\d+') AND contains(host, '.') AND host NOT LIKE '%.local' AND host NOT IN ('10.1.2.3', '172.20.0.1') OR (fine AND scheme = 'https' AND contains(u, ':443') AND NOT contains(u, '@')) AS safe
FROM (SELECT id, trim(url) AS u, {HOST} AS host, lower(regexp_extract(trim(url), '^([A-Za-z]+)://', 1)) AS scheme, {CLEAN_URL} AS fine FROM addresses)
""", ["addresses"])
def _(i):
    return i.feed("addresses").select("id", urls.is_safe_image_url(F.col("url")).alias("safe"))


@query("item_fingerprint", f"""
SELECT id, CASE WHEN id % 3 = 0 THEN 'dl:rj' || id WHEN fine THEN 'url:' || 'x' WHEN id % 4 = 1 THEN 'wb:B' || id ELSE 'title:' || lower(trim(url)) END AS fingerprint FROM (
  SELECT id, url, {CLEAN_URL} AND lower(url) LIKE '%http%' AS fine FROM addresses)
""", ["addresses"])
def _(i):
    none = F.lit(None).cast("string")
    key = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" DL:RJ"), F.col("id").cast("string"))).otherwise(" ")
    cell = F.when(F.col("id") % 4 == 1, F.concat(F.lit("b"), F.col("id").cast("string"))).otherwise(none)
    full = urls.item_fingerprint(key, F.col("url"), cell, F.col("url"))
    return i.feed("addresses").select("id", F.regexp_replace(full, "^url:.*", "url:x").alias("fingerprint"))


# Linkage: suppliers' offers of a part against the catalogue of parts.
FEEDS["offers"] = """
SELECT 'o' || lpad(cast(s_suppkey AS string), 7, '0') AS key, CASE WHEN s_suppkey % 9 = 4 THEN '  ' ELSE CASE s_suppkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' vol ' || cast(s_suppkey % 7 AS string) WHEN 2 THEN replace(p_name, 'e', 'ｅ') WHEN 3 THEN substr(p_name, 2) ELSE 'nothing alike' END END AS title,
  CASE WHEN s_suppkey % 4 = 3 THEN '' ELSE p_brand END AS circle, CASE WHEN s_suppkey % 6 = 5 THEN '' WHEN s_suppkey % 6 = 4 THEN p_type || 'X' ELSE p_type END AS author,
  CASE WHEN s_suppkey % 7 = 0 THEN 'rj ' || lpad(cast(p_partkey AS string), 6, '0') WHEN s_suppkey % 7 = 1 THEN 'RJ999999' ELSE '' END AS identifier
FROM {supplier} JOIN {part} ON p_partkey = s_suppkey
"""
FEEDS["products"] = """
SELECT 'p' || lpad(cast(p_partkey AS string), 7, '0') AS key, CASE WHEN p_partkey % 13 = 7 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 8 = 1 THEN ' ' ELSE p_brand END AS circle,
  CASE WHEN p_partkey % 10 = 2 THEN '' ELSE p_type END AS author, CASE WHEN p_size < 25 THEN 'RJ' || lpad(cast(p_partkey AS string), 6, '0') ELSE '' END AS identifier FROM {part}
"""


def _side_sql(feed: str) -> str:
    given = ", ".join(f"CASE WHEN trim({t}) <> '' THEN {norm_sql(t)} END AS {t}" for t in linkage.TEXTS)
    return f"SELECT key, {given}, nullif({code_sql('identifier')}, '') AS code FROM {feed}"


_SIMS = ", ".join(
    f"CASE WHEN c.{t} IS NOT NULL AND l.{t} IS NOT NULL THEN {similarity_sql(f'c.{t}', f'l.{t}', f'c.{t}_g', f'l.{t}_g')} END AS s_{t}" for t in linkage.TEXTS
)
LINKED = f"""
WITH c0 AS ({_side_sql('offers')}), l0 AS ({_side_sql('products')}),
cp AS (SELECT title, circle, author, code, count(*) AS copies, min(key) AS first_key FROM c0 GROUP BY ALL), lp AS (SELECT title, circle, author, code, count(*) AS copies, min(key) AS first_key FROM l0 GROUP BY ALL),
c AS (SELECT *, {", ".join(f"{grams_sql(t)} AS {t}_g" for t in linkage.TEXTS)} FROM cp), l AS (SELECT *, {", ".join(f"{grams_sql(t)} AS {t}_g" for t in linkage.TEXTS)} FROM lp),
covers AS (SELECT c.first_key AS ck, l.first_key AS lk, (length(c.title) % 5) / 4.0 AS cover FROM cp c JOIN lp l ON substr(c.first_key, 2) = substr(l.first_key, 2)),
sims AS (
  SELECT c.first_key AS offer, l.first_key AS product, l.copies, CASE WHEN c.code IS NOT NULL AND l.code IS NOT NULL THEN (c.code = l.code)::INT::DOUBLE END AS s_identifier, {_SIMS}, v.cover AS s_cover
  FROM c CROSS JOIN l LEFT JOIN covers v ON v.ck = c.first_key AND v.lk = l.first_key
), states AS (
  SELECT *, CASE WHEN s_identifier IS NULL THEN 'UNKNOWN' WHEN s_identifier >= 1 THEN 'MATCH' ELSE 'MISMATCH' END AS e_identifier,
    {", ".join(f"CASE WHEN s_{t} IS NULL THEN 'UNKNOWN' WHEN s_{t} >= 0.92 THEN 'MATCH' WHEN s_{t} >= 0.6 THEN 'PARTIAL' ELSE 'MISMATCH' END AS e_{t}" for t in linkage.TEXTS)},
    CASE WHEN s_cover IS NULL THEN 'UNKNOWN' WHEN s_cover >= 0.85 THEN 'MATCH' WHEN s_cover >= 0.6 THEN 'PARTIAL' ELSE 'MISMATCH' END AS e_cover,
    {" + ".join(f"CASE WHEN s_{d} IS NULL THEN 0.0::DOUBLE ELSE {w}::DOUBLE * s_{d} END" for d, w in linkage.WEIGHTS.items())} AS weighted,
    {" + ".join(f"CASE WHEN s_{d} IS NULL THEN 0.0::DOUBLE ELSE {w}::DOUBLE END" for d, w in linkage.WEIGHTS.items())} AS total FROM sims
), scored AS (SELECT *, CASE WHEN total > 0 THEN floor(weighted / total * 100)::INT ELSE 0 END AS score FROM states
), judged AS MATERIALIZED (
  SELECT *, CASE WHEN total = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN e_identifier = 'MATCH' THEN 'LIKELY_MATCH'
    WHEN 'MISMATCH' IN (e_identifier, e_title, e_circle, e_author, e_cover) THEN 'NO_MATCH' WHEN score >= 72 AND e_title = 'MATCH' AND 'MATCH' IN (e_circle, e_author, e_cover) THEN 'LIKELY_MATCH'
    WHEN score >= 50 THEN 'POSSIBLE_MATCH' ELSE 'NO_MATCH' END AS verdict FROM scored
), matches AS MATERIALIZED (SELECT *, CASE verdict WHEN 'LIKELY_MATCH' THEN 4 ELSE 3 END AS quality FROM judged WHERE verdict IN ('LIKELY_MATCH', 'POSSIBLE_MATCH')
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY offer ORDER BY quality DESC, score DESC, product) AS rn FROM matches) WHERE rn = 1
), near AS (SELECT m.* FROM matches m JOIN best b ON b.offer = m.offer WHERE b.score - m.score <= 8)
"""
LINK_FEEDS = ["offers", "products"]


class Linked:
    def __init__(self, i):
        self.offers, self.products = i.feed("offers"), i.feed("products")
        self.c = i.keep("offer_profiles", lambda: linkage.profiles(self.offers))
        self.l = i.keep("product_profiles", lambda: linkage.profiles(self.products))
        number = lambda df: df.withColumn("n", F.expr("substr(first_key, 2)"))
        self.covers = number(self.c).select(F.col("profile").alias("c"), "n", ((F.length("title") % 5) / 4.0).alias("cover_similarity")).join(
            number(self.l).select(F.col("profile").alias("l"), "n"), "n"
        ).drop("n")
        self.i = i

    def views(self):
        return self.i.keep("match_views", lambda: linkage.match_views(self.c, self.l, self.covers).drop("evidence"))

    def states(self):
        return self.i.keep("match_states", lambda: linkage.match_states(self.views()))

    def named(self, df):
        return df.join(self.c.select(F.col("profile").alias("c"), F.col("first_key").alias("offer")), "c")


@query("profiles", LINKED + " SELECT title, circle, author, code, copies, first_key FROM lp", LINK_FEEDS)
def _(i):
    return linkage.profiles(i.feed("products")).drop("profile")


@query("match_profiles", LINKED + " SELECT offer, product, score, verdict, copies FROM matches", LINK_FEEDS)
def _(i):
    k = Linked(i)
    return k.named(linkage.match_profiles(k.c, k.l, k.covers)).select("offer", F.col("first_key").alias("product"), "score", "verdict", "copies")


@query("pair_evidence", LINKED + """
SELECT offer, product, e_identifier, e_title, e_circle, e_author, e_cover, round(s_title, 6) AS s_title, score FROM judged WHERE verdict IN ('LIKELY_MATCH', 'POSSIBLE_MATCH')
""", LINK_FEEDS)
def _(i):
    """Evidence of a pair by text is that of its view: texts are compared once for all profiles that share them."""
    k = Linked(i)
    judged = linkage.spelled_out(linkage.match_views(k.c, k.l, k.covers), k.l, k.covers, ("evidence",)).withColumnRenamed("first_key", "product")
    named = k.named(judged)
    states = [F.col("evidence")[n]["state"].alias(f"e_{d}") for n, d in enumerate(linkage.WEIGHTS)]
    return named.select("offer", "product", *states, F.round(F.col("evidence")[1]["similarity"], 6).alias("s_title"), "score")


@query("rank_matches", LINKED + " SELECT offer, product, verdict, score FROM matches", LINK_FEEDS)
def _(i):
    k = Linked(i)
    return k.named(linkage.rank_matches(linkage.spelled_out(k.views(), k.l, k.covers))).select("offer", F.col("first_key").alias("product"), "verdict", "score")


@query("best_matches", LINKED + " SELECT offer, product, verdict, score FROM best", LINK_FEEDS)
def _(i):
    k = Linked(i)
    return k.named(linkage.best_matches(k.states())).select("offer", F.col("first_key").alias("product"), "verdict", "score")


@query("ambiguous_matches", LINKED + " SELECT offer, product, score FROM near", LINK_FEEDS)
def _(i):
    k = Linked(i)
    return k.named(linkage.ambiguous_matches(k.views(), k.states(), k.l, k.covers)).select("offer", F.col("first_key").alias("product"), "score")


@query("match_states", LINKED + """
, n AS (SELECT offer, count(*) AS near, sum(copies)::BIGINT AS near_copies FROM near GROUP BY ALL), t AS (SELECT offer, count(*) AS total FROM matches GROUP BY ALL)
SELECT b.offer, b.product, b.verdict, b.score, n.near, n.near_copies, t.total - n.near AS rest FROM best b JOIN n USING (offer) JOIN t USING (offer)
""", LINK_FEEDS)
def _(i):
    k = Linked(i)
    return k.named(k.states()).select("offer", F.col("first_key").alias("product"), "verdict", "score", "near", "near_copies", "rest")


@query("collection_status", LINKED + """
, open_offers AS (SELECT DISTINCT offer FROM judged WHERE verdict = 'INSUFFICIENT_EVIDENCE'), members AS (SELECT offer, sum(copies) AS near FROM near GROUP BY ALL)
SELECT o.key, CASE WHEN m.near > 1 THEN 'AMBIGUOUS' WHEN b.verdict = 'LIKELY_MATCH' THEN 'MATCHED' WHEN b.verdict = 'POSSIBLE_MATCH' THEN 'AMBIGUOUS' WHEN u.offer IS NOT NULL THEN 'UNKNOWN' ELSE 'ABSENT' END AS catalogued,
  CASE WHEN o.n % 3 = 0 THEN o.n % 2 = 0 END AS owned, CASE WHEN o.n % 3 = 0 THEN true END AS wanted
FROM (SELECT c0.key, cast(substr(c0.key, 2) AS int) AS n, p.first_key FROM c0 JOIN cp p ON c0.title IS NOT DISTINCT FROM p.title AND c0.circle IS NOT DISTINCT FROM p.circle AND c0.author IS NOT DISTINCT FROM p.author AND c0.code IS NOT DISTINCT FROM p.code) o
LEFT JOIN best b ON b.offer = o.first_key LEFT JOIN members m ON m.offer = o.first_key LEFT JOIN open_offers u ON u.offer = o.first_key
""", LINK_FEEDS)
def _(i):
    k = Linked(i)
    status = linkage.collection_status(k.c, k.l, k.states())
    n = F.expr("cast(substr(key, 2) AS int)")
    flags = k.offers.filter(n % 3 == 0).select("key", (n % 2 == 0).alias("owned"), F.lit(True).alias("wanted"))
    return linkage.with_ownership(linkage.profile_members(k.offers), status, flags)


@query("local_products", "WITH l AS (SELECT * FROM products) SELECT key, trim(title) AS title FROM l", ["products"])
def _(i):
    entry = i.feed("products").select(F.col("key").alias("id"), *[
        F.struct(F.nullif(F.trim(F.col(c)), F.lit("")).alias("text")).alias(f)
        for f, c in (("title", "title"), ("circle", "circle"), ("artist", "author"), ("identifier", "identifier"))
    ])
    return linkage.local_products(entry).select("key", "title")


FEEDS["decision_log"] = """
SELECT CASE WHEN l_partkey % 50 = 0 THEN ' ' ELSE 'k' || cast(l_partkey AS string) END AS key, CASE l_returnflag WHEN 'A' THEN 'CONFIRMED' WHEN 'R' THEN 'REJECTED' ELSE 'SUGGESTED' END AS decision,
  l_orderkey AS decided_at, l_linenumber AS seq, l_linestatus AS title, 'p' || cast(l_suppkey % 4 AS string) AS provider, CASE WHEN l_suppkey % 2 = 0 THEN 'https://x.example/' || cast(l_suppkey AS string) ELSE '' END AS url FROM {lineitem}
"""
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY decided_at DESC, seq DESC) AS rn FROM decision_log WHERE trim(key) <> '') WHERE rn = 1)"


def _settled(i):
    log = i.feed("decision_log")
    # Orders may repeat a line number for one part; keep the log free of exact ties.
    return linkage.apply_decisions(log.filter("seq <= 4"), log.filter("seq > 4"))


@query("apply_decisions", f"WITH {LATEST} SELECT key, decision, decided_at FROM latest", ["decision_log"])
def _(i):
    return _settled(i).select("key", "decision", "decided_at")


@query("decision_state", f"WITH {LATEST} SELECT p.p_partkey AS id, coalesce(l.decision, 'SUGGESTED') AS decision FROM part p LEFT JOIN latest l ON l.key = 'k' || p.p_partkey", ["decision_log"])
def _(i):
    candidates = i.table("part").select(F.col("p_partkey").alias("id"), F.expr("'k' || p_partkey").alias("key"))
    return linkage.decision_state(candidates, _settled(i)).select("id", "decision")


@query("undecided", f"WITH {LATEST} SELECT p.p_partkey AS id FROM part p LEFT JOIN latest l ON l.key = 'k' || p.p_partkey WHERE coalesce(l.decision, 'SUGGESTED') = 'SUGGESTED'", ["decision_log"])
def _(i):
    candidates = i.table("part").select(F.col("p_partkey").alias("id"), F.expr("'k' || p_partkey").alias("key"))
    return linkage.undecided(candidates, _settled(i)).select("id")


@query("decided_keys", f"WITH {LATEST} SELECT key FROM latest WHERE decision = 'REJECTED'", ["decision_log"])
def _(i):
    return linkage.decided_keys(_settled(i), "REJECTED")
