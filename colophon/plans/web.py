"""Queries over search logs, recognised text, stored pages and provider replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from colophon.functions.text import nfkc
from colophon.operators import merge, ocr, pages, replies, search
from colophon.plans.inputs import FEEDS, query

FEEDS["search_log"] = """
SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'title:' || p_name || ' c:' || p_brand || ' circle:' || p_type WHEN 1 THEN p_name || ' RJ' || lpad(cast(p_partkey AS string), 6, '0') || ' extra' WHEN 2 THEN 'A:' || p_type || '  ' || p_name || '　t:' || p_brand
  WHEN 3 THEN 'ｒｊ ' || lpad(cast(p_partkey AS string), 6, '0') || ' ' || p_name WHEN 4 THEN 'id:rj-' || cast(p_partkey AS string) || ' author:' || p_brand WHEN 5 THEN '  ' ELSE 'r:X1 ' || p_name || '(RJ' || lpad(cast(p_partkey AS string), 7, '0') || ') rj' END AS text,
  CASE p_partkey % 3 WHEN 0 THEN 'img' || cast(p_partkey AS string) END AS image FROM {part}
"""
_FIELDS = """
SELECT id, image, p_name, CASE id % 7 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' extra' WHEN 2 THEN p_name || ' ' || p_brand WHEN 3 THEN p_name WHEN 4 THEN '' WHEN 5 THEN '' ELSE p_name || '()' END AS title,
  CASE id % 7 WHEN 0 THEN p_type ELSE '' END AS circle, CASE id % 7 WHEN 2 THEN p_type WHEN 4 THEN p_brand ELSE '' END AS author,
  CASE id % 7 WHEN 1 THEN 'RJ' || lpad(id::VARCHAR, 6, '0') WHEN 3 THEN 'RJ' || lpad(id::VARCHAR, 6, '0') WHEN 4 THEN 'RJ' || id WHEN 6 THEN 'RJ' || lpad(id::VARCHAR, 7, '0') ELSE '' END AS code
FROM (SELECT p_partkey AS id, p_name, p_brand, p_type, CASE p_partkey % 3 WHEN 0 THEN 'img' || p_partkey END AS image FROM part)
"""
PARSED = f"""
parsed AS (SELECT *, array_to_string(list_filter([code, title, circle, author], lambda v: v <> ''), ' ') AS keyword,
  list_filter([CASE WHEN title <> '' THEN 'TITLE' END, CASE WHEN circle <> '' THEN 'CIRCLE' END, CASE WHEN author <> '' THEN 'AUTHOR' END, CASE WHEN code <> '' THEN 'CODE' END, CASE WHEN image IS NOT NULL THEN 'IMAGE_REFERENCE' END], lambda f: f IS NOT NULL) AS fields
FROM ({_FIELDS}))
"""


def _parsed(i):
    return search.parse_search_queries(i.spread("search_log"), image="image")


@query("parse_search_queries", f"WITH {PARSED} SELECT id, title, circle, author, code, keyword, array_to_string(fields, ',') AS fields FROM parsed")
def _(i):
    return _parsed(i).select("id", "title", "circle", "author", "code", "keyword", F.array_join("fields", ",").alias("fields"))


CAPS = "(SELECT 'ol' AS provider, ['TITLE', 'AUTHOR', 'CODE'] AS can, 20 AS page, true AS secondary UNION ALL SELECT 'gb', ['TITLE', 'AUTHOR', 'CODE'], 20, true UNION ALL SELECT 'dl', ['TITLE', 'CIRCLE', 'CODE'], 30, false)"


@query("route_queries", f"""
WITH {PARSED} SELECT p.id, c.provider, c.page, len(list_intersect(p.fields, c.can)) > 0 AND NOT c.secondary AS eligible, array_to_string(list_filter(p.fields, lambda f: NOT list_contains(c.can, f)), ',') AS ignored
FROM parsed p JOIN {CAPS} c ON list_contains(CASE p.id % 4 WHEN 0 THEN ['ol', 'gb', 'dl'] WHEN 1 THEN ['dl', 'gb'] WHEN 2 THEN ['ol'] ELSE ['gb', 'dl'] END, c.provider)
""")
def _(i):
    ids = F.expr("CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN array(' DL ', 'mb', 'GB') WHEN 2 THEN array('ol') ELSE array('gb', 'xx', 'dl') END")
    routed = search.route_queries(_parsed(i).withColumn("selected", search.sanitize_selection(ids)), include_secondary=False)
    return routed.select("id", "provider", "page", "eligible", F.array_join("ignored", ",").alias("ignored"))


@query("sanitize_selection", """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'ol,gb,dl' WHEN 1 THEN 'dl,gb' WHEN 2 THEN 'ol' ELSE 'gb,dl' END AS ids FROM part
""")
def _(i):
    ids = F.expr("CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN array(' DL ', 'mb', 'GB') WHEN 2 THEN array('ol') ELSE array('gb', 'xx', 'dl', 'GB ') END")
    return i.table("part").select(F.col("p_partkey").alias("id"), F.array_join(search.sanitize_selection(ids), ",").alias("ids"))


@query("result_limit", "SELECT p_partkey, least(CASE WHEN p_size IN (5, 10, 20, 30, 50) THEN p_size ELSE 5 END, greatest(p_partkey % 25, 1)) AS most FROM part")
def _(i):
    most = search.result_limit(F.col("p_size"), F.col("p_partkey") % 25)
    return i.table("part").select("p_partkey", most.alias("most"))


PROVIDER_ROWS = " UNION ALL ".join(
    f"SELECT '{p[0]}' AS provider, '{p[3]}' AS template, '{p[4]}' AS landing, {str(p[5]).lower()} AS plus" for p in search.PROVIDERS
)


@query("search_urls", f"""
WITH {PARSED} SELECT q.id, p.provider, CASE WHEN q.keyword = '' THEN p.landing ELSE replace(p.template, '{{q}}', CASE WHEN p.plus THEN replace(e, '%20', '+') ELSE e END) END AS search_url
FROM (SELECT id, keyword, replace(replace(replace(keyword, '#', '%23'), ' ', '%20'), '()', '%28%29') AS e FROM parsed) q CROSS JOIN ({PROVIDER_ROWS}) p
""")
def _(i):
    return search.search_urls(_parsed(i)).select("id", "provider", "search_url")


# Recognised text: the documents and conversations stand in for the text of photographed covers.
FEEDS["recognised"] = """
SELECT doc_id AS id, text || chr(10) || 'ISBN 978-1' || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'Anna B. Smith' WHEN 1 THEN 'JOHN DOE' WHEN 2 THEN ' -- The Long—Road ..' ELSE 'Price 12' END || chr(10) || 'A ' || lang || chr(10) || 'Mary Stone' AS text FROM {documents}
"""
WORDS = "[" + ", ".join(f"'{w}'" for w in ocr.NOISE_WORDS) + "]"
TRIM = "'^[^\\p{L}\\p{Nd}]+|[^\\p{L}\\p{Nd}]+$'"
LINES = f"""
raw AS (SELECT id, unnest(l) AS raw, unnest(range(len(l))) AS line_no FROM (SELECT id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS l FROM recognised)
), cleaned AS (SELECT id, line_no, regexp_replace(regexp_replace(regexp_replace(replace(raw, chr(9), ' '), '[–—]', '-', 'g'), ' +', ' ', 'g'), {TRIM}, '', 'g') AS line FROM raw
), counted AS (SELECT *, length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(line, '[^\\p{{Nd}}]', '', 'g')) AS digits,
  list_transform(string_split(lower(line), ' '), lambda w: regexp_replace(w, {TRIM}, '', 'g')) AS words FROM cleaned WHERE length(line) BETWEEN 3 AND 90
), kept AS (SELECT id, line_no, line, row_number() OVER (PARTITION BY id ORDER BY line_no) - 1 AS i, letters FROM counted WHERE letters > 0 AND digits <= letters AND NOT regexp_matches(line, '[€$£¥₩@]|://') AND NOT list_has_any(words, {WORDS})
)"""


@query("ocr_lines", f"WITH {LINES} SELECT id, line_no, line FROM kept", ["recognised"])
def _(i):
    return ocr.ocr_lines(i.feed("recognised"), "id")


CORE = "regexp_replace(w, '^[^\\p{L}\\p{Nd}.]+|[^\\p{L}\\p{Nd}.]+$', '', 'g')"


@query("suggest_title_author", f"""
WITH {LINES}, title AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ((id + line_no * 3) % 5) * 1000 + (3 - i) DESC, i) AS rn FROM kept WHERE i < 3) WHERE rn = 1
), people AS (SELECT * FROM kept WHERE len(string_split(line, ' ')) BETWEEN 2 AND 4 AND NOT (line = upper(line) AND NOT regexp_matches(line, '[A-Z]\\.')) AND letters >= 4
  AND len(list_filter(string_split(line, ' '), lambda w: NOT regexp_matches({CORE}, '^\\p{{Lu}}[\\p{{L}}.]*$'))) = 0
), joined AS (SELECT t.id, t.line AS title, t.letters, coalesce((SELECT arg_min(p.line, p.i) FROM people p WHERE p.id = t.id AND p.i > t.i), (SELECT arg_max(p.line, p.i) FROM people p WHERE p.id = t.id AND p.i < t.i)) AS author FROM title t)
SELECT id, title, CASE WHEN length(title) + 1 + length(author) <= 120 THEN author END AS author, CASE WHEN length(title) + 1 + length(author) <= 120 THEN 2 ELSE 1 END AS confidence,
  title || CASE WHEN length(title) + 1 + length(author) <= 120 THEN ' ' || author ELSE '' END AS query FROM joined WHERE letters >= 2
""", ["recognised"])
def _(i):
    heights = F.expr("transform(sequence(0, size(split(text, '\\n'))), n -> cast((id + n * 3) % 5 AS double))")
    found = ocr.suggest_title_author(i.feed("recognised").withColumn("heights", heights), "id", heights="heights")
    return ocr.with_search_text(found).drop("search_title", "search_author")


FEEDS["ocr_truth"] = """
SELECT conv_id AS fixture, turn AS region, text FROM {conversations}
"""
FEEDS["ocr_found"] = """
SELECT conv_id AS fixture, turn AS line_no, CASE WHEN turn % 3 = 1 THEN replace(text, 'e', 'c') || '!' ELSE replace(text, ' ', '  ') END AS text FROM {conversations} WHERE role <> 'system'
"""
# The check's edit distance counts bytes: letters of two bytes become control characters, one for each, on its side.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüÁáÚúÀ"
ONE_BYTE = "".join(map(chr, [*range(1, 9), *range(14, 32)]))[: len(LETTERS)]


def _bytes(x: str) -> str:
    return f"translate({x}, '{LETTERS}', '{ONE_BYTE}')"


REGIONS = f"""
want AS (SELECT fixture, region, text AS truth, regexp_replace(text, '\\s+', '', 'g') AS t FROM ocr_truth), have AS (SELECT fixture, line_no, text AS got, regexp_replace(text, '\\s+', '', 'g') AS g FROM ocr_found
), regions AS (
  SELECT fixture, region, truth, t, coalesce(got, '') AS got, coalesce(g, '') AS g, distance FROM (SELECT w.*, h.got, h.g, levenshtein({_bytes('w.t')}, {_bytes("coalesce(h.g, '')")}) AS distance, row_number() OVER (PARTITION BY w.fixture, w.region, w.truth ORDER BY levenshtein({_bytes('w.t')}, {_bytes("coalesce(h.g, '')")}), h.line_no) AS rn
    FROM want w LEFT JOIN have h USING (fixture)) WHERE rn = 1
)"""


OF_REGIONS = f"WITH {REGIONS} SELECT fixture, region, truth, got, distance, greatest(length(t), 1) AS chars, g = t AS exact FROM regions"


@query("ocr_regions", OF_REGIONS, ["ocr_truth", "ocr_found"])
def _(i):
    return ocr.ocr_regions(i.spread("ocr_truth"), i.spread("ocr_found"))


FEEDS["ascii_truth"] = """
SELECT l_orderkey AS fixture, l_linenumber AS region, 'Title ' || cast(l_partkey AS string) || ' of ' || l_returnflag AS text FROM {lineitem}
"""
FEEDS["ascii_found"] = """
SELECT l_orderkey AS fixture, l_linenumber AS line_no, CASE WHEN l_suppkey % 3 = 0 THEN 'Titel ' || cast(l_partkey AS string) || ' of' ELSE 'Title  ' || cast(l_partkey AS string) || ' of ' || l_returnflag END AS text FROM {lineitem}
UNION ALL SELECT o_orderkey, 99, o_orderpriority FROM {orders}
"""
SCORES = REGIONS.replace("ocr_truth", "ascii_truth").replace("ocr_found", "ascii_found") + """
, scores AS (SELECT r.fixture, count(*) AS regions, sum(distance) AS errors, sum(greatest(length(t), 1)) AS chars, count(*) FILTER (g = t) AS exact, bool_or(g = 'Title' || (r.fixture % 2000) || 'ofN') AS title_exact FROM regions r GROUP BY r.fixture)
"""


def _scores(i):
    truth, found = i.feed("ascii_truth"), i.feed("ascii_found")
    titles = truth.select("fixture").distinct().withColumn("title", F.expr("'Title ' || (fixture % 2000) || ' of N'"))
    return ocr.ocr_score(truth, found, titles)


@query("ocr_score", f"""
WITH {SCORES} SELECT s.*, greatest(coalesce(f.n, 0) - s.regions, 0) AS extra_lines, round(s.errors / s.chars, 6) AS cer FROM scores s LEFT JOIN (SELECT fixture, count(*) AS n FROM ascii_found GROUP BY ALL) f USING (fixture)
""", ["ascii_truth", "ascii_found"])
def _(i):
    return _scores(i).withColumn("cer", F.round("cer", 6))


@query("overall_cer", f"WITH {SCORES} SELECT count(*) AS fixtures, round(sum(errors) / sum(chars), 6) AS cer FROM scores", ["ascii_truth", "ascii_found"])
def _(i):
    return ocr.overall_cer(_scores(i)).withColumn("cer", F.round("cer", 6))


@query("ocr_nfkc", OF_REGIONS, ["ocr_truth", "ocr_found"])  # the given turns have no compatibility characters
def _(i):
    return ocr.ocr_regions(i.spread("ocr_truth"), i.spread("ocr_found"), nfkc)


FEEDS["boxes"] = """
SELECT l_orderkey AS fixture, l_linenumber AS region, cast(l_partkey % 50 AS double) AS x0, cast(l_linenumber * 10 + l_suppkey % 4 AS double) AS y0, cast(l_partkey % 50 + 20 AS double) AS x1, cast(l_linenumber * 10 + l_suppkey % 4 + 8 AS double) AS y1,
  l_quantity AS shift, l_returnflag = 'R' AS vertical FROM {lineitem}
"""


def _box(x=0.0):
    return F.struct((F.col("x0") + x).alias("x0"), "y0", (F.col("x1") + x).alias("x1"), "y1")


@query("detection_recall", """
WITH hit AS (
  SELECT a.fixture, a.region, bool_or((SELECT CASE WHEN u > 0 THEN n / u ELSE 0 END FROM (SELECT greatest(least(a.x1, b.x1 + b.shift) - greatest(a.x0, b.x0 + b.shift), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS n,
    320 - greatest(least(a.x1, b.x1 + b.shift) - greatest(a.x0, b.x0 + b.shift), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS u)) >= 0.3) AS hit FROM boxes a JOIN boxes b ON a.fixture = b.fixture GROUP BY ALL)
SELECT fixture, count(*) AS regions, count(*) FILTER (hit) AS detected, round(avg(hit::INT), 6) AS recall FROM hit GROUP BY ALL
""", ["boxes"])
def _(i):
    b = i.feed("boxes")
    recall = ocr.detection_recall(b.select("fixture", "region", _box().alias("box")), b.select("fixture", _box(F.col("shift")).alias("box")))
    return recall.withColumn("recall", F.round("recall", 6))


@query("reading_order", """
WITH r AS (SELECT *, CASE WHEN vertical THEN -(x0 + x1) / 2 ELSE (y0 + y1) / 2 END AS along, y1 - y0 AS h FROM boxes
), s AS (SELECT *, CASE WHEN along - lag(along) OVER w <= CASE WHEN vertical THEN 1.0 ELSE (h + lag(h) OVER w) * 0.25 END THEN 0 ELSE 1 END AS step FROM r WINDOW w AS (PARTITION BY fixture, vertical ORDER BY along, region)
), b AS (SELECT *, sum(step) OVER (PARTITION BY fixture, vertical ORDER BY along, region) AS band FROM s)
SELECT fixture, region, row_number() OVER (PARTITION BY fixture ORDER BY vertical, band, CASE WHEN vertical THEN y0 ELSE x0 END, region) AS position FROM b
""", ["boxes"])
def _(i):
    return ocr.reading_order(i.feed("boxes").select("fixture", "region", "vertical", _box().alias("box")))


# Pages.
ENTITIES = "replace(replace(replace(replace({}, '&copy;', '&copy;'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
FEEDS["escaped_pages"] = """
SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN replace(html, '&amp;', '&#38;') WHEN 1 THEN replace(html, '&middot;', '&#xB7;') ELSE html END AS html FROM {pages}
"""


@query("html_text", f"""
SELECT page_id, trim(regexp_replace({ENTITIES.format("regexp_replace(html, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS text FROM pages
""")
def _(i):
    return i.feed("escaped_pages").select("page_id", pages.html_text(F.col("html")).alias("text"))


NAV = pages.ListingSpec(
    name="nav", guard=r"<nav>", item_start=r'<li><a href="/([^"]*)"',
    parts={"detail_url": pages.Part([r'href="(/[^"]+)"'], clean=False), "title": pages.Part([r"<a[^>]*>([^<]*)</a>"])},
    required=["title", "detail_url"], detail_prefix="https://site.example",
)


@query("extract_listing", """
WITH items AS (SELECT page_id, unnest(m) AS block, unnest(range(len(m))) AS nth FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="/[^"]*"[^>]*>[^<]*</a>') AS m FROM pages WHERE contains(html, '<nav>'))
), f AS (SELECT page_id, nth, regexp_extract(block, 'href="/([^"]*)"', 1) AS id, 'https://site.example' || regexp_extract(block, 'href="(/[^"]+)"', 1) AS detail_url, trim(regexp_extract(block, '>([^<]*)</a>', 1)) AS title FROM items)
SELECT page_id, pos, id, detail_url, title FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY nth) - 1 AS pos FROM f WHERE title <> '') WHERE pos < 4
""")
def _(i):
    return pages.extract_listing(i.table("pages"), NAV, "page_id", 4)


FEEDS["shop_pages"] = """
SELECT p_partkey AS page_id, CASE WHEN p_partkey % 10 = 9 THEN '<html>maintenance</html>' ELSE '<div id="search_result_list"><ul>' || CASE WHEN p_partkey % 10 = 8 THEN '' ELSE
  '<li class="x" data-list_item_product_id="rj' || lpad(cast(p_partkey AS string), 6, '0') || '"><dl><dd class="work_name"><a href="https://www.dlsite.com/books/work/=/product_id/RJ' || cast(p_partkey AS string) || '.html" title="' || p_name || ' &amp; more">x</a></dd><dd class="maker_name"><a href="/m">' || p_brand || '</a></dd><span class="work_price_base"> ' || cast(p_size AS string) || ',000 </span><span class="work_price_suffix">yen</span><img src="//img.dlsite.jp/a' || cast(p_partkey AS string) || '_img_main.jpg"></dl></li>'
  || '<li data-list_item_product_id="RJ000000"><dd class="work_name">no link</dd></li><li data-list_item_product_id="BJ' || lpad(cast(p_partkey AS string), 6, '0') || '"><dd class="work_name"><a href="https://dlsite.com/product_id/' || cast(p_partkey AS string) || '.html">' || p_type || ' <b>' || p_name || '</b></a></dd><dd class="author_name">by ' || p_brand || '</dd></li>' END || '</ul></div>' END AS html FROM {part}
"""


@query("extract_listing_dl", """
SELECT p_partkey AS page_id, 0 AS pos, 'RJ' || lpad(p_partkey::VARCHAR, 6, '0') AS id, p_name || ' & more' AS title, p_brand AS circle, NULL AS author, p_size || ',000yen' AS price, 'https://img.dlsite.jp/a' || p_partkey || '_img_main.jpg' AS cover, 'https://www.dlsite.com/books/work/=/product_id/RJ' || p_partkey || '.html' AS detail_url FROM part WHERE p_partkey % 10 < 8
UNION ALL SELECT p_partkey, 1, 'BJ' || lpad(p_partkey::VARCHAR, 6, '0'), p_type || ' ' || p_name, NULL, 'by ' || p_brand, NULL, NULL, 'https://dlsite.com/product_id/' || p_partkey || '.html' FROM part WHERE p_partkey % 10 < 8
""")
def _(i):
    return pages.extract_listing(i.spread("shop_pages"), pages.DL, "page_id", 10)


@query("page_status", "SELECT p_partkey AS page_id, CASE p_partkey % 10 WHEN 9 THEN 'WRONG_PAGE' WHEN 8 THEN 'EMPTY' ELSE 'RESULTS' END AS page_status FROM part")
def _(i):
    return pages.page_status(i.spread("shop_pages"), pages.DL).select("page_id", "page_status")


FEEDS["goods_pages"] = """
SELECT p_partkey AS page_id, '<ul class="item-list"><li class="product_' || cast(1000 + p_partkey AS string) || '"><a href="/detail/detail.php?product_id=' || cast(1000 + p_partkey AS string) || '" title="alt ' || p_name || '"></a>' || CASE WHEN p_partkey % 2 = 0 THEN '<p class="item-ttl product_title"><i>' || p_name || '</i></p>' ELSE '' END
  || '<p class="item-price">¥' || cast(p_size AS string) || '&nbsp;</p><p class="search-item-author-author x"><a href="#">' || p_brand || '</a></p><p class="search-item-author-author"><a>' || p_type || '</a></p><img data-src="//cdn.example/resize_image.php?image=' || CASE WHEN p_partkey % 3 = 0 THEN 'now_printing' ELSE cast(p_partkey AS string) END || '&amp;w=1"></li><li class="product_999"><a href="/detail/detail.php?product_id=998" title="other"></a></li></ul>' AS html FROM {part}
"""


@query("extract_listing_mb", """
SELECT p_partkey AS page_id, 0 AS pos, (1000 + p_partkey)::VARCHAR AS id, 'https://www.melonbooks.co.jp/detail/detail.php?product_id=' || (1000 + p_partkey) AS detail_url, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'alt ' || p_name END AS title, '¥' || p_size AS price,
  CASE WHEN p_partkey % 3 <> 0 THEN 'https://cdn.example/resize_image.php?image=' || p_partkey || '&w=1' END AS cover, p_brand || ', ' || p_type AS author FROM part
""")
def _(i):
    return pages.extract_listing(i.spread("goods_pages"), pages.MB, "page_id", 10)


FEEDS["cover_pages"] = """
SELECT page_id, url, replace(html, '<title>', CASE page_id % 7 WHEN 0 THEN '<meta property="og:image" content="https://img.example.org/' || cast(page_id AS string) || '.png">' WHEN 1 THEN '<META content=''/c/' || cast(page_id AS string) || '.jpg'' name=twitter:image />'
  WHEN 2 THEN '<meta property="og:image" content="http://img.example.org/x.png"><link rel="image_src" href="//cdn.example.org/l.png">' WHEN 3 THEN '<meta itemprop="image" content="../up/' || cast(page_id AS string) || '.webp">' WHEN 4 THEN '<meta property="og:image" content="https://127.0.0.1/x.png">'
  WHEN 5 THEN '<meta name="twitter:image" content="https://t.example.org/t.png"><meta property="og:image:secure_url" content="https://s.example.org/s.png">' ELSE '' END || '<title>') AS html FROM {pages}
"""
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
DIR2 = "regexp_replace(regexp_extract(url, '^https?://[^/?#]*/([^?#]*)', 1), '[^/]*$', '')"


@query("page_cover", f"""
SELECT page_id, cover_url, source FROM (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://img.example.org/' || page_id || '.png' WHEN 1 THEN {ORIGIN} || '/c/' || page_id || '.jpg' WHEN 2 THEN regexp_extract(url, '^(https?:)', 1) || '//cdn.example.org/l.png'
  WHEN 3 THEN {ORIGIN} || '/' || regexp_replace({DIR2}, '[^/]+/$', '') || 'up/' || page_id || '.webp' WHEN 5 THEN 'https://s.example.org/s.png' END AS cover_url, CASE page_id % 7 WHEN 1 THEN 'WEBPAGE_TWITTER' WHEN 2 THEN 'WEBPAGE_IMAGE_SRC' WHEN 3 THEN 'WEBPAGE_IMAGE_SRC' ELSE 'WEBPAGE_OPEN_GRAPH' END AS source FROM pages)
WHERE cover_url LIKE 'https:%'
""")
def _(i):
    return pages.page_cover(i.feed("cover_pages"), "page_id")


FEEDS["similarity_pages"] = """
SELECT p_partkey AS page_id, '<table><tr><td>Your image</td></tr></table><table class="m"><a href="//danbooru.example/post/' || cast(p_partkey AS string) || '"><img src="/thumb.jpg"></a><td>>danbooru<</td><td>' || cast(p_size + 40 AS string) || '% similarity</td></table><TABLE><a href="https://files.example/' || cast(p_partkey AS string) || '.png">x</a><img alt="" src="https://t.example/t.gif"></TABLE><table><a href="https://iqdb.org/x">own</a></table>' AS html FROM {part}
"""


@query("parse_similarity_tables", """
SELECT p_partkey AS page_id, 0 AS pos, 'https://danbooru.example/post/' || p_partkey AS source_url, NULL AS image_url, 'Danbooru' AS service, (p_size + 40)::DOUBLE AS similarity FROM part
UNION ALL SELECT p_partkey, 1, 'https://files.example/' || p_partkey || '.png', 'https://t.example/t.gif', '', NULL FROM part
""")
def _(i):
    return pages.parse_similarity_tables(i.feed("similarity_pages"), "page_id")


FEEDS["pasted"] = """
SELECT page_id, 'Found it: ' || url || ' 93%' || chr(10) || 'no link here' || chr(10) || '  ' || url || chr(10) || 'Book – "' || url || '" 7 %' AS text FROM {pages}
"""


@query("parse_pasted_hits", """
SELECT page_id, 0 AS pos, url AS source_url, 'Found it' AS title, 93.0::DOUBLE AS similarity FROM pages UNION ALL SELECT page_id, 1, url, '', NULL FROM pages UNION ALL SELECT page_id, 2, url, 'Book – "', 7.0::DOUBLE FROM pages
""")
def _(i):
    return pages.parse_pasted_hits(i.feed("pasted"), "page_id")


# Provider replies.
FEEDS["ol_replies"] = """
SELECT p_partkey AS reply, CASE p_partkey % 9 WHEN 8 THEN '~"error":"x"!' WHEN 7 THEN 'not json' ELSE '~"numFound": ' || cast(p_size AS string) || ', "docs": [~"key":"/works/OL' || cast(p_partkey AS string) || 'W","title":" ' || p_name || ' ","author_name":["' || p_brand || '"," ","' || p_brand || '","b","c","d","e"],"first_publish_year":' || cast(1950 + p_size AS string) || ',"publisher":"' || p_type || '","cover_i":' || cast(p_partkey % 3 AS string) || ',"language":["eng","jpn","eng"],"number_of_pages":' || cast(p_size - 5 AS string) || '!,~"key":"/bad/1","title":"x"!,~"key":"/books/OL9M","title":"  "!,~"key":"/books/OL' || cast(p_partkey AS string) || 'M","title":"second","cover_i":[77]!]!' END AS body FROM {part}
"""
FEEDS["ol_replies"] = FEEDS["ol_replies"].replace("~", "{{").replace("!", "}}")


@query("parse_open_library", """
SELECT p_partkey AS reply, 0 AS pos, 'OL' || p_partkey || 'W' AS id, p_name AS title, p_brand || ',b,c,d' AS authors, 1950 + p_size AS year, p_type AS publishers, CASE WHEN p_size > 5 THEN p_size - 5 END AS pages, 'eng,jpn' AS languages, CASE WHEN p_partkey % 3 > 0 THEN 'https://covers.openlibrary.org/b/id/' || p_partkey % 3 || '-M.jpg' END AS cover_url, 'https://openlibrary.org/works/OL' || p_partkey || 'W' AS detail_url FROM part WHERE p_partkey % 9 < 7
UNION ALL SELECT p_partkey, 1, 'OL' || p_partkey || 'M', 'second', '', NULL, '', NULL, '', 'https://covers.openlibrary.org/b/id/77-M.jpg', 'https://openlibrary.org/books/OL' || p_partkey || 'M' FROM part WHERE p_partkey % 9 < 7
""")
def _(i):
    rows = replies.parse_open_library(i.feed("ol_replies"), "reply")
    for c in ("authors", "publishers", "languages"):
        rows = rows.withColumn(c, F.array_join(c, ","))
    return rows


@query("open_library_status", "SELECT p_partkey AS reply, CASE WHEN p_partkey % 9 < 7 THEN 'OK' ELSE 'ERROR' END AS status, CASE WHEN p_partkey % 9 < 7 THEN p_size END AS available FROM part")
def _(i):
    return replies.open_library_status(i.feed("ol_replies"), "reply")


FEEDS["gb_replies"] = """
SELECT p_partkey AS reply, CASE p_partkey % 9 WHEN 8 THEN '~"totalItems":0!' WHEN 7 THEN '~"items":"oops"!' ELSE '~"totalItems":' || cast(p_size AS string) || ',"items":[~"id":"v' || cast(p_partkey AS string) || '","volumeInfo":~"title":"' || p_name || '","authors":["' || p_brand || '"],"publisher":"' || p_type || '","publishedDate":"' || cast(990 + p_size AS string) || '-05","pageCount":' || cast(p_size AS string) || ',"language":"ja","infoLink":"' || CASE WHEN p_partkey % 2 = 0 THEN 'http' ELSE 'https' END || '://books.example/' || cast(p_partkey AS string) || '","imageLinks":~"thumbnail":"http://img.example/' || cast(p_partkey AS string) || '"!,"industryIdentifiers":[~"type":"ISBN","identifier":" "!,~"type":"ISBN","identifier":"' || cast(p_partkey AS string) || '"!]!!,~"id":"bad id","volumeInfo":~"title":"x"!!,~"id":"w"!]!' END AS body FROM {part}
"""
FEEDS["gb_replies"] = FEEDS["gb_replies"].replace("~", "{{").replace("!", "}}")


@query("parse_google_books", """
SELECT p_partkey AS reply, 0 AS pos, 'v' || p_partkey AS id, p_name AS title, p_brand AS authors, CASE WHEN p_size >= 10 THEN 990 + p_size END AS year, p_type AS publisher, p_size AS pages, 'ja' AS language, 'https://img.example/' || p_partkey AS cover_url,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://books.google.com/books?id=v' || p_partkey ELSE 'https://books.example/' || p_partkey END AS detail_url, p_partkey::VARCHAR AS identifier FROM part WHERE p_partkey % 9 < 7
""")
def _(i):
    return replies.parse_google_books(i.feed("gb_replies"), "reply").withColumn("authors", F.array_join("authors", ","))


@query("google_books_status", "SELECT p_partkey AS reply, CASE WHEN p_partkey % 9 = 7 THEN 'ERROR' ELSE 'OK' END AS status, CASE WHEN p_partkey % 9 < 7 THEN p_size WHEN p_partkey % 9 = 8 THEN 0 END AS available FROM part")
def _(i):
    return replies.google_books_status(i.feed("gb_replies"), "reply")


FEEDS["picture_replies"] = """
SELECT p_partkey AS reply, CASE p_partkey % 8 WHEN 7 THEN '~"header":~"status":-2,"short_remaining":0,"long_remaining":"9"!!' WHEN 6 THEN '~"header":~"status":3,"short_remaining":2,"long_remaining":5!!' WHEN 5 THEN '~"results":[]!' WHEN 4 THEN '~"header":~"status":0!,"results":[]!' ELSE
  '~"header":~"status":0,"short_remaining":1!,"results":[~"header":~"similarity":"' || cast(p_size + 40 AS string) || '.5","thumbnail":"https://t.example/' || cast(p_partkey AS string) || '.jpg","index_name":"Index 1","index_id":18!,"data":~"ext_urls":["ftp://x","http://a.example/' || cast(p_partkey AS string) || '","https://b.example/RJ' || lpad(cast(p_partkey AS string), 6, '0') || '"],"eng_name":"' || p_name || '","title":" ","company":"' || p_brand || '","creator":["x"," ","' || p_type || '"]!!]!' END AS body FROM {part}
"""
FEEDS["picture_replies"] = FEEDS["picture_replies"].replace("~", "{{").replace("!", "}}")


@query("parse_reverse_hits", """
SELECT p_partkey AS reply, 0 AS pos, (p_size + 40.5)::DOUBLE AS similarity, 'https://b.example/RJ' || lpad(p_partkey::VARCHAR, 6, '0') AS source_url, 'https://t.example/' || p_partkey || '.jpg' AS image_url, p_name AS title, p_brand AS circle, 'x, ' || p_type AS author, 'RJ' || lpad(p_partkey::VARCHAR, 6, '0') AS product_id, 'Index 1' AS index_name,
  'company=' || p_brand || ';creator=x, ' || p_type || ';eng_name=' || p_name || ';ext_urls=ftp://x, http://a.example/' || p_partkey || ', https://b.example/RJ' || lpad(p_partkey::VARCHAR, 6, '0') || ';index=Index 1;index_id=18;similarity=' || (p_size + 40) || '.5' AS metadata FROM part WHERE p_partkey % 8 < 4
""")
def _(i):
    hits = replies.parse_reverse_hits(i.feed("picture_replies"), "reply")
    pairs = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return hits.withColumn("metadata", F.array_join(pairs, ";"))


@query("reverse_status", "SELECT p_partkey AS reply, CASE p_partkey % 8 WHEN 7 THEN 'QUOTA_EXCEEDED' WHEN 6 THEN 'ERROR' WHEN 5 THEN 'ERROR' WHEN 4 THEN 'NO_RESULTS' ELSE 'SUCCESS' END AS status FROM part")
def _(i):
    return replies.reverse_status(i.feed("picture_replies"), "reply")


# Merging.
FEEDS["results"] = """
SELECT l_suppkey AS search, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS pos, CASE l_linenumber % 4 WHEN 0 THEN 'dl' WHEN 1 THEN 'OL' WHEN 2 THEN '' ELSE 'mb' END AS provider, CASE WHEN l_linenumber = 6 THEN 'open LIBRARY' ELSE 'shop' END AS source,
  cast(l_partkey % 40 AS string) AS id, CASE WHEN l_linenumber % 4 = 2 THEN 'https://X.example/' || cast(l_partkey % 30 AS string) || '/?utm_a=1' ELSE '' END AS url, 'Book ' || cast(l_partkey % 9 AS string) AS title FROM {lineitem}
"""
FEEDS["promoted"] = """
SELECT s_suppkey AS search, 'dl:' || cast(s_suppkey % 40 AS string) AS key FROM {supplier}
"""
KEYED = """
keyed AS (SELECT *, CASE WHEN provider <> '' THEN lower(provider) || ':' || id WHEN lower(source) = 'open library' THEN 'ol:' || id ELSE 'url:https://x.example/' || regexp_extract(url, '/(\\d+)/', 1) END AS key, CASE WHEN provider IN ('dl', 'mb') THEN 1 ELSE 4 END AS rank FROM results
), merged AS (SELECT *, first_value(pos) OVER (PARTITION BY search, key ORDER BY pos) AS first_pos, row_number() OVER (PARTITION BY search, key ORDER BY rank, pos) AS rn FROM keyed
), placed AS (SELECT m.*, row_number() OVER (PARTITION BY m.search ORDER BY CASE WHEN p.key IS NULL THEN 1 ELSE 0 END, first_pos) AS place FROM merged m LEFT JOIN promoted p ON p.search = m.search AND p.key = m.key WHERE rn = 1)
"""


@query("merge_results", f"WITH {KEYED} SELECT search, key, place, pos, provider, id FROM placed WHERE place <= 10", ["results", "promoted"])
def _(i):
    merged = merge.merge_results(i.feed("results"), i.feed("promoted"))
    return merged.select("search", "key", "place", "pos", "provider", "id")


FEEDS["picture_hits"] = """
SELECT l_suppkey AS search, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS pos, CASE WHEN l_returnflag = 'A' THEN 'iqdb' ELSE 'SauceNAO' END AS provider, CASE WHEN l_linenumber % 2 = 0 THEN 'r' || cast(l_partkey AS string) END AS result_id, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS similarity,
  CASE WHEN l_linenumber % 3 = 1 THEN 'http://S.example/' || cast(l_partkey % 20 AS string) END AS source_url, CASE WHEN l_discount > 0.05 THEN 'https://i.example/' || cast(l_partkey AS string) END AS image_url, CASE WHEN l_discount < 0.03 THEN ' ' ELSE 'T' || cast(l_partkey AS string) END AS title, '' AS circle,
  CASE WHEN l_tax > 0.04 THEN 'A' || cast(l_partkey AS string) ELSE '' END AS author, CASE WHEN l_linenumber % 3 = 0 THEN 'rj ' || cast(100000 + l_partkey % 25 AS string) ELSE '' END AS product_id FROM {lineitem}
"""


@query("merge_reverse_hits", """
WITH k AS (SELECT *, CASE WHEN product_id <> '' THEN 'id:RJ' || substr(product_id, 4) WHEN source_url IS NOT NULL THEN 'url:https://s.example/' || substr(source_url, 18) ELSE 'row:' || provider || ':' || coalesce(result_id, pos::VARCHAR) END AS key, CASE provider WHEN 'SauceNAO' THEN 1 ELSE 2 END AS pr FROM picture_hits
), g AS (SELECT search, key, coalesce(arg_min(title, pos) FILTER (trim(title) <> ''), '') AS title, coalesce(arg_min(author, pos) FILTER (author <> ''), '') AS author, arg_min(image_url, pos) FILTER (image_url IS NOT NULL) AS image_url, count(*) AS refs, count(DISTINCT provider) AS providers FROM k GROUP BY ALL
), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search, key ORDER BY pr, coalesce(similarity, -1) DESC, pos) AS rn FROM k) WHERE rn = 1)
SELECT search, key, place, title, author, image_url, provider, source_url, similarity, refs, providers FROM (
  SELECT g.*, f.provider, f.source_url, f.similarity, row_number() OVER (PARTITION BY g.search ORDER BY f.pr, coalesce(f.similarity, -1) DESC, g.key) AS place FROM g JOIN f USING (search, key)) WHERE place <= 20
""", ["picture_hits"])
def _(i):
    return merge.merge_reverse_hits(i.feed("picture_hits")).drop("circle", "product_id")


@query("classify_run", """
SELECT event_id, state, state = 'SUCCESS' AS contributed FROM (SELECT event_id, CASE WHEN value * 200 > 20000 THEN 'TIMEOUT' WHEN event_type = 'view' AND user_id % 3 > 0 THEN 'SUCCESS' WHEN event_type IN ('view', 'click') THEN 'NO_RESULTS' ELSE upper(event_type) END AS state FROM events)
""")
def _(i):
    runs = i.table("events").select(
        "event_id", (F.col("value") * 200).alias("elapsed_ms"), F.lit(20000).alias("timeout_ms"), (F.col("user_id") % 3).alias("hits"),
        F.expr("CASE event_type WHEN 'view' THEN 'FOUND' WHEN 'click' THEN 'NO_RESULTS' ELSE 'FAILED' END").alias("outcome"), F.upper("event_type").alias("failure"),
    )
    return merge.classify_run(runs).select("event_id", "state", "contributed")


@query("prepend_candidates", """
WITH b AS (SELECT l_suppkey AS search, 'k' || l_partkey % 50 AS key, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS old FROM lineitem), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search, key ORDER BY old, pos) AS rn FROM b) WHERE rn = 1)
SELECT f.search, f.key, f.pos, f.old, CASE WHEN p.p_size > 25 THEN 'REJECTED' ELSE 'SUGGESTED' END AS decision FROM f LEFT JOIN part p ON 'k' || p.p_partkey = f.key
""")
def _(i):
    rows = i.table("lineitem").selectExpr("l_suppkey AS search", "'k' || l_partkey % 50 AS key", "l_orderkey * 10 + l_linenumber AS pos", "l_returnflag")
    decided = i.table("part").filter("p_size > 25").selectExpr("'k' || p_partkey AS key", "'REJECTED' AS decision")
    new, old = rows.filter("l_returnflag = 'A'").drop("l_returnflag"), rows.filter("l_returnflag <> 'A'").drop("l_returnflag")
    return merge.prepend_candidates(new, old, decided)


@query("provider_rollup", """
SELECT p.name AS provider, coalesce(count(e.event_id), 0) AS searches, count(*) FILTER (event_type = 'view') AS results, count(*) FILTER (event_type = 'click') AS empty, count(*) FILTER (event_type = 'error') AS blocked, count(*) FILTER (event_type IN ('signup', 'purchase')) AS failed, count(*) FILTER (event_type = 'signup') AS timeouts,
  coalesce(sum(user_id) FILTER (event_type = 'view'), 0) AS returned, sum(user_id * 10) FILTER (event_type = 'view') AS available, count(*) FILTER (event_type IN ('view', 'click')) > 0 AS answered
FROM (SELECT n_name AS name, n_nationkey FROM nation) p LEFT JOIN events e ON e.user_id % 20 = p.n_nationkey GROUP BY p.name
""")
def _(i):
    from colophon.operators.analytics import provider_rollup

    named = i.table("nation").select(F.col("n_name").alias("provider"), "n_nationkey")
    kinds = F.expr("CASE event_type WHEN 'view' THEN 'FOUND' WHEN 'click' THEN 'EMPTY' ELSE 'FAILED' END")
    failure = F.expr("CASE event_type WHEN 'error' THEN 'BLOCKED' WHEN 'signup' THEN 'TIMEOUT' WHEN 'purchase' THEN 'INTERNAL' END")
    outcomes = i.table("events").join(named, F.col("user_id") % 20 == F.col("n_nationkey")).select(
        "provider", kinds.alias("outcome"), failure.alias("failure"), F.col("user_id").alias("results"), (F.col("user_id") * 10).alias("available")
    )
    return provider_rollup(named, outcomes)
