"""Stored web pages as rows: plain text, listings, covers and pasted hits.

A page is one row and stays one: items are split, read and filtered inside arrays and exploded at the end, so
none of this shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from colophon.functions.text import bind, first_of, strip
from colophon.functions.urls import is_safe_image_url, url_domain

# Named entities in the order they are replaced.
NAMED_ENTITIES = [
    ("nbsp", " "), ("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("hellip", "…"), ("mdash", "—"),
    ("ndash", "–"), ("middot", "·"), ("times", "×"), ("yen", "¥"), ("amp", "&"),
]
NUMERIC_ENTITY = r"^&#(x?)([0-9A-Fa-f]+);$"


def _code_point(entity: Column) -> Column:
    digits, hex_ = F.regexp_extract(entity, NUMERIC_ENTITY, 2), F.regexp_extract(entity, NUMERIC_ENTITY, 1) == "x"
    short = F.length(digits) <= 8
    number = F.when(hex_ & short, F.conv(digits, 16, 10).cast("long")).when(~hex_, digits.try_cast("long"))
    fine = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(entity)


def unescape(c: Column) -> Column:
    pieces = lambda t: F.regexp_extract_all(t, F.lit(r"(&#x?[0-9A-Fa-f]+;|[^&]+|&)"), F.lit(1))
    decoded = lambda t: F.array_join(
        F.transform(pieces(t), lambda p: F.when(F.rlike(p, F.lit(NUMERIC_ENTITY)), _code_point(p)).otherwise(p)), ""
    )

    def named(t: Column) -> Column:
        for name, text in NAMED_ENTITIES:
            t = F.replace(t, F.lit(f"&{name};"), F.lit(text))
        return t

    numbered = lambda t: F.when(F.contains(t, F.lit("&#")), decoded(t)).otherwise(t)
    return bind(c, lambda t: F.when(F.contains(t, F.lit("&")), named(numbered(t))).otherwise(t))


def html_text(c: Column) -> Column:
    """Readable text of a markup fragment: tags out, entities in, spaces collapsed."""
    return strip(F.regexp_replace(unescape(F.regexp_replace(c, "<[^>]*>", " ")), r"\s+", " "))


@dataclass(frozen=True)
class Part:
    """One field of a listing item: patterns tried in order (group 1), whether markup is cleaned, longest text."""

    patterns: list[str]
    clean: bool = True
    longest: int | None = None
    within: tuple[str, ...] = ()  # cut the block down first: each pattern in the text that the one before leaves


@dataclass(frozen=True)
class ListingSpec:
    """How a result page is told, where its items start (group 1 is the id) and how their fields read."""

    name: str
    guard: str
    item_start: str
    parts: dict[str, Part]
    required: list[str]
    detail_prefix: str = ""
    detail_host: str = ""
    detail_must: list[str] = field(default_factory=list)
    cover_prefix: str = "https:"
    cover_must: str = ""
    cover_refuse: str | None = None
    upper_id: bool = False
    price_suffix: Part | None = None
    same_id: str | None = None
    people: Part | None = None


# A field is read inside its own element: the element is closed first, then its first link is taken.
WORK = r'<dd\s+class="work_name"[^>]*>([\s\S]*?)</dd>'
ANCHOR = r'(<a\b[^>]*href="[^"]+"[^>]*>[\s\S]*?</a>)'
ANCHOR_TEXT = r'<a\b[^>]*href="[^"]+"[^>]*>([\s\S]*?)</a>'

# The two shops whose result pages are read.
DL = ListingSpec(
    name="dl",
    guard=r'id="search_result_(?:list|img_box)"',
    item_start=r'<li\b[^>]*data-list_item_product_id="([A-Za-z]{2}[0-9]{4,12})"',
    parts={
        "detail_url": Part([r'href="([^"]+)"'], clean=False, within=(WORK, ANCHOR)),
        "title": Part([r'^<a\b[^>]*\btitle="([^"]*)"', r'^<a\b[^>]*>([\s\S]*)</a>$'], within=(WORK, ANCHOR)),
        "circle": Part([ANCHOR_TEXT, r"([\s\S]+)"], within=(r'<dd\s+class="maker_name"[^>]*>([\s\S]*?)</dd>',)),
        "author": Part([
            r'<dd\s+class="author_name"[^>]*>([\s\S]*?)</dd>', r"作者\s*</th>\s*<td[^>]*>([\s\S]*?)</td>",
        ]),
        "price": Part([r'<span\s+class="work_price_base"[^>]*>\s*([0-9][0-9,]*)\s*</span>'], clean=False),
        "cover": Part([
            r"""((?:https?:)?//img\.dlsite\.jp/[^"'\s]+?_img_main_240x240\.jpg)""",
            r"""((?:https?:)?//img\.dlsite\.jp/[^"'\s]+?_img_main\.jpg)""",
        ], clean=False),
    },
    required=["title", "detail_url"],
    detail_host="dlsite.com",
    detail_must=["/product_id/", ".html"],
    cover_must="https://img.dlsite.jp/",
    upper_id=True,
    price_suffix=Part([r'<span\s+class="work_price_suffix"[^>]*>([^<]{0,12})</span>']),
)
MB = ListingSpec(
    name="mb",
    guard=r'class="item-list"',
    item_start=r'<li\s+class="product_([0-9]{3,12})"',
    parts={
        "detail_url": Part([r'href="(/detail/detail\.php\?product_id=[0-9]{3,12})"'], clean=False),
        "title": Part([
            r'class="item-ttl product_title"[^>]*>([\s\S]*?)</p>', r'<a\b[^>]*\btitle="([^"]*)"',
        ]),
        "price": Part([r'class="item-price"[^>]*>([^<]{1,24})</p>']),
        "cover": Part([r'data-src="(//[^"]*?resize_image\.php[^"]*?)"'], clean=False),
    },
    required=["title", "detail_url"],
    detail_prefix="https://www.melonbooks.co.jp",
    detail_host="melonbooks.co.jp",
    detail_must=["/detail/detail.php", "product_id="],
    cover_refuse="now_printing",
    same_id=r"product_id=([0-9]+)$",
    people=Part([r'<p\s+class="search-item-author-author[^"]*"[^>]*>(?:(?!</p>|<a\b)[\s\S])*+<a\b[^>]*>([\s\S]*?)</a>']),
)


def _read(block: Column, part: Part) -> Column:
    """First pattern with a non-empty reading; null when there is none."""
    for pattern in part.within:
        block = F.regexp_extract(block, pattern, 1)

    def reading(cut: Column, pattern: str) -> Column:
        raw = F.regexp_extract(cut, pattern, 1)
        text = html_text(raw) if part.clean else strip(unescape(raw))
        if part.longest is not None:
            text = F.substring(text, 1, part.longest)
        return bind(text, lambda t: F.when(t != "", t))

    return bind(block, lambda cut: F.coalesce(*[reading(cut, pattern) for pattern in part.patterns]))


def page_status(pages: DataFrame, spec: ListingSpec, html: str = "html") -> DataFrame:
    """Adds page_status WRONG_PAGE, EMPTY or RESULTS: a page without items is not a wrong page."""
    return pages.withColumn(
        "page_status",
        F.when(~F.rlike(html, F.lit(spec.guard)), "WRONG_PAGE")
        .when(~F.rlike(html, F.lit(spec.item_start)), "EMPTY").otherwise("RESULTS"),
    )


def extract_listing(
    pages: DataFrame, spec: ListingSpec, key: str, limit: int | None = None, html: str = "html", people: int | None = 2
) -> DataFrame:
    """key, pos, id and the fields of every complete item, the first ``limit`` per page and ``people`` per item (None: all)."""
    blocks = F.filter(F.split(html, f"(?={spec.item_start})"), lambda b: F.rlike(b, F.lit(f"^{spec.item_start}")))

    def item(block: Column, i: Column) -> Column:
        ident = F.regexp_extract(block, spec.item_start, 1)
        values = {name: _read(block, part) for name, part in spec.parts.items()}
        if spec.detail_prefix:
            values["detail_url"] = F.concat(F.lit(spec.detail_prefix), values["detail_url"])
        if spec.price_suffix is not None and "price" in values:
            values["price"] = F.concat(values["price"], F.coalesce(_read(block, spec.price_suffix), F.lit("")))
        if "cover" in values:
            whole = lambda u: F.when(F.startswith(u, F.lit("//")), F.concat(F.lit(spec.cover_prefix), u)).otherwise(u)
            refused = lambda u: F.contains(u, F.lit(spec.cover_refuse)) if spec.cover_refuse else F.lit(False)
            fine = lambda u: F.when(F.startswith(u, F.lit(spec.cover_must)) & ~refused(u), u)
            values["cover"] = bind(bind(values["cover"], whole), fine)
        if spec.people is not None:
            names = F.regexp_extract_all(block, F.lit(spec.people.patterns[0]), F.lit(1))
            cleaned = F.transform(names, html_text)
            values["author"] = F.array_join(first_of(F.array_distinct(F.filter(cleaned, lambda n: n != "")), people), ", ")
        return F.struct(
            i.alias("arrival"), (F.upper(ident) if spec.upper_id else ident).alias("id"),
            *[v.alias(n) for n, v in values.items()],
        )

    def complete(x: Column) -> Column:
        fine = F.lit(True)
        for name in spec.required:
            fine = fine & x[name].isNotNull()
        if spec.detail_host:
            url = x["detail_url"]
            of_shop = lambda host: (host == spec.detail_host) | F.endswith(host, F.lit("." + spec.detail_host))
            fine = fine & F.startswith(url, F.lit("https://")) & ~F.contains(url, F.lit(".."))
            fine = fine & bind(url_domain(url), of_shop)
            for text in spec.detail_must:
                fine = fine & F.contains(url, F.lit(text))
        if spec.same_id:
            fine = fine & (F.regexp_extract(x["detail_url"], spec.same_id, 1) == x["id"])
        return F.coalesce(fine, F.lit(False))

    # One expression, exploded with its empty pages: a filter on what is read would be moved before any exchange under the
    # pages, and a plain explode brings a filter of its own that reads every page a second time.
    items = F.when(F.rlike(html, F.lit(spec.guard)), first_of(F.filter(F.transform(blocks, item), complete), limit))
    kept = pages.select(key, F.posexplode_outer(items).alias("pos", "item")).filter("pos IS NOT NULL")
    return kept.select(key, "pos", "item.*").drop("arrival")


META, LINK = r"(?is)<meta\s+([^>]*?)/?>", r"(?is)<link\s+([^>]*?)/?>"
# Image declarations in the order they are believed, and what they are called.
COVER_KEYS = [
    ("og:image:secure_url", "WEBPAGE_OPEN_GRAPH"), ("og:image", "WEBPAGE_OPEN_GRAPH"), ("twitter:image", "WEBPAGE_TWITTER"),
    ("twitter:image:src", "WEBPAGE_TWITTER"), ("image", "WEBPAGE_IMAGE_SRC"),
]


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)(?:^|[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    values = [F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)]
    return F.when(F.rlike(tag, F.lit(pattern)), F.concat(*values))


def resolve_url(raw: Column, base: Column) -> Column:
    """Absolute form of a reference found on a page."""
    value, origin = strip(raw), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"[^/]*$", "")
    path, tail = F.regexp_extract(value, r"^([^?#]*)", 1), F.regexp_extract(value, r"([?#].*)$", 1)
    steps = F.aggregate(
        F.split(F.concat(folder, path), "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when((s == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == "..", acc).otherwise(F.array_append(acc, s)),
    )
    return (
        F.when(value == "", F.lit(None).cast("string"))
        .when(F.rlike(value, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), value)
        .when(F.startswith(value, F.lit("//")), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), value))
        .when(F.startswith(value, F.lit("/")), F.concat(origin, value))
        .otherwise(F.concat(origin, F.lit("/"), F.array_join(steps, "/"), tail))
    )


def page_cover(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """key, cover_url, source: the first declared image of a page that may be fetched."""
    tags = lambda p: F.regexp_extract_all(html, F.lit(p), F.lit(1))
    metas = F.transform(tags(META), lambda t: F.struct(
        F.lower(strip(F.coalesce(_attribute(t, "property"), _attribute(t, "name"), _attribute(t, "itemprop")))).alias("key"),
        F.nullif(strip(_attribute(t, "content")), F.lit("")).alias("content"),
    ))
    links = F.filter(
        F.transform(tags(LINK), lambda t: F.struct(
            F.lower(strip(_attribute(t, "rel"))).alias("rel"), F.nullif(strip(_attribute(t, "href")), F.lit("")).alias("href"),
        )), lambda s: s["rel"] == "image_src")
    rows = pages.select(key, F.col(url).alias("page_url"), metas.alias("metas"), links.alias("links"))

    def usable(raw: Column, source: str) -> Column:
        found = lambda full: F.when(
            is_safe_image_url(full), F.struct(full.alias("cover_url"), F.lit(source).alias("source"))
        )
        return bind(resolve_url(raw, F.col("page_url")), found)

    first = lambda k: F.try_element_at(
        F.filter("metas", lambda s: (s["key"] == k) & s["content"].isNotNull()), F.lit(1)
    )["content"]
    found = [usable(first(k), source) for k, source in COVER_KEYS]
    found.append(usable(F.try_element_at(F.col("links"), F.lit(1))["href"], "WEBPAGE_IMAGE_SRC"))
    return rows.select(key, F.coalesce(*found).alias("c")).filter(F.col("c").isNotNull()).select(key, "c.*")


# Services whose names appear in similarity tables.
SERVICE = (
    r"(?i)>(danbooru|konachan|yande\.re|gelbooru|sankaku(?:\s+channel)?|e-?shuushuu|zerochan|anime-?pictures|3dbooru)<"
)
OWN_HOST = "iqdb.org"
IMAGE_FILE = r"(?i)\.(jpe?g|png|gif|webp)(\?.*)?$"


def parse_similarity_tables(pages: DataFrame, key: str, html: str = "html", limit: int | None = 10) -> DataFrame:
    """key, pos, source_url, image_url, service, similarity: one hit per table that links elsewhere."""
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))
    full = lambda u: F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).otherwise(u)
    outside = lambda t, p: F.filter(
        F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), full), lambda u: ~F.contains(u, F.lit(OWN_HOST))
    )

    def hit(t: Column) -> Column:
        anchors = outside(t, r'(?i)href="((?:https?:)?//[^"]+)"')
        pages_ = F.filter(anchors, lambda u: ~F.rlike(u, F.lit(IMAGE_FILE)))
        one = lambda a: F.try_element_at(a, F.lit(1))
        service = F.regexp_extract(t, SERVICE, 1)
        named = F.concat(F.upper(F.substring(service, 1, 1)), F.substring(service, 2, 100))
        return F.struct(
            F.coalesce(one(pages_), one(anchors)).alias("source_url"),
            one(outside(t, r'(?i)<img[^>]+src="((?:https?:)?//[^"]+)"')).alias("image_url"), named.alias("service"),
            F.regexp_extract(t, r"(?i)(\d{1,3})\s*%\s*similarity", 1).try_cast("double").alias("similarity"),
        )

    hits = F.filter(F.transform(tables, hit), lambda h: h["source_url"].isNotNull())
    return pages.select(key, F.posexplode(first_of(hits, limit)).alias("pos", "h")).select(key, "pos", "h.*")


def parse_pasted_hits(texts: DataFrame, key: str, text: str = "text", limit: int | None = 10) -> DataFrame:
    """key, pos, source_url, title, similarity: one hit per line with an address; the title stands before it."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), strip)
    url = lambda l: F.regexp_extract(l, r"""(?i)\b(https?://[^\s<>"']+)""", 1)
    hits = F.transform(F.filter(lines, lambda l: url(l) != ""), lambda l: F.struct(
        url(l).alias("source_url"),
        F.regexp_replace(strip(F.call_function("substring_index", l, url(l), F.lit(1))), r"^[\-:–—]+|[\-:–—]+$", "").alias("title"),
        F.regexp_extract(l, r"(?i)(\d{1,3})\s*%", 1).try_cast("double").alias("similarity"),
    ))
    return texts.select(key, F.posexplode(first_of(hits, limit)).alias("pos", "h")).select(key, "pos", "h.*")
