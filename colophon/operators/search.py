"""Logged search texts as fields, provider routing and search links.

Everything here is a projection: the provider dimension is a short literal list, so no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colophon.functions.text import bind, collapse, fold_width, normalize_code, strip
from colophon.functions.urls import url_domain, url_scheme

# Text prefixes that name a field, and product codes.
FIELD_PREFIX = r"(?i)^(title|t|circle|c|author|a|code|id|r):(.*)$"
PLAIN_CODE = r"(?i)\bRJ\d{6,10}\b"
SPACED_CODE = r"(?i)\bRJ[\s\-]?\d{6,10}\b"
SEARCH_FIELDS = ["TITLE", "CIRCLE", "AUTHOR", "CODE", "IMAGE_REFERENCE"]

# What the queried providers can search by, their page size and whether they are secondary.
CAPABILITIES = [
    ("ol", ["TITLE", "AUTHOR", "CODE"], 20, True),
    ("gb", ["TITLE", "AUTHOR", "CODE"], 20, True),
    ("dl", ["TITLE", "CIRCLE", "CODE"], 30, False),
]
# Search pages (id, name, host, template, landing page, space as plus).
PROVIDERS = [
    ("ol", "Open Library", "openlibrary.org", "https://openlibrary.org/search?q={q}", "https://openlibrary.org/search", False),
    ("gb", "Google Books", "google.com", "https://www.google.com/search?tbm=bks&q={q}", "https://books.google.com/", False),
    ("dl", "DLsite", "dlsite.com", "https://www.dlsite.com/books/fsr/=/keyword/{q}", "https://www.dlsite.com/books/", True),
    ("mb", "Melonbooks", "melonbooks.co.jp", "https://www.melonbooks.co.jp/search/search.php?mode=search&name={q}", "https://www.melonbooks.co.jp/", False),
    ("sy", "Suruga-ya", "suruga-ya.jp", "https://www.suruga-ya.jp/search?category=&search_word={q}", "https://www.suruga-ya.jp/", False),
    ("dm", "Doujin no Mori", "doujinnomori.com", "https://doujinnomori.com/comics/free-search?keyword={q}", "https://doujinnomori.com/", False),
    ("eh", "E-Hentai", "e-hentai.org", "https://e-hentai.org/?f_search={q}", "https://e-hentai.org/", False),
    ("di", "Doujinshi.info", "doujinshi.info", "https://www.doujinshi.info/works?query={q}", "https://www.doujinshi.info/", False),
    ("mal", "MyAnimeList", "myanimelist.net", "https://myanimelist.net/manga.php?q={q}&cat=manga", "https://myanimelist.net/manga.php", False),
    ("nh", "nhentai", "nhentai.net", "https://nhentai.net/search/?q={q}", "https://nhentai.net/", False),
    ("tr", "Toranoana", "ec.toranoana.jp", "https://ec.toranoana.jp/tora_r/ec/app/catalog/list?searchWord={q}", "https://ec.toranoana.jp/tora_r/ec/", False),
]
SELECTABLE = [c[0] for c in CAPABILITIES]
RESULT_LIMITS, DEFAULT_LIMIT = [5, 10, 20, 30, 50], 5


def _last(tokens: Column) -> Column:
    return F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))


def parse_search_queries(log: DataFrame, text: str = "text", image: str | None = None) -> DataFrame:
    """Adds title, circle, author, code, fields and keyword to a log of search texts.

    ``title:``, ``circle:``, ``author:`` and ``code:`` (with their short forms) name a field, the last one wins;
    a product code anywhere is taken out of the title.
    """
    folded = strip(fold_width(F.col(text)))
    kind = lambda t: F.lower(F.regexp_extract(t, FIELD_PREFIX, 1))
    value = lambda t: collapse(F.regexp_extract(t, FIELD_PREFIX, 2))
    code_in = lambda t: F.regexp_extract(t, PLAIN_CODE, 0)
    named = lambda names: _last(F.transform(F.filter("tokens", lambda t: kind(t).isin(names)), value))
    bare_code = lambda t: (kind(t) == "") & (code_in(t) != "")
    title_part = lambda t: (
        F.when(kind(t).isin("title", "t"), value(t)).when(kind(t) != "", F.lit(""))
        .when(code_in(t) != "", F.replace(t, code_in(t), F.lit(""))).otherwise(t)
    )
    token_code = _last(F.transform(
        F.filter("tokens", lambda t: kind(t).isin("code", "id", "r") | bare_code(t)),
        lambda t: F.when(kind(t) != "", value(t)).otherwise(F.upper(code_in(t))),
    ))
    parsed = (
        log.withColumn("folded", folded)
        .withColumn("tokens", F.filter(F.split("folded", " "), lambda t: strip(t) != ""))
        .withColumn("circle", named(["circle", "c"])).withColumn("author", named(["author", "a"]))
        .withColumn("own_code", token_code)
        .withColumn("own_title", collapse(F.array_join(F.transform("tokens", title_part), " ")))
    )
    spaced = F.regexp_extract("folded", SPACED_CODE, 0)
    found = F.when(F.col("own_code") == "", F.when(spaced != "", spaced).otherwise(F.regexp_extract("own_title", PLAIN_CODE, 0))).otherwise("")
    parsed = parsed.withColumn("found", found).withColumn(
        "code", normalize_code(F.when(F.col("own_code") != "", F.col("own_code")).otherwise(F.col("found")))
    )
    rest = F.when(F.col("found") != "", collapse(F.replace("own_title", "found", F.lit("")))).otherwise(F.col("own_title"))
    title = F.when(F.col("code") != "", collapse(F.regexp_replace(rest, r"(?i)\brj\b", ""))).otherwise(rest)
    parsed = parsed.withColumn("title", title)
    given = [F.when(strip(F.col(f.lower())) != "", F.lit(f)) for f in SEARCH_FIELDS[:4]]
    if image is not None:
        given.append(F.when(F.coalesce(strip(F.col(image)), F.lit("")) != "", F.lit("IMAGE_REFERENCE")))
    keyword = F.array_join(
        F.filter(F.array("code", "title", "circle", "author"), lambda v: strip(v) != ""), " "
    )
    return parsed.withColumn("fields", F.array_compact(F.array(*given))).withColumn("keyword", keyword).drop(
        "folded", "tokens", "own_code", "own_title", "found"
    )


def sanitize_selection(ids: Column) -> Column:
    """Known, selectable provider ids in lower case; a null selection means all of them."""
    clean = F.filter(F.transform(ids, lambda i: F.lower(strip(i))), lambda i: i.isin(SELECTABLE))
    return F.when(ids.isNull(), F.array(*[F.lit(i) for i in SELECTABLE])).otherwise(F.array_distinct(clean))


def result_limit(requested: Column, provider_max: Column | int) -> Column:
    """An offered limit (else the default), never above what one page of the provider holds."""
    page = provider_max if isinstance(provider_max, Column) else F.lit(provider_max)
    offered = F.when(requested.isin(RESULT_LIMITS), requested).otherwise(DEFAULT_LIMIT)
    return F.least(offered, F.greatest(page, F.lit(1)))


def route_queries(queries: DataFrame, selected: str = "selected", include_secondary: bool = True) -> DataFrame:
    """One row per query and selected provider: provider, eligible, ignored fields, page size.

    A provider is eligible when something of the query is left after the fields it lacks are dropped.
    """
    dimension = F.array(*[
        F.struct(F.lit(i).alias("provider"), F.array(*[F.lit(f) for f in fields]).alias("can"), F.lit(page).alias("page"),
                 F.lit(secondary).alias("secondary"))
        for i, fields, page, secondary in CAPABILITIES
    ])
    rows = queries.withColumn("p", F.explode(F.filter(dimension, lambda p: F.array_contains(F.col(selected), p["provider"]))))
    usable = F.size(F.array_intersect("fields", "p.can")) > 0
    return rows.select(
        *queries.columns, "p.provider", "p.page",
        (usable & (F.lit(include_secondary) | ~F.col("p.secondary"))).alias("eligible"),
        F.array_except("fields", "p.can").alias("ignored"),
    )


def safe_link(url: Column, host: Column) -> Column:
    """https on the expected host or a sub-host, without credentials, on the default port."""
    expected = lambda domain: (domain == host) | F.endswith(domain, F.concat(F.lit("."), host))
    return F.coalesce(
        (url_scheme(url) == "https") & bind(url_domain(url), expected)
        & ~F.rlike(url, F.lit("^https://[^/?#]*@")) & ~F.rlike(url, F.lit(r"^https://[^/?#]*:(?!443(?:[/?#]|$))")),
        F.lit(False),
    )


def search_urls(queries: DataFrame, text: str = "keyword", providers: list[tuple] | None = None) -> DataFrame:
    """One row per query and provider with its search address; a blank query leads to the landing page."""
    dimension = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(("provider", "name", "host", "template", "landing", "plus"), p)])
        for p in providers or PROVIDERS
    ])
    spellings = lambda t: F.struct(
        t.alias("text"), F.url_encode(t).alias("plus"), F.replace(F.url_encode(t), F.lit("+"), F.lit("%20")).alias("percent")
    )

    def addresses(s: Column) -> Column:
        filled = lambda p: F.replace(p["template"], F.lit("{q}"), F.when(p["plus"], s["plus"]).otherwise(s["percent"]))
        all_ = F.transform(dimension, lambda p: F.struct(
            p["provider"].alias("provider"), F.when(s["text"] == "", p["landing"]).otherwise(filled(p)).alias("search_url"), p["host"].alias("host")
        ))
        return F.filter(all_, lambda a: safe_link(a["search_url"], a["host"]))

    # Built once per query inside one expression; exploded with empty lists, as a plain explode would build it twice.
    built = bind(bind(strip(F.col(text)), spellings), addresses)
    rows = queries.withColumn("p", F.explode_outer(built)).filter("p IS NOT NULL")
    return rows.select(*queries.columns, "p.provider", "p.search_url")
