"""Stored provider replies (JSON text) as result rows.

Each parser returns rows per result; :func:`open_library_status` and its siblings say how a reply went. Fields that
come as a text or as a list are declared as text, which keeps the raw JSON of a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colophon.functions.text import first_of, normalize_code, strip

# Fixed values of the two book catalogues and the picture search.
OL_SCHEMA = (
    "numFound double, docs array<struct<key string, title string, author_name string, first_publish_year double, "
    "publisher string, cover_i string, language string, number_of_pages double>>"
)
OL_KEY = r"^/(works|books)/(OL[0-9]+[A-Z]?)$"
OL_SITE, OL_COVERS = "https://openlibrary.org", "https://covers.openlibrary.org"
GB_SCHEMA = (
    "totalItems string, items array<struct<id string, volumeInfo struct<title string, authors string, publisher string, "
    "publishedDate string, description string, pageCount string, language string, canonicalVolumeLink string, "
    "infoLink string, imageLinks struct<thumbnail string, smallThumbnail string>, "
    "industryIdentifiers array<struct<type string, identifier string>>>>>"
)
GB_ID, GB_SITE = r"^[A-Za-z0-9_-]{1,64}$", "https://books.google.com/books?id="
REVERSE_SCHEMA = (
    "header struct<status string, short_remaining string, long_remaining string>, "
    "results array<struct<header map<string,string>, data map<string,string>>>"
)
PEOPLE, PUBLISHERS, LANGUAGES = 4, 2, 3  # names of a book that are listed unless asked otherwise
RJ_CODE = r"(?i)\bRJ[\s_-]?(\d{6,8})\b"


def _filled(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def _list(raw: Column) -> Column:
    """A JSON list of texts, or one text, as an array of texts."""
    return F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))


def _texts(raw: Column, most: int | None) -> Column:
    clean = F.filter(F.transform(_list(raw), strip), lambda t: t != "")
    return F.coalesce(first_of(F.array_distinct(clean), most), F.array().cast("array<string>"))


def _rows(replies: DataFrame, key: str, items: Column, keep, limit: int | None) -> DataFrame:
    """First ``limit`` (None: all) complete results of each reply with their position."""
    kept = first_of(F.filter(items, keep), limit)
    return replies.select(key, F.posexplode(kept).alias("pos", "r")).select(key, "pos", "r.*")


def parse_open_library(
    replies: DataFrame, key: str, body: str = "body", limit: int | None = 50, people: int | None = PEOPLE,
    publishers: int | None = PUBLISHERS, languages: int | None = LANGUAGES,
) -> DataFrame:
    """key, pos, id, title, authors, year, publishers, pages, languages, cover_url, detail_url; a limit of None lists all."""

    def book(d: Column) -> Column:
        name = strip(d["key"])
        cover = F.try_element_at(_list(d["cover_i"]), F.lit(1))
        number = cover.try_cast("double")
        cover_id = F.when(number.isNotNull(), F.when(number > 0, number.cast("long").cast("string"))).when(
            F.rlike(cover, F.lit(r"^[\p{L}\p{Nd}]+$")), cover
        )
        return F.struct(
            F.nullif(F.regexp_extract(name, OL_KEY, 2), F.lit("")).alias("id"), _filled(d["title"]).alias("title"),
            _texts(d["author_name"], people).alias("authors"), d["first_publish_year"].cast("int").alias("year"),
            _texts(d["publisher"], publishers).alias("publishers"),
            F.when(d["number_of_pages"] > 0, d["number_of_pages"].cast("int")).alias("pages"),
            _texts(d["language"], languages).alias("languages"),
            F.concat(F.lit(f"{OL_COVERS}/b/id/"), cover_id, F.lit("-M.jpg")).alias("cover_url"),
            F.concat(F.lit(OL_SITE), name).alias("detail_url"),
        )

    parsed = replies.withColumn("j", F.from_json(body, OL_SCHEMA))
    return _rows(parsed, key, F.transform("j.docs", book), lambda r: r["id"].isNotNull() & r["title"].isNotNull(), limit)


def open_library_status(replies: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, status OK|ERROR, available: a reply without a docs list is an error, not an empty answer."""
    j = F.from_json(body, OL_SCHEMA)
    return replies.select(
        key, F.when(j["docs"].isNull(), "ERROR").otherwise("OK").alias("status"), j["numFound"].cast("int").alias("available")
    )


def parse_google_books(replies: DataFrame, key: str, body: str = "body", limit: int | None = 50, people: int | None = PEOPLE) -> DataFrame:
    """key, pos, id, title, authors, year, publisher, pages, language, cover_url, detail_url, identifier; a limit of None lists all."""
    secure = lambda u: F.when(F.startswith(u, F.lit("https://")), u)

    def volume(v: Column) -> Column:
        info, ident = v["volumeInfo"], strip(v["id"])
        year = F.substring(strip(info["publishedDate"]), 1, 4).try_cast("int")
        cover = strip(F.coalesce(info["imageLinks"]["thumbnail"], info["imageLinks"]["smallThumbnail"]))
        pages = info["pageCount"].try_cast("double").cast("int")
        numbers = F.filter(F.transform(info["industryIdentifiers"], lambda i: strip(i["identifier"])), lambda t: t != "")
        return F.struct(
            F.when(F.rlike(ident, F.lit(GB_ID)), ident).alias("id"), _filled(info["title"]).alias("title"),
            _texts(info["authors"], people).alias("authors"), F.when(year.between(1000, 2100), year).alias("year"),
            _filled(info["publisher"]).alias("publisher"), F.when(pages > 0, pages).alias("pages"),
            _filled(info["language"]).alias("language"),
            secure(F.regexp_replace(cover, "^http://", "https://")).alias("cover_url"),
            F.coalesce(secure(info["canonicalVolumeLink"]), secure(info["infoLink"]), F.concat(F.lit(GB_SITE), ident)).alias("detail_url"),
            F.try_element_at(numbers, F.lit(1)).alias("identifier"),
        )

    parsed = replies.withColumn("j", F.from_json(body, GB_SCHEMA))
    return _rows(parsed, key, F.transform("j.items", volume), lambda r: r["id"].isNotNull() & r["title"].isNotNull(), limit)


def google_books_status(replies: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, status, available: absent items are an empty answer, items that are no list are an error."""
    raw = F.get_json_object(body, "$.items")
    valid = F.get_json_object(body, "$").isNotNull()
    status = F.when(~valid, "ERROR").when(raw.isNull() | F.startswith(raw, F.lit("[")), "OK").otherwise("ERROR")
    total = F.get_json_object(body, "$.totalItems").try_cast("double").cast("int")
    return replies.select(key, status.alias("status"), total.alias("available"))


def reverse_status(replies: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, status SUCCESS|NO_RESULTS|QUOTA_EXCEEDED|ERROR of a picture search reply."""
    j = F.from_json(body, REVERSE_SCHEMA)
    code = j["header"]["status"].try_cast("double").cast("int")
    left = lambda c: j["header"][c].try_cast("double").cast("int")
    spent = (left("short_remaining") <= 0) | (left("long_remaining") <= 0)
    status = (
        F.when(j["header"].isNull(), "ERROR").when((code != 0) & F.coalesce(spent, F.lit(False)), "QUOTA_EXCEEDED")
        .when(code != 0, "ERROR").when(F.coalesce(F.size(j["results"]), F.lit(0)) > 0, "SUCCESS").otherwise("NO_RESULTS")
    )
    return replies.select(key, status.alias("status"))


def parse_reverse_hits(replies: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, pos, similarity, source_url, image_url, title, circle, author, product_id, index_name, metadata.

    Only replies whose status is 0 deliver hits. The map of remaining data fields is kept as text.
    """
    text = lambda m, k: F.coalesce(strip(F.try_element_at(m, F.lit(k))), F.lit(""))
    joined = lambda raw: F.when(
        F.startswith(raw, F.lit("[")),
        F.array_join(F.filter(F.transform(F.from_json(raw, "array<string>"), strip), lambda t: t != ""), ", "),
    ).when(F.startswith(raw, F.lit("{")), F.lit("")).otherwise(strip(raw))
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    web = lambda u, p: F.rlike(u, F.lit(p))

    def hit(r: Column) -> Column:
        head, data = r["header"], r["data"]
        links = F.coalesce(_list(F.try_element_at(data, F.lit("ext_urls"))), F.array().cast("array<string>"))
        links = F.transform(links, strip)
        one = lambda p: F.try_element_at(F.filter(links, lambda u: web(u, p)), F.lit(1))
        source = F.coalesce(one("(?i)^https://"), one("(?i)^http://"), one(r"\S"))
        title = first(text(data, "title"), text(data, "eng_name"), text(data, "jp_name"))
        scanned = F.concat_ws(" ", title, source, F.nullif(text(data, "dlsite_id"), F.lit("")))
        thumb = text(head, "thumbnail")
        named = F.array(*[F.struct(F.lit(n).alias("key"), text(head, k).alias("value")) for n, k in (
            ("index", "index_name"), ("similarity", "similarity"), ("index_id", "index_id"))])
        fields = F.transform(F.map_entries(data), lambda e: F.struct(strip(e["key"]).alias("key"), F.coalesce(joined(e["value"]), F.lit("")).alias("value")))
        own = F.filter(named, lambda e: ~F.exists(fields, lambda f: (f["key"] == e["key"]) & (f["value"] != "")))
        metadata = F.map_from_entries(F.filter(F.concat(own, F.coalesce(fields, F.array().cast("array<struct<key:string,value:string>>"))),
                                               lambda e: (e["key"] != "") & (e["value"] != "")))
        return F.struct(
            text(head, "similarity").try_cast("double").alias("similarity"), source.alias("source_url"),
            F.when(web(thumb, "(?i)^https?://"), thumb).alias("image_url"), title.alias("title"),
            text(data, "company").alias("circle"),
            first(joined(F.coalesce(F.try_element_at(data, F.lit("creator")), F.lit(""))), text(data, "author_name"), text(data, "member_name")).alias("author"),
            normalize_code(F.regexp_extract(scanned, RJ_CODE, 0)).alias("product_id"),
            F.nullif(text(head, "index_name"), F.lit("")).alias("index_name"), metadata.alias("metadata"),
        )

    parsed = replies.withColumn("j", F.from_json(body, REVERSE_SCHEMA))
    status = F.col("j.header.status").try_cast("double").cast("int")
    answered = parsed.filter(F.col("j.header").isNotNull() & (status.isNull() | (status == 0)))
    return answered.select(key, F.posexplode(F.transform("j.results", hit)).alias("pos", "r")).select(key, "pos", "r.*")
