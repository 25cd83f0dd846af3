"""Recognised text: useful lines, title and author suggestions, and recognition quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colophon.functions.text import nfkc, strip

# Fixed values of line selection.
MIN_LINE, MAX_LINE, MAX_QUERY, TITLE_LINES = 3, 90, 120, 3
HEIGHT_WEIGHT = 1000.0
# Words that mark a line as imprint, blurb or trade text.
NOISE_WORDS = [
    "isbn", "issn", "doi", "ean", "upc", "vol", "vol.", "volume", "edition", "ed.", "edn",
    "series", "book", "part", "no.", "nr.", "number", "price", "net", "pbk", "hbk", "paperback",
    "hardcover", "paperbacks", "translated", "translator", "edited", "editor", "introduction", "foreword",
    "afterword", "illustrated", "illustrator", "photography", "photographs", "adaptation",
    "adapted", "retold", "illustration", "cover", "publication", "published", "publisher",
    "press", "presses", "books", "group", "media", "ltd", "llc", "inc", "gmbh", "sarl",
    "manga", "anime", "novel", "trilogy", "duology", "tetralogy", "box", "set", "complete",
    "collector", "anniversary", "reissue", "reprint", "first", "edition.", "bestseller",
    "www", "http", "https", "com", "net", "org", "page", "pages", "chap", "chapter",
]
EDGE = r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$"


def _letters(line: Column) -> Column:
    return F.regexp_replace(line, r"[^\p{L}]", "")


def _clean(line: Column) -> Column:
    dashes = F.regexp_replace(F.regexp_replace(line, "\t", " "), "[–—]", "-")
    return F.regexp_replace(F.regexp_replace(dashes, " +", " "), EDGE, "")


def _has_noise_word(line: Column) -> Column:
    words = F.transform(F.split(F.lower(line), " "), lambda w: F.regexp_replace(w, EDGE, ""))
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in NOISE_WORDS]))


def is_noise_line(line: Column) -> Column:
    """No letters, more digits than letters, prices, addresses, or a noise word."""
    digits = F.length(F.regexp_replace(line, r"[^\p{Nd}]", ""))
    return (
        (F.length(_letters(line)) == 0) | (digits > F.length(_letters(line)))
        | F.rlike(line, F.lit("[€$£¥₩@]|://")) | _has_noise_word(line)
    )


def kept_lines(text: Column) -> Column:
    """array<struct<line_no,line>> of the useful lines; line_no counts all lines of the text."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda raw, i: F.struct(i.alias("line_no"), _clean(raw).alias("line")))
    fits = F.filter(lines, lambda s: F.length(s["line"]).between(MIN_LINE, MAX_LINE))
    return F.filter(fits, lambda s: ~is_noise_line(s["line"]))


def ocr_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no, line of every useful line."""
    return texts.select(key, F.explode(kept_lines(F.col(text))).alias("l")).select(key, "l.line_no", "l.line")


def is_person_line(line: Column) -> Column:
    """Two to four capitalised words made of letters and dots."""
    words = F.split(line, " ")
    core = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{Nd}.]+|[^\p{L}\p{Nd}.]+$", "")
    shouted = (line == F.upper(line)) & ~F.rlike(line, F.lit(r"[A-Z]\."))
    return (
        F.size(words).between(2, 4) & ~_has_noise_word(line) & ~shouted
        & F.forall(words, lambda w: F.rlike(core(w), F.lit(r"^\p{Lu}[\p{L}.]*$"))) & (F.length(_letters(line)) >= 4)
    )


def suggest_title_author(texts: DataFrame, key: str, text: str = "text", heights: str | None = None) -> DataFrame:
    """key, title, author, confidence of every text with a usable line.

    The title is the tallest of the first three useful lines (the earlier one of equals); the author is the
    first person-like line after it, else the last one before. It stays inside one row: no shuffle.
    """
    height = lambda n: F.lit(0.0)
    if heights is not None:
        given = lambda n: F.try_element_at(F.col(heights), n + 1).cast("double")
        height = lambda n: F.when((given(n) > 0) & (given(n) < float("inf")), given(n)).otherwise(0.0)
    rows = texts.select(key, *([heights] if heights else []), kept_lines(F.col(text)).alias("lines")).filter(F.size("lines") > 0)
    ranked = F.transform(
        F.slice("lines", 1, TITLE_LINES),
        lambda s, i: F.struct((height(s["line_no"]) * HEIGHT_WEIGHT + (TITLE_LINES - i)).alias("rank"), (-i).alias("up")),
    )
    rows = rows.withColumn("at", -F.array_max(ranked)["up"]).withColumn("title", F.col("lines")[F.col("at")]["line"])
    people = F.filter(
        F.transform("lines", lambda s, i: F.struct(i.alias("i"), s["line"].alias("line"))), lambda s: is_person_line(s["line"])
    )
    rows = rows.withColumn("people", people)
    after = F.try_element_at(F.filter("people", lambda s: s["i"] > F.col("at")), F.lit(1))["line"]
    before = F.try_element_at(F.filter("people", lambda s: s["i"] < F.col("at")), F.lit(-1))["line"]
    author = F.coalesce(after, before)
    fits = F.length("title") + 1 + F.length(author) <= MAX_QUERY
    return rows.filter(F.length(_letters(F.col("title"))) >= 2).select(
        key, "title", F.when(fits, author).alias("author"), F.when(fits, 2).otherwise(1).alias("confidence")
    )


def search_form(c: Column) -> Column:
    """A recognised text as it is searched: compatibility characters folded, ends stripped; a blank text is empty."""
    return F.when(c.isNotNull(), strip(F.regexp_replace(nfkc(c), r"[\t\u3000]", " ")))


def with_search_text(suggestions: DataFrame) -> DataFrame:
    """Adds search_title, search_author and query (both, or the title alone); title and author stay as recognised."""
    folded = suggestions.withColumns({"search_title": search_form(F.col("title")), "search_author": search_form(F.col("author"))})
    return folded.withColumn("query", F.concat_ws(" ", "search_title", "search_author"))


def _squeezed(c: Column, normal_form) -> Column:
    return F.regexp_replace(normal_form(c), r"\s+", "")


def ocr_regions(truth: DataFrame, lines: DataFrame, normal_form=lambda c: c) -> DataFrame:
    """fixture, region, truth, got, distance, chars, exact: each truth region with the closest line of its image.

    truth: fixture, region, text; lines: fixture, line_no, text. ``normal_form`` may fold compatibility characters
    (:func:`colophon.functions.text.nfkc`). Regions that occur among the lines letter by letter are settled by an
    equi-join; only the others are compared with the lines of their own image.
    """
    want = truth.select("fixture", "region", F.col("text").alias("truth"), _squeezed(F.col("text"), normal_form).alias("t"))
    have = lines.select("fixture", "line_no", F.col("text").alias("got"), _squeezed(F.col("text"), normal_form).alias("g"))
    same = (
        want.join(have, (want["fixture"] == have["fixture"]) & (want["t"] == have["g"]))
        .groupBy(want["fixture"], "region", "truth", "t").agg(F.min_by(F.struct("got", "g"), "line_no").alias("b"))
        .withColumn("distance", F.lit(0))
    )
    rest = want.join(same.select("fixture", "region", "t"), ["fixture", "region", "t"], "left_anti")
    measured = rest.join(have, "fixture", "left").withColumn("distance", F.levenshtein("t", F.coalesce("g", F.lit(""))))
    near = measured.groupBy("fixture", "region", "truth", "t").agg(
        F.min_by(F.struct("got", "g", "distance"), F.struct("distance", "line_no")).alias("b")
    )
    shared = ["fixture", "region", "truth", "t"]
    both = same.select(*shared, "b.got", "b.g", "distance").unionByName(near.select(*shared, "b.got", "b.g", "b.distance"))
    return both.select(
        "fixture", "region", "truth", F.coalesce("got", F.lit("")).alias("got"), "distance",
        F.greatest(F.length("t"), F.lit(1)).alias("chars"), (F.coalesce("g", F.lit("")) == F.col("t")).alias("exact"),
    )


def ocr_score(truth: DataFrame, lines: DataFrame, titles: DataFrame, normal_form=lambda c: c) -> DataFrame:
    """Per image: regions, errors, chars, exact, extra_lines, title_exact; sum them for the overall rate."""
    regions = ocr_regions(truth, lines, normal_form)
    wanted = titles.select("fixture", _squeezed(F.col("title"), normal_form).alias("title"))
    found = lines.groupBy("fixture").agg(F.count("*").alias("found"))
    title_hit = _squeezed(F.col("got"), normal_form) == F.col("title")
    return (
        regions.join(wanted, "fixture").groupBy("fixture")
        .agg(
            F.count("*").alias("regions"), F.sum("distance").alias("errors"), F.sum("chars").alias("chars"),
            F.count_if("exact").alias("exact"), F.bool_or(title_hit).alias("title_exact"),
        )
        .join(found, "fixture", "left")
        .withColumn("extra_lines", F.greatest(F.coalesce("found", F.lit(0)) - F.col("regions"), F.lit(0))).drop("found")
        .withColumn("cer", F.col("errors") / F.col("chars"))
    )


def overall_cer(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("fixtures"), (F.sum("errors") / F.greatest(F.sum("chars"), F.lit(1))).alias("cer"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two struct<x0,y0,x1,y1> columns."""
    f = F.col
    width = F.least(f(f"{a}.x1"), f(f"{b}.x1")) - F.greatest(f(f"{a}.x0"), f(f"{b}.x0"))
    height = F.least(f(f"{a}.y1"), f(f"{b}.y1")) - F.greatest(f(f"{a}.y0"), f(f"{b}.y0"))
    inter = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))
    area = lambda s: (f(f"{s}.x1") - f(f"{s}.x0")) * (f(f"{s}.y1") - f(f"{s}.y0"))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def detection_recall(truth: DataFrame, boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """fixture, regions, detected, recall; truth: fixture, region, box; boxes: fixture, box.

    Boxes meet only inside the image they belong to.
    """
    pairs = truth.join(boxes.select("fixture", F.col("box").alias("other")), "fixture", "left")
    hit = pairs.groupBy("fixture", "region").agg(
        F.coalesce(F.bool_or(iou("box", "other") >= threshold), F.lit(False)).alias("hit")
    )
    return hit.groupBy("fixture").agg(
        F.count("*").alias("regions"), F.count_if("hit").alias("detected"), F.avg(F.col("hit").cast("double")).alias("recall")
    )


def reading_order(regions: DataFrame) -> DataFrame:
    """fixture, region, position: lines by band then left to right; after them columns right to left.

    A line starts a new band when its centre is further from the previous one than a quarter of both heights;
    columns share a band within one unit. Windows run over the regions of one image.
    """
    centre_y, centre_x = (F.col("box.y0") + F.col("box.y1")) / 2, (F.col("box.x0") + F.col("box.x1")) / 2
    height = F.col("box.y1") - F.col("box.y0")
    r = regions.withColumn("along", F.when(F.col("vertical"), -centre_x).otherwise(centre_y)).withColumn("height", height)
    image = W.partitionBy("fixture", "vertical").orderBy("along", "region")
    gap = F.col("along") - F.lag("along").over(image)
    slack = F.when(F.col("vertical"), F.lit(1.0)).otherwise((F.col("height") + F.lag("height").over(image)) * 0.25)
    banded = r.withColumn("step", F.when(gap <= slack, 0).otherwise(1)).withColumn("band", F.sum("step").over(image))
    across = F.when(F.col("vertical"), F.col("box.y0")).otherwise(F.col("box.x0"))
    order = W.partitionBy("fixture").orderBy("vertical", "band", across, "region")
    return banded.select("fixture", "region", F.row_number().over(order).alias("position"))
