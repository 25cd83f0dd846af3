"""Notes, note shapes, media files and where the images of a workbook belong.

An image can be named by any number of notes, so its places and catalogue hits are tables of their own
(``places``, ``hits``) next to one row per image; nothing is gathered into arrays per image.
Rows carry their arrival order in ``pos`` wherever the first one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colophon.functions.cellref import a1_format, a1_parse, range_filter
from colophon.functions.text import contains_ci, natural_sort_key, strip
from colophon.sources.cells import SHEET

PREVIEW_CHARS = 120  # fixed value: longest note preview
CELL = [*SHEET, "row", "col"]


def first_shapes(shapes: DataFrame) -> DataFrame:
    """One shape per cell, the first to arrive."""
    return shapes.groupBy(*CELL).agg(F.min(F.struct("pos", "shape_id")).alias("s")).select(*CELL, "s.shape_id", "s.pos")


def match_comments_to_shapes(comments: DataFrame, shapes: DataFrame) -> DataFrame:
    """comments: comment_id, CELL, text, author, sheet_order; shapes: shape_id, CELL, pos -> comments + shape_id.

    Ordered by sheet, row and column.
    """
    matched = comments.join(first_shapes(shapes).select(*CELL, "shape_id"), CELL, "left")
    return matched.orderBy("sheet_order", "row", "col", "comment_id")


def shape_diagnostics(comments: DataFrame, shapes: DataFrame) -> DataFrame:
    """SHEET, problem, row, col, n: repeated shapes, shapes without a note, sheets lacking one of the two."""
    first = first_shapes(shapes)
    noted, drawn = comments.select(*SHEET).distinct(), shapes.select(*SHEET).distinct()
    none = F.lit(None).cast("int")
    columns = lambda problem, row, col, n: [
        *SHEET, F.lit(problem).alias("problem"), row.alias("row"), col.alias("col"), n.cast("long").alias("n"),
    ]
    repeated = shapes.join(first.select(*CELL, "shape_id"), [*CELL, "shape_id"], "left_anti").select(
        *columns("SECOND_SHAPE", F.col("row"), F.col("col"), F.lit(1))
    )
    orphans = (
        first.join(noted, SHEET, "left_semi").join(comments.select(*CELL), CELL, "left_anti")
        .select(*columns("SHAPE_WITHOUT_COMMENT", F.col("row"), F.col("col"), F.lit(1)))
    )
    bare = first.join(noted, SHEET, "left_anti").groupBy(*SHEET).agg(F.count("*").alias("n")).select(
        *columns("NO_COMMENTS_PART", none, none, F.col("n"))
    )
    undrawn = noted.join(drawn, SHEET, "left_anti").select(*columns("NO_DRAWING", none, none, F.lit(1)))
    return repeated.unionByName(orphans).unionByName(bare).unionByName(undrawn)


def resolve_path(base: Column, reference: Column) -> Column:
    """Package path of a reference seen from a part: ``..`` climbs, a leading slash starts at the root."""
    folder = F.regexp_replace(base, r"[^/]*$", "")
    joined = F.when(F.startswith(reference, F.lit("/")), reference).otherwise(F.concat(folder, reference))
    steps = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when((s == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    return F.array_join(steps, "/")


def resolve_media_refs(refs: DataFrame, relationships: DataFrame, media: DataFrame) -> DataFrame:
    """refs: shape_id, pos, kind SRC|RELID, reference, part -> shape_id, pos, kind, reference, media_path, detail.

    A shape whose SRC references reach a file keeps only those; else its RELID references count too. References
    to the same file, or the same failed text, are one row. relationships: part, rel_id, target, external;
    media: path.
    """
    src, rel = F.col("kind") == "SRC", F.col("kind") == "RELID"
    outside = src & (F.contains("reference", F.lit("://")) | F.startswith(F.lower("reference"), F.lit("data:")))
    seen = refs.join(
        relationships.select("part", F.col("rel_id").alias("reference"), "target", "external"), ["part", "reference"], "left"
    )
    wanted = F.when(src & ~outside, resolve_path(F.col("part"), F.col("reference"))).when(
        rel & F.col("target").isNotNull() & ~F.col("external"), resolve_path(F.col("part"), F.col("target"))
    )
    escapes = F.rlike("wanted", F.lit(r"(^|/)\.\.(/|$)")) | (F.col("wanted") == "")
    files = media.select(F.col("path").alias("_file"), F.lit(True).alias("present")).distinct()
    # References without a package path are many; each asks for a name of its own, so that they are not one key.
    asked = F.coalesce("wanted", F.concat(F.lit("//"), F.xxhash64("shape_id", "pos", "reference").cast("string")))
    reason = (
        F.when(outside, F.lit("external reference, not a package part"))
        .when(src & escapes, F.lit("not a valid package path"))
        .when(rel & F.col("target").isNull(), F.concat(F.lit("relationship '"), "reference", F.lit("' is not declared by this drawing")))
        .when(rel & F.col("external"), F.lit("external relationship"))
        .when(rel & escapes, F.lit("target is not a package path"))
        .when(F.col("present").isNull(), F.concat(F.lit("the package has no part '"), "wanted", F.lit("'")))
    )
    judged = (
        seen.withColumn("wanted", wanted).withColumn("_file", asked).join(files, "_file", "left").drop("_file").withColumn("detail", reason)
        .withColumn("media_path", F.when(F.col("detail").isNull(), F.col("wanted")))
    )
    reached = judged.filter(src & F.col("media_path").isNotNull()).select("shape_id").distinct()
    kept = judged.filter(src).unionByName(judged.filter(rel).join(reached, "shape_id", "left_anti"))
    identity = F.coalesce("media_path", F.concat_ws(":", "kind", "reference"))
    order = F.struct(F.when(src, 0).otherwise(1).alias("k"), "pos")
    return (
        kept.withColumn("identity", identity).groupBy("shape_id", "identity")
        .agg(F.min_by(F.struct("pos", "kind", "reference", "media_path", "detail"), order).alias("r"))
        .select("shape_id", "r.*")
    )


def place_images(candidates: DataFrame, cell_range: str, max_floating: int | None = None) -> DataFrame:
    """Images anchored in the range, one per cell: floating pictures before note images, then arrival.

    candidates: image_id, kind FLOATING|NOTE, row, col, pos. Only a given limit leaves floating pictures out.
    """
    inside = range_filter(candidates, cell_range)
    floating = inside.filter(F.col("kind") == "FLOATING")
    floating = floating if max_floating is None else floating.orderBy("pos").limit(max_floating)
    both = floating.unionByName(inside.filter(F.col("kind") == "NOTE"))
    order = F.struct(F.when(F.col("kind") == "FLOATING", 0).otherwise(1).alias("k"), "pos")
    return (
        both.groupBy("row", "col").agg(F.min_by(F.struct("image_id", "kind"), order).alias("i"))
        .select(a1_format(F.col("row"), F.col("col")).alias("cell"), "row", "col", "i.*")
    )


def preview(text: Column) -> Column:
    """First line with content, shortened to 120 characters."""
    line = strip(F.regexp_extract(text, r"(?m)^[^\n]*[^\s][^\n]*$", 0))
    return F.when(F.length(line) <= PREVIEW_CHARS, line).otherwise(
        F.concat(F.substring(line, 1, PREVIEW_CHARS - 1), F.lit("…"))
    )


def image_places(notes: DataFrame) -> DataFrame:
    """key, SHEET, row, col, cell, preview, pos of every note image.

    notes: one row per reference of a note: SHEET, row, col, text, media_path?, reference, detail, pos.
    """
    cell = a1_format(F.col("row"), F.col("col"))
    failed = F.concat(F.lit("unresolved:"), "sheet", F.lit("!"), cell, F.lit(":"), "reference")
    return notes.select(
        F.coalesce("media_path", failed).alias("key"), *SHEET, "row", "col", cell.alias("cell"),
        preview(F.col("text")).alias("preview"), "pos", "media_path", "reference", "detail",
    )


def image_hits(places: DataFrame, records: DataFrame) -> DataFrame:
    """key, SHEET, row, pos: the records named by the places of an image, each once.

    records: SHEET, row (distinct).
    """
    return (
        places.join(records.select(*SHEET, "row").distinct(), [*SHEET, "row"], "left_semi")
        .groupBy("key", *SHEET, "row").agg(F.min("pos").alias("pos"))
    )


def image_index(media: DataFrame, places: DataFrame) -> DataFrame:
    """key, media_path, file_name, format, size_bytes, state, detail and the first place of every image.

    media: path, size_bytes. A file is LINKED when a note reaches it and UNREFERENCED otherwise; a failed
    reference is an UNRESOLVED row of its own.
    """
    first = places.groupBy("key").agg(
        F.min_by(F.struct("sheet", "cell", "media_path", "reference", "detail"), "pos").alias("ref"), F.count("*").alias("places"),
    )
    name = F.substring_index("path", "/", -1)
    suffix = F.lower(F.substring_index(name, ".", -1))
    kind = F.when(suffix.isin("jpg", "jpeg"), "jpeg").when(suffix.isin("png", "gif", "webp", "bmp"), suffix).otherwise("unknown")
    text = F.lit(None).cast("string")
    where = [F.col("ref.sheet").alias("sheet"), F.col("ref.cell").alias("cell"), F.coalesce("places", F.lit(0).cast("long")).alias("places")]
    file = F.struct(
        F.col("path").alias("key"), F.col("path").alias("media_path"), name.alias("file_name"), kind.alias("format"),
        F.col("size_bytes").cast("long").alias("size_bytes"),
        F.when(F.col("places").isNull(), "UNREFERENCED").otherwise("LINKED").alias("state"), text.alias("detail"), *where,
    )
    failed = F.struct(
        F.col("key"), text.alias("media_path"), F.col("ref.reference").alias("file_name"), F.lit("unknown").alias("format"),
        F.lit(-1).cast("long").alias("size_bytes"), F.lit("UNRESOLVED").alias("state"), F.col("ref.detail").alias("detail"), *where,
    )
    both = media.select("path", "size_bytes", F.lit(True).alias("_file")).join(first, F.col("path") == F.col("key"), "full")
    each = F.array_compact(F.array(  # places are grouped once for files and failed references
        F.when(F.col("_file"), file), F.when(F.col("places").isNotNull() & F.col("ref.media_path").isNull(), failed),
    ))
    return both.select(F.explode(each).alias("i")).select("i.*")


def image_coverage(records: DataFrame, images: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: records, records with and without a linked image, unresolved and unreferenced images."""
    linked = images.filter("state = 'LINKED'").select("key")
    covered = hits.join(linked, "key", "left_semi").select(*SHEET, "row").distinct()
    marked = records.select(*SHEET, "row").join(covered.withColumn("covered", F.lit(1)), [*SHEET, "row"], "left")
    a = marked.agg(F.count("*").alias("records"), F.count("covered").alias("with_image"))
    b = images.agg(
        F.count_if(F.col("state") == "UNRESOLVED").alias("unresolved"),
        F.count_if(F.col("state") == "UNREFERENCED").alias("unreferenced"),
    )
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(a).join(one(b), "one").select(
        "records", "with_image", (F.col("records") - F.col("with_image")).alias("without_image"), "unresolved", "unreferenced"
    )


IMAGE_SORTS = {
    "NAME": lambda: [natural_sort_key(F.col("file_name")), F.col("file_name")],
    "SIZE": lambda: [F.when(F.col("size_bytes") < 0, F.lit(2**63 - 1)).otherwise(F.col("size_bytes"))],
    "FORMAT": lambda: [F.lower("format")],
    "WORKSHEET": lambda: [F.coalesce(F.lower("sheet"), F.lit("￿"))],
    "CELL": lambda: [
        F.coalesce(F.lower("sheet"), F.lit("￿")),
        F.coalesce(a1_parse(F.col("cell"))["row"], F.lit(2**31 - 1)),
        F.coalesce(a1_parse(F.col("cell"))["col"], F.lit(2**31 - 1)),
    ],
    "TITLE": lambda: [F.coalesce(F.lower("title"), F.lit("￿"))],
}


def query_images(
    images: DataFrame, places: DataFrame, hits: DataFrame, table: DataFrame, *, needle: str = "",
    states: list[str] | None = None, facets: list[tuple[str, int, str]] | None = None, sheet: str | None = None,
    sort: str = "NAME", ascending: bool = True,
) -> DataFrame:
    """Images that satisfy every given condition, ordered; descending reverses ties as well.

    facets are (sheet, col, shown value); table is the long record table. Every condition on places, hits or
    record cells is a semi-join on the image key.
    """
    out, needle = images, needle.strip()
    if states:
        out = out.filter(F.col("state").isin(states))
    if sheet is not None:
        out = out.join(places.filter(F.col("sheet") == sheet).select("key"), "key", "left_semi")
    if needle:
        own = images.filter(contains_ci(F.col("file_name"), needle) | contains_ci(F.col("detail"), needle)).select("key")
        at = places.filter(
            contains_ci(F.col("sheet"), needle) | contains_ci(F.col("cell"), needle) | contains_ci(F.col("preview"), needle)
        ).select("key")
        rows = table.filter(contains_ci(F.col("text"), needle)).select(*SHEET, "row")
        named = hits.join(rows, [*SHEET, "row"], "left_semi").select("key")
        out = out.join(own.unionByName(at).unionByName(named), "key", "left_semi")
    for name, col, value in facets or []:
        rows = table.filter((F.col("sheet") == name) & (F.col("col") == col) & (strip(F.col("shown")) == value.strip()))
        out = out.join(hits.join(rows.select(*SHEET, "row"), [*SHEET, "row"], "left_semi").select("key"), "key", "left_semi")
    keys = [*IMAGE_SORTS[sort](), F.col("key")]
    return out.orderBy(*[k.asc() if ascending else k.desc() for k in keys])


def source_location(images: DataFrame, places: DataFrame, sheets: DataFrame) -> DataFrame:
    """key, location VERIFIED|UNKNOWN|UNRESOLVED|UNREFERENCED, destinations: where an image can be opened."""
    known = places.join(sheets.select(*SHEET), SHEET, "left_semi").groupBy("key").agg(
        F.count_distinct("workbook", "sheet_key", "cell").alias("destinations")
    )
    reached = F.coalesce("destinations", F.lit(0))
    linked = F.col("state") == "LINKED"
    return images.join(known, "key", "left").select(
        "key",
        F.when(linked & (reached > 0), "VERIFIED").when(linked, "UNKNOWN").otherwise(F.col("state")).alias("location"),
        F.when(linked, reached).otherwise(F.lit(0)).alias("destinations"),
    )


def comment_state(comments: DataFrame, refs: DataFrame) -> DataFrame:
    """comment_id, state; refs: comment_id, media_path (null when it could not be resolved)."""
    per_comment = refs.groupBy("comment_id").agg(
        F.count("media_path").alias("resolved"), F.count("*").alias("refs")
    )
    return comments.join(per_comment, "comment_id", "left").select(
        "comment_id",
        F.when(F.col("resolved") > 0, "WITH_IMAGES").when(F.col("refs") > 0, "UNRESOLVED_IMAGE").otherwise("TEXT_ONLY").alias("state"),
    )


def comment_counts(states: DataFrame) -> DataFrame:
    """One row with the number of comments in each state."""
    return states.agg(
        F.count("*").alias("comments"),
        *[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("WITH_IMAGES", "UNRESOLVED_IMAGE", "TEXT_ONLY")],
    )
