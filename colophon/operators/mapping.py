"""From table columns to catalogue fields, and from records to entries with explicit states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from colophon.functions.text import normalize_header, strip
from colophon.sources.cells import SHEET

# The catalogue fields in order, with their labels and header aliases.
FIELDS = {
    "title": ("Title", ["タイトル", "書名", "ブック名", "作品名", "title", "book name"]),
    "circle": ("Circle", ["サークル", "社团", "社團", "circle"]),
    "artist": ("Artist", ["作者", "著者", "artist", "author", "writer"]),
    "identifier": ("Product ID", ["product id", "identifier", "品番", "作品番号", "型番", "sku", "id"]),
    "url": ("URL", ["url", "リンク", "link", "商品url"]),
    "price": ("Price", ["価格", "値段", "price", "金額"]),
    "description": ("Description", ["説明", "備考", "description", "コメント"]),
    "published": ("Publication date", ["発行", "発売", "出版", "日付", "年月", "date", "year", "release"]),
    "default_order": (
        "Default order", ["通し番号", "連番", "並び順", "serial number", "serial no", "default order", "sort order"],
    ),
    "tags": ("Tags", ["タグ", "ジャンル", "分類", "tags", "genre", "类型", "類型"]),
}
# Headers that win by containment before exact names are tried.
LEADING = {
    "title": ["タイトル", "書名", "ブック名", "作品名", "title", "book name"],
    "circle": ["サークル", "circle", "社团", "社團"],
    "artist": ["作者", "著者", "author", "writer"],
    "published": ["発行", "発売", "出版", "日付", "年月", "date", "year"],
    "tags": ["ジャンル", "genre", "分類", "类型", "類型"],
}
FIELD_NAMES = list(FIELDS)
REQUIRED = "title"


def _contains_any(name, aliases):
    return F.rlike(name, F.lit("|".join(aliases)))


def detect_mapping(columns: DataFrame) -> DataFrame:
    """SHEET, field, header: the header each field is recognised by; fields without one are absent."""
    raw, name = F.lower("name"), F.lower(strip(F.col("name")))
    claims = []
    for field, (_, aliases) in FIELDS.items():
        rule = F.when(name.isin(aliases), 1).when(_contains_any(name, aliases), 2)
        if field in LEADING:
            rule = F.when(_contains_any(raw, LEADING[field]), 0).otherwise(rule)
        claims.append(F.struct(F.lit(field).alias("field"), rule.alias("rule")))
    best = F.min(F.struct("claim.rule", "col", "name")).alias("best")
    return (
        columns.withColumn("claim", F.explode(F.array(*claims))).filter(F.col("claim.rule").isNotNull())
        .groupBy(*SHEET, F.col("claim.field").alias("field")).agg(best)
        .select(*SHEET, "field", F.col("best.name").alias("header"))
    )


def effective_profile(
    columns: DataFrame, edits: DataFrame | None = None, own: DataFrame | None = None, shared: DataFrame | None = None
) -> DataFrame:
    """SHEET, field, header, origin: a sheet's edit, else its profile entry, else the shared set, else detection.

    The first source with any row for a sheet is used as a whole. edits and own are keyed by workbook and
    sheet_key; shared by workbook alone.
    """
    sheets = columns.select(*SHEET).distinct()
    ranked = [detect_mapping(columns).withColumn("rank", F.lit(4)).withColumn("origin", F.lit("DETECTED"))]
    keyed = ["workbook", "sheet_key"]
    for df, keys, rank, origin in (
        (edits, keyed, 1, "EDIT"), (own, keyed, 2, "PROFILE_SHEET"), (shared, ["workbook"], 3, "PROFILE"),
    ):
        if df is not None:
            filled = df.filter(strip(F.col("header")) != "").select(*keys, "field", "header")
            ranked.append(
                sheets.join(filled, keys).select(*SHEET, "field", "header")
                .withColumn("rank", F.lit(rank)).withColumn("origin", F.lit(origin))
            )
    rows = ranked[0]
    for df in ranked[1:]:
        rows = rows.unionByName(df)
    winner = rows.groupBy(*SHEET).agg(F.min("rank").alias("rank"))
    return rows.join(winner, [*SHEET, "rank"]).drop("rank")


def resolve_mapping(columns: DataFrame, profile: DataFrame) -> DataFrame:
    """SHEET, field, header, outcome, col, matches; outcome RESOLVED, HEADER_MISSING or HEADER_AMBIGUOUS."""
    known = columns.withColumn("norm", normalize_header(F.col("name"))).groupBy(*SHEET, "norm").agg(
        F.count("*").alias("matches"), F.min("col").alias("only_col"), F.min("name").alias("only_name")
    )
    joined = profile.withColumn("norm", normalize_header(F.col("header"))).join(known, [*SHEET, "norm"], "left")
    single = F.col("matches") == 1
    return joined.select(
        *SHEET, "field", F.when(single, F.col("only_name")).otherwise(F.col("header")).alias("header"),
        F.when(F.col("matches").isNull(), "HEADER_MISSING").when(single, "RESOLVED").otherwise("HEADER_AMBIGUOUS").alias("outcome"),
        F.when(single, F.col("only_col")).alias("col"), F.coalesce("matches", F.lit(0)).alias("matches"),
    )


def mapping_issues(columns: DataFrame, mapping: DataFrame, profile: DataFrame) -> DataFrame:
    """SHEET, kind, field, header, issue_id for every mapping that cannot be used as it stands."""
    issue = lambda df, kind: df.select(*SHEET, kind.alias("kind"), "field", "header")
    unusable = issue(mapping.filter("outcome <> 'RESOLVED'"), F.col("outcome"))
    same_column = W.partitionBy(*SHEET, "col")
    shared = issue(
        mapping.filter("outcome = 'RESOLVED'").withColumn("users", F.count("*").over(same_column)).filter("users > 1"),
        F.lit("SHARED_HEADER"),
    )
    titled = mapping.filter((F.col("field") == REQUIRED) & (F.col("outcome") == "RESOLVED")).select(*SHEET)
    asked = profile.filter(F.col("field") == REQUIRED).select(*SHEET, "header")
    untitled = issue(
        columns.select(*SHEET).distinct().join(titled, SHEET, "left_anti").join(asked, SHEET, "left")
        .withColumn("field", F.lit(REQUIRED)),
        F.lit("REQUIRED_UNMAPPED"),
    )
    dash = lambda c: F.coalesce(c, F.lit("-"))
    issue_id = F.concat_ws(":", "kind", dash(F.col("sheet")), F.upper(dash(F.col("field"))), dash(F.col("header")))
    return unusable.unionByName(shared).unionByName(untitled).withColumn("issue_id", issue_id)


def build_entries(table: DataFrame, mapping: DataFrame) -> DataFrame:
    """id, SHEET, row and one struct<state,text,candidates> per catalogue field.

    The per-sheet part (which column, which state) is one row per sheet; the per-record part is one hash
    aggregate over the table's own cells.
    """
    states = mapping.groupBy(*SHEET).agg(*[
        F.first(F.when(F.col("field") == f, F.struct("outcome", "header")), ignorenulls=True).alias(f"m_{f}")
        for f in FIELD_NAMES
    ])
    targets = mapping.filter("outcome = 'RESOLVED'").groupBy(*SHEET, "col").agg(F.collect_set("field").alias("fields"))
    texts = (
        table.join(targets, [*SHEET, "col"], "left").groupBy(*SHEET, "row")
        .agg(*[
            F.max(F.when(F.array_contains("fields", f), strip(F.col("text")))).alias(f"t_{f}") for f in FIELD_NAMES
        ])
    )

    def value(f: str):
        outcome, text = F.col(f"m_{f}.outcome"), F.nullif(F.col(f"t_{f}"), F.lit(""))
        state = (
            F.when(outcome == "HEADER_AMBIGUOUS", "AMBIGUOUS")
            .when(outcome.isNull() | (outcome != "RESOLVED"), "UNMAPPED")
            .when(text.isNull(), "MISSING").otherwise("MAPPED")
        )
        candidates = F.when(outcome == "HEADER_AMBIGUOUS", F.array(F.col(f"m_{f}.header")))
        return F.struct(state.alias("state"), F.when(state == "MAPPED", text).alias("text"), candidates.alias("candidates")).alias(f)

    return texts.join(states, SHEET, "left").select(
        F.concat_ws("#", "sheet_key", "row").alias("id"), *SHEET, "row", *[value(f) for f in FIELD_NAMES]
    )


def attach_images(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds images, verified_cover, cover_path, unresolved_images from (workbook, sheet_key, row, media_path, state, detail).

    Images are told apart by path and detail. They are counted, not gathered: a record may be named by any
    number of notes, so the entry keeps the first cover and the counts.
    """
    distinct = hits.dropDuplicates(["workbook", "sheet_key", "row", "media_path", "detail"])
    verified = (F.col("state") == "LINKED") & F.col("media_path").isNotNull()
    per_record = distinct.groupBy("workbook", "sheet_key", "row").agg(
        F.count("*").alias("images"), F.count_if(verified).alias("verified_images"),
        F.min(F.when(verified, F.col("media_path"))).alias("cover_path"),
        F.count_if(F.col("state") == "UNRESOLVED").alias("unresolved_images"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return entries.join(per_record, ["workbook", "sheet_key", "row"], "left").select(
        *entries.columns, zero("images"), (F.coalesce("verified_images", F.lit(0)) > 0).alias("verified_cover"),
        "cover_path", zero("unresolved_images"),
    )


def mapping_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Assignments (workbook, sheet_key, field, header) in one mapping only; headers compare normalised."""
    norm = lambda df: df.select(
        "workbook", "sheet_key", "field", normalize_header(F.col("header")).alias("header")
    ).filter(F.col("header") != "")
    a, b = norm(left), norm(right)
    return a.exceptAll(b).withColumn("side", F.lit("LEFT")).unionByName(b.exceptAll(a).withColumn("side", F.lit("RIGHT")))


def scope(df: DataFrame, keys: list[str] | DataFrame | None) -> DataFrame:
    """Rows of the chosen sheets; an empty choice means all sheets."""
    if keys is None or (isinstance(keys, list) and not keys):
        return df
    if isinstance(keys, list):
        return df.filter(F.col("sheet_key").isin(keys))
    return df.join(keys.select("sheet_key").distinct(), "sheet_key", "left_semi")


def sheet_choices(sheets: DataFrame, entries: DataFrame) -> DataFrame:
    """Every sheet with its record count, sheets without records included."""
    counted = entries.groupBy("workbook", "sheet_key").agg(F.count("*").alias("records"))
    return sheets.join(counted, ["workbook", "sheet_key"], "left").select(
        *SHEET, F.coalesce("records", F.lit(0)).alias("records")
    )


def reconcile_scope(chosen: DataFrame, sheets: DataFrame) -> DataFrame:
    """Chosen keys that still exist."""
    return chosen.join(sheets.select("workbook", "sheet_key"), ["workbook", "sheet_key"], "left_semi")
