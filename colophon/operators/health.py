"""Data-health findings: structure, records, images and consistency.

A finding is (id, category, severity, sheet, record_id, row, field, n, evidence). Every part is a filter or an
aggregate; the caps of the report are ordered limits plus a count of what they leave out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from colophon.functions.dates import date_is_malformed
from colophon.functions.urls import valid_url
from colophon.operators.analytics import duplicate_identifiers, possible_duplicates
from colophon.operators.facets import OPTIONAL
from colophon.operators.mapping import FIELD_NAMES

# How many findings of a kind are listed one by one.
MAX_MISSING, MAX_UNREFERENCED, MAX_DIAGNOSTICS = 400, 200, 20
CATEGORIES = ["STRUCTURE", "RECORDS", "IMAGES", "CONSISTENCY"]
SEVERITIES = ["ERROR", "WARNING", "INFO"]


def _finding(
    df: DataFrame, id_: Column, category: str, severity: str | Column, *, sheet: Column | None = None,
    record: Column | None = None, row: Column | None = None, field: Column | str | None = None,
    n: Column | None = None, evidence: Column | None = None,
) -> DataFrame:
    text = F.lit(None).cast("string")
    pick = lambda c: text if c is None else (F.lit(c) if isinstance(c, str) else c)
    return df.select(
        id_.alias("id"), F.lit(category).alias("category"), pick(severity).alias("severity"), pick(sheet).alias("sheet"),
        pick(record).alias("record_id"), (F.lit(None) if row is None else row).cast("int").alias("row"),
        pick(field).alias("field"), (F.lit(1) if n is None else n).cast("long").alias("n"), pick(evidence).alias("evidence"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _rest(df: DataFrame, cap: int, id_: str, category: str) -> DataFrame:
    """One INFO row telling how many findings the cap leaves out."""
    extra = df.agg((F.count("*") - cap).alias("extra")).filter("extra > 0")
    return _finding(extra, F.lit(id_), category, "INFO", n=F.col("extra"))


def health_structure(
    unreadable: DataFrame, truncations: DataFrame, tables: DataFrame, diagnostics: DataFrame | None = None,
    scan_truncated: bool = False, whole_scope: bool = True, listed: int = MAX_DIAGNOSTICS,
) -> DataFrame:
    """unreadable: sheet; truncations: table_truncation; tables: sheet; diagnostics: pos, level, part, message.

    The first ``listed`` warnings are findings of their own, the rest is counted. Findings about the package as a whole are
    only reported when no sheet selection is active.
    """
    parts = [
        _finding(unreadable, F.concat(F.lit("structure:unreadable:"), "sheet"), "STRUCTURE", "ERROR", sheet=F.col("sheet")),
        _finding(
            truncations, F.concat(F.lit("structure:blank-row:"), "sheet"), "STRUCTURE", "WARNING", sheet=F.col("sheet"),
            row=F.col("blank_row"), n=F.col("skipped_rows"), evidence=F.col("first_skipped_row").cast("string"),
        ),
        _finding(
            tables.agg(F.count("*").alias("tables")).filter("tables = 0"), F.lit("structure:no-table"), "STRUCTURE", "INFO"
        ),
    ]
    if whole_scope and scan_truncated:
        one = tables.agg(F.count("*").alias("tables"))
        parts.append(_finding(one, F.lit("structure:truncated"), "STRUCTURE", "WARNING"))
    if whole_scope and diagnostics is not None:
        warnings = diagnostics.filter("level = 'WARNING'")
        parts.append(_finding(
            warnings.orderBy("pos").limit(listed), F.concat(F.lit("structure:diagnostic:"), F.col("pos").cast("string")), "STRUCTURE", "WARNING",
            field=F.col("part"), evidence=F.col("message"),
        ))
        parts.append(_rest(warnings, listed, "structure:diagnostic:more", "STRUCTURE"))
    return _union(parts)


def missing_fields(entries: DataFrame) -> DataFrame:
    """id, sheet, row, field, ord: every blank optional cell."""
    blanks = F.filter(
        F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("ord"), F.col(f"{f}.state").alias("state"))
                  for i, f in enumerate(FIELD_NAMES) if f in OPTIONAL]),
        lambda s: s["state"] == "MISSING",
    )
    return entries.select("id", "sheet", "row", F.explode(blanks).alias("m")).select("id", "sheet", "row", "m.field", "m.ord")


def health_records(entries: DataFrame, date1904: bool = False, cap: int = MAX_MISSING) -> DataFrame:
    """Titles that identify nothing, blank optional cells, and unreadable URLs, dates and prices."""
    place = {"sheet": F.col("sheet"), "record": F.col("id"), "row": F.col("row")}
    ident = lambda kind: F.concat(kind if isinstance(kind, Column) else F.lit(kind), F.lit(":"), "id")
    state = F.col("title.state")
    kind = (
        F.when(state == "MISSING", "record:title-empty").when(state == "UNMAPPED", "record:title-unmapped")
        .when(state == "AMBIGUOUS", "record:title-ambiguous")
    )
    url, date, price = (F.col(f"{f}.text") for f in ("url", "published", "price"))
    text = F.lit(None).cast("string")
    found = lambda of, kind, severity, field, evidence=text: F.when(of, F.struct(
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), F.lit(severity).alias("severity"),
        F.lit(field).alias("field"), evidence.alias("evidence"),
    ))
    each = F.array_compact(F.array(  # all that is wrong with one record, in one pass
        found(kind.isNotNull(), kind, "ERROR", "title"),
        found(url.isNotNull() & ~valid_url(url), "record:url", "WARNING", "url", url),
        found(date_is_malformed(date, True, date1904), "record:date", "WARNING", "published", date),
        found(price.isNotNull() & ~F.rlike(price, F.lit(r"\p{Nd}")), "record:price", "WARNING", "price", price),
    ))
    single = entries.select("id", "sheet", "row", F.explode(each).alias("f"))
    missing = missing_fields(entries)
    listed = _finding(
        missing.orderBy("sheet", "row", "id", "ord").limit(cap),
        ident(F.concat(F.lit("record:missing:"), F.upper("field"))), "RECORDS", "INFO", field=F.col("field"), **place,
    )
    return _union([
        _finding(single, ident(F.col("f.kind")), "RECORDS", F.col("f.severity"), field=F.col("f.field"), evidence=F.col("f.evidence"), **place),
        listed, _rest(missing, cap, "record:missing:more", "RECORDS"),
    ])


def health_images(entries: DataFrame, images: DataFrame, whole_scope: bool = True, cap: int = MAX_UNREFERENCED) -> DataFrame:
    """Failed references, files no note points at, and records without a cover per sheet."""
    unresolved = images.filter("state = 'UNRESOLVED'")
    bare = entries.filter(~F.col("verified_cover")).groupBy("sheet").agg(F.count("*").alias("n"))
    parts = [
        _finding(
            unresolved, F.concat(F.lit("image:unresolved:"), "key"), "IMAGES", "WARNING", sheet=F.col("sheet"),
            evidence=F.col("detail"),
        ),
        _finding(bare, F.concat(F.lit("image:no-cover:"), "sheet"), "IMAGES", "INFO", sheet=F.col("sheet"), n=F.col("n")),
    ]
    if whole_scope:
        loose = images.filter("state = 'UNREFERENCED'")
        parts.append(_finding(
            loose.orderBy("key").limit(cap), F.concat(F.lit("image:unreferenced:"), "key"), "IMAGES", "INFO",
            evidence=F.col("media_path"),
        ))
        parts.append(_rest(loose, cap, "image:unreferenced:more", "IMAGES"))
    return _union(parts)


def health_duplicates(entries: DataFrame) -> DataFrame:
    """Repeated identifiers and records that agree in title, circle and artist."""
    same_id, same_text = duplicate_identifiers(entries), possible_duplicates(entries)
    more = F.when(F.col("records") > 5, F.concat("places", F.lit("…"))).otherwise(F.col("places"))
    shared = {"sheet": F.col("sheet"), "n": F.col("records"), "evidence": more}
    return _union([
        _finding(same_id, F.concat(F.lit("consistency:duplicate-id:"), "identifier"), "CONSISTENCY", "WARNING", **shared),
        _finding(
            same_text, F.concat(F.lit("consistency:possible-duplicate:"), F.concat_ws("|", "title", "circle", "artist")),
            "CONSISTENCY", "INFO", **shared,
        ),
    ])


def health_mapping(issues: DataFrame) -> DataFrame:
    """One finding per mapping issue."""
    severity = F.when(F.col("kind") == "REQUIRED_UNMAPPED", "ERROR").otherwise("WARNING")
    return _finding(
        issues.dropDuplicates(["issue_id"]), F.concat(F.lit("consistency:mapping:"), "issue_id"), "CONSISTENCY", severity,
        sheet=F.col("sheet"), field=F.col("field"), evidence=F.col("header"),
    )


def _position(names: list[str], c: str) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))


def health_report(
    parts: list[DataFrame], severities: list[str] | None = None, categories: list[str] | None = None
) -> DataFrame:
    """All findings once per id, by severity, category and id; optionally only some of them."""
    out = _union(parts).dropDuplicates(["id"])
    if severities:
        out = out.filter(F.col("severity").isin(severities))
    if categories:
        out = out.filter(F.col("category").isin(categories))
    return out.orderBy(_position(SEVERITIES, "severity"), _position(CATEGORIES, "category"), "id")


def health_summary(findings: DataFrame) -> DataFrame:
    """One row of counts by severity and category."""
    return findings.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == s).alias(f"{s.lower()}s") for s in SEVERITIES],
        *[F.count_if(F.col("category") == c).alias(c.lower()) for c in CATEGORIES],
    )
