"""Collection figures, duplicates and what each provider answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colophon.functions.dates import parse_partial_date
from colophon.functions.text import blank_to_null, split_tags, strip
from colophon.operators.facets import location_label
from colophon.operators.mapping import FIELD_NAMES

TOP_VALUES = 50  # fixed values: length of a top list, locations named per duplicate group
NAMED_LOCATIONS = 5


def collection_summary(entries: DataFrame) -> DataFrame:
    """One row: records, sheets, covers, and the blank and mapped cells of every field."""
    per_field = []
    for f in FIELD_NAMES:
        state = F.col(f"{f}.state")
        per_field += [
            F.count_if(state == "MISSING").alias(f"missing_{f}"),
            F.coalesce(F.bool_or(state.isin("MAPPED", "MISSING")), F.lit(False)).alias(f"mapped_{f}"),
        ]
    return entries.agg(
        F.count("*").alias("records"), F.count_distinct("workbook", "sheet_key").alias("sheets"),
        F.count_if("verified_cover").alias("with_cover"), F.count_if(~F.col("verified_cover")).alias("without_cover"),
        *per_field,
    )


def _top(values: DataFrame, n: int) -> DataFrame:
    return values.groupBy("value").agg(F.count("*").alias("records")).orderBy(
        F.desc("records"), F.lower("value"), "value"
    ).limit(n)


def top_values(entries: DataFrame, field: str, n: int = TOP_VALUES) -> DataFrame:
    """value, records: the most frequent texts of a field."""
    value = blank_to_null(F.col(f"{field}.text"))
    return _top(entries.select(value.alias("value")).filter("value IS NOT NULL"), n)


def tag_counts(entries: DataFrame, n: int = TOP_VALUES) -> DataFrame:
    """value, records: the most frequent tags."""
    return _top(entries.select(F.explode(split_tags(F.col("tags.text"))).alias("value")), n)


def year_histogram(entries: DataFrame, date1904: bool = False) -> DataFrame:
    """year, records; the row with a null year counts filled dates that cannot be read."""
    raw = blank_to_null(F.col("published.text"))
    year = parse_partial_date(raw, True, date1904)["year"]
    return entries.filter(raw.isNotNull()).groupBy(year.alias("year")).agg(F.count("*").alias("records"))


def _groups(entries: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Groups of more than one record with the first five places, in sheet and row order.

    Counting is a map-side combined aggregate; only the first five rows of a group ever meet.
    """
    names = list(keys)
    keyed = entries.select(*[c.alias(n) for n, c in keys.items()], "sheet", "row", location_label().alias("place"))
    sizes = keyed.groupBy(*names).agg(F.count("*").alias("records")).filter("records > 1")
    first = W.partitionBy(*names).orderBy("sheet", "row")
    named = (
        keyed.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= NAMED_LOCATIONS)
        .groupBy(*names).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("n", "place"))), lambda s: s["place"]), ", ").alias("places"),
            F.min_by("sheet", "n").alias("sheet"))
    )
    return sizes.join(named, names)


def duplicate_identifiers(entries: DataFrame) -> DataFrame:
    """identifier, records, places, sheet of every identifier on more than one record."""
    key = F.lower(blank_to_null(F.col("identifier.text")))
    return _groups(entries.filter(key.isNotNull()), {"identifier": key})


def possible_duplicates(entries: DataFrame) -> DataFrame:
    """title, circle, artist, records, places, sheet of records that agree in all three; blanks count as a value."""
    folded = lambda f: F.coalesce(F.lower(strip(F.col(f"{f}.text"))), F.lit(""))
    titled = entries.filter(folded("title") != "")
    return _groups(titled, {f: folded(f) for f in ("title", "circle", "artist")})


def duplicate_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))


def provider_rollup(providers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What each provider answered; providers that stayed silent keep a row.

    outcomes: provider, outcome FOUND|EMPTY|FAILED, failure, results, available. A timeout is counted apart
    from an empty answer and from other failures.
    """
    outcome, failure = F.col("outcome"), F.coalesce("failure", F.lit(""))
    state = (
        F.when(outcome == "FOUND", "RESULTS").when(outcome == "EMPTY", "EMPTY")
        .when(failure == "BLOCKED", "BLOCKED").otherwise("FAILED")
    )
    per = outcomes.withColumn("state", state).groupBy("provider").agg(
        F.count("*").alias("searches"),
        *[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("RESULTS", "EMPTY", "BLOCKED", "FAILED")],
        F.count_if(failure == "TIMEOUT").alias("timeouts"),
        F.sum(F.when(outcome == "FOUND", F.col("results")).otherwise(0)).alias("returned"),
        F.sum(F.when(outcome == "FOUND", F.col("available"))).alias("available"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in (
        "searches", "results", "empty", "blocked", "failed", "timeouts", "returned")]
    return providers.select("provider").join(per, "provider", "left").select(
        "provider", *zero, "available",
        (F.coalesce("results", F.lit(0)) + F.coalesce("empty", F.lit(0)) > 0).alias("answered"),
    )
