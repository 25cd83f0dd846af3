"""Text columns: width folding, normal forms, similarity and sort keys.

All of it stays in JVM expressions except :func:`nfkc`, which has no built-in counterpart.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The printable full-width block maps on ASCII by a constant offset.
_WIDE = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = " " + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))

EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(c: Column) -> Column:
    """Trim every kind of Unicode space, not only U+0020."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    """Stripped text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def normalize_header(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"\s+", " ")


def fold_width(c: Column) -> Column:
    return F.translate(c, _WIDE, _NARROW)


def normalize_code(c: Column) -> Column:
    return F.regexp_replace(F.upper(fold_width(c)), r"[\s\-_]", "")


def normalize_text(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(fold_width(c)), r"[^\p{L}\p{Nd} #+&]", " "))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility folding; null stays null."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def first_of(items: Column, most: int | None) -> Column:
    """The first ``most`` elements; None keeps all."""
    return items if most is None else F.slice(items, 1, most)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda it is a variable, not an expression."""
    return F.transform(F.array(value), body)[0]


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams in one pass; empty array when the text is shorter than n."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def similarity_of_normal(a: Column, b: Column, grams_a: Column, grams_b: Column) -> Column:
    """Similarity of two already normalised texts whose bigram sets are at hand."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = F.when(F.length(a) <= F.length(b), F.contains(b, a)).otherwise(F.contains(a, b))
    sizes = F.size(grams_a) + F.size(grams_b)
    dice = 2.0 * F.size(F.array_intersect(grams_a, grams_b)) / sizes
    return (
        F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when((shorter >= 3) & inside, 0.68 + 0.22 * (shorter / longer))
        .when((F.size(grams_a) == 0) | (F.size(grams_b) == 0), F.lit(0.0))
        .otherwise(dice)
    )


def text_similarity(a: Column, b: Column) -> Column:
    """0..1 similarity of two raw texts: equality, containment, else Dice over bigram sets."""
    normal = F.struct(normalize_text(a).alias("x"), normalize_text(b).alias("y"))
    with_grams = lambda v: F.struct(
        v["x"].alias("x"), v["y"].alias("y"), grams(v["x"], 2).alias("gx"), grams(v["y"], 2).alias("gy")
    )
    return bind(bind(normal, with_grams), lambda v: similarity_of_normal(v["x"], v["y"], v["gx"], v["gy"]))


def contains_ci(c: Column, needle: str) -> Column:
    """Case-insensitive contains; a null value never matches."""
    return F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))


def natural_sort_key(c: Column) -> Column:
    """Key whose byte order is the natural order of names.

    A digit run becomes its length (after leading zeros go) in three digits, then the digits, so the
    longer number sorts later; other characters are lower-cased. Break ties with the raw text.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D)"), 1)
    zero_free = lambda r: F.regexp_replace(r, r"^0+(?=\d)", "")
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.when(
                F.rlike(r, F.lit(r"^\d")),
                F.concat(F.lit("0"), F.lpad(F.length(zero_free(r)).cast("string"), 3, "0"), zero_free(r)),
            ).otherwise(r),
        ),
        "",
    )


def default_order_key(c: Column) -> Column:
    """Sortable struct: numbers, then text without case, then blanks.

    Numbers beyond decimal(38,18) fall back to their double value inside the same group.
    """
    pattern = F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return bind(blank_to_null(c), lambda t: F.struct(
        F.when(t.isNull(), 2).when(F.rlike(t, pattern), 0).otherwise(1).alias("kind"),
        F.when(F.rlike(t, pattern), t.try_cast("double")).alias("approx"),
        F.when(F.rlike(t, pattern), t.try_cast("decimal(38,18)")).alias("exact"),
        F.when(~F.rlike(t, pattern), F.lower(t)).alias("folded"),
    ))


def split_tags(c: Column) -> Column:
    """Stripped, non-empty tags of a separated list."""
    return F.filter(F.transform(F.split(c, "[,、;；]"), strip), lambda t: t != "")
