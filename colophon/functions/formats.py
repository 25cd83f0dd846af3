"""Number formats: what kind of value a format code shows, and the shown text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colophon.functions.text import bind, strip

# Kinds of the built-in format ids.
BUILTIN_KINDS = {
    "PERCENT": [9, 10],
    "DATE": [14, 15, 16, 17],
    "TIME": [18, 19, 20, 21, 32, 33, 34, 35, 36, 45, 46, 47, 55, 56, 57, 58],
    "DATE_TIME": [22, 27, 28, 29, 30, 31, 50, 51, 52, 53, 54],
    "NUMBER": [2, 4, 39, 40, 41, 42, 43, 44],
}

CYCLE_DAYS, MAX_YEAR = 146_097, 999_999_999  # days of 400 years; the last year of the reference's calendar

# Quoted text, escaped characters, brackets and later sections; elapsed-time brackets keep their letters.
LITERALS = r'"[^"]*(?:"|$)|[\\_*][\s\S]?|\[([hmsHMS]+)\]|\[[^\]]*(?:\]|$)|;[\s\S]*$'


def classify_code(code: Column) -> Column:
    """Kind of a custom format code by the tokens of its first section."""
    head = F.substring_index(code, ";", 1)
    section = F.when(head == "", code).otherwise(head)
    text = F.lower(F.regexp_replace(section, LITERALS, "$1"))
    return bind(text, lambda t: bind(F.regexp_replace(t, "am/pm|a/p", ""), lambda k: _kind(t, k)))


def _kind(text: Column, tokens: Column) -> Column:
    has = lambda c, p: F.rlike(c, F.lit(p))
    mantissa = F.substring_index(tokens, "e", 1)
    return (
        F.when(text == "", F.lit("GENERAL"))
        .when(has(text, "%"), F.lit("PERCENT"))
        .when(has(text, "[yd]") & has(tokens, "[hs]"), F.lit("DATE_TIME"))
        .when(has(text, "[yd]"), F.lit("DATE"))
        .when(has(tokens, "[hs]"), F.lit("TIME"))
        .when(has(tokens, "m"), F.lit("DATE"))
        .when(has(mantissa, r"^[^.]*\.[0#?]"), F.lit("NUMBER"))
        .otherwise(F.lit("GENERAL"))
    )


def classify_format(format_id: Column, code: Column) -> Column:
    """Custom code first, then the built-in id, else GENERAL."""

    def kind(declared: Column) -> Column:
        found = F.when(declared != "", classify_code(declared))
        for name, ids in BUILTIN_KINDS.items():
            found = found.when(format_id.isin(ids), F.lit(name))
        return found.otherwise(F.lit("GENERAL"))

    return bind(strip(code), kind)


def short_decimal(value: Column) -> Column:
    """At most two decimals, trailing zeros dropped, no negative zero."""
    trimmed = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    return bind(trimmed, lambda t: F.when(F.rlike(t, F.lit(r"^-?0?$")), F.lit("0")).otherwise(t))


def _date_text(days: Column, date1904: Column) -> Column:
    """The calendar repeats every 400 years, so a serial of any size is a date; years have four digits or more."""

    def from_epoch(epoch: str) -> Column:
        date = F.date_add(F.to_date(F.lit(epoch)), (days % CYCLE_DAYS).cast("int"))
        year = F.year(date) + F.lit(400) * F.floor(days / CYCLE_DAYS)
        return F.when(year <= MAX_YEAR, F.format_string("%04d-%02d-%02d", year, F.month(date), F.day(date)))

    return F.when(date1904, F.when(days >= 0, from_epoch("1904-01-01"))).when(days >= 61, from_epoch("1899-12-30")).when(
        days.between(1, 59), from_epoch("1899-12-31")
    )


def _time_text(seconds: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    parts = F.array_compact(F.array(
        two(F.floor(seconds / 3600)), two(F.floor(seconds % 3600 / 60)), F.when(seconds % 60 > 0, two(seconds % 60))
    ))
    return F.when(seconds > 0, F.array_join(parts, ":"))


def display_value(kind: Column, raw: Column, numeric: Column, date1904: Column | bool = False) -> Column:
    """Text a spreadsheet would show for a numeric cell; other cells keep their text."""
    flag = date1904 if isinstance(date1904, Column) else F.lit(date1904)
    clock = lambda v: F.struct(
        F.floor(v).alias("day"), F.round((v - F.floor(v)) * 86_400).cast("long").alias("second")
    )
    carried = lambda t: F.struct(
        (t["day"] + F.when(t["second"] >= 86_400, 1).otherwise(0)).alias("day"), (t["second"] % 86_400).alias("second")
    )
    texts = lambda t: F.struct(
        _date_text(t["day"], flag).alias("date"), _time_text(t["second"]).alias("time"), (t["second"] == 0).alias("sharp")
    )

    def moment(v: Column) -> Column:
        return bind(bind(bind(clock(v), carried), texts), lambda t: F.when(kind == "DATE", t["date"]).when(
            t["date"].isNull() & t["sharp"], F.lit(None).cast("string")
        ).when(kind == "TIME", F.coalesce(t["time"], F.lit("00:00"))).otherwise(F.concat_ws(" ", t["date"], t["time"])))

    shown = bind(strip(raw).try_cast("double"), lambda v: F.when(
        v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None).cast("string")
    ).when(kind == "PERCENT", F.concat(short_decimal(v * 100), F.lit("%"))).when(kind == "NUMBER", short_decimal(v)).otherwise(moment(v)))
    formatted = numeric & kind.isin("DATE", "TIME", "DATE_TIME", "PERCENT", "NUMBER")
    return F.coalesce(F.when(formatted, shown), raw)
