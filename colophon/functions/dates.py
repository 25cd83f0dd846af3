"""Partial dates: a year, a month or a day, kept at the precision that was written."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colophon.functions.text import bind, strip

# Accepted spellings and bounds.
DATE_PATTERN = r"^(\d{4})(?:\s*年?|\s*[-/.年]\s*(\d{1,2})(?:\s*月?|\s*[-/.月]\s*(\d{1,2})\s*日?))$"
SERIAL_PATTERN = r"^(\d{5,7})(\.\d+)?$"
MIN_YEAR, MAX_YEAR = 1900, 2100
MIN_SERIAL, MAX_SERIAL = 10_000, 2_958_465
EPOCH_1900, EPOCH_1904 = "1899-12-30", "1904-01-01"


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """Struct of year, month?, day? with the integer order key and the ISO label."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.struct(
        year.cast("int").alias("year"),
        month.cast("int").alias("month"),
        day.cast("int").alias("day"),
        (year * 10_000 + F.coalesce(month, F.lit(0)) * 100 + F.coalesce(day, F.lit(0))).cast("int").alias("sort_key"),
        F.concat_ws("-", year.cast("string"), two(month), two(day)).alias("label"),
    )


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _flag(value: bool | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _serial(days: Column, date1904: bool | Column) -> Column:
    base = F.when(_flag(date1904), F.to_date(F.lit(EPOCH_1904))).otherwise(F.to_date(F.lit(EPOCH_1900)))
    date = F.when(days.between(MIN_SERIAL, MAX_SERIAL), F.date_add(base, days))
    return bind(date, lambda d: F.when(
        F.year(d).between(MIN_YEAR, MAX_YEAR), partial_date(F.year(d), F.month(d), F.day(d))
    ))


def parse_serial_date(c: Column, date1904: bool | Column = False) -> Column:
    """Spreadsheet day number as a date; null outside the accepted window."""
    return bind(_part(strip(c), SERIAL_PATTERN, 1), lambda days: _serial(days, date1904))


def parse_partial_date(c: Column, serial: bool | Column = False, date1904: bool | Column = False) -> Column:
    """Year, year-month or full date; anything that would need a guess is null.

    One pattern takes the text apart; only what it does not fit is tried as a serial number.
    """
    fits = lambda t: F.rlike(t, F.lit(DATE_PATTERN))
    parts = lambda t: F.struct(
        F.when(fits(t), F.split(F.regexp_replace(t, DATE_PATTERN, "$1/$2/$3"), "/")).alias("ymd"), t.alias("text")
    )
    numbers = lambda p: F.struct(
        *[p["ymd"][n].try_cast("int").alias(name) for n, name in enumerate(("year", "month", "day"))], p["text"].alias("text")
    )

    def read(p: Column) -> Column:
        in_years, in_months = p["year"].between(MIN_YEAR, MAX_YEAR), p["month"].between(1, 12)
        start = F.when(in_months, F.make_date(p["year"], p["month"], F.lit(1)))
        real = in_years & (p["month"].isNull() | in_months) & (
            p["day"].isNull() | p["day"].between(1, F.day(F.last_day(start)))
        )
        date = F.when(real, partial_date(p["year"], p["month"], p["day"]))
        days = F.when(_flag(serial), _part(p["text"], SERIAL_PATTERN, 1))
        return F.when(p["year"].isNotNull(), date).otherwise(bind(days, lambda d: _serial(d, date1904)))

    return bind(bind(bind(strip(c), parts), numbers), read)


def date_is_malformed(c: Column, serial: bool | Column = False, date1904: bool | Column = False) -> Column:
    """Something is written, but it is not a readable date."""
    filled = F.coalesce(strip(c) != "", F.lit(False))
    return filled & parse_partial_date(c, serial, date1904).isNull()
