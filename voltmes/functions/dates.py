"""Month texts (``yyyy-MM``), their parts, and seasons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Meteorological seasons of the southern hemisphere by month.
SEASONS = {
    "Verão": (12, 1, 2),
    "Outono": (3, 4, 5),
    "Inverno": (6, 7, 8),
    "Primavera": (9, 10, 11),
}


def month_text(date: Column) -> Column:
    """``yyyy-MM`` of a date or timestamp, without a formatter per row."""
    return F.substring(date.cast("date").cast("string"), 1, 7)


def year_of(month_text: Column) -> Column:
    return F.substring(month_text, 1, 4).try_cast("int")


def month_of(month_text: Column) -> Column:
    return F.substring(month_text, 6, 2).try_cast("int")


def first_day(month_text: Column) -> Column:
    """Date of the month's first day, null for text that names no month."""
    return F.try_to_date(F.concat(month_text, F.lit("-01")), "yyyy-MM-dd")


def distinct_days(date: Column) -> Column:
    """Number of different days among dates of one month, as an aggregate of 31 bits instead of a distinct count."""
    return F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.day(date) - 1)))


def season_of(month_number: Column) -> Column:
    season = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        season = F.when(month_number.isin(*months), name).otherwise(season)
    return season
