"""Dates from mixed spellings, and how an article's date lies to a report's year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings tried in this order.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy", "d MMMM yyyy", "MMMM d, yyyy")


def iso_date(c: Column) -> Column:
    """ISO date of a text in one of FORMATS, of the first year-month-day in it, else its first year, else its first ten characters."""
    text = F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("/"), F.lit("-"))
    tried = [F.try_to_timestamp(F.substring(text, 1, 19), F.lit(f)).cast("date") for f in FORMATS]
    parts = [F.regexp_extract(text, r"((?:20|19)\d{2})[-_/. ]([01]?\d)[-_/. ]([0-3]?\d)", i) for i in (1, 2, 3)]
    loose = F.try_to_timestamp(F.concat_ws("-", *parts), F.lit("yyyy-M-d")).cast("date")
    year = F.regexp_extract(text, r"((?:20|19)\d{2})", 1)
    return F.coalesce(F.date_format(F.coalesce(*tried, loose), "yyyy-MM-dd"), F.when(year != "", year), F.substring(text, 1, 10))


def year_of(c: Column) -> Column:
    """The four digits that a text starts with, or empty."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{4})", 1)


def time_alignment(report_year: Column, published: Column) -> Column:
    """pre_mda, same_period (the report's year), post_mda (until next June), outside_window, or unknown."""
    y = report_year.cast("int")
    same_year, next_year = F.year(published) == y, F.year(published) == y + 1
    return F.when(y.isNull() | published.isNull(), "unknown").when(F.year(published) < y, "pre_mda").when(same_year, "same_period").when(next_year & (F.month(published) <= 6), "post_mda").otherwise("outside_window")
