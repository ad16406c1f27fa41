"""Dates as listings print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingweave.functions.text import strip_tags

# The formats tried on a whole cell, in order, with their shapes, and the shapes searched for in longer texts.
FORMATS = {
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{3,9} \d{4}$", "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d MMM yyyy H:m:s": r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d MMM yyyy H:m": r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{1,2}$",
}
SHAPES = r"\d{4}-\d{2}-\d{2}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}|\d{1,2}[/-][A-Za-z]{3,9}[/-]\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{4}"


def _parsed(x: Column) -> Column:
    # the shape is tested first: a failed parse costs a hundred times more than a failed match
    return F.coalesce(*(F.when(x.rlike(shape), F.date_format(F.try_to_timestamp(x, F.lit(f)), "yyyy-MM-dd")) for f, shape in FORMATS.items()))


def normalise_date(x: Column | str) -> Column:
    """ISO date of a cell, or null. What stands before a '|' counts; a date anywhere in it is found; an ISO-shaped
    run inside a longer text is taken as it is."""
    return date_in(shown_date(x))


def shown_date(x: Column | str) -> Column:
    """What a date cell shows before a '|'."""
    return F.trim(F.substring_index(strip_tags(x), "|", 1))


def date_in(text: Column) -> Column:
    """The same as `normalise_date` of a text without markup."""
    runs = F.regexp_extract_all(text, F.lit(SHAPES), 0)
    read = F.filter(F.transform(runs, lambda r: F.when(r.rlike(r"^\d{4}-\d{2}-\d{2}$"), r).otherwise(_parsed(r))), lambda r: r.isNotNull())
    return F.coalesce(_parsed(text), F.get(read, F.lit(0)))


def boundary(text: str) -> Column:
    """A boundary date as listings print dates, as an ISO date; where it can't be read, the query that uses it fails
    instead of keeping or dropping everything."""
    day = normalise_date(F.lit(text))
    return F.coalesce(day, F.raise_error(F.lit(f"no date: {text}")))


def since_filter(day: Column, start: Column | str) -> Column:
    """Rows from a boundary date (ISO, see `boundary`) on; rows without a date pass."""
    return day.isNull() | (day >= (F.lit(start) if isinstance(start, str) else start))


def utc_stamp(at: Column | str) -> Column:
    """A time as UTC text in seconds, `2024-01-31T09:00:00Z`; the session's time zone is UTC."""
    return F.date_format(F.col(at) if isinstance(at, str) else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def period_index(year: Column | str, quarter: Column | str) -> Column:
    """Quarters as consecutive numbers; null unless the quarter is Q1 to Q4 and the year a number."""
    q = F.col(quarter) if isinstance(quarter, str) else quarter
    y = F.col(year) if isinstance(year, str) else year
    return F.when(q.rlike("^Q[1-4]$"), y.try_cast("int") * 4 + F.substring(q, 2, 1).try_cast("int") - 1)
