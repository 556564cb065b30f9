"""Scalar expressions used to normalise listed items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of stored results.
KEY_SEPARATOR = "::"
FINGERPRINT_LENGTH = 16
PLACE_SEPARATOR = ", "


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def non_empty(*values: Column) -> Column:
    """The first value that is neither null nor empty, else an empty string."""
    return F.coalesce(*[F.nullif(value, F.lit("")) for value in values], F.lit(""))


def unique_key(company: Column, ats_job_id: Column) -> Column:
    return F.concat(company, F.lit(KEY_SEPARATOR), or_empty(ats_job_id))


def id_text(value: Column) -> Column:
    return or_empty(value.cast("string"))


def first_or_default(array: Column, field: str | None = None) -> Column:
    """First element (or a field of it) of a possibly empty or null array, else ``''``."""
    first = F.get(array, F.lit(0))
    return or_empty(first[field] if field else first)


def place(city: Column, country: Column) -> Column:
    """``city, country`` with commas and spaces removed from both ends."""
    joined = F.concat(or_empty(city), F.lit(PLACE_SEPARATOR), or_empty(country))
    return F.btrim(joined, F.lit(PLACE_SEPARATOR))


def site_url(base: Column, site: Column, path: Column) -> Column:
    return F.concat(base, F.lit("/"), site, or_empty(path))


def lenient_date(text: Column) -> Column:
    """The first ten characters as an ISO 8601 date, else null.

    Calendar and week dates may be written with or without dashes, a week date also
    without its day.  A full form without dashes has eight characters; where ten are
    given, the last two (the start of a time) do not matter.  Patterns guard the casts,
    because a cast alone also takes shortened forms.
    """
    head = F.substring(text, 1, 10)
    dashed = F.when(head.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), head)
    compact = F.when(
        head.rlike(r"(?s)\A\d{8}(..)?\z"),
        F.concat_ws("-", head.substr(1, 4), head.substr(5, 2), head.substr(7, 2)),
    )
    calendar = F.coalesce(dashed, compact)
    # Year 0 exists for Spark but not for ISO date readers.
    valid = F.when(calendar >= F.lit("0001"), calendar).try_cast("date")
    return F.coalesce(valid, _week_date(head))


def _week_date(head: Column) -> Column:
    is_week = head.rlike(r"(?s)\A\d{4}(-W\d{2}(-[1-7])?|W\d{2}|W\d{2}[1-7](..)?)\z")
    bare = F.when(is_week & (head >= F.lit("0001")), F.replace(head, F.lit("-"), F.lit("")))
    week = bare.substr(6, 2).cast("int")
    day = F.coalesce(F.nullif(bare.substr(8, 1), F.lit("")).cast("int"), F.lit(1))
    # Week 1 is the week of 4 January.
    monday = F.trunc(F.concat(bare.substr(1, 4), F.lit("-01-04")).cast("date"), "week")
    result = F.date_add(monday, (week - 1) * 7 + day - 1)
    # Week 53 is only valid in years that have one, no year has week 0, and no date
    # lies beyond year 9999.
    return F.when((F.weekofyear(result) == week) & (F.year(result) <= 9999), result)


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, FINGERPRINT_LENGTH)


def combined_score(fit: Column, desirability: Column) -> Column:
    return fit + desirability


def encode_detail(value: Column) -> Column:
    return F.to_json(value)


def decode_detail(text: Column) -> Column:
    """Stored JSON as a variant; empty or unreadable text is an empty object."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}")))
