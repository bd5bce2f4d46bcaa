"""Values as text for people: money, dates in UTC, shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE, DATE_TIME = "dd MMM yyyy", "dd MMM yyyy, HH:mm"
UNKNOWN = "\u2014"


def money(amount_minor: Column, currency: Column) -> Column:
    """Rupees with their sign and Indian grouping (the last three digits, then twos); other currencies as code and plain number."""
    whole, cents = ((amount_minor - amount_minor % 100) / 100).cast("long"), F.lpad((amount_minor % 100).cast("string"), 2, "0")
    grouped = F.regexp_replace(whole.cast("string"), r"(?<=\d)(?=(\d\d)*\d{3}$)", ",")
    return F.when(currency == "INR", F.concat(F.lit("\u20b9"), grouped, F.lit("."), cents)).otherwise(
        F.concat(currency, F.lit(" "), whole.cast("string"), F.lit("."), cents))


def date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), DATE)


def date_time(ms: Column) -> Column:
    """A dash for no time."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms), DATE_TIME), F.lit(UNKNOWN))


def period(start: Column, end: Column) -> Column:
    return F.concat(date(start), F.lit(" \u2013 "), date(end))


def percent(share: Column) -> Column:
    """Whole percents, cut off."""
    return F.concat((share * 100).cast("int").cast("string"), F.lit("%"))
