"""Scalar expressions over text, money and time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def present(c: Column) -> Column:
    """Trimmed, null if nothing is left."""
    return F.nullif(squeeze(c), F.lit(""))


def any_match(c: Column, patterns: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | c.rlike(p)
    return found


def first_match(c: Column, table: Sequence[tuple[str, str]], default: str) -> Column:
    """The name of the first (name, pattern) that is found."""
    name, pattern = table[0]
    out = F.when(c.rlike(pattern), name)
    for name, pattern in table[1:]:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise(default)


def amount_minor(raw: Column) -> Column:
    """Minor units of an amount with up to two decimals; null if malformed or out of range."""

    def minor(parts: Column) -> Column:
        hundred = F.try_multiply(F.get(parts, F.lit(0)).try_cast("bigint"), F.lit(100).cast("bigint"))
        return F.try_add(hundred, F.rpad(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), 2, "0").try_cast("bigint"))

    cleaned = F.regexp_replace(squeeze(raw), "[, ]", "")
    return let(cleaned, lambda v: F.when(v.rlike(r"^\d+(\.\d{1,2})?$"), let(F.split(v, r"\."), minor)))


def currency_code(raw: Column) -> Column:
    """The currency's three letters, or null."""
    c = F.replace(F.replace(F.upper(squeeze(raw)), F.lit("₹"), F.lit("INR")), F.lit("."), F.lit(""))
    return let(c, lambda v: F.when(v.isin("RS", "RUPEE", "RUPEES") | v.startswith("INR"), "INR").when(v.rlike("^[A-Z]{3}$"), v))


def date_millis(raw: Column) -> Column:
    """UTC milliseconds of a date or date and time in one of the eleven known forms, or null.

    Days up to 31 are cut to the month's last, but for the bare ISO date, which is strict.
    """
    number = lambda t, i: F.coalesce(F.get(t, F.lit(i)).try_cast("int"), F.lit(0))

    def millis(y: Column, m: Column, d: Column, t: Column, strict: bool = False) -> Column:
        h, mi, s = (number(t, i) for i in (3, 4, 5))
        fine = (y >= 1) & m.between(1, 12) & d.between(1, 31) & (h <= 23) & (mi <= 59) & (s <= 59)
        return F.when(fine, let(F.make_date(y, m, F.lit(1)), lambda first: let(
            F.day(F.last_day(first)), lambda last: F.when(
                F.lit(not strict) | (d <= last), F.unix_date(first).cast("bigint") * 86_400_000 + (F.least(d, last) - 1).cast("bigint") * 86_400_000
                + ((h * 60 + mi) * 60 + s).cast("bigint") * 1000))))

    def parsed(v: Column) -> Column:
        return let(F.regexp_extract_all(v, F.lit(r"\d+"), F.lit(0)), lambda t: (
            F.when(v.rlike(r"^\d{2}([-/])\d{2}\1\d{4}( \d{2}:\d{2}(:\d{2})?)?$"), millis(number(t, 2), number(t, 1), number(t, 0), t))
            .when(v.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$"), millis(number(t, 0), number(t, 1), number(t, 2), t))
            .when(v.rlike(r"^\d{2}([-/])\d{2}\1\d{2}$"), millis(number(t, 2) + 2000, number(t, 1), number(t, 0), t))
            .when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), millis(number(t, 0), number(t, 1), number(t, 2), t, strict=True))))

    return let(squeeze(raw), parsed)


def payment_method(body: Column) -> Column:
    return first_match(body, lexicon.PAYMENT_METHODS, "UNKNOWN")


def fold(c: Column) -> Column:
    """Trimmed and in lower case; null becomes empty."""
    return F.coalesce(F.lower(squeeze(c)), F.lit(""))


def sha256(*parts: Column) -> Column:
    """Hex digest of the parts joined by bars."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def version_parts(c: Column) -> Column:
    """The first dotted number as integers, or null."""
    core = F.nullif(F.regexp_extract(c, r"\d+(?:\.\d+)+", 0), F.lit(""))
    return let(F.transform(F.split(core, r"\."), lambda x: x.try_cast("int")), lambda p: F.when(~F.exists(p, lambda x: x.isNull()), p))


def _compare_parts(x: Column, y: Column) -> Column:
    """-1, 0 or 1 for two arrays of numbers, the shorter filled with zeros to any length."""
    zeros = lambda n: F.array_repeat(F.lit(0), F.greatest(n, F.lit(0)))
    longer = F.concat(x, zeros(F.size(y) - F.size(x)))
    return let(longer, lambda a: let(F.concat(y, zeros(F.size(x) - F.size(y))), lambda b: F.when(a < b, -1).when(a > b, 1).otherwise(0)))


def app_version_fits(current: Column, minimum: Column) -> Column:
    """Whether an app version is at least ``minimum``; suffixes after - or + don't count, a part that is no number never fits."""

    def parts(c: Column) -> Column:
        core = F.regexp_replace(squeeze(c), r"[-+].*$", "")
        return F.when(core.rlike(r"^\d+(\.\d+)*$"), F.transform(F.split(core, r"\."), lambda x: x.try_cast("int")))

    return F.coalesce(let(parts(current), lambda x: let(parts(minimum), lambda y: F.when(
        ~F.exists(x, lambda v: v.isNull()) & ~F.exists(y, lambda v: v.isNull()), _compare_parts(x, y) >= 0))), F.lit(False))


def version_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: by dotted numbers if both have one, else by text."""
    by_text = F.when(a < b, -1).when(a > b, 1).otherwise(0)
    return let(version_parts(a), lambda x: let(version_parts(b), lambda y: F.when(
        x.isNotNull() & y.isNotNull(), _compare_parts(x, y)).otherwise(by_text)))
