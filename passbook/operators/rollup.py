"""A daily roll-up of the ledger: partial sums that are kept by adding, from which the dashboard of any period is put together.

A row of the roll-up is (day, currency, role, category_id, merchant_key) with the money and the number of
transactions.  Parts are added up when they are read, so a batch adds a part, and a
change adds what it takes away and what it puts in its place.  A period is its whole days, from the roll-up, and
the rows of its two edge days, from the transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
KEY = ("day", "currency", "role", "category_id", "merchant_key")


def daily(tx: DataFrame) -> DataFrame:
    """The roll-up of transactions with their role (see ``dashboard.with_role``)."""
    return tx.withColumn("day", F.floor(F.col("ts_ms") / F.lit(DAY_MS)).cast("int")).groupBy(*KEY).agg(
        F.sum("amount_minor").alias("total_minor"), F.count(F.lit(1)).alias("n"))


def added(parts: DataFrame) -> DataFrame:
    """Parts added up; what has been taken away altogether drops out."""
    sums = parts.groupBy(*KEY).agg(F.sum("total_minor").alias("total_minor"), F.sum("n").alias("n"))
    return sums.where("n <> 0 or total_minor <> 0")


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """The part to add when the rows ``before`` become ``after`` (both with their role)."""
    taken = daily(before).withColumns({"total_minor": -F.col("total_minor"), "n": -F.col("n")})
    return added(taken.unionByName(daily(after)))


def whole_days(start: int, end: int) -> tuple[int, int]:
    """First and last day that lie in [start, end] from their first to their last millisecond; the last is before the first if none does."""
    return -(-start // DAY_MS), (end + 1) // DAY_MS - 1


def edges(start: int, end: int) -> list[int]:
    """The days of a period that are not whole."""
    first, last = whole_days(start, end)
    return sorted({d for d in (start // DAY_MS, end // DAY_MS) if not first <= d <= last})


def in_period(rollup: DataFrame, edge_rows: DataFrame, start: int, end: int) -> DataFrame:
    """The roll-up of exactly this period; ``edge_rows`` has the transactions, with their role, of its edge days at least."""
    first, last = whole_days(start, end)
    day = F.floor(F.col("ts_ms") / F.lit(DAY_MS))
    rest = edge_rows.where(F.col("ts_ms").between(start, end) & ~day.between(first, last))
    return rollup.where(F.col("day").between(first, last)).select(*KEY, "total_minor", "n").unionByName(daily(rest))


def _total(role: str, currency: str) -> Column:
    return F.coalesce(F.sum(F.when((F.col("role") == role) & (F.col("currency") == currency), F.col("total_minor"))), F.lit(0))


def scalars(parts: DataFrame, currency: str) -> DataFrame:
    """As ``dashboard.scalars``."""
    return parts.agg(_total("GROSS_EXPENSE", currency).alias("gross_minor"), _total("CREDIT", currency).alias("credits_minor"),
                     _total("REFUND", currency).alias("refunds_minor"), F.coalesce(F.sum("n"), F.lit(0)).alias("transaction_count")).withColumn(
        "net_minor", F.greatest(F.col("gross_minor") - F.col("refunds_minor"), F.lit(0)))


def facets(parts: DataFrame, currency: str) -> DataFrame:
    """As ``dashboard.facets``: (facet, member, total_minor, n)."""
    month = F.date_format(F.timestamp_millis(F.col("day").cast("long") * DAY_MS), "yyyy-MM").alias("month")
    spent = parts.where((F.col("role") == "GROSS_EXPENSE") & (F.col("currency") == currency)).select("category_id", month, "merchant_key", "total_minor", "n")
    sets = spent.groupingSets([[], ["category_id"], ["month"], ["merchant_key"]], "category_id", "month", "merchant_key").agg(
        F.grouping_id().alias("g"), F.sum("total_minor").alias("total_minor"), F.sum("n").alias("n")).where("n <> 0")
    facet = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "category").when(F.col("g") == 5, "month").otherwise("merchant")
    return sets.where("not (g = 6 and merchant_key is null)").select(
        facet.alias("facet"), F.coalesce("category_id", "month", "merchant_key").alias("member"), "total_minor", "n")
