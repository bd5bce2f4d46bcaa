"""Spending dashboards over transactions of a period.

``tx``: tx_id, ts_ms, amount_minor, currency, direction, duplicate_status, transfer_status,
merchant_key, merchant_display, category_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passbook.operators import rollup
from passbook.operators.classify import spending_role


def in_period(tx: DataFrame, start: int, end: int) -> DataFrame:
    return tx.where(F.col("ts_ms").between(start, end))


def with_role(tx: DataFrame, excluded: DataFrame | None = None, exclude_suspected: bool = False) -> DataFrame:
    """Adds role; confirmed duplicates and rows named in ``excluded`` (tx_id) are EXCLUDED but stay for counts."""
    out = F.col("duplicate_status") == "CONFIRMED"
    if exclude_suspected:
        out = out | (F.col("duplicate_status") == "SUSPECTED")
    if excluded is not None:
        e = excluded.select(F.col("tx_id").alias("x_id")).distinct()
        tx = tx.join(e, tx["tx_id"] == e["x_id"], "left")
        out = out | F.col("x_id").isNotNull()
    return tx.withColumn("role", spending_role(F.col("direction"), F.col("transfer_status"), out)).drop("x_id")


def _total(role: str, currency: str) -> Column:
    return F.coalesce(F.sum(F.when((F.col("role") == role) & (F.col("currency") == currency), F.col("amount_minor"))), F.lit(0))


def scalars(tx: DataFrame, currency: str) -> DataFrame:
    """Gross, credits, refunds, net and the number of all rows."""
    return tx.agg(_total("GROSS_EXPENSE", currency).alias("gross_minor"), _total("CREDIT", currency).alias("credits_minor"),
                  _total("REFUND", currency).alias("refunds_minor"), F.count(F.lit(1)).alias("transaction_count")).withColumn(
        "net_minor", F.greatest(F.col("gross_minor") - F.col("refunds_minor"), F.lit(0)))


def _spent(tx: DataFrame, currency: str) -> DataFrame:
    return tx.where((F.col("role") == "GROSS_EXPENSE") & (F.col("currency") == currency))


def _month() -> Column:
    return F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM")



def by_category(tx: DataFrame, currency: str) -> DataFrame:
    return _spent(tx, currency).groupBy("category_id").agg(F.sum("amount_minor").alias("total_minor"), F.count(F.lit(1)).alias("n"))


def by_month(tx: DataFrame, currency: str) -> DataFrame:
    return _spent(tx, currency).groupBy(_month().alias("month")).agg(F.sum("amount_minor").alias("total_minor"), F.count(F.lit(1)).alias("n"))


def by_merchant(tx: DataFrame, currency: str) -> DataFrame:
    """The display name is that of the latest payment."""
    return _spent(tx, currency).where("merchant_key is not null").groupBy("merchant_key").agg(
        F.max_by("merchant_display", F.struct("ts_ms", "tx_id")).alias("merchant_display"),
        F.sum("amount_minor").alias("total_minor"), F.count(F.lit(1)).alias("n"))


def facets(tx: DataFrame, currency: str) -> DataFrame:
    """Total, categories, months and merchants in one pass over the expenses: (facet, member, total_minor, n)."""
    spent = _spent(tx, currency).select("amount_minor", "category_id", _month().alias("month"), "merchant_key")
    sets = spent.groupingSets([[], ["category_id"], ["month"], ["merchant_key"]], "category_id", "month", "merchant_key").agg(
        F.grouping_id().alias("g"), F.sum("amount_minor").alias("total_minor"), F.count(F.lit(1)).alias("n"))
    facet = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "category").when(F.col("g") == 5, "month").otherwise("merchant")
    return sets.where("not (g = 6 and merchant_key is null)").select(
        facet.alias("facet"), F.coalesce("category_id", "month", "merchant_key").alias("member"), "total_minor", "n")


def recent(tx: DataFrame, k: int = 10) -> DataFrame:
    """The k latest rows, ties by id."""
    return tx.orderBy(F.desc("ts_ms"), "tx_id").limit(k)


def subscription_totals(subscriptions: DataFrame, currency: str) -> DataFrame:
    """Monthly and yearly estimate of suspected and confirmed subscriptions, and their number."""
    active = subscriptions.where("status in ('SUSPECTED', 'CONFIRMED')")
    a = F.col("estimated_amount_minor")
    monthly = F.when(F.col("frequency") == "WEEKLY", F.expr("(estimated_amount_minor * 52) div 12")).when(
        F.col("frequency") == "YEARLY", F.expr("estimated_amount_minor div 12")).otherwise(a)
    return active.agg(F.coalesce(F.sum(F.when(F.col("currency") == currency, monthly)), F.lit(0)).alias("monthly_minor"),
                      F.count(F.lit(1)).alias("n_active")).withColumn("annual_minor", F.col("monthly_minor") * 12)


def suspected(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions that aren't dismissed, the most confident first."""
    return subscriptions.where("status in ('SUSPECTED', 'CONFIRMED', 'POSSIBLY_INACTIVE')").select(
        "merchant_key", "status", "confidence", F.size("evidence_ids").alias("n_evidence")).orderBy(F.desc("confidence"), "merchant_key")


#: Places of the short lists.
TOP_CATEGORIES, TOP_MERCHANTS, TOP_SUBSCRIPTIONS = 6, 5, 3


def _top(rows: DataFrame, name: str, member: str, measure: str, k: int) -> DataFrame:
    """The k rows with the greatest measure, ties by member: (list, place, member, measure)."""
    chosen = rows.orderBy(F.desc(measure), member).limit(k)
    place = F.row_number().over(Window.orderBy(F.desc(measure), member))  # over k rows
    return chosen.select(F.lit(name).alias("list"), place.alias("place"), F.col(member).alias("member"), F.col(measure).cast("double").alias("measure"))


def top_lists(tx: DataFrame, subscriptions: DataFrame, currency: str) -> DataFrame:
    """The leading categories and merchants by money spent, and subscriptions by confidence."""
    return (_top(by_category(tx, currency), "categories", "category_id", "total_minor", TOP_CATEGORIES)
            .union(_top(by_merchant(tx, currency), "merchants", "merchant_key", "total_minor", TOP_MERCHANTS))
            .union(_top(suspected(subscriptions), "subscriptions", "merchant_key", "confidence", TOP_SUBSCRIPTIONS)))


CACHED = ("gross_minor long, credits_minor long, refunds_minor long, transaction_count long, net_minor long, "
          "categories array<struct<category_id: string, total_minor: long, n: long>>, months array<struct<month: string, total_minor: long, n: long>>, "
          "recent_ids array<long>")


def cache_row(tx: DataFrame, start: int, end: int, currency: str, now_ms: int) -> DataFrame:
    """One row (cache_key, payload, updated_at) with the dashboard of a period as JSON: scalars, categories, months, recent ids.

    The rows are read once for all sums, which come from their daily roll-up, and once for the latest.
    All lists are bounded: by the categories, by the months of the period, by ten.
    """
    return rollup_row(rollup.daily(tx), recent(tx), start, end, currency, now_ms)


def rollup_row(parts: DataFrame, latest: DataFrame, start: int, end: int, currency: str, now_ms: int) -> DataFrame:
    """The same from the roll-up of the period and its latest rows (tx_id, ts_ms)."""
    sets = parts.withColumn("month", F.date_format(F.timestamp_millis(F.col("day").cast("long") * rollup.DAY_MS), "yyyy-MM"))
    spent = (F.col("role") == "GROSS_EXPENSE") & (F.col("currency") == currency)
    # one row per category and month, then one row in all: every shuffle has sums alone
    sums = sets.groupingSets([["category_id"], ["month"]], "category_id", "month").agg(
        F.grouping_id().alias("g"), F.sum(F.when(spent, F.col("total_minor"))).alias("total_minor"), F.sum(F.when(spent, F.col("n"))).alias("spent"),
        *[F.sum(F.when((F.col("role") == r) & (F.col("currency") == currency), F.col("total_minor"))).alias(r) for r in ("GROSS_EXPENSE", "CREDIT", "REFUND")],
        F.sum("n").alias("n"))
    by_month = F.col("g") == 2
    listed = lambda g, c: F.sort_array(F.collect_list(F.when((F.col("g") == g) & (F.col("spent") > 0), F.struct(
        F.col(c).alias(c), F.col("total_minor").alias("total_minor"), F.col("spent").alias("n")))))
    total = lambda c: F.coalesce(F.sum(F.when(by_month, F.col(c))), F.lit(0))
    whole = sums.agg(total("GROSS_EXPENSE").alias("gross_minor"), total("CREDIT").alias("credits_minor"), total("REFUND").alias("refunds_minor"),
                     total("n").alias("transaction_count"), listed(1, "category_id").alias("categories"), listed(2, "month").alias("months"))
    ids = latest.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("ts_ms")).alias("t"), "tx_id"))), lambda x: x["tx_id"]).alias("recent_ids"))
    # one row each
    row = whole.join(ids).withColumn("net_minor", F.greatest(F.col("gross_minor") - F.col("refunds_minor"), F.lit(0)))
    payload = F.struct("gross_minor", "credits_minor", "refunds_minor", "transaction_count", "net_minor", "categories", "months", "recent_ids")
    return row.select(F.lit(f"{start}:{end}").alias("cache_key"), F.to_json(payload).alias("payload"), F.lit(now_ms).cast("long").alias("updated_at"))


def cached(cache: DataFrame, start: int, end: int) -> DataFrame:
    """The dashboard stored for exactly this period; no row if there is none or its payload can't be read."""
    d = cache.where(F.col("cache_key") == f"{start}:{end}").select(F.from_json("payload", CACHED).alias("d"))
    return d.where("d.transaction_count is not null").select("d.*")


def by_ids(tx: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``tx`` named in the short list ``ids`` (pos, id), with their place in it; ids that are gone drop out."""
    return tx.join(F.broadcast(ids), tx["tx_id"] == ids["id"]).drop("id").orderBy("pos")
