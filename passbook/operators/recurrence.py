"""Recurring payments per merchant and their merge with what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passbook.functions import lexicon, text

DAY_MS = 86_400_000
TOLERANCE = 0.15
#: (frequency, target days, slack days), in order of precedence.
FREQUENCIES = (("WEEKLY", 7.0, 2.0), ("MONTHLY", 30.0, 5.0), ("YEARLY", 365.0, 20.0))
INACTIVE_MULTIPLES = 2.0


def intervals(payments: DataFrame) -> DataFrame:
    """Days since the payment before, per merchant; null for the first."""
    w = Window.partitionBy("merchant_key").orderBy("ts_ms", "tx_id")
    return payments.withColumn("interval_days", (F.col("ts_ms") - F.lag("ts_ms").over(w)) / F.lit(float(DAY_MS)))


def eligible(tx: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Rows that may be recurring expenses: debits to a merchant that are no transfer, no confirmed duplicate and not in ``excluded`` (tx_id)."""
    fine = tx.where("direction = 'DEBIT' and transfer_status = 'NONE' and merchant_key is not null and duplicate_status is distinct from 'CONFIRMED'")
    return fine if excluded is None else fine.join(excluded.select("tx_id").distinct(), "tx_id", "left_anti")


def plausible(payments: DataFrame) -> DataFrame:
    """The payments of merchants that may recur, by sums that Spark combines before the shuffle.

    With all amounts within the tolerance of a median, the greatest is bounded by the least.  Half
    of the intervals are at least as long as their median, so the time between first and last payment bounds
    the number of payments.  What is left of a merchant is therefore bounded by the time it spans, however many rows it has.
    """
    shortest = min(days - slack for _, days, slack in FREQUENCIES)
    span = (F.col("last") - F.col("first")) / F.lit(float(DAY_MS))
    merchants = payments.where("merchant_key is not null").groupBy(F.col("merchant_key").alias("p_key")).agg(
        F.count(F.lit(1)).alias("n"), F.min("amount_minor").alias("lo"), F.max("amount_minor").alias("hi"), F.min("currency").alias("c_lo"),
        F.max("currency").alias("c_hi"), F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last")).where(
        (F.col("n") >= 2) & (F.col("c_lo") == F.col("c_hi")) & (F.col("hi") > 0)
        & (F.col("hi") * (1 - TOLERANCE) <= F.col("lo") * (1 + TOLERANCE) + 1) & ((F.col("n") - 1) / 2 * shortest <= span + 1e-6))
    return payments.join(merchants.select("p_key"), payments["merchant_key"] == merchants["p_key"], "left_semi")


def detect(payments: DataFrame, now_ms: int) -> DataFrame:
    """Subscriptions found in eligible payments (tx_id, merchant_key, merchant_display, amount_minor, currency, ts_ms).

    Merchants that cannot recur are left out first, so no merchant's window or evidence is larger than the
    time it spans allows.  The spreads come from minimum and maximum, as the deviation from a centre is greatest at an end.
    """
    g = intervals(plausible(payments)).groupBy("merchant_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("amount_minor").alias("lo"), F.max("amount_minor").alias("hi"),
        F.floor(F.expr("percentile(amount_minor, 0.5)")).cast("bigint").alias("amount"),
        F.min("currency").alias("currency"), F.max("currency").alias("currency_hi"),
        F.expr("median(interval_days)").alias("median_days"), F.min("interval_days").alias("i_lo"), F.max("interval_days").alias("i_hi"),
        F.max("ts_ms").alias("last_ms"), F.max_by("merchant_display", F.struct("ts_ms", "tx_id")).alias("merchant_display"),
        F.sort_array(F.collect_set("tx_id")).alias("evidence_ids"))
    frequency, target = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, days, slack in reversed(FREQUENCIES):
        fits = F.abs(F.col("median_days") - days) <= slack
        frequency, target = F.when(fits, name).otherwise(frequency), F.when(fits, days).otherwise(target)
    amount = F.col("amount").cast("double")
    spread = F.greatest(F.col("hi") - amount, amount - F.col("lo")) / amount
    g = g.where((F.col("n") >= 2) & (F.col("currency") == F.col("currency_hi")) & (F.col("amount") > 0)).select(
        "*", frequency.alias("frequency"), target.alias("target"), spread.alias("amount_spread")).where(
        F.col("frequency").isNotNull() & (F.col("amount_spread") <= TOLERANCE))
    off = F.greatest(F.abs(F.col("i_lo") - F.col("target")), F.abs(F.col("i_hi") - F.col("target"))) / F.col("target")
    interval_ms = (F.col("target") * DAY_MS).cast("bigint")
    score = (F.when(F.col("n") >= 4, 0.35).when(F.col("n") == 3, 0.25).otherwise(0.15)
             + F.lit(0.35) * (1.0 - F.least(F.col("amount_spread"), F.lit(1.0))) + F.lit(0.30) * (1.0 - F.least(off, F.lit(1.0))))
    inactive = F.lit(now_ms) > F.col("last_ms") + (INACTIVE_MULTIPLES * interval_ms).cast("bigint")
    return g.select(
        "merchant_key", "merchant_display", "frequency", F.col("amount").alias("estimated_amount_minor"), "currency",
        F.col("last_ms").alias("last_payment_ms"), (F.col("last_ms") + interval_ms).alias("estimated_next_ms"),
        F.least(F.lit(1.0), score).alias("confidence"), F.when(inactive, "POSSIBLY_INACTIVE").otherwise("SUSPECTED").alias("status"),
        "evidence_ids")


def by_confidence(subscriptions: DataFrame) -> DataFrame:
    """The most confident first, ties by merchant."""
    return subscriptions.orderBy(F.desc("confidence"), "merchant_key")


def evidence(subscriptions: DataFrame, payments: DataFrame) -> DataFrame:
    """The payments behind each subscription."""
    e = subscriptions.select("merchant_key", F.explode("evidence_ids").alias("tx_id"))
    return payments.join(e, ["merchant_key", "tx_id"])


def by_status(subscriptions: DataFrame) -> DataFrame:
    """The four lists by status as rows: (status, merchant_key, confidence), each list the most confident first."""
    return subscriptions.where(F.col("status").isin(*lexicon.SUBSCRIPTION_STATUSES)).select("status", "merchant_key", "confidence").orderBy(
        "status", F.desc("confidence"), "merchant_key")


#: What a detection brings besides identity, status and evidence.
FOUND = ("merchant_display", "frequency", "estimated_amount_minor", "currency", "last_payment_ms", "estimated_next_ms", "confidence", "evidence_ids")


def merge(detected: DataFrame, stored: DataFrame, now_ms: int) -> DataFrame:
    """The subscriptions of the detected merchants after a detection, as they are to be stored, with is_new.

    DISMISSED stays exactly as stored unless there is new evidence, then it is SUSPECTED again; CONFIRMED is kept; all else is as found.
    A stored subscription keeps its id and its created_at; the oldest stored row of a merchant counts.
    """
    columns = ["subscription_id", "status", "created_at", "updated_at", *FOUND]
    old = stored.groupBy(F.col("merchant_key").alias("k")).agg(F.min_by(F.struct(*columns), F.struct("updated_at", "subscription_id")).alias("old"))
    j = detected.join(old, detected["merchant_key"] == old["k"], "left")
    was, known = F.col("old.status"), F.col("k").isNotNull()
    fresh = F.size(F.array_except("evidence_ids", "old.evidence_ids")) > 0
    stays = F.coalesce((was == "DISMISSED") & ~fresh, F.lit(False))
    status = F.when(stays, was).when(was == "DISMISSED", "SUSPECTED").when(was == "CONFIRMED", "CONFIRMED").otherwise(F.col("status"))
    return j.select(
        F.when(known, F.col("old.subscription_id")).otherwise(F.substring(text.sha256(F.lit("subscription"), F.col("merchant_key")), 1, 32)).alias("subscription_id"),
        "merchant_key", status.alias("status"), *[F.when(stays, F.col(f"old.{c}")).otherwise(F.col(c)).alias(c) for c in FOUND],
        F.coalesce("old.created_at", F.lit(now_ms)).alias("created_at"),
        F.when(stays, F.col("old.updated_at")).otherwise(F.lit(now_ms)).alias("updated_at"), (~known).alias("is_new"))


def merged_table(detected: DataFrame, stored: DataFrame, now_ms: int) -> DataFrame:
    """All subscriptions after a detection: those merged, and the stored ones that were not among them."""
    merged = merge(detected, stored, now_ms).drop("is_new")
    return merged.unionByName(stored.join(merged.select("subscription_id"), "subscription_id", "left_anti").select(*merged.columns))
