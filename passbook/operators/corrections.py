"""User corrections as an overlay: the newest valid value per transaction and field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions import lexicon, text
from passbook.operators.classify import merchant_struct, one_of

#: Fields that change a transaction, with the values they allow (None: any text that isn't blank).
FIELDS = {
    "MERCHANT": None, "CATEGORY": [k for k, _ in lexicon.CATEGORIES], "DIRECTION": lexicon.DIRECTIONS, "DUPLICATE_STATUS": lexicon.STATUSES,
    "TRANSFER_STATUS": lexicon.STATUSES, "NOT_A_TRANSACTION": None,
}
#: Merchant of a text that leaves nothing to name one by.
UNKNOWN = "unknown"


def value_of(field: str, allowed) -> Column:
    """The value to apply if a correction is of ``field`` and valid, else null; closed sets ignore case, ids of categories don't."""
    given = text.present(F.col("new_value"))
    if field == "CATEGORY":
        given = F.when(given.isin(*allowed), given)
    elif allowed:
        given = one_of(given, allowed)
    return F.when(F.col("field_name") == field, given)


def latest(corrections: DataFrame, key: str = "tx_id", fields: dict | None = None) -> DataFrame:
    """One row per key with the newest valid value of each field; ties go to the greater id."""
    valid = {f: value_of(f, allowed) for f, allowed in (fields or FIELDS).items()}
    rows = corrections.select(key, "updated_at", "correction_id", *[v.alias("v_" + f) for f, v in valid.items()]).where(
        F.coalesce(*[F.col("v_" + f) for f in valid]).isNotNull())
    return rows.groupBy(F.col(key).alias("c_tx")).agg(*[
        F.max_by(F.col("v_" + f), F.when(F.col("v_" + f).isNotNull(), F.struct("updated_at", "correction_id"))).alias("c_" + f.lower()) for f in valid])


def apply(tx: DataFrame, corrections: DataFrame) -> DataFrame:
    """Transactions with their corrections: invalid ones count for nothing, the category follows no merchant change.

    A duplicate status of NONE clears the pointer to the other row.  Adds is_user_confirmed, or raises it where it is there.
    """
    c = latest(corrections)
    j = tx.join(c, tx["tx_id"] == c["c_tx"], "left")
    m = merchant_struct(F.col("c_merchant"))
    given = F.col("c_merchant").isNotNull()
    fixed = {
        "merchant_key": F.when(given, F.coalesce(m["key"], F.lit(UNKNOWN))).otherwise(F.col("merchant_key")),
        "merchant_display": F.coalesce("c_merchant", "merchant_display"),
        "possible_duplicate_of": F.when(F.coalesce(F.col("c_duplicate_status") != "NONE", F.lit(True)), F.col("possible_duplicate_of")),
        "category_id": F.coalesce("c_category", "category_id"),
        **{k: F.coalesce("c_" + k, k) for k in ("direction", "duplicate_status", "transfer_status")},
    }
    confirmed = F.col("c_tx").isNotNull()
    if "is_user_confirmed" in tx.columns:
        confirmed = confirmed | F.coalesce(tx["is_user_confirmed"], F.lit(False))
    kept = [x for x in tx.columns if x != "is_user_confirmed"]
    return j.select(*[fixed[x].alias(x) if x in fixed else tx[x] for x in kept], confirmed.alias("is_user_confirmed"))


def outcomes(corrections: DataFrame, tx: DataFrame) -> DataFrame:
    """(correction_id, outcome): APPLIED, or why a correction is refused, in the order in which it is checked."""
    t = tx.select(F.col("tx_id").alias("t_id"), F.col("merchant_key").alias("t_merchant"))
    j = corrections.join(t, corrections["tx_id"] == t["t_id"], "left")
    allowed = FIELDS | {"SUBSCRIPTION_STATUS": lexicon.SUBSCRIPTION_STATUSES}
    value = F.coalesce(*[value_of(f, a) for f, a in allowed.items()])
    unnamed = F.col("apply_to_future") & F.col("merchant_match_key").isNull() & F.col("t_merchant").isNull()
    return j.select("correction_id", (
        F.when(F.col("t_id").isNull(), "TRANSACTION_NOT_FOUND")
        .when(unnamed & (F.col("field_name") != "SUBSCRIPTION_STATUS"), "INVALID_FUTURE_RULE")
        .when(value.isNull() | ((F.col("field_name") == "SUBSCRIPTION_STATUS") & F.col("t_merchant").isNull()), "INVALID_VALUE")
        .otherwise("APPLIED")).alias("outcome"))


def apply_to_subscriptions(subscriptions: DataFrame, tx: DataFrame, corrections: DataFrame) -> DataFrame:
    """Subscriptions with the newest valid SUBSCRIPTION_STATUS given on a transaction of their merchant."""
    of_merchant = corrections.where("field_name = 'SUBSCRIPTION_STATUS'").join(
        tx.select("tx_id", "merchant_key").where("merchant_key is not null"), "tx_id")
    c = latest(of_merchant, "merchant_key", {"SUBSCRIPTION_STATUS": lexicon.SUBSCRIPTION_STATUSES})
    j = subscriptions.join(c, subscriptions["merchant_key"] == c["c_tx"], "left")
    return j.select(*[F.coalesce("c_subscription_status", subscriptions[x]).alias(x) if x == "status" else subscriptions[x]
                      for x in subscriptions.columns])


def excluded_ids(corrections: DataFrame) -> DataFrame:
    return corrections.where("field_name = 'NOT_A_TRANSACTION'").select("tx_id").distinct()
