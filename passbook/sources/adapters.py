"""The ledger's relations as projections of the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.functions import lexicon

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
METHODS = ("UPI", "CARD", "ATM", "NET_BANKING", "WALLET", "BILL_PAYMENT", "UNKNOWN")
MERCHANTS = ("SWIGGY", "AMAZON", "UBER", "NETFLIX", "City Cafe", "OWN ACCOUNT")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def tx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions from orders: one per order, the customer as merchant."""
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("tx_id"),
        _millis("o_orderdate").alias("ts_ms"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount_minor"),
        F.when(F.col("o_orderkey") % 20 == 0, "USD").otherwise("INR").alias("currency"),
        F.element_at(F.array(*map(F.lit, lexicon.DIRECTIONS)), F.substring("o_orderpriority", 1, 1).cast("int")).alias("direction"),
        F.when(F.col("o_orderstatus") == "F", "NONE").when(F.col("o_orderstatus") == "O", "SUSPECTED")
        .otherwise("CONFIRMED").alias("duplicate_status"),
        F.when(F.col("o_orderkey") % 13 == 0, "SUSPECTED").otherwise("NONE").alias("transfer_status"),
        F.element_at(F.array(*map(F.lit, METHODS)), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("payment_method"),
        F.when(F.col("o_custkey") % 11 != 0, F.lower("c_name")).alias("merchant_key"),
        F.when(F.col("o_custkey") % 11 != 0, F.col("c_name")).alias("merchant_display"),
        F.lower("c_mktsegment").alias("category_id"))


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions from events: user and type as merchant, amount fixed by user, ids in order of time."""
    e = _table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), _millis("ts").alias("ts_ms"),
        ((F.col("user_id") % 5 + 2) * 500).cast("bigint").alias("amount_minor"), F.lit("INR").alias("currency"),
        F.lit("DEBIT").alias("direction"), F.concat_ws(" ", F.col("user_id").cast("string"), "event_type").alias("merchant_key"),
        F.lit("Example Bank").alias("institution"), F.lit(None).cast("string").alias("masked_account"),
        F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("r"), F.expr("cast(event_id div 18 as string)"))).alias("reference_hash"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages synthesised from events: known, prefixed and unknown senders; every kind of body."""
    e = _table(spark, sf_dir, "events")
    merchant = F.element_at(F.array(*map(F.lit, MERCHANTS)), (F.col("user_id") % 6 + 1).cast("int"))
    amount = F.format_string("%.2f", F.col("value"))
    day = F.date_format(F.col("ts").cast("timestamp"), "dd-MM-yyyy")
    kind, n = F.col("event_type"), F.col("event_id")
    body = (
        F.when(n % 50 == 0, "Rs.100.00 debited for ALPHA and Rs.200.00 debited for BETA")
        .when(n % 50 == 1, F.concat(F.lit("INR "), amount, F.lit(" sent to coffee@oksbi via UPI. UPI Ref: 123456789012")))
        .when(n % 50 == 2, F.concat(F.lit("Rs."), amount, F.lit(" transferred to SAVINGS Ref:NEFT9911")))
        .when(n % 50 == 3, "Congrats! You won a prize, click here")
        .when(n % 50 == 4, "see you at home tonight")
        .when(n % 50 == 5, "  ")
        .when(kind == "purchase", F.concat(F.lit("Rs."), amount, F.lit(" debited from A/c XX1234 at "), merchant,
                                           F.lit(" on "), day, F.lit(". Avl bal Rs.5000")))
        .when(kind == "click", F.concat(F.lit("Rs."), amount, F.lit(" credited to your A/c XX99")))
        .when(kind == "view", F.concat(F.lit("Rs."), amount, F.lit(" refunded from "), merchant, F.lit(" to your card ending 1111")))
        .when(kind == "signup", "Your OTP is 482913. Do not share this code.")
        .otherwise("Package delivered. Tracking id 998877"))
    sender = F.element_at(F.array(*map(F.lit, ("VM-EX-BANK", "EXBANK", "JD-DEMOUPI", "PROMO", "AX-AMBIG"))),
                          (n % 5 + 1).cast("int"))
    # generated, so that a predicate on the body isn't rewritten into its recipe time and again
    return e.select(n.alias("source_message_id"), sender.alias("sender"), _millis("ts").alias("received_ms"),
                    F.explode_outer(F.array(body)).alias("body"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of orders: every 10th order, field by number, newer for higher ids; some are future rules."""
    o = _table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0")
    n = F.col("o_orderkey") % 70
    field = (F.when(n == 0, "NOT_A_TRANSACTION").when(n == 10, "CATEGORY").when(n == 20, "DIRECTION").when(n == 30, "MERCHANT")
             .when(n == 40, "DUPLICATE_STATUS").when(n == 50, "TRANSFER_STATUS").otherwise("CATEGORY"))
    value = (F.when(n == 0, "true").when(n == 10, "travel").when(n == 20, "REFUND").when(n == 30, "  PAYTM*Swiggy ")
             .when(n == 40, "NONE").when(n == 50, "CONFIRMED").otherwise("no such category"))
    return o.select(
        F.col("o_orderkey").alias("correction_id"), F.col("o_orderkey").alias("tx_id"), field.alias("field_name"), value.alias("new_value"),
        (F.col("o_orderkey") % 3 == 0).alias("apply_to_future"),
        F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("merchant_match_key"),
        _millis("o_orderdate").alias("updated_at"))
