"""Filtering, extraction and scalar parsing on literal rows."""

import pytest

from passbook.functions import text
from passbook.operators import messages
from passbook.sources.rules import REGRESSION
from pyspark.sql import functions as F

TEN_AUG = 1786320000000


def rows(spark, *items):
    return spark.createDataFrame([(i, s, 5_000, b) for i, (s, b) in enumerate(items)],
                                 "source_message_id long, sender string, received_ms long, body string")


def outcome(spark, sender, body):
    return messages.outcomes(rows(spark, (sender, body)), REGRESSION).first()


def test_debit_with_merchant_and_date(spark):
    r = outcome(spark, "VM-EX-BANK", "Rs.1,250.50 debited from A/c XX1234 at SWIGGY on 10-08-2026. Avl bal Rs.5000")
    assert (r.parse_status, r.amount_minor, r.currency, r.direction, r.merchant, r.ts_ms) == ("SUCCESS", 125050, "INR", "DEBIT", "SWIGGY", TEN_AUG)
    assert r.confidence == pytest.approx(0.88)


def test_credit_without_merchant_takes_received_time(spark):
    r = outcome(spark, "EXBANK", "Rs.500.00 credited to your A/c XX99")
    assert (r.amount_minor, r.direction, r.merchant, r.ts_ms) == (50000, "CREDIT", None, 5000)


def test_upi_reference_is_hashed(spark):
    r = outcome(spark, "JD-DEMOUPI", "INR 75.25 sent to coffee@oksbi via UPI. UPI Ref: 123456789012")
    assert (r.amount_minor, r.direction) == (7525, "DEBIT") and len(r.reference_hash) == 32


@pytest.mark.parametrize(("sender", "body", "status", "reason"), [
    ("VM-EX-BANK", "Your statement is ready", "UNSUPPORTED", "UNSUPPORTED_TEMPLATE"),
    ("EX-BANK", "Rs. debited at SWIGGY", "UNSUPPORTED", "UNSUPPORTED_TEMPLATE"),
    ("NOBODY", "nothing here", "UNSUPPORTED", "NO_SENDER_OR_PATTERN_MATCH"),
    ("AX-AMBIG", "Rs.100.00 debited for ALPHA and Rs.200.00 debited for BETA", "AMBIGUOUS", None),
    ("NOBODY", "Rs.5.00 credited", "UNSUPPORTED", "LOW_CONFIDENCE"),
])
def test_outcomes(spark, sender, body, status, reason):
    r = outcome(spark, sender, body)
    assert (r.parse_status, r.parse_reason) == (status, reason)


@pytest.mark.parametrize(("sender", "body", "reason"), [
    ("VM-EX-BANK", "Your OTP is 123456", "SECRET_CODE"),
    ("PROMO", "Flat 50% off! click here", "MARKETING"),
    ("SHIP", "Package out for delivery", "DELIVERY"),
    ("MOM", "call me", "PERSONAL"),
    ("EX-BANK", "  \n", "BLANK"),
    ("UNKNOWN", "INR 50 spent on UPI to merchant@ybl", None),
    ("NOBODY", "x" * 200, "NOT_FINANCIAL"),
    (None, "hello", "MALFORMED"),
    (None, "Rs.5.00 debited", "MALFORMED"),
    ("EX-BANK", None, "MALFORMED"),
])
def test_filter(spark, sender, body, reason):
    assert messages.filtered(rows(spark, (sender, body)), REGRESSION).first().reject_reason == reason


def scalar(spark, f, *values):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in d.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_amounts(spark):
    assert scalar(spark, text.amount_minor, "1,234.56", "1234.5", " 12 ", "1.234", "", None, "99999999999999999999", "92233720368547758.07") == [
        123456, 123450, 1200, None, None, None, None, 9223372036854775807]


def test_currencies(spark):
    assert scalar(spark, text.currency_code, "Rs.", "₹", "rupees", "usd", "INR5", "12", None) == ["INR", "INR", "INR", "USD", "INR", None, None]


def test_dates_are_cut_to_the_month_but_iso_is_strict(spark):
    day = 86_400_000
    got = scalar(spark, text.date_millis, "31-02-2026", "28-02-2026", "32-01-2026", "2026-02-31", "10/08/26", "10-08-2026 01:02",
                 "2026-02-31T00:00:01", "10-08/2026", "01-13-2026", "", None)
    assert got == [got[1], got[1], None, None, TEN_AUG, TEN_AUG + 3_720_000, got[1] + 1000, None, None, None, None]
    assert got[1] % day == 0


def test_payment_methods(spark):
    assert scalar(spark, text.payment_method, "paid via upi", " ****1234", "AX****1234", "cash withdrawal", "NEFT", "nothing") == [
        "UPI", "UNKNOWN", "CARD", "ATM", "NET_BANKING", "UNKNOWN"]


def test_versions(spark):
    d = spark.createDataFrame([("bundled-2026.08.12.0", "2026.8.12"), ("2026.10", "2026.9"), ("1.0", "1.0.1"), ("b", "a")], "a string, b string")
    assert [r[0] for r in d.select(text.version_compare(F.col("a"), F.col("b"))).collect()] == [0, 1, -1, 1]


def test_long_versions_and_app_versions(spark):
    d = spark.createDataFrame([("1" + ".0" * 20 + ".1", "1" + ".0" * 20, 1), ("1" + ".0" * 30, "1.0", 0)], "a string, b string, w int")
    assert all(r.x == r.w for r in d.select("w", text.version_compare(F.col("a"), F.col("b")).alias("x")).collect())
    v = spark.createDataFrame([("1.2.3-beta", "1.2.3", True), ("1.2", "1.2.1", False), ("1.10", "1.9", True), ("x", "1", False), (None, "1", False)], "a string, b string, w boolean")
    assert all(r.x == r.w for r in v.select("w", text.app_version_fits(F.col("a"), F.col("b")).alias("x")).collect())


def test_outcomes_are_narrow(spark):
    plan = messages.outcomes(rows(spark, ("EXBANK", "Rs.5.00 credited")), REGRESSION).where("parse_status = 'SUCCESS'")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_mapping_keeps_numbers_and_trims_text(spark):
    raw = spark.createDataFrame([(" 7 ", " A ", 1, " b "), ("8", " ", 1, "b"), ("9", "A", -1, "b"), (None, "A", 1, "b"), ("5", "A", 1, "")],
                                "source_message_id string, sender string, received_ms long, body string")
    assert messages.mapped(raw).collect() == [("7", "A", 1, " b ")]
    assert messages.mapped(rows(spark, (" A", "b"))).collect() == [(0, "A", 5000, "b")]
    assert messages.page_state(raw, 5).first().asDict() == {"next_id": " 7 ", "n_rows": 5, "exhausted": False}
    assert messages.page_state(raw.where("sender = ' '"), 5).first().asDict() == {"next_id": "8", "n_rows": 1, "exhausted": True}


def test_keyset_page_pushes_both_filters_to_the_scan(spark, tmp_path):
    rows(spark, *[("EXBANK", "x")] * 20).write.parquet(str(tmp_path / "m"))
    page = messages.keyset_page(spark.read.parquet(str(tmp_path / "m")), 0, 10_000, 4, 5)
    assert [r.source_message_id for r in page.collect()] == [5, 6, 7, 8, 9]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(source_message_id,4)" in plan and "GreaterThanOrEqual(received_ms,0)" in plan
    assert messages.page_state(page, 5).first().asDict() == {"next_id": 9, "n_rows": 5, "exhausted": False}


def test_the_parse_of_the_same_rules_is_built_once(spark):
    assert messages.outcome(REGRESSION) is messages.outcome(REGRESSION)
