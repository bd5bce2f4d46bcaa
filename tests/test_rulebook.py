"""Extraction by the literal index against the unrolled rules."""

import time

import pytest
from pyspark.sql import functions as F

from passbook.operators import messages, rulebook
from passbook.sources.rules import DEFAULT, REGRESSION, Institution, Pattern, Rules


@pytest.mark.parametrize(("pattern", "piece"), [
    (r"debited (?<amount>\d+) at", "debited "), (r"(a|b)", None), (r"abc|def", None), (r"abcd?e", "abc"), (r"[abc]{3}xy", None), (r"a\.credited+", "credite"),
    (r"x{3}paid\b", "paid"), (r"(?:sent to )?you", "you"), (r"[[a]b]abc", None), (r"(?<a>[^)(]+) SPENT on", " spent on"), (r"(?x) abc def", None), (r"\Qabcd\E", None)])
def test_literals(pattern, piece):
    assert rulebook.literal(pattern) == piece


def bodies(spark):
    rows = [(1, "VM-EX-BANK", 5, "Rs.100.00 debited from A/c XX1234 at SWIGGY on 01-02-2024. Avl bal Rs.5"), (2, "nobody", 5, "Rs.1.00 credited to your A/c XX99"),
            (3, "EXBANK", 5, "RS.2 CREDITED TO YOUR A/C"), (4, "JD-DEMOUPI", 5, "INR 3.50 sent to coffee@oksbi via UPI. UPI Ref: 123456789012"),
            (5, "AX-AMBIG", 5, "Rs.100.00 debited for ALPHA and Rs.200.00 debited for BETA"), (6, None, 5, "Rs.9 debited"), (7, "EXBANK", 5, None), (8, "EXBANK", 5, ""),
            (9, "x", 5, "Rs.7.00 refunded from UBER to your card ending 1111")]
    return spark.createDataFrame(rows, "source_message_id long, sender string, received_ms long, body string")


@pytest.mark.parametrize("rules", [DEFAULT, REGRESSION])
def test_extractions_equal_the_unrolled_rules(spark, rules):
    m = bodies(spark)
    want = messages.extractions(m.where("sender is not null and body is not null"), rules)
    got = rulebook.extractions(m, rules)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and want.count() > 0
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert rulebook.extractions(m.limit(0), rules).count() == 0


def test_thousands_of_rules_meet_few_messages(spark):
    many = Rules(1, "p", "r", tuple(Institution(f"bank {i}", (f"BANK{i:04d}X",), (
        Pattern(f"r{i}", "DEBIT", rf"paid (?<amount>\d+) to shop{i:04d}\b", "amount"),)) for i in range(5000)))
    m = spark.range(20_000).select(F.col("id").alias("source_message_id"), F.lit("someone").alias("sender"), F.lit(1).cast("long").alias("received_ms"),
                                   F.format_string("you paid %d to shop%04d today", F.col("id") + 1, F.col("id") % 10_000).alias("body"))
    assert rulebook.met(m.where("source_message_id % 10000 = 7"), many).count() == 2
    began = time.time()
    got = rulebook.extractions(m.where("source_message_id % 10000 < 200"), Rules(1, "p", "r", many.institutions))
    assert got.count() == 400 and time.time() - began < 120
