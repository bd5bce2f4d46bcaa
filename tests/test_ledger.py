"""Classification, duplicates, recurrence, dashboards, corrections, stores."""

import random

import pytest

from passbook.operators import classify, corrections, dashboard, dedupe, recurrence, scans
from passbook.plans.query import TransactionQuery, preset
from passbook.sources.store import Store, support_outcome, upserted
from pyspark.sql import functions as F

DAY = 86_400_000


@pytest.mark.parametrize(("raw", "key", "display"), [
    ("  PAYTM*Swiggy ", "swiggy", "Swiggy"), ("SWIGGY.COM", "swiggy com", "SWIGGY.COM"), ("www.AMZN", "amazon", "Amazon"),
    ("coffee@oksbi", "coffee", "coffee"), ("@@ !!", "unknown", "@@ !!"), ("   ", None, None), (None, None, None),
])
def test_merchants(spark, raw, key, display):
    m = spark.createDataFrame([(raw,)], "v string").select(classify.merchant_struct(F.col("v")).alias("m")).first().m
    assert (m and (m.key, m.display)) == (key and (key, display))


def test_category_precedence(spark):
    d = spark.createDataFrame([
        ("CREDIT", "UPI", "NONE", "swiggy", "swiggy", None), ("TRANSFER", "UPI", "NONE", "x", "x", None), ("DEBIT", "UPI", "SUSPECTED", "x", "x", None),
        ("DEBIT", "ATM", "NONE", "swiggy", "swiggy", None), ("DEBIT", "UPI", "NONE", "netflix", "netflix", None), ("DEBIT", "UPI", "NONE", "a", "City Cafe", None),
        ("DEBIT", "UPI", "NONE", None, "", None), ("CREDIT", "UPI", "NONE", "x", "x", "travel"), ("DEBIT", "UPI", "NONE", "x", "x", "no such"),
    ], "d string, m string, t string, k string, w string, u string")
    got = [r[0] for r in d.select(classify.category(*[F.col(c) for c in "dmtkwu"])).collect()]
    assert got == ["income_and_refunds", "transfers", "transfers", "cash_withdrawal", "subscriptions", "food_and_dining", "other", "travel", "other"]


def fold_in_order(tx):
    """The sequential decision, one row at a time."""
    stored, out = {}, []
    for t in tx:
        if t["fp"] in stored:
            out.append((t["seq"], "REUSED", stored[t["fp"]]["seq"]))
            continue
        near = [(abs(t["ts_ms"] - s["ts_ms"]), s["seq"]) for s in stored.values()
                if (s["amount_minor"], s["merchant_key"]) == (t["amount_minor"], t["merchant_key"]) and abs(t["ts_ms"] - s["ts_ms"]) <= dedupe.WINDOW_MS
                and (not s["reference_hash"] or not t["reference_hash"] or s["reference_hash"] == t["reference_hash"])]
        stored[t["fp"]] = t
        out.append((t["seq"], "SUSPECTED" if near else "UNIQUE", min(near)[1] if near else None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_decisions_equal_the_sequential_fold(spark, seed):
    r = random.Random(seed)
    tx = [{"seq": i, "ts_ms": r.randrange(0, 9_000_000), "amount_minor": r.choice([100, 200]), "currency": "INR", "direction": "DEBIT",
           "merchant_key": r.choice(["a", "b", None]), "institution": "I", "masked_account": None, "reference_hash": r.choice([None, None, "r1", "r2"])}
          for i in range(150)]
    d = spark.createDataFrame([tuple(t.values()) for t in tx], "seq long, ts_ms long, amount_minor long, currency string, direction string, "
                              "merchant_key string, institution string, masked_account string, reference_hash string")
    for t, fp in zip(tx, [x[0] for x in d.orderBy("seq").select(dedupe.fingerprint()).collect()], strict=True):
        t["fp"] = fp
    got = [(x.seq, x.decision, x.points_to) for x in dedupe.decide(d).orderBy("seq").collect()]
    want = fold_in_order(tx)
    assert got == want
    # in two batches, the second against what the first stored
    marked = d.withColumn("fingerprint", dedupe.fingerprint())
    stored = dedupe.first_of_each(marked.where("seq < 70"))
    got = [(x.seq, x.decision, x.points_to) for x in dedupe.decide(d.where("seq >= 70"), stored).orderBy("seq").collect()]
    assert got == want[70:]
    # the user's word on near matches
    said = dedupe.decide(d.withColumn("duplicate_override", F.when(F.col("seq") % 2 == 0, "NONE").otherwise("CONFIRMED"))).orderBy("seq").collect()
    for x, (_, decision, points) in zip(said, want, strict=True):
        even = x.seq % 2 == 0
        assert (x.decision, x.points_to) == (("UNIQUE", None) if even and decision == "SUSPECTED" else (decision, points))
        assert x.duplicate_status == {"REUSED": None, "UNIQUE": "NONE", "SUSPECTED": "NONE" if even else "CONFIRMED"}[decision]


def test_accounts_are_folded_before_they_are_compared(spark):
    rows = [(i, 600_000 * i, 5, "INR", "DEBIT", "m", a, None) for i, a in enumerate([" XX12 ", "xx12", "xx13", None])]
    d = spark.createDataFrame(rows, "seq long, ts_ms long, amount_minor long, currency string, direction string, merchant_key string, masked_account string, reference_hash string")
    assert {x.seq: x.near_seq for x in dedupe.near_matches(d).collect()} == {1: 0, 3: 2}


def payments(spark, *rows):
    return spark.createDataFrame([(i, m, m, t, a, c) for i, (m, t, a, c) in enumerate(rows)],
                                 "tx_id long, merchant_key string, merchant_display string, ts_ms long, amount_minor long, currency string")


def test_recurrence(spark):
    p = payments(spark, ("n", 0, 100, "INR"), ("n", 30 * DAY, 100, "INR"), ("n", 60 * DAY, 100, "INR"),
                 ("one", 0, 5, "INR"), ("varies", 0, 100, "INR"), ("varies", 30 * DAY, 200, "INR"), ("mixed", 0, 100, "INR"), ("mixed", 7 * DAY, 100, "USD"),
                 ("often", 0, 100, "INR"), ("often", DAY, 100, "INR"))
    got = recurrence.detect(p, 90 * DAY).collect()
    assert [(r.merchant_key, r.frequency, r.status, list(r.evidence_ids)) for r in got] == [("n", "MONTHLY", "SUSPECTED", [0, 1, 2])]
    assert got[0].confidence == pytest.approx(0.25 + 0.35 + 0.30) and got[0].estimated_next_ms == 90 * DAY
    assert recurrence.detect(p, 121 * DAY).first().status == "POSSIBLY_INACTIVE"


def test_dismissed_needs_new_evidence(spark):
    rest = "merchant_display string, frequency string, estimated_amount_minor long, currency string, last_payment_ms long, estimated_next_ms long, confidence double"
    more = lambda amount: ("M", "WEEKLY", amount, "INR", 1, 2, 0.5)
    found = spark.createDataFrame([(k, "SUSPECTED", e, *more(9)) for k, e in (("a", [1, 2]), ("b", [1, 2]), ("c", [1]), ("d", [1]))],
                                  f"merchant_key string, status string, evidence_ids array<long>, {rest}")
    old = spark.createDataFrame(
        [("1", "a", "DISMISSED", [1, 2], 1, 0, *more(5)), ("2", "b", "DISMISSED", [1], 1, 0, *more(5)), ("3", "c", "CONFIRMED", [1], 1, 0, *more(5)),
         ("8", "c", "DISMISSED", [1], 4, 0, *more(5)), ("9", "z", "CONFIRMED", [7], 3, 3, *more(5))],
        f"subscription_id string, merchant_key string, status string, evidence_ids array<long>, updated_at long, created_at long, {rest}")
    merged = recurrence.merge(found, old, 50)
    got = {r.merchant_key: (r.status, r.is_new, r.estimated_amount_minor, r.created_at, r.updated_at) for r in merged.collect()}
    assert got == {"a": ("DISMISSED", False, 5, 0, 1), "b": ("SUSPECTED", False, 9, 0, 50), "c": ("CONFIRMED", False, 9, 0, 50), "d": ("SUSPECTED", True, 9, 50, 50)}
    assert {r.subscription_id: r.merchant_key for r in merged.collect() if not r.is_new} == {"1": "a", "2": "b", "3": "c"}
    table = recurrence.merged_table(found, old, 50)
    assert table.count() == 6 and table.where("merchant_key = 'z'").first().updated_at == 3


def test_only_expenses_recur_and_hot_merchants_are_left_out_early(spark):
    rows = [(i, "m", d, t, s) for i, (d, t, s) in enumerate([("DEBIT", "NONE", "NONE"), ("CREDIT", "NONE", "NONE"), ("DEBIT", "SUSPECTED", "NONE"),
                                                            ("DEBIT", "NONE", "CONFIRMED"), ("DEBIT", "NONE", None)])] + [(9, None, "DEBIT", "NONE", "NONE")]
    tx = spark.createDataFrame(rows, "tx_id long, merchant_key string, direction string, transfer_status string, duplicate_status string")
    assert [r.tx_id for r in recurrence.eligible(tx).orderBy("tx_id").collect()] == [0, 4]
    assert [r.tx_id for r in recurrence.eligible(tx, tx.where("tx_id = 0")).collect()] == [4]
    hot = spark.range(5000).selectExpr("id as tx_id", "'hot' as merchant_key", "'hot' as merchant_display", "id * 3600000 as ts_ms", "100L as amount_minor", "'INR' as currency")
    p = hot.unionByName(payments(spark, ("n", 0, 100, "INR"), ("n", 7 * DAY, 110, "INR"), ("spread", 0, 100, "INR"), ("spread", 7 * DAY, 200, "INR")).withColumn("tx_id", F.col("tx_id") + 9000))
    assert {r.merchant_key for r in recurrence.plausible(p).collect()} == {"n"}
    assert [r.merchant_key for r in recurrence.detect(p, 8 * DAY).collect()] == ["n"]


@pytest.mark.parametrize("seed", range(3))
def test_leaving_out_changes_no_detection(spark, seed, monkeypatch):
    r = random.Random(seed)
    rows = []
    for m in range(60):
        t, gap = 0, r.choice([5, 6, 7, 9, 28, 33, 365])
        for _ in range(r.randrange(1, 8)):
            rows.append((f"m{m}", t, r.choice([100, 100, 100, 108, 116]), r.choice(["INR"] * 9 + ["USD"])))
            t += int(DAY * (gap + r.choice([0, 0, -1, 1, -4, 3])))
    p = payments(spark, *rows)
    got = sorted(map(str, recurrence.detect(p, 0).collect()))
    monkeypatch.setattr(recurrence, "plausible", lambda x: x.where("merchant_key is not null"))
    assert got == sorted(map(str, recurrence.detect(p, 0).collect()))


TX = "tx_id long, ts_ms long, amount_minor long, currency string, direction string, duplicate_status string, transfer_status string, merchant_key string, merchant_display string, category_id string"


def ledger(spark):
    rows = [(1, 1000, 10000, "INR", "DEBIT", "NONE", "NONE", "a", "A", "food"), (2, 2000, 5000, "INR", "DEBIT", "SUSPECTED", "NONE", "a", "A2", "fuel"),
            (3, 3000, 2000, "INR", "CREDIT", "NONE", "NONE", None, None, "x"), (4, 4000, 3000, "INR", "REFUND", "NONE", "NONE", "b", "B", "x"),
            (5, 10000, 20000, "INR", "TRANSFER", "NONE", "CONFIRMED", "b", "B", "x"), (6, 999, 7, "INR", "DEBIT", "NONE", "NONE", "c", "C", "x"),
            (7, 10001, 7, "INR", "DEBIT", "NONE", "NONE", "c", "C", "x")]
    return spark.createDataFrame(rows, TX)


def test_dashboard(spark):
    p = dashboard.with_role(dashboard.in_period(ledger(spark), 1000, 10000))
    assert dashboard.scalars(p, "INR").first().asDict() == {
        "gross_minor": 15000, "credits_minor": 2000, "refunds_minor": 3000, "transaction_count": 5, "net_minor": 12000}
    assert dashboard.by_merchant(p, "INR").collect() == [("a", "A2", 15000, 2)]
    assert [r.tx_id for r in dashboard.recent(p, 2).collect()] == [5, 4]
    excluded = dashboard.with_role(ledger(spark), spark.createDataFrame([(1,), (1,)], "tx_id long"))
    assert dashboard.scalars(excluded, "INR").first().gross_minor == 5014
    assert {(r.facet, r.member): r.total_minor for r in dashboard.facets(p, "INR").collect()} == {
        ("total", None): 15000, ("category", "food"): 10000, ("category", "fuel"): 5000, ("month", "1970-01"): 15000, ("merchant", "a"): 15000}


def test_subscription_totals(spark):
    s = spark.createDataFrame([("MONTHLY", 10000, "INR", "SUSPECTED"), ("YEARLY", 120000, "INR", "CONFIRMED"), ("MONTHLY", 5000, "INR", "DISMISSED"),
                               ("WEEKLY", None, "INR", "SUSPECTED")], "frequency string, estimated_amount_minor long, currency string, status string")
    assert dashboard.subscription_totals(s, "INR").first().asDict() == {"monthly_minor": 20000, "n_active": 3, "annual_minor": 240000}


def test_corrections(spark):
    c = spark.createDataFrame(
        [(1, 1, "CATEGORY", "travel", 5), (2, 1, "CATEGORY", "rubbish", 6), (3, 2, "MERCHANT", " PAYTM*Swiggy", 1), (4, 2, "DIRECTION", "XX", 1),
         (5, 3, "DIRECTION", "XX", 1), (6, 4, "DUPLICATE_STATUS", " none", 1), (7, 5, "DUPLICATE_STATUS", "CONFIRMED", 1), (8, 6, "NOT_A_TRANSACTION", "true", 1),
         (9, 7, "SUBSCRIPTION_STATUS", "DISMISSED", 1), (10, 2, "MERCHANT", "  ", 2)],
        "correction_id long, tx_id long, field_name string, new_value string, updated_at long")
    tx = ledger(spark).withColumn("possible_duplicate_of", F.lit(77))
    got = {r.tx_id: r for r in corrections.apply(tx, c).collect()}
    assert (got[1].category_id, got[1].is_user_confirmed, got[3].is_user_confirmed, got[6].is_user_confirmed, got[7].is_user_confirmed) == ("travel", True, False, True, False)
    assert (got[2].merchant_key, got[2].merchant_display, got[2].category_id, got[2].direction) == ("swiggy", "PAYTM*Swiggy", "fuel", "DEBIT")
    assert (got[4].duplicate_status, got[4].possible_duplicate_of) == ("NONE", None)
    assert (got[5].duplicate_status, got[5].possible_duplicate_of, got[1].possible_duplicate_of) == ("CONFIRMED", 77, 77)
    again = corrections.apply(corrections.apply(tx, c), c.limit(0))
    assert {r.tx_id for r in again.where("is_user_confirmed").collect()} == {1, 2, 4, 5, 6}
    subs = spark.createDataFrame([("c", "SUSPECTED"), ("a", "CONFIRMED")], "merchant_key string, status string")
    assert dict(corrections.apply_to_subscriptions(subs, tx, c).collect()) == {"c": "DISMISSED", "a": "CONFIRMED"}
    asked = c.withColumns({"apply_to_future": F.lit(True), "merchant_match_key": F.lit(None).cast("string")})
    outcome = dict(corrections.outcomes(asked.union(asked.limit(1).withColumn("tx_id", F.lit(99)).withColumn("correction_id", F.lit(99))), tx).collect())
    assert (outcome[1], outcome[2], outcome[5], outcome[9], outcome[99]) == ("APPLIED", "INVALID_VALUE", "INVALID_FUTURE_RULE", "APPLIED", "TRANSACTION_NOT_FOUND")


def test_queries(spark):
    tx = ledger(spark)
    assert [r.tx_id for r in TransactionQuery(start_ms=1000, direction="DEBIT", limit=2).run(tx).collect()] == [7, 2]
    assert {r.tx_id for r in TransactionQuery(search="a_").run(tx).collect()} == {2}
    assert TransactionQuery(search="").run(tx).count() == 7
    assert preset(30, 5) == (0, 5)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    a = spark.createDataFrame([(1, 10, 5), (2, 20, 5)], "id long, v long, created long")
    s.upsert("t", a, "id", kept=("created",))
    s.upsert("t", spark.createDataFrame([(2, 99, 7), (3, 30, 7)], a.schema), "id", kept=("created",))
    assert sorted(map(tuple, s.read("t").collect())) == [(1, 10, 5), (2, 99, 5), (3, 30, 7)]
    s.delete("t", spark.createDataFrame([(1,)], "id long"), "id")
    assert s.read("t").count() == 2
    s.append("t", spark.createDataFrame([(7, 7, 7)], a.schema), "x-1")
    s.append("t", spark.createDataFrame([(8, 8, 8)], a.schema), "x-1")
    assert {r.id for r in s.read("t").collect()} == {2, 3, 8} and {r.id for r in s.read("t", without="x-1").collect()} == {2, 3}
    s.vacuum("t")
    assert s.read("t").columns == ["id", "v", "created"] and s.read("t").count() == 3
    s.wipe("t", "absent")
    assert s.read("t").count() == 0 and s.read("absent") is None
    s.write("transactions", a)
    s.wipe_analysed()
    assert s.read("transactions").count() == 0
    assert upserted(a, a.limit(0), "id").count() == 2


def test_deletion_cascades_and_clears(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write("transactions", spark.createDataFrame([(1, None), (2, 1), (3, 2)], "tx_id long, possible_duplicate_of long"))
    s.write("user_corrections", spark.createDataFrame([(10, 1), (11, 3)], "correction_id long, tx_id long"))
    s.write("subscriptions", spark.createDataFrame([("a", [1, 2]), ("b", [1])], "subscription_id string, evidence_ids array<long>"))
    s.delete_transactions(spark.createDataFrame([(1,), (1,)], "tx_id long"))
    assert sorted(map(tuple, s.read("transactions").collect())) == [(2, None), (3, 2)]
    assert [r.correction_id for r in s.read("user_corrections").collect()] == [11]
    assert {r.subscription_id: list(r.evidence_ids) for r in s.read("subscriptions").collect()} == {"a": [2], "b": []}


def test_scan_lookups_and_cache(spark):
    st = spark.createDataFrame([(1, "RUNNING", 5, None), (2, "INTERRUPTED", 9, None), (3, "COMPLETED", 7, 6), (4, "COMPLETED", 8, 7)],
                               "scan_id long, status string, updated_at long, completed_at long")
    assert [f(st).first().scan_id for f in (scans.active, scans.resumable, scans.latest_completed)] == [1, 2, 4]
    assert scans.active(st.limit(0)).count() == 0
    p = dashboard.with_role(ledger(spark))
    cache = dashboard.cache_row(p, 0, 10_001, "INR", 1)
    got = dashboard.cached(cache, 0, 10_001).first()
    assert (got.gross_minor, list(got.recent_ids), [c.category_id for c in got.categories]) == (15014, [7, 5, 4, 3, 2, 1, 6], ["food", "fuel", "x"])
    assert dashboard.cached(cache, 0, 1).count() == 0 and dashboard.cached(cache.withColumn("payload", F.lit("{")), 0, 10_001).count() == 0


def test_support(spark):
    d = spark.createDataFrame([(1, "k", "p"), (2, "k", "p"), (3, "k", "q")], "seq long, idempotency_key string, payload string")
    assert [(r.status, r.stored) for r in support_outcome(d).orderBy("seq").collect()] == [(201, True), (201, False), (409, False)]
