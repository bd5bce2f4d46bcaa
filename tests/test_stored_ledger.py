"""The stored ledger: commits, the key index, scan state, failing messages, roll-ups, corrections, sinks that expire."""

import random
import re

import pytest
from pyspark.sql import functions as F

from passbook.operators import corrections, dashboard, dedupe, recurrence, rollup, scans
from passbook.plans import ledger, pipeline
from passbook.plans.pipeline import scan
from passbook.sources import keyindex
from passbook.sources.rules import REGRESSION
from passbook.sources.store import DAY_MS, Conflict, Store, violation
from passbook.streaming import ingest, telemetry


def put(spark, folder, rows, schema=ingest.SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def credit(i, ms=None, amount=None):
    return (i, "EXBANK", 1000 * i if ms is None else ms, f"Rs.{amount or i}.00 credited")


# the store


def test_of_two_writers_one_is_refused(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    a = spark.createDataFrame([(1,)], "id long")
    s.write("t", a)
    _, folders = s.manifest()
    s.write("u", a)  # another table's change is no conflict
    s.replace({"t": a.union(a)}, folders)
    with pytest.raises(Conflict):
        s.replace({"t": a, "u": a.limit(0)}, folders)
    assert (s.read("t").count(), s.read("u").count()) == (2, 1)
    s.upsert_all({"t": (a, "id", ()), "u": (spark.createDataFrame([(2,)], "id long"), "id", ())})
    assert s.read("u").count() == 2


def test_tables_by_day_open_what_is_asked_for(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(i, i * DAY_MS + 5) for i in range(1, 9)], "id long, ts_ms long")
    s.append("transactions", rows, "a")
    s.append("transactions", rows.where("id = 3").withColumn("id", F.lit(30).cast("long")), "b")
    got = s.read_days("transactions", [3, 5, 99])
    assert sorted(r.id for r in got.collect()) == [3, 5, 30] and len({f.split("day=")[1][0] for f in got.inputFiles()}) == 2
    assert {r.id for r in s.read_days("transactions", [3], without="b").collect()} == {3} and s.read_days("transactions", [99]) is None
    s.change_days("transactions", [3], lambda d: d.withColumn("id", F.col("id") + 100))
    assert sorted(r.id for r in s.read("transactions").collect()) == [1, 2, 4, 5, 6, 7, 8, 103, 130]
    s.drop_days("transactions", 5)
    assert sorted(r.id for r in s.read("transactions").collect()) == [5, 6, 7, 8]


# the key index


def keyed(spark, ids, day=1, reference=True):
    return spark.createDataFrame([(i, f"{i:032x}" * 2, f"{i + 10**9:032x}" * 2, "r" if reference and i % 2 else None, day * DAY_MS + i, day * DAY_MS + i) for i in ids],
                                 "seq long, source_hash string, fingerprint string, reference_hash string, ts_ms long, received_ms long")


def ancestors(plan, scanned):
    """The operators above the scan of a path, up to the first join, in a printed plan."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "Scan parquet" in x and scanned in x)
    depth, out = len(re.match(r"[\s:+-]*", lines[at]).group()), []
    for x in reversed(lines[:at]):
        d = len(re.match(r"[\s:+-]*", x).group())
        if d < depth:
            depth = d
            out.append(x.strip(" :+-"))
            if "Join" in x:
                break
    return out


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_index_tells_what_is_stored_without_moving_it(spark, tmp_path, small):
    index = keyindex.KeyIndex(Store(spark, str(tmp_path)), buckets=4, small=small)
    index.add(keyed(spark, range(50)), "a")
    index.add(keyed(spark, range(50), day=2).where("seq >= 40"), "b")
    assert {r.seq for r in index.unstored(keyed(spark, range(45, 60))).collect()} == set(range(50, 60))
    assert {r.seq for r in index.unstored(keyed(spark, range(60)), without="a").collect()} == set(range(60)) - {41, 43, 45, 47, 49}
    other = keyed(spark, range(45, 60), day=2).withColumn("source_hash", F.concat(F.lit("f" * 32), "source_hash"))
    assert {r.seq for r in index.unstored(other).collect()} == set(range(50, 60))  # by fingerprint: with a reference on any day
    kind = "" if small else "Sort"
    plan = index.known(keyed(spark, range(5)))._jdf.queryExecution().executedPlan().toString()
    if small == 0:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = index.known(keyed(spark, range(5)))._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = ancestors(plan, index.name)
    assert "Join" in above[-1] and not any("Exchange" in x for x in above) and kind in " ".join(above)
    assert index.spark.table(index.name).count() == 30
    opened = index.stored([1, 7]).inputFiles()
    assert opened and all("/day=1/" in f for f in opened)
    index.compact([1, 2])
    assert {r.seq for r in index.unstored(keyed(spark, range(45, 60))).collect()} == set(range(50, 60))


# scans


def test_no_body_is_shuffled(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(pipeline, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))) or df.checkpoint())
    scan(spark.createDataFrame([credit(1), credit(1), credit(2)], ingest.SCHEMA), REGRESSION)
    exchanges = [x for x in re.split(r"\n\(\d+\) ", plans[0]) if x.startswith("Exchange")]
    assert exchanges and not any("body" in x for x in exchanges)




def test_scan_reads_the_days_around(spark):
    asked = []
    earlier = pipeline.Earlier(lambda tx: tx, lambda days: asked.append(days))
    scan(spark.createDataFrame([credit(1, 3 * DAY_MS + 60_000), credit(2, 9 * DAY_MS + 40_000_000)], ingest.SCHEMA), REGRESSION, stored=earlier)
    assert asked == [[2, 3, 9]]
    assert dedupe.near_days(spark.createDataFrame([], "ts_ms long")) == []


def test_stored_rows_are_whole_and_sound(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    put(spark, tmp_path / "in", [credit(i) for i in range(1, 9)])
    assert ingest.run_scan(spark, str(tmp_path / "in"), s, REGRESSION, str(tmp_path / "ck"), clock=lambda: 77) == "COMPLETED"
    rows = s.read("transactions")
    assert rows.where(violation().isNotNull()).count() == 0
    assert {(r.tx_id == r.seq, r.parser_version, r.is_user_confirmed, r.created_at, r.updated_at) for r in rows.collect()} == {(True, REGRESSION.parser_version, False, 77, 77)}


def test_a_killed_scan_is_found_and_goes_on(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "store"))
    for k in range(3):
        put(spark, tmp_path / "in", [credit(10 * k + i) for i in range(1, 5)] + [(10 * k + 9, "EXBANK", 5, "")])
    append, batches = Store.append, []

    def dies(self, table, rows, part):
        if table == "scan_batches":
            batches.append(part)
            if len(batches) == 2:
                raise RuntimeError("killed before the state of the second batch is written")
        append(self, table, rows, part)

    monkeypatch.setattr(Store, "append", dies)
    with pytest.raises(Exception, match="killed"):
        ingest.ingest(spark, str(tmp_path / "in"), s, REGRESSION, str(tmp_path / "ck"), files_per_batch=1).awaitTermination()
    state = ingest.scan_states(s)
    assert [(r.status, r.processed, r.accepted, r.cursor) for r in state.collect()] == [("RUNNING", 5, 4, 9)]
    assert scans.resumable(state).first().scan_id == ingest.run_of(str(tmp_path / "ck"))
    assert ingest.run_scan(spark, str(tmp_path / "in"), s, REGRESSION, str(tmp_path / "ck"), files_per_batch=1) == "COMPLETED"
    state = ingest.scan_states(s)
    assert [(r.status, r.processed, r.accepted, r.failures, r.cursor) for r in state.collect()] == [("COMPLETED", 15, 12, 0, 29)]
    assert state.where(scans.violation().isNotNull()).count() == 0 and scans.resumable(state).count() == 0
    assert sorted(r.seq for r in s.read("transactions").collect()) == [i for i in range(30) if 1 <= i % 10 <= 4]


def test_cancelled_between_batches(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    for k in range(3):
        put(spark, tmp_path / "in", [credit(10 * k + 1)])
    assert ingest.run_scan(spark, str(tmp_path / "in"), s, REGRESSION, str(tmp_path / "ck"), files_per_batch=1, cancelled=lambda: True) == "CANCELLED"
    assert ingest.run_scan(spark, str(tmp_path / "in"), s, REGRESSION, str(tmp_path / "ck"), files_per_batch=1) == "COMPLETED"
    assert sorted(r.seq for r in s.read("transactions").collect()) == [1, 11, 21]


def test_pages_by_rows_resume_from_the_stored_cursor(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    source = spark.createDataFrame([credit(i) for i in range(1, 8)] + [(8, " ", 1, "x"), (9, "EXBANK", 99_000_000, "Rs.9.00 credited")], ingest.SCHEMA)
    asked = []
    how = {"start": 0, "end": 50_000_000, "limit": 3}
    assert ingest.scan_pages(source, s, REGRESSION, "p", **how, cancelled=lambda: (asked.append(1), len(asked) == 2)[1]) == "CANCELLED"
    assert sorted(r.seq for r in s.read("transactions").collect()) == [1, 2, 3]
    assert ingest.scan_pages(source, s, REGRESSION, "p", **how) == "COMPLETED"
    assert sorted(r.seq for r in s.read("transactions").collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert [(r.status, r.processed, r.accepted, r.cursor) for r in ingest.scan_states(s).collect()] == [("COMPLETED", 8, 7, 8)]
    assert [(r.batch, r.processed) for r in s.read("scan_batches").where("batch is not null").orderBy("batch").collect()] == [(0, 3), (1, 3), (2, 2)]


def test_pages_are_stored_in_runs_that_double(spark, tmp_path, monkeypatch):
    """Forty pages are a handful of batches, each row is taken once, and rows of one id stay together."""
    s, sizes = Store(spark, str(tmp_path / "store")), []
    source = spark.createDataFrame([credit(i) for i in range(1, 79)] + [credit(4, 4001), credit(90), (None, "EXBANK", 5, "Rs.1.00 credited")], ingest.SCHEMA).repartition(5)
    assert ingest.page_ends(source, 0, 50_000_000, None, 2)[:4] == [(1, 2), (3, 2), (4, 2), (6, 2)]
    assert ingest.page_ends(source, 0, 50_000_000, 78, 2) == [(90, 1)] and ingest.page_ends(source, 0, 50_000_000, 90, 2) == []

    def merger(*a):
        def merge(batch, number):
            ids = sorted(r.source_message_id or 0 for r in batch.collect())
            sizes.append((number, len(ids), ids[0], ids[-1]))
        return merge

    monkeypatch.setattr(ingest, "merger", merger)
    assert ingest.scan_pages(source, s, REGRESSION, "p", 0, 50_000_000, 2) == "COMPLETED"
    assert sizes == [(0, 2, 0, 1), (1, 2, 2, 3), (2, 4, 4, 6), (3, 8, 7, 14), (4, 16, 15, 30), (5, 32, 31, 62), (6, 17, 63, 90)]


def test_one_failing_message_stops_no_other(spark, tmp_path, monkeypatch):
    poison = lambda df: df.withColumn("body", F.when(F.col("source_message_id").isin(7, 1234), F.raise_error(F.lit("rule"))).otherwise(F.col("body")))
    monkeypatch.setattr(ingest, "scan", lambda batch, *a: scan(poison(batch), *a))
    runs = []
    s = Store(spark, str(tmp_path / "store"))
    put(spark, tmp_path / "in", [credit(i, amount=1 + i % 7) for i in range(1, 2001)])
    ingest.run_scan(spark, str(tmp_path / "in"), s, REGRESSION, str(tmp_path / "ck"),
                    parse=lambda b, r: (runs.append(1), poison(b).write.format("noop").mode("overwrite").save()))
    assert sorted((r.source_message_id, r.reason) for r in s.read("dead_letters").collect()) == [(7, "RULE_RUNTIME_ERROR"), (1234, "RULE_RUNTIME_ERROR")]
    assert "body" not in s.read("dead_letters").columns and len(runs) < 70
    assert [(r.status, r.processed, r.accepted, r.failures, r.cursor) for r in ingest.scan_states(s).collect()] == [("COMPLETED", 2000, 1998, 2, 2000)]
    good = spark.createDataFrame([credit(i, amount=1 + i % 7) for i in range(1, 2001) if i not in (7, 1234)], ingest.SCHEMA)
    assert {r.seq for r in s.read("transactions").collect()} == {r.seq for r in scan(good, REGRESSION).collect()}


def test_faults_of_all_messages_are_no_isolated_failures(spark):
    batch = spark.createDataFrame([credit(i) for i in range(12)], ingest.SCHEMA)

    def run(b):
        b.select(F.raise_error(F.lit("rules"))).collect()

    with pytest.raises(Exception, match="rules"):
        ingest.failing(batch, run, limit=3)
    assert ingest.failing(batch, lambda b: b.count()) == []


# roll-ups and corrections

TX = ("tx_id long, ts_ms long, amount_minor long, currency string, direction string, duplicate_status string, transfer_status string, "
      "merchant_key string, merchant_display string, category_id string, possible_duplicate_of long, is_user_confirmed boolean, updated_at long")
GIVEN = ("correction_id long, tx_id long, field_name string, new_value string, apply_to_future boolean, merchant_match_key string, updated_at long")


def random_tx(r, n=120):
    return [(i, r.randrange(40 * DAY_MS), r.randrange(1, 999), r.choice(["INR", "INR", "USD"]), r.choice(["DEBIT", "DEBIT", "CREDIT", "REFUND", "TRANSFER"]),
             r.choice(["NONE", "NONE", "CONFIRMED"]), r.choice(["NONE", "NONE", "SUSPECTED"]), *r.choice([("a", "A"), ("b", "B"), (None, None)]),
             r.choice(["food", "fuel"]), None, False, 0) for i in range(n)]


def random_corrections(r, first, n=30):
    return [(first + i, r.randrange(130), *r.choice([("CATEGORY", "travel"), ("CATEGORY", "no such"), ("DIRECTION", "debit"), ("MERCHANT", "Swiggy"), ("DUPLICATE_STATUS", "NONE"),
             ("DUPLICATE_STATUS", "CONFIRMED"), ("TRANSFER_STATUS", "NONE"), ("NOT_A_TRANSACTION", "true"), ("SUBSCRIPTION_STATUS", "DISMISSED")]), False, None, 100 * first + i) for i in range(n)]


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("seed", [1])
def test_corrections_carried_on_equal_a_fresh_start(spark, tmp_path, seed):
    r = random.Random(seed)
    own = ledger.Ledger(Store(spark, str(tmp_path), span=7))
    rows = random_tx(r)
    tx = spark.createDataFrame(rows, TX)
    own.add(spark.createDataFrame(rows[:70], TX), "1")
    own.add(spark.createDataFrame(rows[70:], TX), "2")
    given = []
    for k in range(2):
        new = random_corrections(r, 1000 * (k + 1))
        given += new
        for _ in range(2):  # a repeated call changes nothing
            outcome = own.correct(spark.createDataFrame(new, GIVEN), 5, f"c{k}")
        assert outcome.count() == len(new) and {x.outcome for x in outcome.collect()} >= {"APPLIED", "TRANSACTION_NOT_FOUND"}
    all_given = spark.createDataFrame(given, GIVEN)
    valid = all_given.join(corrections.outcomes(all_given, tx).where("outcome = 'APPLIED'"), "correction_id", "left_semi")
    fixed = dashboard.with_role(corrections.apply(tx, valid), corrections.excluded_ids(valid))
    stored = own.store.read("transactions")
    cols = [c for c in tx.columns if c != "updated_at"]
    assert same(stored.select(cols), fixed.select(cols))
    assert same(own.rollup().select(*rollup.KEY, "total_minor", "n"), rollup.daily(fixed).select(*rollup.KEY, "total_minor", "n"))
    for start, end in ((0, 40 * DAY_MS), (DAY_MS, 2 * DAY_MS - 1), (DAY_MS + 5, DAY_MS + 50_000_000), (3 * DAY_MS - 7, 29 * DAY_MS + 11)):
        period = dashboard.in_period(fixed, start, end)
        assert same(rollup.scalars(own.parts(start, end), "INR"), dashboard.scalars(period, "INR"))
        assert same(rollup.facets(own.parts(start, end), "INR"), dashboard.facets(period, "INR").where("n > 0 and total_minor is not null"))
    own.compact()
    assert same(own.rollup(), rollup.added(rollup.daily(fixed)))


def test_edges():
    assert rollup.whole_days(0, 2 * DAY_MS - 1) == (0, 1) and rollup.edges(0, 2 * DAY_MS - 1) == []
    assert rollup.edges(5, 2 * DAY_MS) == [0, 2] and rollup.edges(5, 9) == [0]


def test_dashboards_are_read_through_and_dropped(spark, tmp_path):
    own = ledger.Ledger(Store(spark, str(tmp_path), span=7))
    own.add(spark.createDataFrame([(1, 5, 100, "INR", "DEBIT", "NONE", "NONE", "a", "A", "food", None, False, 0),
                                   (2, 9 * DAY_MS, 30, "INR", "DEBIT", "NONE", "NONE", "a", "A", "food", None, False, 0)], TX), "1")
    early, late = (0, DAY_MS), (8 * DAY_MS, 10 * DAY_MS)
    assert own.dashboard(*early, 1).first().gross_minor == 100 and own.dashboard(*late, 1).first().gross_minor == 30
    # from the cache, whatever the tables say
    own.store.upsert("dashboard_cache", own.store.read("dashboard_cache").withColumn("payload", F.regexp_replace("payload", '"gross_minor":30', '"gross_minor":31')), "cache_key")
    assert own.dashboard(*late, 1).first().gross_minor == 31 and own.dashboard(*late, 1, use_cache=False).first().gross_minor == 30
    own.correct(spark.createDataFrame([(1, 2, "NOT_A_TRANSACTION", "true", False, None, 1)], GIVEN), 2, "c")
    assert [r.cache_key for r in own.store.read("dashboard_cache").collect()] == [f"{early[0]}:{early[1]}"]
    got = own.dashboard(*late, 3).first()
    assert (got.gross_minor, got.transaction_count, list(got.recent_ids)) == (0, 1, [2])
    own.store.upsert("dashboard_cache", own.store.read("dashboard_cache").withColumn("payload", F.lit("{")), "cache_key")
    assert own.dashboard(*early, 4).first().gross_minor == 100  # unreadable counts as absent


def test_only_touched_merchants_are_looked_at_again(spark, tmp_path):
    own = ledger.Ledger(Store(spark, str(tmp_path), span=400))
    rows = [(10 * m + i, (i * 30 + m) * DAY_MS, 500, "INR", "DEBIT", "NONE", "NONE", "ab"[m], "AB"[m], "food", None, False, 0) for m in range(2) for i in range(4)]
    own.add(spark.createDataFrame(rows, TX), "1")
    found = recurrence.detect(own.store.read("transactions").select(*ledger.PAYMENT), 1)
    merged = recurrence.merge(found, spark.createDataFrame([], "subscription_id string, merchant_key string, status string, created_at long, updated_at long, " + ", ".join(
        f"{c} {found.schema[c].dataType.simpleString()}" for c in recurrence.FOUND)), 1).drop("is_new")
    own.store.write("subscriptions", merged)
    own.correct(spark.createDataFrame([(1, 3, "NOT_A_TRANSACTION", "true", False, None, 1), (2, 0, "SUBSCRIPTION_STATUS", "CONFIRMED", False, None, 1)], GIVEN), 50, "c")
    got = {r.merchant_key: r for r in own.store.read("subscriptions").collect()}
    assert (got["a"].status, list(got["a"].evidence_ids), got["a"].updated_at) == ("CONFIRMED", [0, 1, 2], 50)
    assert (list(got["b"].evidence_ids), got["b"].updated_at) == ([10, 11, 12, 13], 1)


# sinks


EVENT = "event_id string, ts timestamp, event_type string, app_version string"


def test_ids_expire_in_the_telemetry_sink(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    for rows in ([("a", "2024-01-01 01:00:00", "x"), ("a", "2024-01-01 02:00:00", "y"), ("b", "2024-01-01 03:00:00", "y")],
                 [("a", "2024-01-31 00:59:59", "x"), ("b", "2024-01-31 03:00:00", "x")], [("a", "2024-01-31 01:00:00", "x"), ("b", "2024-02-01 05:00:00", "y")]):
        put(spark, tmp_path / "in", [(i, t, k, "v") for i, t, k in rows], EVENT.replace("timestamp", "string"))
        stream = spark.readStream.schema(EVENT.replace("timestamp", "string")).parquet(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("ts"))
        telemetry.sink(s, stream, str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.event_id, str(r.ts)[:10]) for r in s.read("telemetry_events").collect()) == [
        ("a", "2024-01-01"), ("a", "2024-01-31"), ("b", "2024-01-01"), ("b", "2024-01-31")]
    assert sorted(map(tuple, telemetry.stored_counts(s).collect())) == [("2024-01-01", "x", "v", 1), ("2024-01-01", "y", "v", 1), ("2024-01-31", "x", "v", 2)]
    telemetry.expire(s, 1_709_000_000_000)
    assert {str(r.ts)[:10] for r in s.read("telemetry_events").collect()} == {"2024-01-31"} and telemetry.stored_counts(s).count() == 3


def test_support_keys_expire(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    sent = "seq long, idempotency_key string, payload string"
    for now, rows in ((0, [(1, "k", "p"), (2, "k", "q"), (3, "k", "p")]), (13, [(4, "k", "p"), (5, "k", "q")]), (15, [(6, "k", "q")])):
        put(spark, tmp_path / "in", rows, sent)
        telemetry.support_sink(s, spark.readStream.schema(sent).parquet(str(tmp_path / "in")), str(tmp_path / "ck"), lambda now=now: (20_000 + now) * DAY_MS).awaitTermination()
    assert dict(s.read("support_outcomes").select("seq", "status").collect()) == {1: 201, 2: 409, 3: 201, 4: 201, 5: 409, 6: 201}
    assert sorted(r.seq for r in s.read("support_submissions").collect()) == [1, 6]


# search


def test_search_by_trigrams_equals_a_plain_search(spark, tmp_path):
    from passbook.operators import search
    from passbook.plans.query import TransactionQuery

    names = [("swiggy", "Swiggy"), ("swiggy", "SWIGGY Instamart"), ("a_b", "A_B%c"), ("ab", None), (None, "Ökostrom İst K"), ("cafe", "Café \\ Bar"), (None, None), ("xyxyxy", "xy")]
    rows = [(i, *names[i % len(names)]) for i in range(40)]
    schema = "tx_id long, merchant_key string, merchant_display string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "tx"))
    tx = spark.read.parquet(str(tmp_path / "tx"))
    known = search.dictionary(tx).checkpoint()
    postings = search.trigrams(known).checkpoint()
    for needle in ("swig", "SWIGGY", "gy ins", "a_b%c", "a_b", "b", "xyxyx", "É \\ b", "İst", "ist", "no such", "s%y%m", "%", "K"):
        got = sorted(r.tx_id for r in search.search(needle, tx, known, postings).collect())
        assert got == sorted(r.tx_id for r in TransactionQuery(search=needle).run(tx).collect()), needle
    plan = search.search("swig", tx, known, postings)._jdf.queryExecution().executedPlan().toString()
    assert "In(merchant_key" in plan or "EqualTo(merchant_key,swiggy)" in plan
    assert search.needed("ab%cde_fghi") == ["cde", "fgh", "ghi"]
