"""Rule documents, bundles, privacy, streams."""

import hashlib
import json

import pytest

from passbook.functions import privacy
from passbook.sources import rules
from passbook.sources.store import Store
from passbook.plans.pipeline import scan
from passbook.session import checkpoint_dir
from passbook.streaming import payloads, telemetry
from passbook.streaming.ingest import SCHEMA, ingest
from pyspark.sql import functions as F

DOC = {"schemaVersion": 1, "parserVersion": "p-1.0", "rulesVersion": "r", "institutions": [{"institution": "I", "senderPatterns": ["A"], "transactionPatterns": [
    {"id": "x", "type": "debit", "regex": r"(?:a)(b)\((?<amount>[(0-9]+)", "amountGroup": "amount"}]}]}


def changed(**pattern):
    doc = json.loads(json.dumps(DOC))
    doc["institutions"][0]["transactionPatterns"][0] |= pattern
    return json.dumps(doc)


def test_decoding_is_strict_and_groups_are_counted():
    p = rules.decode(json.dumps(DOC)).institutions[0].patterns[0]
    assert (p.direction, p.index("amount"), p.index("other")) == ("DEBIT", 2, None)
    for bad in (changed(type="GIFT"), changed(surprise=1)):
        with pytest.raises(ValueError):
            rules.decode(bad)
    assert rules.problems(rules.REGRESSION) == []
    assert rules.problems(rules.decode(changed(regex="(")))
    assert rules.problems(rules.decode(changed(dateGroup="d")))


def envelope(version="p-1.0", **changes):
    text = json.dumps(DOC | {"parserVersion": version})
    e = rules.Envelope(1, version, "r", "0.5.0", hashlib.sha256(text.encode()).hexdigest(), "sig", text)
    return rules.encode_envelope(rules.replace(e, **changes))


def test_one_bundle_is_active(spark, tmp_path):
    s = rules.BundleStore(Store(spark, str(tmp_path)))
    for v in ("1.1", "1.2"):
        s.install(envelope(v))
    s.activate("1.1")
    s.activate("1.2", 5)
    assert {v: b.status for v, b in s.bundles.items()} == {"1.1": "INSTALLED", "1.2": "ACTIVE"} and s.active().parser_version == "1.2"
    s.mark("1.1", "INVALID")
    with pytest.raises(ValueError):
        s.activate("1.1")
    again = rules.BundleStore(Store(spark, str(tmp_path)))
    assert again.bundles == s.bundles and again.active().parser_version == "1.2"
    table = rules.activated(s.metadata(spark), "1.1", 9)
    assert {r.parser_version: r.status for r in table.collect()} == {"1.1": "INVALID", "1.2": "ACTIVE"}
    assert rules.is_newer("bundled-2026.10", "2026.9.9") and not rules.is_newer("1.0", "1.0.0")


@pytest.mark.parametrize(("text", "reason"), [
    ("{", "MALFORMED_JSON"), (json.dumps({"schemaVersion": 1}), "MALFORMED_JSON"), (envelope(signature=" "), "INVALID_SCHEMA"),
    (envelope(schema_version=2), "INCOMPATIBLE_SCHEMA"), (envelope(minimum_app_version="9.0"), "INCOMPATIBLE_APP_VERSION"), (envelope(checksum="00"), "CHECKSUM_MISMATCH"),
    (envelope(signature="bad"), "SIGNATURE_INVALID"), (envelope(rules_version="other"), "VERSION_MISMATCH")])
def test_bundles_are_refused_in_order(text, reason):
    with pytest.raises(rules.Refused) as x:
        rules.checked(text, "1.0.0", lambda _, signature: signature == "sig")
    assert x.value.reason == reason


def test_unsound_bundles_fall_back():
    s = rules.BundleStore()
    s.install(envelope("2.0"))
    assert s.activate_verified("2.0")[1] is False
    s.bundles["2.0"] = rules.replace(s.bundles["2.0"], text="{}")
    found, fell_back = s.ensure_active()
    assert fell_back and found == rules.DEFAULT and s.bundles["2.0"].status == "ROLLBACK"
    assert s.activate_verified("2.0")[1] and s.bundles["2.0"].status == "INVALID" and s.bundles["2.0"].activated_at is None
    assert s.activate_verified("absent")[1]
    with pytest.raises(rules.Refused):
        rules.BundleStore(bundled="{").ensure_active()


def test_updates():
    package = envelope("2026.09.1")
    def manifest(**changes):
        return json.dumps({"schemaVersion": 1, "latestParserVersion": "2026.09.1", "latestRulesVersion": "r", "minimumAppVersion": "0.1",
                           "packageUrl": "https://x/p", "packageSha256": rules.sha256(package)} | changes)

    s, state = rules.BundleStore(), rules.UpdateState()
    go = lambda m, now=0, **k: rules.update(s, state, m, lambda _: package, now, **k)
    assert go(manifest(packageUrl="http://x")) == "FAILED" and go(manifest(packageSha256="0" * 64)) == "PACKAGE_CORRUPT"
    assert go(manifest(minimumAppVersion="3")) == "INCOMPATIBLE_APP_VERSION" and go(manifest(), 1) == "RECENTLY_CHECKED"
    assert go(manifest(schemaVersion=2), force=True) == "INCOMPATIBLE_SCHEMA"
    assert go(manifest(), rules.CHECK_INTERVAL_MS) == "UPDATED" and s.active().parser_version == "2026.09.1"
    assert go(manifest(), force=True) == "ALREADY_CURRENT" and go(manifest(latestParserVersion="2026.08"), force=True) == "ALREADY_CURRENT"
    assert state.highest_accepted == "2026.09.1"


def test_encoding_and_java_patterns(spark):
    assert rules.decode(rules.encode(rules.REGRESSION)) == rules.REGRESSION and rules.problems(rules.DEFAULT) == []
    assert rules.java_problems(spark, rules.DEFAULT) == []
    assert rules.java_problems(spark, rules.decode(changed(regex=r"(?P<amount>\d+)(?P=amount)"))) == ["x: not a Java pattern"]


def test_privacy(spark):
    d = spark.createDataFrame([("pay Rs. 5",), ("123456789012",), ("all fine",), (None,)], "t string")
    assert [r[0] for r in d.select(privacy.looks_secret(F.col("t"))).collect()] == [True, True, False, None]
    j = spark.createDataFrame([('{"a":[{"SMS body":1}]}',), ('{"ok":1}',), ("{",), (None,)], "t string")
    assert [r[0] for r in j.select(privacy.prohibited_key(F.col("t"))).collect()] == ["SMS body", None, None, None]
    deep = '{"a":' * 100_000 + '{"Sms-Body":1}' + "}" * 100_000
    j = spark.createDataFrame([(deep,), ('{"x":{"body":1},"sms":2}',), ('[[{"k":[{"UPI":0}]}]]',)], "t string")
    assert [r[0] for r in j.select(privacy.prohibited_path(F.col("t"))).collect()] == ["Sms-Body", "x.body", "[0].[0].k.[0].UPI"]


def test_ingest_resumes_and_repeats_nothing(spark, tmp_path):
    def put(n, *items):
        spark.createDataFrame([(i, "EXBANK", 1000 * i, f"Rs.{i}.00 credited") for i in items], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    store = Store(spark, str(tmp_path / "store"))
    for items, total in (((1, 2), 2), ((2, 3), 3), ((), 3)):
        if items:
            put(0, *items)
        ingest(spark, str(tmp_path / "in"), store, rules.REGRESSION, str(tmp_path / "ck")).awaitTermination()
        assert store.read("transactions").count() == total
    assert "body" not in store.read("transactions").columns


@pytest.mark.parametrize("ids", [(1, 2), (2, 1)])
def test_ingest_finds_near_copies_of_earlier_batches(spark, tmp_path, ids):
    store = Store(spark, str(tmp_path / "store"))
    for i, ms in zip(ids, (600_000, 2_000_000), strict=True):
        spark.createDataFrame([(i, "EXBANK", ms, "Rs.7.00 credited")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), store, rules.REGRESSION, str(tmp_path / "ck")).awaitTermination()
    got = {r.seq: (r.duplicate_status, r.possible_duplicate_of) for r in store.read("transactions").collect()}
    assert got == {ids[0]: ("NONE", None), ids[1]: ("SUSPECTED", ids[0])}


@pytest.mark.parametrize("cuts", [(), (7,), (3, 8, 11)])
def test_any_batches_store_what_one_does(spark, tmp_path, cuts):
    rows = [(i, "EXBANK", 400_000 * (i // 2) + 1000 * i, f"Rs.{7 + i % 3}.00 credited") for i in range(16)]
    store = Store(spark, str(tmp_path / "store"))
    for lo, hi in zip((0, *cuts), (*cuts, len(rows)), strict=True):
        spark.createDataFrame(rows[lo:hi], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), store, rules.REGRESSION, str(tmp_path / "ck"), files_per_batch=1).awaitTermination()
    got = sorted((r.seq, r.duplicate_status, r.possible_duplicate_of) for r in store.read("transactions").collect())
    whole = scan(spark.createDataFrame(rows, SCHEMA), rules.REGRESSION)
    assert got == sorted((r.seq, r.duplicate_status, r.possible_duplicate_of) for r in whole.collect()) and any(x[2] is not None for x in got)


def test_telemetry_sink_repeats_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    schema = "event_id string, ts timestamp, event_type string, app_version string"
    for n in range(2):
        spark.sql(f"select * from values ('a', timestamp'2024-01-01 01:00:00', 'x', 'v1'), ('b{n}', timestamp'2024-01-02 03:00:00', 'x', 'v1') as t(event_id, ts, event_type, app_version)"
                  ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            telemetry.sink(store, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, telemetry.stored_counts(store).collect())) == [("2024-01-01", "x", "v1", 1), ("2024-01-02", "x", "v1", 2)]


def test_payloads(spark):
    u = "00000000-0000-4000-8000-000000000001"
    ok = {"schemaVersion": 1, "batchId": u, "events": [{"eventId": u, "occurredAt": "t", "eventType": "app_error"}]}
    bodies = [json.dumps(ok), "[]", None, json.dumps(ok | {"events": [ok["events"][0]] * 51}), json.dumps(ok | {"events": [7]}), json.dumps(ok | {"schemaVersion": True})]
    r = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, body string")
    got = {x.n: x.problem and x.problem.field for x in payloads.telemetry_checked(r).collect()}
    assert got == {0: None, 1: None, 2: None, 3: "events", 4: "events[0]", 5: "schemaVersion"}
    assert [x.problem is None for x in payloads.telemetry_checked(r).orderBy("n").collect()] == [True] + [False] * 5
    assert payloads.telemetry_checked(r, max_bytes=10).where("n = 0").first().problem.code == "PAYLOAD_TOO_LARGE"


def test_no_local_checkpoints_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        checkpoint_dir(Session)


def test_telemetry_stream_counts_each_event_once(spark, tmp_path):
    rows = spark.sql("""select * from values ('a', timestamp'2024-01-01 01:00:00', 'x', 'v1'), ('a', timestamp'2024-01-01 02:00:00', 'x', 'v1'),
        ('b', timestamp'2024-01-01 03:00:00', 'x', 'v1') as t(event_id, ts, event_type, app_version)""")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = telemetry.daily_counts_stream(stream).writeStream.format("memory").queryName("daily").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("daily").collect() == telemetry.daily_counts(rows).collect() == [("2024-01-01", "x", "v1", 2)]
