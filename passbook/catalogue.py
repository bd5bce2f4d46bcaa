"""All queries of the ledger engine by name; each applies one operator to the fixture tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.functions import display, lexicon, privacy, text
from passbook.operators import classify, corrections, dashboard, dedupe, messages, recurrence, rollup, rulebook, scans, search
from passbook.oracles import COPY_ID, COPY_MS, END, NEEDLES, NOW, OFF_END, OFF_START, ORACLES, SCAN_RULES, START
from passbook.plans import ledger, pipeline
from passbook.plans.query import TransactionQuery
from passbook.session import checkpoint_dir, checkpointed
from passbook.sources import adapters, rules, store
from passbook.sources.rules import REGRESSION
from passbook.streaming import ingest, payloads, telemetry

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _of(f: Callable[[DataFrame], DataFrame], source: Query, name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(source(spark, sf_dir))

    run.__name__ = name
    QUERIES[name] = run


def _pick(values, index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# dashboards


def _period(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = corrections.excluded_ids(adapters.corrections(spark, sf_dir))
    return dashboard.with_role(dashboard.in_period(adapters.tx_orders(spark, sf_dir), START, END), excluded)


for _name, _f in (("dash_scalars", dashboard.scalars), ("dash_by_category", dashboard.by_category), ("dash_by_month", dashboard.by_month),
                  ("dash_by_merchant", dashboard.by_merchant), ("dash_grouping_sets", dashboard.facets)):
    _of(lambda tx, f=_f: f(tx, "INR"), _period, _name)
_of(lambda tx: dashboard.recent(tx.select("tx_id", "ts_ms", "amount_minor", "role"), 10), _period, "dash_recent_topk")


@query
def dash_exclude_suspected(spark, sf_dir):
    tx = dashboard.with_role(adapters.tx_orders(spark, sf_dir), exclude_suspected=True)
    return tx.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("total_minor"))


# transaction queries


@query
def tx_query_filters(spark, sf_dir):
    q = TransactionQuery(START, END, direction="DEBIT", payment_method="CARD", limit=100)
    return q.run(adapters.tx_orders(spark, sf_dir)).select("tx_id", "ts_ms", "amount_minor", "direction", "payment_method")


@query
def tx_search_like(spark, sf_dir):
    return TransactionQuery(search="#0000_01").run(adapters.tx_orders(spark, sf_dir)).select("tx_id", "merchant_display")


@query
def tx_search_index(spark, sf_dir):
    """Several needles, wildcards and short ones among them, by the trigram index of the merchants."""
    tx = adapters.tx_orders(spark, sf_dir)
    names = checkpointed(search.dictionary(tx))
    postings, found = checkpointed(search.trigrams(names)), None
    for needle in NEEDLES:
        own = search.search(needle, tx, names, postings).select(F.lit(needle).alias("needle"), "tx_id")
        found = own if found is None else found.union(own)
    return found


@query
def tx_merchant_drill(spark, sf_dir):
    return TransactionQuery(start_ms=START, merchant_key="customer#000000010").run(adapters.tx_orders(spark, sf_dir)).select(
        "tx_id", "ts_ms", "amount_minor")


@query
def tx_point_lookups(spark, sf_dir):
    wanted = _events(spark, sf_dir).select((F.col("event_id") * 7).alias("tx_id"))
    return adapters.tx_orders(spark, sf_dir).join(wanted, "tx_id", "left_semi").select("tx_id", "amount_minor", "currency")


# messages


def _page(spark, sf_dir):
    return messages.keyset_page(adapters.messages(spark, sf_dir), 1_704_100_000_000, 1_706_000_000_000, 100, 100)


_of(lambda p: p.select("source_message_id", "sender"), _page, "msg_keyset_page")
_of(lambda p: messages.page_state(p, 100), _page, "msg_page_state")


def _raw(spark, sf_dir):
    """Messages of which some lack a sender, a time or a body."""
    m = adapters.messages(spark, sf_dir)
    n = F.col("source_message_id")
    return m.select(n, F.when(n % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "sender")).alias("sender"),
                    F.when(n % 6 == 0, -1).otherwise(F.col("received_ms")).alias("received_ms"),
                    F.when(n % 7 == 0, "").when(n % 35 != 1, F.col("body")).alias("body"))


_of(lambda m: messages.mapped(m).select("source_message_id", "sender", "received_ms"), _raw, "msg_malformed")
_of(lambda m: messages.page_state(messages.keyset_page(m, -1, 1_800_000_000_000, 100, 101), 101), _raw, "msg_page_malformed")
_of(lambda m: messages.filtered(m, REGRESSION).select("source_message_id", "reject_reason"), _raw, "msg_filter_malformed")


def _filtered(spark, sf_dir):
    return messages.filtered(adapters.messages(spark, sf_dir), REGRESSION)


def _accepted(spark, sf_dir):
    return _filtered(spark, sf_dir).where("reject_reason is null").drop("reject_reason")


_of(lambda m: m.select("source_message_id", "reject_reason"), _filtered, "msg_filter")
_of(lambda m: m.select("source_message_id", messages.sender_known(F.col("sender"), REGRESSION.senders()).alias("sender_known")),
    adapters.messages, "msg_sender_match")
_of(lambda m: messages.extractions(m, REGRESSION).select(
    "source_message_id", "rule_id", "institution", "direction", "amount_minor", "currency", "merchant", "reference_hash", "ts_ms"),
    _accepted, "msg_extract")
_of(lambda m: messages.extractions(m, REGRESSION).select(
    "source_message_id", "rule_id", F.round("confidence", 6).alias("confidence")), _accepted, "msg_confidence")
_of(lambda m: rulebook.extractions(m, REGRESSION).select(
    "source_message_id", "rule_id", "institution", "direction", "amount_minor", "currency", "merchant", "reference_hash", "ts_ms"),
    _accepted, "msg_extract_indexed")
_of(lambda m: messages.outcomes(m, REGRESSION).select(
    "source_message_id", "parse_status", "parse_reason", F.when(F.col("parse_status") == "SUCCESS", F.col("rule_id")).alias("rule_id")),
    _accepted, "msg_outcome")
_of(lambda m: m.select("source_message_id", text.payment_method(F.col("body")).alias("payment_method")), adapters.messages, "msg_payment_method")
_of(lambda m: m.select("source_message_id", messages.source_hash().alias("source_hash")), adapters.messages, "msg_source_hash")
_of(lambda m: pipeline.counters(m, REGRESSION), _raw, "scan_counters")

#: Messages of a page.
PAGE = 6_000
SCANNED = ("seq", "source_hash", "fingerprint", "amount_minor", "direction", "merchant_key", "merchant_display", "category_id", "transfer_status",
           "role", "duplicate_status", "possible_duplicate_of")


def _scan_rules(spark):
    return spark.createDataFrame([(i, i, f, v, True, k, t) for i, (f, v, k, t) in enumerate(SCAN_RULES)], (
        "correction_id long, tx_id long, field_name string, new_value string, apply_to_future boolean, merchant_match_key string, updated_at long"))


def _copies(m):
    """Every third message once more, ten minutes later: exact repeats and near ones."""
    return m.where("source_message_id % 3 = 0").withColumns({
        "source_message_id": F.col("source_message_id") + COPY_ID, "received_ms": F.col("received_ms") + COPY_MS})


@query
def scan_pipeline(spark, sf_dir):
    """The whole scan in one batch."""
    m = adapters.messages(spark, sf_dir)
    return pipeline.scan(m.unionByName(_copies(m)), REGRESSION, _scan_rules(spark)).select(*SCANNED)


@query
def scan_two_batches(spark, sf_dir):
    """The same in two batches, the second against what the first has stored."""
    m = adapters.messages(spark, sf_dir)
    first = checkpointed(pipeline.scan(m, REGRESSION, _scan_rules(spark)))
    return first.unionByName(pipeline.scan(_copies(m), REGRESSION, _scan_rules(spark), stored=first)).select(*SCANNED)


@query
def tx_violations(spark, sf_dir):
    n = F.col("tx_id")
    tx = adapters.tx_orders(spark, sf_dir).withColumns({
        "amount_minor": F.when(n % 11 != 0, F.col("amount_minor")).otherwise(-n), "possible_duplicate_of": F.when(n % 5 == 0, n - 1),
        "confidence": F.when(n % 9 == 0, 1.5).otherwise(0.5), "created_at": F.col("ts_ms"), "updated_at": F.col("ts_ms") + n % 4 - 1})
    return tx.select("tx_id", store.violation().alias("violation"))


# the stored ledger


def _root(spark: SparkSession) -> str:
    """A new folder of its own, shared by driver and executors."""
    return f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"


def _ingested(spark, sf_dir):
    """A store that took the messages and then their copies, in two runs from one checkpoint."""
    root, m = _root(spark), adapters.messages(spark, sf_dir)
    s = store.Store(spark, f"{root}/store")
    for part in (m, _copies(m)):
        # small files, so that a batch of them is dealt over all cores: the parse takes far longer than the read
        part.write.mode("append").option("maxRecordsPerFile", 50_000).parquet(f"{root}/in")
        ingest.run_scan(spark, f"{root}/in", s, REGRESSION, f"{root}/checkpoint", corrections=_scan_rules(spark))
    return s


@query
def ingest_store(spark, sf_dir):
    """What ingestion in several batches has stored, exact and near repeats found by the key index and by days."""
    return _ingested(spark, sf_dir).read("transactions").select(*SCANNED)


@query
def scan_in_pages(spark, sf_dir):
    """The same messages in pages by id, cancelled after the first page and resumed from the stored cursor."""
    s, m = store.Store(spark, f"{_root(spark)}/store"), adapters.messages(spark, sf_dir)
    both, asked = m.unionByName(_copies(m)), []
    for stop in (2, 1_000_000):
        ingest.scan_pages(both, s, REGRESSION, "pages", 0, 1 << 60, PAGE, _scan_rules(spark), cancelled=lambda: (asked.append(1), len(asked) == stop)[1])
    return s.read("transactions").select(*SCANNED)


@query
def ingest_rows_are_sound(spark, sf_dir):
    """Violations among the stored rows (none), and how many of them there are."""
    rows = _ingested(spark, sf_dir).read("transactions")
    return rows.groupBy(store.violation().alias("violation")).agg(F.count(F.lit(1)).alias("n"))


@query
def ingest_scan_state(spark, sf_dir):
    """The state that the batches of a scan have left, from metrics observed while they ran."""
    return ingest.scan_states(_ingested(spark, sf_dir)).select("status", "processed", "accepted", "failures", "cursor")


def _ledger(spark, sf_dir):
    """A ledger with the orders as transactions, added in two parts, those excluded that are no transactions, and a dashboard in its cache."""
    own = ledger.Ledger(store.Store(spark, _root(spark), span=400))
    own.store.write("user_corrections", adapters.corrections(spark, sf_dir).where("field_name = 'NOT_A_TRANSACTION'"))
    tx = _pointing(spark, sf_dir).withColumns({"is_user_confirmed": F.lit(False), "updated_at": F.lit(0).cast("long")})
    for k in range(2):
        own.add(tx.where(F.col("tx_id") % 2 == k), f"part-{k}")
    own.recompute(START, END, NOW)
    return own


_of(lambda own: rollup.facets(own.parts(OFF_START, OFF_END), "INR"), _ledger, "dash_rollup")
_of(lambda own: rollup.scalars(own.parts(OFF_START, OFF_END), "INR"), _ledger, "dash_rollup_scalars")


def _corrected(spark, sf_dir):
    own = _ledger(spark, sf_dir)
    own.correct(adapters.corrections(spark, sf_dir), NOW, "corrections")
    return own


_of(lambda own: rollup.facets(own.parts(OFF_START, OFF_END), "INR"), _corrected, "correction_flow")
_of(lambda own: own.store.read("transactions").select(
    "tx_id", "merchant_key", "merchant_display", "category_id", "direction", "duplicate_status", "possible_duplicate_of", "transfer_status",
    "is_user_confirmed"), _corrected, "correction_flow_rows")


@query
def correction_flow_dashboard(spark, sf_dir):
    """The cached dashboard after corrections: the old one is dropped, the new one computed from the roll-up."""
    return _corrected(spark, sf_dir).dashboard(START, END, NOW).select(
        "gross_minor", "credits_minor", "refunds_minor", "transaction_count", "net_minor", F.size("months").cast("long").alias("n_months"))


# scalar functions


@query
def display_format(spark, sf_dir):
    tx = adapters.tx_orders(spark, sf_dir).withColumn("amount_minor", F.col("amount_minor") * F.pow(F.lit(10), F.col("tx_id") % 6).cast("long"))
    return tx.select("tx_id", display.money(F.col("amount_minor"), F.col("currency")).alias("money"), display.date(F.col("ts_ms")).alias("day"),
                     display.date_time(F.when(F.col("tx_id") % 3 != 0, F.col("ts_ms"))).alias("at"), display.percent((F.col("tx_id") % 101) / 100).alias("share"))


@query
def amount_parse(spark, sf_dir):
    n = F.col("event_id")
    raw = F.concat(_pick((" 1,234.5", "12", "7.05 ", "1.234", "abc", "", "99999999999999999999", "1 000.10"), n % 8 + 1),
                   F.when(n % 8 == 1, n.cast("string")).otherwise(""))
    return _events(spark, sf_dir).select(n, text.amount_minor(raw).alias("amount_minor"))


@query
def currency_parse(spark, sf_dir):
    raw = _pick((" rs. ", "₹", "Rupees", "inr5", "usd", "U.S.D", "12", ""), F.col("event_id") % 8 + 1)
    return _events(spark, sf_dir).select("event_id", text.currency_code(raw).alias("currency"))


@query
def date_parse(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    forms = [F.date_format(t, "dd-MM-yyyy"), F.date_format(t, "dd/MM/yyyy HH:mm"), F.date_format(t, "dd/MM/yy"),
             F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("31-02-2026"), F.lit("32-01-2026"), F.lit("2026-02-31"), F.date_format(t, "yyyy-MM-dd")]
    raw = F.element_at(F.array(*forms), (F.col("event_id") % 8 + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", text.date_millis(raw).alias("millis"))


@query
def version_order(spark, sf_dir):
    n, u = F.col("event_id"), F.col("user_id")
    a = F.concat(F.lit("bundled-2026."), (n % 12).cast("string"), F.lit("."), (u % 3).cast("string"))
    b = F.when(n % 5 == 0, "next").otherwise(F.concat(F.lit("2026."), (n % 7).cast("string")))
    return _events(spark, sf_dir).select(n, text.version_compare(a, b).alias("ordering"))


@query
def version_order_long(spark, sf_dir):
    """Versions that differ in their 18th part, if at all."""
    n, u = F.col("event_id"), F.col("user_id")
    head = F.concat(F.lit("1"), F.repeat(F.lit(".0"), 16), F.lit("."))
    return _events(spark, sf_dir).select(n, text.version_compare(F.concat(head, (n % 4).cast("string")), F.concat(head, (u % 3).cast("string"))).alias("ordering"))


@query
def app_version_check(spark, sf_dir):
    n, u = F.col("event_id"), F.col("user_id")
    current = F.concat((n % 3).cast("string"), F.lit("."), (u % 4).cast("string"), F.when(n % 5 == 0, "-beta.1").when(n % 7 == 0, ".x").otherwise("+7"))
    return _events(spark, sf_dir).select(n, text.app_version_fits(current, F.lit("1.2.0")).alias("fits"))


# classification


def _merchants(spark, sf_dir):
    n = F.col("event_id")
    raws = [F.concat(F.lit("  PAYTM*"), "event_type", F.lit(" ")), F.lit("www.Swiggy"), F.lit("AMZN"), F.lit("coffee@oksbi"), F.lit("@@ !!"), F.lit("  "),
            F.lit("City   Cafe"), F.lit("my account"), F.concat(F.lit("Airtel-"), F.col("user_id").cast("string")), F.lit("GPay/ Uber  ")]
    e = _events(spark, sf_dir).select(
        n, F.element_at(F.array(*raws), (n % 10 + 1).cast("int")).alias("raw"),
        F.when(n % 3 == 0, _pick(lexicon.DIRECTIONS, n % 5 + 1)).otherwise("DEBIT").alias("direction"),
        _pick(adapters.METHODS, n % 7 + 1).alias("payment_method")).withColumn("m", classify.merchant_struct(F.col("raw")))
    e = e.select("event_id", "direction", "payment_method", F.col("m.key").alias("merchant_key"), F.col("m.display").alias("merchant_display"),
                 F.col("m.raw_normalized").alias("merchant_raw"))
    e = e.withColumn("words", classify.haystack(F.col("merchant_key"), F.col("merchant_display"), F.col("merchant_raw")))
    return e.withColumn("transfer_status", classify.transfer_status(F.col("direction"), F.col("words")))


def _category() -> F.Column:
    return classify.category(*[F.col(c) for c in ("direction", "payment_method", "transfer_status", "merchant_key", "words")])


_of(lambda m: m.select("event_id", "merchant_key", "merchant_display", "merchant_raw"), _merchants, "merchant_normalize")
_of(lambda m: m.select("event_id", "transfer_status", classify.spending_role(F.col("direction"), F.col("transfer_status")).alias("role")).select(
    "*", *[c.alias(k) for k, c in classify.inclusion_flags(F.col("role")).items()]), _merchants, "semantics_role")
_of(lambda m: m.select("event_id", _category().alias("category_id")), _merchants, "categorise")


@query
def merchant_resolve(spark, sf_dir):
    m = _merchants(spark, sf_dir)
    shown = F.concat("merchant_display", F.lit(" ("), F.col("event_id").cast("string"), F.lit(")"))
    stored = m.where("event_id % 2 = 0").select("merchant_key", shown.alias("merchant_display"), F.col("event_id").alias("tx_id"), F.lit(0).alias("ts_ms"))
    return classify.resolved_merchants(m, stored).select("event_id", F.col("resolved_display").alias("display"))


@query
def future_rule_overlay(spark, sf_dir):
    tx, rules = adapters.tx_orders(spark, sf_dir), classify.future_rules(adapters.corrections(spark, sf_dir))
    return tx.join(rules, tx["merchant_key"] == rules["merchant_match_key"]).select(
        "tx_id", F.coalesce("rule_direction", "direction").alias("direction"), "rule_category",
        F.coalesce("rule_merchant", "merchant_display").alias("merchant_display"))


@query
def category_seed_join(spark, sf_dir):
    counts = _merchants(spark, sf_dir).groupBy(_category().alias("c")).agg(F.count(F.lit(1)).alias("k"))
    seed = store.seed_categories(spark)
    return store.categories_in_order(seed.join(counts, seed["category_id"] == counts["c"], "left").select(
        "category_id", "name", "sort_order", F.coalesce("k", F.lit(0)).alias("n")))


@query
def category_seed_insert(spark, sf_dir):
    """The categories that merchants have are stored already, in an order of the user's own; the seed adds the others."""
    stored = _merchants(spark, sf_dir).groupBy(_category().alias("category_id")).agg((F.count(F.lit(1)) + 100).cast("int").alias("sort_order"))
    return store.inserted_or_ignored(stored, store.seed_categories(spark).select("category_id", "sort_order"), "category_id")


# duplicates


def _fingerprinted(spark, sf_dir):
    return adapters.tx_events(spark, sf_dir).withColumn("fingerprint", dedupe.fingerprint())


_of(lambda t: t.select("seq", "fingerprint"), _fingerprinted, "fingerprint")
_of(lambda t: dedupe.first_of_each(t).select("seq", "ts_ms"), _fingerprinted, "dedupe_exact")
_of(lambda t: dedupe.first_by_window(t).select("seq", "place"), _fingerprinted, "dedupe_rank")
_of(lambda t: dedupe.near_matches(dedupe.first_of_each(t)), _fingerprinted, "dedupe_near")
_of(lambda t: dedupe.decide(t).select("seq", "decision", "duplicate_status", "points_to"), adapters.tx_events, "dedupe_decision")


@query
def dedupe_decision_stored(spark, sf_dir):
    """Against stored rows and with the user's say on near duplicates."""
    t = _fingerprinted(spark, sf_dir)
    override = F.when(F.col("seq") % 5 == 0, "NONE").when(F.col("seq") % 5 == 1, "CONFIRMED")
    incoming = t.where("seq % 3 <> 0").withColumn("duplicate_override", override)
    return dedupe.decide(incoming, stored=t.where("seq % 3 = 0")).select("seq", "decision", "duplicate_status", "points_to")


_of(lambda t: dedupe.unstored(t.where("seq % 3 <> 0"), t.where("seq % 3 = 0")).select("seq"), _fingerprinted, "dedupe_unstored")


@query
def duplicate_pointer_join(spark, sf_dir):
    kept = dedupe.first_of_each(_fingerprinted(spark, sf_dir))
    near = dedupe.near_matches(kept)
    target = kept.select(F.col("seq").alias("t_seq"), F.col("ts_ms").alias("near_ts_ms"))
    return near.join(target, near["near_seq"] == target["t_seq"]).select("seq", "near_seq", "near_ts_ms")


# recurrence


def _payments(spark, sf_dir):
    name = F.concat_ws(" ", "merchant_key", (F.col("seq") % 3).cast("string"))  # three series of each, weeks apart
    e = adapters.tx_events(spark, sf_dir).select(
        F.col("seq").alias("tx_id"), name.alias("merchant_key"), name.alias("merchant_display"), "ts_ms", "amount_minor", "currency")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    return e.unionByName(o.select(
        F.col("o_orderkey").alias("tx_id"), key.alias("merchant_key"), key.alias("merchant_display"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"), (F.col("o_orderkey") % 3 * 100 + 9900).cast("bigint").alias("amount_minor"),
        F.lit("INR").alias("currency")))


def _subscriptions(spark, sf_dir):
    return recurrence.detect(_payments(spark, sf_dir), NOW)


_of(lambda p: recurrence.intervals(p).select("tx_id", "merchant_key", F.round("interval_days", 9).alias("interval_days")), _payments, "recur_intervals")
_of(lambda s: s.select("merchant_key", "frequency", "estimated_amount_minor", "currency", "last_payment_ms", "estimated_next_ms",
                       F.round("confidence", 6).alias("confidence"), "status", F.size("evidence_ids").cast("bigint").alias("n_evidence")),
    _subscriptions, "recur_detect")
_of(lambda s: dashboard.subscription_totals(s, "INR"), _subscriptions, "sub_totals")
_of(lambda s: dashboard.suspected(s).select("merchant_key", "status", F.round("confidence", 6).alias("confidence"), F.col("n_evidence").cast("bigint").alias("n_evidence")),
    _subscriptions, "sub_list")
_of(lambda s: s.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("merchant_key").alias("first_key")), _subscriptions, "status_partition")
_of(lambda s: recurrence.by_status(s).select("status", "merchant_key", F.round("confidence", 6).alias("confidence")), _subscriptions, "status_lists")


@query
def recur_eligible(spark, sf_dir):
    excluded = corrections.excluded_ids(adapters.corrections(spark, sf_dir))
    return recurrence.eligible(adapters.tx_orders(spark, sf_dir), excluded).select("tx_id", "merchant_key", "amount_minor")


@query
def dash_top_lists(spark, sf_dir):
    lists = dashboard.top_lists(_period(spark, sf_dir), _subscriptions(spark, sf_dir), "INR")
    return lists.select("list", "place", "member", F.round("measure", 6).alias("measure"))


@query
def dash_cache(spark, sf_dir):
    """What is read back from the cached JSON of a period: its scalars, and how long its lists are."""
    cache = dashboard.cache_row(_period(spark, sf_dir), START, END, "INR", NOW)
    both = cache.union(cache.withColumn("cache_key", F.lit("other")))
    return dashboard.cached(both, START, END).select(
        "gross_minor", "credits_minor", "refunds_minor", "transaction_count", "net_minor", F.aggregate(
            "categories", F.lit(0).cast("long"), lambda a, x: a + x["total_minor"]).alias("in_categories"),
        F.size("months").cast("long").alias("n_months"), F.get("recent_ids", F.lit(0)).alias("latest_id"))


@query
def recur_merge(spark, sf_dir):
    found = checkpointed(_subscriptions(spark, sf_dir))  # looked at three times
    first, n = F.element_at("evidence_ids", 1), F.size("evidence_ids")
    stored = found.where(first % 5 != 0).select(
        F.col("merchant_key").alias("subscription_id"), "merchant_key", F.lit(1).alias("updated_at"),
        _pick(("DISMISSED", "CONFIRMED", "SUSPECTED", "POSSIBLY_INACTIVE"), n % 4 + 1).alias("status"),
        F.when(first % 2 == 0, F.col("evidence_ids")).otherwise(F.slice("evidence_ids", 2, n)).alias("evidence_ids"))
    stored = stored.join(found.drop("status", "evidence_ids").withColumn("estimated_amount_minor", F.lit(1).cast("long")), "merchant_key").withColumn(
        "created_at", F.lit(7).cast("long"))
    return recurrence.merge(found, stored, NOW).select(
        F.when(F.col("is_new"), None).otherwise(F.col("subscription_id")).alias("old_id"), "merchant_key", "status", "is_new", "estimated_amount_minor",
        "created_at", "updated_at", F.size("evidence_ids").cast("bigint").alias("n_evidence"))


@query
def sub_evidence(spark, sf_dir):
    return recurrence.evidence(_subscriptions(spark, sf_dir), _payments(spark, sf_dir)).select("merchant_key", "tx_id", "amount_minor")


@query
def sub_corrections(spark, sf_dir):
    n = F.col("tx_id")
    # events and orders share numbers, so a payment's own id is that under its merchant
    own = F.concat_ws("/", "merchant_key", n.cast("string")).alias("tx_id")
    pay = _payments(spark, sf_dir)
    given = pay.where("tx_id % 4 = 0").select(
        n.alias("correction_id"), own, F.when(n % 8 == 0, "SUBSCRIPTION_STATUS").otherwise("CATEGORY").alias("field_name"),
        _pick((" dismissed ", "CONFIRMED", "no such"), n % 3 + 1).alias("new_value"), F.col("ts_ms").alias("updated_at"))
    subs = _subscriptions(spark, sf_dir)
    return corrections.apply_to_subscriptions(subs, pay.select(own, "merchant_key"), given).select("merchant_key", "status", "estimated_amount_minor")


# corrections and stores


@query
def corrections_materialise(spark, sf_dir):
    tx = _pointing(spark, sf_dir)
    return corrections.apply(tx, adapters.corrections(spark, sf_dir)).select(
        "tx_id", "merchant_key", "merchant_display", "category_id", "direction", "duplicate_status", "possible_duplicate_of", "transfer_status", "is_user_confirmed")


def _pointing(spark, sf_dir):
    """Orders of which those that may be duplicates point to the order before."""
    return adapters.tx_orders(spark, sf_dir).withColumn(
        "possible_duplicate_of", F.when(F.col("duplicate_status") != "NONE", F.col("tx_id") - 1))


@query
def corrections_outcome(spark, sf_dir):
    n = F.col("correction_id")
    given = adapters.corrections(spark, sf_dir).withColumns({
        "tx_id": F.when(n % 90 == 0, -1).otherwise(n), "merchant_match_key": F.when(n % 4 != 0, F.col("merchant_match_key"))})
    return corrections.outcomes(given, adapters.tx_orders(spark, sf_dir))


def _deleted(spark, sf_dir):
    tx = _pointing(spark, sf_dir)
    return store.without_transactions({"transactions": tx, "user_corrections": adapters.corrections(spark, sf_dir)}, tx.where("tx_id % 7 = 0"))


@query
def fk_set_null(spark, sf_dir):
    return _deleted(spark, sf_dir)["transactions"].select("tx_id", "possible_duplicate_of")


@query
def fk_cascade(spark, sf_dir):
    return _deleted(spark, sf_dir)["user_corrections"].select("correction_id", "tx_id")


@query
def fk_restrict(spark, sf_dir):
    seed = store.seed_categories(spark)
    tx = _merchants(spark, sf_dir).select(_category().alias("category_id"))
    return store.deletable_categories(seed, tx).select("category_id", "sort_order")


_of(corrections.excluded_ids, adapters.corrections, "exclusion_join")


@query
def upsert_fingerprint(spark, sf_dir):
    tx = adapters.tx_orders(spark, sf_dir).select("tx_id", "ts_ms", "amount_minor")
    incoming = tx.where("tx_id % 3 = 0 or tx_id % 2 = 1").select("tx_id", (F.col("ts_ms") + 1).alias("ts_ms"), (F.col("amount_minor") + 100).alias("amount_minor"))
    return store.upserted(tx.where("tx_id % 2 = 0"), incoming, "tx_id", kept=("tx_id", "ts_ms"))


def _metadata(spark, sf_dir):
    n = F.col("event_id")
    return _events(spark, sf_dir).select(
        n.cast("string").alias("parser_version"), _pick(("ACTIVE", "INSTALLED", "ROLLBACK", "INVALID"), n % 4 + 1).alias("status"),
        F.when(n % 4 == 0, n).alias("activated_at"))


_of(lambda m: rules.activated(m, "13", NOW), _metadata, "activate_bundle")
_of(lambda m: rules.marked(rules.marked(m, "4", "INVALID"), "8", "ROLLBACK"), _metadata, "mark_bundle")


@query
def support_idempotency(spark, sf_dir):
    return store.support_outcome(_events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("idempotency_key"), (F.col("event_id") % 2).cast("string").alias("payload")))


@query
def support_idempotency_stored(spark, sf_dir):
    s = _events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("idempotency_key"), (F.col("event_id") % 2).cast("string").alias("payload"))
    old = s.where("seq % 10 = 0").groupBy("idempotency_key").agg(F.sha2(F.min_by("payload", "seq"), 256).alias("payload_hash"))
    return store.support_outcome(s.where("seq % 10 <> 0"), old)


def _scans(spark, sf_dir):
    """Scan states: one per event, the status by its number."""
    n, ms = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    return _events(spark, sf_dir).select(
        n.alias("scan_id"), _pick(lexicon.SCAN_STATUSES, n % 6 + 1).alias("status"), (ms - 1000).alias("started_at"),
        F.when(n % 5 != 0, ms).alias("completed_at"), ms.alias("updated_at"), (n % 40).alias("processed"), (n % 30).alias("accepted"))


_of(lambda s: scans.latest_completed(s).select("scan_id", "completed_at"), _scans, "latest_completed")
_of(lambda s: scans.active(s).select(F.lit("active").alias("lookup"), "scan_id").union(
    scans.resumable(s).select(F.lit("resumable"), "scan_id")), _scans, "status_lookups")
_of(scans.newest_by_status, _scans, "scan_newest_by_status")
_of(lambda s: s.select("scan_id", scans.violation().alias("violation")), _scans, "scan_violations")
_of(lambda e: e.select("event_id", ingest.after(_pick((*ingest.AFTER, "no such"), F.col("event_id") % 11 + 1)).alias("outcome")), _events, "retry_mapping")


@query
def cached_recent_ids(spark, sf_dir):
    cached = spark.createDataFrame([([5, 3, 999999999, 8, 1],)], "ids array<long>").select(F.posexplode("ids").alias("pos", "id"))
    return dashboard.by_ids(adapters.tx_orders(spark, sf_dir), cached).select("pos", "tx_id", "amount_minor")


# privacy, telemetry


@query
def privacy_scan(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", privacy.looks_secret(F.col("text")).alias("looks_secret"))


_of(lambda m: m.select("source_message_id", privacy.looks_secret(F.col("body")).alias("looks_secret")), adapters.messages, "privacy_messages")


@query
def prohibited_keys(spark, sf_dir):
    n = F.col("event_id") % 4
    body = (F.when(n == 0, F.concat(F.lit('{"a": [1, {"b": {"Sms_Body": '), "props", F.lit("}}]}")))
            .when(n == 1, F.concat(F.lit('{"list": ['), "props", F.lit(', {"x": {"S-m-s": 1}, "body": 2}]}'))).otherwise(F.col("props")))
    return _events(spark, sf_dir).select("event_id", privacy.prohibited_key(body).alias("key"), privacy.prohibited_path(body).alias("path"))


@query
def telemetry_validate(spark, sf_dir):
    n = F.col("event_id")
    e = _events(spark, sf_dir).select(
        n.alias("n"), F.when(n % 10 == 3, "not-a-uuid").otherwise(F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))).alias("event_id"),
        _pick((*lexicon.TELEMETRY_EVENT_TYPES, "other"), n % 8 + 1).alias("event_type"),
        F.when(n % 3 == 0, _pick((*lexicon.DURATION_BUCKETS, "LONG"), n % 8 + 1)).alias("duration_bucket"), F.lit(None).cast("string").alias("count_bucket"))
    return e.select("n", telemetry.event_error().alias("error_code"))


def _twice(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "ts", "event_type", F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("app_version"))
    other = F.when(F.col("event_id") % 5 == 0, "again").otherwise(F.col("event_type"))  # some ids come back under another type
    return e.union(e.withColumns({"ts": F.expr("ts + interval 1 hour"), "event_type": other}))


_of(telemetry.daily_counts, _twice, "telemetry_dedupe_daily")
_of(telemetry.accepted_and_duplicates, _twice, "telemetry_accepted")
_of(lambda e: telemetry.accepted_and_duplicates(e, e.where("event_id % 4 = 0")), _twice, "telemetry_accepted_stored")
_of(lambda e: telemetry.added_counts(telemetry.daily_counts(e.where("event_id % 4 = 0")), telemetry.unstored(e, e.where("event_id % 4 = 0"))),
    _twice, "telemetry_added_counts")


@query
def telemetry_expiry(spark, sf_dir):
    """Arrivals against what was stored 29 or 31 days before: the latter has expired."""
    e = _events(spark, sf_dir).select("event_id", "ts", "event_type")
    old = e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.expr("ts - interval 31 days")).otherwise(F.expr("ts - interval 29 days")).alias("ts")).where("event_id % 2 = 0")
    return telemetry.accepted_and_duplicates(e, old, telemetry.TTL_DAYS)


def _uuid(n):
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))


def _requests(spark, sf_dir):
    """Batches of one or two events as JSON, most with a fault by their number."""
    n = F.col("event_id")
    event = F.concat(
        F.lit('{"eventId": "'), F.when(n % 13 == 1, "x").otherwise(_uuid(n)), F.lit('", "occurredAt": '), F.when(n % 13 == 2, '" "').otherwise('"2024"'),
        F.lit(', "eventType": "'), _pick((*lexicon.TELEMETRY_EVENT_TYPES, "other"), n % 8 + 1), F.lit('"'),
        F.when(n % 13 == 3, ', "durationBucket": "LONG"').when(n % 13 == 4, ', "countBucket": null').when(n % 13 == 5, ', "errorCode": "ab"')
        .when(n % 13 == 6, ', "zeta": 1, "eta": 2').when(n % 13 == 7, ', "errorCode": "E_42"').otherwise(""), F.lit("}"))
    events = F.when(n % 17 == 1, "[]").when(n % 17 == 2, "7").when(n % 17 == 3, F.concat(F.lit("["), event, F.lit(", 3]"))).otherwise(
        F.concat(F.lit("["), event, F.lit("]")))
    body = F.concat(
        F.lit('{"schemaVersion": '), F.when(n % 19 == 1, '"1"').when(n % 19 == 2, "2").otherwise("1"), F.lit(', "batchId": "'),
        F.when(n % 19 == 3, "none").otherwise(_uuid(n)), F.lit('", "events": '), events,
        F.when(n % 19 == 4, ', "other": {"a": [{"SMS": 1}]}').when(n % 19 == 5, ', "more": 1').otherwise(""), F.when(n % 19 == 6, "").otherwise("}"))
    return _events(spark, sf_dir).select(n.alias("n"), body.alias("body"))


_of(lambda r: payloads.telemetry_checked(r).select("n", "problem.*"), _requests, "telemetry_payloads")
_of(lambda r: payloads.telemetry_events(payloads.telemetry_checked(r)).select("n", "event_id", "event_type"), _requests, "telemetry_payload_events")


@query
def support_payloads(spark, sf_dir):
    n = F.col("event_id")
    body = F.concat(
        F.lit('{"schemaVersion": 1, "submissionId": "'), F.when(n % 11 == 1, "x").otherwise(_uuid(n)), F.lit('", "consentedAt": '),
        F.when(n % 11 == 2, "5").otherwise('"2024"'), F.lit(', "previewConfirmed": '), F.when(n % 11 == 3, '"true"').otherwise("true"),
        F.lit(', "redactionVersion": "'), F.when(n % 11 == 4, F.repeat(F.lit("r"), 33)).otherwise("r1"), F.lit('", "reason": "'),
        _pick((*lexicon.SUPPORT_REASONS, "why"), n % 5 + 1), F.lit('", "redactedTemplate": "'), F.when(n % 11 == 5, "").otherwise("<amt>"),
        F.when(n % 11 == 6, '", "x": 1, "body": 2}').when(n % 11 == 7, '", "x": 1}').otherwise('"}'))
    r = _events(spark, sf_dir).select(n.alias("n"), body.alias("body"), F.when(n % 7 != 0, _uuid(n)).alias("idempotency_key"))
    return payloads.support_checked(r).select("n", "problem.*")


@query
def header_check(spark, sf_dir):
    n = F.col("event_id")
    h = _events(spark, sf_dir).select(
        n.alias("n"), F.when(n % 5 != 0, "1.0").alias("app_version"), _pick(("android", "ios", ""), n % 3 + 1).alias("platform"),
        F.when(n % 7 != 0, "14").otherwise(" ").alias("os_version"), F.when(n % 11 != 0, _uuid(n)).otherwise("x").alias("install_id"))
    return h.select("n", payloads.header_problem().alias("p")).select("n", "p.*")
_of(lambda e: telemetry.alive(e, 1_707_500_000_000).select("event_id"), _events, "ttl_alive")
