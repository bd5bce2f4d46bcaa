"""Message relations: mapping, keyset pages, the pre-filter and rule-driven extraction.

``messages``: source_message_id, sender, received_ms, body.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from passbook.functions import lexicon, text
from passbook.sources.rules import Institution, Pattern, Rules

CONFIDENCE_MINIMUM = 0.60


def well_formed() -> Column:
    """Id, sender and time are there, the body isn't empty, the time isn't negative."""
    return F.coalesce(text.present(F.col("source_message_id").cast("string")).isNotNull() & text.present(F.col("sender")).isNotNull()
                      & (F.col("received_ms") >= 0) & (F.length("body") > 0), F.lit(False))


def mapped(raw: DataFrame) -> DataFrame:
    """The rows that are well formed, with sender trimmed; an id that is text is trimmed too, a number stays one."""
    sent = F.col("source_message_id")
    if isinstance(raw.schema["source_message_id"].dataType, StringType):
        sent = text.present(sent)
    return raw.where(well_formed()).select(sent.alias("source_message_id"), text.present(F.col("sender")).alias("sender"), "received_ms", "body")


def keyset_page(messages: DataFrame, start: int, end: int, after: int | None, limit: int) -> DataFrame:
    """The next ``limit`` messages of a period in the order of their ids; both filters reach the scan."""
    found = messages.where(F.col("received_ms").between(start, end))
    if after is not None:
        found = found.where(F.col("source_message_id") > after)
    return found.orderBy("source_message_id").limit(limit)


def page_state(page: DataFrame, limit: int) -> DataFrame:
    """The cursor after a page of raw rows, their number, and whether the source is exhausted.

    The cursor is the last well-formed row, or the last row if none is; malformed rows count as read.
    """
    return page.agg(F.coalesce(F.max(F.when(well_formed(), F.col("source_message_id"))), F.max("source_message_id")).alias("next_id"),
                    F.count(F.lit(1)).alias("n_rows")).withColumn("exhausted", F.col("n_rows") < limit)


def sender_known(sender: Column, patterns: Sequence[str]) -> Column:
    """Any pattern, trimmed, is part of the sender whatever the case; prefixes need no stripping for that."""
    found = F.lit(False)
    for p in patterns:
        if p.strip():
            found = found | F.contains(F.upper(sender), F.lit(p.strip().upper()))
    return found


def reject_reason(patterns: Sequence[str]) -> Column:
    """Why a message is not worth parsing; null for those that are.  What cannot be judged is rejected."""
    body = F.col("body")
    trimmed = text.squeeze(body)
    known = sender_known(F.col("sender"), patterns)
    financial = text.any_match(body, lexicon.FINANCIAL_POSITIVE)
    personal = (F.length(trimmed) <= 160) & ~trimmed.rlike(lexicon.AMOUNT_HINT)
    return (F.when(F.col("sender").isNull() | body.isNull(), "MALFORMED")
            .when(trimmed == "", "BLANK")
            .when(text.any_match(body, lexicon.STRONG_REJECT), "SECRET_CODE")
            .when(text.any_match(body, lexicon.DELIVERY_REJECT), "DELIVERY")
            .when(text.any_match(body, lexicon.MARKETING_REJECT) & ~financial, "MARKETING")
            .when(~known & ~financial & personal, "PERSONAL")
            .when(known | financial, None)
            .otherwise("NOT_FINANCIAL"))


def filtered(messages: DataFrame, rules: Rules) -> DataFrame:
    # generated, so that a filter on the reason reads it: merged into the filter, its patterns would be searched for time and again
    return messages.drop("reject_reason").select("*", F.explode_outer(F.array(reject_reason(rules.senders()))).alias("reject_reason"))


def _tries(rules: Rules) -> Column:
    """An array with what each rule finds in a message (sender, body), null where it finds nothing.

    Rules of institutions whose sender pattern matches are tried, all if none does.  The
    rules are unrolled as literal patterns, which compile once per task.
    """
    none = F.lit(None).cast("string")

    def found(m: Column, own: Column, i: Institution, p: Pattern) -> Column:
        """What a rule finds in the message m, or null."""

        def part(group: str | None) -> Column:
            n = p.index(group)
            return none if n is None else text.present(F.regexp_extract(m["body"], "(?is)" + p.regex, n))

        def record(x: Column) -> Column:
            confidence = F.lit(0.50)
            for given, weight in ((own, 0.25), (x["merchant"].isNotNull(), 0.10), (x["reference"].isNotNull(), 0.08),
                                  (x["currency"].isNotNull(), 0.04), (x["date"].isNotNull(), 0.03)):
                confidence = confidence + F.when(given, weight).otherwise(0.0)
            return F.when(x["amount"].isNotNull(), F.struct(
                F.lit(p.id).alias("rule_id"), F.lit(i.name).alias("institution"), own.alias("sender_known"),
                F.lit(p.direction).alias("direction"), x["amount"].alias("amount_minor"),
                F.coalesce(x["currency"], F.lit("INR")).alias("currency"), x["merchant"].alias("merchant"),
                F.when(x["reference"].isNotNull(), F.substring(F.sha2(x["reference"], 256), 1, 32)).alias("reference_hash"),
                x["date"].alias("date_ms"), F.least(F.lit(1.0), confidence).alias("confidence")))

        parts = F.struct(
            text.amount_minor(part(p.amount_group)).alias("amount"), part(p.merchant_group).alias("merchant"),
            part(p.reference_group).alias("reference"),
            (text.currency_code(part(p.currency_group)) if p.currency_group else none).alias("currency"),
            (text.date_millis(part(p.date_group)) if p.date_group else none.cast("bigint")).alias("date"))
        # the pattern is searched for once before its groups are taken
        return F.when((own | ~m["known"]) & m["body"].rlike("(?is)" + p.regex), text.let(parts, record))

    def tries(m: Column) -> Column:
        return F.array(*[found(m, m[f"own_{k}"], i, p) for k, i in enumerate(rules.institutions) for p in i.patterns])

    # bound once, so the rules are evaluated node by node: generated code for them all would be too large to be compiled
    message = F.struct("body", sender_known(F.col("sender"), rules.senders()).alias("known"), *[
        sender_known(F.col("sender"), i.senders).alias(f"own_{k}") for k, i in enumerate(rules.institutions)])
    return text.let(message, tries)


def extractions(messages: DataFrame, rules: Rules) -> DataFrame:
    """One row per message and rule that matches with a valid amount, in a narrow plan."""
    # outer, so that no filter repeats the array below the generator
    rows = messages.select("source_message_id", "sender", "received_ms", "body", F.posexplode_outer(_tries(rules)).alias("rule_seq", "x"))
    return rows.where("x is not null").select(
        "source_message_id", "sender", "received_ms", "body", "rule_seq", "x.*", F.coalesce("x.date_ms", "received_ms").alias("ts_ms")).drop("date_ms")


RECORD = ("rule_id", "institution", "direction", "amount_minor", "currency", "merchant", "reference_hash", "ts_ms", "confidence")


def outcome(rules: Rules) -> Column:
    """The column ``_outcome``, built once for the rules: a scan of many batches doesn't build its thousands of nodes again for each."""
    return _outcome(rules, SparkContext._gateway)


@functools.lru_cache(maxsize=8)
def _outcome(rules: Rules, gateway: object) -> Column:
    """{parse_status, parse_reason, x} of a message: the record of the most confident extraction, of these the first rule's.

    Extractions with the same money, direction, merchant and time are one; several different ones are
    ambiguous.  All of a message's extractions are in its own row, so nothing is shuffled.
    """

    def entry(x: Column, i: Column) -> Column:
        ts = F.coalesce(x["date_ms"], F.col("received_ms"))
        return F.when(x.isNotNull(), F.struct(
            (-x["confidence"]).alias("rank"), i.alias("seq"),
            F.struct(x["amount_minor"], x["currency"], x["direction"], F.lower(F.coalesce(x["merchant"], F.lit(""))), ts).alias("key"),
            F.struct(*[(ts if c == "ts_ms" else x[c]).alias(c) for c in RECORD]).alias("x")))

    def decided(found: Column) -> Column:
        n, best = F.size(F.array_distinct(F.transform(found, lambda x: x["key"]))), F.get(found, F.lit(0))["x"]
        weak = best["confidence"] < CONFIDENCE_MINIMUM
        known = sender_known(F.col("sender"), rules.senders())
        status = F.when(n == 0, "UNSUPPORTED").when(n > 1, "AMBIGUOUS").when(weak, "UNSUPPORTED").otherwise("SUCCESS")
        reason = (F.when((n == 0) & known, "UNSUPPORTED_TEMPLATE").when(n == 0, "NO_SENDER_OR_PATTERN_MATCH")
                  .when((n == 1) & weak, "LOW_CONFIDENCE"))
        return F.struct(status.alias("parse_status"), reason.alias("parse_reason"), best.alias("x"))

    return text.let(F.sort_array(F.filter(F.transform(_tries(rules), entry), lambda x: x.isNotNull())), decided)


def outcomes(accepted: DataFrame, rules: Rules) -> DataFrame:
    """parse_status and parse_reason per accepted message, with the record of its best extraction."""
    # generated, so that no filter on the outcome works it out a second time
    rows = accepted.select("source_message_id", "sender", "received_ms", "body", F.explode_outer(F.array(outcome(rules))).alias("o"))
    return rows.select("source_message_id", "sender", "received_ms", "body", "o.parse_status", "o.parse_reason", "o.x.*")


def source_hash() -> Column:
    return text.sha256(F.col("source_message_id"), F.col("sender"), F.col("received_ms"))


def candidates(messages: DataFrame, rules: Rules, accepted: Observation | None = None) -> DataFrame:
    """Filter, then parse: one transaction candidate per message that succeeds.

    ``accepted`` observes, as the plan runs, how many messages the filter accepts.
    """
    judged = filtered(messages, rules)
    if accepted is not None:
        judged = judged.observe(accepted, F.count_if(F.col("reject_reason").isNull()).alias("accepted"))
    return outcomes(judged.where("reject_reason is null").drop("reject_reason"), rules).where("parse_status = 'SUCCESS'").select(
        "source_message_id", source_hash().alias("source_hash"), "received_ms", "institution", "direction", "amount_minor", "currency",
        "merchant", "reference_hash", F.lit(None).cast("string").alias("masked_account"), "ts_ms", "confidence",
        text.payment_method(F.col("body")).alias("payment_method"))
