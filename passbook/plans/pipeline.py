"""From messages to stored transactions, one declarative plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from passbook.operators import classify, dedupe, messages
from passbook.session import checkpointed
from passbook.sources.rules import Rules


@dataclass(frozen=True)
class Earlier:
    """What earlier scans have stored: ``unstored`` drops the rows of a computed table that are stored, ``of_days`` reads the stored rows of some days."""

    unstored: Callable[[DataFrame], DataFrame]
    of_days: Callable[[list[int]], DataFrame | None]


def rows_as_earlier(stored: DataFrame) -> Earlier:
    """A table of stored rows (source_hash, fingerprint, ts_ms, ...) without an index."""
    day = F.floor(F.col("ts_ms") / F.lit(dedupe.DAY_MS)).cast("int")
    return Earlier(lambda tx: dedupe.unstored(tx, stored), lambda days: stored.where(day.isin(days)))


def scan(batch: DataFrame, rules: Rules, corrections: DataFrame | None = None, stored: DataFrame | Earlier | None = None,
         accepted: Observation | None = None) -> DataFrame:
    """New transactions of a batch of messages: mapped, filtered, parsed, classified, de-duplicated.

    ``stored`` has rows of earlier scans: exact repeats of them are left out, near ones point to them.  The user's
    future rules, in ``corrections``, decide on merchants, categories and near duplicates.  Rows of a batch that repeat a message
    (id, sender, time) count once.  No body goes past the parser: what is shuffled are the narrow candidates.
    The de-duplicated rows are computed at once and checkpointed.
    """
    earlier = rows_as_earlier(stored) if isinstance(stored, DataFrame) else stored
    overlay = classify.future_rules(corrections) if corrections is not None else None
    tx = classify.classified(messages.candidates(messages.mapped(batch), rules, accepted), overlay).withColumnRenamed("source_message_id", "seq")
    once = tx.withColumn("fingerprint", dedupe.fingerprint()).dropDuplicates(["source_hash"])
    if earlier is not None:
        once = earlier.unstored(checkpointed(once))  # keys, their days and the rows themselves are read
    kept = checkpointed(dedupe.first_of_each(once))  # the band join reads it three times
    before = earlier.of_days(dedupe.near_days(kept)) if earlier is not None else None
    near = dedupe.near_matches(kept, stored=before).select(F.col("seq").alias("n_seq"), "near_seq")
    status = dedupe.status_of(F.col("near_seq"), F.col("duplicate_override"))
    return kept.join(near, kept["seq"] == near["n_seq"], "left").withColumns({
        "possible_duplicate_of": F.when(status != "NONE", F.col("near_seq")), "duplicate_status": status}).drop(
        "n_seq", "near_seq", "duplicate_override")


def counters(batch: DataFrame, rules: Rules) -> DataFrame:
    """Processed, malformed, accepted and parsed messages of a batch, in one pass without a join."""
    fine = messages.well_formed()
    judged = batch.select("*", fine.alias("fine"), F.when(fine, messages.reject_reason(rules.senders())).alias("reject_reason"))
    accepted = F.col("fine") & F.col("reject_reason").isNull()
    rows = judged.select("fine", accepted.alias("accepted"), F.explode_outer(
        F.array(F.when(accepted, messages.outcome(rules)["parse_status"]))).alias("parse_status"))
    return rows.agg(F.count(F.lit(1)).alias("processed"), F.count_if(~F.col("fine")).alias("malformed"),
                    F.count_if("accepted").alias("accepted"), F.count_if(F.col("parse_status") == "SUCCESS").alias("parsed"))
