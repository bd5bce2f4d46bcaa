"""Telemetry events: validation, de-duplication by id, daily counters, time to live."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passbook.functions import lexicon
from passbook.session import checkpointed
from passbook.sources.store import DAY_MS, SUPPORT_DAYS, Store, support_outcome, support_rows

TTL_DAYS = 30
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"


def event_error() -> Column:
    """What is wrong with an event (event_id, event_type, duration_bucket, count_bucket); null if nothing."""
    return (F.when(~F.coalesce(F.col("event_id").rlike(UUID), F.lit(False)), "INVALID_EVENT_ID")
            .when(~F.coalesce(F.col("event_type").isin(*lexicon.TELEMETRY_EVENT_TYPES), F.lit(False)), "INVALID_EVENT_TYPE")
            .when(F.col("duration_bucket").isNotNull() & ~F.col("duration_bucket").isin(*lexicon.DURATION_BUCKETS), "INVALID_DURATION")
            .when(F.col("count_bucket").isNotNull() & ~F.col("count_bucket").isin(*lexicon.COUNT_BUCKETS), "INVALID_COUNT"))


def daily_counts(events: DataFrame) -> DataFrame:
    """First-seen events per ingest day, type and version; (event_id, ts, event_type, app_version)."""
    first = events.groupBy("event_id").agg(F.min_by(F.struct("ts", "event_type", "app_version"), "ts").alias("x"))
    return first.groupBy(F.date_format("x.ts", "yyyy-MM-dd").alias("day"), F.col("x.event_type").alias("event_type"),
                         F.col("x.app_version").alias("app_version")).agg(F.count(F.lit(1)).alias("n"))


def daily_counts_stream(events: DataFrame) -> DataFrame:
    """The same over a stream: ids are remembered for the time to live, days close with the watermark."""
    return (events.withWatermark("ts", f"{TTL_DAYS} days").dropDuplicatesWithinWatermark(["event_id"])
            .groupBy(F.window("ts", "1 day"), "event_type", "app_version").agg(F.count(F.lit(1)).alias("n"))
            .select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "app_version", "n"))


def first_of_each(events: DataFrame) -> DataFrame:
    """The row of every id that arrived first, whatever its type; ties by type."""
    order = F.struct("ts", "event_type") if "event_type" in events.columns else F.col("ts")
    return events.groupBy("event_id").agg(F.min_by(F.struct(*events.columns), order).alias("x")).select("x.*")


def unstored(events: DataFrame, stored: DataFrame, days: int | None = None) -> DataFrame:
    """The first of each id among ``events`` (event_id, ts, ...) that isn't among ``stored`` (event_id).

    With ``days``, a stored id (with its ts) counts only for so long: an event that arrives later is new again.
    """
    first, old = first_of_each(events), stored.select(F.col("event_id").alias("old_id"), *([F.col("ts").alias("old_ts")] if days else []))
    same = first["event_id"] == old["old_id"]
    if days:
        same = same & (F.col("old_ts") + F.expr(f"interval {days} days") > first["ts"])
    return first.join(old, same, "left_anti").select(*events.columns)


def accepted_and_duplicates(events: DataFrame, stored: DataFrame | None = None, days: int | None = None) -> DataFrame:
    """Received, accepted and duplicate events per type: the first of an id, whatever its type, is accepted unless the id is stored."""
    new = unstored(events, stored, days) if stored is not None else first_of_each(events)
    one = lambda rows, r, a: rows.select("event_type", F.lit(r).alias("r"), F.lit(a).alias("a"))
    return one(events, 1, 0).union(one(new, 0, 1)).groupBy("event_type").agg(
        F.sum("r").cast("long").alias("received"), F.sum("a").cast("long").alias("accepted")).withColumn("duplicates", F.col("received") - F.col("accepted"))


def added_counts(counts: DataFrame, new: DataFrame) -> DataFrame:
    """Stored daily counts plus those of new events, by day, type and version."""
    key = ["day", "event_type", "app_version"]
    return counts.select(*key, "n").unionByName(daily_counts(new)).groupBy(*key).agg(F.sum("n").alias("n"))


def sink(store: Store, stream: DataFrame, checkpoint: str, days: int = TTL_DAYS) -> StreamingQuery:
    """Store each event once and add it to the daily counts, batch by batch, until the source is read; ids alive are never counted twice.

    An id is a duplicate for ``days`` after it was accepted, then it is new again; ts is the time of arrival.  Stored events lie
    in folders by day, of which a batch reads those of its own time and the ``days`` before, so what it costs doesn't
    grow with what is stored.  Within one batch an id is accepted once.  Events and counts of a batch
    are parts of their tables, so a batch that is repeated after a failure replaces its own.
    """

    def merge(batch: DataFrame, number: int) -> None:
        part = f"{run}-{number}"
        new = batch.select("event_id", "ts", "event_type", "app_version", F.unix_millis("ts").alias("received_ms"))
        span = new.agg(F.min("received_ms").alias("lo"), F.max("received_ms").alias("hi")).first()
        old = None
        if span["lo"] is not None:
            old = store.read_days("telemetry_events", range(span["lo"] // DAY_MS - days, span["hi"] // DAY_MS + 1), without=part)
        new = checkpointed(unstored(new, old, days) if old is not None else first_of_each(new))
        store.append("telemetry_events", new, part)
        store.append("telemetry_counts", daily_counts(new), part)

    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    return stream.writeStream.queryName(f"telemetry-{run}").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expire(store: Store, now_ms: int, days: int = TTL_DAYS) -> None:
    """Delete the stored events that no arrival from now on can repeat; the counts stay."""
    store.drop_days("telemetry_events", now_ms // DAY_MS - days)


def support_sink(store: Store, stream: DataFrame, checkpoint: str, clock: Callable[[], int], days: int = SUPPORT_DAYS) -> StreamingQuery:
    """Store the first submission (seq, idempotency_key, payload) of each key for ``days``; what was answered to each is in support_outcomes.

    The same payload under a key alive is 201 again and stored once, another one is 409; a key that has expired is new.
    """

    def merge(batch: DataFrame, number: int) -> None:
        part, now = f"{run}-{number}", clock()
        kept = store.read_days("support_submissions", range(now // DAY_MS - days, now // DAY_MS + 1), without=part)
        alive_rows = kept.where(F.col("delete_at_ms") > now) if kept is not None else None
        outcome = checkpointed(support_outcome(batch, alive_rows))
        store.append("support_submissions", support_rows(batch, outcome, now, days).withColumn("received_ms", F.lit(now).cast("long")), part)
        store.append("support_outcomes", outcome.drop("stored"), part)

    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    return stream.writeStream.queryName(f"support-{run}").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_counts(store: Store) -> DataFrame:
    """The daily counts of what ``sink`` has stored."""
    return store.read("telemetry_counts").groupBy("day", "event_type", "app_version").agg(F.sum("n").alias("n"))


def alive(rows: DataFrame, now_ms: int, days: int = TTL_DAYS) -> DataFrame:
    return rows.where(F.unix_millis(F.col("ts").cast("timestamp")) + days * DAY_MS > now_ms)
