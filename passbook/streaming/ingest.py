"""Resumable ingestion: files of messages, bounded micro-batches, idempotent merge, state of the scan, rows that fail."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from passbook.operators import messages
from passbook.plans.pipeline import Earlier, scan
from passbook.session import checkpointed
from passbook.sources.keyindex import KeyIndex
from passbook.sources.rules import Rules
from passbook.sources.store import Store, transaction_rows

SCHEMA = "source_message_id long, sender string, received_ms long, body string"
STATE = ("scan_id string, batch long, status string, processed long, accepted long, failures long, cursor long, parser_version string, at_ms long")
#: Messages of one batch that may fail by themselves; more say that the rules are at fault.
MAX_FAILURES = 100
#: Rows of a batch of pages at most, about what a batch of files holds.
RUN_ROWS = 4_000_000


def failing(batch: DataFrame, run: Callable[[DataFrame], object], limit: int = MAX_FAILURES) -> list[int]:
    """The ids of the messages of a batch on which ``run`` raises, found by halving the range of their ids' hashes.

    Each failing message costs the logarithm of the batch in runs.  More than ``limit`` of them raise the last
    error: that isn't a fault of single messages, and nothing is left out for it.
    """
    found: list[int] = []
    keyed = batch.withColumn("_hash", F.xxhash64("source_message_id"))

    def look(low: int, high: int) -> None:
        part = keyed.where(F.col("_hash").between(low, high)).drop("_hash")
        try:
            run(part)
            return
        except AnalysisException:
            raise  # the plan itself
        except (PySparkException, Py4JError):
            ids = part.select("source_message_id").distinct().limit(2).collect()
            if len(ids) == 1:
                found.append(ids[0][0])
                if len(found) > limit:
                    raise
                return
            if low == high or not ids:
                raise
        middle = (low + high) >> 1
        look(low, middle)
        look(middle + 1, high)

    look(-(1 << 63), (1 << 63) - 1)
    return found


def parse_all(batch: DataFrame, rules: Rules) -> None:
    messages.candidates(messages.mapped(batch), rules).write.format("noop").mode("overwrite").save()


def merger(spark: SparkSession, store: Store, rules: Rules, run: str, corrections: DataFrame | None, now: Callable[[], int],
           parse: Callable[[DataFrame, Rules], None]) -> Callable[[DataFrame, int], None]:
    """What stores a numbered batch of a run; a batch that is stored again replaces its own rows.

    Each batch adds a part to the tables of transactions, keys, scan state and dead letters and rewrites nothing that is stored.
    What it processed and accepted is observed while its rows are computed.  If that fails, the
    messages that fail by themselves are found and go to ``dead_letters`` as RULE_RUNTIME_ERROR; the others go on.
    """
    index = KeyIndex(store)

    def rows_of(batch: DataFrame, part: str) -> tuple[DataFrame, dict]:
        read, accepted = Observation(), Observation()
        seen = batch.observe(read, F.count(F.lit(1)).alias("processed"), F.max("source_message_id").alias("cursor"))
        earlier = Earlier(lambda tx: index.unstored(tx, part), lambda days: store.read_days("transactions", days, without=part))
        rows = scan(seen, rules, corrections, earlier, accepted)
        # the rows are computed before anything is replaced
        return checkpointed(transaction_rows(rows, rules.parser_version, now())), read.get | accepted.get

    def merge(batch: DataFrame, number: int) -> None:
        part, failed = f"{run}-{number}", []
        try:
            rows, counts = rows_of(batch, part)
        except AnalysisException:
            raise
        except (PySparkException, Py4JError):
            failed = failing(batch, lambda b: parse(b, rules))
            if not failed:
                raise  # no message fails by itself
            bad = batch.where(F.col("source_message_id").isin(failed))
            store.append("dead_letters", bad.select(
                "source_message_id", "received_ms", F.lit("RULE_RUNTIME_ERROR").alias("reason"), F.lit(number).cast("long").alias("batch")).distinct(), part)
            good = batch.where(~F.coalesce(F.col("source_message_id").isin(failed), F.lit(False)))
            rows, counts = rows_of(good, part)
        store.append("transactions", rows, part)
        index.add(rows, part)
        # last, so a state tells of what is stored
        state = (run, number, "RUNNING", (counts["processed"] or 0) + len(failed), counts["accepted"] or 0, len(failed),
                 max([c for c in (counts["cursor"], *failed) if c is not None], default=None), rules.parser_version, now())
        store.append("scan_batches", spark.createDataFrame([state], STATE), part)

    return merge


def clock_ms() -> int:
    return int(time.time() * 1000)


def ingest(spark: SparkSession, folder: str, store: Store, rules: Rules, checkpoint: str, files_per_batch: int | None = None,
           bytes_per_batch: int = 256 << 20, corrections: DataFrame | None = None, clock: Callable[[], int] | None = None,
           parse: Callable[[DataFrame, Rules], None] = parse_all) -> StreamingQuery:
    """Read what is new in ``folder``, stop when done; bounded batches by bytes, or by files if given.  ``stop()`` of the query cancels it

    after its batch, and the next call goes on from there.  A batch that is repeated after a failure replaces its own rows,
    and stored source hashes and fingerprints are left out (see ``KeyIndex``).  Bodies are never written.
    """
    # batches are numbered within a checkpoint, so its name tells runs of different ones apart
    run = run_of(checkpoint)
    merge = merger(spark, store, rules, run, corrections, clock or clock_ms, parse)
    source = spark.readStream.schema(SCHEMA)
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source.option("maxBytesPerTrigger", bytes_per_batch)
    return source.parquet(folder).writeStream.queryName(f"ingest-{run}").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def ended(store: Store, scan_id: str, status: str, parser_version: str, at_ms: int) -> None:
    end = (scan_id, None, status, 0, 0, 0, None, parser_version, at_ms)
    store.append("scan_batches", store.spark.createDataFrame([end], STATE), f"{scan_id}-end")


def page_ends(source: DataFrame, start: int, end: int, after: int | None, limit: int) -> list[tuple[int | None, int]]:
    """The last id of every page of ``limit`` rows of a period after a cursor, in order, and the page's rows.

    Ids alone are dealt over ranges and counted once for all pages, so no page sorts or reads what the later ones hold; one row a page
    reaches the driver.  Rows that share an id aren't parted: they belong to the page of the first of them.
    """
    found = source.where(F.col("received_ms").between(start, end))
    if after is not None:
        found = found.where(F.col("source_message_id") > after)
    dealt = checkpointed(found.select("source_message_id").repartitionByRange("source_message_id")).withColumn("p", F.spark_partition_id())
    at, starts = 0, []
    for r in sorted(dealt.groupBy("p").count().collect()):  # one row a range
        starts.append((r["p"], at))
        at += r["count"]
    if not starts:
        return []
    ranked = dealt.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("source_message_id"))).join(
        F.broadcast(source.sparkSession.createDataFrame(starts, "p int, at long")), "p")
    pages = ranked.groupBy(F.floor((F.col("at") + F.col("n") - 1) / F.lit(limit)).alias("page")).agg(
        F.max("source_message_id").alias("last"), F.count(F.lit(1)).alias("n"))
    return [(r["last"], r["n"]) for r in pages.orderBy("page").collect()]


def scan_pages(source: DataFrame, store: Store, rules: Rules, scan_id: str, start: int, end: int, limit: int,
               corrections: DataFrame | None = None, cancelled: Callable[[], bool] = lambda: False, clock: Callable[[], int] | None = None) -> str:
    """Scan a table of messages in pages of ``limit`` rows by their ids, for sources that aren't files of a stream.

    A batch is a run of whole pages: as many rows as the scan has stored already, one page at least and ``RUN_ROWS`` rows at most.
    So the fixed costs of a batch come up with the logarithm of the pages, what a failure repeats is no more than
    what is stored, and a batch that is repeated has the pages it had.  The cursor is that of the newest stored
    batch, so a scan that was cut off or cancelled goes on after what is stored; a scan is cancelled between batches.  The
    predicates of period and cursor reach the files.  The scan's state is stored as with ``run_scan``.
    """
    now = clock or clock_ms
    merge = merger(source.sparkSession, store, rules, scan_id, corrections, now, parse_all)
    batches = store.read("scan_batches")
    batches = batches.where((F.col("scan_id") == scan_id) & F.col("batch").isNotNull()) if batches is not None else None
    newest = batches.agg(F.max("cursor").alias("cursor"), F.max("batch").alias("batch"), F.sum("processed").alias("rows")).first() if batches is not None else None
    cursor, number, stored = (newest["cursor"], -1 if newest["batch"] is None else newest["batch"], newest["rows"] or 0) if newest else (None, -1, 0)
    pages = page_ends(source, start, end, cursor, limit)
    status = "COMPLETED"
    while True:
        if cancelled():
            status = "CANCELLED"
            break
        if not pages:
            break
        taken, rows = 0, 0
        while taken < len(pages) and (not taken or rows + pages[taken][1] <= min(stored, RUN_ROWS)):
            rows += pages[taken][1]
            taken += 1
        last = pages[taken - 1][0]
        id_ = F.col("source_message_id")
        if last is not None:
            own = (id_ > cursor) & (id_ <= last) if cursor is not None else (id_ <= last) | id_.isNull()
        else:
            own = id_.isNull()
        number += 1
        merge(source.where(F.col("received_ms").between(start, end) & own), number)
        pages, stored, cursor = pages[taken:], stored + rows, last if last is not None else cursor
    ended(store, scan_id, status, rules.parser_version, now())
    return status


def run_of(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:12]


def run_scan(spark: SparkSession, folder: str, store: Store, rules: Rules, checkpoint: str, cancelled: Callable[[], bool] = lambda: False,
             clock: Callable[[], int] | None = None, **how) -> str:
    """Ingest until the source is read, the scan is cancelled or it fails; stores and returns the status it ended with.

    A cancelled or interrupted scan goes on from its checkpoint with the next call; until then ``scans.resumable`` finds it.
    """
    now = clock or clock_ms
    query = ingest(spark, folder, store, rules, checkpoint, clock=clock, **how)
    status = "COMPLETED"
    try:
        while not query.awaitTermination(0.2):
            if cancelled():
                query.stop()
                status = "CANCELLED"
        if cancelled():
            status = "CANCELLED"
    except PySparkException:
        status = "INTERRUPTED"
    ended(store, run_of(checkpoint), status, rules.parser_version, now())
    return status


def scan_states(store: Store) -> DataFrame | None:
    """One row per scan from its batches: status and times of the newest, sums of the counts, the cursor."""
    rows = store.read("scan_batches")
    if rows is None:
        return None
    ended = F.col("batch").isNull()
    return rows.groupBy("scan_id").agg(
        F.max_by("status", F.struct("at_ms", ended)).alias("status"), F.sum("processed").alias("processed"), F.sum("accepted").alias("accepted"),
        F.sum("failures").alias("failures"), F.max("cursor").alias("cursor"), F.min("at_ms").alias("started_at"), F.max("at_ms").alias("updated_at"),
        F.max_by("parser_version", "at_ms").alias("parser_version")).withColumn(
        "completed_at", F.when(~F.col("status").isin("PENDING", "RUNNING"), F.col("updated_at")))


#: What a run does after each way a scan can end.
AFTER = {
    "COMPLETED": "SUCCESS", "CANCELLED": "SUCCESS", "PERMISSION_REVOKED": "FAILURE", "PROVIDER_ERROR": "RETRY", "COROUTINE_CANCELLED": "RETRY",
    "PERMISSION_DENIED": "FAILURE", "PARSER_UNAVAILABLE": "FAILURE", "SCAN_ALREADY_ACTIVE": "RETRY", "NOT_RESUMABLE": "FAILURE", "UNEXPECTED": "RETRY",
}


def after(reason: Column) -> Column:
    """SUCCESS, RETRY or FAILURE for the status or reason a scan ended with; RETRY for one that isn't known."""
    known = F.create_map(*[F.lit(x) for pair in AFTER.items() for x in pair])
    return F.coalesce(known[F.coalesce(reason, F.lit(""))], F.lit("RETRY"))
