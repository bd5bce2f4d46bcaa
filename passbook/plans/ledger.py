"""The stored ledger: dashboards read through their cache, and corrections carried to all that hangs on them.

Tables of the store: transactions, user_corrections, subscriptions, dashboard_cache, and
daily_rollup (parts, see ``rollup``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.operators import corrections, dashboard, recurrence, rollup
from passbook.session import checkpointed
from passbook.sources.store import Store, day_of

PAYMENT = ("tx_id", "merchant_key", "merchant_display", "amount_minor", "currency", "ts_ms")


class Ledger:
    def __init__(self, store: Store, currency: str = "INR"):
        self.store, self.spark, self.currency = store, store.spark, currency

    def excluded(self) -> DataFrame | None:
        given = self.store.read("user_corrections")
        return corrections.excluded_ids(given) if given is not None else None

    def add(self, rows: DataFrame, part: str) -> None:
        """Add new transactions, and what they add to the roll-up; a part that is written again replaces itself."""
        rows = checkpointed(rows)
        self.store.append("transactions", rows, part)
        self.store.append("daily_rollup", rollup.daily(dashboard.with_role(rows, self.excluded())), part)
        self._invalidate(rows)

    def rollup(self) -> DataFrame:
        return rollup.added(self.store.read("daily_rollup"))

    def compact(self) -> None:
        """Put all parts of the roll-up into one."""
        _, folders = self.store.manifest()
        self.store.replace({"daily_rollup": rollup.added(self.store.read("daily_rollup", folders=folders))}, folders)

    def parts(self, start: int, end: int) -> DataFrame:
        """The roll-up of a period: of the transactions, its edge days alone are opened."""
        edge = self.store.read_days("transactions", rollup.edges(start, end))
        if edge is None:
            edge = self.store.read("transactions").limit(0)
        return rollup.in_period(self.rollup(), dashboard.with_role(edge, self.excluded()), start, end)

    def dashboard(self, start: int, end: int, now_ms: int, use_cache: bool = True) -> DataFrame:
        """The dashboard of a period: from the cache if it is there and readable, else computed and put there."""
        cache = self.store.read("dashboard_cache")
        if use_cache and cache is not None:
            found = dashboard.cached(cache, start, end)
            if not found.isEmpty():
                return found
        return self.recompute(start, end, now_ms)

    def recompute(self, start: int, end: int, now_ms: int) -> DataFrame:
        recent = dashboard.recent(dashboard.in_period(self.store.read("transactions"), start, end)).select("tx_id", "ts_ms")
        row = checkpointed(dashboard.rollup_row(self.parts(start, end), recent, start, end, self.currency, now_ms))
        self.store.upsert("dashboard_cache", row, "cache_key")
        return dashboard.cached(row, start, end)

    def _invalidate(self, *changed: DataFrame) -> None:
        """Drop the cached dashboards whose period holds a day of a changed row."""
        _, folders = self.store.manifest()
        cache = self.store.read("dashboard_cache", folders=folders)
        if cache is None:
            return
        touched = changed[0].select(day_of("ts_ms").alias("day"))
        for rows in changed[1:]:
            touched = touched.union(rows.select(day_of("ts_ms").alias("day")))
        days = F.array(*[F.lit(r["day"]) for r in touched.distinct().collect()]).cast("array<int>")  # days, not rows
        bound = lambda i: day_of(F.split_part("cache_key", F.lit(":"), F.lit(i)).cast("long"))
        self.store.replace({"dashboard_cache": cache.where(~F.exists(days, lambda d: d.between(bound(1), bound(2))))}, folders)

    def correct(self, given: DataFrame, now_ms: int, part: str) -> DataFrame:
        """Apply corrections (correction_id, tx_id, field_name, new_value, apply_to_future, merchant_match_key, updated_at).

        Those that are refused change nothing; the others are stored, the days of their transactions are rewritten, the roll-up gets
        the difference, cached dashboards of these days go, and the merchants before and after are looked at again
        for recurring payments.  A call that is repeated with its ``part`` after a failure ends in the same state (until ``compact``).
        Returns (correction_id, outcome).
        """
        tx = self.store.read("transactions")
        given = checkpointed(given)
        outcomes = checkpointed(corrections.outcomes(given, tx))
        taken = outcomes.where("outcome = 'APPLIED'").select("correction_id")
        applied = checkpointed(given.join(taken, "correction_id", "left_semi"))
        held = self.store.read("user_corrections")
        if held is None:
            held = given.limit(0)
        held = held.select(*given.columns)
        kept = held.join(applied.select("correction_id"), "correction_id", "left_anti").select(*given.columns)
        ids = applied.select("tx_id").distinct()
        before_raw = checkpointed(tx.join(ids, "tx_id", "left_semi"))
        earlier = checkpointed(held.join(ids, "tx_id", "left_semi").select(*given.columns))
        known = kept.join(ids, "tx_id", "left_semi").select(*given.columns).unionByName(applied)
        after_raw = checkpointed(corrections.apply(before_raw, known).withColumn(
            "updated_at", F.lit(now_ms).cast("long")).select(*tx.columns))
        before = dashboard.with_role(before_raw, corrections.excluded_ids(earlier))
        after = dashboard.with_role(after_raw, corrections.excluded_ids(known))
        if not self.store.has_part("daily_rollup", part):  # it is there if a call was cut off after it: the rows may have changed since
            self.store.append("daily_rollup", checkpointed(rollup.change(before, after)), part)
        self.store.write("user_corrections", kept.unionByName(applied))
        self._rewrite(before_raw, after_raw)
        self._invalidate(before_raw)
        self._detect_again(before_raw, after_raw, applied, now_ms)
        return outcomes

    def _rewrite(self, before: DataFrame, after: DataFrame) -> None:
        days = [r["day"] for r in before.select(day_of("ts_ms").alias("day")).distinct().collect()]

        def changed(rows: DataFrame) -> DataFrame:
            new = after.select(*[F.col(c).alias("n_" + c) for c in after.columns])
            j = rows.join(new, rows["tx_id"] == new["n_tx_id"], "left")
            there = F.col("n_tx_id").isNotNull()
            return j.select(*[F.when(there, F.col("n_" + c)).otherwise(rows[c]).alias(c) if c in after.columns else rows[c] for c in rows.columns])

        self.store.change_days("transactions", days, changed)

    def _detect_again(self, before: DataFrame, after: DataFrame, applied: DataFrame, now_ms: int) -> None:
        """Detect anew among the payments of the merchants that a row left or came to, and merge with what is stored."""
        stored = self.store.read("subscriptions")
        if stored is None:
            return
        tx = self.store.read("transactions")
        merchants = before.select("merchant_key").union(after.select("merchant_key")).where("merchant_key is not null").distinct()
        payments = recurrence.eligible(tx.join(merchants, "merchant_key", "left_semi"), self.excluded()).select(*PAYMENT)
        merged = recurrence.merged_table(recurrence.detect(payments, now_ms), stored, now_ms)
        self.store.write("subscriptions", checkpointed(corrections.apply_to_subscriptions(merged, after, applied).select(*stored.columns)))
