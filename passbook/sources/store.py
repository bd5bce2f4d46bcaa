"""Tables as Parquet folders under one small manifest.

Every change writes new folders, then a manifest that names the folder of each table.  A
manifest is created, never overwritten, so of two writers one fails or starts from the other's: a change of
several tables is seen at once or not at all, and a reader keeps the folders it began with.
Tables that are ``DAYED`` lie in folders by day, so what is read of them are the days asked for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.functions import lexicon
from passbook.session import checkpointed

ANALYSED = ("transactions", "user_corrections", "subscriptions", "scan_state", "dashboard_cache")
DAY_MS = 86_400_000
#: Tables in folders by day, and the time in milliseconds that tells it.
DAYED = {"transactions": "ts_ms", "telemetry_events": "received_ms", "support_submissions": "received_ms"}


def day_of(ms: str | F.Column, span: int = 1) -> F.Column:
    """The day of a time, or the first of the ``span`` days it lies in."""
    return (F.floor((F.col(ms) if isinstance(ms, str) else ms) / F.lit(DAY_MS * span)) * span).cast("int")


#: Days that a support submission is kept.
SUPPORT_DAYS = 14


class Conflict(RuntimeError):
    """Another writer changed a table that this change is based on."""


class Store:
    """``span``: days in a folder of the tables by day, the same for the life of a store; one suits streams, more suits long thin histories."""

    def __init__(self, spark: SparkSession, root: str, span: int = 1):
        self.spark, self.root, self.span = spark, root.rstrip("/"), span

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        """The names of what a folder holds; none if it isn't there."""
        fs, path = self._path(*parts)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def manifest(self) -> tuple[int, dict[str, str]]:
        """The newest number and the folder of every table."""
        numbers = [int(n) for n in self._names("_manifest") if n.isdigit()]
        if not numbers:
            return 0, {}
        fs, path = self._path("_manifest", f"{max(numbers):010d}")
        file = fs.open(path)
        try:
            return max(numbers), json.loads(file.readUTF())
        finally:
            file.close()

    def commit(self, changed: dict[str, str], based_on: dict[str, str]) -> None:
        """Name new folders, unless one of the changed tables has another folder by now than ``based_on`` says."""
        while True:
            number, current = self.manifest()
            if any(current.get(t) != based_on.get(t) for t in changed):
                raise Conflict(", ".join(sorted(changed)))
            fs, path = self._path("_manifest", f"{number + 1:010d}")
            fs.mkdirs(path.getParent())
            try:
                file = fs.create(path, False)  # fails if another writer was first
            except Exception:
                if not fs.exists(path):
                    raise
                continue
            file.writeUTF(json.dumps(current | changed))
            file.close()
            return

    def read(self, table: str, without: str | None = None, folders: dict[str, str] | None = None) -> DataFrame | None:
        """The newest rows (or those of ``folders``, a manifest's), but for the part named ``without``."""
        folder = (self.manifest()[1] if folders is None else folders).get(table)
        if folder is None:
            return None
        rows = self.spark.read.parquet(f"{self.root}/{table}/{folder}")
        if without is not None:
            rows = rows.where(F.col("_part").cast("string") != without)
        return rows.drop("_part", "day") if table in DAYED else rows.drop("_part")

    def read_days(self, table: str, days: Iterable[int], without: str | None = None, keep_layout: bool = False) -> DataFrame | None:
        """The rows in the folders of the given days; nothing else is listed or opened."""
        folder = self.manifest()[1].get(table)
        if folder is None:
            return None
        base = f"{self.root}/{table}/{folder}"
        fs, _ = self._path()
        found = [f"{base}/day={d}" for d in self.folder_days(days) if fs.exists(self._path(table, folder, f"day={d}")[1])]
        if not found:
            return None
        rows = self.spark.read.option("basePath", base).parquet(*found)
        if without is not None:
            rows = rows.where(F.col("_part").cast("string") != without)
        return rows if keep_layout else rows.drop("_part", "day")

    def folder_days(self, days: Iterable[int]) -> list[int]:
        return sorted({d // self.span * self.span for d in days})

    def _save(self, table: str, rows: DataFrame, folder: str, part: str) -> None:
        if table in DAYED and DAYED[table] in rows.columns:
            # a part that is written again replaces itself, day by day; a day is one file, or several if it is large
            rows.withColumns({"day": day_of(DAYED[table], self.span), "_part": F.lit(part)}).hint("rebalance", "day").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("day", "_part").parquet(f"{self.root}/{table}/{folder}")
        else:
            rows.write.mode("overwrite").parquet(f"{self.root}/{table}/{folder}/_part={part}")

    def replace(self, tables: dict[str, DataFrame], based_on: dict[str, str] | None = None) -> None:
        """Replace whole tables, all in one commit."""
        based_on = self.manifest()[1] if based_on is None else based_on
        new = {t: uuid.uuid4().hex for t in tables}
        for t, rows in tables.items():
            self._save(t, rows, new[t], "whole")
            if t in DAYED:  # an empty table has no day, but columns
                self.spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{self.root}/{t}/{new[t]}/{_day_zero(t, rows)}_part=none")
        self.commit(new, based_on)

    def write(self, table: str, rows: DataFrame) -> None:
        self.replace({table: rows})

    def upsert(self, table: str, incoming: DataFrame, key: str, kept: tuple[str, ...] = ()) -> None:
        """Rows by ``key``: incoming values win but for the ``kept`` columns, which a stored row keeps."""
        self.upsert_all({table: (incoming, key, kept)})

    def upsert_all(self, changes: dict[str, tuple[DataFrame, str, tuple[str, ...]]]) -> None:
        """Upserts of several tables, all in one commit: (incoming, key, kept) by table."""
        _, folders = self.manifest()
        new = {}
        for t, (incoming, key, kept) in changes.items():
            stored = self.read(t, folders=folders)
            new[t] = incoming if stored is None else upserted(stored, incoming, key, kept)
        self.replace(new, folders)

    def delete(self, table: str, keys: DataFrame, key: str) -> None:
        _, folders = self.manifest()
        stored = self.read(table, folders=folders)
        if stored is not None:
            self.replace({table: stored.join(keys.select(key).distinct(), key, "left_anti")}, folders)

    def append(self, table: str, rows: DataFrame, part: str) -> None:
        """Add rows in a part of their own, in the table's newest folder; a part that is written again replaces itself.

        What is stored already isn't rewritten, so a stream of small batches costs what the batches cost.
        """
        folder = self.manifest()[1].get(table)
        if folder is None:
            try:
                self.write(table, rows.limit(0))
            except Conflict:
                pass  # another writer made it
            folder = self.manifest()[1][table]
        self._save(table, rows, folder, part)

    def has_part(self, table: str, part: str) -> bool:
        """Whether a part of a table that isn't ``DAYED`` has been written to its end."""
        folder = self.manifest()[1].get(table)
        return folder is not None and "_SUCCESS" in self._names(table, folder, f"_part={part}")

    def drop_days(self, table: str, before: int) -> None:
        """Delete the days of a ``DAYED`` table before the given one, and nothing else."""
        folder = self.manifest()[1].get(table)
        for name in self._names(table, folder) if folder is not None else ():
            if name.startswith("day=") and name[4:].lstrip("-").isdigit() and 0 < int(name[4:]) + self.span <= before and name != "day=0":  # day 0 holds the columns of an empty table
                fs, path = self._path(table, folder, name)
                fs.delete(path, True)

    def change_days(self, table: str, days: Iterable[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite the rows of the given days by ``change``, which keeps their times; other days aren't touched."""
        rows = self.read_days(table, days, keep_layout=True)
        if rows is not None:
            folder = self.manifest()[1][table]
            checkpointed(change(rows)).hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "_part").parquet(
                f"{self.root}/{table}/{folder}")

    def wipe(self, *tables: str) -> None:
        """Empty tables, all in one commit."""
        _, folders = self.manifest()
        stored = {t: rows for t in tables if (rows := self.read(t, folders=folders)) is not None}
        if stored:
            self.replace({t: rows.limit(0) for t, rows in stored.items()}, folders)

    def wipe_analysed(self) -> None:
        """Empty the tables that analysis fills; categories and the metadata of rules stay."""
        self.wipe(*ANALYSED)

    def vacuum(self, table: str, keep: int = 2) -> None:
        """Delete all folders of a table but those of the newest ``keep`` manifests; readers of older ones fail from then on."""
        numbers = sorted(int(n) for n in self._names("_manifest") if n.isdigit())[-keep:]
        kept = set()
        for n in numbers:
            fs, path = self._path("_manifest", f"{n:010d}")
            file = fs.open(path)
            kept.add(json.loads(file.readUTF()).get(table))
            file.close()
        for name in self._names(table):
            if name not in kept:
                fs, path = self._path(table, name)
                fs.delete(path, True)

    def delete_transactions(self, ids: DataFrame) -> None:
        """Delete transactions (tx_id) and what hangs on them, in one commit: see ``without_transactions``."""
        _, folders = self.manifest()
        tables = {t: df for t in ("transactions", "user_corrections", "subscriptions") if (df := self.read(t, folders=folders)) is not None}
        self.replace(without_transactions(tables, ids), folders)

    def save_subscriptions(self, merged: DataFrame) -> None:
        """Replace stored subscriptions, and the evidence in their rows, by those of the same id."""
        self.upsert("subscriptions", merged, "subscription_id", kept=("subscription_id", "created_at"))


def _day_zero(table: str, rows: DataFrame) -> str:
    return "day=0/" if DAYED[table] in rows.columns else ""


def upserted(stored: DataFrame, incoming: DataFrame, key: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """The merge of two keyed tables of equal columns in one full outer join."""
    s = stored.select(*[F.col(c).alias("s_" + c) for c in stored.columns])
    i = incoming.select(*[F.col(c).alias("i_" + c) for c in stored.columns])
    both = s.join(i, s["s_" + key] == i["i_" + key], "full_outer")
    new = F.col("i_" + key).isNotNull()
    old = F.col("s_" + key).isNotNull()
    return both.select(*[
        F.when(new & ~(old & F.lit(c in kept)), F.col("i_" + c)).otherwise(F.col("s_" + c)).alias(c) for c in stored.columns])


def without_transactions(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables after a deletion of transactions ``ids`` (tx_id): their corrections go, pointers to them and evidence of them are cleared."""
    gone = ids.select(F.col("tx_id").alias("gone")).distinct()
    out = {}
    if (tx := tables.get("transactions")) is not None:
        left = tx.join(gone, tx["tx_id"] == gone["gone"], "left_anti")
        j = left.join(gone, left["possible_duplicate_of"] == gone["gone"], "left")
        out["transactions"] = j.select(*[
            F.when(F.col("gone").isNull(), left[c]).alias(c) if c == "possible_duplicate_of" else left[c] for c in tx.columns])
    if (corrections := tables.get("user_corrections")) is not None:
        out["user_corrections"] = corrections.join(gone, corrections["tx_id"] == gone["gone"], "left_anti")
    if (subs := tables.get("subscriptions")) is not None:
        e = subs.select("subscription_id", F.explode("evidence_ids").alias("e"))
        stays = e.join(gone, e["e"] == gone["gone"], "left_anti").groupBy(F.col("subscription_id").alias("s_id")).agg(F.sort_array(F.collect_list("e")).alias("es"))
        j = subs.join(stays, subs["subscription_id"] == stays["s_id"], "left")
        out["subscriptions"] = j.select(*[
            F.coalesce("es", F.array().cast(subs.schema[c].dataType)).alias(c) if c == "evidence_ids" else subs[c] for c in subs.columns])
    return out


def deletable_categories(categories: DataFrame, tx: DataFrame) -> DataFrame:
    """The categories that no transaction names; the others must not be deleted."""
    return categories.join(tx.select("category_id").distinct(), "category_id", "left_anti")


def transaction_rows(scanned: DataFrame, parser_version: str, now_ms: int) -> DataFrame:
    """Rows of the transactions table from those of a scan: confirmed by no user, created and updated now; their id is that of the message."""
    return scanned.withColumns({
        "tx_id": F.col("seq"), "parser_version": F.lit(parser_version), "is_user_confirmed": F.lit(False), "created_at": F.lit(now_ms).cast("long"),
        "updated_at": F.lit(now_ms).cast("long")})


def violation() -> F.Column:
    """What is wrong with a row of the transactions table; null if nothing is."""
    whole = lambda c, allowed: F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    return (F.when(F.coalesce(F.col("amount_minor") < 0, F.lit(True)), "AMOUNT")
            .when(~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False)), "CURRENCY")
            .when(F.coalesce(F.col("ts_ms") < 0, F.lit(True)), "TIMESTAMP")
            .when(~whole("direction", lexicon.DIRECTIONS), "DIRECTION")
            .when(~whole("duplicate_status", lexicon.STATUSES) | ~whole("transfer_status", lexicon.STATUSES), "STATUS")
            .when(F.col("merchant_key").isNull() != F.col("merchant_display").isNull(), "MERCHANT")
            .when((F.col("duplicate_status") == "NONE") & F.col("possible_duplicate_of").isNotNull(), "DUPLICATE_POINTER")
            .when(F.coalesce(~F.col("confidence").between(0.0, 1.0) | F.isnan("confidence"), F.lit(True)), "CONFIDENCE")
            .when(F.coalesce(F.col("updated_at") < F.col("created_at"), F.lit(True)), "TIMES"))


def seed_categories(spark: SparkSession, created_ms: int = 0) -> DataFrame:
    return spark.createDataFrame(
        [(k, n, True, i, created_ms) for i, (k, n) in enumerate(lexicon.CATEGORIES)],
        "category_id string, name string, is_system_category boolean, sort_order int, created_at long")


def inserted_or_ignored(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows and those incoming whose key is new."""
    return stored.unionByName(incoming.join(stored.select(key), key, "left_anti").select(*stored.columns))


def categories_in_order(categories: DataFrame) -> DataFrame:
    return categories.orderBy("sort_order", "category_id")


def support_outcome(submissions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """HTTP status per submission (seq, idempotency_key, payload): the first of a key 201, equal ones 201, others 409.

    A key in ``stored`` (idempotency_key, payload_hash) has its first payload there.  ``stored`` in the result marks what to store.
    """
    first = submissions.groupBy("idempotency_key").agg(F.min_by(F.sha2("payload", 256), "seq").alias("h"), F.min("seq").alias("s")).select(
        F.col("idempotency_key").alias("k"), "h", "s")
    j = submissions.join(first, submissions["idempotency_key"] == first["k"])
    if stored is None:
        j = j.withColumn("old", F.lit(None).cast("string"))
    else:
        kept = stored.groupBy(F.col("idempotency_key").alias("old_key")).agg(F.min("payload_hash").alias("old"))
        j = j.join(kept, j["idempotency_key"] == kept["old_key"], "left")
    return j.select("seq", "idempotency_key", F.when(F.sha2("payload", 256) == F.coalesce("old", "h"), 201).otherwise(409).alias("status"),
                    ((F.col("seq") == F.col("s")) & F.col("old").isNull()).alias("stored"))


def support_rows(submissions: DataFrame, outcome: DataFrame, now_ms: int, days: int = SUPPORT_DAYS) -> DataFrame:
    """The submissions that ``support_outcome`` says to store, with their hash and the time they are to be deleted."""
    new = outcome.where("stored").select(F.col("seq").alias("o_seq"))
    j = submissions.join(new, submissions["seq"] == new["o_seq"], "left_semi")
    return j.select(*submissions.columns, F.sha2("payload", 256).alias("payload_hash"), F.lit(now_ms + days * DAY_MS).cast("long").alias("delete_at_ms"))
