"""What is stored, by key: an index that tells the new rows of a batch from stored ones.

A transaction has two keys: the hash of its message and its fingerprint.  A message's hash
holds its time, and a fingerprint without a reference its time bucket, so a repeat of
either can only lie on the same day: those keys are kept in folders by day, and a batch
opens the folders of its own days.  A fingerprint with a reference can come back at any
time; these keys are in a table bucketed by key, which is joined as it lies, without a shuffle of what is stored.

A batch of up to ``SMALL`` keys, counted, is broadcast to the stored keys; a larger one is
shuffled to them.  Keys are the first 128 bits of the SHA-256.  Rows of a part that is written again are
replaced (by day) or repeated (by reference), which changes no answer.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.functions import text
from passbook.sources.store import Store, day_of

#: Keys of a batch that are broadcast (16 bytes each), and buckets of the keys without a day.
SMALL, BUCKETS = 1_000_000, 64
KEYED = "row_hash string, key binary, day int"


def keys(tx: DataFrame, span: int = 1) -> DataFrame:
    """``(row_hash, key, day)``: two keys per row of ``tx`` (source_hash, received_ms, fingerprint, reference_hash, ts_ms); day is null where none bounds it."""
    short = lambda c: F.unhex(F.substring(c, 1, 32))
    bounded = F.when(text.fold(F.col("reference_hash")) == "", day_of("ts_ms", span))
    return tx.select(F.col("source_hash").alias("row_hash"), F.explode(F.array(
        F.struct(short(F.col("source_hash")).alias("key"), day_of("received_ms", span).alias("day")),
        F.struct(short(F.col("fingerprint")).alias("key"), bounded.alias("day")))).alias("x")).select("row_hash", "x.key", "x.day")


class KeyIndex:
    def __init__(self, store: Store, buckets: int = BUCKETS, small: int = SMALL):
        self.store, self.buckets, self.small = store, buckets, small
        self.spark, self.dated = store.spark, f"{store.root}/transaction_keys/dated"
        self.name = "passbook_keys_" + hashlib.sha256(store.root.encode()).hexdigest()[:16]

    def _references(self) -> None:
        """The bucketed table, named in this session's catalogue; its files are in the store."""
        self.spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.name} (key BINARY, part STRING) USING parquet
            CLUSTERED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.store.root}/transaction_keys/references'""")

    def stored(self, days: list[int], without: str | None = None) -> DataFrame | None:
        """The keys of the given days but for the part ``without``; only these days are opened."""
        fs, _ = self.store._path()
        found = [f"{self.dated}/day={d}" for d in days if fs.exists(self.store._path("transaction_keys", "dated", f"day={d}")[1])]
        if not found:
            return None
        rows = self.spark.read.schema("key binary, day int, part string").option("basePath", self.dated).parquet(*found)
        return rows if without is None else rows.where(F.col("part") != without)

    def references(self, without: str | None = None) -> DataFrame:
        self._references()
        rows = self.spark.table(self.name)
        return rows if without is None else rows.where(F.col("part") != without)

    def known(self, tx: DataFrame, without: str | None = None) -> DataFrame:
        """``row_hash`` of the rows of ``tx`` (computed already, as it is read three times) that are stored by either key."""
        wanted = keys(tx, self.store.span)
        per_day = wanted.groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a day of the batch
        hint = F.broadcast if sum(r["n"] for r in per_day) <= self.small else (lambda df: df)
        dated, rest = wanted.where("day is not null"), wanted.where("day is null").select(F.col("row_hash"), F.col("key").alias("w_key"))
        found = self.references(without)
        # the stored side streams past the batch
        hits = found.join(hint(rest), found["key"] == F.col("w_key")).select("row_hash")
        stored = self.stored(sorted(r["day"] for r in per_day if r["day"] is not None), without)
        if stored is not None:
            own = dated.select("row_hash", F.col("key").alias("w_key"), F.col("day").alias("w_day"))
            hits = hits.union(stored.join(hint(own), (stored["day"] == F.col("w_day")) & (stored["key"] == F.col("w_key"))).select("row_hash"))
        return hits.distinct()

    def unstored(self, tx: DataFrame, without: str | None = None) -> DataFrame:
        """The rows of ``tx`` that aren't stored."""
        hits = self.known(tx, without)
        return tx.join(hits, tx["source_hash"] == hits["row_hash"], "left_anti")

    def add(self, tx: DataFrame, part: str) -> None:
        """Add the keys of rows that are stored in ``part``."""
        rows = keys(tx, self.store.span).withColumn("part", F.lit(part))
        rows.where("day is not null").select("key", "day", "part").hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "day", "part").parquet(self.dated)
        self._references()
        rows.where("day is null").select("key", "part").repartition(self.buckets, "key").write.mode("append").insertInto(self.name)

    def compact(self, days: list[int]) -> None:
        """Put the keys of the given (closed) days into one part each; small files of many batches go."""
        for d in days:
            rows = self.stored([d])
            if rows is not None:
                whole = rows.select("key", "day").distinct().withColumn("part", F.lit("whole"))
                whole.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "part").parquet(self.dated)
                for name in self.store._names("transaction_keys", "dated", f"day={d}"):
                    if name.startswith("part=") and name != "part=whole":
                        fs, path = self.store._path("transaction_keys", "dated", f"day={d}", name)
                        fs.delete(path, True)
