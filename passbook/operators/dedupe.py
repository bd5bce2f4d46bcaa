"""Fingerprints, exact and near duplicates.

The near match never suppresses an insert, so the sequential decision has a batch form:
drop what is stored, keep the first of each fingerprint, then join each survivor to the
rows before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passbook.functions import text

BUCKET_MS = 300_000
WINDOW_MS = 1_800_000
DAY_MS = 86_400_000


def fingerprint() -> Column:
    """By reference if there is one, else by institution, money, direction, merchant, account and 5-minute bucket."""
    ref = text.fold(F.col("reference_hash"))
    with_ref = text.sha256(F.lit("v1"), F.col("amount_minor"), F.col("currency"), F.col("direction"), ref)
    without = text.sha256(F.lit("v1"), text.fold(F.col("institution")), F.col("amount_minor"), F.col("currency"), F.col("direction"),
                          F.col("merchant_key"), text.fold(F.col("masked_account")), F.expr(f"cast(ts_ms div {BUCKET_MS} as bigint)") * BUCKET_MS)
    return F.when(ref != "", with_ref).otherwise(without)


def first_of_each(tx: DataFrame) -> DataFrame:
    """The first row by seq of every fingerprint, as a minimum with partial sums rather than a sort."""
    cols = tx.columns
    return tx.groupBy("fingerprint").agg(F.min_by(F.struct(*cols), "seq").alias("x")).select("x.*")


def unstored(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows whose source hash and fingerprint are not stored."""
    out = incoming.join(stored.select("source_hash"), "source_hash", "left_anti") if "source_hash" in incoming.columns else incoming
    return out.join(stored.select("fingerprint"), "fingerprint", "left_anti")


def _compatible(a: Column, b: Column) -> Column:
    blank = lambda c: F.coalesce(text.squeeze(c) == "", F.lit(True))
    return blank(a) | blank(b) | (a == b)


def near_matches(survivors: DataFrame, window_ms: int = WINDOW_MS, stored: DataFrame | None = None) -> DataFrame:
    """``(seq, near_seq, distance_ms)``: each survivor's nearest earlier row within the window; ties by seq.

    All ``stored`` rows are earlier than the survivors, whatever their seq; only those within the window of
    some survivor can match, so a caller that knows the survivors' days gives the rows of those (see ``near_days``).

    Rows meet by money, direction, merchant and time bucket of the window's width (an
    earlier row is posted in three buckets), so one hot key is spread over its buckets.
    """
    key = ["amount_minor", "currency", "direction"]

    def base_of(tx: DataFrame, is_stored: bool) -> DataFrame:
        return tx.select("seq", "ts_ms", *key, F.coalesce("merchant_key", F.lit("")).alias("mk"),
                         F.col("merchant_key").isNull().alias("no_m"), "reference_hash", text.fold(F.col("masked_account")).alias("account"),
                         F.expr(f"ts_ms div {window_ms}").alias("slot"), F.lit(is_stored).alias("stored"))

    base = base_of(survivors, False)
    earlier = base
    if stored is not None:
        earlier = base.union(base_of(stored, True))
    left = base.select(*[F.col(c).alias("a_" + c) for c in base.columns])
    right = earlier.select(*[F.col(c).alias("b_" + c) for c in base.columns if c != "slot"], F.explode(
        F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("b_slot"))
    same = [F.col("a_" + c) == F.col("b_" + c) for c in (*key, "mk", "no_m", "slot")]
    near = left.join(right, same).where(
        (F.col("b_stored") | (F.col("b_seq") < F.col("a_seq"))) & (F.abs(F.col("a_ts_ms") - F.col("b_ts_ms")) <= window_ms)
        & _compatible(F.col("a_reference_hash"), F.col("b_reference_hash")) & _compatible(F.col("a_account"), F.col("b_account")))
    distance = F.abs(F.col("a_ts_ms") - F.col("b_ts_ms"))
    return near.groupBy(F.col("a_seq").alias("seq")).agg(F.min(F.struct(distance.alias("d"), F.col("b_seq").alias("s"))).alias("x")).select(
        "seq", F.col("x.s").alias("near_seq"), F.col("x.d").alias("distance_ms"))


def near_days(survivors: DataFrame, window_ms: int = WINDOW_MS) -> list[int]:
    """The days on which a stored row can be near a survivor: one row a day reaches the driver."""
    day = lambda c: F.floor(c / F.lit(DAY_MS)).cast("int")
    ends = survivors.select(F.explode(F.array(day(F.col("ts_ms") - window_ms), day(F.col("ts_ms") + window_ms))).alias("day"))
    return sorted(r["day"] for r in ends.where("day is not null").distinct().collect())


def status_of(near: Column, override: Column) -> Column:
    """duplicate_status of a new row: NONE without a near match or if the user says so, else the user's status or SUSPECTED."""
    return F.when(near.isNull() | F.coalesce(override == "NONE", F.lit(False)), "NONE").otherwise(F.coalesce(override, F.lit("SUSPECTED")))


def decide(tx: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Per incoming row: REUSED, SUSPECTED or UNIQUE, its duplicate_status, and the row it points to.

    A row that is stored already, by source hash or else by fingerprint, is reused, as is one whose fingerprint came before.  ``tx`` may
    have the user's duplicate_override per row: NONE makes a new row unique, another status stands for SUSPECTED.
    """
    marked = tx.withColumn("fingerprint", fingerprint()).withColumn("old_seq", F.lit(None).cast("long"))
    if "duplicate_override" not in tx.columns:
        marked = marked.withColumn("duplicate_override", F.lit(None).cast("string"))
    new = marked
    if stored is not None:
        new = marked.drop("old_seq")
        for key in [k for k in ("source_hash", "fingerprint") if k in tx.columns or k == "fingerprint"]:
            old = stored.groupBy(F.col(key).alias("o_" + key)).agg(F.min("seq").alias("seq_" + key))
            new = new.join(old, new[key] == old["o_" + key], "left").drop("o_" + key)
        marked = new.withColumn("old_seq", F.coalesce(*[c for c in new.columns if c.startswith("seq_")])).drop("seq_source_hash", "seq_fingerprint")
        new = marked.where("old_seq is null")
    kept = first_of_each(new)
    near = near_matches(kept, stored=stored).select(F.col("seq").alias("n_seq"), "near_seq")
    first = kept.select(F.col("fingerprint").alias("f"), F.col("seq").alias("first_seq"))
    joined = marked.join(first, marked["fingerprint"] == first["f"], "left").join(near, marked["seq"] == near["n_seq"], "left")
    target = F.coalesce("old_seq", F.when(F.col("seq") != F.col("first_seq"), F.col("first_seq")))
    status = status_of(F.col("near_seq"), F.col("duplicate_override"))
    return joined.select(
        "seq", "fingerprint", F.when(target.isNotNull(), "REUSED").when(status != "NONE", "SUSPECTED").otherwise("UNIQUE").alias("decision"),
        F.when(target.isNull(), status).alias("duplicate_status"), F.coalesce(target, F.when(status != "NONE", F.col("near_seq"))).alias("points_to"))


def first_by_window(tx: DataFrame) -> DataFrame:
    """Rows in order of seq within their fingerprint."""
    return tx.withColumn("place", F.row_number().over(Window.partitionBy("fingerprint").orderBy("seq")))
