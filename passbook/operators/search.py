"""Substring search over merchants by a trigram index of their names.

A ledger has far fewer merchants than transactions.  The dictionary holds every
different (merchant_key, merchant_display) once; its trigrams are posted, sorted, so that
a search opens the row groups of its own trigrams.  What holds all trigrams of a needle is
verified by the same ``ilike`` as a plain search, and only the transactions of the merchants found are read.

Defined results: those of ``TransactionQuery(search=...)``.  ``%`` and ``_`` stay wildcards, case doesn't matter; a needle without three
letters between wildcards is looked up in the dictionary itself; rows without a merchant are never found.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Merchants that are named in a filter on the transactions, which Parquet can prune by; more are joined.
NAMED = 1000
FIELDS = ("merchant_display", "merchant_key")


def dictionary(tx: DataFrame) -> DataFrame:
    """``(entry, merchant_key, merchant_display)``: each pair of names once, by a hash of both."""
    names = tx.select("merchant_key", "merchant_display").where("merchant_key is not null or merchant_display is not null").distinct()
    return names.select(F.sha2(F.to_json(F.struct("merchant_key", "merchant_display")), 256).alias("entry"), "merchant_key", "merchant_display")


def trigrams(names: DataFrame) -> DataFrame:
    """``(trigram, field, entry)``: every entry of a dictionary under the trigrams of each of its names, in lower case; sorted by trigram."""
    def grams(c: str) -> Column:
        low = F.lower(c)
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substr(low, i, F.lit(3))))

    each = None
    for field in FIELDS:
        own = names.where(F.length(F.lower(field)) >= 3).select(F.explode(grams(field)).alias("trigram"), F.lit(field).alias("field"), "entry")
        each = own if each is None else each.union(own)
    return each.repartitionByRange("trigram").sortWithinPartitions("trigram")


def needed(needle: str) -> list[str]:
    """The trigrams that any name found by the needle holds; characters whose lower case isn't one character count as wildcards."""
    runs = re.split(r"[%_]", "".join(c if len(c.lower()) == 1 and c.upper().lower() == c.lower() else "_" for c in needle))
    return sorted({r.lower()[i:i + 3] for r in runs for i in range(len(r) - 2)})


def entries(needle: str, names: DataFrame, postings: DataFrame) -> DataFrame:
    """The rows of the dictionary that the needle finds."""
    grams, pattern = needed(needle), "%" + needle.replace("\\", "\\\\") + "%"
    if grams:
        # as many rows as the rarest trigrams have names; all of a needle's trigrams must be in one field
        hits = postings.where(F.col("trigram").isin(grams)).groupBy("entry", "field").agg(F.count(F.lit(1)).alias("n")).where(
            F.col("n") == len(grams)).select("entry").distinct()
        names = names.join(hits, "entry", "left_semi")
    return names.where(F.col("merchant_display").ilike(pattern) | F.col("merchant_key").ilike(pattern))


def search(needle: str, tx: DataFrame, names: DataFrame, postings: DataFrame) -> DataFrame:
    """The transactions of the merchants that the needle finds; of up to ``NAMED`` merchants the keys are filters of the scan."""
    found = entries(needle, names, postings).select(F.col("merchant_key").alias("f_key"), F.col("merchant_display").alias("f_display"))
    few = found.limit(NAMED + 1).collect()
    if len(few) <= NAMED:
        keys = sorted({r["f_key"] for r in few if r["f_key"] is not None})
        of_one = F.col("merchant_key").isin(keys)
        tx = tx.where(of_one | F.col("merchant_key").isNull() if any(r["f_key"] is None for r in few) else of_one)
        found = F.broadcast(tx.sparkSession.createDataFrame(few, "f_key string, f_display string"))
    return tx.join(found, tx["merchant_key"].eqNullSafe(found["f_key"]) & tx["merchant_display"].eqNullSafe(found["f_display"]), "left_semi")
