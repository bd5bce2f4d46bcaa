"""Small helpers shared by the llm operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from passbook.session import checkpoint_dir

#: Rows of an Arrow batch that are turned into Python values at a time.
SLICE = 512


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``SLICE`` at most, without a copy; whole texts are Python values only slice by slice."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, which a cluster's session must name."""
    return checkpoint_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a checkpoint in the shared folder.

    Spark's cleaner removes the files when no plan refers to them any more (where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fold(doc_id: str, buckets: int) -> Column:
    """crc32 of the id's text, modulo ``buckets`` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % buckets


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns cannot clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def hashable(kind: T.DataType) -> bool:
    """Whether Spark can hash values of this type: all but maps and variants, at any depth."""
    if isinstance(kind, T.StructType):
        return all(hashable(x.dataType) for x in kind)
    if isinstance(kind, T.ArrayType):
        return hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def rank_in_groups(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: 0-based gapless rank within each group, without one task per group.

    A group's rows are dealt over salts by the hash of the order columns; ranks
    inside a salt come from a window, and the counts of the earlier salts of the
    group (a small table) are added.  The order between salts is that of the salt.
    Equal order keys get different ranks, in any order; rows without the first of them are dealt by all their columns.
    """
    n = max(8, shuffle_partitions(df.sparkSession))
    rest = [x.name for x in df.schema if x.name not in order and hashable(x.dataType)]
    deal = F.when(F.col(order[0]).isNotNull(), F.xxhash64(*order)).otherwise(F.xxhash64(*order, *rest))
    salted = df.withColumn("_salt", F.pmod(deal, F.lit(n)).cast("int"))
    keys = [*group, "_salt"]
    sizes = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = salted.withColumn("_rank", F.row_number().over(inside) - F.lit(1))
    same = [ranked[k].eqNullSafe(starts[k]) for k in keys]
    joined = ranked.join(starts, same).select(
        *[ranked[c] for c in df.columns], (F.col("_start") + F.col("_rank")).cast("long").alias(out)
    )
    return joined


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``; component: least node reachable.

    Alternating large-star and small-star steps, each a minimum per node joined
    back, so a hub with very many links is never gathered in one task.  Self
    loops and repeated edges are harmless; edges with a null end are dropped.
    An empty input gives an empty result.  The rounds go on until nothing changes: about the logarithm of the longest path.
    """
    e = cut(edges.where("src is not null and dst is not null").select(
        F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()  # of the first edges, so that ``edges`` is computed once
    before = None
    while True:
        both = e.where("a <> b").select("a", "b").union(e.where("a <> b").select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # large star: neighbours above u are moved to the least of u and its neighbours
        large = (both.join(low, both["a"] == low["u"]).where("b > u")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: u and its lower neighbours are moved to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, large["a"] == least["u"]).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = cut(small.select("x.a", "x.b").where("a <> b").distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(e, nodes["node"] == e["a"], "left").select(
        "node", F.coalesce("b", "node").alias("component"))


def by_bytes(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about ``limit`` (one larger row stands alone)."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) on uint64 arrays."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
