"""Vectors scaled to whole numbers, and exact componentwise means of groups of them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

#: Greatest scaled component: up to it, distances of vectors of 4,096 components fit in a long.
LIMIT = 1 << 24
MAX_LONG = (1 << 63) - 1


def scaled(vectors: DataFrame, scale: int, *keep: str) -> DataFrame:
    """``(*keep, x)``: x is floor(scale * component), of rows whose vector is whole.

    Rows are left out whose vector is null or holds a null, NaN or infinite component, or one of a scaled size above ``LIMIT``.
    """
    rows = need(vectors, *keep, "embedding").select(
        *[F.col(f"`{k}`") for k in keep], F.transform("embedding", lambda x: x.cast("double") * F.lit(float(scale))).alias("x"))
    fine = F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & (F.abs(x) <= F.lit(float(LIMIT))))
    return rows.where(fine).select(*[F.col(f"`{k}`") for k in keep], F.transform("x", lambda x: F.floor(x)).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance, row by row."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


Assign = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def means(rows: DataFrame, entries: np.ndarray, assign: Assign) -> np.ndarray:
    """The ``entries`` (k by w) after one update: floor(sum / count) of the values of each; one without values stays.

    ``assign`` takes the vectors of a batch (column x) and gives (entry, value) of what is to be summed.  Every task adds
    up all its rows first, so k * w sums leave it; k * w sums reach the driver.
    """
    k, w = entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, w), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            entry, value = assign(matrix(batch.column(0)))
            count += np.bincount(entry, minlength=k)
            order = np.argsort(entry, kind="stable")
            held = entry[order]
            starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
            total[held[starts]] += np.add.reduceat(value[order], starts, axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, w)), pa.array(np.tile(np.arange(w), len(used))), pa.array(np.repeat(count[used], w)),
             pa.array(total[used].reshape(-1))], ["entry", "at", "n", "s"])

    sums = rows.select("x").mapInArrow(add, "entry long, at long, n long, s long").groupBy("entry", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new = entries.copy()
    for r in sums.collect():  # k * w rows
        new[r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return new


def numbers_sha256(values: Iterable[int]) -> str:
    """Lower-case hex SHA-256 of decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()
