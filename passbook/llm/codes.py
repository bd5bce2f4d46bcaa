"""Vector code compression: product codes whose nearest entries come from memoised grid cells.

A vector is cut into parts; each part position has a codebook.  A part's coarse cell is the
box of the grid of ``width`` that holds it.  For a box, the entries that could be nearest to any
point in it are those whose least distance to the box doesn't exceed the smallest of the
entries' greatest distances to it (at equality an entry of lower index may still tie);
all others are dominated across the box.  A worker remembers the surviving entries of the cells it met, as
a bit set under the cell's key, up to ``MEMO`` cells of a codebook; a part is compared exactly
with its cell's entries alone.  Cells beyond the memory are bounded again: no result depends on it.

Defined results.  A row whose vector is null or holds a null, NaN, infinite or (scaled) greater component
than ``wholevectors.LIMIT`` is dropped.  The codebooks have the length of the kept vector of
least vec_id whose length is a positive multiple of ``parts``; a row of another length stays with a null code and error.
Repeated rows count each; starts of equal id are ordered by their components, null ids come last.  Fewer rows than
``entries``: so many entries.  An empty table gives no rows.  A label's sum beyond a long is null, as is that of a label
without any code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, empty_like
from .wholevectors import MAX_LONG, matrix, means, numbers_sha256, scaled, squared

SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
#: Cells that a worker remembers for a codebook, and edge of a cell.
MEMO, WIDTH = 100_000, 64
#: Parts and pairs of part and entry looked at together.
PARTS, PAIRS = 2048, 1 << 19


class Cells:
    """The entries of a codebook that are not dominated across a cell, remembered by cell."""

    def __init__(self, book: np.ndarray, width: int = WIDTH, memo: int = MEMO) -> None:
        self.book, self.width, self.memo, self.known = book, width, memo, {}

    def bounded(self, cells: np.ndarray) -> np.ndarray:
        """Boolean (cells by entries): not dominated across the cell."""
        least, most = np.zeros((2, len(cells), len(self.book)), np.int64)
        for j in range(cells.shape[1]):
            # a column holds few different cell coordinates
            at, which = np.unique(cells[:, j], return_inverse=True)
            low = at[:, None] * self.width - self.book[None, :, j]
            high = low + self.width - 1
            outside = np.maximum(np.maximum(low, -high), 0)
            far = np.maximum(np.abs(low), np.abs(high))
            least += (outside * outside)[which]
            most += (far * far)[which]
        return least <= most.min(1, keepdims=True)

    def survivors(self, x: np.ndarray) -> np.ndarray:
        """Boolean (rows by entries): the entries to compare each row with."""
        cells, of = np.unique(np.floor_divide(x, self.width), axis=0, return_inverse=True)
        keys = [c.tobytes() for c in cells]
        bits = [self.known.get(k) for k in keys]
        missing = [i for i, b in enumerate(bits) if b is None]
        if missing:
            fresh = np.packbits(self.bounded(cells[missing]), axis=1)
            for i, b in zip(missing, fresh, strict=True):
                bits[i] = b.tobytes()
                if len(self.known) < self.memo:
                    self.known[keys[i]] = bits[i]
        packed = np.frombuffer(b"".join(bits), np.uint8).reshape(len(cells), -1)
        return np.unpackbits(packed, axis=1, count=len(self.book)).astype(bool)[of.reshape(-1)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every row; ties to the lower index."""
        index, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for start in range(0, len(x), PARTS):
            own = x[start:start + PARTS]
            row, entry = np.nonzero(self.survivors(own))  # by row, then by rising entry
            distance = np.concatenate([squared(own[row[at:at + PAIRS]], self.book[entry[at:at + PAIRS]]) for at in range(0, len(row), PAIRS)])
            begins = np.searchsorted(row, np.arange(len(own)))
            least = np.minimum.reduceat(distance, begins)
            at_least = np.flatnonzero(distance == least[row])
            index[start:start + len(own)] = entry[at_least[np.searchsorted(row[at_least], np.arange(len(own)))]]
            error[start:start + len(own)] = least
        return index, error


class Codebooks:
    """Codebooks (part, entry, position) with the memory of their cells."""

    def __init__(self, books: np.ndarray, width: int = WIDTH) -> None:
        self.books = books
        self.cells = [Cells(b, width) for b in books]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance), each rows by parts."""
        found = [c.nearest(part) for c, part in zip(self.cells, np.split(x, len(self.books), axis=1), strict=True)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def grouped(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry over all books, part vector) of every part."""
        index, _ = self.nearest(x)
        parts, entries, width = self.books.shape
        return (index + np.arange(parts) * entries).reshape(-1), x.reshape(-1, width)


def learned(rows: DataFrame, entries: int, parts: int, rounds: int, width: int = WIDTH) -> np.ndarray | None:
    """The codebooks of ``rows`` (vec_id, x of one length) after all rounds."""
    first = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return None
    start = np.array([r["x"] for r in first], np.int64)
    books = np.stack(np.split(start, parts, axis=1))
    for _ in range(rounds):
        held = Codebooks(books, width)
        books = means(rows, books.reshape(-1, books.shape[2]), held.grouped).reshape(books.shape)
    return books


def coded(vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, scale: int = 1024, width: int = WIDTH) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` per kept row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = scaled(vectors, scale, "vec_id", "label").select(F.col("vec_id").cast("long").alias("vec_id"), "label", "x")
    fits = rows.where((F.size("x") > 0) & (F.size("x") % parts == 0))
    first = fits.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).collect()
    length = len(first[0]["x"]) if first else -1
    books = learned(fits.where(F.size("x") == length), entries, parts, rounds, width)
    if books is None:
        none = rows.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
        return none if not rows.isEmpty() else empty_like(spark, SCHEMA)
    held = Codebooks(books, width)
    digits = 2 if entries <= 256 else len(f"{entries - 1:x}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                index, error = held.nearest(matrix(batch.column(1)))
                code = ["".join(f"{i:0{digits}x}" for i in row) for row in index.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(code), pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    found = rows.where(F.size("x") == length).select("vec_id", "x", "label").mapInArrow(encode, f"vec_id long, label {label}, code string, error long")
    other = rows.where(F.size("x") != length).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    whole = cut(found.unionByName(other))
    sums = whole.groupBy(F.col("label").alias("of_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")).select(
        "of_label", F.when(F.col("s") <= F.lit(MAX_LONG), F.col("s").cast("long")).alias("label_error"))
    return whole.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(numbers_sha256(books.reshape(-1).tolist())).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds(last: int) -> str:
    """Assignments a0 to a<last> of parts p (r, part, e) to entries c0 to c<last> (part, k, e), each from the one before."""
    square = "list_sum(list_transform(range(1, len(p.e) + 1), lambda i: (p.e[i] - c.e[i]) * (p.e[i] - c.e[i])))"
    steps = []
    for i in range(last + 1):
        if i:
            steps.append(f"""c{i} AS MATERIALIZED (SELECT c.part, c.k, coalesce(new.e, c.e) AS e FROM c{i - 1} c LEFT JOIN (
  SELECT part, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM (
    SELECT part, k, i, sum(x) AS s, count(*) AS n FROM (
      SELECT part, k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{i - 1}) GROUP BY part, k, i) GROUP BY part, k) new
  ON c.part = new.part AND c.k = new.k
)""")
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, part, any_value(e) AS e, min(near).k AS k, min(near).d AS d FROM (
  SELECT p.r, p.part, p.e, {{'d': CAST({square} AS BIGINT), 'k': c.k}} AS near FROM p JOIN c{i} c ON p.part = c.part) GROUP BY r, part)""")
    return ",\n".join(steps)


#: For vectors of one length, a multiple of four.
ORACLE_OP13 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), p AS MATERIALIZED (
  SELECT r, part, vec_id, e[part * len(e) // 4 + 1 : (part + 1) * len(e) // 4] AS e FROM v CROSS JOIN (SELECT unnest(range(4)) AS part)
), starts AS (
  SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS k FROM v QUALIFY row_number() OVER (ORDER BY vec_id NULLS LAST, e) <= 256
), c0 AS (SELECT part, k, e FROM p JOIN starts USING (r)
), {_rounds(4)},
coded AS (SELECT r, string_agg(lower(printf('%02x', k)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r
), books AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, k)) AS sha FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM v JOIN coded USING (r) CROSS JOIN books
"""
