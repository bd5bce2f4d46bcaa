"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents become token ids (plus an end id); longer ones than the capacity are cut into
full pieces and a rest.  What decides a packing is only how many pieces there are of
each length, at most ``capacity`` numbers however large the corpus, so the plan is made
on that histogram: sets that provably dominate every alternative are fixed for good
(a piece that nothing fits beside, a pair that fills a sequence exactly, the best
partner where only one more piece can fit, or where its length beats any two that fit),
which shrinks the instance until none is found; best fit in order of falling length
places the rest.  Equal sequences are handled together, with a multiplicity.

The plan is a table of runs (length, first rank, bins, offset), its size bounded by the
capacity.  Pieces get a gapless rank within their length from salted windows (a length
that a third of all pieces share is ranked by many tasks) and find sequence and offset
in the run that holds their rank.

``pack_stream`` keeps the order of a stream of documents, as a mix of sources needs it: every
window of documents that follow each other in the files is packed by a plan of its own, in
a task of its own, and sequence numbers rise from window to window.  That costs at most
about one sequence a window.

Defined results: null or empty text is the end id alone, one piece of length 1.
Repeated rows are packed each.  A null id is packed like any other.  An empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, need, rank_in_groups, sliced
from .tokens import WordIds

END_ID = b"\0\0\0\0"
CAPACITY = 2048


#: Documents of a window of ``pack_stream``.
WINDOW = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, window)`` of all rows of ``docs`` (doc_id, text, window)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(tokenizer)
        step = 4 * capacity
        for batch in sliced(batches):
            doc, piece, start, length, crc, of = [], [], [], [], [], []
            for doc_id, text, window in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = ids_of((text or "").encode("utf-8", "surrogatepass")) + END_ID
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    of.append(window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array(of, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "window"])

    rows = need(docs, "doc_id", "text", "window").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "window")
    return rows.mapInArrow(encode, f"{PIECES}, window long")


class Stock:
    """How many pieces are left of each length, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.n)

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        if not self.n[length]:
            del self.n[length]
            del self.lengths[bisect_left(self.lengths, length)]

    def longest_up_to(self, limit: int) -> int | None:
        at = bisect_right(self.lengths, limit)
        return self.lengths[at - 1] if at else None

    def smallest_sum(self, k: int, without: int) -> int:
        """The sum of the k shortest pieces once one piece of length ``without`` is out; infinite if too few."""
        total = 0
        for x in self.lengths:
            free = self.n[x] - (x == without)
            use = min(k, free)
            total += x * use
            k -= use
            if not k:
                return total
        return 1 << 60

    def best_pair(self, limit: int, without: int) -> int:
        """The greatest sum of two pieces that is at most ``limit``; 0 if there is none."""
        best = 0
        i, j = 0, len(self.lengths) - 1
        while i <= j and i < len(self.lengths):
            a, b = self.lengths[i], self.lengths[j]
            if a + b > limit:
                j -= 1
            else:
                if a != b or self.n[a] - (a == without) >= 2:
                    best = max(best, a + b)
                i += 1
        return best


def reduce_by_dominance(stock: Stock, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Take fixed sets out of ``stock``: (lengths in a sequence, number of such sequences)."""
    fixed = []

    def fix(pattern: tuple[int, ...], times: int) -> None:
        fixed.append((pattern, times))
        for x in set(pattern):
            stock.take(x, times * pattern.count(x))

    changed = True
    while changed:
        changed = False
        for x in list(reversed(stock.lengths)):
            while x in stock.n:
                room = capacity - x
                if stock.smallest_sum(1, x) > room:
                    fix((x,), stock.n[x])  # nothing fits beside it
                    changed = True
                    continue
                y = stock.longest_up_to(room)
                if y == x and stock.n[x] < 2:
                    y = stock.longest_up_to(x - 1)
                pairs = stock.n[x] // 2 if y == x else min(stock.n[x], stock.n[y])
                if y == room:
                    fix((x, y), pairs)  # fills the sequence
                    changed = True
                    continue
                # removals only raise the smallest sums and lower the best pair, so a set
                # that dominates does so for as long as both lengths last
                if stock.smallest_sum(2, x) > room or (
                        stock.smallest_sum(3, x) > room and y >= stock.best_pair(room, x)):
                    fix((x, y), pairs)
                    changed = True
                    continue
                break
    return fixed


def best_fit(stock: Stock, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Falling lengths, each piece into the open sequence with the least room that holds it."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((pattern, times))

    for x in reversed(list(stock.lengths)):
        left = stock.n[x]
        while left:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                per = capacity // x
                if left >= per:
                    put(capacity - per * x, (x,) * per, left // per)
                    left %= per
                else:
                    put(capacity - left * x, (x,) * left, 1)
                    left = 0
                continue
            room = rooms[at]
            pattern, times = groups[room].pop()
            if not groups[room]:
                del groups[room]
                del rooms[at]
            fit = room // x  # the same sequence stays the best fit while it has room
            if left >= fit:
                used = min(times, left // fit)
                put(room - fit * x, pattern + (x,) * fit, used)
                left -= used * fit
            else:
                used, fit = 1, left
                put(room - fit * x, pattern + (x,) * fit, 1)
                left = 0
            if times > used:
                put(room, pattern, times - used)
    return [p for x in groups.values() for p in x]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, ranks, first sequence, offset), and the number of sequences."""
    stock = Stock(counts)
    patterns = reduce_by_dominance(stock, capacity) + best_fit(stock, capacity)
    rank = dict.fromkeys(counts, 0)
    runs, first = [], 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            runs.append((x, rank[x], times, first, offset))
            rank[x] += times
            offset += x
        first += times
    return runs, first


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset; sequences hold ``capacity`` tokens at most."""
    spark = docs.sparkSession
    cut_up = cut(pieces(need(docs, "doc_id", "text").withColumn("window", F.lit(0).cast("long")), tokenizer, capacity).drop("window"))
    # one row per length
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)
    ranked = rank_in_groups(cut_up, ["length"], ["doc_id", "piece"], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = (t[:, 0].astype(np.uint64) << np.uint64(48)) + t[:, 1].astype(np.uint64)
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length.astype(np.uint64) << np.uint64(48)) + rank.astype(np.uint64), side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(t[at, 3] + rank - t[at, 1]), pa.array(t[at, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def stream_windows(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` (doc_id, text) plus window: the place of each row in the files it is read from, divided by ``size``.

    Files follow each other by the part number that Spark's writers give them, then by name;
    a DataFrame that isn't a scan of files has its partitions for files.  Only one number per file is
    gathered, in a table as long as the list of files that the driver holds for the scan, so it is broadcast.
    """
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        row = F.monotonically_increasing_id()
        placed = docs.select("doc_id", "text", F.lpad(F.shiftright(row, 33).cast("string"), 10, "0").alias("file"), (row % (1 << 33)).alias("row"))
    part = F.regexp_extract("file", r"part-(\d+)", 1).try_cast("long")
    before = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("file").agg((F.max("row") + 1).alias("n")).select(
        F.col("file").alias("of_file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    return placed.join(F.broadcast(starts), placed["file"] == starts["of_file"]).select(
        "doc_id", "text", F.expr(f"(begin + row) div {size}").alias("window"))


def pack_stream(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """Like ``pack``, but each window of ``window`` documents by itself; sequence_id is the window (above bit 32) and a number in it.

    A task holds the pieces of a window, without their ids.
    """

    def place(group: pa.Table) -> pa.Table:
        length, piece = group["length"].to_numpy(), group["piece"].to_numpy()
        order = np.lexsort((piece, group["doc_id"].fill_null(-1).to_numpy(), length))
        kinds, first, counts = np.unique(length[order], return_index=True, return_counts=True)
        runs, _ = plan(dict(zip(kinds.tolist(), counts.tolist(), strict=True)), capacity)
        table = np.array(sorted(runs), np.int64).reshape(-1, 5)
        length, rank = length[order], np.arange(len(order)) - np.repeat(first, counts)
        at = np.searchsorted((table[:, 0] << 40) + table[:, 1], (length << 40) + rank, side="right") - 1
        number = (group["window"].to_numpy() << 32) + table[at, 3] + rank - table[at, 1]
        return group.drop_columns("window").take(order).append_column("sequence_id", pa.array(number)).append_column(
            "offset", pa.array(table[at, 4]))

    return pieces(stream_windows(docs, window), tokenizer, capacity).groupBy("window").applyInArrow(
        place, f"{PIECES}, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
