"""Document quality by Bradley-Terry pairwise ranking.

Per document a few dozen language-independent measures (symbols, capitals, table
bars, repeated words and lines, lengths ...) are cut into bins at exact quantiles of all
training rows.  From preference pairs (a row of quality 1 before a row of quality 0)
a linear score is learned by logistic loss on feature differences, P(a before b) =
sigmoid(s(a) - s(b)).  The threshold is a quantile of the training scores: the share
of label 0 among all labelled training rows.  The result score is the sigmoid of the
distance to the threshold, so 0.5 is the cut.

All labelled training rows are used, and all pairs of them: a row's loss depends on
the other label's rows through their scores alone, so the sums over pairs are those of two score
distributions on a fine grid, to which every row is dealt linearly.  Spark counts, bins and
sums the rows; where they hold over ``GATHERED`` bins together each step of the fit is two small jobs,
else the bins (a byte each) are summed on the driver.  Scoring streams over all rows and whole texts without a shuffle.

Defined results: null text counts as empty and is scored as such.  Labels with null
quality or null id teach nothing; rows that repeat an id are used as often as they
occur.  If either label value is missing, all scores are 1 (only label 1 known), 0
(only label 0 known) or 0.5 (none).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fold, need, sliced

BINS = 12
#: Bins (a byte each) of training rows that the driver sums itself, rows of a task where Spark does, and cells of the score grid.
GATHERED, ROWS, CELLS = 1 << 21, 500_000, 2048
_classes: list[np.ndarray] = []
#: Character classes of ``measures``.
LOWER, UPPER, DIGIT, SPACE, LINE, BAR, SYMBOL, MARK, OTHER = range(9)


def class_table() -> np.ndarray:
    """The class of each UTF-16 unit."""
    if not _classes:
        t = np.full(65536, OTHER, np.uint8)
        for c in range(65536):
            ch = chr(c)
            if 0xD800 <= c < 0xE000:
                continue
            if ch in "\n\r":
                t[c] = LINE
            elif ch.isspace():
                t[c] = SPACE
            elif ch == "|":
                t[c] = BAR
            elif ch in "#*$%&<>=~^@\\_{}[]":
                t[c] = SYMBOL
            elif ch in ".,;:!?'\"()-":
                t[c] = MARK
            elif ch.isdigit():
                t[c] = DIGIT
            elif ch.isupper():
                t[c] = UPPER
            elif ch.isalpha():
                t[c] = LOWER
        _classes.append(t)
    return _classes[0]


def measures(text: str | None) -> np.ndarray:
    """The measures of one whole text; all finite, zeros for an empty one."""
    text = text or ""
    c = np.bincount(class_table()[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)], minlength=9).astype(float)
    words = text.split()
    n, letters = max(len(words), 1), max(c[LOWER] + c[UPPER], 1.0)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    size = max(len(text), 1)
    return np.array([
        c[SYMBOL] / n, c[BAR] / n, c[UPPER] / letters, c[DIGIT] / size, c[OTHER] / size, c[MARK] / n,
        text.count("!") / n, text.count(".") / n, text.count(",") / n, distinct / n, same / n, pairs / max(len(words) - 1, 1),
        len(set(lines)) / max(len(lines), 1), np.log1p(len(words)), letters / n, n / max(len(lines), 1), np.log1p(c[LINE]),
        c[SPACE] / n, letters / size, text.count("http") / n,
    ])


@dataclass
class Ranker:
    """Bin edges per measure, weights per bin, the threshold and the scale of the result score."""

    edges: np.ndarray
    weights: np.ndarray
    threshold: float
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores of rows of measures."""
        return raw_scores(self.weights, bins(x, self.edges))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -60, 60)))


def bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], 1)


#: Sums of a function of (bins, whether the row is good) over all training rows; or their least, greatest values.
Over = Callable[..., np.ndarray]


def local(x: np.ndarray, good: np.ndarray) -> Over:
    return lambda f, join=np.add: f(x, good)


def spread(rows: DataFrame, width: int) -> Over:
    """The same over a table (good, bins), whose tasks send one array each."""

    def over(f: Callable[[np.ndarray, np.ndarray], np.ndarray], join: np.ufunc = np.add) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in filter(len, batches):
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, width)
                found = f(x, batch.column(0).to_numpy(zero_copy_only=False))
                total = found if total is None else join(total, found)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(float).tobytes()], pa.binary())], ["a"])

        return join.reduce([np.frombuffer(r["a"]) for r in rows.mapInArrow(part, "a binary").collect()])

    return over


def raw_scores(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return w[np.arange(x.shape[1]), x].sum(1)


def all_pairs(over: Over, width: int, n_good: int, n_bad: int, decay: float):
    """``loss(w)`` over all (good, bad) pairs, with what ``slope`` needs to give its gradient there."""

    def loss(w: np.ndarray):
        m = w.reshape(width, BINS)
        low, high = m.min(1).sum() - 1e-6, m.max(1).sum() + 1e-6
        step = (high - low) / (CELLS - 1)

        def dealt(x: np.ndarray, good: np.ndarray) -> np.ndarray:
            place = (raw_scores(m, x) - low) / step
            cell = np.minimum(place.astype(int), CELLS - 2)
            part, side = place - cell, np.where(good, 0, CELLS)
            return np.bincount(cell + side, 1 - part, 2 * CELLS) + np.bincount(cell + 1 + side, part, 2 * CELLS)

        both = over(dealt)
        on_good, on_bad = both[:CELLS] / n_good, both[CELLS:] / n_bad
        apart = step * np.arange(1 - CELLS, CELLS)  # a good row's cell less a bad one's
        against = lambda f: np.convolve(on_bad, f)[CELLS - 1:2 * CELLS - 1]
        value = on_good @ against(np.logaddexp(0, -apart)) + decay / 2 * w @ w
        pull = 1 / (1 + np.exp(np.clip(apart, -500, 500)))
        good_pull = against(pull) / n_good
        bad_pull = np.convolve(on_good, pull[::-1])[CELLS - 1:2 * CELLS - 1] / n_bad
        return value, (low + step * np.arange(CELLS), good_pull, bad_pull)

    def slope(w: np.ndarray, state) -> np.ndarray:
        grid, good_pull, bad_pull = state

        def pulled(x: np.ndarray, good: np.ndarray) -> np.ndarray:
            s = raw_scores(w.reshape(width, BINS), x)
            by_row = np.where(good, -np.interp(s, grid, good_pull), np.interp(s, grid, bad_pull))
            return np.concatenate([np.bincount(x[:, j], by_row, BINS) for j in range(width)])

        return over(pulled) + decay * w

    return loss, slope


def descend(loss, slope, w: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking; ends where a step gains nothing to speak of."""
    value, state = loss(w)
    g, past = slope(w, state), []
    for _ in range(steps):
        q, undo = g.copy(), []
        for d, y in reversed(past):
            undo.append(d @ q / (d @ y))
            q -= undo[-1] * y
        if past:
            d, y = past[-1]
            q *= (d @ y) / (y @ y)
        for (d, y), u in zip(past, reversed(undo), strict=True):
            q += (u - y @ q / (d @ y)) * d
        size = 1.0 if past else 1 / max(np.abs(g).max(), 1e-12)
        while True:
            new = w - size * q
            new_value, new_state = loss(new)
            if new_value <= value - 1e-4 * size * (g @ q) or size < 1e-6:
                break
            size /= 2
        if not new_value < value - 1e-7:
            break
        new_g = slope(new, new_state)
        if (new - w) @ (new_g - g) > 1e-14:
            past = [*past, (new - w, new_g - g)][-memory:]
        w, value, g = new, new_value, new_g
    return w


def threshold_of(over: Over, m: np.ndarray, share: float, weight_good: float, weight_bad: float) -> float:
    """Halfway from the score at which the weights of the scores in order reach ``share`` to the next row's; found by counting in ever finer cells."""
    low, high, below = m.min(1).sum() - 1e-6, m.max(1).sum() + 1e-6, 0.0
    for _ in range(4):
        edges = np.linspace(low, high, 1025)
        weights = over(lambda x, good, e=edges: np.bincount(
            np.searchsorted(e, raw_scores(m, x), side="left"), np.where(good, weight_good, weight_bad), len(e) + 1))
        sums = below + np.cumsum(weights[1:-1])
        at = min(int(np.searchsorted(sums, share - 1e-12)), len(sums) - 1)
        below = sums[at - 1] if at else below
        low, high = edges[at], edges[at + 1]
    value = over(lambda x, good: np.array([np.max(raw_scores(m, x), initial=-np.inf, where=raw_scores(m, x) <= high)]), np.maximum)[0]
    rows, beyond = over(lambda x, good: np.array([np.where(good, weight_good, weight_bad)[raw_scores(m, x) <= value].sum(), (raw_scores(m, x) > value).sum()]))
    if not beyond or rows - share >= max(weight_good, weight_bad):
        return float(value)  # the next row has the same score
    after = over(lambda x, good: np.array([np.min(raw_scores(m, x), initial=np.inf, where=raw_scores(m, x) > value)]), np.minimum)[0]
    return float((value + after) / 2)


def fit(over: Over, edges: np.ndarray, n_good: int, n_bad: int, bad_share: float, steps: int = 100, decay: float = 1e-4) -> Ranker:
    """Logistic loss on the feature differences of all (good, bad) pairs; the threshold is where label 0 has its share of all labelled rows."""
    width = len(edges)
    w = descend(*all_pairs(over, width, n_good, n_bad, decay), np.zeros(width * BINS), steps).reshape(width, BINS)
    return Ranker(edges, w, threshold_of(over, w, bad_share, (1 - bad_share) / n_good, bad_share / n_bad))


def fit_pairs(good: np.ndarray, bad: np.ndarray, bad_share: float, pairs: int | None = None, epochs: int = 100, decay: float = 1e-4) -> Ranker:
    """``fit`` on arrays of measures; ``pairs`` says nothing any more, all of them count."""
    both = np.concatenate([good, bad])
    edges = np.stack([np.quantile(both[:, j], np.arange(1, BINS) / BINS) for j in range(both.shape[1])])
    return fit(local(bins(both, edges).astype(np.uint8), np.arange(len(both)) < len(good)), edges, len(good), len(bad), bad_share, epochs, decay)


def features(texts: list[str | None]) -> np.ndarray:
    """The measures of texts, in single precision as they are counted and cut."""
    return np.array([measures(t) for t in texts], np.float32).reshape(len(texts), len(measures("")))


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(good, x)`` of every document with a label in ``known`` (doc_id, quality); measured before the join, so no text is shuffled."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = [r.tobytes() for r in features(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["doc_id", "x"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("x", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(rows, schema).join(known.distinct(), "doc_id").select((F.col("quality") == 1).alias("good"), "x")


def quantiles(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """The exact order statistics at the ``BINS``-ths of every measure: counts by the first 16 bits of the values, then
    by 8 more of those in the wanted cells, then by the last 8.  Measures aren't negative, so their bits are in their order."""
    rank = np.tile(np.maximum(np.ceil(np.arange(1, BINS) * n / BINS), 1), (width, 1))
    found = np.zeros((width, BINS - 1), np.int64)  # the bits known so far
    for before, shift in ((32, 16), (16, 8), (8, 0)):
        wanted = [np.unique(f) for f in found]

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in filter(len, batches):
                u = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32).reshape(-1, width).astype(np.int64)
                for j in range(width):
                    c = u[:, j]
                    keys, ns = np.unique(c[np.isin(c >> before, wanted[j])] >> shift, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), j)), pa.array(keys), pa.array(ns.astype(np.int64))], ["j", "key", "n"])

        table = rows.select("x").mapInArrow(counts, "j long, key long, n long").groupBy("j", "key").agg(F.sum("n").alias("n")).toArrow()
        js, keys, ns = (table[c].to_numpy() for c in ("j", "key", "n"))
        for j in range(width):
            order = np.argsort(keys[js == j])
            key, sums = keys[js == j][order], np.cumsum(ns[js == j][order])
            for k in range(BINS - 1):
                low, high = np.searchsorted(key, [found[j, k] << (before - shift), (found[j, k] + 1) << (before - shift)])
                start = sums[low - 1] if low else 0
                at = low + int(np.searchsorted(sums[low:high] - start, rank[j, k]))
                rank[j, k] -= (sums[at - 1] if at else 0) - start
                found[j, k] = key[at]
    return found.astype(np.uint32).view(np.float32).reshape(width, BINS - 1)


def measured(docs: DataFrame, ids: DataFrame, limit: int) -> np.ndarray:
    """For a look at some rows (no model is learned from it): measures of at most ``limit`` documents whose id is in ``ids``, a bounded table, so it is broadcast.

    Every document is measured in its task; of the rows (an id may repeat) those of least id and text hash are taken, in that order.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [measures(t).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["h", "t", "x"])

    chosen = docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select(
        F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), "text")
    taken = chosen.mapInArrow(rows, "h long, t long, x array<double>").orderBy("h", "t").limit(limit)
    found = [r.as_py() for r in taken.toArrow()["x"]]
    return np.array(found, float).reshape(len(found), len(measures("")))


def train(docs: DataFrame, labels: DataFrame, gathered: int = GATHERED) -> Ranker:
    """Fit on all rows of ``docs`` (doc_id, text) with ``labels`` (doc_id, quality), both already cut to the training fold."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("quality").cast("long")), F.lit(0))).first()
    width = len(measures(""))
    none = Ranker(np.zeros((width, BINS - 1)), np.zeros((width, BINS)), 0.0)
    if not n or ones in (0, n):
        return Ranker(none.edges, none.weights, 0.0, 0.5 if not n else float(ones == n))
    rows = cut(labelled(docs, known))
    n_rows, n_good = rows.agg(F.count(F.lit(1)), F.count_if("good")).first()
    if n_good in (0, n_rows):
        return Ranker(none.edges, none.weights, 0.0, 0.5)
    edges = quantiles(rows, n_rows, width)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in bins(x, edges).astype(np.uint8)], pa.binary())], ["good", "bins"])

    table = rows.mapInArrow(binned, "good boolean, bins binary")
    if n_rows * width <= gathered:
        got = table.toArrow()
        x, good = np.frombuffer(b"".join(got["bins"].to_pylist()), np.uint8).reshape(-1, width), got["good"].to_numpy()
        order = np.lexsort((*x.T, good))  # so partitions change nothing
        over = local(x[order], good[order])
    else:
        over = spread(cut(table.repartition(-(-n_rows // ROWS))), width)
    return fit(over, edges, n_good, n_rows - n_good, 1 - ones / n)


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """``(doc_id, score, predicted)`` per row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            s = shared.value.score(features(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scores, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Ranker) -> DataFrame:
    """The rows of ``docs`` (with a column text) whose score is at least 0.5, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array(shared.value.score(features(texts)) >= 0.5, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def training_fold(table: DataFrame) -> DataFrame:
    return table.where(fold("doc_id", 3) != 1)


def model_for(spark: SparkSession, sf_dir: str) -> Ranker:
    """The production model: learned from the training fold of documents and labels."""
    docs = need(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    labels = need(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "quality")
    return train(training_fold(docs), training_fold(labels))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, model_for(spark, sf_dir)).select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", "predicted")
