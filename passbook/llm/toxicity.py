"""Toxicity scores by non-negative positive-unlabelled (nnPU) learning.

Positives are confirmed toxic training rows, at most ``max_positive`` of them (those of least
id hash); texts whose word sets agree in three min-hashes are near copies and count once.
Unlabelled are all training documents, whatever their labels.  Words that at least ``MIN_POSITIVE``
positives hold are candidates; Spark counts in how many of all training documents each
occurs, and all candidates become the model's words that have a log-likelihood ratio between the two of ``min_llr``
at least and are held by ``min_lift`` times the share of positives as of the documents that are none (by the prior).
The second limit does not depend on the number of rows: with many of them every slight preference is significant.  A text matters to the model by which of these
it holds, so Spark counts the different sets over all training documents, and the risk of
the unlabelled is an exact sum over all of them:

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)),

minimised by a numpy logistic model on word presence, with the ascent step of the method
whenever the second part is negative.  The class prior is the share of label 1 over all labelled training rows.
The driver gathers the word sets of the positives and one count for each candidate word.  The
different sets of the unlabelled stay in Spark, which sums the risk and its gradient over them for
every step; where they hold at most ``LOCAL`` words together they are gathered once and the
same sums are made on the driver, so the model does not depend on which of the two it was.

Scoring streams over all rows: whole texts, word by word, no shuffle.

Defined results: null or empty text scores like a text without known words; labels of
null toxicity or null id teach nothing; an id that repeats among the labels counts once as a positive, and each of its texts.
Without any positive row, every score is the prior (about 0 without labels).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, mix64, need, sliced

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 22
MEMO = 300_000
#: Positives that must hold a word of the model.
MIN_POSITIVE = 3
#: Words and sets of the unlabelled up to which the driver sums their risk itself (about 100 MB).
LOCAL = 1 << 21


class WordBuckets(dict):
    """Hash bucket per word; remembers ``MEMO`` words at most."""

    def __missing__(self, word: str) -> int:
        bucket = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(self) < MEMO:
            self[word] = bucket
        return bucket


def word_set(text: str | None, buckets: WordBuckets) -> list[int]:
    """The distinct buckets of the words (runs of letters, in lower case) of a whole text."""
    return [buckets[w] for w in set(WORD.findall(text.lower()))] if text else []


@dataclass
class Toxicity:
    """Weights per bucket (sorted) and a bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.by_bucket = dict(zip(self.buckets.tolist(), self.weights.tolist(), strict=True))

    def score(self, text: str | None, buckets: WordBuckets) -> float:
        get = self.by_bucket.get
        found = {b for w in set(WORD.findall(text.lower())) if (b := buckets[w]) in self.by_bucket} if text else ()
        z = self.bias + sum(get(b) for b in found)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def least_hashed(ids: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` different ids of ``ids`` (doc_id), those of least hash."""
    return ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def distinct_sets(docs: DataFrame, ids: DataFrame, limit: int) -> list[np.ndarray]:
    """At most ``limit`` word sets of the documents in ``ids`` (a bounded table, so it is broadcast), one for each triple of min-hashes."""
    seeds = mix64(np.arange(1, 4, dtype=np.uint64))[:, None]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = WordBuckets()
        for batch in sliced(batches):
            out = [sorted(word_set(t, buckets)) for t in batch.column(0).to_pylist()]
            least = [mix64(np.array(x, np.uint64) ^ seeds).min(1).tobytes() if x else None for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(least, pa.binary()), pa.array(out, pa.list_(pa.int32()))], ["least", "words"])

    chosen = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    found = chosen.mapInArrow(sets, "least binary, words array<int>").where("least is not null").groupBy("least").agg(
        F.min("words").alias("words")).orderBy("least").limit(limit).toArrow()["words"]
    return [part.values.to_numpy()[i:j] for part in found.chunks for i, j in pairwise(part.offsets.to_pylist())]


def presence(docs: DataFrame, candidates: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many rows of ``docs`` (text) each of the candidate buckets (sorted) occurs, and the number of rows."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, place = WordBuckets(), {b: k for k, b in enumerate(candidates.tolist())}
        n, rows = np.zeros(len(candidates), np.int64), 0
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                n[[k for b in word_set(text, buckets) if (k := place.get(b)) is not None]] += 1
            rows += batch.num_rows
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, found]), pa.array(np.r_[rows, n[found]])], ["k", "n"])

    out, rows = np.zeros(len(candidates)), 0
    for r in docs.select("text").mapInArrow(counts, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        if r["k"] < 0:
            rows = r["n"]
        else:
            out[r["k"]] = r["n"]
    return out, rows


def patterns(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """``(held, n)``: the different sets of ``words`` (sorted buckets) that rows of ``docs`` (text) hold, and how many rows hold each.

    A set is the rising places of its words in ``words``, as little-endian 32-bit integers.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, place = WordBuckets(), {b: k for k, b in enumerate(words.tolist())}
        found: Counter[bytes] = Counter()
        for batch in sliced(batches):
            found.update(packed(word_set(t, buckets), place) for t in batch.column(0).to_pylist())
            if len(found) > 1 << 17:
                yield table(found)
                found.clear()
        yield table(found)

    def table(found: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["held", "n"])

    return docs.select("text").mapInArrow(sets, "held binary, n long").groupBy("held").agg(F.sum("n").alias("n"))


def packed(buckets: list[int], place: dict[int, int]) -> bytes:
    return np.array(sorted(k for b in buckets if (k := place.get(b)) is not None), "<i4").tobytes()


class Sets:
    """Word sets as rows of a sparse 0/1 matrix, and the weight of each row."""

    def __init__(self, held: list[bytes], counts: np.ndarray) -> None:
        self.words = np.frombuffer(b"".join(held), "<i4")
        self.rows = np.repeat(np.arange(len(held)), [len(x) // 4 for x in held])
        self.counts = counts

    def margins(self, w: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(self.rows, w[self.words], len(self.counts))

    def gather(self, d: np.ndarray, width: int) -> np.ndarray:
        """Sum of ``d`` (one value per row) over the rows that hold each word."""
        return np.bincount(self.words, d[self.rows], width)

    def as_negative(self, w: np.ndarray, b: float) -> np.ndarray:
        """Gradient by words, gradient by bias and sum of the loss of all rows as negatives, one after another."""
        z = self.margins(w, b)
        d = sigmoid(z) * self.counts
        return np.r_[self.gather(d, len(w)), d.sum(), (np.logaddexp(0, z) * self.counts).sum()]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def unlabelled_risk(found: DataFrame, local: int = LOCAL) -> Callable[[np.ndarray, float], np.ndarray]:
    """``as_negative`` per row of the documents counted in ``found`` (of ``patterns``): by Spark, or by the driver if their size allows it."""
    found = cut(found)
    rows, size = found.agg(F.sum("n"), F.sum(F.length("held") / 4 + 1)).first()
    if size <= local:
        t = found.orderBy("held").toArrow()
        sets = Sets(t["held"].to_pylist(), t["n"].to_numpy().astype(float))
        return lambda w, b: sets.as_negative(w, b) / rows

    def risk(w: np.ndarray, b: float) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(w) + 2)
            for batch in sliced(batches):
                total += Sets(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float)).as_negative(w, b)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "x"])

        sums = found.mapInArrow(part, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros(len(w) + 2)
        out[sums["k"].to_numpy()] = sums["x"].to_numpy()
        return out / rows

    return risk


def log_likelihood_ratio(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> np.ndarray:
    """G statistic of presence counts a of n_a against b of n_b, per word."""

    def part(x, n, p):
        return x * np.log(p) + (n - x) * np.log1p(-p)

    tiny = 1e-12
    p, pa_, pb = ((np.clip(x, tiny, 1 - tiny)) for x in ((a + b) / (n_a + n_b), a / n_a, b / n_b))
    return 2 * (part(a, n_a, pa_) + part(b, n_b, pb) - part(a, n_a, p) - part(b, n_b, p))


def no_words(prior: float) -> Toxicity:
    """The model that gives every text the prior."""
    prior = float(np.clip(prior, 1e-6, 1 - 1e-6))
    return Toxicity(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))


def fit_nnpu(words: np.ndarray, positive: Sets, unlabelled: Callable[[np.ndarray, float], np.ndarray], prior: float,
             epochs: int = 400, rate: float = 0.1, decay: float = 1e-5) -> Toxicity:
    """Fit the logistic model with the non-negative risk estimator by full-batch Adam steps.

    ``positive``: the positives' sets of ``words``; ``unlabelled``: see ``unlabelled_risk``.
    """
    model = no_words(prior)
    prior = 1 / (1 + np.exp(-model.bias))
    n = len(positive.counts)
    x = np.r_[np.zeros(len(words)), model.bias]
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, epochs + 1):
        w, b = x[:-1], x[-1]
        zp, risk = positive.margins(w, b), unlabelled(w, b)
        negative = risk[-1] - prior * np.logaddexp(0, zp).mean()
        plus, minus, du = -prior * sigmoid(-zp) / n, -prior * sigmoid(zp) / n, risk[:-1]
        if negative >= 0:
            dp = plus + minus
        else:  # the estimate fell below zero: step back from the overfit part
            dp, du = -minus, -du
        g = np.r_[positive.gather(dp, len(w)) + decay * w, dp.sum()] + du
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Toxicity(words, x[:-1], float(x[-1]))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 6000, min_llr: float = 16.0,
          min_lift: float = 2.0) -> Toxicity:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), both already cut to the training fold."""
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic")
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    prior = ones / n if n else 0.0
    positive = distinct_sets(docs, least_hashed(known.where("toxic = 1"), max_positive), max_positive) if ones else []
    if not positive:
        return no_words(prior)
    buckets, held = np.unique(np.concatenate(positive), return_counts=True)
    candidates, held = buckets[held >= MIN_POSITIVE], held[held >= MIN_POSITIVE]
    n_unlabelled, rows = presence(docs, candidates)
    ratio = log_likelihood_ratio(held, len(positive), n_unlabelled, rows)
    by_positives, by_all = held / len(positive), n_unlabelled / rows
    lifted = by_positives * (1 - prior) >= min_lift * (by_all - prior * by_positives)
    words = candidates[(ratio >= min_llr) & lifted]
    if not len(words):
        return no_words(prior)
    place = {b: k for k, b in enumerate(words.tolist())}
    own = Sets([packed(x.tolist(), place) for x in positive], np.ones(len(positive)))
    return fit_nnpu(words, own, unlabelled_risk(patterns(docs, words)), prior)


def score(docs: DataFrame, model: Toxicity, threshold: float = 0.3) -> DataFrame:
    """The columns of ``docs`` (one of them text) that are not text, plus score and predicted, per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = WordBuckets()
        for batch in sliced(batches):
            s = np.array([shared.value.score(t, buckets) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scores, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Toxicity, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (with a column text) whose score is below ``threshold``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = WordBuckets()
        for batch in sliced(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([shared.value.score(t, buckets) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def training_fold(table: DataFrame) -> DataFrame:
    return table.where(fold("doc_id", 4) != 2)


def model_for(spark: SparkSession, sf_dir: str) -> Toxicity:
    """The production model: learned from the training fold of documents and labels."""
    docs = need(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    labels = need(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "toxic")
    return train(training_fold(docs), training_fold(labels))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, model_for(spark, sf_dir)).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "score", "predicted")
