"""Language identification with interpolated Kneser-Ney character models.

Spark counts the character 4-grams of every training text per language; the counts
(one row per language and 4-gram, with map-side partial sums per batch) are all that the
driver gathers.  All of them are kept, so the model grows with the different 4-grams.  One
training row in ``KEPT_OUT`` is kept out of the counts, for calibration; of a language that has fewer
than ``FEW`` such rows, all rows serve for both.  From the counts the driver derives the continuation
counts of the lower orders and keeps, per language, the interpolated probabilities in
one sorted array of hashes.  A text gets the language of the lowest cross-entropy per
character.  A text whose cross-entropy is above the quantile ``reject_quantile`` of the
rows of its language that were kept out is flagged as rejected.

Normalisation: letters in lower case, everything else one space.

Defined results: null text or no letter gives ``und``, score 0 and no rejection; with
nothing to learn from every text is ``und`` with score 0.  Ties go to the language
that sorts first.  A null id counts as held out and is not learned from.  Very long
texts are cut into segments that overlap by three characters and summed up.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, mix64, need, sliced

ORDER = 4
SEGMENT = 1 << 19
BLOCK = 1 << 20
STEPS = 10_000
KEPT_OUT, FEW = 8, 50
SPACE = 32

_table: list[np.ndarray] = []


def letters_table() -> np.ndarray:
    """For each UTF-16 unit its lower-case letter, or a space for anything else; surrogates stay."""
    if not _table:
        t = np.full(65536, SPACE, np.uint16)
        for c in range(65536):
            ch = chr(c)
            if 0xD800 <= c < 0xE000:
                t[c] = c
            elif unicodedata.category(ch)[0] == "L" or unicodedata.category(ch)[0] == "M":
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 and ord(low) < 65536 else c
        _table.append(t)
    return _table[0]


def normalised(text: str) -> np.ndarray:
    """Letter units with single spaces between words and ORDER-1 spaces before and one after."""
    units = letters_table()[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)]
    gap = units == SPACE
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    units = units[keep]
    if len(units) and units[-1] == SPACE:
        units = units[:-1]
    pad = np.full(ORDER - 1, SPACE, np.uint16)
    return np.concatenate([pad, units, pad[:1]]) if len(units) else units


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(units: np.ndarray) -> np.ndarray:
    """All ORDER-grams, four 16-bit units packed in 64 bits, the last unit lowest."""
    u = units.astype(np.uint64)
    n = len(u) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = u[:n]
    for k in range(1, ORDER):
        out = (out << np.uint64(16)) | u[k:k + n]
    return out


def segments(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each gram, grams) in chunks of about SEGMENT grams that cover all texts."""
    rows, parts, total = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        g = grams(normalised(text))
        for at in range(0, len(g), SEGMENT):
            part = g[at:at + SEGMENT]
            rows.append(np.full(len(part), i, np.int64))
            parts.append(part)
            total += len(part)
            if total >= SEGMENT:
                yield np.concatenate(rows), np.concatenate(parts)
                rows, parts, total = [], [], 0
    if parts:
        yield np.concatenate(rows), np.concatenate(parts)


def gram_counts(training: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over all rows of ``training`` (text, lang): partial sums per task, then one shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            g, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return g, np.bincount(inv, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def flush():
            for lang, parts in held.items():
                g, n = merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            texts = batch.column(0).to_pylist()
            for lang in set(langs):
                for _, g in segments([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    held.setdefault(lang, []).append(np.unique(g, return_counts=True))
                    if len(held[lang]) >= 8:
                        held[lang] = [merged(held[lang])]
            if sum(len(p[0]) for x in held.values() for p in x) > 2_000_000:
                yield from flush()
        yield from flush()

    rows = training.select("text", "lang").where("text is not null and lang is not null")
    return rows.mapInArrow(partial, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Interpolated probabilities of one language over sorted hashes of all its n-grams.

    Counts of the lower orders are continuation counts: how many different units stand
    before an n-gram.  One absolute discount per order, n1 / (n1 + 2 n2).
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, alphabet: int):
        self.alphabet = max(alphabet, 1)
        self.keys, self.values = [], []  # per order 1..ORDER: sorted hashes, (gram mass, ...)
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        g, c = gram, n.astype(np.float64)
        levels = [(g, c)]
        for k in range(ORDER - 1, 0, -1):
            mask = np.uint64((1 << (16 * k)) - 1)
            g, c = np.unique(levels[0][0] & mask, return_counts=True)
            levels.insert(0, (g, c.astype(np.float64)))
        for k, (g, c) in enumerate(levels, 1):
            once, twice = float((c == 1).sum()), float((c == 2).sum())
            d = once / (once + 2 * twice) if once and twice else 0.5
            context, inv = np.unique(g >> np.uint64(16), return_inverse=True)
            total = np.bincount(inv, c)
            kinds = np.bincount(inv)
            back = d * kinds / total
            own = np.maximum(c - d, 0) / total[inv]
            self._add(self.keys, self.values, g, own, k)
            hashes = mix64(context * np.uint64(2) + np.uint64(1))
            order = np.argsort(hashes)
            self.contexts.append((hashes[order], back[order]))

    @staticmethod
    def _add(keys, values, g, own, k) -> None:
        hashes = mix64(g * np.uint64(2) + np.uint64(0))
        order = np.argsort(hashes)
        keys.append(hashes[order])
        values.append(own[order])

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), default)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    def probability(self, g: np.ndarray) -> np.ndarray:
        """P(last unit | the three before) of packed 4-grams."""
        p = np.full(len(g), 1.0 / self.alphabet)
        for k in range(1, ORDER + 1):
            own = g & np.uint64((1 << (16 * k)) - 1) if k < ORDER else g
            context = own >> np.uint64(16)
            back = self._find(*self.contexts[k - 1], mix64(context * np.uint64(2) + np.uint64(1)), 1.0)
            p = self._find(self.keys[k - 1], self.values[k - 1], mix64(own * np.uint64(2)), 0.0) + back * p
        return p


class LanguageModel:
    """Log-probabilities of all 4-grams under every language, in one sorted hash array."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.limits = np.full(len(langs), np.inf)
        every = np.unique(np.concatenate([g for g, _ in tables])) if tables else np.zeros(0, np.uint64)
        alphabet = len(np.unique(every & np.uint64(0xFFFF)))
        self.models = [KneserNey(g, n, alphabet + 1) for g, n in tables]
        hashes = mix64(every)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.logs = np.empty((len(every), len(langs)), np.float32)
        for at in range(0, len(every), BLOCK):
            part = every[order[at:at + BLOCK]]
            for i, m in enumerate(self.models):
                self.logs[at:at + BLOCK, i] = np.log(m.probability(part))

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character under each language, and the number of characters."""
        total = np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts), np.int64)
        for rows, g in segments(texts):
            hashes = mix64(g)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            logs = self.logs[at]
            new = np.flatnonzero(self.hashes[at] != hashes)
            if len(new):
                unseen, inv = np.unique(g[new], return_inverse=True)
                logs[new] = np.stack([np.log(m.probability(unseen)) for m in self.models], 1)[inv]
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            np.add.at(total, rows[starts], np.add.reduceat(logs.astype(np.float64), starts, 0))
            np.add.at(count, rows[starts], np.diff(np.r_[starts, len(rows)]))
        return -total / np.maximum(count, 1)[:, None], count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, list[bool]]:
        """Language, posterior of it, cross-entropy and whether it is rejected, per text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), [False] * len(texts)
        entropy, count = self.cross_entropies(texts)
        best = entropy.argmin(1)
        low = entropy.min(1)
        score = 1 / np.exp(-(entropy - low[:, None]) * count[:, None]).sum(1)
        known = [has_letter(t) for t in texts]
        return ([self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)],
                np.where(known, score, 0.0), low, [bool(k and e > self.limits[b]) for b, k, e in zip(best, known, low, strict=True)])


def quantiles(measured: DataFrame, q: float) -> dict[str, float]:
    """The exact quantile of ``entropy`` per ``lang``, linear between neighbours, without a sort of a language's rows.

    Counts per step of 1 / ``STEPS`` tell the step of each neighbour; only the different
    values of these steps are gathered.
    """
    stepped = measured.withColumn("step", F.floor(F.col("entropy") * STEPS))
    counts = stepped.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["lang", "step"])
    wanted, ranks = [], {}
    for lang, rows in counts.groupby("lang"):
        upto = rows["n"].cumsum().to_numpy()
        at = q * (upto[-1] - 1)
        ranks[lang] = at, []
        for r in (int(at), min(int(at) + 1, upto[-1] - 1)):
            k = int(np.searchsorted(upto, r, side="right"))
            ranks[lang][1].append((int(rows["step"].iloc[k]), r - int(upto[k] - rows["n"].iloc[k])))
        wanted += [(lang, step) for step in {step for step, _ in ranks[lang][1]}]
    if not wanted:
        return {}
    chosen = measured.sparkSession.createDataFrame(wanted, "lang string, step long")
    values = stepped.join(F.broadcast(chosen), ["lang", "step"]).groupBy("lang", "step", "entropy").agg(
        F.count(F.lit(1)).alias("n")).toPandas().sort_values(["lang", "step", "entropy"])
    groups = {key: (rows["entropy"].to_numpy(), rows["n"].cumsum().to_numpy()) for key, rows in values.groupby(["lang", "step"])}

    def value(lang, step, r):
        entropy, upto = groups[lang, step]
        return entropy[np.searchsorted(upto, r, side="right")]

    out = {}
    for lang, (at, places) in ranks.items():
        low, high = (value(lang, *p) for p in places)
        out[lang] = float(low + (high - low) * (at - int(at)))
    return out


def kept_out() -> Column:
    """Whether a training row calibrates instead of being counted: equal texts go the same way."""
    return F.pmod(F.xxhash64("text"), F.lit(KEPT_OUT)) == 0


def train(training: DataFrame, reject_quantile: float = 0.999) -> LanguageModel:
    """Fit on all rows of ``training`` (doc_id, text, lang), but for those kept out for the rejection limits."""
    usable = training.where("text is not null and lang is not null").select("text", "lang")
    # one row per language
    few = [r["lang"] for r in usable.groupBy("lang").agg(F.count_if(kept_out()).alias("n")).where(F.col("n") < FEW).collect()]
    both, out = F.col("lang").isin(few), kept_out()
    counts = cut(gram_counts(usable.where(both | ~out)))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return LanguageModel([], [])
    place = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang"))
    rows = counts.select((place - 1).cast("int").alias("no"), "gram", "n").toArrow()
    no, gram, n = rows["no"].to_numpy(), rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    model = LanguageModel(langs, [(gram[no == i], n[no == i]) for i in range(len(langs))])
    shared = training.sparkSession.sparkContext.broadcast(model)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            entropy, _ = shared.value.cross_entropies(batch.column(0).to_pylist())
            own = [e[langs.index(x)] if x in langs else None for e, x in zip(entropy, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.float64())], ["lang", "entropy"])

    # texts stay on the executors: each row becomes one number
    measured = cut(usable.where(both | out).mapInArrow(entropies, "lang string, entropy double").where("entropy is not null"))
    shared.unpersist()
    limits = quantiles(measured, reject_quantile)
    model.limits = np.array([limits.get(x, np.inf) for x in langs])
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, lang_pred, score, cross_entropy, rejected)`` per row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lang, p, entropy, rejected = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(p), pa.array(entropy), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    rows = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    model = train(docs.where(fold("doc_id", 4) != 2))
    return identify(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score", "rejected")
