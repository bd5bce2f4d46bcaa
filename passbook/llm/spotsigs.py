"""Document fingerprints by spot signatures.

Anchors are the words that most documents of the corpus hold.  After every anchor of a text stands a
chain of the next ``CHAIN`` content words (words that are no anchors); anchor and chain make
one spot signature, a 32-bit hash.  The fingerprint is the set of a text's signatures, written as
Base64 of the sorted little-endian numbers, so the likeness of two texts (Jaccard) follows from their
fingerprints alone.  A change of some words moves only the signatures whose chains hold them.

* ``edits`` compares every document with its edited self and with the next one: rows are dealt into
  ranges of (doc_id, text hash), so texts move once; the first text of a range is copied to the range before.
* ``linked`` finds all near copies: sets are partitioned by length so that a pair above the limit
  lies in one or two neighbouring partitions, posted there under their rarest signatures, and compared by
  a Jaccard that stops as soon as the limit is out of reach.

Defined results.  Words are runs of letters, digits and underscores in lower case.  A text without a full
chain has one signature, of all its words; one without a word, of all its characters; a null or empty text
has the empty set, which is like the empty set alone (likeness 1) and links with nothing.  The order of documents is that of
(doc_id, text hash), null ids last; repeated rows follow one another.  A single document is its own next one.
In ``linked`` rows of one id with different texts are different documents; a null id has a null component and is kept.
An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, empty_like, mix64, need, shuffle_partitions, sliced

WORD = re.compile(r"\w+")
#: Number of anchors, and content words of a chain.
ANCHORS, CHAIN = 400, 2
#: Characters of an anchor at most.
LONGEST = 32
#: Words that a worker counts before it passes them on, and words whose hash it remembers.
COUNTED, MEMO = 400_000, 300_000
#: Members of a list that one task compares with as many others.
BLOCK = 1000


def common_words(docs: DataFrame, count: int = ANCHORS) -> list[str]:
    """The ``count`` words that most documents of (text) hold; ties to the lesser word."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            words = [w for w in held if len(w) <= LONGEST]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                held.update(set(WORD.findall(text.lower())))
                if len(held) > COUNTED:
                    yield passed()
        yield passed()

    words = need(docs, "text").where("text is not null").mapInArrow(counts, "word string, n long")
    top = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(count)
    return [r["word"] for r in top.collect()]


class Spots:
    """Signature sets for given anchors."""

    def __init__(self, anchors: Sequence[str], chain: int = CHAIN) -> None:
        self.anchors, self.chain, self.hashes = frozenset(anchors), chain, {}

    def _hash(self, word: str) -> int:
        """64-bit hash of a word; the last bit tells an anchor."""
        h = self.hashes.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1 << 1 | (word in self.anchors)
            if len(self.hashes) < MEMO:
                self.hashes[word] = h
        return h

    def signatures(self, text: str | None) -> np.ndarray:
        """The sorted distinct signatures of a whole text."""
        words = WORD.findall((text or "").lower())
        if not words:
            if not text:
                return np.zeros(0, np.uint32)
            return np.array([xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))], np.uint32)
        h = np.fromiter(map(self._hash, words), np.uint64, len(words))
        anchor = (h & np.uint64(1)).astype(bool)
        at, content = np.flatnonzero(anchor), np.flatnonzero(~anchor)
        follows = np.searchsorted(content, at)
        full = follows + self.chain <= len(content)
        if not full.any():
            return np.array([xxhash.xxh32_intdigest(h.tobytes())], np.uint32)
        out, follows = h[at[full]], follows[full]
        for k in range(self.chain):
            out = mix64(out * np.uint64(0x100000001B3) + h[content[follows + k]])
        return np.unique((out >> np.uint64(32)).astype(np.uint32))


def fingerprint(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def likeness(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets, or 0 as soon as it can't reach ``least``."""
    if len(x) > len(y):
        x, y = y, x
    if not len(y):
        return 1.0
    if len(x) < least * len(y):
        return 0.0
    need_both = least / (1 + least) * (len(x) + len(y))
    both, step = 0, len(x) if not least else 256
    for at in range(0, len(x), max(step, 1)):
        own = x[at:at + step]
        both += int((y[np.minimum(np.searchsorted(y, own), len(y) - 1)] == own).sum())
        if both + len(x) - at - len(own) < need_both - 1e-9:
            return 0.0
    found = both / (len(x) + len(y) - both)
    return found if found >= least - 1e-12 else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


EDITS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double, n_signatures long")


def edits(docs: DataFrame, anchors: Sequence[str], chain: int = CHAIN) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and likenesses (``EDITS``)."""
    spark = docs.sparkSession
    texts = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.select("doc_id", F.xxhash64("text").alias("h"), "text")
    n = shuffle_partitions(spark)
    # the least (doc_id, h) of every range: one row a partition
    ranges = rows.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h").repartitionByRange(n, "none", "id", "h")
    firsts = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("none", "id", "h")).alias("first")).collect()
    bounds = sorted((r["first"]["none"], r["first"]["id"], r["first"]["h"]) for r in firsts)
    if not bounds:
        return empty_like(spark, EDITS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row in its range, and the first of a range, as a copy, in the one before too."""
        for batch in batches:
            keys = [(i is None, i or 0, h) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            own = [bisect_right(bounds, k) - 1 for k in keys]
            first = [at for at, (k, b) in enumerate(zip(keys, own, strict=True)) if bounds[b] == k]
            for chosen, to, copy in ((None, own, False), (first, [(own[at] - 1) % len(bounds) for at in first], True)):
                part = batch if chosen is None else batch.take(pa.array(chosen, pa.int64()))
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to, pa.int32()), pa.array([copy] * part.num_rows), *part.columns], ["range", "copy", "doc_id", "h", "text"])

    moved = rows.mapInArrow(dealt, "range int, copy boolean, doc_id long, h long, text string").repartitionById(
        len(bounds), F.col("range")).sortWithinPartitions("copy", F.col("doc_id").asc_nulls_last(), "h")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots, kind = Spots(anchors, chain), pa.schema([
            ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_signatures", pa.int64())])
        last = None
        for batch in sliced(batches):
            out = []
            for copy, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4)), strict=True):
                if copy and last is None:
                    continue  # a further copy of the first row of the next range
                own = spots.signatures(text)
                if last is not None:
                    of, before, signed = last
                    new = edited(before, text)
                    changed = spots.signatures(new)
                    out.append((of, len(before), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(signed),
                                fingerprint(changed), likeness(signed, changed), likeness(signed, own), len(signed)))
                last = None if copy else (doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    return moved.mapInArrow(compared, EDITS)


def signed(docs: DataFrame, anchors: Sequence[str], chain: int = CHAIN) -> DataFrame:
    """``(doc_id, n_signatures, class, signatures)`` per row; class and signatures are null for the empty set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = Spots(anchors, chain)
        for batch in sliced(batches):
            found = [spots.signatures(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in found], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary()),
                pa.array([s.tobytes() if len(s) else None for s in found], pa.binary())], ["doc_id", "n_signatures", "class", "signatures"])

    rows = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(sets, "doc_id long, n_signatures long, class binary, signatures binary")


def posted(classes: DataFrame, least: float) -> DataFrame:
    """``(part, token, id, n, visits)``: classes under their rarest shared signatures, in the partition of their length and,
    visiting, in the next longer one."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            token = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.repeat(n, n)), pa.array(token)], ["id", "n", "token"])

    every = classes.select("id", "n", "signatures").mapInArrow(tokens, "id long, n long, token long")
    lengths = every.groupBy("token").agg(F.count(F.lit(1)).alias("length")).where("length > 1").withColumnRenamed("token", "t")
    ordered = every.join(lengths, every["token"] == lengths["t"], "left").select(
        "id", "n", F.struct(F.coalesce("length", F.lit(1)).alias("length"), "token").alias("x"))
    # two sets with enough in common share a signature among the rarest n - ceil(least * n) + 1 of each
    prefix = (F.col("n") - F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)) + 1).cast("int")
    rarest = ordered.groupBy("id", "n").agg(F.sort_array(F.collect_list("x")).alias("x")).select(
        "id", "n", F.explode(F.slice("x", F.lit(1), prefix)).alias("x")).where("x.length > 1")
    part = F.floor(F.log(F.col("n")) / F.lit(-math.log(least) * (1 + 1e-9))).cast("int")
    return rarest.select("id", "n", "x.token", F.explode(F.array(
        F.struct(part.alias("part"), F.lit(False).alias("visits")), F.struct((part + 1).alias("part"), F.lit(True).alias("visits")))).alias("p")).select(
        "p.part", "token", "id", "n", "p.visits")


def linked(docs: DataFrame, anchors: Sequence[str], percent: int = 80, chain: int = CHAIN) -> DataFrame:
    """``(doc_id, n_signatures, component_id, kept)`` per row of ``docs``: components of likeness >= percent / 100.

    The least and the greatest member of every list are compared with all others first.  Lists that then still
    hold several components are dealt over blocks and compared inside tasks, which return
    the edges that connect what they found.
    """
    least = percent / 100
    rows = cut(signed(docs, anchors, chain))
    classes = cut(rows.where("class is not null and doc_id is not null").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("signatures").alias("signatures"), F.first("n_signatures").alias("n")).withColumn(
        "id", F.monotonically_increasing_id()))
    lists = cut(posted(classes, least))
    ends = lists.groupBy("part", "token").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(
        F.col("part").alias("p"), F.col("token").alias("t"), "lo", "hi")
    same = (lists["part"] == ends["p"]) & (lists["token"] == ends["t"])
    pairs = lists.join(ends, same).select(F.explode(F.array(
        F.struct(F.col("lo").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("hi").alias("b")))).alias("x")).select(
        "x.a", "x.b").where("a <> b").distinct()

    def of(side: str) -> DataFrame:
        return classes.select(F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"), F.col("signatures").alias(f"{side}_set"))

    left, right = of("a"), of("b")
    both = pairs.join(left, pairs["a"] == left["a_id"]).join(right, pairs["b"] == right["b_id"]).where(
        100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")).select("a", "b", "a_set", "b_set")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x, y = ([np.frombuffer(s, np.uint32) for s in batch.column(i).to_pylist()] for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array([likeness(p, q, least) > 0 for p, q in zip(x, y, strict=True)], pa.bool_()))

    links = cut(both.mapInArrow(near, "a long, b long"))
    component = cut(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    more = cut(_across(lists, classes, component, least))
    if not more.isEmpty():
        component = cut(connected_components(more.union(component.select(F.col("node").alias("src"), F.col("component").alias("dst")))))
    member = component.join(classes.select("id", "doc_id"), F.col("id") == F.col("node"))
    first = member.groupBy("component").agg(F.min("doc_id").alias("first")).withColumnRenamed("component", "f_component")
    named = member.join(first, F.col("component") == F.col("f_component")).select(F.col("node").alias("m_id"), "first")
    of_class = classes.join(named, classes["id"] == named["m_id"], "left").select(F.col("class").alias("c"), F.coalesce("first", "doc_id").alias("of_class"))
    return rows.join(of_class, rows["class"] == of_class["c"], "left").select(
        "doc_id", "n_signatures", F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _across(lists: DataFrame, classes: DataFrame, component: DataFrame, least: float) -> DataFrame:
    """Edges (src, dst) between the components that a list still holds."""
    keys = ["part", "token", "i", "j"]
    named = lists.join(component, lists["id"] == component["node"], "left").select(
        "part", "token", "id", "visits", F.coalesce("component", "id").alias("own"))
    still = named.groupBy("part", "token").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count(F.lit(1)).alias("length")).where("lo < hi").select(
        F.col("part").alias("p"), F.col("token").alias("t"), F.ceil(F.col("length") / BLOCK).cast("int").alias("blocks"))
    sets = classes.select(F.col("id").alias("s_id"), "signatures")
    opened = named.join(still, (named["part"] == still["p"]) & (named["token"] == still["t"])).join(sets, F.col("id") == F.col("s_id")).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = opened.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "part", "token", "id", "visits", "own", "signatures", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, visits, block = pdf["id"].to_numpy(), pdf["visits"].to_numpy(), pdf["block"].to_numpy()
        sets = [np.frombuffer(s, np.uint32) for s in pdf["signatures"]]
        of, group = np.unique(pdf["own"].to_numpy(), return_inverse=True)
        root = np.arange(len(of))  # components are joined as links are found
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        src, dst = [], []
        for a in range(len(ids)):
            others = np.flatnonzero((root[group] != root[group[a]]) & ~(visits & visits[a]) & ((i == j) | (block != block[a])))
            for b in others[others > a]:
                if root[group[a]] != root[group[b]] and likeness(sets[a], sets[b], least) > 0:
                    src.append(ids[a])
                    dst.append(ids[b])
                    root[root == root[group[b]]] = root[group[a]]
        return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    return spread.groupBy(*keys).applyInPandas(compare, "src long, dst long").distinct()


def op12_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return edits(docs, common_words(docs)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures")
