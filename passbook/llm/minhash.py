"""Near duplicates by a signature-coordinate inverted join over MinHash signatures.

1. Texts with equal shingle sets form a class, which goes on once under a number of its own.
2. Every class has a signature of ``coordinates`` minima.  It is posted under its
   (coordinate, value) pairs.  A pair of classes counts as a candidate if at least
   ``threshold`` coordinates collide, a number chosen so that a pair at the similarity
   limit is missed with probability ``miss`` at most.
3. Prefix merging: with all pairs in one global order, rarest first, two signatures
   that share ``threshold`` pairs share one among the first
   ``coordinates - threshold + 1`` of each, so only those are merged.  Skip merging:
   the remaining, more frequent lists are never merged; their collisions are counted
   by comparing the two signatures.  A passage that many texts share sits at the end of
   the order and is skipped, unless a text holds little else.
4. A list of the merge first pairs its least and its greatest member with all others;
   each such candidate is confirmed on the full sets of both texts.  Where these links
   leave a list in several components, the pairs across components are counted block by
   block inside tasks, and the candidates among them confirmed there on full sets.
   Pairs inside one component cannot change the result and are not formed.
5. Connected components by minima give each text the least id reachable.

Defined results.  Null or empty text, or no word: empty set, linked with nothing, its
own component.  Fewer words than ``size``: the whole sequence is the one shingle.
Repeated rows are copies of each other; rows with the same id and different texts are different documents.  A null id: n_shingles as counted, linked with
nothing, component_id null, kept true.  An empty table gives no rows.  Whole texts of
any length are used.  Shingles are compared by 64-bit hash, classes by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, mix64, need, shuffle_partitions, sliced

MEMO = 300_000
#: Members of a list that one task compares with as many others.
BLOCK = 1000


class WordHashes(dict):
    """64-bit hash per word; remembers ``MEMO`` words at most."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO:
            self[word] = h
        return h


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of all ``size``-word shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - size + 1, 1)
    out = np.full(n, np.uint64(min(len(h), size)))
    for k in range(min(size, len(h))):
        out = mix64(out * np.uint64(0x100000001B3) + h[k:k + n])
    return np.unique(out)


def signature(shingle_set: np.ndarray, coordinates: int) -> np.ndarray:
    """The least value of each of ``coordinates`` hash functions over the set."""
    seeds = mix64(np.arange(1, coordinates + 1, dtype=np.uint64))
    odd = mix64(seeds) | np.uint64(1)
    step = max(1, (1 << 18) // len(shingle_set))
    out = []
    for k in range(0, coordinates, step):
        x = (shingle_set ^ seeds[k:k + step, None]) * odd[k:k + step, None]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        out.append(x.min(1))
    return np.concatenate(out)


def class_of(shingle_set: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingle_set.tobytes())


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def match_threshold(coordinates: int, similarity: float, miss: float = 1e-6) -> int:
    """The greatest t such that fewer than t of the coordinates collide with probability <= miss."""
    cumulative, t = 0.0, 0
    for k in range(coordinates + 1):
        cumulative += math.comb(coordinates, k) * similarity ** k * (1 - similarity) ** (coordinates - k)
        if cumulative > miss:
            break
        t = k + 1
    return max(t, 1)


def texts_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, text)``: the id as a number, and a hash that tells the texts of one id apart."""
    return need(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def shingle_sets(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """``(doc_id, h, n_shingles, class, sig)``; class and sig are null for an empty set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches):
            n, cls, sig = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, size, hashes)
                n.append(len(s))
                cls.append(class_of(s) if len(s) else None)
                sig.append(signature(s, coordinates).astype(np.uint32).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "h", "n_shingles", "class", "sig"])

    return texts_of(docs).mapInArrow(sets, "doc_id long, h long, n_shingles long, class binary, sig binary")


def postings(classes: DataFrame, coordinates: int, threshold: int) -> DataFrame:
    """``(token, id, prefix)``: each class under the tokens of its prefix that others share too.

    A token is the coordinate (above bit 32) and the value; prefix has the bits of the prefix's coordinates.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinate = np.arange(coordinates, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, coordinates)
            token = (sig.astype(np.uint64) | coordinate).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, coordinates)), pa.array(token.view(np.int64))], ["id", "token"])

    posted = classes.select("id", "sig").mapInArrow(tokens, "id long, token long")
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("length")).where("length > 1").withColumnRenamed("token", "t")
    ordered = posted.join(lists, posted["token"] == lists["t"], "left").select(
        "id", F.struct(F.coalesce("length", F.lit(1)).alias("length"), "token").alias("x"))
    prefix = coordinates - threshold + 1
    rarest = ordered.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("x")), 1, prefix).alias("x"))
    bits = F.aggregate("x", F.lit(0).cast("long"), lambda b, x: b + F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.shiftright(x["token"], 32).cast("int")))
    return rarest.select("id", F.explode("x").alias("x"), bits.alias("prefix")).where("x.length > 1").select(
        "x.token", "id", "prefix")


def class_texts(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(t_id, text)``: one text for each class in ``ids`` (id), however many rows repeat it."""
    wanted = ids.select(F.col("id").alias("w_id")).distinct()
    chosen = classes.join(wanted, classes["id"] == wanted["w_id"], "left_semi").select(
        F.col("id").alias("t_id"), F.col("doc_id").alias("of"), F.col("h").alias("of_h"))
    texts = texts_of(docs)
    return texts.join(chosen, (texts["doc_id"] == chosen["of"]) & (texts["h"] == chosen["of_h"])).select("t_id", "text").dropDuplicates(["t_id"])


def full_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``(s_id, shingles)`` of the classes in ``ids`` (id): the sorted hashes, made from the text that stands for the class."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches):
            found = [shingles(t, size, hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["s_id", "shingles"])

    return class_texts(ids, classes, docs).mapInArrow(sets, "s_id long, shingles binary")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, threshold: int,
              coordinates: int) -> DataFrame:
    """The pairs (a, b) with enough collisions and 100 * intersection >= percent * union on the full sets."""
    def of(side: str) -> DataFrame:
        names = {"id": "id", "sig": "sig", "n_shingles": "n"}
        return classes.select(*[F.col(k).alias(f"{side}_{v}") for k, v in names.items()])

    left, right = of("a"), of("b")
    joined = pairs.join(left, pairs["a"] == left["a_id"]).join(right, pairs["b"] == right["b_id"]).where(
        (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")))

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, coordinates) for i in (0, 1))
            yield batch.select([2, 3]).filter(pa.array((x == y).sum(1) >= threshold))

    candidates = cut(joined.select("a_sig", "b_sig", "a", "b").mapInArrow(collide, "a long, b long"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0))
        for batch in sliced(batches):
            keep = []
            for a, text_a, text_b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if last[0] != a:
                    last = (a, shingles(text_a, size, hashes))
                keep.append(similar(last[1], shingles(text_b, size, hashes), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    texts = cut(class_texts(candidates.select(F.explode(F.array("a", "b")).alias("id")), classes, docs))
    with_b = candidates.join(texts.withColumnRenamed("text", "b_text"), F.col("b") == F.col("t_id")).drop("t_id")
    return with_b.join(texts.withColumnRenamed("text", "a_text"), F.col("a") == F.col("t_id")).select("a", "b", "a_text", "b_text").mapInArrow(
        compare, "a long, b long")


#: Lists of at most so many members are compared many at a time.
SMALL = 64
PAIRS = 1 << 17


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that hold only whole groups of a partition that is sorted by ``keys``."""
    held = None
    for pdf in frames:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        last = np.logical_and.reduce([pdf[k].to_numpy() == pdf[k].iloc[-1] for k in keys])
        first = int(last.argmax())
        if first:
            yield pdf.iloc[:first].reset_index(drop=True)
        held = pdf.iloc[first:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def group_pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (r, c), r before c, within each group of rows, in arrays of about ``PAIRS``."""
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        x, y = np.triu_indices(size, 1)
        own = starts[sizes == size]
        step = max(1, PAIRS // len(x))
        for k in range(0, len(own), step):
            yield (own[k:k + step, None] + x).reshape(-1), (own[k:k + step, None] + y).reshape(-1)
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        step = max(1, PAIRS // size)
        for k in range(0, size, step):
            r = np.repeat(np.arange(k, min(k + step, size)), size)
            c = np.tile(np.arange(size), len(r) // size)
            later = c > r
            yield start + r[later], start + c[later]


def candidate_pairs(pdf: pd.DataFrame, coordinates: int, threshold: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one list and pair of blocks that are candidates, lie in different components and first meet there."""
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, coordinates)
    mask = (pdf["prefix"].to_numpy()[:, None] >> np.arange(coordinates)) & 1 == 1
    token, i, j, part, own, count = (pdf[c].to_numpy() for c in ("token", "i", "j", "part", "own", "n_shingles"))
    new = np.r_[True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
    starts = np.flatnonzero(new)
    for r, c in group_pairs(starts, np.diff(np.r_[starts, len(pdf)])):
        fits = (part[r] != part[c]) & ((i[r] == j[r]) | (own[r] != own[c]))
        fits &= 100 * np.minimum(count[r], count[c]) >= percent * np.maximum(count[r], count[c])
        r, c = r[fits], c[fits]
        equal = sig[r] == sig[c]
        fits = (equal.sum(1) >= threshold) & ((equal & mask[r] & mask[c]).argmax(1) == token[r] >> 32)
        if fits.any():
            yield r[fits], c[fits]


def across(lists: DataFrame, classes: DataFrame, docs: DataFrame, component: DataFrame, size: int, percent: int,
           threshold: int, coordinates: int) -> DataFrame:
    """Edges (src, dst) between components: confirmed links of lists that still hold several components.

    First the signatures alone tell which members have a candidate in another component;
    only those return with their full sets.  Each pair is looked at in one list, that of the
    least coordinate they share among their prefixes.  No pair leaves a task: it returns
    an edge from each linked class to the least it is linked with in the task, directly or not.
    """
    spark = docs.sparkSession
    n, keys = max(8, shuffle_partitions(spark)), ["token", "i", "j"]
    named = lists.join(component, lists["id"] == component["node"], "left").select(
        "token", "id", "prefix", F.coalesce("component", "id").alias("part"))
    tokens_open = named.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select(
        F.col("token").alias("t"))
    sigs = classes.select(F.col("id").alias("c_id"), "sig", "n_shingles")
    members = cut(named.join(tokens_open, named["token"] == tokens_open["t"], "left_semi").join(
        sigs, F.col("id") == F.col("c_id")).select("token", "id", "part", "prefix", "sig", "n_shingles"))

    def dealt(rows: DataFrame) -> DataFrame:
        """Every member under all pairs of blocks (i, j) of its list that hold its own."""
        blocks = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).withColumnRenamed("token", "t")
        own = rows.join(blocks, rows["token"] == blocks["t"]).withColumn(
            "own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return spread.select(*rows.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).repartition(
            n, *keys).sortWithinPartitions(*keys)

    def candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(frames, keys):
            has = np.zeros(len(pdf), bool)
            for r, c in candidate_pairs(pdf, coordinates, threshold, percent):
                has[r] = True
                has[c] = True
            yield pdf.loc[has, ["token", "id"]]

    some = cut(dealt(members).mapInPandas(candidates, "token long, id long").distinct())

    full = full_sets(some.select("id"), classes, docs, size)
    chosen = some.select(F.col("token").alias("o_token"), F.col("id").alias("o_id"))
    again = members.join(chosen, (members["token"] == chosen["o_token"]) & (members["id"] == chosen["o_id"]), "left_semi")
    with_sets = again.join(full, again["id"] == full["s_id"]).drop("s_id")

    def confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(frames, keys):
            ids = pdf["id"].to_numpy()
            full = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
            least = np.arange(len(ids))

            def root(x: int, least=least) -> int:
                while least[x] != x:
                    least[x] = least[least[x]]
                    x = least[x]
                return x

            for rows, columns in candidate_pairs(pdf, coordinates, threshold, percent):
                for r, c in zip(rows.tolist(), columns.tolist(), strict=True):
                    if (a := root(r)) != (b := root(c)) and similar(full[r], full[c], percent):
                        least[max(a, b)] = min(a, b)
            top = np.array([root(x) for x in range(len(ids))], int)
            moved = np.flatnonzero(top != np.arange(len(ids)))
            yield pd.DataFrame({"src": ids[moved], "dst": ids[top[moved]]})

    return dealt(with_sets).mapInPandas(confirm, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, coordinates: int = 32) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs`` (doc_id, text)."""
    threshold = match_threshold(coordinates, percent / 100)
    rows = cut(shingle_sets(docs, size, coordinates))
    with_set = rows.where("class is not null and doc_id is not null")
    # numbered as they are written, so a number stays with its class
    classes = cut(with_set.groupBy("class").agg(
        F.min(F.struct("doc_id", "h")).alias("of"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")).select(
        "class", "of.doc_id", "of.h", "sig", "n_shingles", F.monotonically_increasing_id().alias("id")))
    lists = cut(postings(classes, coordinates, threshold))
    ends = lists.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").withColumnRenamed("token", "t")
    hubs = lists.join(ends, lists["token"] == ends["t"]).select(
        F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("id").alias("b")),
                          F.struct(F.col("hi").alias("a"), F.col("id").alias("b")))).alias("x")).select(
        F.col("x.a").alias("a"), F.col("x.b").alias("b")).where("a <> b").distinct()
    links = confirmed(hubs, classes, docs, size, percent, threshold, coordinates)
    component = cut(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    more = cut(across(lists, classes, docs, component, size, percent, threshold, coordinates))
    if not more.isEmpty():
        component = cut(connected_components(more.union(
            component.select(F.col("node").alias("src"), F.col("component").alias("dst")))))
    # of each component the least id of a document
    joined = component.join(classes.select("id", "class", "doc_id"), F.col("id") == F.col("node"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("least")).withColumnRenamed("component", "l_component")
    ids = joined.join(least, F.col("component") == F.col("l_component")).select(F.col("class").alias("l_class"), "least")
    of_class = classes.join(ids, classes["class"] == ids["l_class"], "left").select(
        F.col("class").alias("c"), F.coalesce("least", "doc_id").alias("of_class"))
    return rows.join(of_class, rows["class"] == of_class["c"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id stands for their component; a row with a null id always stays.

    Rows of one id with different texts, of which one stands for its component, all stay.
    """
    found = near_duplicates(docs, size, percent).where("doc_id is not null").groupBy(F.col("doc_id").alias("_dropped")).agg(
        F.bool_or("kept").alias("_kept")).where("not _kept")
    return docs.join(found, docs["doc_id"] == found["_dropped"], "left_anti")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


#: Every pair of texts that share a shingle is counted, so this is meant for small tables.
ORACLE_OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS src, b.doc_id AS dst FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.dst FROM reach JOIN links ON links.src = reach.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON a = doc_id
"""
