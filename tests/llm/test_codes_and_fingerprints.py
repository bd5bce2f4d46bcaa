"""Centroid clustering, vector codes and spot signatures against brute force, with nulls, ties, repeats and empty tables."""

import base64
import hashlib
import random
import re
import time

import numpy as np
import pytest

from passbook.llm import centroids, codes, minhash, spotsigs

VEC = "vec_id long, label int, embedding array<float>"
DOC = "doc_id long, text string"


def vectors(spark, n=300, dims=64, seed=1, extra=()):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 0.2, (9, dims))
    rows = [(i, i % 4 if i % 7 else None, (centres[i % 9] + r.normal(0, 0.05, dims)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n, 1, rows[0][2]), (n, 1, rows[0][2]), (n + 1, None, None), (n + 2, 2, [None] * dims), (n + 3, 2, [float("nan")] * dims), (n + 4, 2, [float("inf")] + [0.0] * (dims - 1))]
    return spark.createDataFrame([*rows, *extra], VEC).selectExpr("*", "'clash' as x", "'clash' as cluster", "'clash' as n"), rows[:n + 2]


# 11


def brute_clusters(rows, k, rounds):
    x = np.array([np.floor(np.float64(v) * 64).astype(np.int64) for _, _, v in rows])
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]].copy()

    def nearest():
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        a, _ = nearest()
        for j in range(len(c)):
            if (a == j).any():
                c[j] = x[a == j].sum(0) // (a == j).sum()
    a, d = nearest()
    sha = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in c.tolist()]
    return sorted((rows[i][0], int(a[i]), int(d[i]), int(d[a == a[i]].sum()), int(d.sum()), sha[a[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("n", [300, 5])
def test_clusters_equal_brute_force(spark, n):
    other_length = [(900, 1, [0.5] * 63), (901, 1, [])]
    d, kept = vectors(spark, n, extra=other_length)
    assert sorted(map(tuple, centroids.clustered(d).collect())) == brute_clusters(kept, 16, 3)


def test_clusters_of_nothing_and_null_ids(spark):
    empty = centroids.clustered(spark.createDataFrame([], VEC))
    assert empty.count() == 0 and empty.columns == centroids.clustered(vectors(spark, 3)[0]).columns
    d = spark.createDataFrame([(None, 1, [0.1] * 64), (3, 1, [0.1] * 64), (None, 1, [1e6] * 64)], VEC)
    assert sorted((r.vec_id is None, r.distance) for r in centroids.clustered(d).collect()) == [(False, 0), (True, 0)]


def test_threshold_walk_is_exact_with_ties():
    r = np.random.default_rng(0)
    for k, dims, spread in ((1, 3, 5), (7, 1, 3), (40, 6, 4), (300, 12, 50)):
        c, x = r.integers(-spread, spread, (k, dims)), r.integers(-spread, spread, (2500, dims))
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        number, distance = centroids.Lists(c).nearest(x)
        assert (number == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_threshold_walk_stops_early(monkeypatch):
    c = np.arange(2000)[:, None] * np.array([[50, 50]])
    seen = []
    monkeypatch.setattr(centroids, "squared", lambda x, y: seen.append(len(x)) or ((x - y) ** 2).sum(1))
    centroids.Lists(c).nearest(c[::100] + 3)
    assert sum(seen) < 20 * 5  # of 2,000 centroids a few are met per vector


# 13


def brute_codes(rows, entries, parts, rounds):
    x = np.array([np.floor(np.float64(v) * 1024).astype(np.int64) for _, _, v in rows])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], x[i].tolist()))
    split = np.split(x, parts, axis=1)
    books = [s[order[:entries]].copy() for s in split]

    def assign():
        d = [((s[:, None] - b[None]) ** 2).sum(2) for s, b in zip(split, books)]
        return np.stack([y.argmin(1) for y in d], 1), sum(y.min(1) for y in d)

    for _ in range(rounds):
        a, _ = assign()
        for p, (s, b) in enumerate(zip(split, books)):
            for j in range(len(b)):
                if (a[:, p] == j).any():
                    b[j] = s[a[:, p] == j].sum(0) // (a[:, p] == j).sum()
    a, e = assign()
    label = [r[1] for r in rows]
    sums = {v: int(sum(int(e[i]) for i in range(len(rows)) if label[i] == v)) for v in set(label)}
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    return sorted((rows[i][0], "".join(f"{v:02x}" for v in a[i]), int(e[i]), sums[label[i]], sha) for i in range(len(rows)))


@pytest.mark.parametrize(("n", "dims"), [(400, 64), (6, 8)])
def test_codes_equal_brute_force(spark, n, dims):
    d, kept = vectors(spark, n, dims)
    assert sorted(map(tuple, codes.coded(d).collect())) == brute_codes(kept, 256, 4, 4)


def test_codes_of_other_lengths_and_of_nothing(spark):
    assert codes.coded(spark.createDataFrame([], VEC)).count() == 0
    d, kept = vectors(spark, 20, 8, extra=[(900, 1, [0.5] * 12), (901, 1, []), (-5, 1, [0.5] * 7)])
    got = {r.vec_id: r for r in codes.coded(d, entries=4).collect()}
    assert all(got[i].code is None and got[i].error is None for i in (900, 901, -5)) and got[0].code is not None
    assert got[900].label_error == got[1].label_error > got[1].error
    only_odd = codes.coded(spark.createDataFrame([(1, 1, [0.5] * 7)], VEC)).collect()
    assert [(r.vec_id, r.code, r.codebooks_sha256) for r in only_odd] == [(1, None, None)]


@pytest.mark.parametrize(("width", "memo"), [(1, 10), (8, 0), (64, 100_000)])
def test_cells_keep_every_nearest_entry(width, memo):
    r = np.random.default_rng(width)
    book, x = r.integers(-60, 60, (70, 4)), r.integers(-70, 70, (3000, 4))
    book[50] = book[3]  # a tie goes to the lower index
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    cells = codes.Cells(book, width, memo)
    for _ in range(2):  # the second time from memory
        index, error = cells.nearest(x)
        assert (index == d.argmin(1)).all() and (error == d.min(1)).all()
    assert len(cells.known) <= memo


def test_cells_exclude_dominated_entries():
    book = np.arange(0, 10_000, 100)[:, None] * np.ones((1, 4), np.int64)
    assert codes.Cells(book, 16).survivors(book[:50] + 3).sum(1).max() <= 3


# 12


def brute_signatures(text, anchors):
    words = re.findall(r"\w+", (text or "").lower())
    content = [i for i, w in enumerate(words) if w not in anchors]
    out = set()
    for i, w in enumerate(words):
        chain = [words[j] for j in content if j > i][:2]
        if w in anchors and len(chain) == 2:
            out.add((w, *chain))
    if not out:
        out = {tuple(words)} if words else {text} if text else set()
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(r, n, vocabulary=4000):
    return " ".join(r.choice(["the", "of", "and", "to"]) if r.random() < 0.35 else f"w{r.randrange(vocabulary)}" for _ in range(n))


def test_edits_equal_brute_force(spark):
    r = random.Random(5)
    texts = [None, "", "x", "?!", "The", "one two three", "Äpfel 😀 of the birds fly high 😀😀", prose(r, 9000), prose(r, 60), prose(r, 60), "no anchors here at all"]
    texts += [texts[8], texts[8]] + [prose(r, r.randrange(1, 200)) for _ in range(60)]
    ids = [7 * i % 509 for i in range(len(texts))]
    d = spark.createDataFrame(list(zip(ids, texts)), DOC).selectExpr("*", "1 as h", "'y' as range", "2 as n_chars").repartition(5)
    anchors = ["the", "of", "and", "to"]
    got = {x.doc_id: x for x in spotsigs.edits(d, anchors).collect()}
    assert len(got) == len(texts)
    order = sorted(zip(ids, texts))
    prints = {}
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        new = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        own, x = brute_signatures(t, anchors), got[i]
        assert (x.n_chars, x.n_signatures) == (len(t), len(own))
        assert x.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert x.near_edited == pytest.approx(jaccard(own, brute_signatures(new, anchors)))
        assert x.near_next == pytest.approx(jaccard(own, brute_signatures(following, anchors)))
        assert len(base64.b64decode(x.fingerprint)) == 4 * len(own)
        assert prints.setdefault(t, x.fingerprint) == x.fingerprint


def test_edits_of_repeats_null_ids_one_row_and_nothing(spark):
    assert spotsigs.edits(spark.createDataFrame([], DOC), ["the"]).count() == 0
    one = spotsigs.edits(spark.createDataFrame([(3, "abcd")], DOC), []).first()
    assert (one.edited_sha256, one.near_next) == (hashlib.sha256(b"abab").hexdigest(), 1.0)
    d = spark.createDataFrame([(None, "b of c"), (1, "a a a a"), (1, "a a a a"), (1, "z"), (None, None)] + [(2, "same text")] * 50, DOC).repartition(7)
    got = spotsigs.edits(d, ["of"]).collect()
    assert len(got) == 55 and sum(x.doc_id is None for x in got) == 2 and sum(x.near_next == 1.0 for x in got if x.doc_id == 2) >= 49
    assert spotsigs.common_words(spark.createDataFrame([], DOC)) == []


def test_common_words_are_counted_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "COUNTED", 3)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["B b b a", "a c", "c b", None, "a " + "q" * 40, "q" * 40, "q" * 40, "q" * 40])], DOC)
    assert spotsigs.common_words(d, 2) == ["a", "b"] and spotsigs.common_words(d, 9) == ["a", "b", "c"]


def test_pruned_likeness_is_exact_above_the_limit():
    r = np.random.default_rng(2)
    for _ in range(300):
        x, y = (np.unique(r.integers(0, 900, r.integers(1, 800)).astype(np.uint32)) for _ in range(2))
        if r.random() < 0.5:
            y = np.unique(np.concatenate([x[r.random(len(x)) < 0.9], y[:20]]))
        true = jaccard(set(x.tolist()), set(y.tolist()))
        for least in (0.0, 0.3, 0.8):
            assert spotsigs.likeness(x, y, least) == pytest.approx(true if true >= least else 0.0)


def test_linked_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BLOCK", 5)
    r = random.Random(8)
    texts = [None, "", "one", "one", "the a b c", "The a b c"]
    for _ in range(10):
        base = prose(r, 150).split()
        for _ in range(r.randrange(1, 14)):
            copy = list(base)
            for _ in range(r.randrange(9)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(4000)}"
            texts.append(" ".join(copy[r.randrange(12):]))
    anchors = ["the", "of", "and", "to"]
    sets = [brute_signatures(t, anchors) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    d = spark.createDataFrame(list(enumerate(texts)), DOC).selectExpr("*", "1 as id", "2 as part")
    got = [(x.n_signatures, x.component_id, x.kept) for x in spotsigs.linked(d, anchors).orderBy("doc_id").collect()]
    assert got == [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]
    assert len({c for _, c, _ in got}) < len(texts) - 20
    assert spotsigs.linked(spark.createDataFrame([], DOC), anchors).count() == 0


# 2: rows that repeat ids


def test_near_duplicates_of_repeated_ids(spark):
    a = " ".join(f"w{i}" for i in range(60))
    b = a.replace("w59", "v")
    other = [(7, f"text {i} " + " ".join(f"x{i}_{k}" for k in range(20))) for i in range(50)]
    d = spark.createDataFrame([(1, a)] * 50 + [(2, b)] * 50 + other, DOC)
    got = minhash.near_duplicates(d).collect()
    assert len(got) == 150 and all(x.component_id == (7 if x.doc_id == 7 else 1) for x in got)


def test_cost_of_repeated_rows_is_linear(spark):
    a = " ".join(f"w{i}" for i in range(60))
    took = {}
    for n in (10, 10, 1000):  # the first run compiles
        d = spark.createDataFrame([(1, a)] * n + [(2, a.replace("w59", "v"))] * n, DOC)
        began = time.time()
        assert minhash.near_duplicates(d).where("component_id = 1").count() == 2 * n
        took[n] = time.time() - began
    assert took[1000] < 3 * took[10] + 5
