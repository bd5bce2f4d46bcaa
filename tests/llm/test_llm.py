"""The llm operators on small tables: brute force, round trips, and nulls, empties, ties and clashing columns."""

import gzip
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from passbook.llm import langid, minhash, mixing, packing, qualityrules, rankquality, tokens, toxicity, vectorjoin, warc
from passbook.llm.common import connected_components, rank_in_groups

public_tokenizers = pytest.importorskip("public_tokenizers")

DOC = "doc_id long, text string"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), DOC)


# shared helpers


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 1)]
    got = dict(connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_ranks_are_gapless(spark):
    d = spark.createDataFrame([(i % 2 if i % 5 else None, i) for i in range(200)] + [(1, 7)] * 3, "g int, i long")
    got = rank_in_groups(d, ["g"], ["i"], "k").toPandas()
    for _, g in got.groupby("g", dropna=False):
        assert sorted(g.k) == list(range(len(g)))


# 1


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 200
    rows = [(3, "http://a/ b\n", long), (1, "http://b", long), (2, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (1, "again", long)]
    got = sorted(map(tuple, warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", warc.F.lit("clash")))
                     .select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
    assert got == sorted([(3, 400, "revisit", 1), (1, 400, "response", None), (2, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None),
                          (None, 400, "revisit", 1), (1, 400, "response", None)], key=str)
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_are_plain_gzip_members(spark, tmp_path):
    big = "".join(random.Random(0).choices("abcdefghij", k=17 << 20))  # above 16 MiB the last byte of a member isn't 0
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame([(1, "u", big), (2, "u", "x")], "page_id long, url string, html string"), path)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    assert sum(gzip.decompress(p.read_bytes()).count(b"WARC/1.1") for p in files if p.stat().st_size) == 2
    got = {r.page_id: bytes(r.payload) for r in warc.read_warc(spark, path).collect()}
    assert got == {1: big.encode(), 2: b"x"}


def test_damage_is_found():
    import hashlib

    m = warc.record_member(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    raw = gzip.decompress(m)
    assert warc.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.parse_record(raw[:-5])
    with pytest.raises(ValueError):
        list(warc._inflated(memoryview(m[:-9])))


# 2


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, percent):
    r = random.Random(size)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("abcdefgh")
    passage = [word() for _ in range(30)]
    texts = ["", None, " \t\n", "One two", "one TWO", "three"]
    for _ in range(12):
        base = [word() for _ in range(80)] + passage
        texts.append(" ".join(base))
        for _ in range(r.randrange(8)):
            copy = list(base)
            for _ in range(r.randrange(12)):
                copy[r.randrange(len(copy))] = word()
            texts += [" ".join(copy)] * r.choice([1, 1, 3])
    texts.append(" ".join(word() for _ in range(30_000)))
    d = docs(spark, *texts).selectExpr("*", "'x' as id", "'y' as token")
    got = [(x.n_shingles, x.component_id) for x in minhash.near_duplicates(d, size, percent).orderBy("doc_id").collect()]
    assert got == brute_components(texts, size, percent)


def test_near_duplicates_of_nothing_and_null_ids(spark):
    assert minhash.near_duplicates(docs(spark)).count() == 0
    d = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], DOC)
    got = sorted(map(tuple, minhash.near_duplicates(d).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (4, 2, 2, False), (2, 2, 2, True), (2, 2, 2, True)], key=str)
    assert minhash.keep_one_each(d).count() == 3


def test_group_pairs_cover_each_group():
    starts, sizes = np.array([0, 3, 4, 104]), np.array([3, 1, 100, 2])
    got = sorted((int(a), int(b)) for r, c in minhash.group_pairs(starts, sizes) for a, b in zip(r, c, strict=True))
    assert got == sorted((s + i, s + j) for s, n in zip(starts, sizes, strict=True) for i in range(n) for j in range(i + 1, n))


# 3


def test_language_id(spark):
    r = random.Random(1)
    langs = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["żółw", "gęś", "jaźń", "kość"]}
    rows = [(i, " ".join(r.choices(langs[x], k=20)), x) for i, x in enumerate(["aa", "bb"] * 30)]
    model = langid.train(spark.createDataFrame([*rows, (98, None, "aa"), (99, "lorem", None)], "doc_id long, text string, lang string"))
    long = "ipsum " * 200_000
    d = docs(spark, "lorem dolor", "gęś kość", "", None, "123 !?", long, "\U00020000").withColumn("score", langid.F.lit(1))
    got = langid.identify(d, model).orderBy("doc_id").collect()
    assert [x.lang_pred for x in got][:6] == ["aa", "bb", "und", "und", "und", "aa"] and got[6].lang_pred in langs
    assert [x.score for x in got[2:5]] == [0, 0, 0] and all(0 <= x.score <= 1 for x in got)
    none = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {(x.lang_pred, x.score) for x in langid.identify(d, none).collect()} == {("und", 0.0)}


def test_language_id_keeps_all_grams_and_rows(spark):
    r = np.random.default_rng(5)
    hot = ["".join(map(chr, r.integers(0x4E00, 0x9F00, 100_000))) for _ in range(21)]
    rows = [(i, t, "aa") for i, t in enumerate(hot)] + [(100 + i, "zażółć gęślą jaźń" + " ż" * i, "zz") for i in range(3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "zz"] and len(model.hashes) > 2_000_000
    rows = [(i, f"lorem ipsum {'dolor ' * (i % 7)}{i}", "aa") for i in range(3000)] + [(5000 + i, "gęś " * i, "bb") for i in range(1, 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d, reject_quantile=0.9)
    out = {x.doc_id for x in d.where(langid.kept_out()).collect()}
    for i, lang in enumerate(model.langs):  # a language of few rows is measured on all of them
        entropy, _ = model.cross_entropies([t for k, t, x in rows if x == lang and (k in out or lang == "bb")])
        assert model.limits[i] == pytest.approx(np.quantile(entropy[:, i], 0.9), abs=1e-12)
    counted = langid.LanguageModel(["aa"], [langid.np.unique(np.concatenate([langid.grams(langid.normalised(t)) for k, t, x in rows if x == "aa" and k not in out]), return_counts=True)])
    some = "lorem dolor ipsum"
    assert model.cross_entropies([some])[0][0, 0] == pytest.approx(
        -np.log(counted_probability(model.models[0], some)).mean()) and len(counted.models[0].keys[3]) == len(model.models[0].keys[3])


def counted_probability(m, text):
    return m.probability(langid.grams(langid.normalised(text)))


def slow_kneser_ney(texts, alphabet):
    """P(unit | context) from the definition, over dicts of n-grams as text."""
    from collections import Counter

    full = Counter()
    for t in texts:
        u = langid.normalised(t).tobytes().decode("utf-16-le")
        full.update(u[i:i + 4] for i in range(len(u) - 3))
    levels = {4: dict(full)}
    for k in (3, 2, 1):
        # the continuation count of an n-gram: how many different units stand before it
        levels[k] = Counter(g[1:] for g in {x[4 - k - 1:] for x in full})
    def discount(c):
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return one / (one + 2 * two) if one and two else 0.5

    def p(g):
        out = 1 / alphabet
        for k in range(1, 5):
            c, own = levels[k], g[4 - k:]
            followers = [v for x, v in c.items() if x[:-1] == own[:-1]]
            if not followers:
                continue
            d, total = discount(c), sum(followers)
            out = max(c.get(own, 0) - d, 0) / total + d * len(followers) / total * out
        return out

    return p


def test_kneser_ney_equals_its_definition():
    texts = ["the cat sat on the mat", "a rat ran at the cat and sat", "that hat"]
    g, n = np.unique(np.concatenate([langid.grams(langid.normalised(t)) for t in texts]), return_counts=True)
    m, p = langid.KneserNey(g, n, 20), slow_kneser_ney(texts, 20)
    for t in (*texts, "the bat had a zebra", "cats"):
        u = langid.normalised(t)
        want = [p(u[i:i + 4].tobytes().decode("utf-16-le")) for i in range(len(u) - 3)]
        assert m.probability(langid.grams(u)) == pytest.approx(want, abs=1e-12)


def test_identify_edges(spark):
    rows = [(i, w * 5, x) for i, (w, x) in enumerate([("abc ", "aa"), ("abc ", "bb"), ("xyz ", "cc")] * 4)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    d = spark.createDataFrame([(1, "abc " * 5), (1, "ABC " * 5), (None, "xyz " * 5), (2, "éèà ùòì ßßß"), (3, None)], DOC).selectExpr("*", "'x' as lang_pred", "1 as rejected")
    got = sorted(((x.doc_id, x.lang_pred, x.rejected) for x in langid.identify(d, model).collect()), key=str)
    # ties go to the first language, repeated rows get the same, unlike texts are rejected
    assert got == sorted([(1, "aa", False), (1, "aa", False), (None, "cc", False), (2, got[2][1], True), (3, "und", False)], key=str)
    assert langid.identify(d.limit(0), model).count() == 0


def test_kneser_ney_sums_to_one():
    text = langid.normalised("the cat sat on the mat and the rat ran")
    g, n = np.unique(langid.grams(text), return_counts=True)
    units = np.unique(g & np.uint64(0xFFFF))
    m = langid.KneserNey(g, n, len(units))
    for context in (g[0] >> np.uint64(16), g[7] >> np.uint64(16)):
        p = m.probability((context << np.uint64(16)) | units)
        assert p.sum() == pytest.approx(1, abs=1e-9) and (p > 0).all()


# 4 and 9


def toxic_rows():
    r = random.Random(2)
    words = ["w" + c for c in "abcdefghijklmnop"]
    return [(i, " ".join(r.choices(words, k=30) + (["Vile,"] if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(400)]


def test_toxicity(spark):
    rows = toxic_rows()
    d = spark.createDataFrame([(a, b) for a, b, _ in rows], DOC)
    labels = spark.createDataFrame([(a, c) for a, _, c in rows] + [(None, 1), (5, None), (0, 1), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    got = toxicity.score(d, model).toPandas().sort_values("doc_id")
    assert got.predicted.tolist() == [c for *_, c in rows]
    edge = toxicity.score(docs(spark, "", None, "VILE " * 100_000).withColumn("score", toxicity.F.lit(0)), model).orderBy("doc_id").collect()
    assert [x.predicted for x in edge] == [0, 0, 1]
    twice = spark.createDataFrame([(0, "vile"), (0, "vile"), (None, "vile")], DOC)
    assert len({x.score for x in toxicity.score(twice, model).collect()}) == 1
    assert toxicity.keep(d, model).count() == 320 and toxicity.keep(docs(spark), model).count() == 0
    empty = toxicity.train(d, labels.limit(0))
    assert all(x.score < 1e-5 for x in toxicity.score(d, empty).collect())
    none = toxicity.train(docs(spark), labels.limit(0))
    assert none.bias == empty.bias
    assert toxicity.train(docs(spark, None, ""), spark.createDataFrame([(0, 1), (1, 1)], labels.schema)).bias > 5


def test_counts_of_the_unlabelled_are_exact(spark):
    rows = toxic_rows()
    d = spark.createDataFrame([(a, b) for a, b, _ in rows] + [(9, None), (9, "")], DOC).repartition(5)
    buckets = toxicity.WordBuckets()
    sets = [set(toxicity.word_set(b, buckets)) for _, b, _ in rows] + [set(), set()]
    words = np.sort(np.array([buckets[w] for w in ("vile", "wa", "wb", "absent")]))
    n, total = toxicity.presence(d, words)
    assert total == 402 and n.tolist() == [sum(w in s for s in sets) for w in words.tolist()]
    want = {}
    for x in sets:
        held = tuple(k for k, w in enumerate(words.tolist()) if w in x)
        want[held] = want.get(held, 0) + 1
    found = toxicity.patterns(d, words)
    assert {tuple(np.frombuffer(r.held, "<i4").tolist()): r.n for r in found.collect()} == want
    # the sums of Spark and of the driver are those of a plain loop over the documents
    w, b = np.array([1.5, -0.5, 0.25, 2.0]), -0.75
    plain = np.zeros(6)
    for x in sets:
        z = b + sum(w[k] for k, c in enumerate(words.tolist()) if c in x)
        for k, c in enumerate(words.tolist()):
            plain[k] += (c in x) / (1 + math.exp(-z))
        plain[4:] += 1 / (1 + math.exp(-z)), math.log1p(math.exp(z))
    for local in (0, toxicity.LOCAL):
        assert toxicity.unlabelled_risk(found, local)(w, b) == pytest.approx(plain / 402, rel=1e-12)


def test_a_model_has_no_greatest_number_of_words(spark):
    """Two hundred words mark the toxic rows; all but those too rare among the distinct positives are learned, and any ten find a text."""
    r = random.Random(8)
    bad, plain = [f"x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)], ["w" + c for c in "abcdefghijklmnop"]
    rows = [(i, " ".join(r.choices(plain, k=20) + (r.sample(bad, 60) if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(800)]
    d = spark.createDataFrame([x[:2] for x in rows], DOC)
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    buckets = toxicity.WordBuckets()
    assert set(model.buckets.tolist()) <= {buckets[w] for w in bad} and len(model.buckets) > 180
    got = toxicity.score(docs(spark, *[" ".join(bad[i:i + 10]) for i in range(0, 200, 10)], "wa wb wc"), model)
    assert [x.predicted for x in got.orderBy("doc_id").collect()] == [1] * 20 + [0]
    # summed by Spark, a few steps end at the same weights
    own = toxicity.Sets([toxicity.packed([buckets[w] for w in bad[:5]], {x: k for k, x in enumerate(model.buckets.tolist())})], np.ones(1))
    found = toxicity.patterns(d, model.buckets)
    a, b = (toxicity.fit_nnpu(model.buckets, own, toxicity.unlabelled_risk(found, n), 0.25, epochs=5) for n in (0, toxicity.LOCAL))
    assert a.weights == pytest.approx(b.weights, rel=1e-6) and a.bias == pytest.approx(b.bias, rel=1e-6)


def test_nnpu_lowers_the_risk_it_states():
    """Against a plain computation of the risk, document by document."""
    rng = np.random.default_rng(3)
    words = np.arange(4)
    positive = rng.integers(0, 16, 40) | 1
    unlabelled = np.where(rng.random(300) < 0.2, rng.integers(0, 16, 300) | 1, rng.integers(0, 8, 300) << 1)
    held = lambda masks: [np.array([k for k in range(4) if x >> k & 1], "<i4").tobytes() for x in masks.tolist()]
    of_unlabelled = toxicity.Sets(held(unlabelled), np.full(300, 1 / 300))
    m = toxicity.fit_nnpu(words, toxicity.Sets(held(positive), np.ones(40)), of_unlabelled.as_negative, 0.2)

    def risk(w, b):
        z = lambda masks: np.array([b + sum(w[k] for k in range(4) if x >> k & 1) for x in masks.tolist()])
        loss = lambda z: np.log1p(np.exp(-z))
        return 0.2 * loss(z(positive)).mean() + max(0, loss(-z(unlabelled)).mean() - 0.2 * loss(-z(positive)).mean())

    best = risk(m.weights, m.bias)
    assert best < risk(np.zeros(4), np.log(0.25)) - 0.05
    for _ in range(50):
        assert risk(m.weights + rng.normal(size=4) * 0.3, m.bias + rng.normal() * 0.3) > best - 1e-2


def test_quality_ranking(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        good = i % 3 != 0
        w = ["".join(r.choices("abcdefg", k=5)) for _ in range(60)]
        rows.append((i, " ".join(w) if good else "### ".join(w), int(good)))
    d = spark.createDataFrame([(a, b) for a, b, _ in rows], DOC)
    labels = spark.createDataFrame([(a, c) for a, _, c in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = rankquality.train(d, labels)
    assert rankquality.score(d, model).toPandas().sort_values("doc_id").predicted.tolist() == [c for *_, c in rows]
    assert rankquality.keep(d, model).count() == 200 and rankquality.score(docs(spark), model).count() == 0
    assert all(0 <= x.score <= 1 for x in rankquality.score(docs(spark, "", None, "a " * 300_000), model).collect())
    odd = spark.createDataFrame([(0, "a b"), (0, "a b"), (None, "a b")], DOC).selectExpr("*", "'x' as score", "1 as predicted", "2 as x")
    assert len({x.score for x in rankquality.score(odd, model).collect()}) == 1 and rankquality.keep(odd, model).columns == odd.columns
    for q, want in ((1, 1.0), (0, 0.0), (2, 0.5)):
        one = rankquality.train(d, labels.where(f"quality = {q}"))
        assert {x.score for x in rankquality.score(d, one).collect()} == {want}


def test_pairs_follow_the_bradley_terry_gradient():
    """The fit against a plain logistic regression on the differences of one-hot features of all pairs."""
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (30, 2)), rng.normal(0, 1, (20, 2))
    m = rankquality.fit_pairs(good, bad, 0.4, pairs=10_000, epochs=600)
    hot = lambda x: np.concatenate([np.eye(rankquality.BINS)[rankquality.bins(x, m.edges)[:, j]] for j in range(2)], 1)
    diff = (hot(good)[:, None] - hot(bad)[None]).reshape(600, -1)
    w = np.zeros(diff.shape[1])
    for _ in range(20_000):
        w += 0.5 * ((diff / (1 + np.exp(diff @ w))[:, None]).mean(0) - 1e-4 * w)
    loss = lambda w: np.log1p(np.exp(-diff @ w)).mean()
    assert loss(m.weights.reshape(-1)) < loss(w) + 0.02
    s = np.concatenate([m.raw(good), m.raw(bad)])
    assert abs((s < m.threshold).mean() - 0.4) < 0.1


# 5 and 6


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_complete_and_tight(seed):
    r = random.Random(seed)
    counts = {r.randrange(1, 101): r.choice([1, 2, 5, 1000]) for _ in range(40)}
    runs, n = packing.plan(counts, 100)
    fill, ranks = {}, {}
    for x, rank, times, first, offset in runs:
        for t in range(times):
            ranks.setdefault(x, []).append(rank + t)
            fill.setdefault(first + t, []).append((offset, x))
    assert {x: sorted(v) for x, v in ranks.items()} == {x: list(range(k)) for x, k in counts.items()}
    assert len(fill) == n
    for parts in fill.values():
        at = 0
        for offset, x in sorted(parts):
            assert offset == at
            at += x
        assert at <= 100
    assert n <= sum(times for _, times in packing.best_fit(packing.Stock(counts), 100))


def best_count(lengths, capacity):
    """The fewest bins, by search."""
    best = len(lengths)

    def go(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for room in {x for x in rooms if x >= rest[0]}:
            i = rooms.index(room)
            go(rest[1:], rooms[:i] + (room - rest[0],) + rooms[i + 1:])
        go(rest[1:], rooms + (capacity - rest[0],))

    go(sorted(lengths, reverse=True), ())
    return best


@pytest.mark.parametrize("seed", range(30))
def test_reduction_keeps_the_optimum(seed):
    r = random.Random(seed)
    lengths = [r.randrange(1, 21) for _ in range(r.randrange(1, 9))]
    stock = packing.Stock({x: lengths.count(x) for x in lengths})
    fixed = packing.reduce_by_dominance(stock, 20)
    rest = [x for x, k in stock.n.items() for _ in range(k)]
    assert sum(n for _, n in fixed) + best_count(rest, 20) == best_count(lengths, 20)


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    words = ["Hello", "wörld,", "<|endoftext|>", "it's", "12", "<|ENDOFTEXT|>", "naïve!!", "x́y"]
    r = random.Random(5)
    texts = [" ".join(r.choices(words, k=r.choice([0, 3, 40, 700]))) for _ in range(30)] + [None, "", "a", "a"]
    got = packing.pack(docs(spark, *texts).withColumn("length", packing.F.lit("clash")), path, 256).toPandas().sort_values(["doc_id", "piece"])
    tk = tokens.load(path)
    for i, t in enumerate(texts):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == i]
        parts = [ids[k:k + 256] for k in range(0, len(ids), 256)]
        assert own.length.tolist() == [len(p) for p in parts] and own.start.tolist() == list(range(0, len(ids), 256))
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in parts]
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == s.length.cumsum().to_numpy() - s.length.to_numpy()).all() and s.length.sum() <= 256
    assert packing.pack(docs(spark), path).count() == 0


@pytest.mark.parametrize("weights", [None, {"a": 0.7, "b": 0.2, None: 0.1}])
def test_mixing(spark, weights):
    rows = [(i, "a" if i % 3 else ("b" if i % 2 else None), "t") for i in range(500)] + [(1, "c", "t")] * 2 + [(None, "a", "t")] * 3
    d = spark.createDataFrame(rows, "doc_id long, source string, position string")
    got = mixing.mix(d, weights).toPandas().sort_values("position")
    assert got.position.tolist() == list(range(505)) and got.groupby("source", dropna=False).size().tolist() == [336, 83, 2, 84]
    assert ((got.position >= got.release) & (got.position < got.deadline)).all()
    assert mixing.mix(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(d, {"a": 0.0})


def earliest_deadline_first(phases):
    """(position, source, block), slot by slot over exact fractions."""
    out = []
    for x in phases:
        w = [Fraction(a, sum(x.shares)) for a in x.shares]
        done = [0] * len(w)
        for t in range(x.length):
            released = [(min(math.ceil((k + 1) / v), x.length), i, j) for j, (i, v, k, n) in enumerate(zip(x.sources, w, done, x.placed, strict=True))
                        if k < n and math.floor(k / v) <= t]
            deadline, i, j = min(released)
            assert t < deadline
            out.append((x.start + t, i, x.before[j] + done[j]))
            done[j] += 1
        assert done == x.placed
    return out


@pytest.mark.parametrize(("sizes", "weights"), [
    ({"a": 4990, "b": 10}, {"a": 0.9995, "b": 0.0005}), ({"a": 2800, "b": 1000, "c": 600}, {"a": 0.7, "b": 0.2, "c": 0.1}),
    ({"a": 3001, "b": 1777, "c": 50, "d": 2}, None), ({"a": 1, "b": 1, "c": 900, "d": 900}, {"a": 1e-5, "b": 0.3071, "c": 0.3333333333333333, "d": 0.2})])
def test_mixing_is_earliest_deadline_first_on_the_given_weights(spark, monkeypatch, sizes, weights):
    monkeypatch.setattr(mixing, "CHUNK", 64)  # so that many chunks have to agree
    d = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    got = mixing.mix(d, weights).toPandas().sort_values("position")
    names = sorted(sizes)
    targets = [weights[s] if weights else Fraction(math.isqrt(sizes[s])) for s in names]
    phases = mixing.plan_phases([sizes[s] for s in names], targets)
    assert list(zip(got.position.tolist(), map(names.index, got.source), got.block.tolist(), strict=True)) == earliest_deadline_first(phases)
    left = dict(sizes)
    for _, phase in got.groupby("phase"):
        total = sum(targets[names.index(s)] for s in left)
        for s in list(left):
            there = (phase.source == s).to_numpy()
            assert (abs(there.cumsum() - float(targets[names.index(s)] / total) * np.arange(1, len(phase) + 1)) < 1 + 1e-9).all()
            left[s] -= int(there.sum())
        left = {s: n for s, n in left.items() if n}
    assert not left


def test_phases_hold_every_row_within_one_block_of_the_target():
    sizes, weights = [100_000, 80_000, 50_000, 26_410], [0.43719, 0.31231, 0.150741, 1e-5]
    phases = mixing.plan_phases(sizes, weights)
    assert len(phases) <= 8 and sum(x.length for x in phases) == sum(sizes)
    for x in phases:
        total = sum(Fraction(repr(weights[i])) for i in x.sources)
        for i, a, n in zip(x.sources, x.shares, x.placed, strict=True):
            assert Fraction(a, sum(x.shares)) == Fraction(repr(weights[i])) / total and abs(n - Fraction(a, sum(x.shares)) * x.length) < 1
    many = mixing.plan_phases([7] * 3000, [Fraction(1)] * 3000)
    assert [x.length for x in many] == [21_000]
    fine = mixing.plan_phases([10, 10], [0.1234567890123456789, 1e-30])
    assert sum(x.length for x in fine) == 20


# 7 and 8


def test_quality_counts(spark):
    texts = [None, "", " \n\t ", "a b c a b c", "a b", "x\nx\n \nx\ny", "# $ü *", "a a a a a", "w " * 100_000, "one two three " * 3 + "end", "Ünï\x0bcode\x85x"]
    got = {r.doc_id: r for r in qualityrules.judge(docs(spark, *texts).withColumn("n_words", qualityrules.F.lit("clash"))).collect()}
    import re
    from collections import Counter

    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        g = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        n = Counter(g)
        covered = {k + x for k, y in enumerate(g) if n[y] > 1 for x in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not r.kept
    assert qualityrules.judge(docs(spark)).count() == 0


def test_rules_reject_by_posterior(spark):
    r = random.Random(6)
    clean = [" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(90)) for _ in range(60)]
    marked = [x.replace(" ", "### ") for x in clean[:10]]
    got = qualityrules.judge(docs(spark, *clean, *marked)).orderBy("doc_id").toPandas()
    assert got.kept.tolist() == [True] * 60 + [False] * 10 and not got.base_failed.any()


def slow_em(patterns, width, rounds=100):
    """The same estimate text by text: every row of its own, rates as products instead of logarithms."""
    texts = [v for v, n in patterns for _ in range(n)]
    good = [0.05 if 0 in v else 0.95 for v in texts]
    for _ in range(rounds):
        p = (sum(good) + 1) / (len(texts) + 2)
        on_good, on_bad = [], []
        for k in range(width):
            g = {x: 1 + sum(a for a, v in zip(good, texts, strict=True) if v[k] == x) for x in (1, 0, None)}
            b = {x: 1 + sum(1 - a for a, v in zip(good, texts, strict=True) if v[k] == x) for x in (1, 0, None)}
            fair = (1 - qualityrules.FALSE_ALARM) / (g[1] + g[None])
            on_good.append({1: g[1] * fair, None: g[None] * fair, 0: qualityrules.FALSE_ALARM})
            on_bad.append({x: b[x] / sum(b.values()) for x in b})
        good = []
        for v in texts:
            a, c = p, 1 - p
            for k in range(width):
                a, c = a * on_good[k][v[k]], c * on_bad[k][v[k]]
            good.append(a / (a + c))
    return dict(zip(texts, good, strict=True))


def test_expectation_maximisation_text_by_text():
    patterns = [((1, 1, None), 40), ((0, 0, 1), 6), ((0, 1, 1), 3), ((None, 0, 0), 4), ((1, None, 1), 10)]
    prior, tables = qualityrules.expectation_maximisation(patterns, 3)
    want = slow_em(patterns, 3)
    for v, _ in patterns:
        z = prior + sum(t[x] for t, x in zip(tables, v, strict=True))
        assert 1 / (1 + math.exp(-z)) == pytest.approx(want[v], abs=1e-6)


def test_verdicts_of_ties_and_repeated_rows(spark):
    r = random.Random(6)
    clean = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(90))
    d = spark.createDataFrame([(1, clean), (1, clean), (None, clean), (2, clean.replace(" ", "### "))], DOC)
    got = qualityrules.judge(d).collect()
    assert len(got) == 4 and len({x.posterior for x in got if x.doc_id != 2}) == 1
    at = {x.posterior for x in got if x.doc_id == 1}.pop()
    assert all(x.kept for x in qualityrules.judge(d, threshold=at).collect() if x.doc_id != 2)  # a posterior of exactly the threshold is kept


def test_token_counts_of_nothing_and_of_repeated_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert tokens.token_counts(docs(spark), path).count() == 0
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], DOC)
    assert {(x.n_tokens, x.over_limit) for x in tokens.token_counts(d, path, limit=1).collect()} == {(2, True)}


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    r = random.Random(7)
    texts = [None, "", " ", "a ▁ b", "<s> x</s>"] + ["".join(r.choices([" ", "  ", "ab", "é", "\n", "▁", "<s>", "日本", "x y"], k=40)) for _ in range(300)]
    got = tokens.token_counts(docs(spark, *texts, "word " * 60_000).withColumn("n_tokens", tokens.F.lit(0)), path).orderBy("doc_id").collect()
    model = tokens.load(path)
    assert [x.n_tokens for x in got[:-1]] == [len(model.encode(t or "")) for t in texts]
    assert [x.n_bytes for x in got[:-1]] == [len((t or "").encode()) for t in texts]
    assert got[-1].over_limit and got[-1].n_tokens == len(model.encode("word " * 60_000))


# 10


def test_vector_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectorjoin, "BLOCK", 16)
    monkeypatch.setattr(vectorjoin, "PRODUCTS", 100)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([c + rng.normal(size=(k, 8)) * s for c, k, s in zip(centres, (60, 20, 5, 1, 30, 1), (0.1, 0.2, 0.3, 0, 0.25, 0), strict=True)])
    x = np.concatenate([x, x[:5], x[:2] * 3])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    got = vectorjoin.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", vectorjoin.F.lit(1))).toPandas().sort_values("vec_id")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(1).tolist() + [0] * len(odd)
    assert got.n_links.tolist() == want
    assert got.component_id.tolist() == vectorjoin.local_groups(near).tolist() + [1000 + i for i in range(len(odd))]
    assert (got.kept == (got.vec_id == got.component_id)).all()
    assert vectorjoin.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    # single precision, clashing columns, repeated rows, one id with two vectors
    f = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.1]), (3, [0.1, 2.0]), (2, [2.0, 0.1])]
    d = spark.createDataFrame(f, "vec_id long, embedding array<float>").selectExpr("*", "'x' as key", "1 as e", "2 as id", "3 as fine", "4 as cell", "5 as copies")
    got = sorted(map(tuple, vectorjoin.linked(d).collect()))
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 1, 1, False)]
    null = vectorjoin.linked(spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")).toPandas()
    assert null.n_links.tolist() == [0, 0] and null.kept.all()


# the pipeline

LABELS = "doc_id long, quality int, toxic int"
TABLE = "doc_id long, text string, lang string, source string, n_chars long, position long, extra map<string,int>"


def corpus(n=400):
    """Texts of two sources in a ratio of 9 to 1, some toxic, some poor, some copies, some empty or null."""
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    rows, labels = [], []
    for i in range(n):
        text = " ".join(word() for _ in range(r.choice([30, 60, 90])))
        toxic, poor = i % 8 == 3, i % 8 == 5
        text = text + " vile filth" if toxic else text.replace(" ", "### ") if poor else text
        rows.append((i, text, "en", "small" if i % 10 == 0 else "large", len(text), 1, {"a": 1}))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(n + k, rows[k * 8][1], "en", "large", 1, 1, None) for k in range(10)]
    return rows + [(None, None, None, None, None, None, None), (2000, "", "en", None, 0, 0, None), (2000, "", "en", None, 0, 0, None)], labels


def written(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, TABLE).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_run(spark, tmp_path):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
    rows, labels = corpus()
    sf_dir = written(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [c.split()[0] for c in TABLE.split(", ")], name
    left = [r.doc_id for r in docs.select("doc_id").collect()]
    kept = set(left)
    clean = {i for i in range(400) if i % 8 not in (3, 5)}
    assert clean <= kept and kept - clean - {None, 2000} == set()  # toxic, poor and copied texts are gone
    got = cp.run(spark, sf_dir).toPandas()
    assert sorted(got.doc_id[got.piece == 0].fillna(-1)) == sorted(-1 if i is None else i for i in left)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == s.length.cumsum().to_numpy() - s.length.to_numpy()).all() and s.length.sum() <= 2048


def test_packing_keeps_the_mix(spark, tmp_path, monkeypatch):
    """The sequences, in order, hold each source at its weight, which they don't if the mixing stage is left out."""
    import corpus_pipeline as cp

    monkeypatch.setattr(cp.packing.pack_stream, "__defaults__", (2048, 25))
    rows = [(i, f"a text with number {i}", "en", "b" if i < 360 else "a", 0, 0, None) for i in range(400)]
    sf_dir = written(spark, tmp_path, rows, [(0, 1, 0)])
    monkeypatch.setattr(cp, "STAGES", cp.STAGES[3:])
    # weights: isqrt(360) = 18 and isqrt(40) = 6, so a quarter of the first 160 rows is of source a
    def share(got):
        window = got.sequence_id // 2 ** 32
        assert sorted(window.value_counts().tolist()) == [25] * 16
        return [(got[window == w].doc_id >= 360).sum() for w in range(16)]

    mixed = share(cp.run(spark, sf_dir).toPandas())
    assert all(5 <= n <= 8 for n in mixed[:6]) and sum(mixed) == 40 and mixed[7:] == [0] * 9
    unmixed = share(cp.pack_sequences(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).toPandas())
    assert not all(5 <= n <= 8 for n in unmixed[:6])


def test_stages_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    sf_dir = written(spark, tmp_path, [], [])
    assert cp.run(spark, sf_dir).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_windows_follow_the_files(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(0, 1000, 1, 7).selectExpr("id as doc_id", "'x' as text", "1 as window").write.parquet(path)
    got = packing.stream_windows(spark.read.parquet(path), 100).toPandas()
    assert (got.window == got.doc_id // 100).all() and len(got) == 1000
    got = packing.stream_windows(spark.range(0, 1000, 1, 7).selectExpr("id as doc_id", "'x' as text"), 100).toPandas()
    assert (got.window == got.doc_id // 100).all()


def test_quality_is_learned_from_all_rows(spark):
    """Bins are cut at exact quantiles of more rows than were once taken of a label; Spark's sums over them give the model of the driver's."""
    r = random.Random(5)
    texts = [" ".join(r.choices(["ab", "Cde", "f1", "gh,", "#", "ij.\n", "k"], k=r.randrange(1, 12))) for _ in range(13_000)]
    good = [int(r.random() < (0.3 if "#" in t else 0.9)) for t in texts]
    d = spark.createDataFrame(list(enumerate(texts)), DOC)
    labels = spark.createDataFrame(list(enumerate(good)), "doc_id long, quality int")
    model = rankquality.train(d, labels)
    x = np.sort(rankquality.features(texts), 0)
    at = np.ceil(np.arange(1, rankquality.BINS) * len(x) / rankquality.BINS).astype(int) - 1
    assert (model.edges == x[at].T).all()
    raw = np.sort(model.raw(rankquality.features(texts)))
    n_bad = good.count(0)
    assert raw[n_bad - 1] <= model.threshold <= raw[n_bad]
    apart = rankquality.train(d.repartition(7), labels, gathered=0)
    assert np.allclose(apart.score(x), model.score(x), atol=1e-3) and (apart.edges == model.edges).all()


def test_rows_of_one_id_with_different_texts_are_different_documents(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (2, "a b c d e f"), (3, "u v w x y z"), (4, "k l m n o p"), (4, "a b c d e f")], DOC)
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(d).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 4)]
    d = spark.createDataFrame([(5, "a b c d e f"), (2, "a b c d e f"), (5, "u v w x y z"), (3, "u v w x y z"), (2, "k l m n o p")], DOC)
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(d).collect())
    assert got == [(2, 2), (2, 2), (3, 3), (5, 2), (5, 3)]
    assert {r.doc_id for r in minhash.keep_one_each(d).collect()} == {2, 3}


def test_training_rows_of_a_repeated_id_are_bounded(spark):
    """One id with far more rows than the bound gives the bound's rows, the same ones whatever the partitions."""
    texts = [f"text number {i} " + "word " * (i % 7) for i in range(300)]
    d = spark.createDataFrame([(1, t) for t in texts] + [(2, "another text")], "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (1,), (2,)], "doc_id long")
    some = rankquality.measured(d.repartition(7), ids, 40)
    assert some.shape == (40, len(rankquality.measures(""))) and (some == rankquality.measured(d.coalesce(1), ids, 40)).all()
    every = rankquality.measured(d, ids, 1000)
    assert sorted(map(tuple, every.tolist())) == sorted(tuple(map(float, rankquality.measures(t))) for t in [*texts, "another text"])
    assert rankquality.measured(d, ids.where("doc_id = 3"), 5).shape == (0, some.shape[1])


@pytest.mark.parametrize(("rule", "counts", "vote"), [
    ("v_length", {"n_words": 80}, 1), ("v_length", {"n_words": 79}, None),
    ("v_symbols", {"n_symbols": 2}, 1), ("v_symbols", {"n_symbols": 3}, None), ("v_symbols", {"n_symbols": 10}, 0),
    ("v_dup_lines", {"n_dup_lines": 2}, 1), ("v_dup_lines", {"n_dup_lines": 3}, None), ("v_dup_lines", {"n_dup_lines": 5}, 0),
    ("v_dup_lines", {"n_lines": 0}, None),
    ("v_repeats", {"n_repeat_words": 20}, 1), ("v_repeats", {"n_repeat_words": 21}, None), ("v_repeats", {"n_repeat_words": 45}, 0),
    ("v_word_length", {"word_chars": 300}, 1), ("v_word_length", {"word_chars": 900}, 1), ("v_word_length", {"word_chars": 299}, None),
    ("v_word_length", {"word_chars": 199}, 0), ("v_word_length", {"word_chars": 1500}, None), ("v_word_length", {"word_chars": 1501}, 0),
    ("v_capitals", {"n_upper": 75}, 1), ("v_capitals", {"n_upper": 76}, None), ("v_capitals", {"n_upper": 250}, 0),
    ("v_shouts", {"n_shouts": 5}, 1), ("v_shouts", {"n_shouts": 6}, None), ("v_shouts", {"n_shouts": 30}, 0),
    ("v_distinct", {"n_distinct": 25}, 1), ("v_distinct", {"n_distinct": 24}, None), ("v_distinct", {"n_distinct": 12}, 0),
])
def test_each_rule_votes_at_its_bounds(spark, rule, counts, vote):
    fine = {"n_words": 100, "word_chars": 500, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "n_upper": 0, "n_shouts": 0, "n_lines": 10, "n_distinct": 100}
    row = spark.createDataFrame([tuple((fine | counts).values())], ", ".join(f"{c} long" for c in fine))
    votes = row.select(*[v.alias(k) for k, v in qualityrules.rules().items()]).first().asDict()
    # only n_words, word_chars and n_lines are read by several rules
    assert votes.pop(rule) == vote
    assert set(votes.values()) <= ({1, None} if {"n_words", "word_chars", "n_lines"} & set(counts) else {1})


def test_no_rule_votes_without_a_word(spark):
    got = qualityrules.text_counts(docs(spark, None, "", " \n\t ")).select(*[v.alias(k) for k, v in qualityrules.rules().items()])
    assert {v for r in got.collect() for v in r} == {None}
