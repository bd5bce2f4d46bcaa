"""Quality rules combined by weak supervision, in DataFrame functions only.

Every rule votes good (1), bad (0) or abstains (null) on a text's counts.  Expectation
maximisation over the distinct vote patterns (at most 3 ** rules rows, counted by
Spark) estimates how each rule votes on good and on bad texts; the posterior
probability of good replaces the demand that every rule pass.  ``base_failed`` is the
one hard rule: fewer than ``MIN_WORDS`` words, or more than half of them in repeated
3-word windows.

Counts per whole text: words are runs of anything but ASCII white space;
``word_chars`` code points in words; ``n_symbols`` characters of ``#*$%&|<>``;
``n_dup_lines`` lines with a word that equal an earlier line; ``n_repeat_words`` words
covered by a 3-word window that occurs at least twice in the text.  Windows are
compared by 64-bit hash.

Defined results: null text has no words and fails the base rule; ties of a posterior
of exactly the threshold are kept; repeated rows are counted as often as they occur;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, need

MIN_WORDS = 50
GAP = r"[\x20\x09-\x0D]+"
ROUNDS = 100
#: Share of good texts that a rule may call bad: given, as the rules' bounds are set for it.
FALSE_ALARM = 0.001


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def text_counts(docs: DataFrame) -> DataFrame:
    """One row of counts per row of ``docs`` (doc_id, text)."""
    d = need(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", F.array_remove(F.split("text", GAP), "").alias("w"))
    d = d.select(
        "doc_id", "w", F.size("w").alias("n"), F.array_join("w", "").alias("joined"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select(
        "doc_id", "n",
        F.length("joined").alias("word_chars"),
        F.length(F.regexp_replace("joined", "[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("joined", r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.length(F.regexp_replace("joined", "[^!?]+", "")).alias("n_shouts"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    windows = F.greatest(F.col("n") - 2, F.lit(0))
    d = d.withColumn("g", F.zip_with(
        F.zip_with(F.slice("h", 1, windows), F.slice("h", 2, windows), lambda a, b: F.xxhash64(a, b)),
        F.slice("h", 3, windows), lambda a, c: F.xxhash64(a, c))).drop("h")
    # only texts with a repeated window sort their windows with their places
    d = d.withColumn("s", F.when(
        F.size(F.array_distinct("g")) < F.size("g"),
        F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("g")
    rest = F.size("s") - 1
    d = d.withColumn("at", F.when(F.col("s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(
        F.zip_with(F.slice("s", 1, rest), F.slice("s", 2, rest),
                   lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
        lambda x: x.isNotNull())))))).drop("s")
    rest = F.size("at") - 1
    d = d.withColumn("n_repeat_words", F.when(F.col("at").isNotNull(), F.lit(3) + _sum(F.zip_with(
        F.slice("at", 1, rest), F.slice("at", 2, rest), lambda a, b: F.least(b - a, F.lit(3))))).otherwise(F.lit(0)))
    return d.select("doc_id", F.col("n").cast("long").alias("n_words"), *(
        F.col(c).cast("long").alias(c) for c in
        ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_shouts", "n_lines", "n_distinct")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _between(share: Column, good: float, bad: float) -> Column:
    """Good up to ``good``, bad from ``bad``, silent between (either order)."""
    if good < bad:
        return F.when(share <= good, 1).when(share >= bad, 0)
    return F.when(share >= good, 1).when(share <= bad, 0)


def rules() -> dict[str, Column]:
    """The votes by rule: 1 good, 0 bad, null abstains (always if there is no word)."""
    n, lines = F.col("n_words"), F.col("n_lines")
    share = lambda c: F.col(c) / F.nullif(n, F.lit(0))
    mean = share("word_chars")
    return {
        "v_length": F.when(n >= 80, 1),
        "v_symbols": _between(share("n_symbols"), 0.02, 0.1),
        "v_dup_lines": _between(F.col("n_dup_lines") / F.nullif(lines, F.lit(0)), 0.2, 0.5),
        "v_repeats": _between(share("n_repeat_words"), 0.2, 0.45),
        "v_word_length": F.when(mean.between(3.0, 9.0), 1).when((mean < 2.0) | (mean > 15.0), 0),
        "v_capitals": _between(F.col("n_upper") / F.nullif(F.col("word_chars"), F.lit(0)), 0.15, 0.5),
        "v_shouts": _between(share("n_shouts"), 0.05, 0.3),
        "v_distinct": _between(share("n_distinct"), 0.25, 0.12),
    }


def expectation_maximisation(patterns: list[tuple[tuple[int | None, ...], int]], width: int) -> tuple[float, list[dict]]:
    """Log prior odds of good, and per rule the log-likelihood ratio of each vote.

    ``patterns``: distinct vote vectors with their row counts.  On good texts a rule
    votes bad at the rate ``FALSE_ALARM``: estimated freely, the classes would drift to
    whichever rules agree most often.  All else is estimated, smoothed by one row per vote.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return 0.0, [{1: 0.0, 0: 0.0, None: 0.0} for _ in range(width)]

    # start: a text is doubtful if any rule calls it bad; the rounds then weigh the rules
    good = [0.05 if 0 in votes else 0.95 for votes, _ in patterns]
    prior, tables = 0.0, []
    for _ in range(ROUNDS):
        weight = sum(g * n for g, (_, n) in zip(good, patterns, strict=True))
        p = (weight + 1) / (total + 2)
        prior = math.log(p / (1 - p))
        tables = []
        for k in range(width):
            counts = {v: [1.0, 1.0] for v in (1, 0, None)}
            for g, (votes, n) in zip(good, patterns, strict=True):
                counts[votes[k]][0] += g * n
                counts[votes[k]][1] += (1 - g) * n
            fair = (1 - FALSE_ALARM) / (counts[1][0] + counts[None][0])
            on_good = {1: counts[1][0] * fair, None: counts[None][0] * fair, 0: FALSE_ALARM}
            on_bad = sum(c[1] for c in counts.values())
            tables.append({v: math.log(on_good[v]) - math.log(c[1] / on_bad) for v, c in counts.items()})
        new = []
        for votes, _ in patterns:
            z = prior + sum(t[v] for t, v in zip(tables, votes, strict=True))
            new.append(1 / (1 + math.exp(-max(min(z, 500), -500))))
        moved = max(abs(a - b) for a, b in zip(good, new, strict=True))
        good = new
        if moved < 1e-9:
            break
    return prior, tables


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, base_failed, posterior and kept per row of ``docs`` (doc_id, text)."""
    votes = rules()
    names = list(votes)
    counted = cut(text_counts(docs).select("*", *(v.alias(k) for k, v in votes.items())))
    found = counted.groupBy(*names).count().collect()  # 3 ** len(rules) rows at most
    prior, tables = expectation_maximisation([(tuple(r[k] for k in names), r["count"]) for r in found], len(names))
    z = F.lit(prior)
    for k, t in zip(names, tables, strict=True):
        z = z + F.when(F.col(k) == 1, t[1]).when(F.col(k) == 0, t[0]).otherwise(t[None])
    return counted.select("*", base_failed().alias("base_failed"), (1 / (1 + F.exp(-z))).alias("posterior")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
