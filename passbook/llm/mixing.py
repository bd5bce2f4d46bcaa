"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A block is one row of a source.  With integer shares a of a total A, block k of a source
(from 0) is released at slot floor(k A / a) and due by slot ceil((k + 1) A / a); in every
slot the released block with the earliest deadline goes (ties: by the source's number).
As the weights a / A sum to 1 every block meets its window, so at any slot each source is
less than one block off its target weight.

Phases.  A phase lasts until a source would run out at its weight: P, the least of
floor(rows A / a).  By then every source has had floor or ceil of P a / A blocks; ceil goes
to the blocks released first, which can always be met.  The rest is scheduled anew, with
the weights of the sources that have rows scaled to sum to 1.  There are at most two phases
per source, worked out from the sizes alone.

Slots.  Within a phase the schedule repeats after A slots, so a period and what follows
the last whole one are all that is laid out.  They are cut into chunks that Spark
schedules independently: a chunk starts its schedule ``lead`` = ceil(A / least a) + 1 slots
early, from the state in which the blocks of earliest deadline are ahead.  Two schedules
that differ only in blocks already released agree once these are due, at most ``lead``
slots later, so every chunk continues the one before it exactly.

Weights given are taken as the decimal numbers they are written as, so their shares are
integers; they are not rounded.  Default weights: the integer square root of a source's
rows, whose period grows with the square root of the rows only.  The driver holds one
number per source, and per phase and source; rows never reach it.  Ranks within a source
come from salted windows, so a source with a third of all rows is ranked by many tasks.
A slot costs time in proportion to the number of sources that still have rows.

Defined results: a null source is a source of its own; sources without a given weight
share the least given weight; weights of absent sources are ignored; a weight that is not
positive raises ValueError; weights that have no common denominator below ``LIMIT`` are
taken to half of it, which moves no block by a millionth of its size in 10 ** 11 rows.
Equal ids get different positions, in any order.  Null ids are ordered by hash.  An empty table gives no rows.
Further columns are passed on; one with the name of an added column is replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need, rank_in_groups

#: Slots of a chunk, and of a stride within it, at least.
CHUNK, STRIDE = 4096, 64
#: Rows up to which the tables of phases and of slots are broadcast; larger ones are joined by shuffle.
SMALL = 1 << 18
LIMIT = 1 << 60
ADDED = ("block", "phase", "release", "deadline", "share", "position")


class Phase(NamedTuple):
    """Active sources with their shares, blocks placed before, and blocks placed in the phase."""

    start: int
    length: int
    sources: list[int]
    shares: list[int]
    before: list[int]
    placed: list[int]


def whole(weights: list[float]) -> list[int]:
    """Integers in exactly the ratios of the weights, without a common divisor."""
    exact = [w if isinstance(w, Fraction) else Fraction(repr(w)) for w in weights]
    scale = math.lcm(*[x.denominator for x in exact])
    out = [int(x * scale) for x in exact]
    common = math.gcd(*out)
    return [x // common for x in out]


def plan_phases(sizes: list[int], weights: list[float]) -> list[Phase]:
    """The phases of the mix of sources of ``sizes`` rows."""
    left, out, start = list(sizes), [], 0
    while active := [i for i, n in enumerate(left) if n]:
        shares = whole([weights[i] for i in active])
        total = sum(shares)
        if total >= LIMIT:
            shares = [max(1, a * (LIMIT // 2) // total) for a in shares]
            total = sum(shares)
        length = min(left[i] * total // a for i, a in zip(active, shares, strict=True))
        placed = [length * a // total for a in shares]
        # (release, not the last of its source, number) of the blocks that are under way at the end
        under_way = sorted((placed[j] * total // a, left[i] - placed[j] > 1, j)
                           for j, (i, a) in enumerate(zip(active, shares, strict=True)) if length * a % total)
        for *_, j in under_way[:length - sum(placed)]:
            placed[j] += 1
        out.append(Phase(start, length, active, shares, [sizes[i] - left[i] for i in active], placed))
        for j, i in enumerate(active):
            left[i] -= placed[j]
        start += length
    return out


def parts(phases: list[Phase]) -> list[tuple]:
    """(phase, part, length, total, lead, sources): a whole period (part 0), and what is no whole one (part 1).

    A source there: number, share a, A div a, A mod a, number of blocks.
    """
    out = []
    for p, x in enumerate(phases):
        total = sum(x.shares)
        each = lambda ends: [(i, a, total // a, total % a, n) for i, a, n in zip(x.sources, x.shares, ends, strict=True)]  # noqa: B023, E731
        times, rest = divmod(x.length, total)
        lead = -(-total // min(x.shares)) + 1
        if times:
            out.append((p, 0, total, total, lead, each(x.shares)))
        if rest:
            out.append((p, 1, rest, total, lead, each([n - times * a for n, a in zip(x.placed, x.shares, strict=True)])))
    return out


def _block(x: Column, k: Column, release: Column, remainder: Column, length: Column) -> Column:
    """State of a source (a field of ``x`` each: no, a, q, s, e) whose next block is k; k A = release a + remainder."""
    carry = (remainder + x["s"] >= x["a"]).cast("long")
    after, rest = release + x["q"] + carry, remainder + x["s"] - carry * x["a"]
    return F.struct(
        x["no"].alias("no"), x["a"].alias("a"), x["q"].alias("q"), x["s"].alias("s"), x["e"].alias("e"), k.alias("k"), release.alias("release"),
        after.alias("after"), rest.alias("rest"), F.least(after + (rest > 0).cast("long"), length).alias("deadline"))


def _begin(x: Column, at: Column, total: Column, length: Column) -> Column:
    """State of a source at slot ``at`` with floor(at a / A) blocks placed."""
    exact = lambda c: c.cast("decimal(19,0)")
    k = F.floor((exact(at) * exact(x["a"]) - (exact(at) * exact(x["a"])) % exact(total)) / exact(total)).cast("long")
    remainder = ((exact(k) * exact(total)) % exact(x["a"])).cast("long")
    release = F.floor((exact(k) * exact(total) - exact(remainder)) / exact(x["a"])).cast("long")
    return _block(x, k, release, remainder, length)


def _advanced(x: Column, length: Column) -> Column:
    return _block(x, x["k"] + 1, x["after"], x["rest"], length)


def slots(spark: SparkSession, phases: list[Phase]) -> DataFrame:
    """``(s_phase, s_part, s_no, s_k, slot, s_release, s_deadline)``: the slot of block k of each source in each part."""
    table = spark.createDataFrame(
        parts(phases), "s_phase int, s_part int, length long, total long, lead long, "
        "sources array<struct<no: long, a: long, q: long, s: long, e: long>>")
    length, total = F.col("length"), F.col("total")
    chunk = F.greatest(F.lit(CHUNK), "lead")
    chunks = table.select("*", chunk.alias("chunk"), F.greatest(F.lit(1), F.floor(length / chunk)).cast("long").alias("n")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c"))
    dealt = chunks.select("*", (F.col("c") * F.col("chunk")).alias("first")).select(
        "*", F.when(F.col("c") == F.col("n") - 1, length).otherwise(F.col("first") + F.col("chunk")).alias("until"),
        F.greatest(F.lit(0), F.col("first") - F.col("lead")).alias("at")).repartition("s_phase", "s_part", "c")
    even = dealt.select("*", F.transform("sources", lambda x: _begin(x, F.col("at"), total, length)).alias("even"))
    # of the blocks that are under way at the start, those of earliest deadline are placed already
    behind = F.sort_array(F.transform(F.filter("even", lambda x: x["release"] < F.col("at")), lambda x: F.struct(x["deadline"], x["no"])))
    ahead = F.slice(behind, 1, (F.col("at") - F.aggregate("even", F.expr("0L"), lambda n, x: n + x["k"])).cast("int"))
    begun = even.select("*", F.transform(ahead, lambda x: x["no"]).alias("ahead")).select(
        "*", F.transform("even", lambda x: F.when(F.array_contains("ahead", x["no"]), _advanced(x, length)).otherwise(x)).alias("state"),
        F.greatest(F.lit(STRIDE), F.floor(F.sqrt(F.col("until") - F.col("at")))).cast("long").alias("step"))

    # Spark copies what an aggregate carries at every step, so strides of about the root of the chunk keep
    # that short, and a slot takes two steps: first the choice, then the change of state.
    none = F.expr("cast(array() as array<bigint>)")
    no_choice = F.expr("cast(null as struct<deadline: bigint, no: bigint, k: bigint, release: bigint>)")

    def carried(state: Column, best: Column, out: Column) -> Column:
        return F.struct(state.alias("state"), best.alias("best"), out.alias("out"))

    def place(acc: Column, step: Column) -> Column:
        best = acc["best"]
        choice = F.array_min(F.transform(
            F.filter(acc["state"], lambda x: (x["release"] <= F.shiftright(step, 1)) & (x["k"] < x["e"])),
            lambda x: F.struct(*[x[c].alias(c) for c in ("deadline", "no", "k", "release")])))
        changed = F.transform(acc["state"], lambda x: F.when(x["no"] == best["no"], _advanced(x, length)).otherwise(x))
        return F.when(step % 2 == 0, carried(acc["state"], choice, acc["out"])).otherwise(
            carried(changed, no_choice, F.concat(acc["out"], F.array(best["no"], best["k"], best["release"], best["deadline"]))))

    def stride(acc: Column, slot: Column) -> Column:
        run = F.sequence(2 * slot, 2 * F.least(slot + F.col("step"), F.col("until")) - 1)
        done = F.aggregate(run, carried(acc["state"], no_choice, none), place)
        return F.element_at(F.transform(F.array(done), lambda x: F.struct(
            x["state"].alias("state"), F.concat(acc["out"], x["out"]).alias("out"))), 1)

    laid = begun.select("s_phase", "s_part", "first", "at", F.aggregate(
        F.sequence("at", F.col("until") - 1, F.col("step")), F.struct(F.col("state").alias("state"), none.alias("out")),
        stride, lambda acc: acc["out"]).alias("out"))
    names = ("s_no", "s_k", "s_release", "s_deadline")
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size("out") / 4).cast("int") - 1), lambda i: F.struct(
        *[F.get("out", (4 * i + j).cast("int")).alias(c) for j, c in enumerate(names)]))
    # outer: no filter may repeat the schedule below
    placed = laid.select("s_phase", "s_part", "first", "at", F.posexplode_outer(rows).alias("i", "x"))
    return placed.select("s_phase", "s_part", *[f"x.{c}" for c in names], (F.col("at") + F.col("i")).alias("slot"), "first").where(
        "slot >= first").drop("first")


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """``docs`` (doc_id, source, ...) plus block, phase, release, deadline, share and position (from 0, gapless).

    release and deadline are positions: the window in which the block is due; share is
    the weight of the source in its phase.
    """
    spark = docs.sparkSession
    if weights and not all(w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    kept = [c for c in docs.columns if c not in ADDED]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "doc_id", "source")
    found = [(r["source"], r["n"]) for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()]  # one row per source
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    names, sizes = [x[0] for x in found], [x[1] for x in found]
    targets = [weights.get(x, min(weights.values())) for x in names] if weights else [Fraction(math.isqrt(n)) for n in sizes]
    phases = plan_phases(sizes, targets)
    small = lambda df, n: F.broadcast(df) if n <= SMALL else df
    sources = small(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "m_source string, m_no int"), len(names))
    rows = [(i, p, k, k + n, x.start, x.length // sum(x.shares), sum(x.shares), a, a / sum(x.shares))
            for p, x in enumerate(phases) for i, a, k, n in zip(x.sources, x.shares, x.before, x.placed, strict=True) if n]
    phase_table = small(spark.createDataFrame(
        rows, "p_no int, phase int, k0 long, k1 long, p0 long, times long, period long, per long, share double"), len(rows))
    named = docs.join(sources, docs["source"].eqNullSafe(F.col("m_source"))).drop("m_source")
    ranked = rank_in_groups(named, ["m_no"], ["doc_id"], "block")
    placed = ranked.join(phase_table, (F.col("m_no") == F.col("p_no")) & (F.col("block") >= F.col("k0")) & (F.col("block") < F.col("k1")))
    # a slot's place and window count from the start of its period
    turn = F.expr("least((block - k0) div per, times)")
    placed = placed.withColumn("turn", turn).withColumns({
        "part": F.when(F.col("turn") < F.col("times"), 0).otherwise(1),
        "in_part": F.expr("block - k0 - turn * per"),
        "start": F.expr("p0 + turn * period")})
    laid_out = small(slots(spark, phases), sum(x[2] for x in parts(phases)))
    return placed.join(laid_out, (F.col("phase") == F.col("s_phase")) & (F.col("part") == F.col("s_part")) &
                       (F.col("m_no") == F.col("s_no")) & (F.col("in_part") == F.col("s_k"))).select(
        "row.*", "block", "phase", (F.col("start") + F.col("s_release")).alias("release"),
        (F.col("start") + F.col("s_deadline")).alias("deadline"), "share", (F.col("start") + F.col("slot")).alias("position"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source")
    return mix(docs).select("doc_id", "source", "block", "phase", "release", "deadline", "share", "position")
