"""Extraction under very many rules, by an index of the literals that they require.

``messages.outcome`` unrolls all rules in one expression, which suits dozens.  Here the rules are
a table.  A pattern that cannot match without a certain piece of plain text has that piece as its
literal; all literals and sender needles are looked for in one pass over a message (Aho-Corasick), and the
message meets only the rules whose literal it holds, plus those without any.  What a rule
then finds is worked out by Spark's own regular expressions, its pattern being a column.

Defined results: the rows of ``messages.extractions``, in any order of columns' evaluation; messages with a null sender or body find
nothing.  Rules are control data: the automaton is built once a worker from the rules given, and the table of rules is broadcast
while it has at most ``BROADCAST`` rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.functions import text
from passbook.sources.rules import Rules

#: Rules whose table is broadcast, and least letters of a literal.
BROADCAST, LEAST = 100_000, 3
RULE = ("rule_seq int, rule_id string, institution string, direction string, pattern string, amount_at int, merchant_at int, reference_at int, "
        "currency_at int, date_at int")
_PLAIN = re.compile(r"[A-Za-z0-9 ]")


def literal(pattern: str) -> str | None:
    """The longest run of plain characters that every match holds, in lower case; None if there is none of ``LEAST`` letters.

    Only characters outside groups, classes and alternatives count, and none before a quantifier; a pattern with an alternative
    at its top has none.
    """
    if re.search(r"\\Q|\(\?[a-z]*[-x]", pattern):
        return None  # quoting, or flags that change what plain text means
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        step = 1
        plain = False
        if c == "\\":
            step = 2
        elif c == "[":
            m = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]").match(pattern, i)
            if not m or "[" in m[0][1:]:
                return None  # nested classes
            step = len(m[0])
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            return None
        elif c == "{":
            step = (pattern + "}").index("}", i) + 1 - i
        else:
            plain = not depth and bool(_PLAIN.match(c))
        following = pattern[i + step:i + step + 1]
        if plain and following not in ("?", "*", "+", "{"):
            run += c
        else:
            runs.append(run)
            run = ""
        i += step
    best = max([*runs, run], key=len)
    return best.lower() if sum(x.isalnum() for x in best) >= LEAST else None


def table(spark: SparkSession, rules: Rules) -> DataFrame:
    """One row per rule (``RULE``)."""
    rows = []
    for i in rules.institutions:
        for p in i.patterns:
            rows.append((len(rows), p.id, i.name, p.direction, "(?is)" + p.regex, *[p.index(g) for g in (
                p.amount_group, p.merchant_group, p.reference_group, p.currency_group, p.date_group)]))
    return spark.createDataFrame(rows, RULE)


def met(messages: DataFrame, rules: Rules) -> DataFrame:
    """``messages`` with rule_seq and own (whether the rule's institution knows the sender), a row per rule that is worth trying."""
    flat = [(k, p) for k, i in enumerate(rules.institutions) for p in i.patterns]
    of_literal: dict[str, list[int]] = {}
    always = []
    for n, (_, p) in enumerate(flat):
        if (piece := literal(p.regex)) is None:
            always.append(n)
        else:
            of_literal.setdefault(piece, []).append(n)
    of_sender: dict[str, list[int]] = {}
    for k, i in enumerate(rules.institutions):
        for s in i.senders:
            if s.strip():
                of_sender.setdefault(s.strip().upper(), []).append(k)
    house = [k for k, _ in flat]

    def automaton(pieces: dict[str, list[int]]):
        import ahocorasick

        a = ahocorasick.Automaton()
        for piece, held in pieces.items():
            a.add_word(piece, held)
        a.make_automaton()
        return a if pieces else None

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies, senders = automaton(of_literal), automaton(of_sender)
        for batch in batches:
            seqs, owns = [], []
            for sender, body in zip(batch.column("sender").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if sender is None or body is None:
                    seqs.append([])
                    owns.append([])
                    continue
                own = {k for _, held in senders.iter(sender.upper()) for k in held} if senders else set()
                tried = {n for _, held in bodies.iter(body.lower()) for n in held} if bodies else set()
                # those of the institutions that know the sender; all if none does
                mine = sorted(n for n in tried.union(always) if not own or house[n] in own)
                seqs.append(mine)
                owns.append([house[n] in own for n in mine])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seqs, pa.list_(pa.int32())), pa.array(owns, pa.list_(pa.bool_()))],
                                             [*batch.schema.names, "seqs", "owns"])

    base = messages.select("source_message_id", "sender", "received_ms", "body")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema) + ", seqs array<int>, owns array<boolean>"
    rows = base.mapInArrow(found, schema)
    return rows.select(*base.columns, F.explode(F.arrays_zip("seqs", "owns")).alias("x")).select(
        *base.columns, F.col("x.seqs").alias("met_seq"), F.col("x.owns").alias("own"))


def extractions(messages: DataFrame, rules: Rules) -> DataFrame:
    """As ``messages.extractions``: one row per message and rule that matches with a valid amount."""
    every = table(messages.sparkSession, rules)
    few = sum(len(i.patterns) for i in rules.institutions) <= BROADCAST
    tried = met(messages, rules)
    # messages of one rule follow each other in a task where Spark shuffles, so its pattern is compiled once for them
    joined = tried.join(F.broadcast(every) if few else every, tried["met_seq"] == every["rule_seq"])
    matching = joined.where(F.rlike("body", F.col("pattern")))

    def part(at: str) -> Column:
        return F.when(F.col(at).isNotNull(), text.present(F.call_function("regexp_extract", F.col("body"), F.col("pattern"), F.coalesce(at, F.lit(0)))))

    found = matching.withColumns({
        "amount_minor": text.amount_minor(part("amount_at")), "merchant": part("merchant_at"), "reference": part("reference_at"),
        "given_currency": text.currency_code(part("currency_at")), "given_date": text.date_millis(part("date_at"))}).where("amount_minor is not null")
    confidence = F.lit(0.50)
    for given, weight in ((F.col("own"), 0.25), (F.col("merchant").isNotNull(), 0.10), (F.col("reference").isNotNull(), 0.08),
                          (F.col("given_currency").isNotNull(), 0.04), (F.col("given_date").isNotNull(), 0.03)):
        confidence = confidence + F.when(given, weight).otherwise(0.0)
    return found.select(
        "source_message_id", "sender", "received_ms", "body", "rule_seq", "rule_id", "institution", F.col("own").alias("sender_known"), "direction",
        "amount_minor", F.coalesce("given_currency", F.lit("INR")).alias("currency"), "merchant",
        F.when(F.col("reference").isNotNull(), F.substring(F.sha2("reference", 256), 1, 32)).alias("reference_hash"),
        F.least(F.lit(1.0), confidence).alias("confidence"), F.coalesce("given_date", "received_ms").alias("ts_ms"))
