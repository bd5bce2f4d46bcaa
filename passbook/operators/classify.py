"""Merchant normalisation, spending semantics and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions import lexicon, text


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def merchant_struct(raw: Column) -> Column:
    """{key, display, raw_normalized} of a merchant text; null for a blank one."""
    keys = _literal_map({t: k for t, (k, _) in lexicon.MERCHANT_ALIASES.items()})
    names = _literal_map({t: d for t, (_, d) in lexicon.MERCHANT_ALIASES.items()})

    def named(collapsed: Column, cleaned: Column) -> Column:
        folded = text.squeeze(F.regexp_replace(F.lower(cleaned), "[^a-z0-9]+", " "))
        return text.let(folded, lambda key: F.struct(
            F.when(key == "", "unknown").otherwise(F.coalesce(keys[key], key)).alias("key"),
            F.when(key == "", collapsed).otherwise(F.coalesce(names[key], cleaned)).alias("display"),
            collapsed.alias("raw_normalized")))

    def cleaned(collapsed: Column) -> Column:
        bare = text.squeeze(F.regexp_replace(F.regexp_replace(collapsed, lexicon.WWW_PREFIX, ""), lexicon.PROCESSOR_PREFIX, ""))
        cut = text.let(bare, lambda b: F.when(F.instr(b, "@") > 1, text.squeeze(F.substring_index(b, "@", 1))).otherwise(b))
        return F.when(collapsed != "", text.let(cut, lambda c: named(collapsed, c)))

    return text.let(F.regexp_replace(text.squeeze(raw), r"\s+", " "), cleaned)


def haystack(key: Column, display: Column, raw: Column) -> Column:
    return F.concat_ws(" ", display, raw, key)


def transfer_status(direction: Column, words: Column, user: Column | None = None) -> Column:
    """The user's status if given, else SUSPECTED for transfers and own accounts."""
    inferred = F.when((direction == "TRANSFER") | F.coalesce(words, F.lit("")).rlike(lexicon.OWN_ACCOUNT), "SUSPECTED").otherwise("NONE")
    return inferred if user is None else F.coalesce(user, inferred)


def spending_role(direction: Column, status: Column, excluded: Column | None = None) -> Column:
    role = (F.when((status != "NONE") | (direction == "TRANSFER"), "TRANSFER").when(direction == "DEBIT", "GROSS_EXPENSE")
            .when(direction == "CREDIT", "CREDIT").otherwise("REFUND"))
    return role if excluded is None else F.when(excluded, "EXCLUDED").otherwise(role)


def inclusion_flags(role: Column) -> dict[str, Column]:
    """What a role counts towards."""
    return {
        "in_gross_expense": role == "GROSS_EXPENSE",
        "in_refunds": role == "REFUND",
        "in_credits": role == "CREDIT",
        "is_transfer": role == "TRANSFER",
        "in_net_spending": role.isin("GROSS_EXPENSE", "REFUND"),
    }


def category(direction: Column, method: Column, status: Column, key: Column, words: Column, user: Column | None = None) -> Column:
    """User's category, direction, transfer, cash, exact merchant, first keyword, other: in that order."""
    out = F.when(direction.isin("CREDIT", "REFUND", "REVERSAL"), "income_and_refunds").when(direction == "TRANSFER", "transfers")
    out = out.when(status != "NONE", "transfers").when(method == "ATM", "cash_withdrawal")
    exact = _literal_map(lexicon.EXACT_CATEGORIES)[key]
    out = out.when(exact.isNotNull(), exact)
    for pattern, name in lexicon.KEYWORD_CATEGORIES:
        out = out.when(words.rlike(pattern), name)
    out = out.otherwise("other")
    if user is not None:
        out = F.when(user.isin(*[c for c, _ in lexicon.CATEGORIES]), user).otherwise(out)
    return out


def future_rules(corrections: DataFrame) -> DataFrame:
    """One row per merchant key with the newest future rule of each field; ties go to the greater id."""
    rules = corrections.where("apply_to_future and merchant_match_key is not null")
    newest = lambda field: F.max_by(
        F.when(F.col("field_name") == field, F.col("new_value")),
        F.when(F.col("field_name") == field, F.struct("updated_at", "correction_id")))
    return rules.groupBy("merchant_match_key").agg(
        *[newest(f).alias("rule_" + f.lower()) for f in
          ("MERCHANT", "CATEGORY", "DIRECTION", "TRANSFER_STATUS", "DUPLICATE_STATUS", "NOT_A_TRANSACTION")])


def one_of(value: Column, allowed) -> Column:
    """The value, trimmed and in capitals, if it is allowed; else null."""
    return text.let(F.upper(text.squeeze(value)), lambda v: F.when(v.isin(*allowed), v))


def resolved_merchants(tx: DataFrame, stored: DataFrame) -> DataFrame:
    """``tx`` plus resolved_display: the display of the latest stored row (merchant_key, merchant_display, ts_ms, tx_id) of its key, else its own.

    Rows without a merchant key drop out.
    """
    latest = stored.where("merchant_key is not null").groupBy(F.col("merchant_key").alias("r_key")).agg(
        F.max_by("merchant_display", F.struct("ts_ms", "tx_id")).alias("r_display"))
    known = tx.where("merchant_key is not null")
    return known.join(latest, known["merchant_key"] == latest["r_key"], "left").select(
        *[known[c] for c in tx.columns], F.coalesce("r_display", "merchant_display").alias("resolved_display"))


def classified(candidates: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Candidates plus merchant, role, category and duplicate_override, under the future rules of their merchant."""
    c = candidates.withColumn("m", merchant_struct(F.col("merchant"))).select(
        *candidates.columns, F.col("m.key").alias("merchant_key"), F.col("m.display").alias("merchant_display"),
        F.col("m.raw_normalized").alias("merchant_raw"))
    none = F.lit(None).cast("string")
    user = {k: none for k in ("merchant", "category", "direction", "transfer_status", "duplicate_status", "not_a_transaction")}
    if rules is not None:
        c = c.join(rules, c["merchant_key"] == rules["merchant_match_key"], "left")
        user = {k: F.col("rule_" + k) for k in user}
    direction = F.coalesce(one_of(user["direction"], lexicon.DIRECTIONS), F.col("direction"))
    display = F.coalesce(user["merchant"], F.col("merchant_display"))
    words = haystack(F.col("merchant_key"), display, F.col("merchant_raw"))
    status = transfer_status(direction, words, one_of(user["transfer_status"], lexicon.STATUSES))
    excluded = F.coalesce(F.lower(text.squeeze(user["not_a_transaction"])) == "true", F.lit(False))
    keep = [x for x in candidates.columns if x not in ("direction", "merchant")]
    return c.select(
        *keep, direction.alias("direction"), "merchant_key", display.alias("merchant_display"), "merchant_raw",
        status.alias("transfer_status"), spending_role(direction, status, excluded).alias("role"),
        category(direction, F.col("payment_method"), status, F.col("merchant_key"), words, user["category"]).alias("category_id"),
        one_of(user["duplicate_status"], lexicon.STATUSES).alias("duplicate_override"))
