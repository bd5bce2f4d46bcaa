"""DuckDB SQL for the catalogue's queries, built from the same tables of fixed values."""

from __future__ import annotations

import re

from passbook.functions import lexicon
from passbook.operators.recurrence import FREQUENCIES
from passbook.sources.adapters import MERCHANTS, METHODS
from passbook.sources.rules import REGRESSION

START, END, NOW = 800_000_000_000, 900_000_000_000, 1_000_000_000_000
#: A period that begins and ends within a day.
OFF_START, OFF_END = 790_000_000_123, 899_000_456_789
#: What is searched for by the trigram index.
NEEDLES = ("#0000_01", "CUSTOMER#00000001", "er#0%17", "77", "no such", "R#%")
#: The copies that the scan's queries add to the messages.
COPY_ID, COPY_MS = 10_000_000, 600_000
#: Future rules of the scan's queries: (field, value, merchant key, updated at).
SCAN_RULES = (
    ("DUPLICATE_STATUS", " none ", "swiggy", 5), ("DUPLICATE_STATUS", "CONFIRMED", "amazon", 5), ("CATEGORY", "travel", "uber", 5), ("CATEGORY", "fuel", "uber", 4),
    ("MERCHANT", "Ride", "uber", 5), ("DIRECTION", "refund", "netflix", 5), ("TRANSFER_STATUS", "SUSPECTED", "city cafe", 5),
    ("NOT_A_TRANSACTION", "true", "own account", 5), ("DUPLICATE_STATUS", "gift", "netflix", 6),
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


def _find(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {_q(pattern)})"


def _any(c: str, patterns) -> str:
    return "(" + " OR ".join(_find(c, p) for p in patterns) + ")"


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


TX = f"""
tx AS (
  SELECT o_orderkey AS tx_id, epoch_us(o_orderdate) // 1000 AS ts_ms, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor,
    CASE WHEN o_orderkey % 20 = 0 THEN 'USD' ELSE 'INR' END AS currency,
    {_list(lexicon.DIRECTIONS)}[CAST(substr(o_orderpriority, 1, 1) AS INT)] AS direction,
    CASE o_orderstatus WHEN 'F' THEN 'NONE' WHEN 'O' THEN 'SUSPECTED' ELSE 'CONFIRMED' END AS duplicate_status,
    CASE WHEN o_orderkey % 13 = 0 THEN 'SUSPECTED' ELSE 'NONE' END AS transfer_status,
    {_list(METHODS)}[CAST(o_orderkey % 7 + 1 AS INT)] AS payment_method,
    CASE WHEN o_custkey % 11 <> 0 THEN lower(c_name) END AS merchant_key,
    CASE WHEN o_custkey % 11 <> 0 THEN c_name END AS merchant_display, lower(c_mktsegment) AS category_id
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
CORR = """
corr AS (
  SELECT o_orderkey AS correction_id, o_orderkey AS tx_id,
    CASE o_orderkey % 70 WHEN 0 THEN 'NOT_A_TRANSACTION' WHEN 10 THEN 'CATEGORY' WHEN 20 THEN 'DIRECTION' WHEN 30 THEN 'MERCHANT'
      WHEN 40 THEN 'DUPLICATE_STATUS' WHEN 50 THEN 'TRANSFER_STATUS' ELSE 'CATEGORY' END AS field_name,
    CASE o_orderkey % 70 WHEN 0 THEN 'true' WHEN 10 THEN 'travel' WHEN 20 THEN 'REFUND' WHEN 30 THEN '  PAYTM*Swiggy '
      WHEN 40 THEN 'NONE' WHEN 50 THEN 'CONFIRMED' ELSE 'no such category' END AS new_value,
    o_orderkey % 3 = 0 AS apply_to_future, 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS merchant_match_key,
    epoch_us(o_orderdate) // 1000 AS updated_at
  FROM orders WHERE o_orderkey % 10 = 0
)"""


def _role(direction: str = "direction", status: str = "transfer_status", excluded: str = "false") -> str:
    return (f"CASE WHEN {excluded} THEN 'EXCLUDED' WHEN {status} <> 'NONE' OR {direction} = 'TRANSFER' THEN 'TRANSFER' "
            f"WHEN {direction} = 'DEBIT' THEN 'GROSS_EXPENSE' WHEN {direction} = 'CREDIT' THEN 'CREDIT' ELSE 'REFUND' END")


PERIOD = f"""{TX}, {CORR},
p AS (
  SELECT *, {_role(excluded="(duplicate_status = 'CONFIRMED' OR tx_id IN (SELECT tx_id FROM corr WHERE field_name = 'NOT_A_TRANSACTION'))")} AS role
  FROM tx WHERE ts_ms BETWEEN {START} AND {END}
), spent AS (SELECT *, strftime(make_timestamp(ts_ms * 1000), '%Y-%m') AS month FROM p WHERE role = 'GROSS_EXPENSE' AND currency = 'INR')"""

_MERCHANT = f"{_list(MERCHANTS)}[CAST(user_id % 6 + 1 AS INT)]"
_AMOUNT = "printf('%.2f', value)"
MSG = f"""
msg AS (
  SELECT event_id AS source_message_id, ['VM-EX-BANK', 'EXBANK', 'JD-DEMOUPI', 'PROMO', 'AX-AMBIG'][CAST(event_id % 5 + 1 AS INT)] AS sender,
    epoch_us(ts) // 1000 AS received_ms,
    CASE WHEN event_id % 50 = 0 THEN 'Rs.100.00 debited for ALPHA and Rs.200.00 debited for BETA'
      WHEN event_id % 50 = 1 THEN 'INR ' || {_AMOUNT} || ' sent to coffee@oksbi via UPI. UPI Ref: 123456789012'
      WHEN event_id % 50 = 2 THEN 'Rs.' || {_AMOUNT} || ' transferred to SAVINGS Ref:NEFT9911'
      WHEN event_id % 50 = 3 THEN 'Congrats! You won a prize, click here'
      WHEN event_id % 50 = 4 THEN 'see you at home tonight'
      WHEN event_id % 50 = 5 THEN '  '
      WHEN event_type = 'purchase' THEN 'Rs.' || {_AMOUNT} || ' debited from A/c XX1234 at ' || {_MERCHANT} || ' on ' || strftime(ts, '%d-%m-%Y') || '. Avl bal Rs.5000'
      WHEN event_type = 'click' THEN 'Rs.' || {_AMOUNT} || ' credited to your A/c XX99'
      WHEN event_type = 'view' THEN 'Rs.' || {_AMOUNT} || ' refunded from ' || {_MERCHANT} || ' to your card ending 1111'
      WHEN event_type = 'signup' THEN 'Your OTP is 482913. Do not share this code.'
      ELSE 'Package delivered. Tracking id 998877' END AS body
  FROM events
)"""


def _known(senders) -> str:
    return "(" + " OR ".join(f"contains(upper(sender), {_q(s.upper())})" for s in senders) + ")"


KNOWN = _known(REGRESSION.senders())
FILTER = f"""{MSG},
filtered AS (
  SELECT *, CASE
    WHEN {_trim('body')} = '' THEN 'BLANK'
    WHEN {_any('body', lexicon.STRONG_REJECT)} THEN 'SECRET_CODE'
    WHEN {_any('body', lexicon.DELIVERY_REJECT)} THEN 'DELIVERY'
    WHEN {_any('body', lexicon.MARKETING_REJECT)} AND NOT {_any('body', lexicon.FINANCIAL_POSITIVE)} THEN 'MARKETING'
    WHEN NOT {KNOWN} AND NOT {_any('body', lexicon.FINANCIAL_POSITIVE)} AND length({_trim('body')}) <= 160
      AND NOT {_find(_trim('body'), lexicon.AMOUNT_HINT)} THEN 'PERSONAL'
    WHEN NOT ({KNOWN} OR {_any('body', lexicon.FINANCIAL_POSITIVE)}) THEN 'NOT_FINANCIAL' END AS reject_reason
  FROM msg
), accepted AS (SELECT source_message_id, sender, received_ms, body FROM filtered WHERE reject_reason IS NULL)"""


def _plain(regex: str) -> str:
    return "(?is)" + re.sub(r"\(\?<[A-Za-z]\w*>", "(", regex)


def _extractions() -> str:
    out, number = [], 0
    for i in REGRESSION.institutions:
        for p in i.patterns:
            number += 1

            def part(g, p=p):
                n = p.index(g)
                return "NULL" if n is None else f"nullif({_trim(f'regexp_extract(body, {_q(_plain(p.regex))}, {n})')}, '')"

            out.append(
                f"SELECT source_message_id, received_ms, {number} AS rule_seq, {_q(p.id)} AS rule_id, {_q(i.name)} AS institution, "
                f"{_known(i.senders)} AS sender_known, {_q(p.direction)} AS direction, {part(p.amount_group)} AS a, {part(p.merchant_group)} AS merchant, "
                f"{part(p.reference_group)} AS reference, {part(p.date_group)} AS d FROM accepted WHERE {_known(i.senders)} OR NOT {KNOWN}")
    return "raw AS (\n" + "\nUNION ALL\n".join(out) + "\n)"


EXTRACT = f"""{FILTER}, {_extractions()},
found AS (
  SELECT source_message_id, rule_seq, rule_id, institution, sender_known, direction,
    CAST(round(CAST(replace(a, ',', '') AS DOUBLE) * 100) AS BIGINT) AS amount_minor, 'INR' AS currency, merchant,
    substr(sha256(reference), 1, 32) AS reference_hash,
    coalesce(epoch_us(try_strptime(d, '%d-%m-%Y')) // 1000, received_ms) AS ts_ms,
    0.5::DOUBLE + CASE WHEN sender_known THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN merchant IS NOT NULL THEN 0.10::DOUBLE ELSE 0 END
      + CASE WHEN reference IS NOT NULL THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN d IS NOT NULL THEN 0.03::DOUBLE ELSE 0 END AS confidence
  FROM raw WHERE a IS NOT NULL
), once AS (
  SELECT * FROM found QUALIFY row_number() OVER (
    PARTITION BY source_message_id, amount_minor, currency, direction, lower(coalesce(merchant, '')), ts_ms ORDER BY confidence DESC, rule_seq) = 1
), best AS (
  SELECT *, count(*) OVER (PARTITION BY source_message_id) AS n_found FROM once
  QUALIFY row_number() OVER (PARTITION BY source_message_id ORDER BY confidence DESC, rule_seq) = 1
), outcome AS (
  SELECT m.source_message_id, m.sender, m.received_ms, m.body,
    b.institution, b.direction, b.amount_minor, b.currency, b.merchant, b.reference_hash, b.ts_ms,
    CASE WHEN n_found IS NULL THEN 'UNSUPPORTED' WHEN n_found > 1 THEN 'AMBIGUOUS' WHEN confidence < 0.6 THEN 'UNSUPPORTED' ELSE 'SUCCESS' END AS parse_status,
    CASE WHEN n_found IS NULL AND {KNOWN} THEN 'UNSUPPORTED_TEMPLATE' WHEN n_found IS NULL THEN 'NO_SENDER_OR_PATTERN_MATCH'
      WHEN n_found = 1 AND confidence < 0.6 THEN 'LOW_CONFIDENCE' END AS parse_reason, rule_id, confidence
  FROM accepted m LEFT JOIN best b USING (source_message_id)
)"""


def _merchant(raw: str) -> str:
    """CTE steps: collapsed, cleaned, key, then aliases."""
    keys = "CASE k " + " ".join(f"WHEN {_q(t)} THEN {_q(k)}" for t, (k, _) in lexicon.MERCHANT_ALIASES.items()) + " ELSE k END"
    names = "CASE k " + " ".join(f"WHEN {_q(t)} THEN {_q(d)}" for t, (_, d) in lexicon.MERCHANT_ALIASES.items()) + " ELSE c3 END"
    return f"""
m1 AS (SELECT *, regexp_replace({_trim(raw)}, '\\s+', ' ', 'g') AS c1 FROM src),
m2 AS (SELECT *, {_trim(f"regexp_replace(regexp_replace(c1, {_q(lexicon.WWW_PREFIX)}, ''), {_q(lexicon.PROCESSOR_PREFIX)}, '')")} AS c2 FROM m1),
m3 AS (SELECT *, CASE WHEN strpos(c2, '@') > 1 THEN {_trim("split_part(c2, '@', 1)")} ELSE c2 END AS c3 FROM m2),
m4 AS (SELECT *, {_trim("regexp_replace(lower(c3), '[^a-z0-9]+', ' ', 'g')")} AS k FROM m3),
m5 AS (SELECT *, CASE WHEN c1 <> '' THEN CASE WHEN k = '' THEN 'unknown' ELSE {keys} END END AS merchant_key,
  CASE WHEN c1 <> '' THEN CASE WHEN k = '' THEN c1 ELSE {names} END END AS merchant_display, nullif(c1, '') AS merchant_raw FROM m4)"""


MERCHANT_SRC = f"""
src AS (SELECT event_id, ['  PAYTM*' || event_type || ' ', 'www.Swiggy', 'AMZN', 'coffee@oksbi', '@@ !!', '  ', 'City   Cafe', 'my account', 'Airtel-' || user_id,
  'GPay/ Uber  '][CAST(event_id % 10 + 1 AS INT)] AS raw, {_list(lexicon.DIRECTIONS)}[CAST(event_id % 5 + 1 AS INT)] AS base_direction,
  CASE WHEN event_id % 3 = 0 THEN {_list(lexicon.DIRECTIONS)}[CAST(event_id % 5 + 1 AS INT)] ELSE 'DEBIT' END AS direction,
  {_list(METHODS)}[CAST(event_id % 7 + 1 AS INT)] AS payment_method FROM events)"""
CLASSIFY = f"""{MERCHANT_SRC}, {_merchant('raw')},
cl AS (SELECT *, concat_ws(' ', merchant_display, merchant_raw, merchant_key) AS words,
  CASE WHEN direction = 'TRANSFER' OR {_find("concat_ws(' ', merchant_display, merchant_raw, merchant_key)", lexicon.OWN_ACCOUNT)} THEN 'SUSPECTED' ELSE 'NONE' END AS transfer_status FROM m5)"""
CATEGORY = ("CASE WHEN direction IN ('CREDIT', 'REFUND', 'REVERSAL') THEN 'income_and_refunds' WHEN direction = 'TRANSFER' THEN 'transfers' "
            "WHEN transfer_status <> 'NONE' THEN 'transfers' WHEN payment_method = 'ATM' THEN 'cash_withdrawal' "
            + " ".join(f"WHEN merchant_key = {_q(k)} THEN {_q(c)}" for k, c in lexicon.EXACT_CATEGORIES.items()) + " "
            + " ".join(f"WHEN {_find('words', p)} THEN {_q(c)}" for p, c in lexicon.KEYWORD_CATEGORIES) + " ELSE 'other' END")

_PAYMENT = f"CASE {' '.join(f'WHEN {_find("body", p)} THEN {_q(n)}' for n, p in lexicon.PAYMENT_METHODS)} ELSE 'UNKNOWN' END"
_ONE_OF = lambda c, xs: f"CASE WHEN upper({_trim(c)}) IN {tuple(xs)} THEN upper({_trim(c)}) END"
_NEWEST = ", ".join(f"max_by(v, t) FILTER (f = '{f}') AS r_{f.lower()}" for f in (
    "MERCHANT", "CATEGORY", "DIRECTION", "TRANSFER_STATUS", "DUPLICATE_STATUS", "NOT_A_TRANSACTION"))
SCAN = EXTRACT.replace("  FROM msg\n), accepted", "  FROM both_msg\n), accepted").replace("),\nfiltered AS", f"""), both_msg AS (
  SELECT * FROM msg UNION ALL SELECT source_message_id + {COPY_ID}, sender, received_ms + {COPY_MS}, body FROM msg WHERE source_message_id % 3 = 0
),
filtered AS""") + f""", cand AS (
  SELECT source_message_id AS seq, sha256(source_message_id || '|' || sender || '|' || received_ms) AS source_hash, institution, direction AS d0,
    amount_minor, currency, merchant AS raw, reference_hash, ts_ms, {_PAYMENT} AS payment_method
  FROM outcome WHERE parse_status = 'SUCCESS' AND length(body) > 0
), src AS (SELECT * FROM cand), {_merchant('raw')},
rule AS (SELECT k AS rk, {_NEWEST} FROM (VALUES {", ".join(f"({_q(f)}, {_q(v)}, {_q(k)}, {t})" for f, v, k, t in SCAN_RULES)}) AS x(f, v, k, t) GROUP BY 1),
c1x AS (
  SELECT m5.* EXCLUDE (merchant_display), coalesce({_ONE_OF('r_direction', lexicon.DIRECTIONS)}, d0) AS direction,
    coalesce(r_merchant, merchant_display) AS merchant_display, {_ONE_OF('r_transfer_status', lexicon.STATUSES)} AS user_transfer, r_category,
    coalesce(lower({_trim('r_not_a_transaction')}) = 'true', false) AS excluded, {_ONE_OF('r_duplicate_status', lexicon.STATUSES)} AS override
  FROM m5 LEFT JOIN rule ON rk = merchant_key
), c2x AS (
  SELECT *, concat_ws(' ', merchant_display, merchant_raw, merchant_key) AS words FROM c1x
), c3x AS (
  SELECT *, coalesce(user_transfer, CASE WHEN direction = 'TRANSFER' OR {_find('words', lexicon.OWN_ACCOUNT)} THEN 'SUSPECTED' ELSE 'NONE' END) AS transfer_status FROM c2x
), c4x AS (
  SELECT *, {_role(excluded='excluded')} AS role,
    CASE WHEN reference_hash IS NOT NULL THEN sha256(concat_ws('|', 'v1', amount_minor, currency, direction, lower(reference_hash)))
      ELSE sha256(concat_ws('|', 'v1', lower(institution), amount_minor, currency, direction, coalesce(merchant_key, ''), '', ts_ms // 300000 * 300000)) END AS fingerprint
  FROM c3x
), kept AS (SELECT * FROM c4x QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY seq) = 1
), near AS (
  SELECT a.seq, b.seq AS near_seq FROM kept a JOIN kept b
    ON a.amount_minor = b.amount_minor AND a.currency = b.currency AND a.direction = b.direction AND a.merchant_key IS NOT DISTINCT FROM b.merchant_key
    AND b.seq < a.seq AND abs(a.ts_ms - b.ts_ms) <= 1800000 AND (a.reference_hash IS NULL OR b.reference_hash IS NULL OR a.reference_hash = b.reference_hash)
  QUALIFY row_number() OVER (PARTITION BY a.seq ORDER BY abs(a.ts_ms - b.ts_ms), b.seq) = 1
), scanned AS (
  SELECT kept.*, near_seq, CASE WHEN near_seq IS NULL OR override = 'NONE' THEN 'NONE' ELSE coalesce(override, 'SUSPECTED') END AS duplicate_status
  FROM kept LEFT JOIN near USING (seq)
)"""

TXE = """
te AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, CAST((user_id % 5 + 2) * 500 AS BIGINT) AS amount_minor, 'INR' AS currency, 'DEBIT' AS direction,
    user_id || ' ' || event_type AS merchant_key, CASE WHEN event_id % 9 = 0 THEN 'r' || (event_id // 18) END AS reference_hash FROM events
), fp AS (
  SELECT *, CASE WHEN reference_hash IS NOT NULL THEN sha256('v1|' || amount_minor || '|INR|DEBIT|' || lower(reference_hash))
    ELSE sha256('v1|example bank|' || amount_minor || '|INR|DEBIT|' || merchant_key || '||' || (ts_ms // 300000 * 300000)) END AS fingerprint FROM te
), kept AS (SELECT * FROM fp QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY seq) = 1
), near AS (
  SELECT a.seq, b.seq AS near_seq, abs(a.ts_ms - b.ts_ms) AS distance_ms FROM kept a JOIN kept b
    ON a.amount_minor = b.amount_minor AND a.merchant_key = b.merchant_key AND b.seq < a.seq AND abs(a.ts_ms - b.ts_ms) <= 1800000
    AND (a.reference_hash IS NULL OR b.reference_hash IS NULL OR a.reference_hash = b.reference_hash)
  QUALIFY row_number() OVER (PARTITION BY a.seq ORDER BY abs(a.ts_ms - b.ts_ms), b.seq) = 1
)"""

PAY = f"""
pay AS (
  SELECT event_id AS tx_id, user_id || ' ' || event_type || ' ' || (event_id % 3) AS merchant_key, epoch_us(ts) // 1000 AS ts_ms,
    CAST((user_id % 5 + 2) * 500 AS BIGINT) AS amount_minor
  FROM events
  UNION ALL SELECT o_orderkey, 'c' || o_custkey, epoch_us(o_orderdate) // 1000, 9900 + o_orderkey % 3 * 100 FROM orders
), iv AS (SELECT *, (ts_ms - lag(ts_ms) OVER (PARTITION BY merchant_key ORDER BY ts_ms, tx_id)) / 86400000::DOUBLE AS interval_days FROM pay
), g AS (
  SELECT merchant_key, count(*) AS n, min(amount_minor) AS lo, max(amount_minor) AS hi, CAST(floor(median(amount_minor)) AS BIGINT) AS amount,
    median(interval_days) AS median_days, min(interval_days) AS i_lo, max(interval_days) AS i_hi, max(ts_ms) AS last_ms, list_sort(list(tx_id)) AS ids
  FROM iv GROUP BY 1
), f AS (
  SELECT *, CASE {" ".join(f"WHEN abs(median_days - {d}::DOUBLE) <= {s}::DOUBLE THEN {_q(n)}" for n, d, s in FREQUENCIES)} END AS frequency,
    CASE {" ".join(f"WHEN abs(median_days - {d}::DOUBLE) <= {s}::DOUBLE THEN {d}::DOUBLE" for n, d, s in FREQUENCIES)} END AS target,
    greatest(hi - amount::DOUBLE, amount::DOUBLE - lo) / amount::DOUBLE AS spread FROM g WHERE n >= 2 AND amount > 0
), sub AS (
  SELECT merchant_key, frequency, amount AS estimated_amount_minor, 'INR' AS currency, last_ms AS last_payment_ms, last_ms + CAST(target * 86400000 AS BIGINT) AS estimated_next_ms,
    least(1.0::DOUBLE, CASE WHEN n >= 4 THEN 0.35::DOUBLE WHEN n = 3 THEN 0.25::DOUBLE ELSE 0.15::DOUBLE END + 0.35::DOUBLE * (1.0::DOUBLE - least(spread, 1.0::DOUBLE))
      + 0.30::DOUBLE * (1.0::DOUBLE - least(greatest(abs(i_lo - target), abs(i_hi - target)) / target, 1.0::DOUBLE))) AS confidence,
    CASE WHEN {NOW} > last_ms + 2 * CAST(target * 86400000 AS BIGINT) THEN 'POSSIBLY_INACTIVE' ELSE 'SUSPECTED' END AS status, len(ids) AS n_evidence, ids AS evidence_ids
  FROM f WHERE frequency IS NOT NULL AND spread <= 0.15::DOUBLE
), old AS (
  SELECT merchant_key, ['DISMISSED', 'CONFIRMED', 'SUSPECTED', 'POSSIBLY_INACTIVE'][CAST(len(evidence_ids) % 4 + 1 AS INT)] AS was,
    CASE WHEN evidence_ids[1] % 2 = 0 THEN evidence_ids ELSE evidence_ids[2:] END AS old_ids FROM sub WHERE evidence_ids[1] % 5 <> 0
)"""

SCANS = f"""
scans AS (SELECT event_id AS scan_id, {_list(lexicon.SCAN_STATUSES)}[CAST(event_id % 6 + 1 AS INT)] AS status, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) // 1000 END AS completed_at,
  epoch_us(ts) // 1000 AS updated_at, event_id % 40 AS processed, event_id % 30 AS accepted FROM events)"""

_UUID = "'00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0')"
_IS_UUID = "'^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$'"


def _unknown(j: str, allowed: str) -> str:
    return f"list_sort(list_filter(json_keys({j}), lambda x: x NOT IN {allowed}))[1]"


def _string(j: str, name: str) -> str:
    return f"CASE WHEN json_type({j}, '$.{name}') = 'VARCHAR' THEN json_extract_string({j}, '$.{name}') END"


_EVENT_KEYS = "('eventId', 'occurredAt', 'eventType', 'durationBucket', 'countBucket', 'errorCode')"
_BANNED = f"list_filter(regexp_extract_all(body, '\"([^\"]+)\"\\s*:', 1), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g') IN {lexicon.PROHIBITED_KEYS})[1]"
REQUESTS = f"""
made AS (
  SELECT event_id AS n, '{{"eventId": "' || CASE WHEN event_id % 13 = 1 THEN 'x' ELSE {_UUID} END || '", "occurredAt": ' || CASE WHEN event_id % 13 = 2 THEN '" "' ELSE '"2024"' END
    || ', "eventType": "' || {_list([*lexicon.TELEMETRY_EVENT_TYPES, "other"])}[CAST(event_id % 8 + 1 AS INT)] || '"'
    || CASE event_id % 13 WHEN 3 THEN ', "durationBucket": "LONG"' WHEN 4 THEN ', "countBucket": null' WHEN 5 THEN ', "errorCode": "ab"' WHEN 6 THEN ', "zeta": 1, "eta": 2'
      WHEN 7 THEN ', "errorCode": "E_42"' ELSE '' END || '}}' AS event, {_UUID} AS u FROM events
), bodies AS (
  SELECT n, '{{"schemaVersion": ' || CASE n % 19 WHEN 1 THEN '"1"' WHEN 2 THEN '2' ELSE '1' END || ', "batchId": "' || CASE WHEN n % 19 = 3 THEN 'none' ELSE u END || '", "events": '
    || CASE n % 17 WHEN 1 THEN '[]' WHEN 2 THEN '7' WHEN 3 THEN '[' || event || ', 3]' ELSE '[' || event || ']' END
    || CASE n % 19 WHEN 4 THEN ', "other": {{"a": [{{"SMS": 1}}]}}' WHEN 5 THEN ', "more": 1' ELSE '' END || CASE WHEN n % 19 = 6 THEN '' ELSE '}}' END AS body FROM made
), v AS (SELECT *, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN body END AS j FROM bodies
), ev AS (
  SELECT n, i - 1 AS i, e FROM (SELECT n, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM (
    SELECT n, CAST(json_extract(j, '$.events[*]') AS JSON[]) AS es FROM v WHERE ok AND json_type(j, '$.events') = 'ARRAY'))
), bad AS (
  SELECT n, i, CASE WHEN json_type(e) <> 'OBJECT' THEN 'events[' || i || ']' WHEN {_unknown('e', _EVENT_KEYS)} IS NOT NULL THEN 'events[' || i || '].' || {_unknown('e', _EVENT_KEYS)}
      WHEN NOT coalesce(regexp_matches({_string('e', 'eventId')}, {_IS_UUID}), false) THEN 'events[' || i || '].eventId'
      WHEN coalesce(trim({_string('e', 'occurredAt')}), '') = '' THEN 'events[' || i || '].occurredAt'
      WHEN NOT coalesce({_string('e', 'eventType')} IN {lexicon.TELEMETRY_EVENT_TYPES}, false) THEN 'events[' || i || '].eventType'
      WHEN list_contains(json_keys(e), 'durationBucket') AND NOT coalesce({_string('e', 'durationBucket')} IN {lexicon.DURATION_BUCKETS}, false) THEN 'events[' || i || '].durationBucket'
      WHEN list_contains(json_keys(e), 'countBucket') AND NOT coalesce({_string('e', 'countBucket')} IN {lexicon.COUNT_BUCKETS}, false) THEN 'events[' || i || '].countBucket'
      WHEN list_contains(json_keys(e), 'errorCode') AND NOT coalesce(regexp_matches({_string('e', 'errorCode')}, '^[A-Z0-9_]{{3,64}}$'), false) THEN 'events[' || i || '].errorCode' END AS f,
    CASE WHEN json_type(e) <> 'OBJECT' THEN 'INVALID' WHEN {_unknown('e', _EVENT_KEYS)} IS NOT NULL THEN 'UNKNOWN_PROPERTY' END AS c FROM ev
), first_bad AS (
  SELECT n, min_by(f, i) AS f, min_by(coalesce(c, CASE split_part(f, '.', 2) WHEN 'eventId' THEN 'INVALID_FORMAT' WHEN 'occurredAt' THEN 'MISSING' WHEN 'errorCode' THEN 'INVALID_FORMAT' ELSE 'UNSUPPORTED_VALUE' END), i) AS c
  FROM bad WHERE f IS NOT NULL GROUP BY 1
), judged AS (
  SELECT v.n, body, CASE WHEN ok AND {_BANNED} IS NOT NULL THEN 'PROHIBITED_FIELD' WHEN NOT ok OR NOT fine THEN 'VALIDATION_ERROR' END AS code, CASE WHEN NOT ok THEN NULL
      WHEN {_BANNED} IS NOT NULL THEN 'other.a.[0].' || {_BANNED} ELSE field END AS field,
    CASE WHEN NOT ok THEN 'INVALID' WHEN {_BANNED} IS NOT NULL THEN 'PROHIBITED_FIELD' ELSE field_code END AS field_code
  FROM v LEFT JOIN (
    SELECT v.n, field IS NULL AS fine, field, CASE WHEN field = u THEN 'UNKNOWN_PROPERTY' WHEN field = 'schemaVersion' THEN 'UNSUPPORTED_VALUE' WHEN field = 'batchId' THEN 'INVALID_FORMAT'
      WHEN field = 'events' THEN 'INVALID' ELSE first_bad.c END AS field_code
    FROM (SELECT n, j, {_unknown('j', "('schemaVersion', 'batchId', 'events')")} AS u, coalesce({_unknown('j', "('schemaVersion', 'batchId', 'events')")},
        CASE WHEN json_type(j, '$.schemaVersion') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR json_extract_string(j, '$.schemaVersion') <> '1' THEN 'schemaVersion'
          WHEN NOT regexp_matches(json_extract_string(j, '$.batchId'), {_IS_UUID}) THEN 'batchId'
          WHEN json_type(j, '$.events') <> 'ARRAY' OR json_array_length(j, '$.events') NOT BETWEEN 1 AND 50 THEN 'events' END, f) AS field
      FROM v LEFT JOIN first_bad USING (n) WHERE ok) v LEFT JOIN first_bad USING (n)) x USING (n)
)"""
_SUPPORT_KEYS = "('schemaVersion', 'submissionId', 'consentedAt', 'previewConfirmed', 'redactionVersion', 'reason', 'redactedTemplate')"
SUPPORT = f"""
bodies AS (
  SELECT event_id AS n, '{{"schemaVersion": 1, "submissionId": "' || CASE WHEN event_id % 11 = 1 THEN 'x' ELSE {_UUID} END || '", "consentedAt": ' || CASE WHEN event_id % 11 = 2 THEN '5' ELSE '"2024"' END
    || ', "previewConfirmed": ' || CASE WHEN event_id % 11 = 3 THEN '"true"' ELSE 'true' END || ', "redactionVersion": "' || CASE WHEN event_id % 11 = 4 THEN repeat('r', 33) ELSE 'r1' END
    || '", "reason": "' || {_list([*lexicon.SUPPORT_REASONS, "why"])}[CAST(event_id % 5 + 1 AS INT)] || '", "redactedTemplate": "' || CASE WHEN event_id % 11 = 5 THEN '' ELSE '<amt>' END
    || CASE event_id % 11 WHEN 6 THEN '", "x": 1, "body": 2}}' WHEN 7 THEN '", "x": 1}}' ELSE '"}}' END AS body, CASE WHEN event_id % 7 <> 0 THEN {_UUID} END AS k FROM events
), f AS (
  SELECT n, CASE WHEN {_BANNED} IS NOT NULL THEN {_BANNED} WHEN k IS NULL THEN 'Idempotency-Key' WHEN {_unknown('body', _SUPPORT_KEYS)} IS NOT NULL THEN {_unknown('body', _SUPPORT_KEYS)}
    WHEN NOT regexp_matches({_string('body', 'submissionId')}, {_IS_UUID}) THEN 'submissionId' WHEN json_type(body, '$.previewConfirmed') <> 'BOOLEAN' THEN 'previewConfirmed'
    WHEN coalesce({_string('body', 'consentedAt')}, '') = '' THEN 'consentedAt' WHEN length({_string('body', 'redactionVersion')}) NOT BETWEEN 1 AND 32 THEN 'redactionVersion'
    WHEN {_string('body', 'reason')} NOT IN {lexicon.SUPPORT_REASONS} THEN 'reason' WHEN length({_string('body', 'redactedTemplate')}) NOT BETWEEN 1 AND 4096 THEN 'redactedTemplate' END AS field FROM bodies
), judged AS (
  SELECT n, field, CASE WHEN field = 'body' THEN 'PROHIBITED_FIELD' WHEN field IS NOT NULL THEN 'VALIDATION_ERROR' END AS code,
    CASE WHEN field = 'body' THEN 'PROHIBITED_FIELD' WHEN field = 'x' THEN 'UNKNOWN_PROPERTY' WHEN field IN ('Idempotency-Key', 'submissionId') THEN 'INVALID_FORMAT' WHEN field IN ('previewConfirmed', 'reason') THEN 'UNSUPPORTED_VALUE'
      WHEN field = 'consentedAt' THEN 'MISSING' WHEN field IS NOT NULL THEN 'INVALID' END AS field_code FROM f
)"""

W = "WITH "
#: Every event twice, an hour apart; some ids come back under another type.
TWICE = """WITH e AS (SELECT event_id, ts, event_type, 'v' || (user_id % 3) AS app_version FROM events
        UNION ALL SELECT event_id, ts + INTERVAL 1 HOUR, CASE WHEN event_id % 5 = 0 THEN 'again' ELSE event_type END, 'v' || (user_id % 3) FROM events)"""
FIRST = "f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1)"
METADATA = """m AS (SELECT CAST(event_id AS VARCHAR) AS parser_version, ['ACTIVE', 'INSTALLED', 'ROLLBACK', 'INVALID'][CAST(event_id % 4 + 1 AS INT)] AS status,
        CASE WHEN event_id % 4 = 0 THEN event_id END AS activated_at FROM events)"""
#: How a scan can end, in the order in which the query deals them to the events.
ENDS = ("COMPLETED", "CANCELLED", "PERMISSION_REVOKED", "PROVIDER_ERROR", "COROUTINE_CANCELLED", "PERMISSION_DENIED", "PARSER_UNAVAILABLE",
        "SCAN_ALREADY_ACTIVE", "NOT_RESUMABLE", "UNEXPECTED")
ACCEPTED = """SELECT e.event_type, e.n AS received, coalesce(f.n, 0) AS accepted, e.n - coalesce(f.n, 0) AS duplicates
      FROM (SELECT event_type, count(*) AS n FROM e GROUP BY 1) e LEFT JOIN (SELECT event_type, count(*) AS n FROM first GROUP BY 1) f USING (event_type)"""

ORACLES: dict[str, str] = {
    "dash_scalars": f"""{W}{PERIOD}, s AS (SELECT
      CAST(coalesce(sum(amount_minor) FILTER (role = 'GROSS_EXPENSE' AND currency = 'INR'), 0) AS BIGINT) AS gross_minor,
      CAST(coalesce(sum(amount_minor) FILTER (role = 'CREDIT' AND currency = 'INR'), 0) AS BIGINT) AS credits_minor,
      CAST(coalesce(sum(amount_minor) FILTER (role = 'REFUND' AND currency = 'INR'), 0) AS BIGINT) AS refunds_minor, count(*) AS transaction_count FROM p)
      SELECT *, greatest(gross_minor - refunds_minor, 0) AS net_minor FROM s""",
    "dash_by_category": f"{W}{PERIOD} SELECT category_id, CAST(sum(amount_minor) AS BIGINT) AS total_minor, count(*) AS n FROM spent GROUP BY 1",
    "dash_by_month": f"{W}{PERIOD} SELECT month, CAST(sum(amount_minor) AS BIGINT) AS total_minor, count(*) AS n FROM spent GROUP BY 1",
    "dash_by_merchant": f"""{W}{PERIOD} SELECT merchant_key, max_by(merchant_display, ts_ms) AS merchant_display, CAST(sum(amount_minor) AS BIGINT) AS total_minor,
      count(*) AS n FROM spent WHERE merchant_key IS NOT NULL GROUP BY 1""",
    "dash_grouping_sets": f"""{W}{PERIOD}
      SELECT 'total' AS facet, NULL AS member, CAST(sum(amount_minor) AS BIGINT) AS total_minor, count(*) AS n FROM spent
      UNION ALL SELECT 'category', category_id, CAST(sum(amount_minor) AS BIGINT), count(*) FROM spent GROUP BY 2
      UNION ALL SELECT 'month', month, CAST(sum(amount_minor) AS BIGINT), count(*) FROM spent GROUP BY 2
      UNION ALL SELECT 'merchant', merchant_key, CAST(sum(amount_minor) AS BIGINT), count(*) FROM spent WHERE merchant_key IS NOT NULL GROUP BY 2""",
    "dash_recent_topk": f"{W}{PERIOD} SELECT tx_id, ts_ms, amount_minor, role FROM p ORDER BY ts_ms DESC, tx_id LIMIT 10",
    "dash_exclude_suspected": f"""{W}{TX} SELECT {_role(excluded="duplicate_status <> 'NONE'")} AS role, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS total_minor FROM tx GROUP BY 1""",
    "tx_query_filters": f"""{W}{TX} SELECT tx_id, ts_ms, amount_minor, direction, payment_method FROM tx
      WHERE direction = 'DEBIT' AND payment_method = 'CARD' AND ts_ms BETWEEN {START} AND {END} ORDER BY ts_ms DESC, tx_id LIMIT 100""",
    "tx_search_like": f"{W}{TX} SELECT tx_id, merchant_display FROM tx WHERE merchant_display ILIKE '%#0000_01%' OR merchant_key ILIKE '%#0000_01%'",
    "tx_merchant_drill": f"{W}{TX} SELECT tx_id, ts_ms, amount_minor FROM tx WHERE merchant_key = 'customer#000000010' AND ts_ms >= {START}",
    "tx_point_lookups": f"{W}{TX} SELECT tx_id, amount_minor, currency FROM tx WHERE tx_id IN (SELECT event_id * 7 FROM events)",
    "msg_keyset_page": f"{W}{MSG} SELECT source_message_id, sender FROM msg WHERE received_ms BETWEEN 1704100000000 AND 1706000000000 AND source_message_id > 100 ORDER BY 1 LIMIT 100",
    "msg_page_state": f"""{W}{MSG}, page AS (SELECT * FROM msg WHERE received_ms BETWEEN 1704100000000 AND 1706000000000 AND source_message_id > 100 ORDER BY 1 LIMIT 100)
      SELECT max(source_message_id) AS next_id, count(*) AS n_rows, count(*) < 100 AS exhausted FROM page""",
    "msg_malformed": f"""{W}{MSG} SELECT source_message_id, sender, received_ms FROM msg
      WHERE source_message_id % 4 <> 0 AND source_message_id % 6 <> 0 AND source_message_id % 7 <> 0 AND source_message_id % 35 <> 1""",
    "msg_page_malformed": f"""{W}{MSG}, page AS (SELECT source_message_id AS n FROM msg WHERE source_message_id % 6 <> 0 AND source_message_id > 100 ORDER BY 1 LIMIT 101),
      page2 AS (SELECT source_message_id AS n FROM (SELECT source_message_id, CASE WHEN source_message_id % 6 = 0 THEN -1 ELSE received_ms END AS r FROM msg)
        WHERE r BETWEEN -1 AND 1800000000000 AND source_message_id > 100 ORDER BY 1 LIMIT 101)
      SELECT max(n) FILTER (n % 4 <> 0 AND n % 6 <> 0 AND n % 7 <> 0 AND n % 35 <> 1) AS next_id, count(*) AS n_rows, count(*) < 101 AS exhausted FROM page2""",
    "msg_filter_malformed": f"""{W}{FILTER} SELECT source_message_id, CASE WHEN source_message_id % 35 = 1 AND source_message_id % 7 <> 0 THEN 'MALFORMED'
      WHEN source_message_id % 7 = 0 THEN 'BLANK' ELSE reject_reason END AS reject_reason FROM raw_filtered""".replace("  FROM msg\n), accepted AS", """  FROM (
        SELECT source_message_id, CASE WHEN source_message_id % 4 = 0 THEN '  ' ELSE sender END AS sender, received_ms, body FROM msg)
      ), accepted AS""").replace("filtered AS (", "raw_filtered AS (", 1).replace("FROM filtered WHERE", "FROM raw_filtered WHERE"),
    "msg_filter": f"{W}{FILTER} SELECT source_message_id, reject_reason FROM filtered",
    "msg_sender_match": f"{W}{MSG} SELECT source_message_id, {KNOWN} AS sender_known FROM msg",
    "msg_extract": f"{W}{EXTRACT} SELECT source_message_id, rule_id, institution, direction, amount_minor, currency, merchant, reference_hash, ts_ms FROM found",
    "msg_confidence": f"{W}{EXTRACT} SELECT source_message_id, rule_id, round(confidence, 6) AS confidence FROM found",
    "msg_outcome": f"{W}{EXTRACT} SELECT source_message_id, parse_status, parse_reason, CASE WHEN parse_status = 'SUCCESS' THEN rule_id END AS rule_id FROM outcome",
    "msg_payment_method": f"{W}{MSG} SELECT source_message_id, CASE {' '.join(f'WHEN {_find("body", p)} THEN {_q(n)}' for n, p in lexicon.PAYMENT_METHODS)} ELSE 'UNKNOWN' END AS payment_method FROM msg",
    "msg_source_hash": f"{W}{MSG} SELECT source_message_id, sha256(source_message_id || '|' || sender || '|' || received_ms) AS source_hash FROM msg",
    "scan_counters": f"""{W}{EXTRACT}, fine AS (SELECT source_message_id AS n FROM msg
        WHERE source_message_id % 4 <> 0 AND source_message_id % 6 <> 0 AND source_message_id % 7 <> 0 AND source_message_id % 35 <> 1)
      SELECT (SELECT count(*) FROM msg) AS processed, (SELECT count(*) FROM msg) - (SELECT count(*) FROM fine) AS malformed,
        (SELECT count(*) FROM accepted JOIN fine ON n = source_message_id) AS accepted,
        (SELECT count(*) FROM outcome JOIN fine ON n = source_message_id WHERE parse_status = 'SUCCESS') AS parsed""",
    **dict.fromkeys(("scan_pipeline", "scan_two_batches"), f"""{W}{SCAN} SELECT seq, source_hash, fingerprint, amount_minor, direction, merchant_key, merchant_display,
      CASE WHEN r_category IN (SELECT category_id FROM (VALUES {", ".join(f"({_q(k)})" for k, _ in lexicon.CATEGORIES)}) AS v(category_id)) THEN r_category ELSE {CATEGORY} END AS category_id,
      transfer_status, role, duplicate_status, CASE WHEN duplicate_status <> 'NONE' THEN near_seq END AS possible_duplicate_of FROM scanned"""),
    "tx_violations": f"""{W}{TX} SELECT tx_id, CASE WHEN tx_id % 11 = 0 AND tx_id > 0 THEN 'AMOUNT' WHEN (merchant_key IS NULL) <> (merchant_display IS NULL) THEN 'MERCHANT'
      WHEN duplicate_status = 'NONE' AND tx_id % 5 = 0 THEN 'DUPLICATE_POINTER' WHEN tx_id % 9 = 0 THEN 'CONFIDENCE' WHEN tx_id % 4 = 0 THEN 'TIMES' END AS violation FROM tx""",
    "display_format": rf"""{W}{TX}, m AS (SELECT tx_id, ts_ms, currency, CAST(CAST(amount_minor AS HUGEINT) * CAST(pow(10, tx_id % 6) AS HUGEINT) AS BIGINT) AS a FROM tx),
      p AS (SELECT *, CAST(a // 100 AS VARCHAR) AS w, lpad(CAST(a % 100 AS VARCHAR), 2, '0') AS c FROM m)
      SELECT tx_id, CASE WHEN currency = 'INR' THEN '₹' || CASE WHEN length(w) > 3 THEN ltrim(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(\d\d)', '\1,', 'g')), ',') || ',' || right(w, 3)
          ELSE w END || '.' || c ELSE currency || ' ' || w || '.' || c END AS money, strftime(make_timestamp(ts_ms * 1000), '%d %b %Y') AS day,
        CASE WHEN tx_id % 3 <> 0 THEN strftime(make_timestamp(ts_ms * 1000), '%d %b %Y, %H:%M') ELSE '—' END AS at, trunc((tx_id % 101) / 100 * 100)::INT || '%' AS share FROM p""",
    "amount_parse": """WITH s AS (SELECT event_id, [' 1,234.5', '12', '7.05 ', '1.234', 'abc', '', '99999999999999999999', '1 000.10'][CAST(event_id % 8 + 1 AS INT)] || CASE WHEN event_id % 8 = 1 THEN CAST(event_id AS VARCHAR) ELSE '' END AS raw FROM events),
      c AS (SELECT event_id, regexp_replace(raw, '[, ]', '', 'g') AS v FROM s)
      SELECT event_id, CASE WHEN regexp_matches(v, '^\\d+(\\.\\d{1,2})?$') THEN TRY_CAST(split_part(v, '.', 1) AS BIGINT) * 100 + CAST(rpad(split_part(v, '.', 2), 2, '0') AS BIGINT) END AS amount_minor FROM c""",
    "currency_parse": """WITH s AS (SELECT event_id, [' rs. ', '₹', 'Rupees', 'inr5', 'usd', 'U.S.D', '12', ''][CAST(event_id % 8 + 1 AS INT)] AS raw FROM events),
      c AS (SELECT event_id, replace(replace(upper(trim(raw)), '₹', 'INR'), '.', '') AS v FROM s)
      SELECT event_id, CASE WHEN v IN ('RS', 'RUPEE', 'RUPEES') OR starts_with(v, 'INR') THEN 'INR' WHEN regexp_matches(v, '^[A-Z]{3}$') THEN v END AS currency FROM c""",
    "date_parse": r"""WITH s AS (SELECT event_id, [strftime(ts, '%d-%m-%Y'), strftime(ts, '%d/%m/%Y %H:%M'), strftime(ts, '%d/%m/%y'), strftime(ts, '%Y-%m-%dT%H:%M:%S'),
        '31-02-2026', '32-01-2026', '2026-02-31', strftime(ts, '%Y-%m-%d')][CAST(event_id % 8 + 1 AS INT)] AS raw FROM events),
      p AS (SELECT event_id, raw, [CAST(x AS INT) FOR x IN regexp_extract_all(raw, '\d+')] AS t FROM s),
      q AS (SELECT event_id, raw, CASE WHEN length(split_part(raw, '-', 1)) = 4 THEN t[1] WHEN t[3] < 100 THEN 2000 + t[3] ELSE t[3] END AS y, t[2] AS m,
        CASE WHEN length(split_part(raw, '-', 1)) = 4 THEN t[3] ELSE t[1] END AS d, coalesce(t[4], 0) * 3600 + coalesce(t[5], 0) * 60 + coalesce(t[6], 0) AS secs FROM p),
      r AS (SELECT *, CASE WHEN d <= 31 THEN day(last_day(make_date(y, m, 1))) END AS last FROM q)
      SELECT event_id, CASE WHEN d <= 31 AND NOT (length(raw) = 10 AND length(split_part(raw, '-', 1)) = 4 AND d > last)
        THEN (epoch_us(make_date(y, m, least(d, last))::TIMESTAMP) // 1000 + secs * 1000)::BIGINT END AS millis FROM r""",
    "merchant_normalize": f"{W}{CLASSIFY} SELECT event_id, merchant_key, merchant_display, merchant_raw FROM cl",
    "semantics_role": f"""{W}{CLASSIFY}, r AS (SELECT event_id, transfer_status, {_role()} AS role FROM cl)
      SELECT *, role = 'GROSS_EXPENSE' AS in_gross_expense, role = 'REFUND' AS in_refunds, role = 'CREDIT' AS in_credits, role = 'TRANSFER' AS is_transfer,
      role IN ('GROSS_EXPENSE', 'REFUND') AS in_net_spending FROM r""",
    "categorise": f"{W}{CLASSIFY} SELECT event_id, {CATEGORY} AS category_id FROM cl",
    "merchant_resolve": f"""{W}{CLASSIFY}, latest AS (SELECT merchant_key AS lk, max_by(merchant_display || ' (' || event_id || ')', event_id) AS stored FROM cl WHERE event_id % 2 = 0 AND merchant_key IS NOT NULL GROUP BY 1)
      SELECT event_id, coalesce(stored, merchant_display) AS display FROM cl LEFT JOIN latest ON latest.lk = merchant_key WHERE merchant_key IS NOT NULL""",
    "future_rule_overlay": f"""{W}{TX}, {CORR}, r AS (SELECT merchant_match_key,
      max_by(new_value, updated_at * 1000000 + correction_id) FILTER (field_name = 'DIRECTION') AS rule_direction,
      max_by(new_value, updated_at * 1000000 + correction_id) FILTER (field_name = 'CATEGORY') AS rule_category,
      max_by(new_value, updated_at * 1000000 + correction_id) FILTER (field_name = 'MERCHANT') AS rule_merchant FROM corr WHERE apply_to_future GROUP BY 1)
      SELECT tx_id, coalesce(rule_direction, direction) AS direction, rule_category, coalesce(rule_merchant, merchant_display) AS merchant_display
      FROM tx JOIN r ON merchant_key = merchant_match_key""",
    "fingerprint": f"{W}{TXE} SELECT seq, fingerprint FROM fp",
    "dedupe_exact": f"{W}{TXE} SELECT seq, ts_ms FROM kept",
    "dedupe_rank": f"{W}{TXE} SELECT seq, row_number() OVER (PARTITION BY fingerprint ORDER BY seq) AS place FROM fp",
    "dedupe_near": f"{W}{TXE} SELECT * FROM near",
    "dedupe_decision": f"""{W}{TXE} SELECT fp.seq, CASE WHEN fp.seq <> k.seq THEN 'REUSED' WHEN near_seq IS NOT NULL THEN 'SUSPECTED' ELSE 'UNIQUE' END AS decision,
      CASE WHEN fp.seq = k.seq THEN CASE WHEN near_seq IS NOT NULL THEN 'SUSPECTED' ELSE 'NONE' END END AS duplicate_status,
      CASE WHEN fp.seq <> k.seq THEN k.seq ELSE near_seq END AS points_to FROM fp JOIN kept k USING (fingerprint) LEFT JOIN near ON near.seq = fp.seq""",
    "dedupe_decision_stored": f"""{W}{TXE}, old AS (SELECT * FROM fp WHERE seq % 3 = 0), inc AS (SELECT * FROM fp WHERE seq % 3 <> 0),
      hit AS (SELECT inc.*, o.s AS old_seq, CASE seq % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'CONFIRMED' END AS override
        FROM inc LEFT JOIN (SELECT fingerprint, min(seq) AS s FROM old GROUP BY 1) o USING (fingerprint)),
      new AS (SELECT * FROM hit WHERE old_seq IS NULL QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY seq) = 1),
      pool AS (SELECT seq, ts_ms, amount_minor, merchant_key, reference_hash, true AS st FROM old UNION ALL SELECT seq, ts_ms, amount_minor, merchant_key, reference_hash, false FROM new),
      nr AS (SELECT a.seq, b.seq AS near_seq FROM new a JOIN pool b ON a.amount_minor = b.amount_minor AND a.merchant_key = b.merchant_key AND (b.st OR b.seq < a.seq)
        AND abs(a.ts_ms - b.ts_ms) <= 1800000 AND (a.reference_hash IS NULL OR b.reference_hash IS NULL OR a.reference_hash = b.reference_hash)
        QUALIFY row_number() OVER (PARTITION BY a.seq ORDER BY abs(a.ts_ms - b.ts_ms), b.seq) = 1),
      j AS (SELECT hit.seq, coalesce(hit.old_seq, CASE WHEN hit.seq <> new.seq THEN new.seq END) AS target,
          CASE WHEN near_seq IS NULL OR hit.override = 'NONE' THEN 'NONE' ELSE coalesce(hit.override, 'SUSPECTED') END AS status, near_seq
        FROM hit LEFT JOIN new ON new.fingerprint = hit.fingerprint LEFT JOIN nr ON nr.seq = hit.seq)
      SELECT seq, CASE WHEN target IS NOT NULL THEN 'REUSED' WHEN status <> 'NONE' THEN 'SUSPECTED' ELSE 'UNIQUE' END AS decision,
        CASE WHEN target IS NULL THEN status END AS duplicate_status, coalesce(target, CASE WHEN status <> 'NONE' THEN near_seq END) AS points_to FROM j""",
    "dedupe_unstored": f"""{W}{TXE} SELECT seq FROM fp WHERE seq % 3 <> 0 AND fingerprint NOT IN (SELECT fingerprint FROM fp WHERE seq % 3 = 0)""",
    "recur_intervals": f"{W}{PAY} SELECT tx_id, merchant_key, round(interval_days, 9) AS interval_days FROM iv",
    "recur_detect": f"{W}{PAY} SELECT merchant_key, frequency, estimated_amount_minor, currency, last_payment_ms, estimated_next_ms, round(confidence, 6) AS confidence, status, n_evidence FROM sub",
    "recur_eligible": f"""{W}{TX}, {CORR} SELECT tx_id, merchant_key, amount_minor FROM tx WHERE direction = 'DEBIT' AND transfer_status = 'NONE' AND merchant_key IS NOT NULL
      AND duplicate_status <> 'CONFIRMED' AND tx_id NOT IN (SELECT tx_id FROM corr WHERE field_name = 'NOT_A_TRANSACTION')""",
    "recur_merge": f"""{W}{PAY}, m AS (SELECT s.*, was, old_ids, coalesce(was = 'DISMISSED' AND len(old_ids) = len(evidence_ids), false) AS stays FROM sub s LEFT JOIN old USING (merchant_key))
      SELECT CASE WHEN was IS NOT NULL THEN s.merchant_key END AS old_id, CASE WHEN stays THEN 1 ELSE estimated_amount_minor END AS estimated_amount_minor,
      CASE WHEN was IS NULL THEN {NOW} ELSE 7 END AS created_at, CASE WHEN stays THEN 1 ELSE {NOW} END AS updated_at, n_evidence, s.merchant_key, CASE WHEN was IS NULL THEN status WHEN was = 'DISMISSED' AND len(old_ids) = len(evidence_ids) THEN 'DISMISSED'
      WHEN was = 'DISMISSED' THEN 'SUSPECTED' WHEN was = 'CONFIRMED' THEN 'CONFIRMED' ELSE status END AS status, was IS NULL AS is_new FROM m s""",
    "sub_corrections": f"""{W}{PAY}, c AS (SELECT merchant_key, max_by(v, (ts_ms, tx_id)) AS v FROM (
        SELECT *, CASE tx_id % 3 WHEN 0 THEN 'DISMISSED' WHEN 1 THEN 'CONFIRMED' END AS v FROM pay WHERE tx_id % 8 = 0) WHERE v IS NOT NULL GROUP BY 1)
      SELECT merchant_key, coalesce(v, status) AS status, estimated_amount_minor FROM sub LEFT JOIN c USING (merchant_key)""",
    "status_lists": f"{W}{PAY} SELECT status, merchant_key, round(confidence, 6) AS confidence FROM sub",
    "dash_top_lists": f"""{W}{PERIOD}, {PAY.strip()}, lists AS (
      SELECT 'categories' AS list, category_id AS member, CAST(sum(amount_minor) AS DOUBLE) AS measure, 6 AS k FROM spent GROUP BY 2
      UNION ALL SELECT 'merchants', merchant_key, CAST(sum(amount_minor) AS DOUBLE), 5 FROM spent WHERE merchant_key IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'subscriptions', merchant_key, confidence, 3 FROM sub)
      SELECT list, row_number() OVER (PARTITION BY list ORDER BY measure DESC, member) AS place, member, round(measure, 6) AS measure FROM lists
      QUALIFY place <= k""",
    "dash_cache": f"""{W}{PERIOD}, s AS (SELECT
      CAST(coalesce(sum(amount_minor) FILTER (role = 'GROSS_EXPENSE' AND currency = 'INR'), 0) AS BIGINT) AS gross_minor,
      CAST(coalesce(sum(amount_minor) FILTER (role = 'CREDIT' AND currency = 'INR'), 0) AS BIGINT) AS credits_minor,
      CAST(coalesce(sum(amount_minor) FILTER (role = 'REFUND' AND currency = 'INR'), 0) AS BIGINT) AS refunds_minor, count(*) AS transaction_count FROM p)
      SELECT *, greatest(gross_minor - refunds_minor, 0) AS net_minor, (SELECT CAST(sum(amount_minor) AS BIGINT) FROM spent) AS in_categories,
        (SELECT count(DISTINCT month) FROM spent) AS n_months, (SELECT tx_id FROM p ORDER BY ts_ms DESC, tx_id LIMIT 1) AS latest_id FROM s""",
    "sub_totals": f"""{W}{PAY}, a AS (SELECT CASE frequency WHEN 'WEEKLY' THEN estimated_amount_minor * 52 // 12 WHEN 'YEARLY' THEN estimated_amount_minor // 12 ELSE estimated_amount_minor END AS m
      FROM sub WHERE status IN ('SUSPECTED', 'CONFIRMED')) SELECT CAST(coalesce(sum(m), 0) AS BIGINT) AS monthly_minor, count(*) AS n_active, CAST(coalesce(sum(m), 0) * 12 AS BIGINT) AS annual_minor FROM a""",
    "sub_list": f"{W}{PAY} SELECT merchant_key, status, round(confidence, 6) AS confidence, n_evidence FROM sub",
    "status_partition": f"{W}{PAY} SELECT status, count(*) AS n, list_sort(list(merchant_key))[1] AS first_key FROM sub GROUP BY 1",
    "sub_evidence": f"{W}{PAY} SELECT merchant_key, tx_id, amount_minor FROM (SELECT merchant_key, unnest(evidence_ids) AS tx_id FROM sub) JOIN pay USING (merchant_key, tx_id)",
    "corrections_materialise": f"""{W}{TX}, {CORR}, src AS (SELECT DISTINCT new_value AS raw FROM corr WHERE field_name = 'MERCHANT'), {_merchant('raw').strip()},
      valid AS (SELECT corr.*, m5.merchant_key AS new_key, trim(new_value) AS v FROM corr LEFT JOIN m5 ON raw = new_value AND field_name = 'MERCHANT'
        WHERE CASE field_name WHEN 'CATEGORY' THEN new_value IN {tuple(k for k, _ in lexicon.CATEGORIES)} WHEN 'DIRECTION' THEN new_value IN {lexicon.DIRECTIONS}
          WHEN 'DUPLICATE_STATUS' THEN new_value IN {lexicon.STATUSES} WHEN 'TRANSFER_STATUS' THEN new_value IN {lexicon.STATUSES} ELSE trim(new_value) <> '' END)
      SELECT t.tx_id, coalesce(new_key, t.merchant_key) AS merchant_key, CASE WHEN field_name = 'MERCHANT' THEN v ELSE merchant_display END AS merchant_display,
      CASE WHEN field_name = 'CATEGORY' THEN v ELSE category_id END AS category_id, CASE WHEN field_name = 'DIRECTION' THEN v ELSE direction END AS direction,
      CASE WHEN field_name = 'DUPLICATE_STATUS' THEN v ELSE duplicate_status END AS duplicate_status,
      CASE WHEN duplicate_status <> 'NONE' AND NOT coalesce(field_name = 'DUPLICATE_STATUS' AND v = 'NONE', false) THEN t.tx_id - 1 END AS possible_duplicate_of,
      CASE WHEN field_name = 'TRANSFER_STATUS' THEN v ELSE transfer_status END AS transfer_status, c.tx_id IS NOT NULL AS is_user_confirmed
      FROM tx t LEFT JOIN valid c ON c.tx_id = t.tx_id""",
    "corrections_outcome": f"""{W}{TX}, {CORR} SELECT correction_id, CASE WHEN t.tx_id IS NULL THEN 'TRANSACTION_NOT_FOUND'
        WHEN apply_to_future AND correction_id % 4 = 0 AND t.merchant_key IS NULL THEN 'INVALID_FUTURE_RULE'
        WHEN field_name = 'CATEGORY' AND new_value NOT IN {tuple(k for k, _ in lexicon.CATEGORIES)} THEN 'INVALID_VALUE' ELSE 'APPLIED' END AS outcome
      FROM corr LEFT JOIN tx t ON t.tx_id = CASE WHEN correction_id % 90 = 0 THEN -1 ELSE correction_id END""",
    "fk_set_null": f"""{W}{TX} SELECT tx_id, CASE WHEN duplicate_status <> 'NONE' AND (tx_id - 1) NOT IN (SELECT tx_id FROM tx WHERE tx_id % 7 = 0) THEN tx_id - 1 END AS possible_duplicate_of
      FROM tx WHERE tx_id % 7 <> 0""",
    "fk_cascade": f"{W}{TX}, {CORR} SELECT correction_id, tx_id FROM corr WHERE tx_id NOT IN (SELECT tx_id FROM tx WHERE tx_id % 7 = 0)",
    "fk_restrict": f"""{W}{CLASSIFY}, c AS (SELECT DISTINCT {CATEGORY} AS category_id FROM cl)
      SELECT category_id, sort_order FROM (VALUES {', '.join(f'({_q(k)}, {i})' for i, (k, n) in enumerate(lexicon.CATEGORIES))}) AS v(category_id, sort_order)
      WHERE category_id NOT IN (SELECT category_id FROM c)""",
    "exclusion_join": f"{W}{CORR} SELECT DISTINCT tx_id FROM corr WHERE field_name = 'NOT_A_TRANSACTION'",
    "upsert_fingerprint": f"""{W}{TX}, s AS (SELECT * FROM tx WHERE tx_id % 2 = 0), i AS (SELECT tx_id, ts_ms + 1 AS ts_ms, amount_minor + 100 AS amount_minor FROM tx WHERE tx_id % 3 = 0 OR tx_id % 2 = 1)
      SELECT coalesce(s.tx_id, i.tx_id) AS tx_id, coalesce(s.ts_ms, i.ts_ms) AS ts_ms, coalesce(i.amount_minor, s.amount_minor) AS amount_minor FROM s FULL JOIN i ON s.tx_id = i.tx_id""",
    "activate_bundle": f"""WITH {METADATA}, wanted AS (SELECT parser_version FROM m WHERE parser_version = '13' AND status <> 'INVALID')
      SELECT m.parser_version, CASE WHEN w.parser_version IS NOT NULL THEN 'ACTIVE' WHEN m.status = 'ACTIVE' AND EXISTS (SELECT 1 FROM wanted) THEN 'INSTALLED' ELSE m.status END AS status,
        CASE WHEN w.parser_version IS NOT NULL THEN {NOW} ELSE m.activated_at END AS activated_at FROM m LEFT JOIN wanted w ON w.parser_version = m.parser_version""",
    "mark_bundle": f"""WITH {METADATA}, marks AS (SELECT * FROM (VALUES ('4', 'INVALID'), ('8', 'ROLLBACK')) AS v(version, mark))
      SELECT m.parser_version, coalesce(mark, status) AS status, CASE WHEN mark IS DISTINCT FROM 'INVALID' THEN activated_at END AS activated_at
      FROM m LEFT JOIN marks ON version = parser_version""",
    "version_order_long": "SELECT event_id, CAST(sign(CAST(event_id % 4 AS BIGINT) - user_id % 3) AS INT) AS ordering FROM events",
    "app_version_check": r"""WITH v AS (SELECT event_id, (event_id % 3) || '.' || (user_id % 4) || CASE WHEN event_id % 5 = 0 THEN '-beta.1' WHEN event_id % 7 = 0 THEN '.x' ELSE '+7' END AS cur FROM events),
      p AS (SELECT event_id, regexp_replace(cur, '[-+].*$', '') AS core FROM v)
      SELECT event_id, regexp_matches(core, '^\d+(\.\d+)*$') AND list_transform(string_split(CASE WHEN regexp_matches(core, '^\d+(\.\d+)*$') THEN core ELSE '0' END || '.0', '.'), lambda x: CAST(x AS INT)) >= [1, 2, 0] AS fits FROM p""",
    "version_order": """WITH v AS (SELECT event_id, 'bundled-2026.' || (event_id % 12) || '.' || (user_id % 3) AS a, CASE WHEN event_id % 5 = 0 THEN 'next' ELSE '2026.' || (event_id % 7) END AS b,
      event_id % 12 AS a1, user_id % 3 AS a2, event_id % 7 AS b1 FROM events)
      SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 WHEN a1 < b1 THEN -1 WHEN a1 > b1 THEN 1 WHEN a2 > 0 THEN 1 ELSE 0 END AS ordering FROM v""",
    "privacy_scan": f"SELECT doc_id, {_any('text', lexicon.SECRET_PATTERNS)} AS looks_secret FROM documents",
    "privacy_messages": f"{W}{MSG} SELECT source_message_id, {_any('body', lexicon.SECRET_PATTERNS)} AS looks_secret FROM msg",
    "prohibited_keys": f"""WITH b AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{{"a": [1, {{"b": {{"Sms_Body": ' || props || '}}}}]}}'
        WHEN 1 THEN '{{"list": [' || props || ', {{"x": {{"S-m-s": 1}}, "body": 2}}]}}' ELSE props END AS body FROM events),
      k AS (SELECT event_id, min_by(t.key, t.id) AS key, min_by(t.path || '.' || t.key, t.id) AS place FROM b, json_tree(b.body) AS t
        WHERE regexp_replace(lower(t.key), '[^a-z0-9]', '', 'g') IN {lexicon.PROHIBITED_KEYS} GROUP BY 1)
      SELECT event_id, key, replace(substr(place, 3), '[', '.[') AS path FROM b LEFT JOIN k USING (event_id)""",
    "telemetry_validate": f"""WITH t AS (SELECT event_id, {_list([*lexicon.TELEMETRY_EVENT_TYPES, "other"])}[CAST(event_id % 8 + 1 AS INT)] AS t, {_list([*lexicon.DURATION_BUCKETS, "LONG"])}[CAST(event_id % 8 + 1 AS INT)] AS d FROM events)
      SELECT event_id AS n, CASE WHEN event_id % 10 = 3 THEN 'INVALID_EVENT_ID' WHEN t = 'other' THEN 'INVALID_EVENT_TYPE' WHEN event_id % 3 = 0 AND d = 'LONG' THEN 'INVALID_DURATION' END AS error_code FROM t""",
    "telemetry_dedupe_daily": f"""{TWICE}, {FIRST}
      SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, app_version, count(*) AS n FROM f GROUP BY ALL""",
    "telemetry_accepted": f"""{TWICE}, first AS (SELECT event_type FROM e QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1)
      {ACCEPTED}""",
    "telemetry_accepted_stored": f"""{TWICE}, first AS (SELECT event_type FROM (
        SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1) WHERE event_id NOT IN (SELECT event_id FROM e WHERE event_id % 4 = 0))
      {ACCEPTED}""",
    "telemetry_expiry": f"""WITH e AS (SELECT event_id, ts, event_type FROM events),
      old AS (SELECT event_id, ts - CASE WHEN event_id % 3 = 0 THEN INTERVAL 31 DAY ELSE INTERVAL 29 DAY END AS ts FROM events WHERE event_id % 2 = 0),
      first AS (SELECT event_type FROM e WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.event_id = e.event_id AND old.ts + INTERVAL 30 DAY > e.ts))
      {ACCEPTED}""",
    "telemetry_added_counts": f"""{TWICE}, {FIRST},
      old AS (SELECT * FROM e WHERE event_id % 4 = 0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1),
      counted AS (SELECT * FROM old UNION ALL SELECT * FROM f WHERE event_id NOT IN (SELECT event_id FROM old))
      SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, app_version, count(*) AS n FROM counted GROUP BY ALL""",
    "telemetry_payloads": f"{W}{REQUESTS} SELECT n, code, field, field_code FROM judged",
    "telemetry_payload_events": f"""{W}{REQUESTS} SELECT n, json_extract_string(e, '$.eventId') AS event_id, json_extract_string(e, '$.eventType') AS event_type FROM (
      SELECT n, unnest(CAST(json_extract(body, '$.events[*]') AS JSON[])) AS e FROM judged WHERE field_code IS NULL)""",
    "support_payloads": f"""{W}{SUPPORT} SELECT n, code, field, field_code FROM judged""",
    "header_check": """WITH h AS (SELECT event_id AS n, CASE WHEN event_id % 5 <> 0 THEN '1.0' END AS a, ['android', 'ios', ''][CAST(event_id % 3 + 1 AS INT)] AS p,
        CASE WHEN event_id % 7 <> 0 THEN '14' ELSE ' ' END AS o, CASE WHEN event_id % 11 <> 0 THEN 'u' ELSE 'x' END AS i FROM events),
      f AS (SELECT *, concat_ws(',', CASE WHEN a IS NULL THEN 'x-app-version' END, CASE WHEN trim(p) = '' THEN 'x-platform' END, CASE WHEN trim(o) = '' THEN 'x-os-version' END) AS missing FROM h),
      g AS (SELECT n, CASE WHEN missing <> '' THEN missing WHEN p <> 'android' THEN 'X-Platform' WHEN i = 'x' THEN 'X-Install-Id' END AS field,
        CASE WHEN missing <> '' THEN 'MISSING' WHEN p <> 'android' THEN 'UNSUPPORTED_VALUE' WHEN i = 'x' THEN 'INVALID_FORMAT' END AS field_code FROM f)
      SELECT n, CASE WHEN field IS NOT NULL THEN 'VALIDATION_ERROR' END AS code, field, field_code FROM g""",
    "ttl_alive": "SELECT event_id FROM events WHERE epoch_us(ts) // 1000 + 2592000000 > 1707500000000",
    "support_idempotency": """WITH s AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS k, CAST(event_id % 2 AS VARCHAR) AS payload FROM events), f AS (SELECT k, min_by(payload, seq) AS p, min(seq) AS s FROM s GROUP BY 1)
      SELECT seq, k AS idempotency_key, CASE WHEN payload = p THEN 201 ELSE 409 END AS status, seq = f.s AS stored FROM s JOIN f USING (k)""",
    "category_seed_join": f"""{W}{CLASSIFY}, c AS (SELECT {CATEGORY} AS category_id FROM cl), s AS (SELECT * FROM (VALUES {', '.join(f'({_q(k)}, {_q(n)}, {i})' for i, (k, n) in enumerate(lexicon.CATEGORIES))}) AS v(category_id, name, sort_order))
      SELECT s.category_id, name, sort_order, count(c.category_id) AS n FROM s LEFT JOIN c ON c.category_id = s.category_id GROUP BY ALL""",
    "category_seed_insert": f"""{W}{CLASSIFY}, stored AS (SELECT {CATEGORY} AS category_id, CAST(100 + count(*) AS INT) AS sort_order FROM cl GROUP BY 1),
      seed AS (SELECT * FROM (VALUES {', '.join(f'({_q(k)}, {i})' for i, (k, _) in enumerate(lexicon.CATEGORIES))}) AS v(category_id, sort_order))
      SELECT * FROM stored UNION ALL SELECT * FROM seed WHERE category_id NOT IN (SELECT category_id FROM stored)""",
    "latest_completed": f"{W}{SCANS} SELECT scan_id, completed_at FROM scans WHERE status = 'COMPLETED' ORDER BY completed_at DESC NULLS LAST, scan_id DESC LIMIT 1",
    "status_lookups": f"""{W}{SCANS} SELECT 'active' AS lookup, max_by(scan_id, (updated_at, scan_id)) AS scan_id FROM scans WHERE status IN ('PENDING', 'RUNNING')
      UNION ALL SELECT 'resumable', max_by(scan_id, (updated_at, scan_id)) FROM scans WHERE status IN ('PENDING', 'RUNNING', 'INTERRUPTED')""",
    "scan_newest_by_status": f"{W}{SCANS} SELECT status, max_by(scan_id, (updated_at, scan_id)) AS scan_id FROM scans GROUP BY 1",
    "scan_violations": f"""{W}{SCANS} SELECT scan_id, CASE WHEN accepted > processed THEN 'COUNTS' WHEN status = 'COMPLETED' AND completed_at IS NULL THEN 'COMPLETED_AT'
      WHEN status IN ('PENDING', 'RUNNING') AND completed_at IS NOT NULL THEN 'STILL_RUNNING' END AS violation FROM scans""",
    "retry_mapping": f"""WITH reasons AS (SELECT * FROM (VALUES {', '.join(f'({_q(k)}, {i})' for i, k in enumerate((*ENDS, 'no such')))}) AS v(reason, i)),
      ended AS (SELECT event_id, reason FROM events JOIN reasons ON i = event_id % 11)
      SELECT event_id, CASE WHEN reason IN ('COMPLETED', 'CANCELLED') THEN 'SUCCESS'
        WHEN reason IN ('PERMISSION_REVOKED', 'PERMISSION_DENIED', 'PARSER_UNAVAILABLE', 'NOT_RESUMABLE') THEN 'FAILURE' ELSE 'RETRY' END AS outcome FROM ended""",
    "support_idempotency_stored": """WITH s AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS k, CAST(event_id % 2 AS VARCHAR) AS payload FROM events),
      o AS (SELECT k, min_by(payload, seq) AS p FROM s WHERE seq % 10 = 0 GROUP BY 1), i AS (SELECT * FROM s WHERE seq % 10 <> 0),
      f AS (SELECT k, min_by(payload, seq) AS p, min(seq) AS s FROM i GROUP BY 1)
      SELECT i.seq, i.k AS idempotency_key, CASE WHEN i.payload = coalesce(o.p, f.p) THEN 201 ELSE 409 END AS status, i.seq = f.s AND o.p IS NULL AS stored
      FROM i JOIN f ON f.k = i.k LEFT JOIN o ON o.k = i.k""",
    "cached_recent_ids": f"""{W}{TX} SELECT pos, tx_id, amount_minor FROM (SELECT unnest([5, 3, 999999999, 8, 1]) AS tx_id, unnest([0, 1, 2, 3, 4]) AS pos) JOIN tx USING (tx_id)""",
    "duplicate_pointer_join": f"{W}{TXE} SELECT near.seq, near_seq, b.ts_ms AS near_ts_ms FROM near JOIN kept b ON b.seq = near_seq",
}

_FACETS = """
      SELECT 'total' AS facet, NULL AS member, CAST(sum(amount_minor) AS BIGINT) AS total_minor, count(*) AS n FROM spent
      UNION ALL SELECT 'category', category_id, CAST(sum(amount_minor) AS BIGINT), count(*) FROM spent GROUP BY 2
      UNION ALL SELECT 'month', month, CAST(sum(amount_minor) AS BIGINT), count(*) FROM spent GROUP BY 2
      UNION ALL SELECT 'merchant', merchant_key, CAST(sum(amount_minor) AS BIGINT), count(*) FROM spent WHERE merchant_key IS NOT NULL GROUP BY 2"""


def _off(sql: str) -> str:
    """The same over the period that begins and ends within a day."""
    return sql.replace(f"BETWEEN {START} AND {END}", f"BETWEEN {OFF_START} AND {OFF_END}")


#: The corrected ledger worked out from scratch, with its roles.
_FIXED = f"""WITH fixed AS ({ORACLES["corrections_materialise"]}), {TX}, {CORR},
p AS (
  SELECT f.*, t.ts_ms, t.amount_minor, t.currency, {_role("f.direction", "f.transfer_status",
    "(f.duplicate_status = 'CONFIRMED' OR f.tx_id IN (SELECT tx_id FROM corr WHERE field_name = 'NOT_A_TRANSACTION'))")} AS role
  FROM fixed f JOIN tx t USING (tx_id) WHERE t.ts_ms BETWEEN {START} AND {END}
), spent AS (SELECT *, strftime(make_timestamp(ts_ms * 1000), '%Y-%m') AS month FROM p WHERE role = 'GROSS_EXPENSE' AND currency = 'INR')"""
_SUM = "CAST(coalesce(sum(amount_minor) FILTER (role = '{0}' AND currency = 'INR'), 0) AS BIGINT)"

ORACLES |= {
    "dash_rollup": _off(ORACLES["dash_grouping_sets"]),
    "dash_rollup_scalars": _off(ORACLES["dash_scalars"]),
    "correction_flow": _off(_FIXED) + _FACETS,
    "correction_flow_rows": ORACLES["corrections_materialise"],
    "correction_flow_dashboard": f"""{_FIXED}, s AS (SELECT {_SUM.format("GROSS_EXPENSE")} AS gross_minor, {_SUM.format("CREDIT")} AS credits_minor,
      {_SUM.format("REFUND")} AS refunds_minor, count(*) AS transaction_count FROM p)
      SELECT *, greatest(gross_minor - refunds_minor, 0) AS net_minor, (SELECT count(DISTINCT month) FROM spent) AS n_months FROM s""",
    "tx_search_index": f"""{W}{TX}, needles AS (SELECT unnest({_list(NEEDLES)}) AS needle)
      SELECT needle, tx_id FROM tx JOIN needles ON merchant_display ILIKE '%' || needle || '%' OR merchant_key ILIKE '%' || needle || '%'""",
    "msg_extract_indexed": ORACLES["msg_extract"],
    "scan_in_pages": ORACLES["scan_two_batches"],
    "ingest_store": ORACLES["scan_two_batches"],
    "ingest_rows_are_sound": f"SELECT CAST(NULL AS VARCHAR) AS violation, count(*) AS n FROM ({ORACLES['scan_two_batches']})",
    "ingest_scan_state": f"""{W}{FILTER} SELECT 'COMPLETED' AS status, count(*) + count(*) FILTER (source_message_id % 3 = 0) AS processed,
      count(*) FILTER (reject_reason IS NULL) + count(*) FILTER (reject_reason IS NULL AND source_message_id % 3 = 0) AS accepted, 0 AS failures,
      max(CASE WHEN source_message_id % 3 = 0 THEN source_message_id + {COPY_ID} ELSE source_message_id END) AS cursor FROM filtered""",
}
