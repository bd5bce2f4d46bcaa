"""Checks of request headers and JSON bodies, as columns {code, field, field_code} of the first thing that is wrong; null if nothing is.

Bodies are read as variants, so a value's type counts as it is in the JSON text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions import lexicon, privacy, text
from passbook.streaming.telemetry import UUID

# The properties of the bodies, and the bounds of their values.
BATCH_KEYS = ("schemaVersion", "batchId", "events")
EVENT_KEYS = ("eventId", "occurredAt", "eventType", "durationBucket", "countBucket", "errorCode")
SUPPORT_KEYS = ("schemaVersion", "submissionId", "consentedAt", "previewConfirmed", "redactionVersion", "reason", "redactedTemplate")
ERROR_CODE = r"^[A-Z0-9_]{3,64}$"
MAX_EVENTS, MAX_REDACTION_VERSION, MAX_TEMPLATE = 50, 32, 4096


def _problem(field: Column | str, field_code: str, code: str = "VALIDATION_ERROR") -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return F.struct(F.lit(code).alias("code"), field.alias("field"), F.lit(field_code).alias("field_code"))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def header_problem() -> Column:
    """Of the headers app_version, platform, os_version and install_id."""
    names = {"app_version": "x-app-version", "platform": "x-platform", "os_version": "x-os-version", "install_id": "x-install-id"}
    missing = F.concat_ws(",", *[F.when(text.present(F.col(c)).isNull(), n) for c, n in names.items()])
    return (F.when(missing != "", _problem(missing, "MISSING"))
            .when(F.col("platform") != "android", _problem("X-Platform", "UNSUPPORTED_VALUE"))
            .when(~F.col("install_id").rlike(UUID), _problem("X-Install-Id", "INVALID_FORMAT")))


def _value(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column, name: str) -> Column:
    """The value if it is a string in the JSON, else null."""
    return F.when(F.schema_of_variant(_value(v, name)) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def _unknown(v: Column, allowed: Sequence[str]) -> Column:
    """The first unknown property in order of names, or null."""
    return F.array_min(F.array_except(F.json_object_keys(F.to_json(v)), F.array(*map(F.lit, allowed))))


def _version_one(v: Column) -> Column:
    kind = F.schema_of_variant(_value(v, "schemaVersion"))
    return _true(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (F.try_variant_get(v, "$.schemaVersion", "double") == 1))


def _uuid(v: Column, name: str) -> Column:
    return _true(_text(v, name).rlike(UUID))


def _given(v: Column, name: str) -> Column:
    return _true(text.present(_text(v, name)).isNotNull())


def _one_of(v: Column, name: str, allowed: Sequence[str]) -> Column:
    return _true(_text(v, name).isin(*allowed))


def _event_problem(e: Column, i: Column) -> Column:
    at = lambda name: F.concat(F.lit("events["), i.cast("string"), F.lit("]."), name if isinstance(name, Column) else F.lit(name))
    keys = F.json_object_keys(F.to_json(e))
    has = lambda name: F.array_contains(keys, name)
    code = _text(e, "errorCode")
    return (F.when(~_true(F.schema_of_variant(e).startswith("OBJECT")), _problem(F.concat(F.lit("events["), i.cast("string"), F.lit("]")), "INVALID"))
            .when(_unknown(e, EVENT_KEYS).isNotNull(), _problem(at(_unknown(e, EVENT_KEYS)), "UNKNOWN_PROPERTY"))
            .when(~_uuid(e, "eventId"), _problem(at("eventId"), "INVALID_FORMAT"))
            .when(~_given(e, "occurredAt"), _problem(at("occurredAt"), "MISSING"))
            .when(~_one_of(e, "eventType", lexicon.TELEMETRY_EVENT_TYPES), _problem(at("eventType"), "UNSUPPORTED_VALUE"))
            .when(has("durationBucket") & ~_one_of(e, "durationBucket", lexicon.DURATION_BUCKETS), _problem(at("durationBucket"), "UNSUPPORTED_VALUE"))
            .when(has("countBucket") & ~_one_of(e, "countBucket", lexicon.COUNT_BUCKETS), _problem(at("countBucket"), "UNSUPPORTED_VALUE"))
            .when(has("errorCode") & ~_true(code.rlike(ERROR_CODE)), _problem(at("errorCode"), "INVALID_FORMAT")))


def _batch_problem(v: Column) -> Column:
    events = F.try_variant_get(v, "$.events", "array<variant>")
    sized = _true(F.schema_of_variant(_value(v, "events")).startswith("ARRAY") & F.size(events).between(1, MAX_EVENTS))
    return (F.when(_unknown(v, BATCH_KEYS).isNotNull(), _problem(_unknown(v, BATCH_KEYS), "UNKNOWN_PROPERTY"))
            .when(~_version_one(v), _problem("schemaVersion", "UNSUPPORTED_VALUE"))
            .when(~_uuid(v, "batchId"), _problem("batchId", "INVALID_FORMAT"))
            .when(~sized, _problem("events", "INVALID"))
            .otherwise(F.get(F.filter(F.transform(events, _event_problem), lambda x: x.isNotNull()), F.lit(0))))


def _support_problem(v: Column) -> Column:
    true = _true((F.schema_of_variant(_value(v, "previewConfirmed")) == "BOOLEAN") & F.try_variant_get(v, "$.previewConfirmed", "boolean"))
    bounded = lambda name, n: _given(v, name) & _true(F.length(_text(v, name)) <= n)
    return (F.when(~_true(F.col("idempotency_key").rlike(UUID)), _problem("Idempotency-Key", "INVALID_FORMAT"))
            .when(_unknown(v, SUPPORT_KEYS).isNotNull(), _problem(_unknown(v, SUPPORT_KEYS), "UNKNOWN_PROPERTY"))
            .when(~_version_one(v), _problem("schemaVersion", "UNSUPPORTED_VALUE"))
            .when(~_uuid(v, "submissionId"), _problem("submissionId", "INVALID_FORMAT"))
            .when(~true, _problem("previewConfirmed", "UNSUPPORTED_VALUE"))
            .when(~_given(v, "consentedAt"), _problem("consentedAt", "MISSING"))
            .when(~bounded("redactionVersion", MAX_REDACTION_VERSION), _problem("redactionVersion", "INVALID"))
            .when(~_one_of(v, "reason", lexicon.SUPPORT_REASONS), _problem("reason", "UNSUPPORTED_VALUE"))
            .when(~bounded("redactedTemplate", MAX_TEMPLATE), _problem("redactedTemplate", "INVALID")))


def _checked(requests: DataFrame, rest, max_bytes: int) -> DataFrame:
    read = requests.select("*", F.try_parse_json("body").alias("_v"), privacy.prohibited_path(F.col("body")).alias("_path"))
    v, none = F.col("_v"), F.lit(None).cast("string")
    return read.select(*requests.columns, (
        F.when(F.coalesce(F.octet_length("body"), F.lit(0)) > max_bytes, _problem(none, "INVALID", "PAYLOAD_TOO_LARGE"))
        .when(~_true(F.schema_of_variant(v).startswith("OBJECT")), _problem(none, "INVALID"))
        .when(F.col("_path").isNotNull(), _problem(F.col("_path"), "PROHIBITED_FIELD", "PROHIBITED_FIELD"))
        .otherwise(rest(v))).alias("problem"))


def telemetry_checked(requests: DataFrame, max_bytes: int = 65_536) -> DataFrame:
    """``requests`` (body, ...) plus problem, for batches of telemetry events."""
    return _checked(requests, _batch_problem, max_bytes)


def support_checked(requests: DataFrame, max_bytes: int = 16_384) -> DataFrame:
    """``requests`` (body, idempotency_key, ...) plus problem, for support submissions."""
    return _checked(requests, _support_problem, max_bytes)


def telemetry_events(checked: DataFrame) -> DataFrame:
    """The columns of valid batches with one row per event: event_id, occurred_at, event_type."""
    rows = checked.where("problem is null").select(
        *[c for c in checked.columns if c != "problem"], F.explode(F.try_variant_get(F.parse_json("body"), "$.events", "array<variant>")).alias("e"))
    return rows.select(*[c for c in checked.columns if c != "problem"], *[
        F.variant_get("e", f"$.{n}", "string").alias(c) for c, n in (("event_id", "eventId"), ("occurred_at", "occurredAt"), ("event_type", "eventType"))])
