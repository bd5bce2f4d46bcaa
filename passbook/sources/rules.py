"""Declarative extraction rules: strict decoding, validation and the bundle life cycle.

Rules are small control data and live on the driver; applying them is Spark's work.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.functions import lexicon
from passbook.sources.store import Store

FORBIDDEN = ("javascript:", "eval(", "<script")


@dataclass(frozen=True)
class Pattern:
    id: str
    direction: str
    regex: str
    amount_group: str
    merchant_group: str | None = None
    currency_group: str | None = None
    reference_group: str | None = None
    date_group: str | None = None

    def index(self, group: str | None) -> int | None:
        """The number of a named group, counting every capturing group before it."""
        if group is None:
            return None
        starts = re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?:\?<([A-Za-z]\w*)>|(\?))?", self.regex)
        n = 0
        for m in starts:
            if not m[0].startswith("(") or m[2]:
                continue
            n += 1
            if m[1] == group:
                return n
        return None


@dataclass(frozen=True)
class Institution:
    name: str
    senders: tuple[str, ...]
    patterns: tuple[Pattern, ...]


@dataclass(frozen=True)
class Rules:
    schema_version: int
    parser_version: str
    rules_version: str
    institutions: tuple[Institution, ...]

    def senders(self) -> list[str]:
        return [s for i in self.institutions for s in i.senders]


def _strict(found: dict, needed: set[str], optional: set[str] = frozenset()) -> dict:
    if unknown := set(found) - needed - optional:
        raise ValueError(f"unknown keys {sorted(unknown)}")
    if missing := needed - set(found):
        raise ValueError(f"missing keys {sorted(missing)}")
    return found


def decode(text: str) -> Rules:
    """Rules of a JSON document; unknown keys and unknown directions are errors."""
    groups = {"merchantGroup", "currencyGroup", "referenceGroup", "dateGroup"}
    doc = _strict(json.loads(text), {"schemaVersion", "parserVersion", "rulesVersion", "institutions"})
    institutions = []
    for i in doc["institutions"]:
        _strict(i, {"institution", "senderPatterns", "transactionPatterns"})
        patterns = []
        for p in i["transactionPatterns"]:
            _strict(p, {"id", "type", "regex", "amountGroup"}, groups)
            if p["type"].upper() not in lexicon.DIRECTIONS:
                raise ValueError(f"unknown type {p['type']}")
            patterns.append(Pattern(p["id"], p["type"].upper(), p["regex"], p["amountGroup"], *(
                p.get(g) for g in ("merchantGroup", "currencyGroup", "referenceGroup", "dateGroup"))))
        institutions.append(Institution(i["institution"], tuple(i["senderPatterns"]), tuple(patterns)))
    return Rules(doc["schemaVersion"], doc["parserVersion"], doc["rulesVersion"], tuple(institutions))


def problems(rules: Rules) -> list[str]:
    """Why a document must not be installed; empty if nothing is wrong."""
    out = [] if rules.schema_version == 1 else [f"schema version {rules.schema_version}"]
    ids = [p.id for i in rules.institutions for p in i.patterns]
    out += [f"repeated id {x}" for x in sorted({x for x in ids if ids.count(x) > 1})]
    for i in rules.institutions:
        for p in i.patterns:
            if any(t in p.regex.lower() for t in FORBIDDEN):
                out.append(f"{p.id}: forbidden token")
            try:
                re.compile(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", p.regex))
            except re.error as e:
                out.append(f"{p.id}: {e}")
                continue
            for g in (p.amount_group, p.merchant_group, p.currency_group, p.reference_group, p.date_group):
                if g is not None and p.index(g) is None:
                    out.append(f"{p.id}: no group {g}")
    return out


def java_problems(spark: SparkSession, rules: Rules) -> list[str]:
    """Patterns that Spark's own regular expressions refuse, which would fail every query that tries them."""
    out = []
    for i in rules.institutions:
        for p in i.patterns:
            try:
                spark.range(1).select(F.lit("").rlike("(?is)" + p.regex)).collect()
            except (PySparkException, Py4JJavaError):
                out.append(f"{p.id}: not a Java pattern")
    return out


def encode(rules: Rules) -> str:
    """The JSON document of rules; ``decode`` gives them back."""
    return json.dumps({
        "schemaVersion": rules.schema_version, "parserVersion": rules.parser_version, "rulesVersion": rules.rules_version,
        "institutions": [{
            "institution": i.name, "senderPatterns": list(i.senders), "transactionPatterns": [{
                "id": p.id, "type": p.direction, "regex": p.regex, "amountGroup": p.amount_group, "merchantGroup": p.merchant_group,
                "currencyGroup": p.currency_group, "referenceGroup": p.reference_group, "dateGroup": p.date_group} for p in i.patterns],
        } for i in rules.institutions]})


@dataclass(frozen=True)
class Envelope:
    """A rules document as it is handed out: versions, checksum and signature of the text, and the text itself."""

    schema_version: int
    parser_version: str
    rules_version: str
    minimum_app_version: str
    checksum: str
    signature: str
    text: str


_ENVELOPE = ("schemaVersion", "parserVersion", "rulesVersion", "minimumAppVersion", "checksumSha256", "signatureBase64", "rulesUtf8")


def decode_envelope(text: str) -> Envelope:
    doc = _strict(json.loads(text), set(_ENVELOPE))
    e = Envelope(doc["schemaVersion"], *[str(doc[k]).strip() for k in _ENVELOPE[1:6]], doc["rulesUtf8"])
    e = replace(e, checksum=e.checksum.lower())
    if e.schema_version < 1 or not all((e.parser_version, e.rules_version, e.minimum_app_version, e.checksum, e.signature, e.text.strip())):
        raise ValueError("an envelope field is blank")
    return e


def encode_envelope(e: Envelope) -> str:
    return json.dumps(dict(zip(_ENVELOPE, (
        e.schema_version, e.parser_version, e.rules_version, e.minimum_app_version, e.checksum, e.signature, e.text), strict=True)))


def enveloped(rules: Rules, minimum_app_version: str = "0.0.0", signature: str = "unsigned") -> str:
    """An envelope around rules of our own."""
    text = encode(rules)
    return encode_envelope(Envelope(1, rules.parser_version, rules.rules_version, minimum_app_version, sha256(text), signature, text))


@dataclass(frozen=True)
class Manifest:
    """What the newest rules package is and where it lies."""

    schema_version: int
    parser_version: str
    rules_version: str
    minimum_app_version: str
    package_url: str
    package_sha256: str
    published_ms: int | None = None


def decode_manifest(text: str) -> Manifest:
    doc = _strict(json.loads(text), {"schemaVersion", "latestParserVersion", "latestRulesVersion", "minimumAppVersion", "packageUrl", "packageSha256"},
                  {"publishedAtEpochMillis"})
    m = Manifest(doc["schemaVersion"], doc["latestParserVersion"].strip(), doc["latestRulesVersion"].strip(), doc["minimumAppVersion"].strip(),
                 doc["packageUrl"].strip(), doc["packageSha256"].strip().lower(), doc.get("publishedAtEpochMillis"))
    if m.schema_version < 1 or not m.minimum_app_version or not m.package_url.startswith("https://") or not re.fullmatch("[a-f0-9]{64}", m.package_sha256):
        raise ValueError("the manifest has an invalid value")
    return m


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def app_fits(current: str, minimum: str) -> bool:
    """Whether an app version is at least ``minimum``, without what follows - or +."""

    def parts(version: str) -> list[int]:
        core = re.split("[-+]", version.strip())[0].split(".")
        return [int(x) for x in core] if all(re.fullmatch(r"\d+", x) for x in core) else []

    a, b = parts(current), parts(minimum)
    n = max(len(a), len(b))
    return bool(a and b) and a + [0] * (n - len(a)) >= b + [0] * (n - len(b))


class Refused(ValueError):
    """Why a bundle isn't taken; ``reason`` is a short code."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


def checked(text: str, app_version: str, verify: Callable[[str, str], bool] | None = None) -> tuple[Envelope, Rules]:
    """Envelope and rules of a bundle, or Refused; the checks have a fixed order.  ``verify`` gets text and signature."""
    try:
        e = decode_envelope(text)
    except (json.JSONDecodeError, KeyError, TypeError) as x:
        raise Refused("MALFORMED_JSON", str(x)) from x
    except ValueError as x:
        raise Refused("MALFORMED_JSON" if "keys" in str(x) else "INVALID_SCHEMA", str(x)) from x
    if e.schema_version != 1:
        raise Refused("INCOMPATIBLE_SCHEMA", str(e.schema_version))
    if not app_fits(app_version, e.minimum_app_version):
        raise Refused("INCOMPATIBLE_APP_VERSION", f"{app_version} < {e.minimum_app_version}")
    if sha256(e.text) != e.checksum:
        raise Refused("CHECKSUM_MISMATCH")
    if verify is not None and not verify(e.text, e.signature):
        raise Refused("SIGNATURE_INVALID")
    return e, _document(e.text, e.parser_version, e.rules_version)


def _document(text: str, parser_version: str, rules_version: str) -> Rules:
    try:
        rules = decode(text)
    except (ValueError, KeyError, TypeError, AttributeError) as x:
        raise Refused("MALFORMED_JSON", str(x)) from x
    if found := problems(rules):
        raise Refused("INVALID_RULES", "; ".join(found))
    if (rules.parser_version, rules.rules_version) != (parser_version, rules_version):
        raise Refused("VERSION_MISMATCH", f"{rules.parser_version}, {rules.rules_version}")
    return rules


METADATA = ("parser_version string, rules_version string, checksum string, document string, status string, installed_at long, activated_at long")


@dataclass(frozen=True)
class Bundle:
    """An installed rules document; status INSTALLED, ACTIVE, ROLLBACK or INVALID."""

    parser_version: str
    rules_version: str
    checksum: str
    text: str
    status: str = "INSTALLED"
    installed_at: int = 0
    activated_at: int | None = None


class BundleStore:
    """Installed bundles by version, of which one at most is active; ``bundled`` is the envelope to fall back to.

    The bundles live in a table of the store, if one is given, else in memory: a few rows of control data.
    """

    def __init__(self, store: Store | None = None, app_version: str = "1.0.0", bundled: str | None = None,
                 verify: Callable[[str, str], bool] | None = None):
        self.store, self.app_version, self.verify = store, app_version, verify
        self.bundled = bundled if bundled is not None else enveloped(DEFAULT)
        rows = store.read("parser_metadata") if store is not None else None
        self.bundles = {r["parser_version"]: Bundle(*r) for r in rows.collect()} if rows is not None else {}

    def _put(self, *bundles: Bundle) -> None:
        self.bundles |= {b.parser_version: b for b in bundles}
        if self.store is not None:
            self.store.write("parser_metadata", self.metadata(self.store.spark))

    def metadata(self, spark: SparkSession) -> DataFrame:
        """The bundles as a table, the newest installed first."""
        rows = [(b.parser_version, b.rules_version, b.checksum, b.text, b.status, b.installed_at, b.activated_at) for b in self.bundles.values()]
        return spark.createDataFrame(rows, METADATA).orderBy(F.desc("installed_at"), "parser_version")

    def install(self, envelope: str, now_ms: int = 0) -> Bundle:
        """Take a bundle whose checks pass; Refused else.  An active one of the same version becomes installed."""
        e, found = checked(envelope, self.app_version, self.verify)
        if self.store is not None and (wrong := java_problems(self.store.spark, found)):
            raise Refused("INVALID_RULES", "; ".join(wrong))
        bundle = Bundle(e.parser_version, e.rules_version, e.checksum, e.text, installed_at=now_ms)
        self._put(bundle)
        return bundle

    def activate(self, version: str, now_ms: int = 0) -> None:
        if self.bundles[version].status == "INVALID":
            raise ValueError(f"{version} is invalid")
        self._put(*[replace(b, status="INSTALLED") for v, b in self.bundles.items() if b.status == "ACTIVE" and v != version],
                  replace(self.bundles[version], status="ACTIVE", activated_at=now_ms))

    def mark(self, version: str, status: str) -> None:
        if status not in ("ROLLBACK", "INVALID"):
            raise ValueError(status)
        b = self.bundles[version]
        self._put(replace(b, status=status, activated_at=None if status == "INVALID" else b.activated_at))

    def active_bundle(self) -> Bundle | None:
        return next((b for b in self.bundles.values() if b.status == "ACTIVE"), None)

    def active(self) -> Rules | None:
        b = self.active_bundle()
        return decode(b.text) if b else None

    def _sound(self, b: Bundle) -> bool:
        try:
            _document(b.text, b.parser_version, b.rules_version)
        except Refused:
            return False
        return sha256(b.text) == b.checksum

    def _fall_back(self, now_ms: int) -> Rules:
        try:
            b = self.install(self.bundled, now_ms)
        except Refused as x:
            raise Refused("BUNDLED_FALLBACK_UNAVAILABLE", str(x)) from x
        self.activate(b.parser_version, now_ms)
        return decode(b.text)

    def activate_verified(self, version: str, now_ms: int = 0) -> tuple[Rules, bool]:
        """The rules of ``version``, checked again and made active, or the bundled ones; and whether it fell back."""
        b = self.bundles.get(version)
        if b is not None and self._sound(b):
            if b.status == "INVALID":
                self._put(replace(b, status="INSTALLED"))
            self.activate(version, now_ms)
            return decode(b.text), False
        if b is not None:
            self.mark(version, "INVALID")
        return self._fall_back(now_ms), True

    def ensure_active(self, now_ms: int = 0) -> tuple[Rules, bool]:
        """The active rules if they are still sound, else the bundled ones; an unsound one is marked ROLLBACK."""
        b = self.active_bundle()
        if b is not None:
            if self._sound(b):
                return decode(b.text), False
            self.mark(b.parser_version, "ROLLBACK")
        return self._fall_back(now_ms), True


@dataclass
class UpdateState:
    """What updates remember: the last check, and the highest version ever accepted."""

    last_check_ms: int | None = None
    highest_accepted: str | None = None


CHECK_INTERVAL_MS = 12 * 3_600_000


def update(bundles: BundleStore, state: UpdateState, manifest: str, package: Callable[[str], str], now_ms: int, force: bool = False) -> str:
    """Take the package that a manifest names, if it is newer and sound: the outcome as a short code.

    ``package`` gives the text for the package's address, from wherever files are handed out.
    """
    bundles.ensure_active(now_ms)
    before = bundles.active_bundle()
    if not force and state.last_check_ms is not None and now_ms - state.last_check_ms < CHECK_INTERVAL_MS:
        return "RECENTLY_CHECKED"
    try:
        m = decode_manifest(manifest)
    except (ValueError, KeyError, TypeError, AttributeError):
        return "FAILED"
    if m.schema_version > 1:
        state.last_check_ms = now_ms
        return "INCOMPATIBLE_SCHEMA"
    if not app_fits(bundles.app_version, m.minimum_app_version):
        state.last_check_ms = now_ms
        return "INCOMPATIBLE_APP_VERSION"
    if any(v is not None and not is_newer(m.parser_version, v) for v in (before and before.parser_version, state.highest_accepted)):
        state.last_check_ms = now_ms
        return "ALREADY_CURRENT"
    text = package(m.package_url)
    if sha256(text) != m.package_sha256:
        return "PACKAGE_CORRUPT"
    try:
        b = bundles.install(text, now_ms)
    except Refused as x:
        return x.reason
    _, fell_back = bundles.activate_verified(b.parser_version, now_ms)
    if fell_back:
        bundles.activate_verified(before.parser_version, now_ms)
        return "ACTIVATION_FAILED"
    state.last_check_ms, state.highest_accepted = now_ms, b.parser_version
    return "UPDATED"


def activated(metadata: DataFrame, version: str, now_ms: int) -> DataFrame:
    """The table of bundles (parser_version, status, activated_at, ...) with ``version`` the only active one; an invalid one never is."""
    chosen = (F.col("parser_version") == version) & (F.col("status") != "INVALID")
    found = metadata.agg(F.coalesce(F.bool_or(chosen), F.lit(False)).alias("found"))
    return metadata.join(F.broadcast(found)).withColumns({
        "status": F.when(chosen, "ACTIVE").when(F.col("found") & (F.col("status") == "ACTIVE"), "INSTALLED").otherwise(F.col("status")),
        "activated_at": F.when(chosen, F.lit(now_ms)).otherwise(F.col("activated_at"))}).select(*metadata.columns)


def marked(metadata: DataFrame, version: str, status: str) -> DataFrame:
    """The table with ``version`` marked ROLLBACK or INVALID; the latter was never activated."""
    this = F.col("parser_version") == version
    return metadata.withColumns({
        "status": F.when(this, status).otherwise(F.col("status")),
        "activated_at": F.when(~this | F.lit(status != "INVALID"), F.col("activated_at"))}).select(*metadata.columns)


def numeric_version(version: str) -> list[int] | None:
    found = re.search(r"\d+(?:\.\d+)+", version)
    return [int(x) for x in found[0].split(".")] if found else None


def is_newer(candidate: str, baseline: str) -> bool:
    """By the first dotted numbers if both have one, shorter ones filled with zeros; else by text."""
    a, b = numeric_version(candidate), numeric_version(baseline)
    if a is None or b is None:
        return candidate > baseline
    n = max(len(a), len(b))
    return a + [0] * (n - len(a)) > b + [0] * (n - len(b))


# The rules to fall back to.
DEFAULT = Rules(1, "bundled-2026.08.12.0", "bundled-rules-1", (
    Institution("Example Bank", ("EX-BANK", "EXBANK"), (
        Pattern("example_debit_v1", "DEBIT", r"Rs\.?\s?(?<amount>[0-9,]+(?:\.[0-9]{1,2})?)\s+debited.*?(?:at|to)\s+(?<merchant>[A-Za-z0-9 ._-]+)",
                "amount", "merchant"),
        Pattern("example_credit_v1", "CREDIT", r"Rs\.?\s?(?<amount>[0-9,]+(?:\.[0-9]{1,2})?)\s+credited", "amount"))),))
_AMOUNT = r"(?<amount>[0-9,]+(?:\.[0-9]{1,2})?)"
# The rules that the regression corpus is extracted with.
REGRESSION = Rules(1, "regression-2026.08.12.0", "regression-rules-1", (
    Institution("Example Bank", ("EX-BANK", "EXBANK"), (
        Pattern("example_debit_v1", "DEBIT", r"Rs\.?\s?" + _AMOUNT + r"\s+debited.*?(?:at|to)\s+(?<merchant>[A-Za-z0-9 ._-]+?)"
                r"(?:\s+on\s+(?<date>\d{2}[-/]\d{2}[-/]\d{2,4}))?(?:\.|\s|$)", "amount", "merchant", date_group="date"),
        Pattern("example_credit_v1", "CREDIT", r"Rs\.?\s?" + _AMOUNT + r"\s+credited", "amount"),
        Pattern("example_refund_v1", "REFUND", r"Rs\.?\s?" + _AMOUNT + r"\s+refunded.*?(?:from|by)\s+(?<merchant>[A-Za-z0-9 ._-]+)",
                "amount", "merchant"),
        Pattern("example_transfer_v1", "TRANSFER", r"Rs\.?\s?" + _AMOUNT + r"\s+transferred\s+to\s+(?<merchant>[A-Za-z0-9_]+)"
                r"(?:\s+Ref(?:erence)?[:\s]*(?<reference>[A-Za-z0-9-]+))?", "amount", "merchant", reference_group="reference"))),
    Institution("Demo UPI Bank", ("DEMOUPI", "DM-UPI"), (
        Pattern("demo_upi_debit_v1", "DEBIT", r"INR\s" + _AMOUNT + r"\s+sent\s+to\s+(?<merchant>[A-Za-z0-9 @._-]+)\s+via\s+UPI"
                r".*?UPI Ref[:\s]+(?<reference>[0-9]+)", "amount", "merchant", reference_group="reference"),)),
    Institution("Ambiguity Bank A", ("AMBIG",), (
        Pattern("ambig_a_debit", "DEBIT", r"Rs\.?\s?" + _AMOUNT + r"\s+debited\s+for\s+(?<merchant>ALPHA)", "amount", "merchant"),)),
    Institution("Ambiguity Bank B", ("AMBIG",), (
        Pattern("ambig_b_debit", "DEBIT", r"Rs\.?\s?" + _AMOUNT + r"\s+debited\s+for\s+(?<merchant>BETA)", "amount", "merchant"),)),
))
