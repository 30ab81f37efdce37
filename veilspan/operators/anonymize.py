"""Anonymization of spans: masking, keyed pseudonyms, reversible tokens, policy routing and the signed audit trail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.crypto import hmac_sha256
from veilspan.functions.spans import dedup_by_start, let, replace_right_to_left, text_of
from veilspan.operators.detect import without_entropy


@dataclass(frozen=True)
class Keys:
    """Secret keys; none has a default. ``epoch`` names the pseudonymization key in use."""

    pseudonym: str
    token: str
    audit: str
    fingerprint: str
    epoch: str = "current"


@dataclass(frozen=True)
class Policy:
    mask: tuple[str, ...] = P.MASKED_TYPES
    pseudonymize: tuple[str, ...] = P.PSEUDONYMIZE_TYPES
    tokenize: tuple[str, ...] = P.TOKENIZE_TYPES
    version: str = "1"


def _is(kind: Column, types: tuple[str, ...]) -> Column:
    return kind.isin(*types) if types else F.lit(False)


def pseudonym(value: Column, kind: Column, key: str, length: int = P.TOKEN_HEX) -> Column:
    return F.concat(F.substring(F.lower(kind), 1, 4), F.lit("_"), F.substring(hmac_sha256(key, value), 1, length))


def token(value: Column, kind: Column, key: str) -> Column:
    return F.concat(F.lit("tok_"), F.lower(kind), F.lit("_"), F.substring(hmac_sha256(key, value), 1, P.TOKEN_HEX))


def mask(text: Column, spans: Column, placeholder: str = P.PLACEHOLDER) -> Column:
    return replace_right_to_left(text, spans, lambda original, s: F.lit(placeholder))


def pseudonymize(text: Column, spans: Column, key: str, length: int = P.TOKEN_HEX) -> Column:
    return replace_right_to_left(text, spans, lambda original, s: pseudonym(original, s["type"], key, length))


def tokenize(text: Column, spans: Column, key: str) -> Column:
    return replace_right_to_left(text, spans, lambda original, s: token(original, s["type"], key))


def method_of(kind: Column, policy: Policy = Policy()) -> Column:
    """The label in the audit trail: ``P.MASK_METHOD`` for every type that is neither pseudonymized nor tokenized, even where
    the text stays as it is."""
    return F.when(_is(kind, policy.pseudonymize), "pseudonymize").when(_is(kind, policy.tokenize), "tokenize").otherwise(P.MASK_METHOD)


def anonymize_by_policy(text: Column, spans: Column, keys: Keys, policy: Policy = Policy(), tokens: Column | None = None) -> Column:
    """Each span by its type's rule; unknown types stay. ``tokens`` is an optional map from values to the tokens that a store
    holds for them; other values get the token of their own type."""

    def replacement(original: Column, s: Column) -> Column:
        own = token(original, s["type"], keys.token)
        issued = own if tokens is None else F.coalesce(F.element_at(tokens, original), own)
        return (
            F.when(_is(s["type"], policy.mask), F.lit(P.PLACEHOLDER))
            .when(_is(s["type"], policy.pseudonymize), pseudonym(original, s["type"], keys.pseudonym))
            .when(_is(s["type"], policy.tokenize), issued)
            .otherwise(original)
        )

    return replace_right_to_left(text, spans, replacement)


# --- audit trail ---


def _payload(field_type: Column, method: Column, fingerprint: Column, version: Column, timestamp: Column) -> Column:
    """The event as JSON with sorted keys, in the form that is signed."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return F.concat(
        F.lit('{"field_type": '), quoted(field_type), F.lit(', "method": '), quoted(method), F.lit(', "original_value_fingerprint": '), quoted(fingerprint),
        F.lit(', "policy_version": '), quoted(version), F.lit(', "timestamp": '), timestamp.cast("bigint").cast("string"), F.lit("}"),
    )


def audit_event(field_type: Column, value: Column, keys: Keys, timestamp: Column, policy: Policy = Policy()) -> Column:
    """struct of field_type, method, policy_version, original_value_fingerprint, timestamp, authentication_tag."""
    method, version = method_of(field_type, policy), F.lit(policy.version)

    def signed(fingerprint: Column) -> Column:
        return F.struct(
            field_type.alias("field_type"), method.alias("method"), version.alias("policy_version"), fingerprint.alias("original_value_fingerprint"),
            timestamp.cast("bigint").alias("timestamp"), hmac_sha256(keys.audit, _payload(field_type, method, fingerprint, version, timestamp)).alias("authentication_tag"),
        )

    return let(hmac_sha256(keys.fingerprint, value), signed)


def verify_audit_event(event: Column, audit_key: str) -> Column:
    """False for events without a tag and for events that were changed."""
    payload = _payload(event["field_type"], event["method"], event["original_value_fingerprint"], event["policy_version"], event["timestamp"])
    return F.coalesce(event["authentication_tag"] == hmac_sha256(audit_key, payload), F.lit(False))


def process_lines(df: DataFrame, spans: Column, keys: Keys, timestamp: Column, policy: Policy = Policy(), text: str = "log") -> DataFrame:
    """``df`` with anonymized, detector_span_count and audit_events: detected spans without entropy, deduplicated once for
    both the text and the audit trail."""
    kept = df.withColumn("_veil_spans", dedup_by_start(without_entropy(spans)))
    events = F.transform("_veil_spans", lambda s: audit_event(s["type"], text_of(F.col(text), s), keys, timestamp, policy))
    return kept.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in ("anonymized", "detector_span_count", "audit_events")],
        anonymize_by_policy(F.col(text), F.col("_veil_spans"), keys, policy).alias("anonymized"),
        F.size("_veil_spans").alias("detector_span_count"),
        events.alias("audit_events"),
    )


def audit_rows(processed: DataFrame, line_id: str = "line_id") -> DataFrame:
    """One row per audit event with its own id, the line's id and its number in the line."""
    rows = processed.select(F.col(line_id).alias("line_id"), "log_type", F.posexplode_outer("audit_events").alias("number", "event")).where("event is not null")
    return rows.select(F.concat(F.col("line_id").cast("string"), F.lit("-audit-"), F.col("number").cast("string")).alias("event_id"), "line_id", "log_type", "event.*")
