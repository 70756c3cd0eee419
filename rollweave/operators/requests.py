"""Validity of incoming requests and the gate in front of public search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rollweave.functions.rules import first_message, messages, missing
from rollweave.functions.text import normalize_name, squeeze, strip
from rollweave.operators.registry import SEARCHABLE

# Request vocabularies and bounds.
STATUSES = ("yes", "no", "unknown")
SITUATIONS = (
    "existing_voter", "new_voter", "missing_name", "shifted_address", "correction",
    "deceased_family", "duplicate_entry", "portal_failed",
)
STATUS_FIELDS = (
    "blo_visited", "enumeration_form_received", "enumeration_form_submitted",
    "current_roll_found", "base_roll_found",
)
GUIDANCE_FIELDS = ("state_id", "situation", *STATUS_FIELDS)
SEARCH_FIELDS = (
    "state_id", "query", "ac_number", "part_number", "limit", "use_sanitized_pilot", "turnstile_verified",
)


def local_search_blockers() -> Column:
    """Rules of an operator's search request."""
    c = F.col
    return messages([
        (missing(c("state_id")), "state_id is required"),
        (~F.coalesce(c("ac_number") > 0, F.lit(False)), "ac_number must be positive"),
        (F.length(normalize_name(c("query"))) < 2, "search query must contain at least two normalized characters"),
        (~c("limit").between(1, 20), "limit must be between 1 and 20"),
        (~c("threshold").between(0, 1), "similarity threshold must be between 0 and 1"),
    ])


def public_search_blockers() -> Column:
    """Rules of a public, scoped search request."""
    c = F.col
    return messages([
        (c("query").isNull(), "query must be a string"),
        (F.length(strip(c("query"))) < 2, "query must contain at least two characters"),
        (c("ac_number").isNull(), "name search must be scoped by Assembly Constituency"),
        (c("part_number").isNotNull() & c("ac_number").isNull(), "part_number search also requires ac_number"),
        (~c("limit").between(1, 20), "limit must be between 1 and 20"),
    ])


def readiness_blockers() -> Column:
    """Rules of a readiness request."""
    c = F.col
    return messages([
        (missing(c("state_id")), "state_id is required"),
        (~F.coalesce(c("ac_number") > 0, F.lit(False)), "ac_number must be positive"),
        (c("part_number") <= 0, "part_number must be positive"),
        (~c("max_quality_issue_rate").between(0, 1), "max_quality_issue_rate must be between 0 and 1"),
    ])


class _Payload:
    """Typed look at the top-level fields of a JSON text column: 5, "5" and true differ."""

    def __init__(self, payload: Column):
        self.value = F.try_parse_json(payload)
        self.keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))

    def has(self, key: str) -> Column:
        return F.array_contains(self.keys, key)

    def kind(self, key: str) -> Column:
        field = F.try_variant_get(self.value, f"$.{key}", "variant")
        return F.coalesce(F.schema_of_variant(field), F.lit("VOID"))

    def string(self, key: str) -> Column:
        return F.when(self.kind(key) == "STRING", squeeze(F.try_variant_get(self.value, f"$.{key}", "string")))

    def integer(self, key: str) -> Column:
        return F.when(self.kind(key) == "BIGINT", F.try_variant_get(self.value, f"$.{key}", "bigint"))

    def absent(self, key: str) -> Column:
        return self.kind(key) == "VOID"


def _unknown_fields(keys: Column, allowed: Sequence[str]) -> tuple[Column, Column]:
    extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(a) for a in allowed])))
    return F.size(extra) > 0, F.concat(F.lit("unknown fields: "), F.array_join(extra, ", "))


def _string_rules(p: _Payload, key: str, low: int, high: int) -> list:
    value = p.string(key)
    return [
        (value.isNull(), f"{key} must be a string"),
        (~F.length(value).between(low, high), f"{key} length is invalid"),
    ]


def guidance_payload_error(payload: Column) -> Column:
    """First validation error of a guidance request in JSON, NULL when it is valid."""
    p = _Payload(payload)
    rules = [_unknown_fields(p.keys, GUIDANCE_FIELDS)]
    rules += _string_rules(p, "state_id", 2, 16) + _string_rules(p, "situation", 2, 64)
    rules.append((~p.string("situation").isin(*SITUATIONS), "situation is not supported"))
    for key in STATUS_FIELDS:
        rules += [(p.has(key) & cond, text) for cond, text in _string_rules(p, key, 2, 16)]
    rules += [
        (p.has(key) & ~p.string(key).isin(*STATUSES), f"{key} must be yes, no, or unknown")
        for key in STATUS_FIELDS
    ]
    return first_message(rules)


def search_payload_error(payload: Column) -> Column:
    """First validation error of a search request in JSON, NULL when it is valid."""
    p = _Payload(payload)
    ac, part, limit = (p.integer(k) for k in ("ac_number", "part_number", "limit"))
    rules = [_unknown_fields(p.keys, SEARCH_FIELDS)]
    rules += _string_rules(p, "state_id", 2, 16) + _string_rules(p, "query", 2, 80)
    rules += [
        (ac.isNull(), "ac_number must be an integer"),
        (~ac.between(1, 999), "ac_number is out of range"),
        (~p.absent("part_number") & part.isNull(), "part_number must be an integer"),
        (~part.between(1, 9999), "part_number is out of range"),
        (p.has("limit") & limit.isNull(), "limit must be an integer"),
        (~limit.between(1, 20), "limit is out of range"),
    ]
    rules += [
        (p.has(k) & (p.kind(k) != "BOOLEAN"), f"{k} must be a boolean")
        for k in ("use_sanitized_pilot", "turnstile_verified")
    ]
    return first_message(rules)


def policy_blockers() -> Column:
    """Sanity rules of a search-policy row, in order; the first one stops a launch."""
    c = F.col
    return messages([
        (~c("require_scope"), "public search must require geographic scope"),
        (c("max_results") > 20, "public search max_results must be 20 or less"),
        (c("allow_bulk_export"), "bulk export must be disabled"),
        (c("reveal_full_epic"), "full EPIC reveal must be disabled"),
        (c("reveal_raw_address"), "raw address reveal must be disabled"),
        (c("log_full_query"), "full search query logging must be disabled"),
        (~c("rate_limit_max_requests").between(1, 120), "search rate limit must be between 1 and 120 requests"),
        (~c("rate_limit_window_seconds").between(10, 3600),
         "search rate limit window must be between 10 and 3600 seconds"),
    ])


def search_gate(requests: DataFrame, states: DataFrame, require_turnstile: bool = True) -> DataFrame:
    """Requests with the first reason indexed search is refused, NULL when it is allowed.

    ``requests(..., state_id, turnstile_verified, use_sanitized_pilot)``. A policy row's
    fields may be present on the request; they are checked first.
    """
    c = F.col
    registry = states.select(
        "state_id", c("public_launch_ready").alias("_ready"), c("data_capability").alias("_capability"),
        c("schedule_provenance.confidence").alias("_confidence"), F.lit(True).alias("_known"),
    )
    joined = requests.join(registry, "state_id", "left")
    pilot = c("use_sanitized_pilot")
    rules = [(c("_known").isNull(), F.concat(F.lit("unknown state_id: "), c("state_id")))]
    if "require_scope" in requests.columns:
        first = F.get(policy_blockers(), F.lit(0))
        rules.append((first.isNotNull(), first))
    rules += [
        (~pilot & ~c("_ready"), "indexed search is not enabled for public launch in this state"),
        (~pilot & ~c("_capability").isin(*SEARCHABLE), "indexed search is not available for this state"),
        (~pilot & (c("_confidence") != "official"), "public search requires official schedule provenance"),
    ]
    if require_turnstile:
        rules.append((~pilot & ~c("turnstile_verified"), "public search requires abuse-prevention verification"))
    return joined.withColumn("refusal", first_message(rules)).select(
        *requests.columns, "refusal", F.col("refusal").isNull().alias("allowed")
    )
