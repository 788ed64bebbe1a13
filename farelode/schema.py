"""Declared record types and value domains. Readers always get these schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------------------------------
# The value domains and field lists of the record types.
SOURCE_TYPES = ("fare_rule", "airline_offer", "supplier_offer", "circular", "waiver_notice", "policy_bulletin", "terms_page", "other")
CABIN_TYPES = ("economy", "premium_economy", "business", "first", "mixed", "unknown")
PASSENGER_TYPES = ("adt", "chd", "inf", "all", "unknown")
POLICY_TOPICS = ("refund", "reissue_change", "no_show", "go_show", "cancellation", "waiver", "other")
POLICY_ACTIONS = ("allowed", "not_allowed", "conditional", "unknown")
APPLIES_TO = ("ticket", "fare", "tax", "segment", "coupon", "itinerary", "passenger", "unknown")
PENALTY_TYPES = ("fixed_amount", "percentage", "forfeiture", "free", "fare_difference_only", "tax_only", "mixed", "unknown")
DEPARTURE_SIDES = ("before_departure", "after_departure", "both", "not_applicable", "unknown")
LABEL_BACKENDS = ("sqlite", "jsonl", "postgres")

METADATA_FIELDS = (
    "source_id", "document_id", "document_type", "carrier", "supplier", "offer_or_circular_id", "market", "route_scope", "cabin", "fare_family", "pax_type",
    "effective_from", "effective_to", "travel_from", "travel_to", "ticketing_from", "ticketing_to", "section_title", "source_url", "source_filename", "chunk_id",
)
MANIFEST_FIELDS = (
    "source_id", "document_id", "document_type", "carrier", "supplier", "offer_or_circular_id", "source_url", "source_filename", "file_format", "market",
    "route_scope", "cabin", "fare_family", "effective_from", "effective_to", "language", "status", "notes",
)
OVERLAY_FIELDS = (
    "source_id", "document_id", "document_type", "carrier", "supplier", "offer_or_circular_id", "source_url", "source_filename", "market", "route_scope",
    "cabin", "fare_family", "effective_from", "effective_to",
)
CLAUSE_FIELDS = (
    ("record_id", "string"), ("source_id", "string"), ("document_id", "string"), ("document_type", "string"), ("offer_or_circular_id", "string"),
    ("source_url", "string"), ("source_filename", "string"), ("carrier", "string"), ("supplier", "string"), ("market", "string"), ("route_scope", "string"),
    ("cabin", "string"), ("fare_family", "string"), ("pax_type", "string"), ("policy_topic", "string"), ("action", "string"), ("applies_to", "string"),
    ("penalty_type", "string"), ("penalty_amount", "double"), ("penalty_currency", "string"), ("penalty_percent", "double"),
    ("fare_difference_required", "boolean"), ("tax_refund_rule", "string"), ("time_window", "string"), ("before_after_departure", "string"),
    ("effective_from", "string"), ("effective_to", "string"), ("travel_from", "string"), ("travel_to", "string"), ("ticketing_from", "string"),
    ("ticketing_to", "string"), ("eligibility_conditions", "array<string>"), ("exceptions", "array<string>"), ("clause_text", "string"),
    ("section_title", "string"), ("chunk_id", "string"), ("citation_span", "string"), ("confidence", "double"), ("needs_review", "boolean"), ("notes", "string"),
)
TIER_FIELDS = (
    ("time_window", "string"), ("before_after_departure", "string"), ("penalty_type", "string"), ("penalty_amount", "double"), ("penalty_currency", "string"),
    ("penalty_percent", "double"), ("fare_difference_required", "boolean"), ("notes", "string"),
)
PAYOUT_FIELDS = (
    ("method", "string"), ("allowed", "boolean"), ("fee_type", "string"), ("fee_amount", "double"), ("fee_currency", "string"), ("fee_percent", "double"),
    ("time_window", "string"), ("before_after_departure", "string"), ("notes", "string"),
)
IDENTITY_FIELDS = ("record_id", "source_id", "document_id", "document_type", "carrier", "supplier", "offer_or_circular_id", "chunk_id")
SCORED_FIELDS = (
    ("policy_topic", "string"), ("action", "string"), ("penalty_type", "string"), ("penalty_amount", "double"), ("penalty_currency", "string"),
    ("penalty_percent", "double"), ("fare_difference_required", "boolean"), ("time_window", "string"), ("before_after_departure", "string"),
    ("tax_refund_rule", "string"), ("eligibility_conditions", "array<string>"), ("exceptions", "array<string>"),
)
# ---------------------------------------------------------------------------------------------------------------------


_SIMPLE = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(fields) -> T.StructType:
    """Fields of simple types as a struct; made without a session, as workers read this module too."""
    return T.StructType([T.StructField(n, _SIMPLE[t]) for n, t in fields])


METADATA_SCHEMA = _struct([(n, "string") for n in METADATA_FIELDS])
MANIFEST_SCHEMA = _struct([(n, "string") for n in MANIFEST_FIELDS])
CHUNK_SCHEMA = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("metadata", METADATA_SCHEMA), T.StructField("start_token", T.IntegerType()), T.StructField("end_token", T.IntegerType())])
CLAUSE_SCHEMA = _struct(CLAUSE_FIELDS)
TIER_TYPE = f"struct<{', '.join(f'{n}: {t}' for n, t in TIER_FIELDS)}>"
PAYOUT_TYPE = f"struct<{', '.join(f'{n}: {t}' for n, t in PAYOUT_FIELDS)}>"
LABEL_SCHEMA = T.StructType([
    *_struct([*[(n, "string") for n in IDENTITY_FIELDS], ("clause_text", "string"), ("label_status", "string"), *SCORED_FIELDS]).fields,
    T.StructField("penalty_tiers", T.ArrayType(_struct(TIER_FIELDS))),
    T.StructField("refund_payout_options", T.ArrayType(_struct(PAYOUT_FIELDS))),
    T.StructField("notes", T.StringType()),
])
LABEL_TABLE_SCHEMA = T.StructType([*_struct([("record_id", "string"), ("payload_json", "string"), ("label_status", "string")]).fields, T.StructField("updated_at", T.TimestampType())])
QUEUE_SCHEMA = T.StructType([*_struct([*[(n, "string") for n in IDENTITY_FIELDS], ("chunk_text", "string"), ("clause_text", "string")]).fields, T.StructField("heuristic", _struct(SCORED_FIELDS)), T.StructField("manual_labeling_note", T.StringType())])
