"""Schemas, enumerations and field lists shared by every layer."""

from pyspark.sql import types as T

S, I, L, D, B, TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _schema(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# --- fixed values: names and codes that stored data and callers rely on -------------------
DIMENSIONS = ["capability", "equipment", "procedure", "completeness"]
CONFIDENCE_TIERS = ["high", "medium", "low", "insufficient_data"]  # best to worst
RECORD_TYPES = ["hospital", "clinic", "dentist", "pharmacy", "farmacy", "doctor", "nursing_home"]
ACTION_TYPES = ["note", "override", "shortlist", "flag"]
REVIEW_STATUSES = [
    "not_started", "in_progress", "email_sent", "called", "parked", "validation_complete",
]
PLACEHOLDERS = ["", "null", "na", "n/a", "unknown", "none"]
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
# score bucket label, lowest, highest, tier
SCORE_BUCKETS = [
    ("0-29", 0, 29, "low"), ("30-39", 30, 39, "low"), ("40-49", 40, 49, "med"),
    ("50-59", 50, 59, "med"), ("60-69", 60, 69, "med"), ("70-79", 70, 79, "high"),
    ("80-89", 80, 89, "high"), ("90-100", 90, 100, "high"),
]
SEVERITY_POINTS = {"critical": 50, "high": 30, "medium": 15, "low": 5}
# columns landed from the source, in table order
SOURCE_COLUMNS = [
    "unique_id", "name", "organization_type", "content_table_id", "officialPhone", "email", "officialWebsite",
    "yearEstablished", "acceptsVolunteers", "facebookLink", "address_line1", "address_line2", "address_line3",
    "address_city", "address_stateOrRegion", "address_zipOrPostcode", "address_country", "address_countryCode",
    "countries", "facilityTypeId", "operatorTypeId", "affiliationTypeIds", "description", "capability",
    "procedure", "equipment", "area", "numberDoctors", "capacity", "recency_of_page_update",
    "distinct_social_media_presence_count", "affiliated_staff_presence", "custom_logo_presence",
    "number_of_facts_about_the_organization", "post_metrics_most_recent_social_media_post_date",
    "post_metrics_post_count", "engagement_metrics_n_followers", "engagement_metrics_n_likes",
    "engagement_metrics_n_engagements", "source", "latitude", "longitude",
]
# columns an analyst may correct, with the type the text value is cast back to
OVERRIDE_FIELDS = {
    "name": "string",
    "official_phone": "string",
    "email": "string",
    "official_website": "string",
    "address_line1": "string",
    "address_line2": "string",
    "address_line3": "string",
    "address_city": "string",
    "address_state_or_region": "string",
    "address_zip_or_postcode": "string",
    "address_country": "string",
    "address_country_code": "string",
    "facility_type_id": "string",
    "operator_type_id": "string",
    "description": "string",
    "capability": "string",
    "procedure": "string",
    "equipment": "string",
    "year_established": "int",
    "number_doctors": "int",
    "capacity": "int",
    "latitude": "double",
    "longitude": "double",
}
# the columns that count towards completeness when picking the best copy of a record
COMPLETENESS_FIELDS = [
    "name", "official_phone", "email", "official_website", "address_city", "address_state_or_region",
    "description", "capability", "procedure", "equipment",
]
# -------------------------------------------------------------------------------------------

TRUST_SIGNALS = _schema(
    ("facility_id", S, False), ("dimension", S, False), ("trust_score", D, True),
    ("confidence_tier", S, True), ("evidence_text", S, True), ("source_field", S, True),
    ("contradiction", B, True), ("contradiction_detail", S, True), ("extraction_model", S, True),
    ("extracted_at", TS, True),
)
EXTRACTION_ERRORS = _schema(
    ("facility_id", S, True), ("error_message", S, True), ("raw_response", S, True),
    ("failed_at", TS, False),
)
QUALITY_SCORES = _schema(
    ("facility_id", S, False), ("quality_score", I, False), ("quality_tier", S, False),
    ("total_penalty_points", I, False), ("issues", T.ArrayType(S), True), ("computed_at", TS, False),
)
OUTREACH = _schema(
    ("email", S, False), ("facility_count", L, True), ("first_name", S, True), ("first_state", S, True),
    ("is_shared", B, True),
    ("min_quality_score", I, True), ("avg_quality_score", I, True), ("issues", T.ArrayType(S), True),
    ("computed_at", TS, True),
)
OUTREACH_LISTS = _schema(("email", S, False), ("list", S, False), ("value", S, False))
OVERRIDES_LOG = _schema(
    ("facility_id", S, False), ("field_name", S, False), ("new_value", S, True),
    ("analyst_id", S, True), ("reason", S, True), ("updated_at", TS, False),
)
ACTIONS_LOG = _schema(
    ("action_id", S, False), ("facility_id", S, False), ("analyst_id", S, False),
    ("action_type", S, False), ("dimension", S, True), ("content", S, True),
    ("override_score", D, True), ("created_at", TS, True), ("updated_at", TS, False),
)
REVIEW_STATE = _schema(
    ("facility_id", S, False), ("status", S, False), ("parked_reason", S, True),
    ("assigned_to", S, True), ("notes", S, True), ("updated_by", S, True), ("updated_at", TS, False),
)
RAW_RESPONSES = _schema(
    ("facility_id", S, False), ("raw_response", S, True), ("extraction_model", S, True),
    ("error_message", S, True), ("responded_at", TS, True),
)

# One dimension of a model answer. Score and contradiction stay text so that 0.8, "0.8" and junk
# can be told apart after parsing.
MODEL_ANSWER = T.StructType([
    T.StructField("dimensions", T.ArrayType(_schema(
        ("dimension", S, True), ("trust_score", S, True), ("confidence_tier", S, True),
        ("evidence_text", S, True), ("source_field", S, True), ("contradiction", S, True),
        ("contradiction_detail", S, True),
    ))),
])
