"""Further record-quality checks: duplicates, contradictions, weak text and consistency.

Row-local rules share one scan through ``row_checks``; shared-value rules go through ``shared_records``.
All yield unique_id, check, severity, penalty_points, issue_summary.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trustdesk.functions.text import (
    digits, email_key, is_email, is_missing, json_strings, matching_key, national_number, sanitize,
)
from trustdesk.operators.quality import Rule, row_checks
from trustdesk.operators.skew import salted_join
from trustdesk.schemas import PLACEHOLDERS, SEVERITY_POINTS

# --- fixed values: contacts nobody can be reached at, and country names used as a whole address ---
PLACEHOLDER_EMAILS = ["test@example.com", "abc@xyz.com"]
COUNTRY_NAMES = ["india", "in"]
# words that name each record type
TYPE_WORDS = {
    "hospital": ["hospital"],
    "clinic": ["clinic"],
    "dentist": ["dentist", "dental"],
    "pharmacy": ["pharmacy", "pharmacist"],
    "nursing_home": ["nursing"],
}
INPATIENT_WORDS = ["inpatient", "icu", "ward"]
# --------------------------------------------------------------------------------------------------


def rule(check, condition, severity, issue):
    return Rule(check, condition, SEVERITY_POINTS[severity], issue, severity)


def points_of(severity) -> Column:
    """Penalty of a severity column."""
    out = F.lit(0)
    for name, points in SEVERITY_POINTS.items():
        out = F.when(severity == name, points).otherwise(out)
    return out


def shared_records(keyed: DataFrame, key="value", hot_rows=None, also=None) -> DataFrame:
    """(unique_id, key, duplicate_count) for every record whose key belongs to more than one record.

    ``also`` keeps further keys, given as a condition on the key. Copies collapse to one row per (key, record)
    before anything else, and that one shuffle feeds both the counts and the join.
    """
    keys = [key] if isinstance(key, str) else list(key)
    per_record = keyed.dropna(subset=keys).select("unique_id", *keys).distinct()
    counts = per_record.groupBy(*keys).agg(F.count("unique_id").alias("duplicate_count"),
                                           F.count(F.lit(1)).alias("n"))
    wanted = F.col("duplicate_count") > 1
    # the test on n is always true and keeps the column, hence the shuffle, the same for both uses
    shared = counts.where((wanted if also is None else wanted | also) & (F.col("n") > 0))
    return salted_join(per_record, shared.drop("n"), keys, "unique_id", counts=shared.select(*keys, "n"),
                       hot_rows=hot_rows)


def by_count(count="duplicate_count") -> Column:
    return F.when(F.col(count) >= 6, "critical").otherwise("high")


def _finish(df, check, severity, issue, *keep):
    return (df.withColumn("check", F.lit(check)).withColumn("severity", severity)
            .withColumn("penalty_points", points_of(F.col("severity")))
            .withColumn("issue_summary", issue)
            .select("unique_id", *keep, "check", "severity", "penalty_points", "issue_summary"))


def _used_by(what):
    return F.concat(F.lit(f"This {what} appears on "), F.col("duplicate_count").cast("string"),
                    F.lit(" facility records"))


def duplicate_emails(src: DataFrame, hot_rows=None) -> DataFrame:
    """Addresses on several records; a placeholder address counts whether shared or not."""
    keyed = (src.select("unique_id", email_key("email").alias("email")).where(is_email("email")))
    placeholder = F.col("email").isin(PLACEHOLDER_EMAILS)
    shared = shared_records(keyed, "email", hot_rows, also=placeholder)
    return _finish(shared, "duplicate_email", F.when(placeholder, "critical").otherwise(by_count()),
                   F.when(placeholder, "Placeholder email address").otherwise(_used_by("email")),
                   "email", "duplicate_count")


def contact_numbers(src: DataFrame) -> DataFrame:
    """Distinct national numbers per record from both phone fields."""
    listed = F.coalesce(json_strings("phone_numbers"), F.array().cast("array<string>"))
    numbers = F.array_distinct(F.transform(
        F.concat(listed, F.array("officialPhone")), lambda p: national_number(p)))
    return src.select("unique_id", F.explode(numbers).alias("phone")).where(F.col("phone") != "")


def duplicate_phones_by_count(src: DataFrame, min_digits=7, hot_rows=None) -> DataFrame:
    """Shared numbers graded by how many records use them; too short numbers are reported too."""
    numbers = contact_numbers(src)
    short = F.length("phone") < min_digits
    shared = shared_records(numbers, "phone", hot_rows, also=short)
    return _finish(shared, "duplicate_phone_count", F.when(short, "high").otherwise(by_count()),
                   F.when(short, "Phone number has too few digits").otherwise(_used_by("phone number")),
                   "phone", "duplicate_count")


def duplicate_identity(silver: DataFrame, hot_rows=None) -> DataFrame:
    """Same normalised name with the same address (critical) or the same city and state (high)."""
    name, address = matching_key("name"), matching_key("address_line1")
    city, state = matching_key("address_city"), matching_key("address_state_or_region")
    keys = F.array_compact(F.array(
        F.when((name != "") & (address != ""), F.struct(
            F.lit("address").alias("match"), F.concat_ws("|", name, address).alias("value"))),
        F.when((name != "") & city.isNotNull() & state.isNotNull(), F.struct(
            F.lit("place").alias("match"), F.concat_ws("|", name, city, state).alias("value")))))
    keyed = silver.select("unique_id", F.inline(keys))
    shared = shared_records(keyed, ["match", "value"], hot_rows)
    same_address = F.col("match") == "address"
    return _finish(shared, "duplicate_identity", F.when(same_address, "critical").otherwise("high"),
                   F.when(same_address, "Same name and address as another record")
                   .otherwise("Same name, city and state as another record"), "match", "value", "duplicate_count")


def missing_core(src: DataFrame) -> DataFrame:
    """Core identity fields that are missing, contacts and descriptive texts taken together."""
    def every(*cs, extra=()):
        return reduce(lambda a, b: a & b, (is_missing(c, extra) for c in cs))

    return row_checks(src, [
        rule("core_name", is_missing("name"), "critical", "Facility name is missing"),
        rule("core_state", is_missing("address_stateOrRegion"), "high", "State or region is missing"),
        rule("core_type", is_missing("facilityTypeId"), "medium", "Facility type is missing"),
        rule("core_contact", every("officialPhone", "phone_numbers", "email", "officialWebsite", "websites",
                                   extra=["[]"]), "medium", "No contact field is filled in"),
        rule("core_text", every("description", "capability", "procedure", "equipment", extra=["[]"]), "high",
             "No descriptive text is filled in"),
    ])


def contact_formats(src: DataFrame, min_digits=7) -> DataFrame:
    """Malformed or placeholder contact values."""
    email, phone = email_key("email"), digits("officialPhone")
    has_email, has_phone = ~is_missing("email"), ~is_missing("officialPhone")
    at_signs = F.length(email) - F.length(F.replace(email, F.lit("@"), F.lit("")))
    return row_checks(src, [
        rule("email_no_at", has_email & (at_signs == 0) & ~email.isin(PLACEHOLDERS), "medium", "Email has no @"),
        rule("email_no_domain", has_email & (at_signs == 1) & ~email.rlike(r"@[^@\s]+\.[^@\s]+$"), "medium",
             "Email has no domain"),
        rule("email_several", has_email & (at_signs > 1), "medium", "Several emails in one field"),
        rule("email_placeholder", has_email & email.isin([*PLACEHOLDER_EMAILS, *PLACEHOLDERS]), "high",
             "Placeholder email"),
        rule("phone_not_a_number", has_phone & (phone == ""), "medium", "Phone is not a number"),
        rule("phone_short", has_phone & F.length(phone).between(1, min_digits - 1), "medium",
             "Phone number has too few digits"),
        # Java patterns know back references, so one repeated digit is a single test
        rule("phone_repeated", has_phone & phone.rlike(r"^([0-9])\1+$"), "high", "Phone repeats one digit"),
    ])


def _any_word(text, words):
    return reduce(lambda a, b: a | b, (F.array_contains(text, w) for w in words))


def words_of(*cs) -> Column:
    """Lower-cased words of several text columns."""
    return F.split(F.concat_ws(" ", *(matching_key(c) for c in cs)), " ")


def field_conflicts(src: DataFrame, as_of) -> DataFrame:
    """Structured fields that contradict each other or the text."""
    year = F.trim("yearEstablished").try_cast("int")
    beds = F.trim("capacity").try_cast("int")
    kind = F.lower(F.trim("facilityTypeId"))
    return row_checks(src, [
        rule("hospital_without_beds", (kind == "hospital") & (beds == 0), "medium", "Hospital with capacity 0"),
        rule("year_in_future", year > F.year(F.lit(as_of).cast("date")), "high", "Year established is in the future"),
        rule("year_too_old", year < 1800, "medium", "Year established is implausibly old"),
        rule("inpatients_without_beds",
             _any_word(words_of("description", "capability"), INPATIENT_WORDS) & (F.coalesce(beds, F.lit(0)) == 0),
             "medium", "Inpatient services claimed without bed capacity"),
    ])


def low_coverage_guard(src: DataFrame, coverage: DataFrame, as_of, threshold=0.5) -> DataFrame:
    """Missing fields of low coverage only warn; present but invalid values are penalised.

    ``coverage`` has one row per column (field, coverage), a handful whatever the data size.
    """
    year = F.trim("yearEstablished").try_cast("int")
    this_year = F.year(F.lit(as_of).cast("date"))
    beds = F.trim("capacity").try_cast("int")
    state = F.inline(F.array(
        F.struct(F.lit("capacity").alias("field"), F.when(is_missing("capacity"), "missing").when(
            beds.isNull() | (beds <= 0), "invalid").alias("state")),
        F.struct(F.lit("yearEstablished").alias("field"), F.when(is_missing("yearEstablished"), "missing").when(
            year > this_year, "future").when(year.isNull() | (year < 1800), "invalid").alias("state"))))
    found = src.select("unique_id", state).where(F.col("state").isNotNull())
    low = F.col("coverage") < threshold
    severity = (F.when(F.col("state") == "future", "high").when(F.col("state") == "invalid", "medium")
                .when(low, "warning").otherwise("low"))
    issue = (F.when(F.col("state") != "missing", F.concat(F.col("field"), F.lit(" is present but not valid")))
             .when(low, F.concat(F.col("field"), F.lit(" is missing (low dataset coverage)")))
             .otherwise(F.concat(F.col("field"), F.lit(" is missing"))))
    joined = found.join(F.broadcast(coverage.select("field", "coverage")), "field")
    return _finish(joined, "low_coverage", severity, issue, "field")


def weak_address(silver: DataFrame, hot_rows=None) -> DataFrame:
    """Addresses too thin to find a place by, or used by several records."""
    line = F.trim("address_line1")
    full = F.concat_ws("|", matching_key("address_line1"), matching_key("address_line2"),
                       matching_key("address_city"), matching_key("address_state_or_region"))
    only_country = F.lower(line).isin(COUNTRY_NAMES)
    rules = row_checks(silver, [
        rule("address_missing", F.col("address_line1").isNull() | (line == ""), "low", "Address is missing"),
        rule("address_country_only", only_country, "medium", "Address is only a country"),
        rule("address_short", (F.length(line) < 10) & (line != "") & ~only_country, "low", "Address is very short"),
    ])
    keyed = silver.where(matching_key("address_line1") != "").select("unique_id", full.alias("value"))
    shared = _finish(shared_records(keyed, "value", hot_rows), "address_shared", F.lit("medium"), _used_by("address"))
    return rules.unionByName(shared.select(rules.columns))


def same_coordinates(silver: DataFrame, hot_rows=None) -> DataFrame:
    """Records at exactly the same point."""
    keyed = silver.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "unique_id", "latitude", "longitude")
    return _finish(shared_records(keyed, ["latitude", "longitude"], hot_rows), "same_coordinates", F.lit("medium"),
                   _used_by("point"), "latitude", "longitude", "duplicate_count")


def type_against_text(silver: DataFrame) -> DataFrame:
    """The text names another record type and never the record's own."""
    words = words_of("description", "capability", "procedure", "equipment")
    rules = []
    for kind, own in TYPE_WORDS.items():
        for other, theirs in TYPE_WORDS.items():
            if other != kind:
                rules.append(rule(
                    f"type_{kind}_{other}",
                    (F.col("facility_type_id") == kind) & _any_word(F.col("_words"), theirs)
                    & ~_any_word(F.col("_words"), own), "medium", f"Type is {kind} but the text names {other}"))
    return row_checks(silver.withColumn("_words", words), rules)


def text_quality(df: DataFrame, text="description", id_col="unique_id", others=(), min_chars=40,
                 garbled_share=0.01, punctuation_share=0.3, hot_rows=None) -> DataFrame:
    """Thin, garbled, repeated or copied text. Works on any table with an id and a text column."""
    value, length = F.col(text), F.col("_length")
    # the normalised text is needed several times, so it is a column of its own rather than an expression
    prepared = df.withColumn("_length", F.length(value))
    if others:
        prepared = prepared.withColumn("_key", matching_key(text))
    garbled = (length - F.length(sanitize(value))) / length
    punctuation = F.length(F.regexp_replace(value, r"[\p{L}\p{N}\s]+", "")) / length
    present = length > 0
    rules = [
        rule("text_short", present & (F.length(F.trim(value)) < min_chars), "low", "Text is too short to support a claim"),
        rule("text_garbled", present & (garbled > garbled_share), "medium", "Text holds unreadable characters"),
        rule("text_punctuation", present & (punctuation > punctuation_share), "low", "Text is mostly punctuation"),
    ]
    if others:
        same = F.col("_key").isin([matching_key(o) for o in others])
        rules.append(rule("text_copied_field", present & (F.col("_key") != "") & same, "medium",
                          "Text repeats another field"))
    rows = row_checks(prepared, rules, id_col)
    keyed = df.where(value.rlike(r"[\p{L}\p{N}]")).select(
        F.col(id_col).alias("unique_id"), F.sha2(matching_key(text), 256).alias("value"))
    shared = _finish(shared_records(keyed, "value", hot_rows), "text_boilerplate", F.lit("medium"), _used_by("text"))
    return rows.unionByName(shared.select(rows.columns))


def trust_quality_matrix(facility_scores: DataFrame, scores: DataFrame, trust_cut=0.7, quality_cut=65) -> DataFrame:
    """Where trust and quality disagree or are both low. A record without a quality row scores 100."""
    trust, quality = F.col("score"), F.coalesce("quality_score", F.lit(100))
    high_trust, high_quality = trust >= trust_cut, quality >= quality_cut
    verdict = (F.when(trust.isNull(), "no_trust_score")
               .when(high_trust & high_quality, "reliable")
               .when(high_trust, "manual_review")
               .when(high_quality, "claims_unproven")
               .otherwise("risky"))
    return (facility_scores.join(scores.select("facility_id", "quality_score"), "facility_id", "left")
            .select("facility_id", "score", quality.alias("quality_score"), verdict.alias("verdict")))
