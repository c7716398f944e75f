"""Record-quality checks and the 0-100 quality score.

Every check yields (unique_id, check, penalty_points, issue_summary). All rules that look at one
record at a time run together in one scan; only rules about values shared between records shuffle.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trustdesk.functions.score import quality_tier
from trustdesk.functions.text import digits, is_missing, json_strings
from trustdesk.operators.skew import hot_split_join, salted_join
from trustdesk.schemas import RECORD_TYPES

CONTRACT = ["unique_id", "check", "penalty_points", "issue_summary"]


@dataclass
class Rule:
    """``check`` fails where ``condition`` holds; points and issue may be columns."""

    check: str
    condition: Column
    points: Column | int
    issue: Column | str
    severity: str = None


def _lit(v):
    return v if isinstance(v, Column) else F.lit(v)


def usable_rules(df: DataFrame, rules):
    """Split rules into those the columns of ``df`` can answer and the names of those they cannot."""
    good, skipped = [], []
    for rule in rules:
        try:
            df.select(_lit(rule.condition), _lit(rule.points), _lit(rule.issue))
            good.append(rule)
        except AnalysisException:
            skipped.append(rule.check)
    return good, skipped


def row_checks(df: DataFrame, rules, id_col="unique_id", keep=()) -> DataFrame:
    """All row-local rules in one scan: each record yields one row per rule it fails."""
    fired = F.array_compact(F.array(*(
        F.when(r.condition, F.struct(
            F.lit(r.check).alias("check"), _lit(r.points).cast("int").alias("penalty_points"),
            _lit(r.issue).alias("issue_summary"), F.lit(r.severity).alias("severity")))
        for r in rules)))
    # the plain generator would get a filter with a second copy of all the conditions
    out = df.select(F.col(id_col).alias("unique_id"), *keep, F.inline_outer(fired)).where(F.col("check").isNotNull())
    return out if any(r.severity for r in rules) else out.drop("severity")


# --- the implemented checks -------------------------------------------------------------------------

def missing_rules():
    """Missing name, description, type, phone, email and website."""
    allowed = F.col("facilityTypeId").isin(RECORD_TYPES)
    # fixed values: names, points and texts of the checks
    return [
        Rule("missing_name", is_missing("name"), 60, "Facility name is missing"),
        Rule("missing_description", is_missing("description"), 30, "Description is missing"),
        Rule("invalid_type", F.col("facilityTypeId").isNull() | ~allowed, 20,
             "Facility type is missing or invalid"),
        Rule("missing_phone", is_missing("officialPhone") & is_missing("phone_numbers", ["[]"]), 10,
             "No phone number on record"),
        Rule("missing_email", is_missing("email"), 10, "No email address on record"),
        Rule("missing_website", is_missing("officialWebsite") & is_missing("websites", ["[]"]), 5,
             "No website on record"),
    ]


# the country the records belong to: accepted spellings and the box its coordinates fall in
HOME_COUNTRY = {"names": ["india", "in"], "latitude": (6, 38), "longitude": (68, 98)}


def location_parts(missing_coordinate_points=5, country=HOME_COUNTRY):
    """(code, text, points, condition) for each location problem.

    A comparison with NULL stays NULL, so a missing country or an unreadable coordinate raises nothing.
    """
    def blank(c):
        value = F.lower(F.trim(F.col(c)))
        return F.col(c).isNull() | value.isin(["", "na", "n/a", "unknown"])

    def outside(c):
        low, high = country[c]
        value = F.col(c).try_cast("double")
        return (value < low) | (value > high)

    # fixed values: codes, texts and points of the location problems
    return [
        ("bad_city", "City missing or invalid", 10, blank("address_city")),
        ("bad_state_or_region", "State/region missing or invalid", 25, blank("address_stateOrRegion")),
        ("unexpected_country", "Country is not India", 30,
         ~F.lower(F.trim(F.col("address_country"))).isin(country["names"])),
        ("missing_coordinates", "Coordinates missing", missing_coordinate_points,
         F.col("latitude").isNull() | F.col("longitude").isNull()),
        ("latitude_outside_india_range", "Latitude outside India", 35, outside("latitude")),
        ("longitude_outside_india_range", "Longitude outside India", 35, outside("longitude")),
    ]


def _location(parts):
    codes = F.concat_ws(", ", *(F.when(cond, code) for code, _, _, cond in parts))
    issue = F.concat_ws("; ", *(F.when(cond, text) for _, text, _, cond in parts))
    points = reduce(lambda a, b: a + b, (F.when(cond, p).otherwise(0) for _, _, p, cond in parts))
    return codes, points, issue


def location_rule(**options):
    codes, points, issue = _location(location_parts(**options))
    return Rule("location", codes != "", points, issue)


def location_check(src: DataFrame, **options) -> DataFrame:
    """Location problems with their codes, one row per failing record."""
    codes, points, issue = _location(location_parts(**options))
    return src.select(
        "unique_id", "name", "facilityTypeId", "address_city", "address_stateOrRegion", "address_country",
        "latitude", "longitude", codes.alias("location_issues"), points.alias("penalty_points"),
        issue.alias("issue_summary")).where(F.col("location_issues") != "")


def shared_values(df: DataFrame, value, id_col="unique_id") -> DataFrame:
    """Values used by more than one record: (value, duplicate_count, n rows).

    The test on ``n`` is always true; it keeps the column alive in every use of this frame, so that all of
    them read the same shuffle.
    """
    return (df.groupBy(value)
            .agg(F.count_distinct(id_col).alias("duplicate_count"), F.count(F.lit(1)).alias("n"))
            .where((F.col("duplicate_count") > 1) & (F.col("n") > 0)))


def with_percent_rank(df: DataFrame, column) -> DataFrame:
    """``percent_rank`` over the whole frame, ordered by an integer count column.

    The rank only depends on how many rows have each count, so the ordered step runs on that histogram.
    K different counts >= 2 need more than K*K/2 underlying rows, hence the histogram of 10^11 rows has
    under 450,000 entries; that bound is what allows the single ordered pass and the broadcast.
    """
    histogram = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    everything = W.partitionBy(F.lit(1))
    before = everything.orderBy(column).rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("_n").over(everything)
    below = F.coalesce(F.sum("_n").over(before), F.lit(0))
    ranks = histogram.select(
        column, F.when(total > 1, below / (total - 1)).otherwise(F.lit(0.0)).alias("pct_rank"))
    return df.join(F.broadcast(ranks), column)


def phone_rows(src: DataFrame) -> DataFrame:
    """One row per listed phone number with its digits."""
    return (src.where(~F.col("phone_numbers").isin("null", "[]"))
            .select("unique_id", "name", "facilityTypeId", "address_city", "address_stateOrRegion",
                    "address_country", F.explode(json_strings("phone_numbers")).alias("raw_phone"))
            .withColumn("phone_normalized", digits("raw_phone")))


def _graded_phones(dupes: DataFrame) -> DataFrame:
    """Severity, points and text of each shared number."""
    rank = F.col("pct_rank")
    return with_percent_rank(dupes, "duplicate_count").select(
        "phone_normalized", "duplicate_count", "pct_rank",
        F.when(rank >= 0.90, "critical").when(rank >= 0.60, "medium").otherwise("low").alias("severity"),
        F.when(rank >= 0.90, 50).when(rank >= 0.60, 30).otherwise(10).alias("penalty_points"),
        F.concat(F.lit("Phone number shared with "), F.col("duplicate_count").cast("string"),
                 F.lit(" facilities")).alias("issue_summary"))


def duplicate_phones(src: DataFrame, min_digits=7, hot_rows=None) -> DataFrame:
    """Numbers shared between records, one row per listing, graded by the percentile of their spread."""
    phones = phone_rows(src)
    dupes = shared_values(phones.where(F.length("phone_normalized") >= min_digits), "phone_normalized")
    return hot_split_join(phones, _graded_phones(dupes), "phone_normalized",
                          counts=dupes.select("phone_normalized", "n"), hot_rows=hot_rows)


def duplicate_phone_penalties(src: DataFrame, min_digits=7, hot_rows=None) -> DataFrame:
    """The same finding in the check contract, one row per (record, number): what scoring needs.

    Listings collapse to distinct pairs first; that one shuffle feeds the counts and the join. Rows without a
    record id count for nothing here and are left out.
    """
    pairs = (phone_rows(src).where((F.length("phone_normalized") >= min_digits) & F.col("unique_id").isNotNull())
             .select("unique_id", "phone_normalized").distinct())
    counts = pairs.groupBy("phone_normalized").agg(
        F.count("unique_id").alias("duplicate_count"), F.count(F.lit(1)).alias("n"))
    dupes = counts.where((F.col("duplicate_count") > 1) & (F.col("n") > 0))
    return salted_join(pairs, _graded_phones(dupes), "phone_normalized", "unique_id",
                       counts=dupes.select("phone_normalized", "n"), hot_rows=hot_rows).select(
        "unique_id", F.lit("duplicate_phones").alias("check"), "penalty_points", "issue_summary")


def core_checks(src: DataFrame, extra=()):
    """The implemented checks and further ones as (contract rows, check names, names of skipped checks).

    ``extra`` holds rules, which join the one scan, and pairs of a name and a function from the records to rows with
    the contract's columns. What does not fit the records or the contract is skipped and named, the rest goes on.
    """
    rules, skipped = usable_rules(src, [*missing_rules(), location_rule(), *(x for x in extra if isinstance(x, Rule))])
    frames = [row_checks(src, rules).select(CONTRACT)]
    names = [r.check for r in rules]
    for name, build in (x for x in extra if not isinstance(x, Rule)):
        try:
            frames.append(build(src).select(CONTRACT).where(F.col("check") == name))
            names.append(name)
        except AnalysisException:
            skipped.append(name)
    try:
        frames.append(duplicate_phone_penalties(src))
        names.append("duplicate_phones")
    except AnalysisException:
        skipped.append("duplicate_phones")
    return union_checks(frames), names, skipped


def union_checks(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, (f.select(CONTRACT) for f in frames))


# --- scoring ----------------------------------------------------------------------------------------

def severity_of_points(points="penalty_points"):
    p = F.col(points)
    return F.when(p >= 40, "critical").when(p >= 20, "high").when(p >= 10, "medium").otherwise("low")


def quality_scores(checks: DataFrame, names, computed_at=None) -> DataFrame:
    """Worst penalty per check, summed per record and taken off 100; distinct issues, sorted.

    ``names`` are the checks present, which lets one map-side-combined group-by replace the two nested
    ones. Ids are trimmed because the cleaned layers hold trimmed ids; records without an id have no row.
    """
    worst = [F.coalesce(F.max(F.when(F.col("check") == n, F.col("penalty_points"))), F.lit(0)) for n in names]
    total = reduce(lambda a, b: a + b, worst)
    grouped = (checks.where(F.col("unique_id").isNotNull())
               .groupBy(F.trim("unique_id").alias("facility_id"))
               .agg(total.cast("int").alias("total_penalty_points"),
                    F.array_sort(F.collect_set("issue_summary")).alias("issues")))
    score = F.greatest(F.lit(0), 100 - F.col("total_penalty_points"))
    out = grouped.select("facility_id", score.alias("quality_score"), quality_tier(score).alias("quality_tier"),
                         "total_penalty_points", "issues")
    return out if computed_at is None else out.withColumn("computed_at", F.lit(computed_at).cast("timestamp"))


def worst_records(checks: DataFrame, names, records: DataFrame, n=100) -> DataFrame:
    """The ``n`` lowest scores with issue counts by severity and the record's identity fields."""
    order = [F.col("quality_score"), F.desc("total_penalty_points"), F.col("facility_id")]
    worst = quality_scores(checks, names).orderBy(*order).limit(n)
    # issues are counted for the chosen ids alone; n ids are few enough to go to every task
    counts = (checks.withColumn("facility_id", F.trim("unique_id"))
              .join(F.broadcast(worst.select("facility_id")), "facility_id", "left_semi")
              .withColumn("_severity", severity_of_points())
              .groupBy("facility_id")
              .agg(*(F.count_distinct(F.when(F.col("_severity") == s, F.col("issue_summary"))).alias(f"{s}_issues")
                     for s in ("critical", "high", "medium", "low"))))
    identity = records.select(
        F.col("unique_id").alias("facility_id"), F.col("name").alias("facility_name"),
        F.col("facility_type_id").alias("facility_type"), F.col("address_city").alias("city"),
        F.col("address_state_or_region").alias("state"))
    return worst.join(counts, "facility_id").join(identity, "facility_id", "left").orderBy(*order)
