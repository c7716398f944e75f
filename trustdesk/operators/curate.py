"""Analyst-ready layer: one row per valid id, corrections merged; row-level issues."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trustdesk.functions.text import is_uuid
from trustdesk.operators.skew import hot_split_join
from trustdesk.schemas import COMPLETENESS_FIELDS, OVERRIDE_FIELDS, RECORD_TYPES


def first_by(df: DataFrame, keys, order) -> DataFrame:
    """First row per key. ``row_number() = 1`` lets Spark keep one row per key and map task before the
    shuffle (WindowGroupLimit), so a key with very many rows never meets in one task."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def latest_by(log: DataFrame, keys, order="updated_at", tiebreak="seq") -> DataFrame:
    """Latest row per key of an append-only log; ``tiebreak`` settles equal times."""
    return first_by(log, keys, [F.desc(order), F.desc(tiebreak)])


def completeness_points() -> Column:
    """How many of the twelve core fields are filled in and acceptable."""
    flags = [F.col(c).isNotNull() for c in COMPLETENESS_FIELDS]
    flags += [F.col("address_country_code") == "IN", F.col("facility_type_id").isin(RECORD_TYPES)]
    return reduce(lambda a, b: a + b, (F.when(f, 1).otherwise(0) for f in flags))


def best_by_completeness(df: DataFrame, key="unique_id", points: Column = None, order=(), tiebreak=()) -> DataFrame:
    """The most complete copy of each record with a well-formed id."""
    points = completeness_points() if points is None else points
    order = [points.desc(), *(F.desc(c) for c in order), *(F.asc_nulls_last(c) for c in tiebreak)]
    return first_by(df.where(is_uuid(key)), [key], order)


def pivot_overrides(overrides: DataFrame, fields=OVERRIDE_FIELDS, tiebreak="seq") -> DataFrame:
    """Latest value per (record, field) as one wide row per record, plus the list of corrected fields.

    The latest value is the greatest (time, tiebreak) struct, so a single group-by with map-side combine
    resolves the log, pivots it and lists the fields.
    """
    versions = F.struct("updated_at", tiebreak, "new_value")
    latest = {f: F.max(F.when(F.col("field_name") == f, versions)) for f in fields}
    return overrides.groupBy("facility_id").agg(
        F.array_sort(F.collect_set("field_name")).alias("overridden_fields"),
        *(v["new_value"].alias(f"{f}_ov") for f, v in latest.items()))


def override_latest(overrides: DataFrame, tiebreak="seq") -> DataFrame:
    """Latest override per (record, field)."""
    return latest_by(overrides, ["facility_id", "field_name"], tiebreak=tiebreak)


# copies of one record that tie on completeness and time are told apart by their contents
GOLD_TIEBREAK = ["name", "official_phone", "email", "official_website", "address_line1", "description"]


def to_gold(silver: DataFrame, overrides: DataFrame, built_at=None, tiebreak="seq",
            record_tiebreak=GOLD_TIEBREAK) -> DataFrame:
    """Best copy per valid id with the latest corrections applied.

    A NULL or uncastable correction falls back to the cleaned value but stays listed.
    """
    best = best_by_completeness(silver, order=["_silver_processed_at"], tiebreak=record_tiebreak)
    wide = pivot_overrides(overrides, tiebreak=tiebreak).withColumnRenamed("facility_id", "unique_id")
    joined = best.join(wide, "unique_id", "left")

    def merged(c):
        if c not in OVERRIDE_FIELDS:
            return F.col(c)
        return F.coalesce(F.col(f"{c}_ov").try_cast(OVERRIDE_FIELDS[c]), F.col(c)).alias(c)

    columns = [merged(c) for c in silver.columns if c != "_silver_processed_at"]
    listed = F.coalesce("overridden_fields", F.array().cast("array<string>")).alias("overridden_fields")
    built = F.lit(built_at).cast("timestamp") if built_at is not None else F.col("_silver_processed_at")
    return joined.select(*columns, listed, built.alias("_gold_built_at"))


def issue_rules():
    """(condition, field, issue type, severity, raw value column, suggestion, rule name)."""
    valid = is_uuid("unique_id")
    kind, code = F.col("facility_type_id"), F.col("address_country_code")
    # fixed values: issue types, severities, suggestions and rule names
    return [
        (~valid, "unique_id", "invalid_facility_id", "critical", None, "unique_id_uuid_validation"),
        (valid & (F.col("_copies") > 1), "unique_id", "duplicate_facility_id", "medium",
         "Deduped in facilities_gold by completeness score", "unique_id_duplicate_detection"),
        (valid & F.col("name").isNull(), "name", "missing_facility_name", "high", None,
         "name_required_for_identity"),
        (valid & (kind.isNull() | ~kind.isin(RECORD_TYPES)), "facility_type_id", "invalid_facility_type",
         "medium", None, "facility_type_allowlist"),
        (valid & (code != "IN"), "address_country_code", "unexpected_country_code", "medium", "IN",
         "india_dataset_country_code_check"),
    ]


def count_copies(silver: DataFrame, key="unique_id", hot_rows=None):
    """Rows per id attached to each row, by a counted join instead of a window over the id."""
    counts = silver.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return hot_split_join(silver, counts.withColumnRenamed("n", "_copies"), key, how="left",
                          counts=counts, hot_rows=hot_rows)


def issue_rows(silver: DataFrame, rules=None, detected_at=None, hot_rows=None) -> DataFrame:
    """One row per (record row, failed rule), all rules in one pass."""
    needed = silver.select("unique_id", "name", "facility_type_id", "address_country_code")
    fired = F.array_compact(F.array(*(
        F.when(cond, F.struct(
            F.lit(field).alias("field_name"), F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"),
            F.col(field).alias("raw_value"), F.lit(suggestion).cast("string").alias("suggested_value"),
            F.lit(rule).alias("rule_name")))
        for cond, field, kind, severity, suggestion, rule in (rules or issue_rules()))))
    out = count_copies(needed, hot_rows=hot_rows).select(F.col("unique_id").alias("facility_id"), F.inline(fired))
    return out if detected_at is None else out.withColumn("detected_at", F.lit(detected_at).cast("timestamp"))
