"""Filter options, paged search and record detail."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from trustdesk.functions.score import trust_tier
from trustdesk.functions.text import contains_pattern
from trustdesk.operators import ranking
from trustdesk.operators.curate import completeness_points
from trustdesk.operators.trust import facility_scores

SEARCH_COLUMNS = ("name", "description", "address_state_or_region")
WIDER_SEARCH_COLUMNS = (*SEARCH_COLUMNS, "capability")


def filter_options(gold: DataFrame):
    """Distinct states and record types, sorted."""
    def options(c, name):
        return gold.where(F.col(c).isNotNull()).select(F.col(c).alias(name)).distinct().orderBy(name)

    return {"states": options("address_state_or_region", "state"),
            "facility_types": options("facility_type_id", "facility_type")}


def page_bounds(page=1, limit=25):
    """Page from 1 and its size as (limit, offset); others are refused."""
    if int(page) < 1 or int(limit) < 1:
        raise ValueError("page and limit start at 1")
    return int(limit), (int(page) - 1) * int(limit)


def matching(gold: DataFrame, q="", state="", facility_type="", columns=SEARCH_COLUMNS) -> DataFrame:
    """Records matching the term and the set filters. An unset argument adds no predicate at all."""
    if q:
        pattern = contains_pattern(q)
        gold = gold.where(reduce(lambda a, b: a | b, (F.lower(c).like(pattern) for c in columns)))
    if state:
        gold = gold.where(F.col("address_state_or_region") == state)
    if facility_type:
        gold = gold.where(F.col("facility_type_id") == facility_type)
    return gold


#: How each sort orders records: column and whether it descends; the id tells equal ones apart.
SORTS = {"score": ("score", True), "completeness": ("completeness", True), "name": ("facility_name", False)}


def found_records(gold: DataFrame, signals: DataFrame, scores: DataFrame, q="", state="", facility_type="", min_score=0,
                  contradictions_only=False, sort="score", tier=None, columns=SEARCH_COLUMNS):
    """All matching records with their scores, and the key that ``sort`` orders them by.

    ``min_score`` is 0..100 and counts a record without score as 0. ``sort`` is score, completeness or name.
    Records are filtered before they meet their signals.
    """
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {sorted(SORTS)}")
    found = matching(gold, q, state, facility_type, columns)
    if sort == "completeness":
        found = found.withColumn("completeness", completeness_points())
    rows = facility_scores(found, signals, scores, keep=["completeness"] if sort == "completeness" else [])
    if float(min_score):
        rows = rows.where(F.coalesce("score", F.lit(0.0)) >= float(min_score) / 100)
    if contradictions_only:
        rows = rows.where(F.col("has_contradiction") == 1)
    if tier:
        rows = rows.where(trust_tier("score") == tier)
    return rows, ranking.sort_key(SORTS[sort], ("facility_id", False))


def search(gold: DataFrame, signals: DataFrame, scores: DataFrame, page=1, limit=25, shallow=ranking.SHALLOW, **filters) -> DataFrame:
    """One page of records, best score first; ``filters`` are those of ``found_records``.

    Pages that end within ``shallow`` rows are a top list; deeper ones sort the range they lie in only.
    """
    rows, key = found_records(gold, signals, scores, **filters)
    size, offset = page_bounds(page, limit)
    return ranking.page(rows, key, offset, size, shallow).withColumnRenamed("score", "overall_trust_score")


def search_after(gold: DataFrame, signals: DataFrame, scores: DataFrame, cursor, limit=25, **filters) -> DataFrame:
    """The page behind a record, given by the value of its sort column and its id, at the cost of the first page."""
    rows, key = found_records(gold, signals, scores, **filters)
    value, last_id = cursor
    if value is not None and SORTS[filters.get("sort", "score")][1]:
        value = -value
    return ranking.after(rows, key, (value, last_id), limit).drop("_cursor").withColumnRenamed("score", "overall_trust_score")


DETAIL_COLUMNS = ["address_city", "description", "capability", "procedure", "equipment", "capacity",
                  "year_established", "number_doctors", "official_phone", "email", "official_website",
                  "address_line1", "overridden_fields"]


def detail(facility_id: str, gold: DataFrame, signals: DataFrame, scores: DataFrame):
    """One record's profile with its score, and its signals, as two DataFrames.

    The id predicate sits on bare columns of all three inputs, so it reaches their scans.
    """
    own = F.col("facility_id") == facility_id
    record = facility_scores(gold.where(F.col("unique_id") == facility_id), signals.where(own), scores.where(own),
                             keep=DETAIL_COLUMNS)
    return {
        "facility": record.withColumnRenamed("address_city", "district").withColumnRenamed(
            "score", "overall_trust_score"),
        "trust_signals": signals.where(own).orderBy("dimension"),
    }
