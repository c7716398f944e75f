"""Analyst state: latest actions, review queue, board, validation and score corrections."""

from pyspark.sql import DataFrame, functions as F

from trustdesk.operators.curate import latest_by
from trustdesk.operators.trust import constant_rows
from trustdesk.schemas import ACTION_TYPES, REVIEW_STATUSES, UUID_PATTERN

ACTION_KEY = ("facility_id", "analyst_id", "action_type", "dimension")


def latest_actions(actions: DataFrame, keys=ACTION_KEY, tiebreak="seq") -> DataFrame:
    """Latest action per key; a missing dimension counts as the empty one."""
    filled = actions.withColumn("dimension", F.coalesce("dimension", F.lit("")))
    return latest_by(filled, list(keys), tiebreak=tiebreak)


def is_shortlisted():
    return (F.col("action_type") == "shortlist") & (F.col("content") == "added")


def is_flagged(flag_rule="flagged"):
    """``flagged`` matches that literal; ``any_nonblank`` also counts flags stored with a free-text reason."""
    flag = F.col("action_type") == "flag"
    if flag_rule == "any_nonblank":
        return flag & (F.trim("content") != "")
    return flag & (F.col("content") == "flagged")


def action_counts(actions: DataFrame, keys=("facility_id", "action_type", "dimension"), flag_rule="flagged",
                  tiebreak="seq") -> DataFrame:
    """Records currently shortlisted and flagged: one flag per record first, then plain sums."""
    latest = latest_actions(actions, keys, tiebreak)
    per_record = latest.groupBy("facility_id").agg(
        F.max(F.when(is_shortlisted(), 1).otherwise(0)).alias("s"),
        F.max(F.when(is_flagged(flag_rule), 1).otherwise(0)).alias("f"))
    return per_record.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("int").alias("shortlisted_count"),
                          F.coalesce(F.sum("f"), F.lit(0)).cast("int").alias("flagged_count"))


def action_state(actions: DataFrame, analyst_id=None, flag_rule="flagged", tiebreak="seq") -> DataFrame:
    """Shortlist, flag and latest note per (record, analyst), or per record when all analysts count as one."""
    keys = ["facility_id", "analyst_id"]
    if analyst_id is not None:
        actions = actions.where(F.col("analyst_id") == analyst_id)
    latest = latest_actions(actions, tiebreak=tiebreak)
    note = F.max(F.when(F.col("action_type") == "note", F.struct("updated_at", tiebreak, "content")))
    return latest.groupBy(*keys).agg(
        F.max(F.coalesce(is_shortlisted(), F.lit(False))).alias("shortlisted"),
        F.max(F.coalesce(is_flagged(flag_rule), F.lit(False))).alias("flagged"), note["content"].alias("note"))


def review_queue(actions: DataFrame, fs: DataFrame, analyst_id=None, flag_rule="flagged", tiebreak="seq") -> DataFrame:
    """Flagged and shortlisted records of each analyst with score, note and contradiction."""
    acted = action_state(actions, analyst_id, flag_rule, tiebreak).where(F.col("flagged") | F.col("shortlisted"))
    listed = F.explode(F.array_compact(F.array(
        F.when(F.col("flagged"), F.lit("flagged")), F.when(F.col("shortlisted"), F.lit("shortlisted")))))
    return (acted.withColumn("list", listed)
            .join(fs, "facility_id")
            .select("analyst_id", "list", "facility_id", "facility_name", "state", "facility_type", "score", "note",
                    "has_contradiction"))


def search_state(rows: DataFrame, actions: DataFrame, analyst_id=None, tiebreak="seq") -> DataFrame:
    """Adds shortlist, flag and note state to search rows; with no analyst given, anyone's state counts."""
    state = action_state(actions, analyst_id, tiebreak=tiebreak).groupBy("facility_id").agg(
        F.max("shortlisted").alias("shortlisted"), F.max("flagged").alias("flagged"),
        F.max(F.when(F.col("note").isNotNull(), True).otherwise(False)).alias("has_note"))
    joined = rows.join(state, "facility_id", "left")
    return joined.select(*rows.columns, *(F.coalesce(c, F.lit(False)).alias(c)
                                          for c in ("shortlisted", "flagged", "has_note")))


# --- board ------------------------------------------------------------------------------------------

def review_state(log: DataFrame, tiebreak="seq") -> DataFrame:
    """One row per record: its latest accepted move."""
    return latest_by(log, ["facility_id"], tiebreak=tiebreak)


def _card(df, **changed):
    fields = {"facility_id": None, "facility_name": None, "facility_type": None, "state": None, "status": None,
              "parked_reason": None, "assigned_to": None, "notes": None, "updated_by": None, "updated_at": None}
    return df.select(*((changed[f] if f in changed else F.col(f)).alias(f) for f in fields))


def _identity(gold):
    return gold.select(F.col("unique_id").alias("facility_id"), F.col("name").alias("facility_name"),
                       F.col("facility_type_id").alias("facility_type"),
                       F.col("address_state_or_region").alias("state"))


def unstarted(gold: DataFrame, review: DataFrame = None, limit=None) -> DataFrame:
    """All cards not yet started, or the first ``limit`` by name. Without ``review`` every record counts as such."""
    cards = _identity(gold)
    if review is not None:
        cards = cards.join(review.select("facility_id"), "facility_id", "left_anti")
    none = F.lit(None).cast("string")
    cards = _card(cards, status=F.lit("not_started"), parked_reason=none, assigned_to=none, notes=none,
                  updated_by=none, updated_at=none)
    return cards if limit is None else cards.orderBy(F.asc_nulls_first("facility_name"), "facility_id").limit(limit)


def board(gold: DataFrame, review: DataFrame, status=None, assigned_to=None) -> DataFrame:
    """Cards of reviewed records; a record missing from the table shows its id as name."""
    if status is not None:
        review = review.where(F.col("status") == status)
    if assigned_to is not None:
        review = review.where(F.col("assigned_to") == assigned_to)
    cards = review.join(_identity(gold), "facility_id", "left")
    return _card(cards, facility_name=F.coalesce("facility_name", "facility_id"),
                 updated_at=F.col("updated_at").cast("string"))


def board_counts(gold: DataFrame, review: DataFrame) -> DataFrame:
    """Cards per column, every column listed; not started are the records without a review row."""
    moved = review.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    waiting = (gold.join(review.select(F.col("facility_id").alias("unique_id")), "unique_id", "left_anti")
               .agg(F.count(F.lit(1)).alias("n")).select(F.lit("not_started").alias("status"), "n"))
    counts = moved.unionByName(waiting).groupBy("status").agg(F.sum("n").alias("cards"))
    names = constant_rows(gold, list(enumerate(REVIEW_STATUSES, 1)), ["position", "status"])
    return names.join(counts, "status", "left").select("position", "status", F.coalesce("cards", F.lit(0)).alias("cards"))


# --- validation -------------------------------------------------------------------------------------

def validate_moves(moves: DataFrame) -> DataFrame:
    """Adds ``error``: NULL for acceptable board moves."""
    blank = F.trim(F.coalesce("parked_reason", F.lit(""))) == ""
    return moves.withColumn("error", F.when(
        F.col("status").isNull() | ~F.col("status").isin(REVIEW_STATUSES), "unknown status").when(
        (F.col("status") == "parked") & blank, "parked needs a reason"))


def validate_actions(actions: DataFrame, require_uuid_analyst=False) -> DataFrame:
    """Adds ``error``: NULL for acceptable actions."""
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    kind, score = F.col("action_type"), F.col("override_score")
    error = F.when(kind.isNull() | ~kind.isin(ACTION_TYPES), "unknown action type")
    if require_uuid_analyst:
        error = error.when(F.col("analyst_id").isNull() | ~F.col("analyst_id").rlike(UUID_PATTERN),
                           "analyst id is not a UUID")
    error = (error.when((kind == "override") & blank, "override needs a reason")
             .when((kind == "override") & (score.isNull() | ~score.between(0, 100)), "override score must be 0 to 100")
             .when((kind == "flag") & blank, "flag needs a reason"))
    return actions.withColumn("error", error)


def accepted(checked: DataFrame):
    """(valid rows, rejected rows) of a validated frame."""
    ok = F.col("error").isNull()
    return checked.where(ok).drop("error"), checked.where(~ok)


# --- corrections ------------------------------------------------------------------------------------

CLEANUP_PREFIX = "LLM cleanup from bronze: "  # fixed value: marks corrections that came from suggestions


def suggestions_to_overrides(suggestions: DataFrame, analyst_id, at) -> DataFrame:
    """Accepted cleanup suggestions as rows for the override log."""
    return suggestions.select(
        "facility_id", "field_name", F.col("suggested_value").alias("new_value"), F.lit(analyst_id).alias("analyst_id"),
        F.concat(F.lit(CLEANUP_PREFIX), F.col("reason")).alias("reason"), F.lit(at).cast("timestamp").alias("updated_at"))


def changed_since(overrides: DataFrame, ts) -> DataFrame:
    """Ids with a correction after ``ts``."""
    return overrides.where(F.col("updated_at") > F.lit(ts).cast("timestamp")).select("facility_id").distinct()


def rescore(previous: DataFrame, gold: DataFrame, changed: DataFrame, score) -> DataFrame:
    """Recompute only changed records and keep the other rows of ``previous``.

    ``score`` maps a gold subset to score rows with the columns of ``previous``.
    """
    redo = gold.join(changed.withColumnRenamed("facility_id", "unique_id"), "unique_id", "left_semi")
    return previous.join(changed, "facility_id", "left_anti").unionByName(score(redo).select(previous.columns))


def apply_score_overrides(signals: DataFrame, actions: DataFrame, tiebreak="seq") -> DataFrame:
    """The latest valid score correction of an analyst, over 100, replaces the signal's score."""
    valid, _ = accepted(validate_actions(actions.where(F.col("action_type") == "override")))
    latest = latest_actions(valid, ("facility_id", "dimension"), tiebreak).select(
        "facility_id", "dimension", (F.col("override_score") / 100).alias("_analyst_score"))
    return (signals.join(latest, ["facility_id", "dimension"], "left")
            .select(*(F.coalesce("_analyst_score", "trust_score").alias(c) if c == "trust_score" else c
                      for c in signals.columns), F.col("_analyst_score").isNotNull().alias("overridden")))
