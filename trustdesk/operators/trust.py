"""Trust score per record, dashboards and statistics over it."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from trustdesk.functions.score import int_tier, score_to_int, share
from trustdesk.schemas import DIMENSIONS, SCORE_BUCKETS

# --- fixed values: the trust score's weights ---
FEW_SIGNALS_PENALTY = 0.10      # per missing signal below three
MISSING_FIELD_PENALTY = 0.03    # per empty field below
CHECKED_FIELDS = ["official_phone", "email", "official_website", "year_established", "capacity", "number_doctors",
                  "description"]
QUALITY_DIVISOR = 400.0
HIGHEST_SCORE = 0.90
# -----------------------------------------------


def signal_summary(signals: DataFrame) -> DataFrame:
    """Signals reduced to one row per record, so that later joins are one to one."""
    return signals.groupBy("facility_id").agg(
        F.avg("trust_score").alias("_mean"), F.count("trust_score").alias("_scored"),
        F.max(F.when(F.col("contradiction"), 1).otherwise(0)).alias("_contradiction"),
        F.count("dimension").alias("_signals"))


def facility_scores(gold: DataFrame, signals: DataFrame, scores: DataFrame, keep=(), digits=6) -> DataFrame:
    """Blended trust score per record, any-contradiction flag and signal count.

    The mean signal score loses points for few signals, empty fields and low record quality and is capped.
    Records that passed every quality check have no quality row and count as 100. ``digits`` rounds away
    floating-point noise of the mean, which depends on the order rows are added up in. Empty fields are counted before
    the joins, so that no text is carried through them.
    """
    empty = reduce(lambda a, b: a + b, (F.when(F.col(c).isNull(), 1).otherwise(0) for c in CHECKED_FIELDS))
    scored = F.coalesce("_scored", F.lit(0))
    blended = (F.col("_mean") - F.greatest(F.lit(0), 3 - scored) * FEW_SIGNALS_PENALTY
               - F.col("_empty") * MISSING_FIELD_PENALTY
               - (100 - F.coalesce("quality_score", F.lit(100))) / QUALITY_DIVISOR)
    inside = F.least(F.greatest(F.lit(0.0), F.least(F.lit(1.0), blended)), F.lit(HIGHEST_SCORE))
    records = gold.select(F.col("unique_id").alias("facility_id"), "name", "address_state_or_region", "facility_type_id",
                          empty.alias("_empty"), *keep)
    return (records.join(signal_summary(signals), "facility_id", "left")
            .join(scores.select("facility_id", "quality_score"), "facility_id", "left")
            .select("facility_id", F.col("name").alias("facility_name"),
                    F.col("address_state_or_region").alias("state"), F.col("facility_type_id").alias("facility_type"),
                    F.round(F.when(scored > 0, inside), digits).alias("score"),
                    F.coalesce("_contradiction", F.lit(0)).alias("has_contradiction"),
                    F.coalesce("_signals", F.lit(0)).cast("int").alias("signal_count"), *keep))


# --- dashboard over records -------------------------------------------------------------------------

def _n(condition=None):
    return F.count(F.lit(1) if condition is None else F.when(condition, 1)).cast("int")


def summary(fs: DataFrame) -> DataFrame:
    return fs.agg(_n().alias("total"), F.coalesce(F.sum("has_contradiction"), F.lit(0)).cast("int").alias(
        "contradiction_count"), F.round(F.avg("score") * 100).cast("int").alias("avg_score"))


def constant_rows(df: DataFrame, rows, names) -> DataFrame:
    """A fixed handful of rows as an inline relation, known to the optimizer with its size."""
    values = ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def histogram(fs: DataFrame, points=None) -> DataFrame:
    """Records per score bucket on the rounded score, empty buckets included.

    Each score maps to its bucket by expression; only the eight bucket counts are joined.
    """
    points = F.round(F.col("score") * 100).cast("int") if points is None else points
    position = reduce(lambda e, b: e.when(points.between(b[1][1], b[1][2]), b[0]),
                      enumerate(SCORE_BUCKETS[1:], 2), F.when(points.between(*SCORE_BUCKETS[0][1:3]), 1))
    counts = (fs.select(position.alias("position")).where(F.col("position").isNotNull())
              .groupBy("position").agg(_n().alias("count")))
    buckets = constant_rows(fs, [(i, label, tier) for i, (label, _, _, tier) in enumerate(SCORE_BUCKETS, 1)],
                            ["position", "label", "tier"])
    return buckets.join(counts, "position", "left").select(
        "position", "label", F.coalesce("count", F.lit(0)).alias("count"), "tier")


def tiers(fs: DataFrame) -> DataFrame:
    """Tier counts on the raw score; 0.695 rounds into bucket 70-79 but stays in the middle tier here."""
    s = F.col("score")
    return fs.agg(_n(s >= 0.7).alias("high_count"), _n((s >= 0.4) & (s < 0.7)).alias("med_count"),
                  _n(s < 0.4).alias("low_count"), _n(s.isNull()).alias("insuff_count"), _n().alias("total"))


def dimension_means(signals: DataFrame) -> DataFrame:
    """Whole-number mean per dimension; all dimensions are listed, unanswered ones with NULL."""
    means = (signals.where(F.col("trust_score").isNotNull()).groupBy(F.col("dimension").alias("dim"))
             .agg(F.round(F.round(F.avg("trust_score"), 9) * 100).cast("int").alias("avg")))
    names = constant_rows(signals, list(enumerate(DIMENSIONS, 1)), ["position", "dim"])
    return names.join(means, "dim", "left").select("position", "dim", "avg")


def by_type(fs: DataFrame, n=8) -> DataFrame:
    return (fs.where(F.col("facility_type").isNotNull()).groupBy(F.col("facility_type").alias("type"))
            .agg(_n().alias("count"), F.sum("has_contradiction").cast("int").alias("contradictions"))
            .orderBy(F.desc("count"), "type").limit(n))


def extremes(fs: DataFrame, n=3, best=True) -> DataFrame:
    """Highest or lowest scored records; ties go by name, then id."""
    return (fs.where(F.col("score").isNotNull())
            .orderBy(F.desc("score") if best else F.asc("score"), "facility_name", "facility_id").limit(n)
            .withColumn("points", F.round(F.col("score") * 100).cast("int")))


def dashboard(fs: DataFrame, signals: DataFrame, actions: DataFrame = None, mode="records",
              flag_rule="flagged", tiebreak="seq"):
    """Every panel as a DataFrame. ``mode='records'`` works on the blended score, ``mode='signals'`` on the
    plain mean of signal scores. Persist ``fs`` when several panels are shown."""
    if mode == "signals":
        panels = signal_dashboard(fs, signals)
    else:
        panels = {
            "summary": summary(fs), "histogram": histogram(fs), "tiers": tiers(fs), "dims": dimension_means(signals),
            "types": by_type(fs), "top": extremes(fs), "bottom": extremes(fs, best=False)}
    if actions is not None:
        from trustdesk.operators.workbench import action_counts
        panels["actions"] = action_counts(actions, flag_rule=flag_rule, tiebreak=tiebreak)
    return panels


# --- dashboard over signals -------------------------------------------------------------------------

def _usable_points(signals):
    usable = (F.col("confidence_tier") != "insufficient_data") & F.col("trust_score").isNotNull()
    return signals.where(usable).withColumn("points", score_to_int("trust_score"))


def simple_scores(signals: DataFrame) -> DataFrame:
    """Plain mean of whole-number scores per record, without insufficient signals."""
    return _usable_points(signals).groupBy("facility_id").agg(
        F.round(F.avg("points")).cast("int").alias("score"))


def signal_dashboard(records: DataFrame, signals: DataFrame):
    """``records`` has facility_id, facility_name, facility_type, has_contradiction and optionally score (0..1).

    The average is taken over signals, not over records; tiers and buckets use whole-number scores.
    """
    if "score" in records.columns:
        points = F.coalesce(score_to_int(F.col("r.score")), F.col("s.score"))
    else:
        points = F.col("s.score")
    rows = (records.alias("r").join(simple_scores(signals).alias("s"), "facility_id", "left")
            .select("facility_id", "r.facility_name", "r.facility_type", "r.has_contradiction",
                    points.alias("points")))
    usable = _usable_points(signals)
    tier = int_tier("points")
    mean = usable.agg(F.round(F.avg("points")).cast("int").alias("avg_score")).withColumn("_one", F.lit(1))
    totals = rows.agg(_n().alias("total"), _n(F.col("has_contradiction") == 1).alias("contradiction_count"),
                      *(_n(tier == t).alias(f"{t}_count") for t in ("high", "med", "low", "insuff")))
    dims = usable.groupBy(F.col("dimension").alias("dim")).agg(F.round(F.avg("points")).cast("int").alias("avg"))
    names = constant_rows(signals, list(enumerate(DIMENSIONS, 1)), ["position", "dim"])
    scored = rows.where(F.col("points").isNotNull())
    return {
        "summary": totals.withColumn("_one", F.lit(1)).join(mean, "_one").drop("_one"),
        "histogram": histogram(rows, F.col("points")),
        "dims": names.join(dims, "dim", "left").select("position", "dim", "avg"),
        "types": rows.where(F.col("facility_type").isNotNull()).groupBy(F.col("facility_type").alias("type")).agg(
            _n().alias("count"), _n(F.col("has_contradiction") == 1).alias("contradictions")),
        "top": scored.orderBy(F.desc("points"), "facility_id").limit(3),
        "bottom": scored.orderBy("points", F.desc("facility_id")).limit(3),
    }


# --- statistics -------------------------------------------------------------------------------------

def stats_totals(fs: DataFrame) -> DataFrame:
    """Records and records with a contradiction; one row per record makes plain counts enough."""
    return fs.agg(_n().alias("total_facilities"),
                  F.coalesce(F.sum("has_contradiction"), F.lit(0)).cast("int").alias("contradiction_count"))


def tier_percentages(fs: DataFrame) -> DataFrame:
    t = tiers(fs)
    return t.select(*(share(F.col(f"{n}_count"), F.col("total")).alias(a) for n, a in (
        ("high", "high_trust_pct"), ("med", "med_trust_pct"), ("low", "low_trust_pct"), ("insuff", "insuff_pct"))))


def stats_dimensions(signals: DataFrame) -> DataFrame:
    """Mean per dimension to one decimal, best first."""
    return (signals.where(F.col("trust_score").isNotNull()).groupBy("dimension")
            .agg(F.round(F.round(F.avg("trust_score"), 9) * 100, 1).alias("avg_score"))
            .orderBy(F.desc("avg_score"), "dimension"))


def stats_dimension_range(signals: DataFrame) -> DataFrame:
    """Best and worst dimension; at most four rows reach this aggregate."""
    ranked = stats_dimensions(signals)
    best = F.struct(-F.col("avg_score"), F.col("dimension"))
    return ranked.agg(F.min_by("dimension", best).alias("top_dimension"),
                      F.max_by("dimension", best).alias("bottom_dimension"))


def stats_top_type(fs: DataFrame, more_than=2) -> DataFrame:
    """Type with the highest share of contradicted records among types with enough records."""
    kinds = (fs.where(F.col("facility_type").isNotNull()).groupBy("facility_type")
             .agg(_n().alias("total"), F.sum("has_contradiction").cast("int").alias("contradictions"))
             .where(F.col("total") > more_than))
    return kinds.orderBy((F.col("contradictions") / F.col("total")).desc(), "facility_type").limit(1)
