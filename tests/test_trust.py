import json

import pytest
from pyspark.sql import functions as F

from trustdesk.operators import search, signals as sig, trust, workbench as desk
from trustdesk.plans.queries import Data
from trustdesk.schemas import CONFIDENCE_TIERS

SIGNALS = "facility_id string, dimension string, trust_score double, confidence_tier string, contradiction boolean"


@pytest.fixture(scope="module")
def fs(spark, sf_dir):
    d = Data(spark, sf_dir)
    return trust.facility_scores(d.gold, d.signals, d.quality_scores).persist()


def test_dashboard_over_signals(spark):
    """The one worked example with numbers: two records, four signals, two actions."""
    records = spark.createDataFrame(
        [("a", "A", "clinic", 0, 0.82), ("b", "B", "hospital", 1, 0.36)],
        "facility_id string, facility_name string, facility_type string, has_contradiction int, score double")
    signals = spark.createDataFrame(
        [("a", "capability", 0.8, "high", False), ("a", "equipment", 0.6, "medium", False),
         ("b", "capability", 0.4, "low", True), ("b", "procedure", None, "insufficient_data", False)], SIGNALS)
    actions = spark.createDataFrame(
        [("a", "x", "shortlist", None, "added", "2024-01-01", 1), ("b", "x", "flag", None, "flagged", "2024-01-01", 2)],
        "facility_id string, analyst_id string, action_type string, dimension string, content string, updated_at string, seq int")
    panels = trust.dashboard(records, signals, actions, mode="signals")
    s = panels["summary"].first()
    assert (s.total, s.contradiction_count, s.avg_score) == (2, 1, 60)
    assert (s.high_count, s.med_count, s.low_count, s.insuff_count) == (1, 0, 1, 0)
    assert panels["actions"].first().asDict() == {"shortlisted_count": 1, "flagged_count": 1}
    assert panels["top"].first().facility_id == "a" and panels["bottom"].first().facility_id == "b"
    assert {tuple(r) for r in panels["types"].collect()} == {("clinic", 1, 0), ("hospital", 1, 1)}
    assert {r.dim: r.avg for r in panels["dims"].collect()} == {
        "capability": 60, "equipment": 60, "procedure": None, "completeness": None}


def test_scores_stay_in_range_and_buckets_add_up(fs):
    low, high, scored = fs.agg(F.min("score"), F.max("score"), F.count("score")).first()
    assert 0 <= low and high <= 0.90
    assert trust.histogram(fs).agg(F.sum("count")).first()[0] == scored


def test_bucket_rounds_and_tier_does_not(spark):
    fs = spark.createDataFrame([(0.695, "a")], "score double, facility_id string")
    assert trust.histogram(fs).where("count = 1").first().label == "70-79"
    assert trust.tiers(fs).first().med_count == 1


def test_blend(spark, sf_dir):
    d = Data(spark, sf_dir)
    one = d.gold.limit(1).withColumn("unique_id", F.lit("a"))
    for c in trust.CHECKED_FIELDS:
        one = one.withColumn(c, F.lit(1) if c in ("year_established", "capacity", "number_doctors") else F.lit("x"))
    signals = lambda *s: spark.createDataFrame([("a", "capability", x, "high", False) for x in s], SIGNALS)
    none = spark.createDataFrame([], "facility_id string, quality_score int")
    poor = spark.createDataFrame([("a", 60)], "facility_id string, quality_score int")
    score = lambda s, q: trust.facility_scores(one, s, q).first().score
    assert score(signals(1.0, 1.0, 1.0), none) == 0.9          # capped
    assert score(signals(0.8, 0.6, 0.4), poor) == 0.5          # 0.6 - 40/400
    assert score(signals(0.5), none) == 0.3                    # two signals short
    assert score(signals(0.1), poor) == 0.0                    # never below zero
    assert score(signals(None), none) is None


def test_search_guards(spark, sf_dir, fs):
    d = Data(spark, sf_dir)
    assert search.page_bounds(1, 1000) == (1000, 0) and search.page_bounds(3, 10) == (10, 20)
    for page, limit in ((0, 10), (1, 0)):
        with pytest.raises(ValueError):
            search.page_bounds(page, limit)
    first = search.search(d.gold, d.signals, d.quality_scores, limit=10).collect()
    second = search.search(d.gold, d.signals, d.quality_scores, limit=10, page=2).collect()
    ids = [r.facility_id for r in first + second]
    assert len(set(ids)) == 20
    values = [r.overall_trust_score for r in first + second]
    assert values == sorted(values, reverse=True)
    with pytest.raises(ValueError):
        search.search(d.gold, d.signals, d.quality_scores, sort="colour")
    wild = search.matching(d.gold, q="car_").count()
    assert wild >= search.matching(d.gold, q="care").count() > 0


def answers(spark, *texts):
    return spark.createDataFrame([(f"r{i}", t, "m", None, "2024-01-01 00:00:00") for i, t in enumerate(texts)],
                                 "facility_id string, raw_response string, extraction_model string, error_message string, responded_at string")


def test_parsing_routes_bad_answers(spark):
    item = {"dimension": "capability", "trust_score": 0.5, "confidence_tier": "medium", "evidence_text": "x",
            "source_field": "capability", "contradiction": True, "contradiction_detail": None}
    less = lambda *keys: {k: v for k, v in item.items() if k not in keys}
    wrap = lambda *items: json.dumps({"dimensions": list(items)})
    good, errors = sig.parse_signals(answers(
        spark, wrap(item), wrap(less("contradiction", "trust_score")), wrap({**item, "trust_score": "0.25"}), wrap(),
        "not json", '{"dims": []}', wrap(item, less("dimension")), wrap(less("confidence_tier")),
        wrap({**item, "trust_score": "high"}), wrap(item)[:40], wrap(item) + " and more", None, wrap({**item, "dimension": "staff"}),
        wrap(item) + "\r\n \t"))
    got = {r.facility_id: r for r in good.collect()}
    assert set(got) == {"r0", "r1", "r2", "r13"}
    assert got["r0"].contradiction and got["r1"].contradiction is False and got["r1"].trust_score is None
    assert got["r2"].trust_score == 0.25
    assert {r.facility_id for r in errors.collect()} == {f"r{i}" for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12)}
    assert sig.valid_dimensions(good).count() == 4


def test_fallback_scorer(spark, sf_dir):
    raw = Data(spark, sf_dir).raw

    def broken(batch):
        raise RuntimeError("limit reached")

    some_bad = lambda batch: ["not json" if i % 2 else a for i, a in enumerate(sig.rule_scorer(batch))]
    models = lambda df: {r[0]: r[1] for r in df.groupBy("extraction_model").count().collect()}
    assert models(sig.score(raw, broken, sig.rule_scorer)) == {"fallback": raw.count()}
    mixed = sig.score(raw, some_bad, sig.rule_scorer)
    assert set(models(mixed)) == {"primary", "fallback"}
    assert sig.parse_signals(mixed.withColumn("responded_at", F.lit("2024-01-01")))[1].isEmpty()
    failed = sig.parse_signals(sig.score(raw, broken).withColumn("responded_at", F.lit("2024-01-01")))[1]
    assert failed.count() == raw.count() and "limit reached" in failed.first().error_message


def test_segments_skip_overlaps_and_rebuild_the_text(spark, sf_dir):
    marks = spark.createDataFrame(
        [("a", "f", "one two three four", m) for m in ("two three", "three four", "two three", "one", "absent", "")]
        + [("b", "f", "whole", "whole")], "facility_id string, field_name string, text string, match string")
    got = {}
    for r in sig.segments(marks).orderBy("facility_id", "position").collect():
        got.setdefault(r.facility_id, []).append((r.kind, r.text))
    assert got["a"] == [("highlight", "one"), ("plain", " "), ("highlight", "two three"), ("plain", " four")]
    assert got["b"] == [("highlight", "whole")]
    d = Data(spark, sf_dir)
    marks = sig.highlights(d.gold, d.signals)
    rebuilt = sig.segments(marks).groupBy("facility_id", "field_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]), "").alias("text"))
    assert rebuilt.exceptAll(marks.where("match <> ''").select("facility_id", "field_name", "text").distinct()).isEmpty()


def test_lowest_tier_is_by_rank(spark):
    signals = spark.createDataFrame([("a", t) for t in ("high", "medium")] + [("b", t) for t in CONFIDENCE_TIERS],
                                    "facility_id string, confidence_tier string")
    assert {tuple(r) for r in sig.lowest_tier(signals).collect()} == {("a", "medium"), ("b", "insufficient_data")}


def test_guard_and_grounding(spark):
    coverage = spark.createDataFrame([("capacity", 0.25), ("capability", 0.9)], "field string, coverage double")
    signals = spark.createDataFrame(
        [("a", 0.5, "high", "12", "capacity"), ("a", 0.5, "high", "beds", "capability")],
        "facility_id string, trust_score double, confidence_tier string, evidence_text string, source_field string")
    got = {r.source_field: r for r in sig.coverage_guard(signals, coverage).collect()}
    assert got["capacity"].trust_score is None and got["capacity"].confidence_tier == "insufficient_data"
    assert "25%" in got["capacity"].evidence_text and got["capability"].trust_score == 0.5


def test_moves_and_actions(spark):
    moves = spark.createDataFrame([("parked", " "), ("parked", "waiting"), ("lost", None), ("called", None)],
                                  "status string, parked_reason string")
    assert [r.error for r in desk.validate_moves(moves).collect()] == [
        "parked needs a reason", None, "unknown status", None]
    acts = spark.createDataFrame(
        [("override", "why", 50.0), ("override", "why", 101.0), ("override", " ", 5.0), ("flag", None, None), ("note", None, None),
         ("like", "x", None)], "action_type string, content string, override_score double")
    assert [r.error is None for r in desk.validate_actions(acts).collect()] == [True, False, False, False, True, False]


def test_latest_action_breaks_ties(spark):
    log = spark.createDataFrame(
        [("a", "x", "flag", None, "flagged", "2024-01-01", 1), ("a", "x", "flag", "", "cleared", "2024-01-01", 2)],
        "facility_id string, analyst_id string, action_type string, dimension string, content string, updated_at string, seq int")
    assert [r.content for r in desk.latest_actions(log).collect()] == ["cleared"]
    assert desk.action_counts(log).first().flagged_count == 0


def test_unstarted(spark, sf_dir):
    d = Data(spark, sf_dir)
    waiting, all_cards = desk.unstarted(d.gold, d.review), desk.unstarted(d.gold)
    assert desk.unstarted(d.gold, limit=3).count() == 3
    assert waiting.count() < all_cards.count() == d.gold.count()
    counts = {r.status: r.cards for r in desk.board_counts(d.gold, d.review).collect()}
    assert counts["not_started"] == waiting.count()
