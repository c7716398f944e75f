"""Registered queries: every operator over whole driver tables."""

import uuid

from pyspark.sql import functions as F

from trustdesk.operators import (
    clean, curate, documented_checks as extra, enrich, quality, ranking, score_store, search as find, signals as sig,
    starters, text_index, trust, vector_index, workbench as desk,
)
from trustdesk.operators.outreach import contacts, outreach, outreach_draft, outreach_lists
from trustdesk.operators.similarity import fuzzy_identity, fuzzy_nearby
from trustdesk.plans.check_runs import run_checks
from trustdesk.plans.layers import shared_folder, state_of, stored_once, stored_path
from trustdesk.schemas import EXTRACTION_ERRORS, SOURCE_COLUMNS, TRUST_SIGNALS
from trustdesk.sources import driver_views as views, sinks
from trustdesk.sources.readers import read_csv, run_sql
from trustdesk.streaming import latest

AS_OF = "2024-06-30"
AT = "2024-06-30 12:00:00"
COVERED = ["description", "capability", "procedure", "equipment", "year_established", "capacity", "number_doctors",
           "email"]
QUERIES = {}


class Data:
    """The views and layers one query needs, built lazily over one set of tables."""

    def __init__(self, spark, sf_dir):
        self.spark, self.dir, self._state = spark, sf_dir, None

    @property
    def state(self):
        """State of the input files, looked up once."""
        self._state = self._state or state_of(self.spark, self.dir)
        return self._state

    def table(self, name):
        return views.table(self.spark, self.dir, name)

    def view(self, name):
        return getattr(views, name)(self.spark, self.dir)

    def kept(self, name, build, partition_by=()):
        """A stored layer: written by the first query that needs it, read by the others."""
        return stored_once(self.spark, (self.dir, name), build, partition_by, self.state)

    source = property(lambda s: s.kept("source", lambda: s.view("source").drop("balance", "record_key")))
    signals = property(lambda s: s.kept("signals", lambda: s.view("signals"), ["dimension"]))
    responses = property(lambda s: s.kept("responses", lambda: s.view("responses")))
    overrides = property(lambda s: s.view("overrides"))
    actions = property(lambda s: s.view("actions"))
    review_log = property(lambda s: s.view("review_log"))
    raw = property(lambda s: clean.to_raw(s.source).where(F.col("facility_id").isNotNull()))
    bronze = property(lambda s: clean.to_bronze(s.source, AT))
    silver = property(lambda s: s.kept("silver", lambda: clean.to_silver(s.bronze, AS_OF)))
    gold = property(lambda s: s.kept("gold", lambda: curate.to_gold(s.silver, s.overrides)))
    quality_scores = property(lambda s: s.kept("quality_scores", s.build_scores))

    def build_scores(self):
        checks, names, _ = quality.core_checks(self.source)
        return quality.quality_scores(checks, names)

    @property
    def fs(self):
        return trust.facility_scores(self.gold, self.signals, self.quality_scores)

    @property
    def review(self):
        good, _ = desk.accepted(desk.validate_moves(self.review_log))
        return desk.review_state(good)


def listed(c):
    """Arrays as sorted text, for comparing results by value."""
    return F.array_join(F.array_sort(c), "|").alias(c)


def _register(name, build):
    QUERIES[name] = lambda spark, sf_dir: build(Data(spark, sf_dir))


def add(name):
    def wrap(build):
        _register(name, build)
        return build
    return wrap


# --- layers -------------------------------------------------------------------------------------------
add("bronze_landed")(lambda d: d.bronze.select(SOURCE_COLUMNS))
add("raw_subset")(lambda d: clean.to_raw(d.source))


@add("silver_clean")
def _(d):
    s = clean.to_silver(d.bronze, AS_OF).drop("_silver_processed_at")
    return s.select(*(listed(c) if c == "affiliation_type_ids" else c for c in s.columns))


@add("gold_merge")
def _(d):
    g = curate.to_gold(d.silver, d.overrides).drop("_gold_built_at")
    return g.select(*(listed(c) if c in ("affiliation_type_ids", "overridden_fields") else c for c in g.columns))


add("issue_rows")(lambda d: curate.issue_rows(d.silver))
add("override_latest")(lambda d: curate.override_latest(d.overrides).select("facility_id", "field_name", "new_value", "seq"))

# --- quality ------------------------------------------------------------------------------------------
add("dup_phones")(lambda d: quality.duplicate_phones(d.source).withColumn("pct_rank", F.round("pct_rank", 6)))
add("missing_checks")(lambda d: quality.row_checks(d.source, quality.missing_rules()))
add("location_check")(lambda d: quality.location_check(d.source))
add("quality_scores")(lambda d: d.build_scores().withColumn("issues", F.array_join("issues", "|")))


@add("worst_100")
def _(d):
    checks, names, _ = quality.core_checks(d.source)
    return quality.worst_records(checks, names, d.gold).withColumn("issues", F.array_join("issues", "|"))


add("dup_emails")(lambda d: extra.duplicate_emails(d.source))
add("dup_phones_by_count")(lambda d: extra.duplicate_phones_by_count(d.source))
add("dup_identity")(lambda d: extra.duplicate_identity(d.silver))
add("fuzzy_identity")(lambda d: fuzzy_identity(d.silver))
add("fuzzy_nearby")(lambda d: fuzzy_nearby(d.silver, km=900.0))
add("missing_core")(lambda d: extra.missing_core(d.source))
add("contact_formats")(lambda d: extra.contact_formats(d.source))
add("field_conflicts")(lambda d: extra.field_conflicts(d.source, AS_OF))
add("low_coverage")(lambda d: extra.low_coverage_guard(
    d.source, sig.coverage(d.source, ["capacity", "yearEstablished"]), AS_OF))
add("weak_address")(lambda d: extra.weak_address(d.silver))
add("same_coords")(lambda d: extra.same_coordinates(d.silver))
add("type_vs_text")(lambda d: extra.type_against_text(d.silver))
add("text_quality")(lambda d: extra.text_quality(d.silver, others=["capability", "procedure", "equipment"]))
add("document_text_quality")(lambda d: extra.text_quality(d.table("documents"), "text", "doc_id"))
add("trust_quality_matrix")(lambda d: extra.trust_quality_matrix(d.fs, d.quality_scores))

# --- signals ------------------------------------------------------------------------------------------
add("worklist")(lambda d: sig.worklist(d.raw, d.signals).select("facility_id", "facility_name"))
add("prompt")(lambda d: sig.render_prompt(d.raw).select("facility_id", "prompt"))


@add("model_score")
def _(d):
    good, _ = sig.parse_signals(sig.score(d.raw, sig.rule_scorer).withColumn("responded_at", F.lit(AT).cast("timestamp")))
    return good.drop("extracted_at")


add("signals_parse")(lambda d: sig.valid_dimensions(sig.parse_signals(d.responses)[0]).drop("extracted_at"))
add("signals_errors")(lambda d: sig.parse_signals(d.responses)[1].drop("failed_at"))
add("signals_latest")(lambda d: sig.latest_signals(d.signals).select(
    "facility_id", "dimension", "trust_score", "confidence_tier", "evidence_text"))
add("coverage")(lambda d: sig.coverage(d.silver, COVERED))
add("coverage_guard")(lambda d: sig.coverage_guard(d.signals, sig.coverage(d.silver, COVERED)).drop("extracted_at"))
add("evidence_grounding")(lambda d: sig.ground_evidence(d.signals, d.gold).select(
    "facility_id", "dimension", "source_field", "evidence_text", "grounding", "grounded"))
add("contradiction_severity")(lambda d: sig.contradiction_severity(sig.ground_evidence(d.signals, d.gold)).select(
    "facility_id", "dimension", "contradiction_detail", "severity"))
add("highlights")(lambda d: sig.highlights(d.gold, d.signals))
add("segments")(lambda d: sig.segments(sig.highlights(d.gold, d.signals)))
add("score_bands")(lambda d: sig.score_bands(d.signals))
add("field_profile")(lambda d: sig.field_profile(d.gold, d.signals))
add("field_items")(lambda d: sig.field_items(d.gold))
add("lowest_tier")(lambda d: sig.lowest_tier(d.signals))
add("extraction_report")(lambda d: sig.extraction_report(
    d.raw, d.signals, sig.parse_signals(d.responses)[1]))
add("report_dimensions")(lambda d: sig.report_dimensions(d.signals))
add("contradiction_sample")(lambda d: sig.contradiction_sample(d.signals))
add("missing_signals")(lambda d: sig.missing_signals(d.raw, d.signals))

# --- trust score and dashboards -----------------------------------------------------------------------
add("facility_scores")(lambda d: d.fs)
add("simple_scores")(lambda d: trust.simple_scores(d.signals))
add("dash_summary")(lambda d: trust.summary(d.fs))
add("dash_histogram")(lambda d: trust.histogram(d.fs))
add("dash_tiers")(lambda d: trust.tiers(d.fs))
add("dash_dims")(lambda d: trust.dimension_means(d.signals))
add("dash_types")(lambda d: trust.by_type(d.fs))
add("dash_top_bottom")(lambda d: trust.extremes(d.fs).withColumn("end", F.lit("top")).unionByName(
    trust.extremes(d.fs, best=False).withColumn("end", F.lit("bottom"))))


def signal_panels(d):
    return trust.signal_dashboard(d.fs.drop("score"), d.signals)


for _panel in ("summary", "histogram", "dims", "types", "top", "bottom"):
    add(f"dash_signal_{_panel}")(lambda d, p=_panel: signal_panels(d)[p])
add("stats_totals")(lambda d: trust.stats_totals(d.fs))
add("stats_tiers")(lambda d: trust.tier_percentages(d.fs))
add("stats_dims")(lambda d: trust.stats_dimensions(d.signals))
add("stats_dim_range")(lambda d: trust.stats_dimension_range(d.signals))
add("stats_top_type")(lambda d: trust.stats_top_type(d.fs))

# --- search -------------------------------------------------------------------------------------------


@add("filter_options")
def _(d):
    options = find.filter_options(d.gold)
    return (options["states"].select(F.lit("state").alias("kind"), F.col("state").alias("value"))
            .unionByName(options["facility_types"].select(F.lit("type").alias("kind"),
                                                          F.col("facility_type").alias("value"))))


add("search")(lambda d: find.search(d.gold, d.signals, d.quality_scores))
add("search_filtered")(lambda d: find.search(
    d.gold, d.signals, d.quality_scores, q="Care", facility_type="clinic", min_score=5, page=1, limit=50, sort="name",
    columns=find.WIDER_SEARCH_COLUMNS))
add("search_contradictions")(lambda d: find.search(
    d.gold, d.signals, d.quality_scores, state="NATION_1", contradictions_only=True, tier="low", sort="completeness"))
add("search_deep")(lambda d: find.search(d.gold, d.signals, d.quality_scores, page=3, limit=20, shallow=10))


@add("search_indexed")
def _(d):
    """Records that hold a term with wildcards, by the index of letter triples."""
    index = text_index.build(d.gold, folder(d, "text_index"), find.WIDER_SEARCH_COLUMNS)
    found = text_index.matching(d.gold, index, "l%side_c", find.WIDER_SEARCH_COLUMNS).withColumn("term", F.lit("wild"))
    short = text_index.matching(d.gold, index, "_9", ["name"]).withColumn("term", F.lit("short"))
    return found.unionByName(short).select("term", "unique_id", "name")


SAMPLE_CURSOR = (0.6, "80000000-0000-0000-0000-000000000000")
add("search_after")(lambda d: find.search_after(d.gold, d.signals, d.quality_scores, SAMPLE_CURSOR))


@add("search_stored_order")
def _(d):
    """A page from the middle of the whole result, stored in order by name."""
    rows, key = find.found_records(d.gold, d.signals, d.quality_scores, sort="name")
    kept = ranking.store_in_order(rows.select("facility_id", "facility_name", "score"), key, folder(d, "found"), range_rows=100)
    return kept.page(d.spark, kept.rows // 2, 30).withColumnRenamed("score", "overall_trust_score")


add("search_bound_sql")(lambda d: (d.gold.createOrReplaceTempView("trustdesk_gold"), run_sql(
    d.spark, "SELECT unique_id, name FROM trustdesk_gold WHERE (:state = '' OR address_state_or_region = :state)",
    state="NATION_3"))[1])
SAMPLE_ID = "c4ca4238-a0b9-2382-0dcc-509a6f75849b"
add("detail")(lambda d: find.detail(SAMPLE_ID, d.gold, d.signals, d.quality_scores)["facility"].withColumn(
    "overridden_fields", F.array_join("overridden_fields", "|")))
add("detail_signals")(lambda d: find.detail(SAMPLE_ID, d.gold, d.signals, d.quality_scores)["trust_signals"].drop("extracted_at"))

# --- analyst state ------------------------------------------------------------------------------------
add("latest_actions")(lambda d: desk.latest_actions(d.actions).select(
    "facility_id", "analyst_id", "action_type", "dimension", "content", "override_score", "seq"))


@add("stream_latest")
def _(d):
    """The action log folded into its latest state by a file stream."""
    path, schema = stored_path(d.spark, (d.dir, "actions_log"), lambda: d.actions)
    columns = ["facility_id", "analyst_id", "action_type", "content", "seq"]
    keys = ["facility_id", "analyst_id", "action_type"]
    state = f"{shared_folder(d.spark)}/trustdesk/{uuid.uuid4().hex}"
    latest.stream_latest(d.spark, path, schema, keys, f"{state}/state", f"{state}/checkpoint").awaitTermination()
    return latest.read_latest(d.spark, f"{state}/state", schema, keys).select(columns)


add("action_counts")(lambda d: desk.action_counts(d.actions))
add("action_counts_any_reason")(lambda d: desk.action_counts(d.actions, flag_rule="any_nonblank"))
add("review_queue")(lambda d: desk.review_queue(d.actions, d.fs))
add("search_state")(lambda d: desk.search_state(d.fs, d.actions).select(
    "facility_id", "shortlisted", "flagged", "has_note"))
add("board_columns")(lambda d: desk.board(d.gold, d.review).drop("updated_at").unionByName(
    desk.unstarted(d.gold, d.review).drop("updated_at")))
add("board_unstarted_all")(lambda d: desk.unstarted(d.gold).select("facility_id", "facility_name", "status"))
add("board_assignee")(lambda d: desk.board(d.gold, d.review, status="parked", assigned_to="analyst-2").drop("updated_at"))
add("board_counts")(lambda d: desk.board_counts(d.gold, d.review))
add("move_validation")(lambda d: desk.validate_moves(d.review_log).select("seq", "status", "parked_reason", "error"))
add("action_validation")(lambda d: desk.validate_actions(d.actions).select(
    "action_id", "action_type", "content", "override_score", "error"))
add("suggestions_apply")(lambda d: desk.suggestions_to_overrides(d.view("suggestions"), "analyst-1", AT).drop("updated_at"))
add("changed_ids")(lambda d: desk.changed_since(d.overrides, "2001-01-01 00:00:00"))


@add("rescore")
def _(d):
    before = d.overrides.where("updated_at <= '2001-01-01'")
    score = lambda gold: trust.facility_scores(gold, d.signals, d.quality_scores)
    previous = score(curate.to_gold(d.silver, before))
    return desk.rescore(previous, d.gold, desk.changed_since(d.overrides, "2001-01-01 00:00:00"), score)


@add("rescore_stored")
def _(d):
    """The same in a table stored in buckets, of which the touched ones are rewritten."""
    since, path = "2001-01-01 00:00:00", folder(d, "score_buckets")
    score = lambda gold: trust.facility_scores(gold, d.signals, d.quality_scores)
    previous = score(curate.to_gold(d.silver, d.overrides.where("updated_at <= '2001-01-01'")))
    score_store.store(previous, path)
    score_store.rescore(path, d.gold, desk.changed_since(d.overrides, since), score, previous.schema)
    return score_store.read(d.spark, path, previous.schema)


add("score_overrides")(lambda d: desk.apply_score_overrides(d.signals, d.actions).select(
    "facility_id", "dimension", "trust_score", "overridden", "confidence_tier", "evidence_text"))

# --- outreach -----------------------------------------------------------------------------------------


@add("outreach_rollup")
def _(d):
    return outreach(contacts(d.source, d.quality_scores)).withColumn("issues", F.array_join("issues", "|"))


add("outreach_lists")(lambda d: outreach_lists(contacts(d.source, d.quality_scores)))
add("outreach_draft")(lambda d: outreach_draft(outreach(contacts(d.source, d.quality_scores)), "Maya"))

# --- geography ----------------------------------------------------------------------------------------
add("pin_enrich")(lambda d: enrich.enrich_postal(
    d.gold.select("unique_id", "address_zip_or_postcode"), d.view("postal_directory")))
add("indicator_join")(lambda d: enrich.enrich_indicators(
    d.gold.select("unique_id", "address_city"), d.view("district_indicators"), ["burden"]))
add("unmatched_districts")(lambda d: enrich.unmatched_districts(d.gold, d.view("district_indicators")))
add("district_rank")(lambda d: enrich.district_rank(d.gold, d.view("district_indicators")))
add("point_in_polygon")(lambda d: enrich.point_in_polygon(
    d.gold.select("unique_id", "latitude", "longitude"), d.view("polygons")))



@add("point_in_holes")
def _(d):
    """Polygons of two parts and a hole."""
    shapes = d.view("polygons").selectExpr("district", """array(ring,
        transform(ring, p -> struct(ring[0].x + (p.x - ring[0].x) * 0.25D + 4D AS x, ring[0].y + (p.y - ring[0].y) * 0.25D + 1D AS y)),
        transform(ring, p -> struct(ring[0].x + (p.x - ring[0].x) * 0.125D + 4D AS x, ring[0].y + (p.y - ring[0].y) * 0.125D + 7D AS y))) AS rings""")
    return enrich.point_in_polygon(d.gold.select("unique_id", "latitude", "longitude"), shapes, rings="rings")


# --- operators of the starter texts -------------------------------------------------------------------


def history(d):
    return d.table("events").selectExpr(
        "user_id", "ts", "event_id", "value",
        "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op")


add("cdc_current")(lambda d: starters.cdc_current(history(d), ["user_id"], ["ts", "event_id"]).select(
    "user_id", "event_id", "value", "op"))
def incomplete_history(d):
    """The history with some keys and times missing."""
    return history(d).selectExpr("CASE WHEN event_id % 97 = 5 THEN NULL ELSE user_id END AS user_id",
                                 "CASE WHEN event_id % 101 = 7 THEN NULL ELSE ts END AS ts", "event_id", "value", "op")


add("scd2")(lambda d: starters.scd2(incomplete_history(d), ["user_id"], "ts", "event_id").select(
    "user_id", "event_id", F.col("valid_from").cast("string").alias("valid_from"),
    F.col("valid_to").cast("string").alias("valid_to"), "is_current"))


@add("cosine_topk")
def _(d):
    """Every vector whose id is divisible by 50 as query, compared with all vectors."""
    vectors = d.table("embeddings")
    found = starters.cosine_topk(vectors, starters.query_vectors(vectors.where("vec_id % 50 = 0"), "vec_id", "embedding"))
    return found.withColumn("similarity", F.round("similarity", 5))


@add("cosine_topk_by_id")
def _(d):
    """The same through the index."""
    vectors = d.table("embeddings")
    index = vector_index.build(vectors, folder(d, "vectors"))
    found = vector_index.search(index, vectors.where("vec_id % 50 = 0"))
    return found.drop("compared").withColumn("similarity", F.round("similarity", 5))


add("chunk_paragraphs")(lambda d: starters.chunk_paragraphs(d.table("documents"), blank=r"\n+"))


def daily_sales(d):
    return starters.daily_units(d.table("lineitem"), ["l_suppkey"], "l_shipdate", "l_quantity")


add("velocity")(lambda d: starters.velocity(daily_sales(d), ["l_suppkey"]).select(
    "l_suppkey", F.col("day").cast("string").alias("day"), F.round("velocity", 6).alias("velocity")))
add("moving_avg")(lambda d: starters.moving_average(daily_sales(d), ["l_suppkey"], [0.5, 0.3, 0.2]).select(
    "l_suppkey", F.col("day").cast("string").alias("day"), F.round("forecast", 6).alias("forecast")))


add("unit_forecast")(lambda d: starters.unit_forecast(daily_sales(d), ["l_suppkey"], [0.5, 0.3, 0.2]).select(
    "l_suppkey", F.round("forecast", 6).alias("forecast")))


@add("low_stock")
def _(d):
    speed = curate.first_by(starters.velocity(daily_sales(d), ["l_suppkey"]), ["l_suppkey"], [F.desc("day")])
    stock = d.table("supplier").selectExpr("s_suppkey AS l_suppkey", "s_acctbal / 100 AS on_hand")
    return starters.low_stock(stock, speed, "l_suppkey").select(
        "l_suppkey", F.round("on_hand", 6).alias("on_hand"), F.round("days_left", 4).alias("days_left"))


add("moderation_metrics")(lambda d: starters.moderation_metrics(
    d.table("documents").join(d.table("labels"), "doc_id"), "source", F.col("toxic") == 0, "quality").select(
    "source", "submissions", F.round("approval_rate", 6).alias("approval_rate"), F.round("avg_score", 6).alias("avg_score")))


# --- checks registered from outside, and tables written and read back ------------------------------------


def same_names(src):
    """Names that several records carry, as a check of its own."""
    shared = (src.where("name IS NOT NULL").groupBy("name").agg(F.count_distinct("unique_id").alias("n")).where("n > 1")
              .select("name"))
    return src.join(shared, "name", "left_semi").select(
        "unique_id", F.lit("same_name").alias("check"), F.lit(3).alias("penalty_points"), F.lit("Name occurs twice").alias("issue_summary"))


def extra_checks():
    return [quality.Rule("short_name", F.length("name") < 24, 7, "Name is short"), ("same_name", same_names)]


def failing_checks():
    """Checks that cannot run: a column that is not there, a cast that fails on a row, a function that does either."""
    return [quality.Rule("no_such_column", F.col("no_such_column").isNull(), 5, "never seen"),
            quality.Rule("name_as_number", F.col("name").cast("int") > 0, 5, "never seen"),
            ("year_as_number", lambda src: src.groupBy("unique_id").agg(F.max(F.col("yearEstablished").cast("int")).alias("y")).select(
                "unique_id", F.lit("year_as_number").alias("check"), F.col("y").alias("penalty_points"), F.lit("x").alias("issue_summary"))),
            ("lost_column", lambda src: src.select("nowhere"))]


def checked(d):
    return run_checks(d.source, folder(d, "checks"), [*extra_checks(), *failing_checks()])


@add("registered_checks")
def _(d):
    run = checked(d)
    return quality.quality_scores(run.checks, run.names).select(
        "facility_id", "total_penalty_points", F.lit(", ".join(run.skipped)).alias("skipped"))


@add("staged_checks")
def _(d):
    """Findings of each check that ran, and the checks that failed with the phase they failed in."""
    run = checked(d)
    worst = (run.checks.where(F.col("unique_id").isNotNull()).groupBy(F.trim("unique_id").alias("facility_id"), "check")
             .agg(F.max("penalty_points").alias("points")))
    found = worst.groupBy("check").agg(F.count(F.lit(1)).alias("records"), F.sum("points").alias("points"))
    return found.withColumn("failed", F.lit(None).cast("string")).unionByName(
        run.failures.select("check", F.lit(0).cast("long").alias("records"), F.lit(0).cast("long").alias("points"),
                            F.concat_ws(" ", "phase", "condition").alias("failed")))


def folder(d, name):
    return f"{shared_folder(d.spark)}/trustdesk/{uuid.uuid4().hex}/{name}"


@add("signals_append")
def _(d):
    path = folder(d, "signals")
    sinks.ensure_table(d.spark, path, TRUST_SIGNALS)
    sinks.append_signals(sig.parse_signals(d.responses)[0], path)
    return sinks.read_pinned(d.spark, path, TRUST_SIGNALS).select("facility_id", "dimension", "trust_score", "confidence_tier")


@add("errors_append")
def _(d):
    path = folder(d, "errors")
    sinks.ensure_table(d.spark, path, EXTRACTION_ERRORS)
    sinks.append_errors(sig.parse_signals(d.responses)[1], path)
    return sinks.read_pinned(d.spark, path, EXTRACTION_ERRORS).select("facility_id", "error_message")


@add("publish_snapshot")
def _(d):
    done = sinks.publish_snapshot(d.quality_scores, ["facility_id"], folder(d, "quality_scores"))
    if not done.ok:
        raise ValueError(done.error)
    return sinks.read_snapshot(d.spark, done.target, d.quality_scores.schema).select("facility_id", "quality_score")


@add("publish_again")
def _(d):
    """Two versions of a snapshot, then one whose keys repeat, which fails: readers keep the second."""
    path, keys = folder(d, "served"), ["facility_id"]
    sinks.publish_snapshot(d.quality_scores.where("quality_score < 50"), keys, path)
    second = sinks.publish_snapshot(d.quality_scores.where("quality_score >= 50"), keys, path)
    third = sinks.publish_snapshot(d.quality_scores.unionByName(d.quality_scores), keys, path)
    return sinks.read_snapshot(d.spark, path).select("facility_id", "quality_score", F.lit(second.ok and not third.ok).alias("kept_old"))


@add("csv_scan")
def _(d):
    docs, path = d.table("documents"), folder(d, "documents.csv")
    docs.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)
    return read_csv(d.spark, path, docs.schema, docs.columns)
