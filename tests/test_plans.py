import pytest
from pyspark.sql import functions as F, types as T

from trustdesk import schemas
from trustdesk.operators import clean, curate, enrich, outreach, signals as sig, starters
from trustdesk.plans import layers
from trustdesk.plans.queries import Data
from trustdesk.schemas import EXTRACTION_ERRORS, OVERRIDES_LOG, TRUST_SIGNALS
from trustdesk.sources import readers, sinks
from trustdesk.streaming import latest


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,text\n1,"two\nlines"\n2,"says ""hi"""\n')
    df = readers.read_csv(spark, str(path), "id int, text string", required=["id", "text"])
    assert [r.text for r in df.orderBy("id").collect()] == ["two\nlines", 'says "hi"']
    assert dict(readers.read_csv(spark, str(path)).dtypes)["id"] == "int"
    with pytest.raises(ValueError, match="size"):
        readers.read_csv(spark, str(path), "id int, text string", required=["size"])


def test_layers_extraction_and_publishing(spark, sf_dir, tmp_path):
    d = Data(spark, sf_dir)
    layout, served = layers.Layout(str(tmp_path / "lake")), layers.Layout(str(tmp_path / "served"))
    at = "2024-06-30 12:00:00"
    built = layers.build_layers(spark, d.source, d.overrides, layout, at, "2024-06-30")
    assert built["bronze"].count() == built["silver"].count() == d.source.count()
    assert built["skipped_checks"] == []

    raw = clean.to_raw(d.source).where("facility_id IS NOT NULL")
    ids = raw.select("facility_id").distinct().count()
    calls = [layers.extract_signals(spark, raw, layout, sig.rule_scorer, at, chunk=80) for _ in range(2)]
    assert calls[0]["written"] > 0 and calls[0]["rounds"] == 2 and calls[1] == {"written": 0, "dropped": 0, "rounds": 0}
    signals = sinks.read_pinned(spark, layout.signals, TRUST_SIGNALS)
    assert signals.select("facility_id").distinct().count() == ids
    assert sinks.read_pinned(spark, layout.errors, EXTRACTION_ERRORS).isEmpty()

    done = layers.publish(built, signals, served)
    assert [p.ok for p in done] == [True] * 5, done
    twice = built["gold"].unionByName(built["gold"])
    failed, fine = sinks.publish_all([(twice, ["unique_id"], served.twice), (built["gold"], ["unique_id"], served.again)])
    assert not failed.ok and "not unique" in failed.error and fine.ok and fine.rows == built["gold"].count()


def test_append_drops_unknown_dimensions(spark, tmp_path):
    path = str(tmp_path / "signals")
    sinks.ensure_table(spark, path, TRUST_SIGNALS)
    sinks.ensure_table(spark, path, TRUST_SIGNALS)
    rows = spark.createDataFrame([("a", "capability"), ("a", "staffing"), ("b", "procedure")], "facility_id string, dimension string")
    assert sinks.append_signals(rows, path) == {"written": 2, "dropped": 1}
    stored = sinks.read_pinned(spark, path, TRUST_SIGNALS)
    assert stored.count() == 2 and stored.where("trust_score IS NULL").count() == 2
    scan = stored.where("dimension = 'capability'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dimension" in scan


def test_overwrite_may_change_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite(spark.range(3), path)
    sinks.overwrite(spark.range(2).withColumn("more", F.lit("x")), path)
    assert readers.read_table(spark, path).columns == ["id", "more"]


def test_stream_keeps_the_latest_version(spark, tmp_path):
    schema = T.StructType([*OVERRIDES_LOG, T.StructField("seq", T.IntegerType())])
    source, target = str(tmp_path / "log"), str(tmp_path / "state")
    keys = ["facility_id", "field_name"]

    def write(*rows):
        spark.createDataFrame(rows, "facility_id string, field_name string, new_value string, updated_at string, seq int").withColumn(
            "updated_at", F.col("updated_at").cast("timestamp")).select(*(
                F.col(f.name) if f.name in ("facility_id", "field_name", "new_value", "updated_at", "seq")
                else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)).coalesce(1).write.mode("append").parquet(source)

    def run():
        latest.stream_latest(spark, source, schema, keys, target, str(tmp_path / "checkpoint"), max_files=1).awaitTermination(120)
        return {(r.facility_id, r.field_name): r.new_value for r in latest.read_latest(spark, target, schema, keys).collect()}

    write(("a", "name", "new", "2024-02-01", 2), ("b", "name", "only", "2024-01-01", 3))
    write(("a", "name", "late", "2024-01-01", 1))
    assert run() == {("a", "name"): "new", ("b", "name"): "only"}
    write(("a", "name", "newest", "2024-02-01", 4))
    assert run() == {("a", "name"): "newest", ("b", "name"): "only"}
    # a replayed batch rewrites its own folder and leaves the same state
    latest.fold_batch(spark.read.schema(schema).parquet(source).where("seq = 4"), 2, keys, target)
    state = latest.read_latest(spark, target, schema, keys)
    whole = curate.latest_by(spark.read.schema(schema).parquet(source), keys)
    assert state.count() == 2 and whole.exceptAll(state).isEmpty()


def test_one_letter_for_a_very_large_address(spark):
    rows = [(f"id{i}", f"Clinic {i:03d}", f"City {i % 7}", "Kerala" if i % 3 else "", " Desk@X.org ") for i in range(500)]
    src = spark.createDataFrame([*rows, ("solo", "Solo {items}", None, None, "s@x.org"), ("none", None, None, None, "n@x.org"),
                                 (None, "No id", None, None, "s2@x.org")],
                                "unique_id string, name string, address_city string, address_stateOrRegion string, email string")
    scores = spark.createDataFrame([(f"id{i}", i % 100, [f"Issue {i % 4}"]) for i in range(0, 500, 2)],
                                   "facility_id string, quality_score int, issues array<string>")
    reached = outreach.contacts(src, scores)
    rollup = {r.email: r for r in outreach.outreach(reached).collect()}
    desk = rollup["desk@x.org"]
    assert (desk.facility_count, desk.first_name, desk.first_state, desk.is_shared) == (500, "Clinic 000", "Kerala", True)
    assert desk.issues == ["Issue 0", "Issue 2"] and desk.min_quality_score == 0 and desk.avg_quality_score == 49
    lists = outreach.outreach_lists(reached).where("email = 'desk@x.org'").groupBy("list").count().collect()
    assert {r["list"]: r["count"] for r in lists} == {"facility_ids": 500, "facility_names": 500, "states": 2, "cities": 7, "issues": 2}
    letters = {r.email: r.draft for r in outreach.outreach_draft(outreach.outreach(reached), "Maya", "Care Map").collect()}
    assert len(letters) == len(rollup) == 4
    assert "500 facilities including Clinic 000 in Kerala" in letters["desk@x.org"] and "\n  - Issue 2" in letters["desk@x.org"]
    assert "listed for Solo {items}." in letters["s@x.org"] and "need a look" not in letters["s@x.org"]
    assert "your facility" in letters["n@x.org"] and rollup["s2@x.org"].facility_count == 0


def test_extraction_goes_on_past_failing_records(spark, tmp_path):
    schema = "facility_id string, facility_name string, facility_type string, state string, description string, capability string, " \
             "procedure string, equipment string, capacity string, year_established string"
    raw = spark.createDataFrame([(f"{'bad' if i % 2 else 'good'}{i}", "n", "clinic", "s", "d" * 3000, "c", "p", "e", "1", "1990") for i in range(60)],
                                schema)

    def scorer(batch):
        if batch["facility_id"].str.startswith("bad").any():
            raise RuntimeError("refused")
        assert batch["prompt"].str.contains("d" * 3000).all()
        return sig.rule_scorer(batch)

    layout = layers.Layout(str(tmp_path / "x"))
    done = layers.extract_signals(spark, raw, layout, scorer, "2024-06-30 12:00:00", chunk=30)
    signals = sinks.read_pinned(spark, layout.signals, TRUST_SIGNALS)
    errors = sinks.read_pinned(spark, layout.errors, EXTRACTION_ERRORS)
    assert signals.select("facility_id").distinct().count() == 30 and done["written"] == signals.count() == 120
    assert errors.groupBy("facility_id").count().where("count <> 3").isEmpty() and errors.count() == 90
    assert errors.where("error_message NOT LIKE 'RuntimeError: refused'").isEmpty()
    again = layers.extract_signals(spark, raw, layout, scorer, "2024-06-30 12:00:00")
    assert again == {"written": 0, "dropped": 0, "rounds": 0}


def test_an_append_that_writes_nothing_is_counted(spark, tmp_path):
    made = spark.createDataFrame([("a", "staffing"), ("b", "capability"), ("c", None)], "facility_id string, dimension string")
    for where, counts in (("true", (1, 2)), ("dimension = 'staffing'", (0, 1)), ("dimension IS NULL", (0, 1)), ("false", (0, 0))):
        done = sinks.append_signals(made.where(where).repartition(3), str(tmp_path / "s"))
        assert (done["written"], done["dropped"]) == counts, where
    assert sinks.read_pinned(spark, str(tmp_path / "s"), TRUST_SIGNALS).count() == 1


def test_stored_layers_follow_their_inputs(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in/t.parquet")
    read = lambda: layers.stored_once(spark, (f"{tmp_path}/in", "copy"), lambda: spark.read.parquet(f"{tmp_path}/in/t.parquet"))
    assert read().count() == 3
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/in/t.parquet")
    assert read().count() == 8


def test_empty_tables_have_their_types(spark, tmp_path):
    for name in ("TRUST_SIGNALS", "EXTRACTION_ERRORS", "QUALITY_SCORES", "OUTREACH", "OUTREACH_LISTS", "OVERRIDES_LOG",
                 "ACTIONS_LOG", "REVIEW_STATE"):
        schema, path = getattr(schemas, name), f"{tmp_path}/{name}"
        sinks.ensure_table(spark, path, schema)
        table = sinks.read_pinned(spark, path, schema)
        assert table.isEmpty() and table.dtypes == spark.createDataFrame([], schema).dtypes


def test_nearest_vectors_in_blocks(spark):
    rows = [(i, [float((i * 7) % 11 - 5), float(i % 5), 1.0]) for i in range(60)] + [(98, [0.0, 0.0, 0.0]), (99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = starters.query_vectors(df, "vec_id", "embedding")
    key = lambda r: (r.query_id, r.rank)
    one, many = (sorted(starters.cosine_topk(df, asked, k=3, block=b).collect(), key=key) for b in (1000, 7))
    assert one == many and len(one) == 180 and all(r.similarity >= 0.999 for r in one if r.rank == 1)
    assert starters.cosine_topk(df, []).isEmpty()


def test_query_vectors_stay_on_spark(spark, monkeypatch):
    df = spark.range(300).selectExpr("id AS vec_id", "array(cos(id), sin(id * 3), 1.0D) AS embedding")
    with monkeypatch.context() as m:
        for name in ("collect", "toLocalIterator", "toPandas"):
            m.setattr(type(df), name, lambda *a, **b: pytest.fail("query vectors came to the driver"))
        found = starters.cosine_topk(df, starters.query_vectors(df.where("vec_id % 50 = 0"), "vec_id", "embedding"), block=4)
    first = [(r.query_id, r.match_id) for r in found.where("rank = 1").collect()]
    assert sorted(first) == [(i, i) for i in range(0, 300, 50)] and found.count() == 30


def test_ambiguous_pins_are_marked(spark):
    offices = spark.createDataFrame(
        [("1", "D", "S", "10", "20"), ("1", "D", "S", "NA", "NA"), ("2", "D", "S", "1", "1"), ("2", "E", "S", "1", "1")],
        "pincode string, district string, statename string, latitude string, longitude string")
    records = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "9"), ("d", None)], "unique_id string, address_zip_or_postcode string")
    got = {r.unique_id: r for r in enrich.enrich_postal(records, offices).collect()}
    assert len(got) == 4 and got["a"].pin_district == "D" and got["a"].pin_latitude == 10.0
    assert got["b"].is_ambiguous and got["b"].pin_district is None and got["c"].office_count is None


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_point_in_concave_polygon(spark, hot_rows):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 5.0), (0.0, 10.0)]
    shapes = spark.createDataFrame([("d", ring)], "district string, ring array<struct<x:double, y:double>>")
    points = spark.createDataFrame([("in", 5.0, 2.0), ("in", 5.0, 2.0), ("notch", 5.0, 8.0), ("far", 50.0, 5.0), ("none", None, 1.0)],
                                   "unique_id string, longitude double, latitude double")
    got = enrich.point_in_polygon(points, shapes, hot_rows=hot_rows).collect()
    assert [(r.unique_id, r.district) for r in got] == [("in", "d"), ("in", "d")]


def test_validity_ranges_cross_buckets(spark):
    changes = spark.createDataFrame(
        [("a", "2024-01-01 10:00:00", 1), ("a", "2024-01-01 11:00:00", 2), ("a", "2024-01-05 09:00:00", 3), ("b", "2024-01-02 00:00:00", 4)],
        "k string, ts string, n int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.n: (str(r.valid_to) if r.valid_to else None, r.is_current) for r in starters.scd2(changes, ["k"], "ts", "n").collect()}
    lost = spark.createDataFrame([(None, None, 1), (None, "2024-01-01 10:00:00", 2), ("a", None, 3)], "k string, ts string, n int").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = {r.n: (str(r.valid_to) if r.valid_to else None, r.is_current) for r in starters.scd2(lost, ["k"], "ts", "n").collect()}
    assert ends == {1: ("2024-01-01 10:00:00", False), 2: (None, True), 3: (None, True)}
    assert got == {1: ("2024-01-01 11:00:00", False), 2: ("2024-01-05 09:00:00", False), 3: (None, True), 4: (None, True)}


def test_appended_signals_are_dealt_by_size(spark, tmp_path):
    """One stored file of many answers is not sorted by one task."""
    path = str(tmp_path / "signals")
    rows = spark.range(0, 100_000, 1, 1).selectExpr(
        "'f' || id AS facility_id", "CASE WHEN id % 2 = 0 THEN 'capability' ELSE 'equipment' END AS dimension", "md5(CAST(id AS STRING)) AS evidence_text")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        assert sinks.append_signals(rows, path) == {"written": 100_000, "dropped": 0}
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stored = spark.read.schema(TRUST_SIGNALS).parquet(path)
    assert len(stored.inputFiles()) > 4 and stored.select("facility_id").distinct().count() == 100_000


def test_answers_are_stored_for_all_cores(spark, sf_dir):
    assert len(Data(spark, sf_dir).responses.inputFiles()) >= spark.sparkContext.defaultParallelism
