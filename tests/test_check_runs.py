import pytest
from pyspark.sql import functions as F

from trustdesk.operators import quality
from trustdesk.plans import check_runs
from trustdesk.plans.layers import shared_folder
from trustdesk.plans.queries import Data, extra_checks, failing_checks


@pytest.fixture
def folder(spark, request):
    return f"{shared_folder(spark)}/trustdesk-tests/{request.node.name}"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_checks_that_fail_on_a_row_are_named_and_the_others_score(spark, sf_dir, folder):
    d = Data(spark, sf_dir)
    run = check_runs.run_checks(d.source, folder, [*extra_checks(), *failing_checks()])
    assert {(r.check, r.phase) for r in run.failures.collect()} == {
        ("no_such_column", "plan"), ("lost_column", "plan"), ("name_as_number", "run"), ("year_as_number", "run")}
    assert set(run.skipped) == {"no_such_column", "lost_column", "name_as_number", "year_as_number"}
    checks, names, _ = quality.core_checks(d.source, extra_checks())
    assert set(run.names) == set(names)
    assert rows(quality.quality_scores(run.checks, run.names)) == rows(quality.quality_scores(checks, names))
    stored = spark.read.parquet(f"{folder}/failures")
    assert rows(stored) == rows(run.failures)
    assert all("Lotus" in r.message or "cast" in r.message.lower() or r.phase == "plan" for r in stored.collect())


def test_failing_rules_are_found_by_halves(spark, folder):
    src = spark.createDataFrame([(str(i), "x" if i == 7 else str(i)) for i in range(20)], "unique_id string, v string")
    good = [quality.Rule(f"good{i}", F.col("unique_id").cast("int") == i, 1, "hit") for i in range(9)]
    bad = [quality.Rule(f"bad{i}", F.col("v").cast("int") > 5, 1, "big") for i in range(2)]
    stage = check_runs.Stage(src, folder)
    tried = []
    plain = stage.run
    stage.run = lambda names, build: tried.append(len(names)) or plain(names, build)
    stage.rules([*good[:4], bad[0], *good[4:], bad[1]])
    assert sorted(stage.names) == sorted(r.check for r in good)
    assert sorted(f[0] for f in stage.failures) == ["bad0", "bad1"] and all(f[2] == "CAST_INVALID_INPUT" for f in stage.failures)
    assert tried[0] == 11 and len(tried) <= 15


def test_faults_of_the_cluster_are_not_swallowed(spark, sf_dir, folder, monkeypatch):
    d = Data(spark, sf_dir)

    def lost(*args, **kwargs):
        raise OSError("storage is gone")

    monkeypatch.setattr(check_runs.sinks, "overwrite", lost)
    with pytest.raises(OSError):
        check_runs.run_checks(d.source, folder)


def test_a_python_check_that_fails_is_named(spark, sf_dir, folder):
    d = Data(spark, sf_dir)

    def broken(src):
        def run(batches):
            for batch in batches:
                raise ValueError("no answer")
                yield batch
        return src.select(F.col("unique_id"), F.lit("broken").alias("check"), F.lit(1).alias("penalty_points"),
                          F.lit("x").alias("issue_summary")).mapInPandas(run, "unique_id string, check string, penalty_points int, issue_summary string")

    run = check_runs.run_checks(d.source, folder, [("broken", broken)])
    assert [(r.check, r.phase, "no answer" in r.message) for r in run.failures.collect()] == [("broken", "run", True)]
    assert "missing_name" in run.names


def test_names_must_differ(spark, sf_dir, folder):
    with pytest.raises(ValueError):
        check_runs.run_checks(Data(spark, sf_dir).source, folder, [quality.Rule("missing_name", F.lit(True), 1, "x")])


def test_no_records(spark, sf_dir, folder):
    run = check_runs.run_checks(Data(spark, sf_dir).source.where("false"), folder, extra_checks())
    assert run.checks.count() == 0 and run.failures.count() == 0 and "same_name" in run.names
