import pytest
from pyspark.sql import functions as F

from trustdesk.operators import curate
from trustdesk.plans.layers import shared_folder
from trustdesk.sources import sinks
from trustdesk.streaming import latest


@pytest.fixture
def folder(spark, request, tmp_path):
    return f"{shared_folder(spark)}/trustdesk-tests/{tmp_path.name}-{request.node.name}"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_failing_publish_leaves_the_old_snapshot_readable(spark, folder, monkeypatch):
    first = spark.range(5).withColumn("v", F.lit("old"))
    second = spark.range(7).withColumn("v", F.lit("new"))
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, folder)
    assert sinks.publish_snapshot(first, ["id"], folder).ok
    reader = sinks.read_snapshot(spark, folder)
    # keys that repeat, rows that fail while they are written, rows that are not what was sent
    assert "not unique" in sinks.publish_snapshot(second.unionByName(second), ["id"], folder).error
    broken = second.withColumn("n", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")))
    assert "lost" in sinks.publish_snapshot(broken, ["id"], folder).error
    plain = sinks._digest
    seen = []
    monkeypatch.setattr(sinks, "_digest", lambda: seen.append(1) or (plain() if len(seen) % 2 else F.lit("other")))
    assert "differ" in sinks.publish_snapshot(second, ["id"], folder).error
    monkeypatch.undo()
    assert rows(sinks.read_snapshot(spark, folder)) == rows(first)
    done = sinks.publish_snapshot(second, ["id"], folder)
    assert done.ok and done.rows == 7 and rows(sinks.read_snapshot(spark, folder)) == rows(second)
    # a reader that opened the version before still reads it
    assert rows(reader) == rows(first)
    assert sinks.publish_snapshot(first, ["id"], folder).ok and rows(sinks.read_snapshot(spark, folder)) == rows(first)
    assert [r.seq for r in sinks.versions(spark, folder).orderBy("seq").collect()] == [1, 2, 3]
    assert len(sinks.expired(spark, folder, keep=2)) == 1 and rows(spark.read.parquet(*sinks.expired(spark, folder, 2))) == rows(first)


def test_an_empty_snapshot(spark, folder):
    assert sinks.publish_snapshot(spark.range(0), ["id"], folder).ok
    assert sinks.read_snapshot(spark, folder).count() == 0


def test_live_runs_cover_all_batches_with_few_runs():
    for fan in (2, 3, 10):
        for last in range(0, 260):
            runs = latest.live_runs(last, fan)
            assert [b for a, z in runs for b in range(a, z + 1)] == list(range(last + 1))
            assert len(runs) <= (fan - 1) * (len(str(bin(last + 1))))
    assert latest.live_runs(137) == [(0, 99), (100, 109), (110, 119), (120, 129), *((b, b) for b in range(130, 138))]


COLUMNS = "k int, v string, updated_at timestamp, seq int"


def batch(spark, i):
    return spark.createDataFrame([(j % 4 if j else i, f"{i}-{j}", i * 10 + j) for j in range(3)], "k int, v string, seq int").select(
        "k", "v", F.timestamp_seconds(F.lit(1700000000) + (F.col("seq") * 7919) % 100).alias("updated_at"), "seq")


def test_state_after_many_batches_reads_few_runs_and_survives_a_crash(spark, folder, monkeypatch):
    schema, everything = batch(spark, 0).schema, None
    assert latest.read_latest(spark, folder, schema, ["k"]).count() == 0
    for i in range(13):
        rows_of = batch(spark, i)
        everything = rows_of if everything is None else everything.unionByName(rows_of)
        if i == 8:
            # a crash while the tiers are merged: readers keep the state of the batch before, the replay goes on from there
            plain, calls = latest.store_run, []

            def crash(*args):
                calls.append(1)
                if len(calls) == 3:
                    raise OSError("lost")
                plain(*args)

            before = rows(latest.read_latest(spark, folder, schema, ["k"], fan=3))
            monkeypatch.setattr(latest, "store_run", crash)
            with pytest.raises(OSError):
                latest.fold_batch(rows_of, i, ["k"], folder, fan=3)
            monkeypatch.undo()
            assert rows(latest.read_latest(spark, folder, schema, ["k"], fan=3)) == before
        latest.fold_batch(rows_of, i, ["k"], folder, fan=3)
        if i in (8, 12):
            latest.fold_batch(rows_of, i, ["k"], folder, fan=3)
            assert rows(latest.read_latest(spark, folder, schema, ["k"], fan=3)) == rows(curate.latest_by(everything, ["k"]))
    read = latest.read_latest(spark, folder, schema, ["k"], fan=3).inputFiles()
    runs = {f.split("run=")[1].split("/")[0] for f in read}
    assert runs == {"0-8", "9-11", "12-12"}
    dead = latest.dead_runs(spark, folder, fan=3)
    assert not {d.split("run=")[1] for d in dead} & runs and len(dead) == 12 + 3
