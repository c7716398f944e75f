"""Latest-wins state kept from a stream of log files.

A batch stores its own latest rows as a run. Ten runs of one tier are merged into one of the next as soon as they are
there, as in a counter: after batch 137 the live runs are 0-99, 100-109, 110-119, 120-129, 130, ..., 137. A row is rewritten
once a tier, and a reader meets at most nine runs of each. What is live follows from the last finished batch alone, whose
number is added to a small manifest when its runs are complete; that one file is the switch. Runs are never changed, so that a
crash before the switch leaves the state of the batch before, and the batch is replayed.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from trustdesk.operators.curate import latest_by

#: Runs of one tier that are merged into one of the next.
FAN = 10


def live_runs(last: int, fan=FAN) -> list:
    """(first, last) batch of each live run after batch ``last``, oldest first."""
    runs, begin, left = [], 0, last + 1
    size = 1
    while size * fan <= left:
        size *= fan
    while size:
        for _ in range(left // size):
            runs.append((begin, begin + size - 1))
            begin += size
        left %= size
        size //= fan
    return runs


def run_path(target: str, run) -> str:
    return f"{target}/run={run[0]}-{run[1]}"


def store_run(rows: DataFrame, keys, target: str, run, order, tiebreak) -> None:
    latest_by(rows, list(keys), order, tiebreak).write.mode("overwrite").parquet(run_path(target, run))


def fold_batch(batch: DataFrame, batch_id: int, keys, target: str, order="updated_at", tiebreak="seq", fan=FAN) -> None:
    """Store the latest rows of one batch, merge the tiers that it fills and switch readers to it.

    A replayed batch rewrites its own runs with the same rows, and latest-wins does not depend on arrival order, so replays
    and late rows are safe.
    """
    spark = batch.sparkSession
    store_run(batch, keys, target, (batch_id, batch_id), order, tiebreak)
    size = fan
    while (batch_id + 1) % size == 0:
        begin, step = batch_id + 1 - size, size // fan
        parts = [run_path(target, (at, at + step - 1)) for at in range(begin, batch_id + 1, step)]
        store_run(spark.read.schema(batch.schema).parquet(*parts), keys, target, (begin, batch_id), order, tiebreak)
        size *= fan
    spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("append").parquet(f"{target}/manifest")


def last_batch(spark: SparkSession, target: str):
    """Number of the last finished batch, or None."""
    spark.createDataFrame([], "batch long").write.mode("ignore").parquet(f"{target}/manifest")
    return spark.read.schema("batch long").parquet(f"{target}/manifest").agg(F.max("batch")).first()[0]


def read_latest(spark: SparkSession, target: str, schema, keys, order="updated_at", tiebreak="seq", fan=FAN) -> DataFrame:
    """Current state: the latest row per key over the live runs, at most nine a tier."""
    last = last_batch(spark, target)
    if last is None:
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(schema).parquet(*[run_path(target, r) for r in live_runs(last, fan)])
    return latest_by(stored, list(keys), order, tiebreak)


def dead_runs(spark: SparkSession, target: str, fan=FAN) -> list:
    """Folders that no reader of the current state opens, for a clean-up that knows when the last reader has left."""
    last = last_batch(spark, target)
    if last is None:
        return []
    live = set(live_runs(last, fan))
    made, size = set(), 1
    while size <= last + 1:
        made |= {(at, at + size - 1) for at in range(0, last + 2 - size, size)}
        size *= fan
    return [run_path(target, r) for r in sorted(made - live)]


def stream_latest(spark: SparkSession, source: str, schema, keys, target: str, checkpoint: str, order="updated_at",
                  tiebreak="seq", max_files=None):
    """Start the stream over a folder of Parquet log files; it stops once all present files are folded in.

    ``checkpoint`` belongs on storage every executor sees.
    """
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (reader.parquet(source).writeStream
            .foreachBatch(lambda batch, batch_id: fold_batch(batch, batch_id, keys, target, order, tiebreak))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
