"""Layer runs: landing to analyst-ready, scores, outreach, signals, publishing.

Each layer is written once and read back by the next, so a lost executor recomputes one layer at most and
no layer is evaluated twice.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from trustdesk.operators import clean, curate, quality, signals as sig
from trustdesk.operators.outreach import contacts, outreach, outreach_lists
from trustdesk.plans.check_runs import run_checks
from trustdesk.schemas import EXTRACTION_ERRORS, RAW_RESPONSES, TRUST_SIGNALS
from trustdesk.sources import sinks


@dataclass
class Layout:
    """Where the tables live."""

    root: str

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.root}/{name}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a layer and go on from its stored form."""
    sinks.overwrite(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables that cut a plan: ``spark.checkpoint.dir``. A session on one machine may use the warehouse instead."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def state_of(spark: SparkSession, path: str) -> tuple:
    """Number, size and latest change of the files under a path, from the listing alone."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime")).first())
    return tuple(files)


_KEPT = {}


def stored_path(spark: SparkSession, key, build, partition_by=(), now=None):
    """(path, schema) of the table for ``key``, (folder of inputs, name), written on first use in this application.

    A table is written anew when the files of its inputs have changed; ``now`` is their state if it is known already.
    """
    folder, name = key
    now = now or state_of(spark, folder)
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _KEPT or _KEPT[key][0] != now:
        df = build()
        path = f"{shared_folder(spark)}/trustdesk/{uuid.uuid4().hex}/{name}"
        sinks.overwrite(df, path, partition_by)
        _KEPT[key] = (now, path, df.schema)
    return _KEPT[key][1:]


def stored_once(spark: SparkSession, key, build, partition_by=(), now=None) -> DataFrame:
    """The table for ``key``, read from its stored copy."""
    path, schema = stored_path(spark, key, build, partition_by, now)
    return spark.read.schema(schema).parquet(path)


def build_layers(spark: SparkSession, src: DataFrame, overrides: DataFrame, layout: Layout, at, as_of,
                 tiebreak="seq", extra=()) -> dict:
    """Bronze, silver, gold, row-level issues, quality scores and outreach, in that order.

    Checks, with those of ``extra``, are staged one by one; one that fails is named and the others score.
    """
    clean.require_rows(src)
    bronze = stored(clean.to_bronze(src, at), layout.bronze)
    silver = stored(clean.to_silver(bronze, as_of, at), layout.silver)
    gold = stored(curate.to_gold(silver, overrides, at, tiebreak), layout.gold)
    issues = stored(curate.issue_rows(silver, detected_at=at), layout.issues)
    run = run_checks(src, f"{layout.checks}/run={uuid.uuid4().hex}", extra)
    scores = stored(quality.quality_scores(run.checks, run.names, at), layout.quality_scores)
    reached = contacts(src, scores)
    mails = stored(outreach(reached, at), layout.outreach)
    lists = stored(outreach_lists(reached), layout.outreach_lists)
    return {"bronze": bronze, "silver": silver, "gold": gold, "issues": issues, "quality_scores": scores,
            "outreach": mails, "outreach_lists": lists, "skipped_checks": run.skipped, "failed_checks": run.failures}


def extract_signals(spark: SparkSession, raw: DataFrame, layout: Layout, scorer, at, fallback=None, chunk=None,
                    attempts=3) -> dict:
    """Score records without signals, round by round, until all are answered or have failed ``attempts`` times.

    Each round has a run id of its own under the responses. Answers are stored before they are parsed, so the scorer
    runs once per record and round. Records that are answered, or have failed too often, leave the work list, so a
    restarted run goes on where the last one stopped and repeats one round at most. A round takes the whole list, or
    the first ``chunk`` records of it.
    """
    sinks.ensure_table(spark, layout.signals, TRUST_SIGNALS)
    sinks.ensure_table(spark, layout.errors, EXTRACTION_ERRORS)
    total = {"written": 0, "dropped": 0, "rounds": 0}
    while True:
        done = sinks.read_pinned(spark, layout.signals, TRUST_SIGNALS)
        failed = sinks.read_pinned(spark, layout.errors, EXTRACTION_ERRORS)
        todo = sig.render_prompt(sig.worklist(raw, done, failed, attempts, chunk))
        if chunk is not None:
            # a limit leaves one partition; the scorer should run on every core
            todo = todo.repartition(spark.sparkContext.defaultParallelism, "facility_id")
        answers = sig.score(todo, scorer, fallback).withColumn("responded_at", F.lit(at).cast("timestamp"))
        path = f"{layout.responses}/run={uuid.uuid4().hex}"
        sinks.overwrite(sinks.conform(answers, RAW_RESPONSES), path)
        stored_answers = sinks.read_pinned(spark, path, RAW_RESPONSES)
        if stored_answers.isEmpty():
            return total
        good, errors = sig.parse_signals(stored_answers)
        outcome = sinks.append_signals(good, layout.signals)
        sinks.append_errors(errors, layout.errors)
        total = {"written": total["written"] + outcome["written"], "dropped": total["dropped"] + outcome["dropped"],
                 "rounds": total["rounds"] + 1}


def publish(layers: dict, signals: DataFrame, target: Layout) -> list:
    """Snapshots of the served tables with their key columns."""
    return sinks.publish_all([
        (layers["gold"], ["unique_id"], target.facilities),
        (sig.latest_signals(signals), ["facility_id", "dimension"], target.trust_signals),
        (layers["quality_scores"], ["facility_id"], target.quality_scores),
        (layers["outreach"], ["email"], target.email_outreach),
        (layers["outreach_lists"], ["email", "list", "value"], target.email_outreach_lists),
    ])
