"""Checks that are run and staged one by one, so that one that fails on a row does not take the others with it.

A check may fail while its plan is built (a column that is not there) or only when it meets a row (a cast that cannot be done).
All row rules go in one scan, since they seldom fail; a scan that fails is done again in two halves until the failing
rules stand alone. Checks that are functions run one by one. What has run is staged as a table and read from there, so
that scores never evaluate a check again. Only faults of a check are caught: lost executors and storage that is
not there still stop the run.
"""

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, functions as F

from trustdesk.operators.quality import CONTRACT, Rule, duplicate_phone_penalties, location_rule, missing_rules, row_checks, usable_rules
from trustdesk.sources import sinks

FAILURES = "check string, phase string, condition string, message string"
#: Letters of a message that a failure keeps; the rest is the engine's own report.
MESSAGE = 2000


@dataclass
class CheckRun:
    """Staged ``checks`` of all that could run, their ``names`` in order, and the ``failures``."""

    checks: DataFrame
    names: list
    failures: DataFrame
    skipped: list = field(default_factory=list)


def fault_of(error: Exception):
    """The condition of an error that a check itself has caused, else None."""
    if isinstance(error, AnalysisException):
        return error.getCondition() or "ANALYSIS"
    if isinstance(error, PySparkException):
        # faults of the engine or the cluster have no SQL state of their own, or one of class XX or 58
        state = error.getSqlState()
        if state and state[:2] not in ("XX", "58"):
            return error.getCondition() or type(error).__name__
        if type(error).__name__ == "PythonException":
            return "PYTHON"
    return None


class Stage:
    """Runs checks over ``src`` and keeps what they give under ``folder``."""

    def __init__(self, src: DataFrame, folder: str):
        self.src, self.folder = src, folder
        self.paths, self.names, self.failures = [], [], []

    def run(self, names, build) -> bool:
        """Stage the rows of ``build``; False if the check cannot run on these rows."""
        path, phase = f"{self.folder}/part={len(self.paths)}-{uuid.uuid4().hex[:8]}", "plan"
        try:
            rows = build(self.src).select(CONTRACT)
            rows = rows.where(F.col("check").isin(*names))
            phase = "run"
            sinks.overwrite(sinks.conform(rows, CONTRACT_SCHEMA), path)
        except Exception as error:
            condition = fault_of(error)
            if condition is None:
                raise
            if len(names) == 1:
                self.failures.append((names[0], phase, condition, str(error)[:MESSAGE]))
            return False
        self.paths.append(path)
        self.names += names
        return True

    def rules(self, rules):
        """All rules in one scan, or in ever smaller parts where that fails."""
        if not rules or self.run([r.check for r in rules], lambda src: row_checks(src, rules)) or len(rules) == 1:
            return
        half = len(rules) // 2
        self.rules(rules[:half])
        self.rules(rules[half:])

    def done(self, order) -> CheckRun:
        spark = self.src.sparkSession
        names = [n for n in order if n in self.names]
        checks = (spark.read.schema(CONTRACT_SCHEMA).parquet(*self.paths) if self.paths
                  else spark.createDataFrame([], CONTRACT_SCHEMA))
        failures = spark.createDataFrame(self.failures, FAILURES)
        sinks.overwrite(failures, f"{self.folder}/failures")
        return CheckRun(checks, names, failures, [n for n in order if n not in names])


def _schema():
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    kinds = {"penalty_points": IntegerType()}
    return StructType([StructField(c, kinds.get(c, StringType())) for c in CONTRACT])


CONTRACT_SCHEMA = _schema()


def run_checks(src: DataFrame, folder: str, extra=()) -> CheckRun:
    """The implemented checks and further ones over stored records, each staged under ``folder``.

    ``extra`` holds rules and pairs of a name and a function from the records to rows with the contract's columns. A rule whose
    columns are missing or whose cast fails on a row, and a function that fails in either way, is named in the failures
    with what went wrong; all others score. Names must differ. A check that finds nothing has run.
    """
    built_in = [*missing_rules(), location_rule()]
    rules = [*built_in, *(x for x in extra if isinstance(x, Rule))]
    functions = [*(x for x in extra if not isinstance(x, Rule)), ("duplicate_phones", duplicate_phone_penalties)]
    order = [*(r.check for r in rules), *(name for name, _ in functions)]
    if len(set(order)) < len(order):
        raise ValueError("two checks have the same name")
    stage = Stage(src, folder)
    good, _ = usable_rules(src, rules)
    stage.rules(good)
    for rule in (r for r in rules if r not in good):
        stage.rules([rule])
    for name, build in functions:
        stage.run([name], build)
    return stage.done(order)
