"""Writers: empty tables, appends under a pinned schema, overwrites and snapshot publishing."""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from trustdesk.operators.signals import valid_dimensions
from trustdesk.schemas import EXTRACTION_ERRORS, TRUST_SIGNALS


def ensure_table(spark: SparkSession, path: str, schema: StructType) -> None:
    """Create an empty table once; later calls leave it alone."""
    # an unpartitioned empty write leaves a file that carries the schema; an existing table is not touched
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def read_pinned(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read under the declared schema, so an empty or all-NULL table keeps its types."""
    return spark.read.schema(schema).parquet(path)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast and order columns to ``schema``; columns the frame lacks become NULL."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema))


def append_signals(signals: DataFrame, path: str) -> dict:
    """Append signals partitioned by dimension, dropping unknown dimensions.

    Written and dropped rows are observed during the write itself, so nothing is counted twice. Answers are small as stored and
    large as rows: the rows are dealt anew by size, so that what a writing task sorts does not follow the stored files. They
    are observed behind that, as an exchange without rows is taken out of a plan with all that was observed before it.
    """
    dropped, written = Observation(), Observation()
    dealt = conform(signals, TRUST_SIGNALS).hint("rebalance", "facility_id", "dimension")
    rows = valid_dimensions(dealt, dropped).observe(written, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("append").partitionBy("dimension").parquet(path)
    return {"written": written.get["rows"], "dropped": dropped.get["dropped"] or 0}


def append_errors(errors: DataFrame, path: str) -> None:
    conform(errors, EXTRACTION_ERRORS).write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str, partition_by=()) -> None:
    """Replace a table; columns may change from run to run."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


@dataclass
class Published:
    target: str
    ok: bool
    rows: int = None
    error: str = None
    version: str = None


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


#: A pointer row: versions are ordered by ``seq``; the last one is what readers see.
POINTER = "seq long, version string, rows long, digest string"


def _digest():
    """Checksum of a table's rows whatever their order."""
    return F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")).cast("string")


def versions(spark: SparkSession, target: str) -> DataFrame:
    """All published versions of a snapshot, none where nothing has been published."""
    spark.createDataFrame([], POINTER).write.mode("ignore").parquet(f"{target}/_pointers")
    return spark.read.schema(POINTER).parquet(f"{target}/_pointers")


def current_version(spark: SparkSession, target: str):
    """The version that readers see, or None."""
    return versions(spark, target).orderBy(F.desc("seq"), F.desc("version")).limit(1).first()


def read_snapshot(spark: SparkSession, target: str, schema: StructType = None) -> DataFrame:
    """The current snapshot; a publish that fails or is under way does not change it."""
    now = current_version(spark, target)
    if now is None:
        raise FileNotFoundError(f"nothing has been published under {target}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{target}/versions/{now.version}")


def publish_snapshot(df: DataFrame, keys, target: str) -> Published:
    """Publish one full snapshot for a serving store as a new version; the one before stays readable until the end.

    Keys must be unique. The version is written to a folder of its own and read back; only when its rows and their
    checksum are those that were sent is its pointer row added, which is one file and thus all or nothing. Whatever fails
    before that leaves readers with the old version.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    try:
        before = current_version(spark, target)
        written = Observation()
        path = f"{target}/versions/{version}"
        df.observe(written, F.count(F.lit(1)).alias("rows"), _digest().alias("digest")).write.parquet(path)
        stored = spark.read.schema(df.schema).parquet(path)
        if not duplicate_keys(stored, keys).isEmpty():
            raise ValueError(f"{', '.join(keys)} is not unique")
        found = stored.agg(F.count(F.lit(1)).alias("rows"), _digest().alias("digest")).first()
        sent = written.get
        if (found["rows"], found["digest"]) != (sent["rows"], sent["digest"]):
            raise ValueError(f"{sent['rows']} rows were sent, {found['rows']} are stored, or they differ")
        seq = before.seq + 1 if before else 1
        pointer = spark.createDataFrame([(seq, version, found["rows"], found["digest"])], POINTER)
        pointer.coalesce(1).write.mode("append").parquet(f"{target}/_pointers")
        return Published(target, True, found["rows"], version=version)
    except Exception as e:
        return Published(target, False, error=f"{type(e).__name__}: {e}")


def expired(spark: SparkSession, target: str, keep=2) -> list:
    """Folders of all versions but the last ``keep``, for a clean-up that knows when the last reader has left."""
    old = versions(spark, target).orderBy(F.desc("seq"), F.desc("version")).offset(keep).collect()
    return [f"{target}/versions/{r.version}" for r in old]


def publish_all(tables) -> list:
    """Publish (frame, keys, target) triples; one failure does not stop the others."""
    return [publish_snapshot(*t) for t in tables]
