"""Scores stored in buckets by id, so that a run for a few changed ids reads and writes their buckets only.

Each bucket has a current version, named by the last manifest row for it. A run writes new versions of the buckets it
touches to folders of its own and then adds its manifest rows in one file: readers see all of its buckets or none.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

BUCKETS = 64
MANIFEST = "seq long, bucket int, version string"


def bucket_of(c, buckets=BUCKETS):
    return F.pmod(F.xxhash64(F.col(c)), F.lit(buckets)).cast("int")


def current(spark: SparkSession, path: str) -> dict:
    """Version of each bucket, at most one number and one name a bucket."""
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{path}/manifest")
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    last = rows.withColumn("_n", F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("seq"), F.desc("version")))).where("_n = 1")
    return {r.bucket: (r.seq, r.version) for r in last.collect()}


def write_buckets(scores: DataFrame, path: str, touched, id_col="facility_id", buckets=BUCKETS) -> None:
    """New versions of the ``touched`` buckets; a bucket without rows is empty from then on."""
    spark, version = scores.sparkSession, uuid.uuid4().hex
    before = current(spark, path)
    if not touched:
        return
    rows = scores.withColumn("_bucket", bucket_of(id_col, buckets)).where(F.col("_bucket").isin(*touched))
    folder = f"{path}/versions/{version}"
    rows.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
    stored = spark.read.schema(rows.schema).parquet(folder)
    written = {r["_bucket"] for r in stored.select("_bucket").distinct().collect()}
    seq = max((s for s, _ in before.values()), default=0) + 1
    made = [(seq, b, version if b in written else "") for b in sorted(touched)]
    spark.createDataFrame(made, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def store(scores: DataFrame, path: str, id_col="facility_id", buckets=BUCKETS) -> None:
    """Store all scores."""
    write_buckets(scores, path, list(range(buckets)), id_col, buckets)


def read(spark: SparkSession, path: str, schema, touched=None) -> DataFrame:
    """Scores of all buckets, or of the ``touched`` ones: their folders are read and no others."""
    now = current(spark, path)
    folders = [f"{path}/versions/{v}/_bucket={b}" for b, (_, v) in sorted(now.items()) if v and (touched is None or b in touched)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def touched_buckets(changed: DataFrame, id_col="facility_id", buckets=BUCKETS) -> list:
    """Buckets of the changed ids: at most ``buckets`` numbers."""
    return sorted(r[0] for r in changed.select(bucket_of(id_col, buckets)).distinct().collect())


def rescore(path: str, gold: DataFrame, changed: DataFrame, score, schema, id_col="facility_id", gold_id="unique_id", buckets=BUCKETS) -> list:
    """Recompute the changed records of a stored table in place; returns the buckets that were read and rewritten.

    ``score`` maps a part of the records to score rows. Records of untouched buckets are neither scored nor read.
    """
    spark = changed.sparkSession
    touched = touched_buckets(changed, id_col, buckets)
    if not touched:
        return touched
    ids = changed.select(F.col(id_col)).distinct()
    redo = gold.join(ids.withColumnRenamed(id_col, gold_id), gold_id, "left_semi")
    kept = read(spark, path, schema, touched).join(ids, id_col, "left_anti")
    write_buckets(kept.unionByName(score(redo).select(kept.columns)), path, touched, id_col, buckets)
    return touched
