"""Operators described only in the starter texts: change history, validity ranges, sales and moderation
figures, nearest vectors and paragraph cuts."""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from trustdesk.operators.curate import first_by


def cdc_current(changes: DataFrame, keys, order, op="op", deleted="delete") -> DataFrame:
    """Current rows from insert/update/delete history: latest change per key, deletions left out."""
    return first_by(changes, keys, [F.desc(c) for c in order]).where(F.col(op) != deleted)


def scd2(changes: DataFrame, keys, order, tiebreak, bucket="day") -> DataFrame:
    """Validity ranges of every version; the last one is current and has no end.

    Versions are ordered within (key, ``bucket`` of time), so a key with very many versions is worked on by
    many tasks. The last version of a bucket ends where the key's next bucket starts; that second step sees
    one row per key and bucket. A missing key is a key of its own, and versions without a time come first.
    """
    keys = list(keys)
    cut = changes.withColumn("_bucket", F.date_trunc(bucket, F.col(order)))
    within = W.partitionBy(*keys, "_bucket").orderBy(order, tiebreak)
    starts = cut.groupBy(*keys, "_bucket").agg(F.min(order).alias("_start"))
    line = W.partitionBy(*keys).orderBy("_bucket")
    following = starts.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_bucket").alias("_of"),
                              F.lead("_start").over(line).alias("_next_start"),
                              F.lead(F.lit(True)).over(line).alias("_more"))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys] + [F.col("_bucket").eqNullSafe(F.col("_of"))]
    ranges = (cut.withColumn("_next", F.lead(order).over(within)).withColumn("_later", F.lead(F.lit(True)).over(within))
              .join(following, reduce(lambda a, b: a & b, same)))
    until = F.when(F.col("_later"), F.col("_next")).otherwise(F.col("_next_start"))
    return ranges.select(*changes.columns, F.col(order).alias("valid_from"), until.alias("valid_to"),
                         (F.col("_later").isNull() & F.col("_more").isNull()).alias("is_current"))


def daily_units(sales: DataFrame, keys, ts, units) -> DataFrame:
    """Units per key and day, pre-aggregated so that later windows see one row per day."""
    return sales.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.sum(units).alias("units"))


def velocity(daily: DataFrame, keys, days=30) -> DataFrame:
    """Mean units per calendar day over the last ``days`` days before each day, the day included."""
    w = W.partitionBy(*keys).orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return daily.withColumn("velocity", F.sum("units").over(w) / days)


def moving_average(daily: DataFrame, keys, weights) -> DataFrame:
    """Weighted mean of the latest sales days, newest weight first; early days use the weights they have."""
    w = W.partitionBy(*keys).orderBy("day")
    terms = [(F.lag("units", n).over(w) if n else F.col("units"), weight) for n, weight in enumerate(weights)]
    total = sum(F.coalesce(value * weight, F.lit(0.0)) for value, weight in terms)
    used = sum(F.when(value.isNotNull(), weight).otherwise(0.0) for value, weight in terms)
    return daily.withColumn("forecast", total / used)


def unit_forecast(daily: DataFrame, keys, weights, days=30) -> DataFrame:
    """Units expected in the ``days`` days after the last day of the table, per key.

    A weighted moving average over as many windows of ``days`` days as there are weights, the newest first. A window
    without sales counts as none, a key without sales in all of them is expected to sell nothing. One sum per key, with
    partial sums in each task.
    """
    last = daily.agg(F.max("day")).scalar()
    window = F.floor(F.date_diff(last, "day") / days)
    share = F.coalesce(F.get(F.array(*(F.lit(float(w)) for w in weights)), window.cast("int")), F.lit(0.0))
    return daily.groupBy(*keys).agg((F.sum(F.col("units") * share) / sum(weights)).alias("forecast"))


def low_stock(stock: DataFrame, speed: DataFrame, keys, on_hand="on_hand", days_left=14) -> DataFrame:
    """Items whose stock lasts fewer than ``days_left`` days at their current speed."""
    lasts = F.col(on_hand) / F.nullif(F.col("velocity"), F.lit(0.0))
    return (stock.join(speed, keys).withColumn("days_left", lasts).where(F.col("days_left") < days_left))


def moderation_metrics(reviews: DataFrame, target, approved, score) -> DataFrame:
    """Submissions, approval rate and mean score per target."""
    return reviews.groupBy(target).agg(
        F.count(F.lit(1)).alias("submissions"), F.avg(F.when(approved, 1.0).otherwise(0.0)).alias("approval_rate"),
        F.avg(score).alias("avg_score"))


#: Vectors that are compared together, and stored ones of a part; small tables are dealt into LEAST_PARTS.
BLOCK, PART_ROWS, LEAST_PARTS = 1_000, 50_000, 32


def query_vectors(df: DataFrame, id_col, vector):
    """Query vectors for ``cosine_topk``; they stay on Spark."""
    return df.select(id_col, vector)


def parts_for(rows: int) -> int:
    """Parts that grow with the stored vectors, so that a task's share does not."""
    return max(LEAST_PARTS, -(-rows // PART_ROWS))


def vector_blocks(df: DataFrame, id_col, vector, size) -> DataFrame:
    """``block`` (a number), ``ids`` and ``units`` (bytes): at most ``size`` vectors a row, scaled to length one."""
    def pack(batches):
        for batch in batches:
            batch = batch[batch["vector"].map(lambda v: v is not None and any(v))]
            for at in range(0, len(batch), size):
                part = batch[at:at + size]
                units = np.array(part["vector"].tolist(), dtype="float64")
                units /= np.linalg.norm(units, axis=1, keepdims=True)
                yield pd.DataFrame({"ids": [part["id"].to_numpy(dtype="int64").tobytes()], "units": [units.tobytes()]})

    named = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector"))
    return named.mapInPandas(pack, "ids binary, units binary").withColumn("block", F.monotonically_increasing_id())


def cosine_topk(vectors: DataFrame, queries, k=5, id_col="vec_id", vector="embedding", block=BLOCK) -> DataFrame:
    """The ``k`` most similar stored vectors of each query vector.

    ``queries`` is a table of query ids and vectors, or a list of such pairs. Both sides are packed into blocks of at most
    ``block`` vectors; stored blocks are dealt into parts of some PART_ROWS vectors and every query block goes to each part, so that a task
    holds a block of each side at a time. It keeps the best ``k`` per query of a block until the next query block comes;
    these meet by query id. A vector of length zero, or a missing one, is similar to nothing and has no row.
    """
    if not isinstance(queries, DataFrame):
        queries = vectors.sparkSession.createDataFrame(
            [(q, None if v is None else [float(x) for x in v]) for q, v in queries], "query_id long, vector array<double>")
    parts = parts_for(vectors.count())
    asked = vector_blocks(queries, *queries.columns[:2], block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    stored = vector_blocks(vectors, id_col, vector, block).select(
        F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), F.col("ids").alias("match_ids"), F.col("units").alias("match_units"))
    pairs = asked.hint("merge").join(stored, "part").select("part", "block", "ids", "units", "match_ids", "match_units")

    def best(batches):
        at, kept = None, None

        def done():
            ids, matches, values = kept
            return pd.DataFrame({"query_id": np.repeat(ids, values.shape[1]), "match_id": matches.ravel(), "similarity": values.ravel()})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if at != (row.part, row.block):
                    if kept:
                        yield done()
                    ids = np.frombuffer(row.ids, dtype="int64")
                    at, kept = (row.part, row.block), (ids, np.empty((len(ids), 0), dtype="int64"), np.empty((len(ids), 0)))
                ids, matches, values = kept
                found = np.frombuffer(row.match_ids, dtype="int64")
                similar = np.frombuffer(row.units).reshape(len(ids), -1) @ np.frombuffer(row.match_units).reshape(len(found), -1).T
                matches = np.concatenate([matches, np.broadcast_to(found, similar.shape)], axis=1)
                values = np.concatenate([values, np.round(similar, 9)], axis=1)
                order = np.lexsort((matches, -values), axis=1)[:, :k]
                kept = ids, np.take_along_axis(matches, order, axis=1), np.take_along_axis(values, order, axis=1)
        if kept:
            yield done()

    partial = pairs.mapInPandas(best, "query_id long, match_id long, similarity double")
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def chunk_paragraphs(documents: DataFrame, id_col="doc_id", text="text", blank=r"\n\s*\n") -> DataFrame:
    """Paragraphs of each document, numbered, empty ones left out."""
    parts = F.filter(F.transform(F.split(text, blank), lambda p: F.trim(p)), lambda p: p != "")
    return documents.select(id_col, F.posexplode(parts).alias("chunk", "paragraph"))
