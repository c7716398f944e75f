"""Ranks and pages of tables of any size: rows are dealt into ranges of their order, and only counts of ranges meet.

A sort key is one struct that compares as the rows should be ordered. Bounds of the ranges come from a bounded sample of keys;
they decide how even the ranges are and nothing else.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

#: Ranges of one table and sampled keys a range; both bound what the driver holds.
RANGES, SAMPLED = 256, 16
#: Rows of a range in a stored result, and rows up to which a page is taken without ranges.
RANGE_ROWS, SHALLOW = 200_000, 10_000


def sort_key(*parts) -> Column:
    """A struct that orders rows by (column, descending) pairs, nulls last; numbers only may descend."""
    fields = []
    for i, (c, descending) in enumerate(parts):
        value = F.col(c) if isinstance(c, str) else c
        fields += [value.isNull().alias(f"n{i}"), (0 - value if descending else value).alias(f"k{i}")]
    return F.struct(*fields)


def range_bounds(rows: DataFrame, key: Column, ranges=RANGES) -> list:
    """At most ``ranges`` - 1 keys that cut the rows into ranges of about the same size, in order."""
    # the first by a hash are a sample that does not depend on how rows are dealt
    keys = rows.select(key.alias("key")).withColumn("at", F.xxhash64("key")).orderBy("at", "key").limit(ranges * SAMPLED)
    found = sorted({r["key"] for r in keys.collect()}, key=_order)
    cuts = [found[len(found) * i // ranges] for i in range(1, ranges) if found]
    return list(dict.fromkeys(cuts))


def _order(key: Row):
    return tuple((v is not None, v) if v is not None else (False,) for v in key)


def range_of(key: Column, bounds: list, kind) -> Column:
    """Number of the range that a key lies in: how many bounds are not above it, found by halving."""
    if not bounds:
        return F.lit(0)
    edges = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kind, strict=True)]) for b in bounds])
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda below, step: F.when(
        (below + step <= len(bounds)) & (F.get(edges, below + step - 1) <= key), below + step).otherwise(below))


def dealt(rows: DataFrame, key: Column, ranges=RANGES):
    """Rows with ``_key`` and ``_range``, and the number of ranges."""
    keyed = rows.withColumn("_key", key)
    bounds = range_bounds(keyed, F.col("_key"), ranges)
    return keyed.withColumn("_range", range_of(F.col("_key"), bounds, keyed.schema["_key"].dataType)), len(bounds) + 1


def before(counts: dict, ranges: int) -> list:
    """Rows in the ranges before each."""
    out, total = [], 0
    for i in range(ranges):
        out.append(total)
        total += counts.get(i, 0)
    return out


def with_rank(rows: DataFrame, *parts, ranges=RANGES, name="rank") -> DataFrame:
    """``rows`` with their rank by (column, descending) pairs, nulls last; equal rows share the smallest.

    Rows are counted by key, keys are dealt into ranges, and within a range a running sum counts the rows before each key;
    the sums of the ranges, at most ``ranges`` numbers, add what lies before the range. A key of very many rows is one row
    of the counts. No step sees more than a range.
    """
    key = sort_key(*parts)
    counted = rows.groupBy(key.alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    placed, n = dealt(counted, F.col("_value"), ranges)
    totals = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.sum("_n").alias("n")).collect()}
    line = W.partitionBy("_range").orderBy("_key").rowsBetween(W.unboundedPreceding, -1)
    start = F.get(F.lit(before(totals, n)), F.col("_range"))
    ranks = placed.select("_value", (F.coalesce(F.sum("_n").over(line), F.lit(0)) + start + 1).cast("int").alias(name))
    same = [F.col(f"_value.k{i}").eqNullSafe(F.col(f"_ranked.k{i}")) for i in range(len(parts))]
    return (rows.withColumn("_value", key).join(ranks.withColumnRenamed("_value", "_ranked"), reduce(lambda a, b: a & b, same))
            .drop("_value", "_ranked"))


def page(rows: DataFrame, key: Column, offset: int, size: int, shallow=SHALLOW, ranges=RANGES) -> DataFrame:
    """Rows ``offset`` to ``offset`` + ``size`` in the order of a unique ``key``.

    A page near the start is a top list. Any other one is found by the counts of the ranges: only the ranges that the page
    touches are sorted, and no more than one range and the page are passed over.
    """
    if offset + size <= shallow:
        return rows.withColumn("_key", key).orderBy("_key").offset(offset).limit(size).drop("_key")
    placed, n = dealt(rows, key, ranges)
    starts = before({r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect()}, n)
    first = max(i for i, s in enumerate(starts) if s <= offset)
    last = max(i for i, s in enumerate(starts) if s < offset + size)
    touched = placed.where(F.col("_range").between(first, last)).drop("_range")
    return touched.orderBy("_key").offset(offset - starts[first]).limit(size).drop("_key")


def after(rows: DataFrame, key: Column, cursor: tuple, size: int) -> DataFrame:
    """The ``size`` rows that follow ``cursor``, the values of the last row's key, whatever its depth.

    The cursor's row need not be there any more. ``_cursor`` of each row starts the page behind it.
    """
    keyed = rows.withColumn("_cursor", key)
    kind = keyed.schema["_cursor"].dataType
    values = [x for v in cursor for x in (v is None, v)]
    seen = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, kind, strict=True)])
    return keyed.where(F.col("_cursor") > seen).orderBy("_cursor").limit(size)


@dataclass
class StoredOrder:
    """A result stored in order: folders of ranges and, for each, the rows before it and its first key."""

    path: str
    schema: object
    starts: list
    rows: int
    firsts: list

    def page(self, spark, offset: int, size: int) -> DataFrame:
        """A page at any depth; it reads the folders that it touches and nothing else."""
        touched = [i for i, s in enumerate(self.starts) if s < offset + size and (self.starts[i + 1:i + 2] or [self.rows])[0] > offset]
        found = spark.read.schema(self.schema).parquet(self.path).where(F.col("_range").isin(*touched))
        skip = offset - self.starts[touched[0]] if touched else 0
        return found.orderBy("_key").offset(skip).limit(size).drop("_key", "_range")


def store_in_order(rows: DataFrame, key: Column, path: str, range_rows=RANGE_ROWS) -> StoredOrder:
    """Sort ``rows`` once into folders of about ``range_rows`` rows each, for reading many pages of one result."""
    spark, n = rows.sparkSession, rows.count()
    keyed = rows.withColumn("_key", key)
    line = keyed.repartitionByRange(max(1, -(-n // range_rows)), "_key").withColumn("_range", F.spark_partition_id())
    line.sortWithinPartitions("_range", "_key").write.mode("overwrite").partitionBy("_range").parquet(path)
    stored = spark.read.schema(line.schema).parquet(path)
    found = {r["_range"]: r for r in stored.groupBy("_range").agg(F.count("*").alias("n"), F.min("_key").alias("first")).collect()}
    ranges = max(found, default=0) + 1
    return StoredOrder(path, line.schema, before({i: r["n"] for i, r in found.items()}, ranges), sum(r["n"] for r in found.values()),
                       [found[i]["first"] if i in found else None for i in range(ranges)])
