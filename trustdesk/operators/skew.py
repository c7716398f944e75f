"""Equi-joins that survive a key holding a large share of the rows.

A key is hot when ``hot_rows`` rows or more carry it. The list of hot keys is broadcast; its size is
bounded by construction, since N rows hold at most N / hot_rows such keys (100,000 for 10^11 rows at
the default), whatever the data looks like. Keys below the limit join by an ordinary shuffle.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 1_000_000


def _names(on):
    return [on] if isinstance(on, str) else list(on)


def _hot_keys(rows, on, counts, hot_rows):
    if counts is None:
        counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= hot_rows)


def hot_split_join(rows: DataFrame, lookup: DataFrame, on, how="inner", counts: DataFrame = None,
                   hot_rows: int = None) -> DataFrame:
    """Join ``rows`` (any number per key) to ``lookup`` (one row per key) on the columns ``on``.

    Rows of hot keys meet their lookup row by broadcast and never move, so even exact copies of one row
    stay spread out. Where no key is hot, adaptive execution sees the empty broadcast and drops the hot
    branch before it scans anything. ``counts`` is an optional frame (``on``, ``n``) of rows per key.
    """
    on, hot_rows = _names(on), hot_rows or HOT_ROWS
    keys = _hot_keys(rows, on, counts, hot_rows).select(*on)
    no_key = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in on))
    keyed = rows.where(~no_key)
    hot = keyed.join(F.broadcast(keys.join(lookup, on, how)), on)
    out = keyed.join(F.broadcast(keys), on, "left_anti").join(lookup, on, how).unionByName(hot)
    if how == "left":
        # rows without a key match nothing; they are passed on instead of meeting in one task
        out = out.unionByName(rows.where(no_key), allowMissingColumns=True)
    return out


def salted_join(rows: DataFrame, lookup: DataFrame, on, spread_on, how="inner", counts: DataFrame = None,
                hot_rows: int = None) -> DataFrame:
    """The same join in one pass, for ``rows`` that are distinct on ``on`` + ``spread_on``.

    Rows of a hot key are dealt out by a hash of ``spread_on`` and the lookup rows of that key are
    repeated once per share. ``lookup`` may hold several rows per key.
    """
    on, spread_on, hot_rows = _names(on), _names(spread_on), hot_rows or HOT_ROWS
    hot = _hot_keys(rows, on, counts, hot_rows).select(
        *on, F.ceil(F.col("n") / hot_rows).cast("int").alias("_shares"))
    dealt = (rows.join(F.broadcast(hot), on, "left")
             .withColumn("_share", F.coalesce(F.pmod(F.xxhash64(*spread_on), F.col("_shares")), F.lit(0)).cast("int"))
             .drop("_shares"))
    repeated = (lookup.join(F.broadcast(hot), on, "left")
                .withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)))
                .drop("_shares"))
    return dealt.join(repeated, [*on, "_share"], how).drop("_share")
