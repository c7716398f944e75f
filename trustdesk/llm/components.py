"""Connected components of a graph given as edges, by alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from trustdesk.llm.common import stored


def large_star(edges):
    """Every node hands its larger neighbours the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges):
    """Every node hands its smaller neighbours, and itself, the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    handed = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that it reaches, for every node of ``edges`` (longs ``u`` and ``v``).

    Loops and repeated edges change nothing; no edges give no rows. Minima are taken per node with partial sums, a
    node with very many edges is one large key of a join that can be split, and each round is written to the shared
    folder. Only counts reach the driver.
    """
    flat = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(flat, "edges")
    while True:
        degree = now.groupBy("u").agg(F.count("*").alias("n"))
        roots = now.select(F.col("v").alias("u")).distinct()
        if not degree.where("n > 1").limit(1).count() and not roots.join(now, "u", "left_semi").limit(1).count():
            break
        now = stored(small_star(stored(large_star(now).distinct(), "large")).distinct(), "small")
    alone = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(alone)
