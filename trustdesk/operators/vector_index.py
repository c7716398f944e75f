"""Nearest vectors through an inverted-file index, exactly.

Vectors are scaled to length one and filed under the nearest of some centroids, in blocks that are rings around it: all
vectors of a block lie between two angles from the centroid. Angles obey the triangle inequality, so a query at angle t of the
centroid is at least ``t - high`` or ``low - t`` away from every vector of the block. A search first looks into the cell of
each query, which gives a similarity that k vectors reach; then it looks into the blocks that may hold better ones and no
others. Results are those of comparing everything, whatever the centroids are.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Centroids are fitted to at most SAMPLE vectors, the first by the hash of their ids, and are at most CELLS.
SAMPLE, CELLS = 1 << 16, 1 << 10
#: Vectors of a block, and of a share of a cell that one task files.
BLOCK, SHARE = 256, 1 << 18
ROUNDS = 10
#: Vectors that are compared with all centroids, or with a block, at once.
STEP = 512
#: Similarities are rounded to DIGITS; bounds leave room for that and for the rounding of angles.
DIGITS, SLACK = 9, 1e-7
FILED = "cell int, low double, high double, ids binary, units binary"


@dataclass
class VectorIndex:
    """Centroids, at most CELLS rows of an array, and the folder of the filed blocks."""

    spark: SparkSession
    centroids: np.ndarray
    path: str

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(FILED).parquet(self.path)


def unit_rows(vectors) -> np.ndarray:
    x = np.array(list(vectors), dtype="float64")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector) -> bool:
    return vector is not None and len(vector) > 0 and all(v is not None for v in vector) and any(vector)


def fit_centroids(units: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from every n-th vector on; a centroid that loses all its vectors stays where it was."""
    centroids = units[np.linspace(0, len(units) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, units)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centroids)
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def angles(units, centroids):
    return np.arccos(np.clip(units @ centroids.T, -1.0, 1.0))


def steps(n: int) -> list:
    return [slice(i, i + STEP) for i in range(0, n, STEP)]


def nearest_cells(units, centroids):
    """Number of the nearest centroid of each vector and the angle to it, step by step: memory does not follow the cells."""
    cell, angle = np.empty(len(units), "int64"), np.empty(len(units))
    for at in steps(len(units)):
        away = angles(units[at], centroids)
        cell[at] = away.argmin(axis=1)
        angle[at] = np.take_along_axis(away, cell[at, None], axis=1)[:, 0]
    return cell, angle


def build(vectors: DataFrame, path: str, id_col="vec_id", vector="embedding", cells=None) -> VectorIndex:
    """File all ``vectors`` under ``path``. Vectors that are missing or of length zero are similar to nothing and left out.

    As many cells as the square root of the rows, CELLS at most. Only the sample reaches the driver. A cell of very many
    vectors is filed by several tasks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    some = some[some["vector"].map(usable)]
    wanted = cells or min(CELLS, max(1, round(rows.count() ** 0.5)))
    centroids = fit_centroids(unit_rows(some["vector"]), min(wanted, len(some))) if len(some) else np.zeros((0, 1))
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch in batches:
            batch = batch[batch["vector"].map(usable)]
            if len(batch) and len(sent.value):
                units = unit_rows(batch["vector"])
                cell, angle = nearest_cells(units, sent.value)
                yield pd.DataFrame({"cell": cell.astype("int32"), "angle": angle, "id": batch["id"].to_numpy(), "unit": [u.tobytes() for u in units]})

    def file(batches):
        held, now = [], None
        for batch in batches:
            for cell, angle, ident, unit in zip(*[batch[c] for c in ("cell", "angle", "id", "unit")], strict=True):
                if held and (cell != now or len(held) == BLOCK):
                    yield filed(now, held)
                    held = []
                now = cell
                held.append((angle, ident, unit))
        if held:
            yield filed(now, held)

    def filed(cell, held):
        return pd.DataFrame({"cell": [cell], "low": [held[0][0]], "high": [held[-1][0]],
                             "ids": [np.array([h[1] for h in held], "int64").tobytes()], "units": [b"".join(h[2] for h in held)]})

    placed = rows.mapInPandas(assign, "cell int, angle double, id long, unit binary")
    share = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-rows.count() // (SHARE * max(1, len(centroids)))))))
    line = placed.repartition("cell", share).sortWithinPartitions("cell", "angle", "id")
    line.mapInPandas(file, FILED).write.mode("overwrite").parquet(path)
    return VectorIndex(spark, centroids, path)


def asked(index: VectorIndex, queries: DataFrame, id_col, vector, reached: DataFrame = None) -> DataFrame:
    """``cell``, ``ids``, ``units``, ``angles`` and ``least`` of the queries that look into a cell, packed by batch.

    Without ``reached`` each query looks into its nearest cell; with it (``query_id`` and the similarity that k vectors have
    reached) into all cells that are not ruled out.
    """
    sent = index.spark.sparkContext.broadcast(index.centroids)
    reach = index.blocks().groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()  # CELLS rows
    ring = index.spark.sparkContext.broadcast({int(r.cell): (r.low, r.high) for r in reach.itertuples()})
    first = reached is None
    rows = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.withColumn("least", F.lit(-2.0)) if first else rows.join(reached, "query_id", "left").withColumn(
        "least", F.coalesce("least", F.lit(-2.0)))

    def look(batches):
        centroids = sent.value
        for batch in batches:
            batch = batch[batch["vector"].map(usable)]
            if not len(batch) or not len(centroids):
                continue
            units, ids, least = unit_rows(batch["vector"]), batch["query_id"].to_numpy("int64"), batch["least"].to_numpy("float64")
            inside = np.zeros((len(ids), len(centroids)), bool)
            if first:
                filled = np.array(sorted(ring.value))
                inside[np.arange(len(ids)), filled[nearest_cells(units, centroids[filled])[0]] if len(filled) else 0] = True
            else:
                low, high = (np.array([ring.value.get(c, (9.0, -9.0))[i] for c in range(len(centroids))]) for i in (0, 1))
                for at in steps(len(ids)):
                    away = angles(units[at], centroids)
                    gap = np.maximum(0, np.maximum(away - high, low - away))
                    inside[at] = (np.cos(np.minimum(gap, np.pi)) + SLACK >= least[at, None]) & (high >= 0)
            for cell in np.flatnonzero(inside.any(axis=0)):
                at = np.flatnonzero(inside[:, cell])
                away = angles(units[at], centroids[[cell]])[:, 0]
                yield pd.DataFrame({"cell": np.array([cell], "int32"), "query_ids": [ids[at].tobytes()], "query_units": [units[at].tobytes()],
                                    "query_angles": [away.tobytes()], "query_least": [least[at].tobytes()]})

    return rows.mapInPandas(look, "cell int, query_ids binary, query_units binary, query_angles binary, query_least binary")


def compare(index: VectorIndex, looks: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query in each block that its ring does not rule out, and the vectors ``compared`` for them."""
    def best(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, away = np.frombuffer(row.query_ids, "int64"), np.frombuffer(row.query_angles)
                units, least = np.frombuffer(row.query_units).reshape(len(ids), -1), np.frombuffer(row.query_least)
                gap = np.maximum(0, np.maximum(away - row.high, row.low - away))
                at = np.flatnonzero(np.cos(np.minimum(gap, np.pi)) + SLACK >= least)
                found, block = np.frombuffer(row.ids, "int64"), np.frombuffer(row.units).reshape(len(row.ids) // 8, -1).T
                for some in (at[part] for part in steps(len(at))):
                    similar = np.round(units[some] @ block, DIGITS)
                    matches = np.broadcast_to(found, similar.shape)
                    order = np.lexsort((matches, -similar), axis=1)[:, :k]
                    n = order.shape[1]
                    compared = np.zeros((len(some), n), "int64")
                    compared[:, 0] = len(found)
                    yield pd.DataFrame({"query_id": np.repeat(ids[some], n), "match_id": np.take_along_axis(matches, order, axis=1).ravel(),
                                        "similarity": np.take_along_axis(similar, order, axis=1).ravel(), "compared": compared.ravel()})

    pairs = looks.join(index.blocks(), "cell").select(
        "query_ids", "query_units", "query_angles", "query_least", "ids", "units", "low", "high")
    return pairs.mapInPandas(best, "query_id long, match_id long, similarity double, compared long")


def search(index: VectorIndex, queries: DataFrame, k=5, id_col="vec_id", vector="embedding") -> DataFrame:
    """The ``k`` most similar vectors of each query: ``query_id``, ``match_id``, ``similarity``, ``rank`` and ``compared``, the
    vectors that the query was compared with. Of equally similar ones the smaller id comes first."""
    line = W.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id")
    first = compare(index, asked(index, queries, id_col, vector), k).withColumn("rank", F.row_number().over(line))
    reached = first.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("least"))
    partial = compare(index, asked(index, queries, id_col, vector, reached), k)
    total = partial.groupBy("query_id").agg(F.sum("compared").alias("compared"))
    best = partial.drop("compared").withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)
    return best.join(total, "query_id")
