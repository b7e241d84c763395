"""Operator 13: centroid clustering with Ptolemaic pivots.

Entries become whole numbers floor(256 * c); all distances are squared, exact, as longs. The first centroids
are the vectors with the smallest SHA-256 of "seed:vec_id"; each round assigns every vector and moves each
centroid to the rounded-down mean of its vectors.

For a vector q, a centroid c and pivots p, s, Ptolemy's inequality gives
    d(q, c) * d(p, s) >= |d(q, p) * d(c, s) - d(q, s) * d(c, p)|.
The pivots are fixed, so d(q, p) is computed once and stored beside the vector, and d(c, p) once a round. Bounds are
rounded down by more than the products can be off; a centroid whose bound exceeds the best exact distance
so far cannot win, nor tie, and all others are compared exactly.

Rounds are narrow passes: a task sends sums per centroid and dimension, so neither copies of a vector nor a large
cluster gather anywhere. The driver holds centroids, pivots and these sums.

Cases: vectors of another length, null ones, and those with null or non-finite entries are left out. A product
beyond +-2**27 counts as that bound. Of equal distances the smaller number wins; a centroid without vectors
stays; fewer vectors than centroids give fewer centroids; vectors with a null id are clustered but are no
first centroids, and without any id no row is returned. Repeated rows stay. Inertia beyond a long is null. Other columns are not read. No rows give none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.vectors import all_finite, blocks, matrix, scaled, summed
from ticketloom.session import stored

FACTOR, LARGEST, DIMENSION = 256, 2**27, 64
CENTROIDS, ROUNDS, SEED = 40, 5, 2
PIVOTS = 6

# More than the relative error of a product of two rounded square roots, and of what is made of it.
SLACK = 2.0**-46


def squared(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to one point."""
    difference = x - point
    return np.einsum("ij,ij->i", difference, difference)


def spread_out(points: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` different points, each the farthest from those before it."""
    chosen = points[:1]
    while len(chosen) < min(most, len(points)):
        nearest = np.min([squared(points, p) for p in chosen], axis=0)
        if not nearest.max():
            break
        chosen = np.vstack([chosen, points[nearest.argmax()]])
    return chosen


class Assigner:
    """Nearest centroids with Ptolemaic bounds."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids = centroids
        pairs = list(combinations(range(len(pivots)), 2))
        self.first, self.second = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        to_pivots = np.sqrt(np.array([squared(pivots, c) for c in centroids], np.float64))
        self.to_first, self.to_second = to_pivots[:, self.first], to_pivots[:, self.second]
        self.apart = np.sqrt(np.array([squared(pivots[i : i + 1], pivots[j])[0] for i, j in pairs], np.float64))

    def bounds(self, to_pivots: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances: one row per vector, one column per centroid."""
        if not len(self.apart):
            return np.zeros((len(to_pivots), len(self.centroids)))
        one, two = to_pivots[:, self.first], to_pivots[:, self.second]
        found = np.empty((len(to_pivots), len(self.centroids)))
        for c in range(len(self.centroids)):
            left, right = one * self.to_second[c], two * self.to_first[c]
            least = (abs(left - right) - (left + right) * SLACK) / self.apart
            found[:, c] = least.max(axis=1)
        return np.maximum(found, 0) ** 2 * (1 - SLACK)

    def assign(self, x: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid, and how many distances were computed."""
        bounds = self.bounds(to_pivots)
        cluster = bounds.argmin(axis=1)
        difference = x - self.centroids[cluster]
        best = np.einsum("ij,ij->i", difference, difference)
        computed = len(x)
        guess = cluster.copy()
        for c in range(len(self.centroids)):
            left = np.flatnonzero((bounds[:, c] <= best) & (guess != c))
            distance = squared(x[left], self.centroids[c])
            closer = (distance < best[left]) | ((distance == best[left]) & (c < cluster[left]))
            cluster[left[closer]], best[left[closer]] = c, distance[closer]
            computed += len(left)
        return cluster, best, computed


def _parts(block: pa.RecordBatch, dimension: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    x = matrix(block.column("x"), dimension).astype(np.int64)
    return x, matrix(block.column("to_pivots"), pivots)


def _moved(rows: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    k, dimension = centroids.shape

    def run(batches):
        assigner = Assigner(centroids, pivots)
        totals = np.zeros((k, dimension + 1), np.int64)
        for block in blocks(batches):
            x, to_pivots = _parts(block, dimension, len(pivots))
            cluster, _, _ = assigner.assign(x, to_pivots)
            order = np.argsort(cluster, kind="stable")
            present, at = np.unique(cluster[order], return_index=True)
            totals[present, 1:] += np.add.reduceat(x[order], at, axis=0)
            totals[:, 0] += np.bincount(cluster, minlength=k)
        slots = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots.astype(np.int32)), pa.array(totals.ravel()[slots])], names=["slot", "number"]
        )

    sums = rows.mapInArrow(run, "slot INT, number LONG").withColumn("number", F.col("number").cast("decimal(38,0)"))
    found = summed(sums, "number")
    moved = centroids.copy()
    for c in range(k):
        base = c * (dimension + 1)
        count = int(found.get(base, 0))
        if count:
            moved[c] = [int(found.get(base + 1 + j, 0)) // count for j in range(dimension)]
    return moved


def clusters(
    embeddings: DataFrame,
    vector: str = "embedding",
    dimension: int = DIMENSION,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    pivots: int = PIVOTS,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the final centroid of every vector."""
    spark = embeddings.sparkSession
    schema = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}"
    rows = embeddings.select("vec_id", F.col(f"`{vector}`").alias("vector"))
    rows = rows.where(all_finite(F.col("vector")) & (F.size("vector") == dimension))
    rows = rows.select("vec_id", scaled(F.col("vector"), FACTOR, 0, LARGEST).cast("array<int>").alias("x"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id IS NOT NULL").orderBy(drawn, "x").limit(centroids).collect()
    if not first:
        return spark.createDataFrame(
            [], f"{schema}, cluster INT, distance LONG, cluster_inertia LONG, inertia LONG, centroid ARRAY<LONG>"
        )
    points = np.array([r["x"] for r in first], np.int64)
    fixed = spread_out(points, pivots)

    def measured(batches):
        for block in blocks(batches):
            x = matrix(block.column("x"), dimension).astype(np.int64)
            away = np.sqrt(np.array([squared(x, p) for p in fixed], np.float64)).T
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(fixed)), pa.array(away.ravel())
            )
            yield pa.RecordBatch.from_arrays([*block.columns, lists], names=["vec_id", "x", "to_pivots"])

    rows = stored(rows.mapInArrow(measured, f"{schema}, x ARRAY<INT>, to_pivots ARRAY<DOUBLE>"), "vectors")
    for _ in range(rounds):
        points = _moved(rows, points, fixed)

    def assigned(batches):
        assigner = Assigner(points, fixed)
        for block in blocks(batches):
            cluster, distance, _ = assigner.assign(*_parts(block, dimension, len(fixed)))
            yield pa.RecordBatch.from_arrays(
                [block.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cluster", "distance"],
            )

    found = stored(rows.mapInArrow(assigned, f"{schema}, cluster INT, distance LONG"), "clusters")
    by_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    # One row per centroid.
    totals = {r["cluster"]: int(r["total"]) for r in by_cluster.collect()}
    held = {c: t if t < 2**63 else None for c, t in totals.items()}
    whole = sum(totals.values())
    facts = [(c, held[c], whole if whole < 2**63 else None, points[c].tolist()) for c in totals]
    facts = spark.createDataFrame(facts, "cluster INT, cluster_inertia LONG, inertia LONG, centroid ARRAY<LONG>")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
