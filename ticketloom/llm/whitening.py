"""Operator 11: whitening of embeddings by spectrum slicing.

Entries become whole numbers x = floor(64 * c) + 1,000,000. The covariance of the distinct vectors is exact:
sums first, then products of the differences from the rounded mean, as integers, in one pass each; the driver
holds one matrix of the dimension. Its leading eigenpairs come from inertia counts and Rayleigh quotient
iteration (see spectrum). Rows are whitened in one narrow pass; copies of a vector meet on the map side of one
aggregation, however many they are.

Cases: rows whose vector is null or empty, or holds a null or non-finite entry, are left out, and so are vectors
of another length than most have (of equally frequent lengths the greatest counts). A product beyond +-2**53
counts as that bound. Repeated rows and null ids stay, one result each. Components whose eigenvalue is zero up to
rounding cannot be whitened and are left out: one distinct vector, or none, gives no rows. A deviation
beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm import spectrum
from ticketloom.llm.vectors import all_finite, blocks, matrix, scaled, summed, usual_length
from ticketloom.session import stored

FACTOR, ORIGIN, LARGEST = 64, 1_000_000, 2**53
COMPONENTS = 16

SCHEMA = "component INT, n LONG, deviation LONG, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE"


@dataclass(frozen=True)
class Whitening:
    """n, the whole-number centre near the mean, sums of the differences from it, and the components' rows."""

    n: int
    centre: list[int]
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S of each row, exact; Python integers where a long would not hold what follows."""
        y = x - np.array(self.centre, np.int64)
        largest = int(abs(y).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if largest**2 * x.shape[1] < 2**63:
            return y * self.n - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        projection = (self.vectors / np.sqrt(self.values)[:, None]).astype(np.float64)
        return (centred / self.n).astype(np.float64) @ projection.T


def exact_products(y: np.ndarray) -> np.ndarray:
    """y^T y of whole numbers, exact: by floating point where no partial sum can leave its whole numbers."""
    if int(abs(y).max(initial=0)) ** 2 * len(y) < 2**53:
        exact = y.astype(np.float64)
        return (exact.T @ exact).astype(np.int64).astype(object)
    exact = y.astype(object)
    return exact.T @ exact


def _totals(fit: DataFrame, dimension: int, of_block, slots: int, kind: str) -> dict:
    """Sums over all rows of what `of_block` makes of a block of x; each task sends one row per slot."""
    made = pa.decimal128(38) if kind.startswith("DECIMAL") else pa.float64()

    def run(batches):
        total = None
        for block in blocks(batches):
            found = of_block(matrix(block.column("x"), dimension))
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(slots, dtype=np.int32)), pa.array(total.tolist()).cast(made)],
                names=["slot", "number"],
            )

    return summed(fit.mapInArrow(run, f"slot INT, number {kind}"), "number")


def _vectors(embeddings: DataFrame, vector: str) -> tuple[DataFrame, int]:
    rows = embeddings.select("vec_id", F.col(f"`{vector}`").alias("vector"))
    rows = rows.where(all_finite(F.col("vector")) & (F.size("vector") > 0))
    dimension = usual_length(rows, "vector")
    rows = rows.where(F.size("vector") == dimension)
    return rows.select("vec_id", scaled(F.col("vector"), FACTOR, ORIGIN, LARGEST).alias("x")), dimension


def _of_distinct(fit: DataFrame, dimension: int, components: int) -> Whitening | None:
    """The whitening of the fit list; None where no component has variance."""
    size = dimension + 1

    def counts(x):
        return np.array([len(x), *(x - ORIGIN).astype(object).sum(axis=0)], object)

    found = _totals(fit, dimension, counts, size, "DECIMAL(38,0)")
    n = int(found.get(0, 0))
    if n < 2:
        return None
    sums = [int(found[i]) for i in range(1, size)]
    offsets = [(2 * s + n) // (2 * n) for s in sums]
    centre, sums = [o + ORIGIN for o in offsets], [s - n * o for s, o in zip(sums, offsets)]
    upper = np.triu_indices(dimension)
    whole = np.array(centre, np.int64)
    found = _totals(
        fit, dimension, lambda x: exact_products(x - whole)[upper], len(upper[0]), "DECIMAL(38,0)"
    )
    covariance = np.zeros((dimension, dimension), np.longdouble)
    for slot, (i, j) in enumerate(zip(*upper)):
        # Whole numbers up to here: only the quotient is rounded.
        exact = n * int(found[slot]) - sums[i] * sums[j]
        covariance[i, j] = covariance[j, i] = np.longdouble(str(exact)) / np.longdouble(str(n * n))
    values, vectors = spectrum.leading(covariance, components)
    if not len(values):
        return None
    explained = (values / covariance.trace()).astype(np.float64)
    return Whitening(n, centre, sums, vectors, values, explained)


def _identity_error(fit: DataFrame, dimension: int, of: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity, measured on all of it."""
    k = len(of.values)

    def moments(x):
        w = of.whitened(of.centred(x))
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = _totals(fit, dimension, moments, k + k * k, "DOUBLE")
    mean = np.array([found[i] for i in range(k)]) / of.n
    second = np.array([found[k + i] for i in range(k * k)]).reshape(k, k) / of.n
    return float(abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whitened(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: see the contract's columns in SCHEMA."""
    rows, dimension = _vectors(embeddings, vector)
    schema = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, {SCHEMA}"
    # Each distinct vector once; copies are combined before the shuffle.
    fit = stored(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"), "fit-list")
    of = _of_distinct(fit, dimension, components) if dimension else None
    if of is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = _identity_error(fit, dimension, of)
    k, longest = len(of.values), 2**63 - 1

    def run(batches):
        for block in blocks(batches):
            centred = of.centred(matrix(block.column("x"), dimension))
            squares = (centred * centred).sum(axis=1).tolist()
            deviation = pa.array([s if s <= longest else None for s in squares], pa.int64())
            each = np.repeat(np.arange(block.num_rows), k)
            repeated = pa.array(each)
            rows = len(each)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("vec_id").take(repeated),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), block.num_rows)),
                    pa.array(np.full(rows, of.n)),
                    deviation.take(repeated),
                    pa.array(of.whitened(centred).ravel()),
                    pa.array(np.tile(of.explained, block.num_rows)),
                    pa.array(np.full(rows, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
