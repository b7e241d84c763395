"""Vectors of a table as whole numbers, in Spark and in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows handled at once inside a batch.
BLOCK_ROWS = 4096


def all_finite(vector: Column) -> Column:
    """Whether a vector is there and every entry is a finite number."""

    def finite(e: Column) -> Column:
        number = e.cast("double")
        return e.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))

    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def scaled(vector: Column, factor: int, origin: int, largest: int) -> Column:
    """floor(factor * entry) + origin per entry as a long; beyond +-largest the product counts as that."""

    def whole(e: Column) -> Column:
        product = F.lit(float(factor)) * e.cast("double")
        held = F.least(F.greatest(product, F.lit(-float(largest))), F.lit(float(largest)))
        return F.floor(held).cast("long") + F.lit(origin)

    return F.transform(vector, whole)


def usual_length(rows: DataFrame, column: str) -> int:
    """The length that most vectors have; of equally frequent ones the greatest. 0 without rows."""
    lengths = rows.groupBy(F.size(column).alias("length")).count()
    top = lengths.orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return top[0]["length"] if top else 0


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """The lists of a column, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def blocks(batches):
    """The batches in parts of at most BLOCK_ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def summed(rows: DataFrame, number: str) -> dict[int, object]:
    """Sums of the column per slot; rows are (slot, number) with a bounded count of slots."""
    return {r["slot"]: r["total"] for r in rows.groupBy("slot").agg(F.sum(number).alias("total")).collect()}
