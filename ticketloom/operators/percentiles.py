"""Grouped summaries with exact, linearly interpolated percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions.measures import Measure, columns

# Cells per doubling of the value. A cell of waits of a day spans fewer than 58,000 different microseconds, one of waits
# of a year 21 million; and a group with waits from a microsecond to a year has 47 million cells at most. A
# task puts either in order, and no more, as narrow rows that it can sort on disk.
CELLS_PER_OCTAVE = 1 << 20
# Values are counted in steps of one microsecond when given in hours.
CELL_UNIT = 3.6e9


def summarize(
    df: DataFrame,
    keys: list[str],
    measures: list[Measure],
    value: str,
    percentiles: dict[str, float],
    in_task: bool = False,
) -> DataFrame:
    """Measures and percentiles of `value` per group, the same values by either plan.

    The input is evaluated once: rows of one value of a group are combined on the map side into their
    number and the parts of the measures, and one shuffle of these gives both measures and ranks, for groups of
    any size. A caller who knows that no group has more different values than a task holds can ask for
    Spark's own aggregate.
    """
    if in_task:
        exact = [F.percentile(value, p).alias(name) for name, p in percentiles.items()]
        return df.groupBy(*keys).agg(*columns(*measures), *exact)

    counted = _counted(df, keys, value, measures)
    cells = _cells(counted, keys, measures)
    base = _all_columns(cells).groupBy(*keys).agg(*[m.merged() for m in measures])
    ranked = _ranked(counted, cells, keys, value, percentiles)
    if not keys:
        # Two frames of one row each: stack them and fold, rather than pair them.
        stacked = base.unionByName(ranked, allowMissingColumns=True)
        return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    return _join_on(base, ranked, keys, "left").select(*base.columns, *percentiles)


def distributed_percentiles(
    df: DataFrame, keys: list[str], value: str, percentiles: dict[str, float]
) -> DataFrame:
    """Exact percentiles without gathering a group in one task."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    counted = _counted(rows, keys, value, [])
    return _ranked(counted, _cells(counted, keys, []), keys, value, percentiles)


def _counted(df: DataFrame, keys: list[str], value: str, measures: list[Measure]) -> DataFrame:
    """A row per group and different value, NULL included: rows with a value, and the parts of the measures."""
    size = F.log2(F.abs(value) * F.lit(CELL_UNIT) + 1.0) * F.lit(float(CELLS_PER_OCTAVE))
    cell = (F.signum(value) * F.floor(size)).cast("bigint")
    parts = {name: part.alias(name) for m in measures for name, (part, _) in m.parts().items()}
    return df.withColumn("cell", cell).groupBy(*keys, "cell", value).agg(F.count(value).alias("n"), *parts.values())


def _cells(counted: DataFrame, keys: list[str], measures: list[Measure]) -> DataFrame:
    """The same per cell of a fixed grid that keeps the order of the values."""
    parts = {name: together for m in measures for name, (_, together) in m.parts().items()}
    merged = [getattr(F, together)(name).alias(name) for name, together in parts.items()]
    return counted.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), *merged)


def _ranked(
    counted: DataFrame, cells: DataFrame, keys: list[str], value: str, percentiles: dict[str, float]
) -> DataFrame:
    """The values of the wanted ranks.

    Running sums over the cells of a group show the cells that hold these ranks, a few per group; only the
    values of those cells are put in order.
    """
    wanted = {name: (p, f"{name}_low", f"{name}_high") for name, p in percentiles.items()}

    def rank(p: float, rounding) -> Column:
        return rounding(F.lit(p) * (F.col("total") - 1)).cast("bigint")

    def holds(r: Column) -> Column:
        return (r >= F.col("before")) & (r < F.col("before") + F.col("n"))

    def ahead(within: list[str], order: str) -> Column:
        window = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
        before = window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(before), F.lit(0))

    any_rank = F.lit(False)
    for p, _, _ in wanted.values():
        any_rank = any_rank | holds(rank(p, F.floor)) | holds(rank(p, F.ceil))

    in_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # Rows without a value have n = 0; a condition on their cell, which is NULL, would go below the aggregation,
    # whose shuffle would no longer be the one that the measures read.
    filled = _all_columns(cells).filter("n > 0").select(*keys, "cell", "n")
    placed = filled.withColumns({"total": F.sum("n").over(in_group), "before": ahead(keys, "cell")})
    targets = placed.filter(any_rank).drop("n")

    values = _join_on(_all_columns(counted).filter("n > 0"), targets, [*keys, "cell"])
    values = values.withColumn("before", F.col("before") + ahead([*keys, "cell"], value))
    ends = []
    for p, low, high in wanted.values():
        ends.append(F.max(F.when(holds(rank(p, F.floor)), F.col(value))).alias(low))
        ends.append(F.max(F.when(holds(rank(p, F.ceil)), F.col(value))).alias(high))
    read = values.groupBy(*keys).agg(F.max("total").alias("total"), *ends)

    def interpolated(p: float, low: str, high: str) -> Column:
        """As Spark's percentile does it, so that both plans give the same bits."""
        at = F.lit(p) * (F.col("total") - 1)
        between = (F.ceil(at) - at) * F.col(low) + (at - F.floor(at)) * F.col(high)
        return F.when(F.ceil(at) == F.floor(at), F.col(low)).otherwise(between)

    return read.select(*keys, *[interpolated(*w).alias(name) for name, w in wanted.items()])


def _all_columns(combined: DataFrame) -> DataFrame:
    """The same rows, through a condition that holds for each and reads every column.

    Without it the optimizer would drop the parts that ranks do not need, and the number that measures do not
    need, and evaluate the input again for each shuffle that differs by them.
    """
    return combined.filter(F.xxhash64(*combined.columns).bitwiseAND(F.lit(1)) >= 0)


def _join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL; the key columns of the left side remain."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])
