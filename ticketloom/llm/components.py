"""Connected components of links, without any node's links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.session import stored


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node of its component) for every node of the links (a, b).

    Alternates two rewrites until nothing changes. In both, every node learns the smallest node of its
    neighbourhood (an aggregate that combines before it shuffles); then its larger neighbours, or its
    smaller ones and itself, are linked to that smallest node instead. The number of rounds grows with
    the logarithm of the number of nodes. Each round is written to the shared folder.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .where("high <> low")
        .distinct(),
        "links",
    )
    state = None
    while True:
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).union(
            edges.select("low", "high")
        )
        smallest = both.groupBy("node").agg(F.min("other").alias("m")).withColumn("m", F.least("m", "node"))
        large = (
            both.where("other > node").join(smallest, "node").select(F.col("other").alias("high"), F.col("m").alias("low"))
        ).distinct()
        lowest = large.groupBy("high").agg(F.min("low").alias("m"))
        small = (
            large.join(lowest, "high")
            .where("low <> m")
            .select(F.col("low").alias("high"), F.col("m").alias("low"))
            .union(lowest.select("high", "m"))
            .distinct()
        )
        edges = stored(small, "links")
        seen = edges.agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")), F.lit(0))
        ).first()
        if seen == state:
            break
        state = seen
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        edges.select("low", "low").distinct()
    )
