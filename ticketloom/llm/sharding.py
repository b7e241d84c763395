"""Operator 6: shards by vector bin packing over bytes, tokens and rows.

Groups are the documents with equal texts. Each item to place has a vector (bytes, tokens, rows), and
goes, largest first, to the shard where the dot product with the shard's residual capacity is highest
among the shards whose bytes it does not overfill.

What is placed is bounded, whatever the number of documents: a group that holds more than one part in
`grains` of the bytes, tokens or rows is an item of its own (there are at most 3 * grains of those), cut
by doc_id into several if it is larger still; all other groups are hashed into `grains` parcels, and a
parcel is one item. So the driver places a few thousand items while all rows stay distributed, and the
shards differ by about one parcel. Copies stay together unless their group alone is larger than a grain.

Slots count from 0 in each shard without gaps: rows are ordered by doc_id inside narrow lanes of a
shard, and the (bounded) list of lane sizes gives each lane its first slot.

Defined cases: a null text has size 1 like the empty text, and both are one group; null doc_ids sort
first; rows that repeat a doc_id and text are rows of their own; fewer documents than shards leave
shards empty; an empty table gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketloom.session import stored

MEASURES = ("bytes", "tokens", "rows")

# A token of the measure is a word between white space.
WORD = r"[^\x20\x09-\x0D]+"

# Rows that a lane of a shard holds on average; lanes are what a task sorts.
LANE_ROWS = 20_000


def place(sizes: np.ndarray, shards: int) -> list[int]:
    """The shard of each item; sizes has a row (bytes, tokens, rows) per item.

    Items come by falling bytes. An item goes to the highest dot product of its vector (each measure as
    a share of all) with what the shard still has to take, among the shards with room for its bytes;
    if none has room, to the one with the most room.
    """
    totals = np.maximum(sizes.sum(axis=0), 1)
    shares = sizes / totals
    room = np.full((shards, sizes.shape[1]), 1.0 / shards)
    result = [0] * len(sizes)
    for i in np.lexsort((np.arange(len(sizes)), -shares[:, 0])):
        fits = room[:, 0] >= shares[i, 0] - 1e-12
        scores = np.where(fits, room @ shares[i], -np.inf)
        best = int(np.argmax(scores)) if fits.any() else int(np.argmax(room[:, 0]))
        room[best] -= shares[i]
        result[i] = best
    return result


def sharded(documents: DataFrame, shards: int = 8, grains: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot and grown_shard (null under this law)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(
        documents.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("group"),
        ),
        "sharding-rows",
    )
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    if not total[2]:
        empty = "doc_id, size, text_crc32, 'bytes' AS law, 0 AS shard, 0L AS slot, CAST(NULL AS INT) AS grown_shard"
        return rows.selectExpr(*empty.split(", "))

    measures = [F.sum("size"), F.sum("tokens"), F.count(F.lit(1))]
    grain = [max(t / grains, 1) for t in total]
    heavy = (
        rows.groupBy("group")
        .agg(*[m.alias(n) for m, n in zip(measures, MEASURES)])
        .where(F.greatest(*[F.col(n) / g for n, g in zip(MEASURES, grain)]) > 1)
        .withColumn("cuts", F.ceil(F.greatest(*[F.col(n) / g for n, g in zip(MEASURES, grain)])).cast("int"))
        .select("group", "cuts")
    )
    # At most 3 * grains groups are heavy, 16 bytes and a number each.
    items = (
        rows.join(F.broadcast(heavy), "group", "left")
        .withColumn("heavy", F.when(F.col("cuts").isNotNull(), F.hex("group")).otherwise(F.lit("")))
        .withColumn(
            "part",
            F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("cuts")))
            .otherwise(F.pmod(F.xxhash64("group"), F.lit(grains)))
            .cast("int"),
        )
    )
    sizes = items.groupBy("heavy", "part").agg(*[m.alias(n) for m, n in zip(measures, MEASURES)])
    listed = sorted(sizes.collect(), key=lambda r: (r["heavy"], r["part"]))
    vectors = np.array([[float(r[m]) for m in MEASURES] for r in listed])
    placed = documents.sparkSession.createDataFrame(
        [(r["heavy"], r["part"], s) for r, s in zip(listed, place(vectors, shards))],
        "heavy STRING, part INT, shard INT",
    )
    lanes = max(1, int(total[2]) // (shards * LANE_ROWS))
    laned = items.join(F.broadcast(placed), ["heavy", "part"]).withColumn(
        "lane", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(lanes)).cast("int")
    )
    return _with_slots(laned.select("doc_id", "size", "text_crc32", "shard", "lane"))


def _with_slots(laned: DataFrame) -> DataFrame:
    lane = Window.partitionBy("shard", "lane")
    counts = laned.groupBy("shard", "lane").count()
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        "shard", "lane", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long").alias("first_slot")
    )
    ranked = laned.withColumn("rank", F.row_number().over(lane.orderBy("doc_id", "text_crc32", "size")))
    return ranked.join(first, ["shard", "lane"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first_slot") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
