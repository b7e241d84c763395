"""Operator 7: benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

Words are runs of letters and digits in lower case. For every benchmark item, the windows of a document
that have the item's number of words are fingerprinted: 64 bits, each the majority of that bit in the
hashes of the window's words. Fingerprints meet the fingerprints of items of the same length through a
multi-index: cut into radius + 1 blocks, two fingerprints at most `radius` bits apart agree on at least
one block, so the equi-join on (length, block number, block) finds every pair within the radius. Pairs
within it are verified by the exact weighted Jaccard similarity of their 5-word shingles (shingles count
as often as they occur), from 0.8 on.

Only windows that can pass are fingerprinted: a similarity above 0 needs a common shingle, so windows
start where some shingle of the document, found by an equi-join, stands in line with the same shingle of
an item. Windows of whole texts are covered; a window that would reach over an end of the text is moved
inside it, and a text shorter than the item is one window.

The items' shingles are broadcast if there are at most BROADCAST_SHINGLES of them; else both sides are
shuffled by shingle, and the few windows found fetch their documents by a second join.

Defined cases: null and empty texts and items without words match nothing; items with fewer than five
words are one shingle; repeated documents and items give one row per pair of ids, with the best window;
empty tables give an empty result; other columns of the tables are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.batches import named

SHINGLE_WORDS = 5
LEAST_SIMILARITY = 0.8
BITS = 64
RADIUS = 15

# Shingle rows of the benchmark that are broadcast: at most about 40 bytes each.
BROADCAST_SHINGLES = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _hash_at(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + i) for i in range(size)])


def _shingles(words: Column, size: int) -> Column:
    """All runs of `size` words; a shorter array is one shingle."""
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1)))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))


def with_fingerprint(rows: DataFrame, words: str, name: str) -> DataFrame:
    """Adds 64 bits, each set if more than half of the words' hashes have it."""
    hashed = rows.withColumn("hashes", F.transform(words, lambda w: F.xxhash64(w)))

    def bit(b: int) -> Column:
        ones = F.aggregate(
            "hashes", F.lit(0), lambda n, h: n + F.shiftrightunsigned(h, b).bitwiseAND(1).cast("int")
        )
        return F.when(2 * ones > F.size("hashes"), F.lit(1 << b if b < BITS - 1 else -(1 << b))).otherwise(F.lit(0))

    total = bit(0)
    for b in range(1, BITS):
        total = total.bitwiseOR(bit(b))
    return hashed.withColumn(name, total).drop("hashes")


def _blocks(print_: Column, radius: int) -> Column:
    """The fingerprint's radius + 1 blocks, each with its number."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("block"),
                F.shiftrightunsigned(print_, low).bitwiseAND((1 << (high - low)) - 1).alias("bits"),
            )
            for i, (low, high) in enumerate(zip(edges, edges[1:]))
        ]
    )


def _items(benchmark: DataFrame) -> DataFrame:
    return (
        benchmark.select("item_id", words_of(F.col("text")).alias("item"))
        .where("item_id IS NOT NULL AND size(item) > 0")
        .distinct()
        .withColumn("length", F.size("item"))
    )


def _windows(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, length, start and window: each window in line with a shingle of an item of its length."""
    docs = documents.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")
    ).where("size(words) > 0")
    # Items shorter than a shingle are found by shingles of their own length: at most five lengths.
    sizes = items.select(F.least("length", F.lit(SHINGLE_WORDS)).alias("k")).distinct().collect()
    sizes = [r["k"] for r in sizes] or [SHINGLE_WORDS]
    found = None
    for k in sorted(sizes):
        anchors = (
            items.where(F.least("length", F.lit(SHINGLE_WORDS)) == k)
            .select("item", "length", F.explode(F.sequence(F.lit(0), F.col("length") - k)).alias("offset"))
            .select(_hash_at("item", F.col("offset"), k).alias("shingle"), "length", "offset")
            .distinct()
        )
        places = (
            docs.where(F.size("words") >= k)
            .select("*", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("at"))
            .select("*", _hash_at("words", F.col("at"), k).alias("shingle"), F.size("words").alias("n_words"))
        )
        start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("offset"), F.col("n_words") - F.col("length")))
        if anchors.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES:
            hits = places.join(F.broadcast(anchors), "shingle").withColumn("start", start)
        else:
            hits = (
                places.drop("words")
                .join(anchors, "shingle")
                .select("doc_id", "text_hash", "length", start.alias("start"))
                .distinct()
                .withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})
            )
            same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
            hits = hits.join(docs, same)
        windows = hits.select(
            "doc_id",
            "text_hash",
            "length",
            "start",
            F.slice("words", F.col("start") + 1, F.col("length")).alias("window"),
        ).distinct()
        found = windows if found is None else found.unionByName(windows)
    return found


def _similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and the exact weighted Jaccard similarity of the shingles of `window` and `item`."""

    def counted(words: str, mine: int) -> Column:
        return F.transform(
            _shingles(F.col(words), SHINGLE_WORDS),
            lambda s: F.struct(s.alias("shingle"), F.lit(mine).alias("a"), F.lit(1 - mine).alias("b")),
        )

    rows = pairs.select(*keys, F.explode(F.concat(counted("window", 1), counted("item", 0))).alias("one"))
    counts = rows.groupBy(*keys, "one.shingle").agg(F.sum("one.a").alias("a"), F.sum("one.b").alias("b"))
    return counts.groupBy(*keys).agg(
        (F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("similarity")
    )


def contaminated(
    documents: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = LEAST_SIMILARITY
) -> DataFrame:
    """doc_id, item_id, start (words before the window), n_words and similarity: a row per pair found."""
    items = _items(benchmark)
    windows = _windows(documents, items)
    printed = with_fingerprint(windows, "window", "print")
    prints = with_fingerprint(items, "item", "item_print").select(
        "item_id", "item", "length", "item_print", F.explode(_blocks(F.col("item_print"), radius)).alias("at")
    )
    keys = ["doc_id", "text_hash", "length", "start", "item_id", "item_hash"]
    pairs = (
        printed.select("*", F.explode(_blocks(F.col("print"), radius)).alias("at"))
        .select("doc_id", "text_hash", "length", "start", "window", "print", "at.block", "at.bits")
        .join(prints.select("*", "at.block", "at.bits").drop("at"), ["length", "block", "bits"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
        .withColumn("item_hash", F.xxhash64(F.array_join("item", " ")))
        .select(*keys, "window", "item")
        .distinct()
    )
    found = _similarity(pairs, keys).where(F.col("similarity") >= least)
    best = F.max_by(
        F.struct("start", F.col("length").alias("n_words"), "similarity"),
        F.struct("similarity", -F.col("start"), -F.col("length")),
    )
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their columns; a doc_id goes with all its rows."""
    ids = contaminated(documents, benchmark).select(F.col("doc_id").alias("leaking")).distinct()
    columns = named(documents.columns)
    return documents.join(ids, documents["doc_id"].eqNullSafe(ids["leaking"]), "left_anti").select(*columns)
