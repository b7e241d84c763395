"""Operator 2: near-duplicates by BagMinHash signatures, bands, and verified multiset overlap.

Words are runs of letters and digits in lower case; a text is the multiset of its 5-word shingles. Texts
whose multisets have a weighted Jaccard similarity (sum of the smaller counts over sum of the larger) of at
least 0.8 are linked, and every row gets the connected component of its text: `class_id`, the smallest
doc_id in it.

1. Rows with equal texts are one node, with a number; only one row per node goes on.
2. BagMinHash (see bag_min_hash) gives 128 values per text, cut into 32 bands of 4. Two texts at 0.8 share
   no band with probability 5e-8, and less above. Texts that share a band share a bucket.
3. In each bucket every node is paired with the bucket's smallest node. Pairs are verified on their texts,
   and components formed. That resolves a bucket of near copies of one text with a number of pairs linear
   in its size.
4. What is left are buckets that hold several components; there all nodes outside the largest component are
   compared with all nodes: in small buckets as pairs, in larger ones block by block, where a task multiplies
   the 0/1 matrices of its shingles and returns only links that join components. The nodes of buckets with more
   than PAIRS_PER_NODE open pairs per node are dealt anew, by the rarest of their shingles: of n shingles the
   n - ceil(0.8 n) + 1 that are rarest among these nodes. Two texts at 0.8 share one of those, always. So nothing
   is capped: many unrelated texts that share one frequent passage separate, and every link of theirs stays.
5. Components are formed again over all verified links.

No bucket is collected: pairs are made by joins on the bucket, and a block has a bounded size.

Defined cases: a null text counts as empty; texts without words are alike only if they are equal; texts
with fewer than five words are one shingle; repeated rows share a class; rows with a null doc_id get the
class of their text, null if it has no other id; an empty table gives an empty result; other columns are
not read. Two rows with one doc_id and different texts are two nodes.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.bag_min_hash import bands, mixed, signatures
from ticketloom.llm.batches import Memo, fresh_name, named, slices, text_column
from ticketloom.llm.components import components
from ticketloom.session import stored

SHINGLE_WORDS = 5
BAND_ROWS = 4
# The similarity that links, as a fraction.
LEAST = (8, 10)

# Buckets of at most this many nodes are verified pair by pair, larger ones in blocks.
PAIRED = 32
# Nodes, and bytes of text, in a block.
BLOCK_NODES, BLOCK_BYTES = 1_000, 4 << 20
# Beyond this many open pairs per node the nodes of a bucket are dealt by their rarest shingles.
PAIRS_PER_NODE = 10_000
# Shingles whose counts are multiplied at once.
COLUMNS = 2_048

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _word_code(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


@lru_cache(maxsize=1)
def _word_codes() -> Memo:
    """One per Python worker, kept between its tasks."""
    return Memo(_word_code, bound=200_000)


def bag_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of the text as 64-bit codes in order, and how often each occurs.

    A shingle is a run of SHINGLE_WORDS words, or all words if there are fewer; none without words. Equal
    codes of different shingles are out of the question for the few million that any comparison meets.
    """
    words = words_of(text)
    codes = np.fromiter(map(_word_codes().__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE_WORDS, len(words))
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        found = mixed(found * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(found)])
    return np.unique(found, return_counts=True)


def _digest() -> Column:
    return F.unhex(F.md5(text_column().cast("binary")))


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether sum(min) / sum(max) of two bags reaches LEAST."""
    total = int(a[1].sum() + b[1].sum())
    _, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][in_a], b[1][in_b]).sum())
    return common > 0 and common * LEAST[1] >= (total - common) * LEAST[0]


def _banded(documents: DataFrame) -> DataFrame:
    """digest and bands (one hash per band) of the texts that have words; copies are not all left out."""
    rows = documents.select(_digest().alias("digest"), "text")

    def run(batches):
        done = Memo(lambda digest: None, bound=100_000)
        for batch in slices(batches):
            fresh = []
            for i, digest in enumerate(batch.column("digest").to_pylist()):
                if digest not in done:
                    done[digest]
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int32()))
            bags = [bag_of(t or "") for t in batch.column("text").to_pylist()]
            full = [i for i, bag in enumerate(bags) if len(bag[0])]
            if not full:
                continue
            found = bands(signatures([bags[i] for i in full]), BAND_ROWS)
            offsets = pa.array(np.arange(len(full) + 1, dtype=np.int32) * found.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1)))
            digests = batch.column("digest").take(pa.array(full, pa.int32()))
            yield pa.RecordBatch.from_arrays([digests, lists], ["digest", "bands"])

    return rows.mapInArrow(run, "digest BINARY, bands ARRAY<LONG>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar. Many pairs may share b, so that text is joined first."""
    with_b = pairs.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    both = with_b.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")

    def run(batches):
        known = lru_cache(maxsize=32)(bag_of)
        for batch in batches:
            pairs = zip(batch.column("text_a"), batch.column("text_b"))
            keep = [similar(known(x.as_py()), known(y.as_py())) for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a LONG, b LONG")


def _starred(buckets: DataFrame) -> DataFrame:
    """Each node with the smallest node of each of its buckets."""
    centres = buckets.groupBy("bucket").agg(F.min("node").alias("b"))
    return buckets.join(centres, "bucket").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _opened(rows: DataFrame) -> DataFrame:
    """Rows (bucket, node, component, bytes) of buckets that hold several components, with n, crossing and largest."""
    sizes = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    shape = (
        sizes.groupBy("bucket")
        .agg(
            F.sum("size").alias("n"),
            F.sum(F.col("size") * F.col("size")).alias("inside"),
            F.max(F.struct("size", "component")).alias("largest"),
        )
        .selectExpr("bucket", "n", "(n * n - inside) DIV 2 AS crossing", "largest.component AS largest")
        .where("crossing > 0")
    )
    return rows.join(shape, "bucket")


def _open_buckets(buckets: DataFrame, component: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (bucket, node, component, bytes, n, largest) of buckets that hold several components; n is their size.

    `largest` is the component with most nodes of the bucket, `bytes` the length of the node's text. Nodes of
    crowded buckets are in buckets of a rare shingle instead.
    """
    columns = ["bucket", "node", "component", "bytes", "n", "largest"]
    lengths = texts.select("node", F.octet_length("text").cast("long").alias("bytes"))
    known = lengths.join(component, "node", "left")
    rows = buckets.join(known, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component"), "bytes"
    )
    opened = stored(_opened(rows), "open")
    crowded = F.col("crossing") > PAIRS_PER_NODE * F.col("n")
    many, some = opened.where(crowded), opened.where(~crowded).select(*columns)
    if many.isEmpty():
        return some
    nodes = stored(many.select("node", "component", "bytes").distinct(), "crowded")
    rare = stored(_rare_shingles(nodes, texts), "rare")
    # Many shingles of one passage have the same nodes: one of them is enough.
    sets = rare.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    )
    chosen = sets.where("nodes > 1").groupBy("nodes", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    return some.union(_opened(rare.join(chosen, "bucket")).select(*columns))


def _rare_shingles(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (bucket, node, component, bytes): for each node the rarest shingles of its text, of which any similar text
    of these nodes shares one. Equal shingles of a text count apart, so similarity is that of two sets."""

    def run(batches):
        for batch in slices(batches):
            found = [elements_of(t) for t in batch.column("text").to_pylist()]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))
            columns = [*(batch.column(c) for c in node), lists]
            yield pa.RecordBatch.from_arrays(columns, [*node, "shingles"])

    node = ["node", "component", "bytes"]
    read = texts.join(nodes, "node").select(*node, "text")
    told = stored(read.mapInArrow(run, "node LONG, component LONG, bytes LONG, shingles ARRAY<LONG>"), "shingles")
    each = told.select(*node, F.explode("shingles").alias("bucket"))
    often = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("often"))
    in_order = F.sort_array(F.collect_list(F.struct("often", "bucket")))
    enough = F.expr(f"int(size(found) - ceil(size(found) * {LEAST[0]} / {LEAST[1]}) + 1)")
    ranked = each.join(often, "bucket").groupBy(*node).agg(in_order.alias("found"))
    rare = ranked.select(*node, F.explode(F.slice("found", F.lit(1), enough)).alias("rare"))
    return rare.where("rare.often > 1").select("rare.bucket", *node)


def _open_pairs(opened: DataFrame) -> DataFrame:
    """Pairs of nodes of different components in buckets of at most PAIRED nodes."""
    few = opened.where(F.col("n") <= PAIRED)
    rest = few.where("component <> largest").select("bucket", F.col("node").alias("x"), "component")
    others = few.select("bucket", F.col("node").alias("y"), F.col("component").alias("other"))
    return (
        rest.join(others, "bucket")
        .where("component <> other")
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        .distinct()
    )


def _block_links(opened: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join the components of buckets of more than PAIRED nodes.

    The nodes of a bucket are dealt into blocks. Every block of nodes outside the largest component meets
    every block of all nodes in a task of its own, which finds all similar pairs and returns the links that
    join components it has not joined yet: fewer than it has nodes. Blocks are laid out by lengths alone, so a
    text meets its rows once, for both sides.
    """
    rows = opened.where(F.col("n") > PAIRED)
    rest = "CASE WHEN component <> largest THEN {} END"
    sizes = rows.groupBy("bucket").agg(
        F.max("n").alias("n"),
        F.sum("bytes").alias("total"),
        F.expr(f"sum({rest.format('bytes')})").alias("rest_bytes"),
        F.expr(f"sum({rest.format('1')})").alias("rest"),
    )
    dealt = sizes.selectExpr(
        "bucket",
        f"CAST(greatest(ceil(n / {BLOCK_NODES}), ceil(total / {BLOCK_BYTES})) AS INT) AS blocks",
        f"CAST(greatest(ceil(rest / {BLOCK_NODES}), ceil(rest_bytes / {BLOCK_BYTES})) AS INT) AS rest_blocks",
    )
    placed = rows.join(dealt, "bucket").selectExpr(
        "*", "int(pmod(xxhash64(node), blocks)) AS own", "int(pmod(xxhash64(node, 1), rest_blocks)) AS own_rest"
    )
    both_sides = F.expr(
        """inline(concat(
            transform(sequence(0, rest_blocks - 1), x -> struct(own AS i, x AS j, false AS outside)),
            IF(component <> largest,
                transform(sequence(0, blocks - 1), x -> struct(x AS i, own_rest AS j, true AS outside)), array())))"""
    )
    sides = placed.join(texts.select("node", "text"), "node").select("bucket", "node", "component", "text", both_sides)

    def join_components(group):
        outside = np.array(group.column("outside").to_pylist(), bool)
        nodes, labels = group.column("node").to_numpy(), group.column("component").to_numpy()
        found = linked([t.as_py() for t in group.column("text")], outside)
        a, b = joining(found, nodes, labels)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sides.groupBy("bucket", "i", "j").applyInArrow(join_components, "a LONG, b LONG")


def elements_of(text: str) -> np.ndarray:
    """One code for each shingle of the text: the k-th of equal ones has a code of its own."""
    codes, counts = bag_of(text)
    levels = np.repeat(codes, counts)
    rank = np.arange(len(levels)) - np.repeat(np.cumsum(counts) - counts, counts)
    return mixed(levels + rank.astype(np.uint64))


def linked(texts: list[str], outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (text outside, other text) that are similar, as two arrays of places.

    A shingle that occurs k times counts as k elements, so the overlap of two multisets is the product of
    two 0/1 rows; elements of one text alone cannot overlap and are left out. Shingles are compared by
    64-bit codes (see `bag_of`).
    """
    elements = [elements_of(text) for text in texts]
    sizes = np.array([len(found) for found in elements], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    _, column, often = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
    common = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((len(texts), COLUMNS), np.float32)
        part[owner[low:high], column[low:high] - start] = 1
        common += part[left] @ part[right].T
    total = sizes[left][:, None] + sizes[right][None, :]
    similar_ = (common > 0) & (common * LEAST[1] >= (total - common) * LEAST[0])
    x, y = np.nonzero(similar_)
    return left[x], right[y]


def joining(pairs: tuple[np.ndarray, np.ndarray], nodes: np.ndarray, labels: np.ndarray) -> tuple[list, list]:
    """Of the linked places, as node pairs, those that join components not joined before."""
    above: dict[int, int] = {}

    def top(label):
        while label in above:
            label = above[label]
        return label

    a, b = [], []
    for x, y in zip(*pairs):
        first, second = top(labels[x]), top(labels[y])
        if first != second:
            above[max(first, second)] = min(first, second)
            a.append(int(nodes[x]))
            b.append(int(nodes[y]))
    return a, b


def classes(documents: DataFrame) -> DataFrame:
    """One row per text: digest, first_id (its smallest doc_id), class_id, chosen, and repeats.

    `chosen` marks one text per class, one whose first_id is the class_id. `repeats` tells whether some
    doc_id has the text in several rows.
    """
    counted = documents.select("doc_id", _digest().alias("digest")).groupBy("digest", "doc_id").count()
    # The ids are fixed by being written.
    nodes = stored(
        counted.groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), (F.max("count") > 1).alias("repeats"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    banded = _banded(documents).dropDuplicates(["digest"]).join(nodes.select("digest", "node"), "digest")
    spread = stored(banded.select("node", F.explode("bands").alias("bucket")), "bands")
    shared = spread.groupBy("bucket").count().where("count > 1").select("bucket")
    buckets = stored(spread.join(shared, "bucket").select("bucket", "node"), "buckets")

    candidates = nodes.join(buckets.select("node").distinct(), "node")
    texts = stored(_first_rows(documents.select("doc_id", "text"), candidates, "node").select("node", "text"), "texts")
    near = stored(_verified(_starred(buckets), texts), "links")
    component = components(near)
    opened = stored(_open_buckets(buckets, component, texts), "open")
    more = stored(_verified(_open_pairs(opened), texts).union(_block_links(opened, texts)), "links")
    if not more.isEmpty():
        # The components so far stand for their links, so few rounds are left.
        component = components(component.toDF("a", "b").union(more))
    of_class = nodes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_class = stored(of_class, "classes")
    smallest = of_class.groupBy("component").agg(F.min("first_id").alias("class_id"))
    together = of_class.join(smallest, "component").withColumn("first", F.col("first_id").eqNullSafe(F.col("class_id")))
    elected = together.where("first").groupBy("component").agg(F.min("node").alias("elected"))
    return together.join(elected, "component").select(
        "digest", "first_id", "class_id", (F.col("node") == F.col("elected")).alias("chosen"), "repeats"
    )


def _first_rows(documents: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """One row of the documents per node: one of its first doc_id; with further columns of the nodes.

    Rows and nodes meet by digest and doc_id, so that the copies of one text spread over tasks.
    """
    digest, first = fresh_name(documents, "digest"), fresh_name(documents, "first_id")
    repeats = fresh_name(documents, "repeats")
    wanted = nodes.select(
        F.col("digest").alias(digest), F.col("first_id").alias(first), F.col("repeats").alias(repeats), *more
    )
    rows = documents.withColumn(f"{digest}_", _digest())
    met = rows.join(
        wanted.hint("shuffle_hash"),
        (F.col(f"{digest}_") == F.col(digest)) & rows["doc_id"].eqNullSafe(wanted[first]),
    ).drop(f"{digest}_", first)
    if not nodes.where("repeats").isEmpty():
        met = met.dropDuplicates([digest])
    return met.drop(digest, repeats)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id and class_id of every row."""
    rows = documents.select("doc_id", _digest().alias("digest"))
    return rows.join(classes(documents).select("digest", "class_id"), "digest").select("doc_id", "class_id")


def representatives(documents: DataFrame) -> DataFrame:
    """One row of each class, with its columns: one of its smallest doc_id."""
    chosen = stored(classes(documents).where("chosen"), "chosen")
    return _first_rows(documents, chosen).select(*named(documents.columns))
