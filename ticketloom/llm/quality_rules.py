"""Operator 3: quality rules by hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams of UTF-8 bytes are counted over whole corpora: the trusted target
(all documents that the trusted labels mark 1) and the raw corpus (all documents). A document's score
is the mean, over all its n-grams, of log p_target - log p_raw; it is kept if its base rules hold and
the score reaches a fixed threshold. Nothing is sampled: the same text under the same corpora always
gets the same verdict.

The corpus has one shuffle of texts to meet the labels. Each task counts into arrays of fixed length
and sends its non-zero counts, so what is summed is bounded per task; the model is two arrays of BUCKETS numbers.

Defined cases: a null text counts as empty; a text without n-grams scores 0; without any trusted
document the target equals the raw corpus and all scores are 0; contradictory labels of one document
count as untrusted; repeated rows are counted and judged one by one; an empty table gives an empty
result; other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.batches import annotate, kept_rows, slices

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16

# Fixed values of the base rules.
WHITE_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8

# A document is kept from this mean log ratio on, in nats per n-gram.
LEAST_RATIO = -0.5

BASE = (
    "n_words LONG, word_chars LONG, n_symbols LONG, n_dup_lines LONG, n_repeat_words LONG, base_failed BOOLEAN"
)


def hashed_ngrams(texts: list[str]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The UTF-8 length of each text, and for each order the bucket at each byte of all texts in a row.

    The second array of a pair is false where an n-gram would reach into the next text.
    """
    encoded = [t.encode() for t in texts]
    lengths = np.array([len(b) for b in encoded], np.int64)
    data = np.frombuffer(b"".join(encoded), np.uint8).astype(np.uint32)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))

    def orders():
        for order in ORDERS:
            size = max(len(data) - order + 1, 0)
            value = np.zeros(size, np.uint32)
            for i in range(order):
                value = value << np.uint32(8) | data[i : i + size]
            mixed = (value + np.uint32(order)) * np.uint32(2654435761)
            yield mixed >> np.uint32(16), left[:size] >= order

    return lengths, orders()


def log_ratios(documents: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of every bucket; `trusted` has the doc_ids of the trusted documents."""
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("trusted", F.lit(True))
    # The narrow side is built as a hash table, so the texts are shuffled but not sorted.
    joined = documents.select("doc_id", "text").join(ids.hint("shuffle_hash"), "doc_id", "left")

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lengths, orders = hashed_ngrams(texts)
            good = np.repeat([bool(x) for x in batch.column("trusted").to_pylist()], lengths)
            for grams, inside in orders:
                raw += np.bincount(grams[inside], minlength=BUCKETS)
                target += np.bincount(grams[inside & good[: len(grams)]], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])],
            names=["bucket", "raw", "target"],
        )

    counted = joined.mapInArrow(count, "bucket INT, raw LONG, target LONG")
    # At most BUCKETS rows, whatever the corpus.
    rows = counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in rows:
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    windows = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    if len(counts) == n:
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[inverse] > 1)
    edges[starts] += 1
    np.add.at(edges, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def base_rules(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(WHITE_SPACE)]
    repeated = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > REPEAT_PERCENT * len(words)
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE_SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        failed,
    )


def mean_ratios(texts: list[str], ratios: np.ndarray) -> np.ndarray:
    """The mean log ratio of each text's n-grams; 0 for a text without any."""
    lengths, orders = hashed_ngrams(texts)
    ends = np.cumsum(lengths)
    sums, sizes = np.zeros(len(texts)), np.zeros(len(texts))
    for grams, inside in orders:
        running = np.zeros(lengths.sum() + 1)
        np.cumsum(np.where(inside, ratios[grams], 0.0), out=running[1 : len(grams) + 1])
        running[len(grams) + 1 :] = running[len(grams)]
        sums += running[ends] - running[ends - lengths]
        running[1 : len(grams) + 1] = np.cumsum(inside)
        running[len(grams) + 1 :] = running[len(grams)]
        sizes += running[ends] - running[ends - lengths]
    return sums / np.maximum(sizes, 1)


def _judge(model, least: float):
    """A function from texts to the columns of BASE, the mean log ratio and the verdict."""
    ratios = model.value

    def compute(texts):
        base = [list(column) for column in zip(*map(base_rules, texts))]
        means = mean_ratios(texts, ratios)
        return [*base, means, ~np.array(base[-1], bool) & (means >= least)]

    return compute


def quality_verdicts(documents: DataFrame, trusted: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """doc_id, the base rules, log_ratio and kept, for every document."""
    model = documents.sparkSession.sparkContext.broadcast(log_ratios(documents, trusted))
    return annotate(
        documents, ["doc_id"], f"{BASE}, log_ratio DOUBLE, kept BOOLEAN", lambda: _judge(model, least)
    )


def passing(documents: DataFrame, trusted: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """The documents that are kept, with their columns."""
    model = documents.sparkSession.sparkContext.broadcast(log_ratios(documents, trusted))
    return kept_rows(documents, lambda: lambda texts, f=_judge(model, least): f(texts)[-1])
