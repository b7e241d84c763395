"""Bounded training samples of labelled documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.batches import text_column


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo the number of folds; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


@dataclass(frozen=True)
class Sample:
    """Texts with a 0/1 label, and the share of label 1 among all rows that may be learned from."""

    texts: list[str]
    labels: list[int]
    share: float

    def weights(self) -> list[float]:
        """Weights with which each label has its share of all labelled rows."""
        ones = sum(self.labels)
        zeros = len(self.labels) - ones
        return [self.share / max(ones, 1) if y else (1 - self.share) / max(zeros, 1) for y in self.labels]


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, learnable: Column, per_label: int, longest: int
) -> Sample:
    """At most `per_label` documents of each label, each of at most `longest` bytes, in a fixed order.

    Rows for which `learnable` does not hold, and doc_ids with contradictory labels, are never read. The
    documents taken are those whose doc_id has the smallest hash, so the same tables give the same sample.
    """
    rows = (
        labels.where(learnable)
        .where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("most"))
        .where("label = most")
        .select("doc_id", "label", F.xxhash64("doc_id").alias("order"))
    )
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    picked = [rows.where(F.col("label") == y).orderBy("order", "doc_id").limit(per_label) for y in (0, 1)]
    # At most 2 * per_label ids.
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    text = text_column()
    found = (
        documents.select("doc_id", text.alias("text"))
        .where(F.octet_length("text") <= longest)
        .join(ids, "doc_id")
        .dropDuplicates(["doc_id"])
        .select("order", "doc_id", "label", "text")
        .collect()
    )
    found.sort(key=lambda r: (r["order"], r["doc_id"]))
    total = sum(counts.values())
    return Sample(
        [r["text"] for r in found], [r["label"] for r in found], counts.get(1, 0) / total if total else 0.5
    )
