"""A training-corpus pipeline: rules, classifier, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; `run` writes every
stage's rows as Parquet in the shared folder and gives them, read again, to the next. All stages but the
last return the columns of `documents`; the last returns the encoding digests of the documents kept.

What is learned comes from the whole tables in `sf_dir`, so it does not depend on what earlier stages took
away: the quality rules' trusted documents and the classifier's labelled sample. The corpus statistics of
the rules are those of the stage's own input, as is the lexicon of the encoder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketloom.llm import decontamination, near_duplicates, quality_classifier, quality_rules
from ticketloom.llm.queries import round_trip, table, trusted, workers_import
from ticketloom.session import stored


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rules and the n-gram log-likelihood ratio (operator 3)."""
    workers_import(spark)
    return quality_rules.passing(docs, trusted(spark, sf_dir))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, learned from the labelled documents, accepts (operator 4)."""
    workers_import(spark)
    net = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.accepted(docs, net)


def deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, of the smallest doc_id, of each class of near-duplicates (operator 2)."""
    workers_import(spark)
    return near_duplicates.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what holds no benchmark item (operator 7)."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left (operator 8)."""
    workers_import(spark)
    return round_trip(docs)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_duplicates", deduplication),
    ("decontamination", benchmark),
    ("encoding", encoding),
]

# The classifier and the encoder have no SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
