"""The registered queries over the operators of this folder, with SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import (
    decontamination,
    near_duplicates,
    pivot_clusters,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
    token_counts,
    token_files,
    toxicity,
    url_filters,
    whitening,
    word_bpe,
)

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """A public vocabulary file, or the one of that name in the folder of TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_import(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and keeps their batches small."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    # Texts that stand in memory at once on either side of a worker.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def _query(function):
    def run(spark, sf_dir):
        workers_import(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return function


@_query
def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the labels mark as of good quality, and never as of bad quality."""
    labels = table(spark, sf_dir, "labels")
    return labels.groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1")


@_query
def op3_quality_rules(spark, sf_dir):
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


# Fixed rules of the contract: host, path, verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@_query
def op5_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host STRING, path STRING, verdict STRING")
    return url_filters.url_verdicts(table(spark, sf_dir, "pages"), rules)


ORACLES["op5_url_filters"] = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail
    FROM pages
), parts AS (
    SELECT page_id, regexp_extract(tail, '^[^/?#]*') AS raw_host, tail FROM cut
), hosts AS (
    SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(tail, length(raw_host) + 1), '^[^?#]*') AS path
    FROM parts
), rules(rule_host, rule_path, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
        ('org', '/fr/', 'allow')
), fitting AS (
    SELECT page_id, host, path, rule_host || rule_path AS rule, verdict
    FROM hosts LEFT JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM fitting
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""


@_query
def op6_sharding(spark, sf_dir):
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=8)


def digests(encodings: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids as text and of the decoded text."""
    return encodings.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def round_trip(documents: DataFrame) -> DataFrame:
    """The digests of encoding and decoding every document with a lexicon of its own words."""
    file = tokenizer_file("word_bpe_49k.json")
    lexicon = word_bpe.build_lexicon(documents, file)
    return digests(word_bpe.round_trip(documents, file, lexicon))


@_query
def op8_word_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))


@_query
def op10_token_files(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@_query
def op4_quality_classifier(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return quality_classifier.scored(documents, quality_classifier.fit(documents, table(spark, sf_dir, "labels")))


@_query
def op9_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return toxicity.scored(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


@_query
def op7_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op2_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op12_substring_dedup(spark, sf_dir):
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op11_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@_query
def op13_pivot_clusters(spark, sf_dir):
    found = pivot_clusters.clusters(table(spark, sf_dir, "embeddings"))
    joined = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.withColumn("centroid_sha256", F.sha2(joined, 256)).drop("centroid")
