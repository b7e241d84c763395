"""Operator 5: URL rules by host-suffix and path-prefix expressions.

Every URL expands into host suffixes times path prefixes; expressions meet the rules in an equi-join on
a short prefix of their SHA-256 digest, and the full digest confirms a meeting. Of a URL's confirmed
rules the longest wins (host and path together; of equal length, block before allow, then by text).

Only suffixes with as many labels, and prefixes with as many characters, as some rule has are
expanded; no other expression can equal a rule. So the expansion is bounded by the rules, never by
the URL. Rules are matched once per distinct (host, path); the rows of one hot URL meet before that.

Defined cases: a null URL or one without "://" has empty host and path and matches no rule with a
host; a URL with an empty path matches only rules with an empty path; rules with null host or path
are left out, repeated rules count once; repeated rows are judged one by one; an empty table gives an
empty result; other columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of the digest that the join compares first, as in a list of hash prefixes.
PREFIX_BYTES = 4

# Rules up to this many are broadcast (at most about 64 MB); more are joined by shuffle.
BROADCAST_RULES = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first "://" up to "/", "?", "#" or the end, with A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    # A line feed cannot be confused with either part's text: the length of the host is part of it.
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit("\n"), host, path), 256)


def _expanded(pairs: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    suffixes = [
        F.when(F.size(F.split("host", r"\.")) >= n, F.substring_index("host", ".", -n)) for n in labels
    ]
    prefixes = [F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    hosts = F.array_distinct(F.array_compact(F.array(*suffixes)))
    paths = F.array_distinct(F.array_compact(F.array(*prefixes)))
    return (
        pairs.withColumn("suffix", F.explode(hosts))
        .withColumn("prefix", F.explode(paths))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("digest", 1, 2 * PREFIX_BYTES))
        .select("host", "path", "digest", "short")
    )


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, the winning rule (host and path, or null) and its verdict, else `default`.

    `rules` has the columns host, path and verdict; hosts are compared in lower case.
    """
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .distinct()
        .select(
            _digest(F.col("host"), F.col("path")).alias("digest"),
            F.substring(_digest(F.col("host"), F.col("path")), 1, 2 * PREFIX_BYTES).alias("short"),
            F.concat("host", "path").alias("rule"),
            "verdict",
            F.size(F.split("host", r"\.")).alias("labels"),
            F.char_length("path").alias("length"),
        )
    )
    shape = rules.agg(F.collect_set("labels"), F.collect_set("length"), F.count(F.lit(1))).first()
    labels, lengths, count = sorted(shape[0]), sorted(shape[1]), shape[2]
    if not count:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    rules = rules.select("short", "digest", "rule", "verdict")
    if count <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    expressions = _expanded(judged.select("host", "path").distinct(), labels, lengths)
    # The smallest of these wins: longest rule, then block before allow, then text.
    order = F.struct(
        (-F.char_length("rule")).alias("shortness"), (F.col("verdict") != "block").alias("open"), "rule", "verdict"
    )
    matched = (
        expressions.join(rules.withColumnRenamed("digest", "rule_digest"), "short")
        .where("digest = rule_digest")
        .groupBy("host", "path")
        .agg(F.min(order).alias("won"))
    )
    # All urls without host and path meet one row at most, which is broadcast: their key may be a hot one.
    nothing = "host = '' AND path = ''"
    bare = judged.where(nothing).join(F.broadcast(matched.where(nothing)), ["host", "path"], "left")
    both = judged.where(f"NOT ({nothing})").join(matched, ["host", "path"], "left").unionByName(bare)
    return both.select(
        "page_id",
        "host",
        "path",
        F.col("won.rule").alias("rule"),
        F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
    )
