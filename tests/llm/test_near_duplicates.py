import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticketloom.llm import near_duplicates as near
from ticketloom.llm.bag_min_hash import bands, mixed, signatures
from ticketloom.llm.components import components
from ticketloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def shingles_of(words):
    """The multiset of runs of five words; all words at once if there are fewer."""
    runs = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    return Counter(runs if words else [])


def bag(counts):
    keys = sorted(counts)
    return mixed(np.array(keys, np.uint64)), np.array([counts[k] for k in keys])


@pytest.mark.parametrize("a, b", [(1, 1), (3, 5), (1, 7), (100, 130)])
def test_signatures_estimate_the_weighted_similarity(a, b):
    rng, agreed = np.random.default_rng(1), []
    for _ in range(40):
        base = int(rng.integers(1 << 40))
        x, y = {base + i: a for i in range(60)}, {base + 15 + i: b for i in range(60)}
        s = signatures([bag(x), bag(y)])
        agreed.append((s[0] == s[1]).mean())
    both = set(x) | set(y)
    true = sum(min(x.get(k, 0), y.get(k, 0)) for k in both) / sum(max(x.get(k, 0), y.get(k, 0)) for k in both)
    assert abs(np.mean(agreed) - true) < 0.03


def test_signatures_depend_on_their_bag_alone():
    bags = [bag({k: 1 + k % 9 for k in range(n)}) for n in (1, 3, 50, 400)] + [bag({})]
    together = signatures(bags)
    for one, row in zip(bags, together):
        assert (signatures([one])[0] == row).all()
    assert np.isinf(together[-1]).all() and np.isfinite(together[:-1]).all()
    assert bands(together[:2], 4).shape == (2, 32)


def brute_force(rows):
    """The class of every row, from all pairs of texts."""
    texts = sorted({t or "" for _, t in rows})
    bags = [shingles_of(near.words_of(t)) for t in texts]
    above = list(range(len(texts)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            total = sum((bags[i] | bags[j]).values())
            if total and Fraction(sum((bags[i] & bags[j]).values()), total) >= Fraction(8, 10):
                above[top(i)] = top(j)
    of = {t: top(i) for i, t in enumerate(texts)}
    ids = defaultdict(list)
    for i, t in rows:
        ids[of[t or ""]].append(i)
    first = {c: min((i for i in found if i is not None), default=None) for c, found in ids.items()}
    return sorted(((i, first[of[t or ""]]) for i, t in rows), key=repr)


def family(rng, size, base_words, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(base_words)]
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        yield " ".join(words)


def test_classes_of_all_kinds_of_rows(edge, none):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert sorted(map(tuple, near.near_duplicates(edge).collect()), key=repr) == brute_force(rows)
    assert near.near_duplicates(none).collect() == []
    kept = near.representatives(edge)
    assert kept.columns == edge.columns
    classes = [c for _, c in brute_force(rows)]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(set(classes), key=repr)
    assert near.representatives(none).collect() == []


@pytest.mark.parametrize(
    "paired, per_node, block", [(32, 10_000, 1_000), (2, 10_000, 7), (2, 1, 50)], ids=["pairs", "blocks", "bands"]
)
def test_classes_by_brute_force(spark, monkeypatch, paired, per_node, block):
    """Families whose copies are similar to some but not all others, so that buckets hold several components."""
    monkeypatch.setattr(near, "PAIRED", paired)
    monkeypatch.setattr(near, "PAIRS_PER_NODE", per_node)
    monkeypatch.setattr(near, "BLOCK_NODES", block)
    rng = random.Random(8)
    texts = [*family(rng, 60, 80, 3), *family(rng, 30, 200, 8), *family(rng, 30, 30, 1), "a b", "a b", "b a", ""]
    texts += ["one two three four five six " * 40, "one two three four five six " * 45]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[70])]
    documents = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert sorted(map(tuple, near.near_duplicates(documents).collect()), key=repr) == brute_force(rows)


def test_a_pair_that_shares_one_crowded_bucket_alone_is_linked(spark, monkeypatch):
    """Unrelated texts share a bucket; two similar ones share nothing but that bucket."""
    monkeypatch.setattr(near, "PAIRS_PER_NODE", 0)
    base = [f"w{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(20)]
    texts = [base, [*base[:-1], "x"], *[[*passage, *(f"u{k}x{i}" for i in range(90))] for k in range(40)]]
    texts = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "node LONG, text STRING")
    buckets = texts.select(F.lit(7).cast("long").alias("bucket"), "node")
    none = spark.createDataFrame([], "node LONG, component LONG")
    opened = near._open_buckets(buckets, none, texts)
    assert [tuple(r) for r in near._open_pairs(opened).select("a", "b").collect()] == [(1, 0)]
    assert [r["n"] for r in opened.select("bucket", "n").distinct().collect() if r["n"] > 2] == []


def test_query_by_brute_force(spark):
    table = pd.read_parquet(f"{FOLDER}/documents.parquet")
    rows = list(zip(table["doc_id"].tolist(), table["text"].tolist()))
    found = QUERIES["op2_near_duplicates"](spark, FOLDER).collect()
    assert sorted(map(tuple, found), key=repr) == brute_force(rows)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 540)]
    links = [p if rng.random() < 0.5 else p[::-1] for p in chain + star] + [(7, 7), (8, 9), (8, 9)]
    found = components(spark.createDataFrame(links, "a LONG, b LONG"))
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 540)} | {8: 8, 9: 8}
    assert {r["node"]: r["component"] for r in found.collect()} == want
    assert components(spark.createDataFrame([], "a LONG, b LONG")).collect() == []


def test_a_text_meets_the_rows_of_open_buckets_once(spark):
    """The blocks are laid out by lengths alone: the text of a bucket's row is read and shuffled once, not per side."""
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(near.PAIRED + 10)]
    texts = spark.createDataFrame(texts, "node LONG, text STRING")
    buckets = texts.select(F.lit(7).cast("long").alias("bucket"), "node")
    none = spark.createDataFrame([], "node LONG, component LONG")
    opened = near._open_buckets(buckets, none, texts)
    links = near._block_links(opened, texts)
    assert links.collect() == []
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join Inner, \(node#", plan)) == 1
