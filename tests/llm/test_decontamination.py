import re
from collections import Counter

import pandas as pd
import pytest

from ticketloom.llm import decontamination
from ticketloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(found):
    return Counter(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else Counter()


def brute_force(documents, items):
    """The best similarity of any window of any length-of-item words, where it reaches 0.8."""
    best = {}
    for doc, text in documents:
        body = words(text)
        for item, passage in items:
            wanted = words(passage)
            for start in range(max(1, len(body) - len(wanted) + 1)):
                a, b = shingles(body[start : start + len(wanted)]), shingles(wanted)
                total = sum((a | b).values())
                likeness = sum((a & b).values()) / total if total else 0
                if likeness >= 0.8 and likeness > best.get((doc, item), 0):
                    best[doc, item] = likeness
    return {pair: round(v, 12) for pair, v in best.items()}


def found(df):
    return {(r["doc_id"], r["item_id"]): round(r["similarity"], 12) for r in df.collect()}


@pytest.fixture(scope="module")
def passages():
    items = pd.read_parquet(f"{FOLDER}/benchmark.parquet")
    return dict(zip(items["item_id"].tolist(), items["text"].tolist()))


def cases(passages):
    long = passages[0].split()
    filler = "Nothing of this kind stands in any of the items at all, I say. " * 9
    return [
        (1, filler + passages[0] + filler),
        (2, passages[1].upper().replace(" ", "\n")),
        (3, " ".join(long[1:]) + " " + filler),
        (4, filler + " ".join(long[:-1])),
        (5, filler + " ".join(long[: len(long) // 2]) + filler),
        (6, filler + " ".join([*long[:1], "extra", *long[1:]]) + filler),
        (7, None),
        (8, ""),
        (9, "alpha beta gamma"),
        (10, "so alpha, beta. gamma!" + filler),
        (None, passages[2]),
        (1, filler + passages[3]),
    ]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_leaks_by_brute_force(spark, monkeypatch, passages, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", broadcast)
    items = [*passages.items(), (900, "Alpha beta gamma"), (901, None), (902, "..."), (903, passages[3])]
    documents = spark.createDataFrame(cases(passages), "doc_id LONG, text STRING").selectExpr("*", "1 AS item_id", "2 AS start")
    benchmark = spark.createDataFrame(items + [items[0]], "item_id LONG, text STRING")
    got = found(decontamination.contaminated(documents, benchmark))
    assert got == brute_force(cases(passages), items)
    clean = decontamination.clean(documents, benchmark)
    leaking = {doc for doc, _ in got}
    assert clean.columns == documents.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, _ in cases(passages) if i not in leaking)


def test_empty_tables(spark, edge, none, passages):
    benchmark = spark.createDataFrame(list(passages.items()), "item_id LONG, text STRING")
    assert decontamination.contaminated(none, benchmark).collect() == []
    assert decontamination.contaminated(edge, benchmark.limit(0)).collect() == []
    assert decontamination.contaminated(edge, benchmark).collect() == []
    assert decontamination.clean(edge, benchmark.limit(0)).count() == edge.count()


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(200):
        flipped = sum(1 << b for b in rng.sample(range(64), 15))
        a = rng.getrandbits(64)
        rows.append((i, a - (1 << 63), (a ^ flipped) - (1 << 63)))
    pairs = spark.createDataFrame(rows, "i LONG, a LONG, b LONG")
    pairs = pairs.select(
        decontamination._blocks(pairs["a"], 15).alias("a"), decontamination._blocks(pairs["b"], 15).alias("b")
    )
    assert pairs.where("size(array_intersect(a, b)) = 0").count() == 0


def test_query_by_brute_force(spark, passages):
    table = pd.read_parquet(f"{FOLDER}/documents.parquet")
    rows = list(zip(table["doc_id"].tolist(), table["text"].tolist()))
    listed = {tuple(s) for p in passages.values() for s in shingles(words(p))}
    rows = [(i, t) for i, t in rows if listed & set(shingles(words(t)))]
    got = found(QUERIES["op7_decontamination"](spark, FOLDER))
    assert got == brute_force(rows, passages.items()) and got


def test_the_main_path_runs_no_python(spark):
    plan = QUERIES["op7_decontamination"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
