"""The pipeline against its operators and brute force, stage by stage."""

import hashlib

import corpus_pipeline
import pandas as pd
import pytest
from tokenizers import Tokenizer

from ticketloom.llm import near_duplicates, quality_classifier
from ticketloom.llm.queries import QUERIES, table, tokenizer_file
from test_decontamination import brute_force as leaks
from test_decontamination import shingles, words
from test_near_duplicates import brute_force as classes

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """doc_id -> text of the documents that brute force keeps."""
    found = {r["doc_id"]: r["text"] for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()}
    passed = {r["doc_id"] for r in QUERIES["op3_quality_rules"](spark, FOLDER).collect() if r["kept"]}
    net = quality_classifier.fit(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    found = {i: t for i, t in found.items() if i in passed and net.scores([t])[0] >= 0.7}
    first = {c for _, c in classes(list(found.items()))}
    found = {i: t for i, t in found.items() if i in first}
    items = pd.read_parquet(f"{FOLDER}/benchmark.parquet")
    items = list(zip(items["item_id"].tolist(), items["text"].tolist()))
    listed = {s for _, p in items for s in shingles(words(p))}
    near = [(i, t) for i, t in found.items() if listed & set(shingles(words(t)))]
    leaking = {i for i, _ in leaks(near, items)}
    return {i: t for i, t in found.items() if i not in leaking}


def test_pipeline_by_brute_force(spark, kept):
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = []
    for i, text in kept.items():
        ids = library.encode(text, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text)]
        want.append((i, len(ids), *hashes))
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(want) and want


def test_stages_keep_the_columns_and_take_all_kinds_of_rows(spark, edge, none):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for documents in (edge, none):
            found = stage(spark, documents, FOLDER)
            assert found.columns == edge.columns
            assert found.count() <= documents.count()
    last = corpus_pipeline.STAGES[-1][1](spark, edge, FOLDER)
    assert last.count() == edge.count()


def test_one_row_of_repeated_rows_stays(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "d e f"), (3, "d  e f")]
    documents = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert sorted(r["doc_id"] for r in near_duplicates.representatives(documents).collect()) == [1, 3]
