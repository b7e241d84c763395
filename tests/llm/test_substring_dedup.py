"""Repeated windows against brute force, and the parse they rest on."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from ticketloom.llm import recompression
from ticketloom.llm.queries import QUERIES, table, workers_import
from ticketloom.llm.substring_dedup import without_repeats

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_force(rows, window=20):
    """(doc_id, number of words, number removed, text left) of every row."""
    listed = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, words in listed:
        for p in range(len(words) - window + 1):
            key, place = tuple(words[p : p + window]), ((i is not None, i or 0), p)
            first[key] = min(first.get(key, place), place)
    found = []
    for i, words in listed:
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < ((i is not None, i or 0), p):
                gone.update(range(p, p + window))
        left = " ".join(w for p, w in enumerate(words) if p not in gone)
        found.append((i, len(words), len(gone), left))
    return found


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_whole_query_by_brute_force(spark):
    rows = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    want = [(i, n, r, hashlib.sha256(t.encode()).hexdigest()) for i, n, r, t in brute_force(rows)]
    assert ordered(QUERIES["op12_substring_dedup"](spark, FOLDER).collect()) == ordered(want)
    assert any(r for _, _, r, _ in want)


@pytest.mark.parametrize("window", [1, 3, 8, 20, 60])
def test_runs_periods_and_copies(spark, window):
    """Few different words: long runs, periods of two and three, passages at either end of a text."""
    workers_import(spark)
    rng = np.random.default_rng(window)
    passage = " ".join(rng.choice(list("abcdefgh"), 70))
    texts = ["a " * 150, "a " * 37 + "b " * 44, "a b " * 60, "a b c " * 50, passage, f"x {passage} y", f"{passage} z"]
    texts += [" ".join(rng.choice(list("ab"), 120)) for _ in range(12)]
    texts += [" ".join(rng.choice(list("abcdefghijklmnop"), 300)) for _ in range(12)]
    texts += [f"\t{passage}\v\n  {passage}", None, "", " \f\r ", "a", "x" * 3000]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    rows += [(None, passage), (None, texts[0]), rows[4], rows[4], (rows[4][0], passage + " " + passage)]
    documents = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(5)
    got = without_repeats(documents, window).collect()
    assert ordered(got) == ordered(brute_force(rows, window))


def test_edges(spark, edge, none):
    want = brute_force([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert ordered(without_repeats(edge).collect()) == ordered(want)
    assert without_repeats(none).count() == 0
    assert without_repeats(edge).columns == ["doc_id", "n_words", "n_removed", "kept"]
    with pytest.raises(ValueError):
        without_repeats(edge, 0)


def test_columns_with_clashing_names(spark, edge):
    clash = edge.select("doc_id", "text", *[edge["verdict"].alias(n) for n in ("unit", "places", "starts", "name")])
    assert ordered(without_repeats(clash).collect()) == ordered(without_repeats(edge).collect())


def test_equal_words_around_a_symbol_give_the_symbol():
    """Every symbol comes back, at its place, in any text that holds its deciding range."""
    rng = np.random.default_rng(3)
    letters = list("abcdefg")
    text = " ".join(rng.choice(letters, 400))
    words = text.split()
    found = recompression.symbols(recompression.words_of(pa.array([text])), 20)
    assert len(found.name) > 50
    for name, start, low, high in zip(found.name, found.start, found.low, found.high):
        before, after = " ".join(rng.choice(letters, 15)), " ".join(rng.choice(letters, 15))
        other = f"{before} {' '.join(words[low:high])} {after}"
        again = recompression.symbols(recompression.words_of(pa.array([other])), 20)
        at = np.flatnonzero(again.start == start - low + 15)
        assert len(at) == 1 and again.name[at[0]] == name


def test_long_words_and_texts_in_pieces(monkeypatch):
    text = " ".join(["ab", "c" * 500, "d", "e" * 90, "ab"] * 30)
    whole = recompression.words_of(pa.array([text, None, text])).names()
    monkeypatch.setattr(recompression, "PIECE", 64)
    assert (recompression.words_of(pa.array([text, None, text])).names() == whole).all()
    assert len(set(whole.tolist())) == 4
