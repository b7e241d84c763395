"""Token counts, quality rules, encoding and token files against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ticketloom.llm import quality_rules, token_counts, token_files, word_bpe
from ticketloom.llm.queries import QUERIES, digests, round_trip, tokenizer_file
from ticketloom.llm.word_lexicon import Lexicon, compiled
from ticketloom.llm.word_splits import Vocabulary

FOLDER = "/root/testdata/sf0.001"
PIECES, WORDS = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")
LETTERS = "abIS's \n\r\tÉé1²<|>_-🙂Σσİ'T\u0301▁日s/=;"


def strange_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_piece_counts_equal_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = token_counts.PieceCounter(PIECES)
    texts = strange_texts(500) + ["", " ", "  a ", "\n\n", "a\r\nb;\r\n", "a" * 500, "=" * 99, "▁▁x▁"]
    assert [counter.count(t) for t in texts] == [len(model.encode(t)) for t in texts]


def test_token_counts_of_all_kinds_of_rows(edge, none):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for row in edge.collect():
        text = row["text"] or ""
        n = len(model.encode(text))
        want.append((row["doc_id"], len(text.encode()), n, n > 4096))
    found = token_counts.token_counts(edge, PIECES)
    assert collected(found) == sorted(want, key=repr)
    assert token_counts.token_counts(none, PIECES).collect() == []


def base_by_hand(text):
    """The base rules from their wording alone."""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in " \t\n\x0b\x0c\r" for c in line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(marked) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dup, len(marked), failed


def test_base_rules_by_brute_force():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab#\n") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += strange_texts(50) + ["x y\nx y\n \nx y", "a " * 9, "a " * 8, "one two " * 30]
    assert [quality_rules.base_rules(t) for t in texts] == [base_by_hand(t) for t in texts]


def ratio_by_hand(texts, good):
    """Mean log ratios with dictionaries instead of arrays."""

    def grams(text):
        data = text.encode()
        for n in quality_rules.ORDERS:
            for i in range(len(data) - n + 1):
                value = int.from_bytes(data[i : i + n], "big")
                yield (value + n) * 2654435761 % 2**32 >> 16

    raw, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for text, g in zip(texts, good):
        for b in grams(text):
            raw[b] += 1
            target[b] += g
    log = lambda x: np.log((x + 1) / (x.sum() + len(x)))
    ratios = log(target) - log(raw) if target.sum() else np.zeros(len(raw))
    return [np.mean([ratios[b] for b in grams(t)]) if list(grams(t)) else 0.0 for t in texts]


def test_quality_verdicts_by_brute_force(spark, edge, none):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").union(
        edge.select("doc_id", "text").where("doc_id <> 8 OR doc_id IS NULL")
    )
    rows = [(r["doc_id"], r["text"] or "") for r in documents.collect()]
    good = {i for i, _ in rows if i is not None and i % 3}
    trusted = spark.createDataFrame([(i,) for i in sorted(good)], "doc_id LONG")
    ratios = ratio_by_hand([t for _, t in rows], [i in good for i, _ in rows])
    want = []
    for (i, text), ratio in zip(rows, ratios):
        base = base_by_hand(text) if len(text) < 30_000 else quality_rules.base_rules(text)
        want.append((i, *base, round(ratio, 9), not base[-1] and ratio >= quality_rules.LEAST_RATIO))
    found = [(*r[:7], round(r[7], 9), r[8]) for r in quality_rules.quality_verdicts(documents, trusted).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    nobody = trusted.limit(0)
    assert {r["log_ratio"] for r in quality_rules.quality_verdicts(edge, nobody).collect()} == {0.0}
    assert quality_rules.quality_verdicts(none, trusted).collect() == []
    kept = quality_rules.passing(edge, nobody)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == set()


def test_lexicon_finds_its_words_and_shares_suffixes():
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(500)}
    inside, outside = set(sorted(words)[::2]), set(sorted(words)[1::2])
    ids = {w: [len(w), i] for i, w in enumerate(sorted(inside))}
    lexicon = Lexicon(compiled(ids))
    assert all(lexicon.get(w) == ids[w] for w in inside)
    assert all(lexicon.get(w) is None for w in outside) and lexicon.get("") is None
    shared = Lexicon(compiled({a + "nation": [1] for a in "abcdefgh"}))
    assert len(shared.ends) == 2 + len("nation")
    assert Lexicon(compiled({})).get("a") is None and Lexicon(compiled({"": [4]})).get("") == [4]


def test_encoder_equals_the_library(library):
    vocabulary = Vocabulary(WORDS)
    merger = word_bpe.Merger(vocabulary)
    words = ["thation", "attion", "the", "and", "erth"]
    lexicon = Lexicon(compiled({w: merger.encode(w) for w in words}))
    texts = strange_texts(500) + ["it's I'LL 'S", "x" * 63 + "y" + "!" * 300, "ab" * 500, "the thation,attion."]
    for encoder in (word_bpe.Encoder(vocabulary), word_bpe.Encoder(vocabulary, lexicon)):
        for text in texts:
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encoder.encode(text), "<i4").tolist() == want, text


def test_round_trip_of_all_kinds_of_rows(edge, none, library):
    want = []
    for row in edge.collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text)]
        want.append((row["doc_id"], len(ids), *hashes))
    assert collected(round_trip(edge)) == sorted(want, key=repr)
    assert round_trip(none).collect() == []
    assert collected(digests(word_bpe.decoded(word_bpe.encoded(edge, WORDS), WORDS))) == sorted(want, key=repr)


def test_frequent_words_are_bounded(spark, edge):
    found = {r["word"] for r in word_bpe.frequent_words(edge, 20).collect()}
    assert {"anblewh", "sttible"} <= found and len(found) <= 20


def test_token_files_of_all_kinds_of_rows(spark, edge, none, library):
    rows = [(r["doc_id"], r["text"] or "") for r in edge.collect()]
    layout = token_files.Layout(sequence=16, rows=4)
    found = token_files.token_files(edge.repartition(5), WORDS, layout).collect()
    assert sorted(r["doc_id"] or -1 for r in found) == sorted(i or -1 for i, _ in rows)
    of = {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in rows}
    start, order = 0, sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    for r in order:
        ids = np.array(of[r["doc_id"]], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_files(none, WORDS).collect() == []


def test_sequences_have_one_length_and_masks_mark_padding(spark, tmp_path):
    import pyarrow as pa

    documents = spark.createDataFrame([(i, "the and " * i) for i in range(40)], "doc_id LONG, text STRING")
    layout = token_files.Layout(sequence=8, rows=3)
    files = token_files.write_token_files(documents, WORDS, str(tmp_path), layout).collect()
    for row in files:
        file = pa.ipc.open_file(pa.memory_map(f"{row['file']}.arrow"))
        batches = [file.get_batch(i) for i in range(file.num_record_batches)]
        assert all(b.num_rows == 3 for b in batches[:-1])
        masks = np.concatenate([b.column("mask").values.to_numpy(zero_copy_only=False) for b in batches])
        assert masks.sum() == row["n_ids"] and not masks[row["n_ids"] :].any() and len(masks) % 8 == 0


@pytest.mark.parametrize("name", ["op1_token_counts", "op3_quality_rules", "op8_word_bpe", "op10_token_files"])
def test_queries_cover_every_document(spark, name):
    ids = pd.read_parquet(f"{FOLDER}/documents.parquet")["doc_id"]
    assert sorted(r["doc_id"] for r in QUERIES[name](spark, FOLDER).collect()) == sorted(ids)


def test_token_files_merge_by_the_library(monkeypatch, library):
    """What the memo of words lacks is merged by the library, to the ids of its own call."""
    monkeypatch.setattr(word_bpe.Merger, "encode", None)
    token_files.packed_encoder.cache_clear()
    encoder = token_files.packed_encoder(WORDS)
    for text in ["", "Plain words, 12 of them.", "naïve Éclairs don't", "ab" * 300, *strange_texts(300)]:
        ids = np.frombuffer(encoder.encode(text), f"<{encoder.code}").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_plain_texts_of_a_slice_are_encoded_together(monkeypatch, library):
    """Words with different marks, cases and neighbours cost one merge for each different pre-token of a slice."""
    encoder = token_files.PackedEncoder(Vocabulary(WORDS))
    asked = []
    merge = encoder.vocabulary.ids_of_token
    monkeypatch.setattr(encoder.vocabulary, "ids_of_token", lambda token: asked.append(token) or merge(token))
    texts = ["Anble anble, ANBLE.", "'anble' anble's", "", " \n", "anble!'s 's's 'LL'd'x don't 'tis '5 we're'", "1²12½ µªº×÷ÀÉŸŉſ"]
    texts += ["é İ", "<|endoftext|>'s", "anble x"] + [f"a{chr(c)}b '{chr(c)}s" for c in range(1, 0x180)]
    found = encoder.encode_all(texts)
    for text, packed in zip(texts, found):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, f"<{encoder.code}").tolist() == want, text
    assert asked.count("anble") <= 2  # by the plain path once, by the other one once
    assert encoder.encode_all([]) == []


def test_the_driver_keeps_no_encoder_after_the_lexicon(edge):
    word_bpe.encoder.cache_clear()
    word_bpe.vocabulary.cache_clear()
    word_bpe.build_lexicon(edge, WORDS)
    assert word_bpe.encoder.cache_info().currsize == word_bpe.vocabulary.cache_info().currsize == 0
