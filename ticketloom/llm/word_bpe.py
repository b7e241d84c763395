"""Operator 8: byte-pair encoding and decoding with a minimal acyclic transducer as the lexicon.

Frequent words are compiled, with their ids, into a shared-suffix automaton (`word_lexicon`), which is
written once to the shared folder and memory-mapped by every Python worker. Words that it lacks are merged
exactly. A bounded memo of words stands before both. The lexicon only saves work; results never depend on it.

Word counts cover all documents. A word is frequent if it takes up at least one part in LEXICON_WORDS of
all characters, so there can be no more than about LEXICON_WORDS of them.

Defined cases: a null text encodes as the empty text, to no ids and to the empty decoded text; special
strings in a text become their ids, as in the library; repeated rows and null doc_ids are encoded row by
row; an empty table gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm.batches import Memo, annotate, text_column
from ticketloom.llm.shared_files import create, mapped
from ticketloom.llm.word_lexicon import Lexicon, compiled
from ticketloom.llm.word_splits import Vocabulary
from ticketloom.session import scratch_dir

LEXICON_WORDS = 50_000

# Words, and pre-tokens, that a worker remembers: about 60 MB each.
MEMO = 300_000

# Ids that are decoded at once.
DECODED = 500_000

# Beyond this many symbols a heap finds the next merge.
SCANNED = 64


class Merger:
    """Exact merges of one pre-token: the lowest-rank pair first, and of equal ranks the leftmost."""

    def __init__(self, vocabulary: Vocabulary):
        self.ids, self.word_end = vocabulary.ids, vocabulary.word_end
        self.merged = [self.ids[a + b] for a, b in vocabulary.merges]
        self.ranks = {}
        for rank, (a, b) in enumerate(vocabulary.merges):
            self.ranks.setdefault((self.ids[a], self.ids[b]), rank)

    def encode(self, token: str) -> list[int]:
        if not token:
            return []
        ids = [self.ids[c] for c in token[:-1]]
        ids.append(self.ids[token[-1] + self.word_end])
        return self._scanned(ids) if len(ids) <= SCANNED else self._by_heap(ids)

    def _scanned(self, ids: list[int]) -> list[int]:
        none = len(self.merged)
        rank = self.ranks.get
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            merged = self.merged[best]
            ids[i : i + 2] = [merged]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], merged), none)
            if i < len(ranks):
                ranks[i] = rank((merged, ids[i + 1]), none)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i):
            if i >= 0 and after[i] < n and (rank := self.ranks.get((ids[i], ids[after[i]]))) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != left or ids[j] != right:
                continue  # one of the two has merged since
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [i for i in ids if i >= 0]


class Encoder:
    """Encodes texts to packed little-endian ids: memo, then lexicon, then merges, by `merge` if given.

    `code` is the number format of an id: "i" for 32 bits with sign, "I" or "H" for 32 or 16 without.
    """

    def __init__(
        self,
        vocabulary: Vocabulary,
        lexicon: Lexicon | None = None,
        code: str = "i",
        merge: Callable[[str], list[int]] | None = None,
    ):
        self.vocabulary, self.lexicon, self.code = vocabulary, lexicon, code
        self.merger = None if merge else Merger(vocabulary)
        self.merge = merge or self.merger.encode
        self.tokens, self.words = Memo(self._token, MEMO), Memo(self._word, MEMO)

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _token(self, token: str) -> bytes:
        ids = self.lexicon.get(token) if self.lexicon else None
        return self._packed(self.merge(token) if ids is None else ids)

    def _word(self, word: str) -> bytes:
        return b"".join([self.tokens[t] for t in self.vocabulary.tokens_of_word(word)])

    def encode(self, text: str) -> bytes:
        if self.vocabulary.is_plain(text):
            return b"".join(map(self.words.__getitem__, text.split()))
        parts = self.vocabulary.tokens_of_text(text)
        return b"".join(self.tokens[p] if isinstance(p, str) else self._packed([p]) for p in parts)


@lru_cache(maxsize=2)
def vocabulary(tokenizer_file: str) -> Vocabulary:
    return Vocabulary(tokenizer_file)


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str, lexicon_uri: str | None = None) -> Encoder:
    """One encoder per Python worker, kept between its tasks; all of a machine map the same lexicon file."""
    lexicon = Lexicon(mapped(lexicon_uri).read_buffer()) if lexicon_uri else None
    return Encoder(vocabulary(tokenizer_file), lexicon)


def frequent_words(documents: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """The words, in lower case, that take up at least one part in `most` of all characters."""
    text = text_column()
    total = documents.agg(F.sum(F.char_length(text) + 1)).first()[0] or 0
    words = documents.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    counts = words.where("word <> ''").groupBy("word").count()
    return counts.where((F.char_length("word") + 1) * F.col("count") * most >= F.lit(total)).select("word")


def build_lexicon(documents: DataFrame, tokenizer_file: str, most: int = LEXICON_WORDS) -> str:
    """Compiles the frequent words of the documents; the place of the file in the shared folder."""
    # Not the workers' one, which stays: the driver needs it just here.
    found = Encoder(Vocabulary(tokenizer_file))
    # About `most` words at the most: each takes up at least one part in `most` of all characters.
    words = [r["word"] for r in frequent_words(documents, most).collect()]
    tokens = {t for w in words for t in found.vocabulary.tokens_of_word(w)}
    uri = scratch_dir(documents.sparkSession, "lexicon") + "/lexicon.bin"
    with create(uri) as file:
        file.write(compiled({t: found.merger.encode(t) for t in tokens}))
    return uri


def _lists(found: Encoder, texts: list[str]) -> pa.ListArray:
    """The ids of each text."""
    packed = [found.encode(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encoded(documents: DataFrame, tokenizer_file: str, lexicon_uri: str | None = None) -> DataFrame:
    """doc_id and ids, an array of int: the encoding of each whole text."""
    found = lambda: encoder(tokenizer_file, lexicon_uri)
    return annotate(
        documents, ["doc_id"], "ids ARRAY<INT>", lambda: lambda texts, e=found(): [_lists(e, texts)]
    )


def round_trip(documents: DataFrame, tokenizer_file: str, lexicon_uri: str | None = None) -> DataFrame:
    """doc_id, ids and decoded: each whole text encoded, and its ids decoded again, by one worker."""

    def prepare():
        found, spell = encoder(tokenizer_file, lexicon_uri), decoder(tokenizer_file)

        def compute(texts):
            ids = _lists(found, texts)
            return [ids, spell(ids)]

        return compute

    return annotate(documents, ["doc_id"], "ids ARRAY<INT>, decoded STRING", prepare)


def decoder(tokenizer_file: str):
    """A function from lists of ids to texts: for a file without a decoder, the tokens with spaces between."""
    known = vocabulary(tokenizer_file)
    if known.has_decoder:
        raise ValueError("only vocabulary files without a decoder are supported")
    tokens = [""] * known.size
    for token, i in [*known.ids.items(), *known.special.items()]:
        tokens[i] = token
    spelled = pa.array(tokens)

    def spell(ids: pa.ListArray) -> pa.Array:
        offsets = pc.subtract(ids.offsets, ids.offsets[0])
        return pc.binary_join(pa.ListArray.from_arrays(offsets, spelled.take(ids.flatten())), " ")

    return spell


def _parts(batch: pa.RecordBatch):
    """The batch in parts of at most DECODED ids; a longer encoding is alone."""
    start, size = 0, 0
    for i, length in enumerate(pc.list_value_length(batch.column("ids")).to_pylist()):
        if i > start and size + length > DECODED:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += length
    if batch.num_rows > start:
        yield batch.slice(start)


def decoded(encodings: DataFrame, tokenizer_file: str) -> DataFrame:
    """The encodings with their decoded text."""
    columns = encodings.columns

    def decode(batches):
        spell = decoder(tokenizer_file)
        for batch in batches:
            for part in _parts(batch):
                arrays = [part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, spell(part.column("ids"))], names=[*columns, "decoded"])

    schema = T.StructType([*encodings.schema.fields, T.StructField("decoded", T.StringType())])
    return encodings.mapInArrow(decode, schema)
