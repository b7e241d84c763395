"""Operator 9: toxicity by compression distance under two zstandard dictionaries.

A text becomes windows of WINDOW_WORDS words, each word written as a code of CODE_BYTES bytes (a digest of
the word in lower case without marks around it), so that a match is a whole word and never a chance
piece of one. Each window is compressed twice: under a dictionary trained on ordinary text, and under one
that also has a dictionary trained on toxic text. What the second saves is the window's distance; windows
that save LEAST_SAVING bytes or more add up, and a logistic curve over the sum and the text's length,
calibrated on labelled documents that took no part in the training, gives the score.

The training text of the toxic dictionary: of a toxic document most words are ordinary, so it gives only
the words that recur in the toxic documents of the sample far more than in the ordinary ones, counted by
different neighbours on either side (copies and shared passages count once). The sample is bounded: at most PER_LABEL
documents of each label, each of at most LONGEST bytes; a quarter of it calibrates. All of it is fitted on
the driver; scoring takes whole texts in one pass without a shuffle.

Defined cases: a null text counts as empty, an empty text has no windows and a sum of 0; without toxic
or without ordinary labelled documents every score is the share of toxic labels (0 without any); repeated
rows are scored one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.batches import Memo, annotate
from ticketloom.llm.samples import Sample, fold, labelled_sample

WINDOW_WORDS = 16
CODE_BYTES = 12
LEAST_SAVING = 3
PER_LABEL = 3_000
LONGEST = 32_768
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 8_192
MARKS = b".,;:!?#*$%&()[]{}\"'|<>"

# A word of toxic text occurs beside this many different neighbours, in this share of the toxic documents,
# and this many times as often as in ordinary ones.
LEAST_CONTEXTS, LEAST_SHARE, LEAST_RATIO = 4, 0.005, 10


def words_of(text: str) -> list[bytes]:
    return [w.strip(MARKS) for w in text.lower().encode().split()]


def code_of(word: bytes) -> bytes:
    return hashlib.md5(word).digest()[:CODE_BYTES]


def windows_of(codes: list[bytes]) -> list[bytes]:
    return [b"".join(codes[i : i + WINDOW_WORDS]) for i in range(0, len(codes), WINDOW_WORDS)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Matches of half a code or more, and no header: a window's length is what its content takes."""
    parameters = zstandard.ZstdCompressionParameters(
        window_log=17,
        hash_log=15,
        chain_log=15,
        search_log=1,
        min_match=6,
        target_length=0,
        strategy=zstandard.STRATEGY_DFAST,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
    )
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=parameters)


@dataclass(frozen=True)
class ToxicityModel:
    """The two trained dictionaries and the calibration; without dictionaries, a constant score."""

    ordinary: bytes
    toxic: bytes
    curve: tuple[float, ...]
    constant: float = 0.0


class Distances:
    """Sums of what the windows of a text save under the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.both = _compressor(ordinary), _compressor(ordinary + toxic)
        self.codes = Memo(code_of, bound=400_000)

    def of(self, text: str) -> tuple[int, int]:
        """The saved bytes, and the number of words."""
        codes = list(map(self.codes.__getitem__, words_of(text)))
        saved = 0
        for window in windows_of(codes):
            less = len(self.ordinary.compress(window)) - len(self.both.compress(window))
            if less >= LEAST_SAVING:
                saved += less
        return saved, len(codes)


@lru_cache(maxsize=2)
def distances(ordinary: bytes, toxic: bytes) -> Distances:
    """One per Python worker, kept between its tasks."""
    return Distances(ordinary, toxic)


def toxic_words(toxic: list[str], ordinary: list[str]) -> set[bytes]:
    """Words that recur beside different neighbours in toxic documents far more than in ordinary ones."""

    def contexts(texts):
        found = defaultdict(lambda: (set(), set()))
        for text in texts:
            words = [b"", *words_of(text), b""]
            first = {}
            for before, word, after in zip(words, words[1:], words[2:]):
                first.setdefault(word, (before, after))
            for word, (before, after) in first.items():
                found[word][0].add(before)
                found[word][1].add(after)
        return {word: min(len(before), len(after)) for word, (before, after) in found.items()}

    here, there = contexts(toxic), contexts(ordinary)
    least = max(LEAST_CONTEXTS, LEAST_SHARE * len(toxic))
    return {
        word
        for word, n in here.items()
        if word and n >= least and n * len(ordinary) >= LEAST_RATIO * (there.get(word, 0) + 1) * len(toxic)
    }


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary's bytes; the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=4 * CODE_BYTES, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sorted(set(samples)))[:size]


def _features(found: np.ndarray) -> np.ndarray:
    saved, words = found[:, 0], found[:, 1]
    return np.stack([np.ones(len(found)), np.log1p(saved), np.log1p(words), np.minimum(saved, 60) / 20], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method on the weighted log likelihood with a small ridge."""
    beta = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        move = np.linalg.solve(curve, slope)
        beta = beta + move
        if np.abs(move).max() < 1e-9:
            break
    return beta


def fitted(sample: Sample) -> ToxicityModel:
    """The model of a sample; every fourth document of each label calibrates, the others train."""
    seen = {0: 0, 1: 0}
    train, calibrate = {0: [], 1: []}, []
    for text, label, weight in zip(sample.texts, sample.labels, sample.weights()):
        if seen[label] % 4 == 3:
            calibrate.append((text, label, weight))
        else:
            train[label].append(text)
        seen[label] += 1
    if not (train[0] and train[1] and {y for _, y, _ in calibrate} == {0, 1}):
        return ToxicityModel(b"", b"", (), sample.share if sample.texts else 0.0)
    words = toxic_words(train[1], train[0])
    spans = [code_of(w) for text in train[1] for w in words_of(text) if w in words]
    windows = [w for text in train[0] for w in windows_of([code_of(x) for x in words_of(text)])]
    # Windows of fixed places in the list, so that training stays short.
    ordinary = _trained(ORDINARY_BYTES, windows[:: max(1, len(windows) // 40_000)])
    toxic = _trained(TOXIC_BYTES, spans) if spans else b""
    found = Distances(ordinary, toxic)
    x = _features(np.array([found.of(text) for text, _, _ in calibrate], float))
    y = np.array([label for _, label, _ in calibrate], float)
    weight = np.array([w for _, _, w in calibrate])
    return ToxicityModel(ordinary, toxic, tuple(_logistic(x, y, weight * len(y) / weight.sum())))


def fit(documents: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> ToxicityModel:
    """Learns `toxic` from the labels outside the held-out fold."""
    learnable = fold(F.col("doc_id"), folds) != held_out
    return fitted(labelled_sample(documents, labels, "toxic", learnable, PER_LABEL, LONGEST))


def scores(texts: list[str], model: ToxicityModel) -> np.ndarray:
    if not model.curve:
        return np.full(len(texts), model.constant)
    found = distances(model.ordinary, model.toxic)
    x = _features(np.array([found.of(t) for t in texts], float).reshape(-1, 2))
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.curve), -30, 30)))


def scored(documents: DataFrame, model: ToxicityModel, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    result = annotate(
        documents, ["doc_id"], "score DOUBLE", lambda: lambda texts, m=shared.value: [scores(texts, m)]
    )
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return result.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
