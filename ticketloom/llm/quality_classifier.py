"""Operator 4: attention-based multiple-instance learning of document quality.

A document is a bag of passages (runs of PASSAGE_WORDS words). Every passage is encoded: byte and
byte-class statistics go through a learned layer. Gated attention, tanh(V h) * sigmoid(U h), gives each
passage a weight learned from document labels alone, and the weighted sum of the passages is scored.

The network is fitted on a bounded sample (PER_LABEL documents of each label, each of at most LONGEST
bytes) on the driver, with fixed seeds; weights restore the labels' shares. Scoring takes all passages of
whole texts in one pass without a shuffle; the broadcast network has a fixed size.

Defined cases: a null text counts as empty; an empty text is one passage without words; without labelled
documents, or with one label only, every score is that label's share (0.5 without any); repeated
rows are scored one by one; an empty table gives an empty result; other columns are not read. Two rows
with one doc_id and different texts may put either into the sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.batches import annotate, kept_rows
from ticketloom.llm.samples import Sample, fold, labelled_sample

PASSAGE_WORDS = 64
PER_LABEL = 2_500
LONGEST = 32_768
HIDDEN, GATES = 24, 12
STEPS, BAGS, RATE, DECAY = 400, 128, 0.01, 1e-4
ACCEPTED = 0.7


def _byte_classes() -> np.ndarray:
    """Classes of bytes: lower, upper, digit, space, line end, stops, marks, brackets, signs, other, beyond ASCII."""
    classes = np.full(256, 9, np.int64)
    groups = [
        b"abcdefghijklmnopqrstuvwxyz",
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        b"0123456789",
        b" \t\x0b\x0c",
        b"\n\r",
        b".,;:",
        b"!?",
        b"()[]{}'\"",
        b"#*$%&|<>",
    ]
    for number, group in enumerate(groups):
        classes[list(group)] = number
    classes[128:] = 10
    return classes


CLASSES = _byte_classes()
KINDS = 11
FEATURES = 128 + KINDS * KINDS + 4
WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages of all texts, and the number of passages of each text."""
    encoded = [t.encode() + b"\n" for t in texts]
    data = np.frombuffer(b"".join(encoded), np.uint8)
    ends = np.cumsum([len(b) for b in encoded])
    white = WHITE[data]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    owner = np.searchsorted(ends, starts, side="right")
    words = np.bincount(owner, minlength=len(texts))
    per_text = np.maximum(-(-words // PASSAGE_WORDS), 1)
    first_passage = np.cumsum(per_text) - per_text
    first_word = np.cumsum(words) - words
    word_passage = first_passage[owner] + (np.arange(len(starts)) - first_word[owner]) // PASSAGE_WORDS
    count = int(per_text.sum())

    # A byte belongs to the passage of the last word that began, or to the first passage of its text.
    lengths = np.diff(ends, prepend=0)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    last = np.cumsum(np.isin(np.arange(len(data)), starts, assume_unique=True)) - 1
    of_word = np.where(last >= 0, word_passage[np.maximum(last, 0)], 0) if len(starts) else np.zeros_like(last)
    passage = np.maximum(of_word, first_passage[text_of])

    sizes = np.maximum(np.bincount(passage, minlength=count), 1)[:, None]
    single = np.bincount(passage * 128 + np.where(data < 128, data, 127), minlength=count * 128)
    kinds = CLASSES[data]
    same = text_of[1:] == text_of[:-1]
    pairs = np.bincount(
        (passage[1:] * KINDS * KINDS + kinds[:-1] * KINDS + kinds[1:])[same], minlength=count * KINDS * KINDS
    )
    n_words = np.maximum(np.bincount(word_passage, minlength=count), 1)
    inside = np.arange(len(data)) - starts[np.maximum(last, 0)] if len(starts) else np.zeros(len(data), np.int64)
    mixed = np.where(white, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * POWERS[inside % 64])
    codes = np.add.reduceat(mixed, starts) if len(starts) else np.zeros(0, np.uint64)
    order = np.lexsort((codes, word_passage))
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (np.diff(codes[order]) != 0) | (np.diff(word_passage[order]) != 0)
    distinct = np.bincount(word_passage[order], weights=fresh, minlength=count) / n_words
    again = np.zeros(len(codes))
    again[1:] = (codes[1:] == codes[:-1]) & (word_passage[1:] == word_passage[:-1])
    again = np.bincount(word_passage, weights=again, minlength=count) / n_words
    extra = np.stack([distinct, again, np.log1p(n_words) / 5, sizes[:, 0] / n_words / 10], axis=1)
    features = np.concatenate(
        [
            np.sqrt(single.reshape(count, 128) / sizes),
            np.sqrt(pairs.reshape(count, KINDS * KINDS) / sizes),
            extra,
        ],
        axis=1,
    )
    return features.astype(np.float32), per_text


@dataclass
class Network:
    """Encoder W, b; attention V, U, a; scorer c, d. `constant` replaces them where nothing can be learned."""

    weights: dict[str, np.ndarray] | None
    constant: float = 0.5

    def forward(self, features: np.ndarray, per_text: np.ndarray) -> dict[str, np.ndarray]:
        w, starts = self.weights, np.cumsum(per_text) - per_text
        hidden = np.maximum(features @ w["W"] + w["b"], 0)
        tanh = np.tanh(hidden @ w["V"])
        gate = 1 / (1 + np.exp(-(hidden @ w["U"])))
        raw = (tanh * gate) @ w["a"]
        top = np.repeat(np.maximum.reduceat(raw, starts), per_text)
        powers = np.exp(raw - top)
        attention = powers / np.repeat(np.add.reduceat(powers, starts), per_text)
        pooled = np.add.reduceat(attention[:, None] * hidden, starts)
        score = 1 / (1 + np.exp(-np.clip(pooled @ w["c"] + w["d"], -30, 30)))
        return {"h": hidden, "t": tanh, "g": gate, "p": attention, "z": pooled, "y": score}

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        return self.forward(*passages(texts))["y"].astype(np.float64)


def _gradients(net: Network, features, per_text, labels, importance) -> dict[str, np.ndarray]:
    w, f = net.weights, net.forward(features, per_text)
    error = (f["y"] - labels) * importance
    d_pooled = np.repeat(error[:, None] * w["c"], per_text, axis=0)
    d_attention = (d_pooled * f["h"]).sum(axis=1)
    starts = np.cumsum(per_text) - per_text
    mean = np.repeat(np.add.reduceat(f["p"] * d_attention, starts), per_text)
    d_raw = f["p"] * (d_attention - mean)
    d_both = d_raw[:, None] * w["a"]
    d_tanh = d_both * f["g"] * (1 - f["t"] ** 2)
    d_gate = d_both * f["t"] * f["g"] * (1 - f["g"])
    d_hidden = (f["p"][:, None] * d_pooled + d_tanh @ w["V"].T + d_gate @ w["U"].T) * (f["h"] > 0)
    return {
        "W": features.T @ d_hidden,
        "b": d_hidden.sum(axis=0),
        "V": f["h"].T @ d_tanh,
        "U": f["h"].T @ d_gate,
        "a": (d_raw[:, None] * f["t"] * f["g"]).sum(axis=0),
        "c": f["z"].T @ error,
        "d": error.sum(keepdims=True),
    }


def _sample_passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same as `passages`, a few texts at a time into one array: the driver holds the features once."""
    per_text = np.array([max(-(-len(t.encode().split()) // PASSAGE_WORDS), 1) for t in texts])
    ends = np.cumsum(per_text)
    features = np.empty((ends[-1], FEATURES), np.float32)
    for i in range(0, len(texts), 8):
        part = passages(texts[i : i + 8])[0]
        features[ends[i] - per_text[i] :][: len(part)] = part
    return features, per_text


def fitted(sample: Sample) -> Network:
    """The network after STEPS steps of Adam on BAGS documents each, the same for the same sample."""
    labels = np.array(sample.labels, np.float32)
    if len(set(sample.labels)) < 2:
        return Network(None, sample.share if sample.labels else 0.5)
    features, per_text = _sample_passages(sample.texts)
    starts = np.cumsum(per_text) - per_text
    importance = np.array(sample.weights(), np.float32)
    importance /= importance.mean()

    rng = np.random.default_rng(7)
    shapes = {
        "W": (FEATURES, HIDDEN),
        "b": (HIDDEN,),
        "V": (HIDDEN, GATES),
        "U": (HIDDEN, GATES),
        "a": (GATES,),
        "c": (HIDDEN,),
        "d": (1,),
    }
    net = Network(
        {k: (rng.standard_normal(s) / np.sqrt(max(s[0], 1))).astype(np.float32) for k, s in shapes.items()}
    )
    net.weights["b"][:], net.weights["d"][:] = 0, 0
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    waiting = np.zeros(0, np.int64)
    for step in range(1, STEPS + 1):
        if len(waiting) < BAGS:
            waiting = np.concatenate([waiting, *(rng.permutation(len(labels)) for _ in range(-(-BAGS // len(labels))))])
        bags, waiting = waiting[:BAGS], waiting[BAGS:]
        rows = np.concatenate([np.arange(starts[i], starts[i] + per_text[i]) for i in bags])
        found = _gradients(net, features[rows], per_text[bags], labels[bags], importance[bags] / len(bags))
        for k, g in found.items():
            g = g + DECAY * net.weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            scale = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
            net.weights[k] = (net.weights[k] - RATE * (first[k] / (1 - 0.9**step)) / scale).astype(np.float32)
    return net


def fit(documents: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> Network:
    """Learns `quality` from the labels outside the held-out fold."""
    learnable = fold(F.col("doc_id"), folds) != held_out
    return fitted(labelled_sample(documents, labels, "quality", learnable, PER_LABEL, LONGEST))


def scored(documents: DataFrame, net: Network, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ACCEPTED) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(net)
    result = annotate(
        documents, ["doc_id"], "score DOUBLE", lambda: lambda texts, n=shared.value: [n.scores(texts)]
    )
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return result.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted")
    )


def accepted(documents: DataFrame, net: Network) -> DataFrame:
    """The documents that score ACCEPTED or more, with their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(net)
    return kept_rows(documents, lambda: lambda texts, n=shared.value: n.scores(texts) >= ACCEPTED)
