"""Locally consistent naming of words, runs and pairs: the array part of operator 12.

A word's name is a 64-bit digest of its bytes. The first round names each maximal run of one word; every
further round names pairs of neighbours (a, b) where a is a left and b a right symbol, which one bit of a
digest of the name decides. A name is a function of what it stands for, so equal runs and pairs have one
name in every document and on every executor, without a dictionary that would have to be shared.

Every symbol carries the range of words that decides that it is there: its own words and those neighbours
whose names were looked at. Whoever reads the same words in that range finds the same symbol at the same
place. At the ends of a document the range is unbounded, since something may precede or follow elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
UNBOUNDED = 1 << 40
# Bytes whose powers stand in memory at once.
PIECE = 1 << 20

# White space that separates words: blank, and 9 to 13.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits of the argument and on the salt."""
    x = x + U(0x9E3779B97F4A7C15 * (salt + 1) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Polynomial:
    """Digests of all slices of a sequence, from prefix sums modulo 2**64."""

    def __init__(self, multiplier: int):
        self.multiplier = multiplier
        self.inverse = pow(multiplier, -1, 2**64)
        self.powers = self.inverses = np.ones(1, U)

    def digests(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(values) + 1:
            self.powers, self.inverses = (
                np.concatenate([np.ones(1, U), np.cumprod(np.full(len(values), m, U))])
                for m in (U(self.multiplier), U(self.inverse))
            )
        sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.powers[: len(values)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.inverses[starts]


# Two independent digests of words and of windows: tables of byte values and multipliers.
_TABLES = [mixed(np.arange(256, dtype=U), salt) for salt in (11, 12)]
_OF_BYTES = [Polynomial(m) for m in (0xD6E8FEB86659FD93, 0xA3B195354A39B70D)]
_OF_WORDS = [Polynomial(m) for m in (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)]


@dataclass
class Words:
    """The words of several texts: where they are in the bytes, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def names(self, which: int = 0) -> np.ndarray:
        """One of two 64-bit names of every word."""
        found = np.empty(len(self.starts), U)
        at = 0
        while at < len(self.starts):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + PIECE, "right")))
            values = _TABLES[which][self.data[base : self.ends[to - 1]]]
            found[at:to] = _OF_BYTES[which].digests(values, self.starts[at:to] - base, self.ends[at:to] - base)
            at = to
        return mixed(found + (self.ends - self.starts).astype(U), 13 + which)


def words_of(texts: pa.Array) -> Words:
    """The words of an Arrow array of texts; null is a text without words."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    # A word ends before white space and at the end of its text; border marks where a word may not go on.
    inside = ~WHITE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before = np.concatenate([[False], inside])[:-1]
    after = np.concatenate([inside, [False]])[1:]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


@dataclass
class Symbols:
    """Symbols in the order of the text: name, first word, the deciding range of words, and the text's number."""

    name: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray
    text: np.ndarray

    def taken(self, which: np.ndarray) -> "Symbols":
        return Symbols(*[a[which] for a in (self.name, self.start, self.low, self.high, self.text)])

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a symbol is the first, or the last, of its text."""
        n = len(self.name)
        first, last = np.ones(n, bool), np.ones(n, bool)
        first[1:] = self.text[1:] != self.text[:-1]
        last[:-1] = first[1:]
        return first, last

    def beside(self) -> tuple[np.ndarray, np.ndarray]:
        """The low end of the neighbour before, and the high end of the one behind."""
        first, last = self.sides()
        low, high = np.full(len(self.name), -UNBOUNDED), np.full(len(self.name), UNBOUNDED)
        low[1:], high[:-1] = self.low[:-1], self.high[1:]
        low[first], high[last] = -UNBOUNDED, UNBOUNDED
        return low, high


def _runs(s: Symbols) -> Symbols:
    """Each maximal run of one name becomes a symbol; a run of one keeps its name."""
    first, _ = s.sides()
    head = first.copy()
    head[1:] |= s.name[1:] != s.name[:-1]
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(s.name)) - 1
    length = (tails - heads + 1).astype(U)
    name = np.where(length == 1, s.name[heads], mixed(s.name[heads] ^ mixed(length, 21), 22))
    low, high = s.beside()
    return Symbols(name, s.start[heads], low[heads], high[tails], s.text[heads])


def _pairs(s: Symbols, number: int) -> Symbols:
    """Each left symbol before a right symbol becomes one with it.

    That both are there decides that they join; that a symbol stays alone depends on the neighbour it
    would have joined.
    """
    right = (mixed(s.name, 31 + number) & U(1)).astype(bool)
    _, last = s.sides()
    joins = np.zeros(len(s.name), bool)
    joins[:-1] = ~right[:-1] & right[1:] & ~last[:-1]
    low, high = s.beside()
    following = np.append(s.name[1:], U(0))
    name = np.where(joins, mixed(s.name * U(3) + mixed(following, 81), 131 + number), s.name)
    low = np.where(right, low, s.low)
    high = np.where(right, s.high, high)
    joined = Symbols(name, s.start, low, high, s.text)
    absorbed = np.zeros(len(s.name), bool)
    absorbed[1:] = joins[:-1]
    return joined.taken(~absorbed)


def pair_rounds(window: int) -> int:
    """Rounds after which most deciding ranges still fit in a window: a round makes symbols 4/3 as long."""
    return max(0, int(np.log(window / 6) / np.log(4 / 3))) if window > 6 else 0


def symbols(words: Words, window: int) -> Symbols:
    """The symbols after all rounds whose deciding range fits in a window."""
    at = np.arange(len(words.starts))
    s = _runs(Symbols(words.names(), at, at, at + 1, words.text_of_word()))
    for number in range(pair_rounds(window)):
        s = _pairs(s, number)
    return s.taken(s.high - s.low <= window)


def covered(total: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of `total` places lie in any of the ranges [begin, end)."""
    change = np.bincount(begins, minlength=total + 1) - np.bincount(ends, minlength=total + 1)
    return np.cumsum(change)[:total] > 0


def open_windows(words: Words, found: Symbols, unique: np.ndarray, window: int) -> np.ndarray:
    """First words of the windows that hold the deciding range of no unique symbol."""
    total = len(words.starts)
    text_begin = words.first[:-1][found.text[unique]]
    # Starts of the windows around the range, none before the text.
    begins = np.maximum(found.high[unique] - window, text_begin)
    closed = covered(total, begins, found.low[unique] + 1)
    fits = np.arange(total) + window <= np.repeat(words.first[1:], words.counts)
    return np.flatnonzero(fits & ~closed)


def fingerprints(words: Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for the words of each window."""
    return tuple(
        mixed(_OF_WORDS[i].digests(words.names(i), starts, starts + window), 41 + i).view(np.int64) for i in (0, 1)
    )


def remaining(words: Words, removed: np.ndarray) -> pa.Array:
    """The texts of the words that are not removed, one space apart."""
    kept = ~removed
    text = words.text_of_word()[kept]
    ends = words.ends[kept]
    data = words.data.copy()
    shown = covered(len(data), words.starts[kept], ends) if len(data) else np.zeros(0, bool)
    # The byte behind a word that another one of its text follows is white space.
    gaps = ends[:-1][text[1:] == text[:-1]] if len(ends) else ends
    data[gaps], shown[gaps] = 32, True
    spaces = np.bincount(text[1:][text[1:] == text[:-1]], minlength=len(words.first) - 1) if len(text) else 0
    sizes = np.bincount(text, weights=ends - words.starts[kept], minlength=len(words.first) - 1)
    offsets = np.concatenate([[0], np.cumsum(sizes.astype(np.int64) + spaces)])
    narrow = offsets[-1] < 2**31
    kind = pa.StringArray if narrow else pa.LargeStringArray
    buffers = [pa.py_buffer(offsets.astype(np.int32 if narrow else np.int64)), pa.py_buffer(data[shown])]
    return kind.from_buffers(len(offsets) - 1, *buffers)
