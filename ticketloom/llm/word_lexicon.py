"""A minimal acyclic transducer from words to lists of ids, built once and memory-mapped by its readers.

States share suffixes: two states with equal futures are one. Each arc has a number, the count of words
that sort before it among the words through its state; the sum along a word's path is the word's index,
which finds its ids. Everything is one array of 32-bit numbers in this order:

    states, arcs, words, ids (counts) | first arc of each state (and the end) | whether each state ends a word
    | arc labels | arc targets | arc numbers | first id of each word (and the end) | ids

State 0 is the start. The arcs of a state are sorted by label, a byte of the word's UTF-8.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np


def _minimal_states(words: list[bytes]) -> tuple[list[list[tuple[int, int]]], list[bool], int]:
    """Arcs and end marks of the minimal automaton of sorted words, and its start state.

    Words come in order, so what lies below the last word's path is final: it is replaced by an equal
    state from the register, or registered.
    """
    arcs: list[list[list[int]]] = [[]]
    ends = [False]
    register: dict[tuple, int] = {}
    path: list[int] = []  # states after each byte of the last word
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth:
            state = path.pop()
            parent = path[-1] if path else 0
            key = (ends[state], tuple(map(tuple, arcs[state])))
            arcs[parent][-1][1] = register.setdefault(key, state)

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        settle(shared)
        for byte in word[shared:]:
            parent = path[-1] if path else 0
            arcs.append([])
            ends.append(False)
            arcs[parent].append([byte, len(arcs) - 1])
            path.append(len(arcs) - 1)
        ends[path[-1] if path else 0] = True
        last = word
    settle(0)
    return arcs, ends, 0


def compiled(ids_of: dict[str, list[int]]) -> bytes:
    """The transducer of the words, as the bytes of its file."""
    by_bytes = {word.encode(): ids for word, ids in ids_of.items()}
    words = sorted(by_bytes)
    arcs, ends, start = _minimal_states(words)
    order, number, waiting = [], {start: 0}, [start]
    while waiting:
        state = waiting.pop()
        order.append(state)
        for _, target in arcs[state]:
            if target not in number:
                number[target] = len(number)
                waiting.append(target)
    order = sorted(number, key=number.get)

    below: dict[int, int] = {}
    stack = [start]
    while stack:
        state = stack[-1]
        missing = [t for _, t in arcs[state] if t not in below]
        if missing:
            stack.extend(missing)
            continue
        below[state] = ends[state] + sum(below[t] for _, t in arcs[state])
        stack.pop()

    first, labels, targets, numbers = [0], [], [], []
    for state in order:
        before = int(ends[state])
        for label, target in arcs[state]:
            labels.append(label)
            targets.append(number[target])
            numbers.append(before)
            before += below[target]
        first.append(len(labels))
    ids = [by_bytes[w] for w in words]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    flat = [i for one in ids for i in one]
    head = [len(order), len(labels), len(words), len(flat)]
    parts = [head, first, [int(ends[s]) for s in order], labels, targets, numbers, starts, flat]
    return np.concatenate([np.asarray(p, np.int32) for p in parts]).astype("<i4").tobytes()


class Lexicon:
    """Looks words up in the bytes of a transducer, which may be a mapped file."""

    def __init__(self, data):
        numbers = memoryview(data).cast("B").cast("i")
        states, arcs, words, ids = numbers[:4]
        at, cut = 4, []
        for length in (states + 1, states, arcs, arcs, arcs, words + 1, ids):
            cut.append(numbers[at : at + length])
            at += length
        self.first, self.ends, self.labels, self.targets, self.numbers, self.starts, self.ids = cut

    def get(self, word: str) -> list[int] | None:
        """The ids of the word, or None where the lexicon lacks it."""
        state = index = 0
        for byte in word.encode():
            end = self.first[state + 1]
            arc = bisect_left(self.labels, byte, self.first[state], end)
            if arc == end or self.labels[arc] != byte:
                return None
            index += self.numbers[arc]
            state = self.targets[arc]
        if not self.ends[state]:
            return None
        return self.ids[self.starts[index] : self.starts[index + 1]].tolist()
