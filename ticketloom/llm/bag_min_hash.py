"""BagMinHash: signatures of weighted sets whose agreement estimates the weighted Jaccard similarity.

A shingle that occurs w times has the integer weights 1..w as levels. On every unit of weight of every
shingle runs a Poisson process of rate 1 that is a function of the shingle alone; each of its points has
a time and one of m positions. A signature's value at a position is the earliest time of a point there
among the units below the bag's weights. Two bags share a value with probability sum(min) / sum(max).

The processes form a hierarchy: units 0, 1, [2, 4), [4, 8), ... have one process each, of a rate equal to
their length; its first point is drawn at once for all units of the range, falls into either half with
equal chance, and only then is the range split (the half without the point starts afresh from there). So a
weight of a thousand costs about ten draws, not a thousand, when nothing early falls into its range, and
ranges whose first point comes too late to matter are never split at all.

Points count up to a horizon by which a bag of its total weight has filled all m positions almost surely;
bags that are not full by then are drawn again with twice the horizon. So the values never depend on it.
"""

from __future__ import annotations

import numpy as np

POSITIONS = 128

_C1, _C2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_GOLD_TWICE = np.uint64(2 * 0x9E3779B97F4A7C15 % 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def _exponential(key: np.ndarray, draw: np.ndarray | int) -> np.ndarray:
    """Standard exponential numbers, one per key and number of draw."""
    bits = mixed(key + _GOLD * np.asarray(2 * draw + 1, np.uint64))
    return -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def _range_key(element: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mixed(element ^ mixed(low.astype(np.uint64) * _GOLD + size.astype(np.uint64)))


def _points(bag, element, weight, horizon, positions: int, result: np.ndarray) -> None:
    """Lowers `result[bag, position]` to the time of every point up to its bag's horizon."""
    flat = result.reshape(-1)
    low, size = np.zeros(len(bag), np.int64), np.ones(len(bag), np.int64)
    pieces, first = [], 0
    while True:
        reach = weight > first
        if not reach.any():
            break
        length = max(first, 1)
        pieces.append((bag[reach], element[reach], weight[reach], np.full(reach.sum(), first), np.full(reach.sum(), length)))
        first += length
    bag, element, weight, low, size = (np.concatenate(p) for p in zip(*pieces))
    key = _range_key(element, low, size)
    time = _exponential(key, 0) / size
    draw = np.zeros(len(bag), np.int64)
    while len(bag):
        early = time <= horizon[bag]
        bag, element, weight, low, size, key, time, draw = (
            x[early] for x in (bag, element, weight, low, size, key, time, draw)
        )
        unit = size == 1
        # A point of a unit: its position, then the next point of the same unit.
        place = mixed(key[unit] + _GOLD * (2 * draw[unit] + 2).astype(np.uint64)) % np.uint64(positions)
        np.minimum.at(flat, bag[unit] * positions + place.astype(np.int64), time[unit])
        next_draw = draw[unit] + 1
        next_time = time[unit] + _exponential(key[unit], next_draw)
        groups = [
            (bag[unit], element[unit], weight[unit], low[unit], size[unit], key[unit], next_time, next_draw)
        ]
        split = ~unit
        if split.any():
            b, e, w, s, t = bag[split], element[split], weight[split], size[split] // 2, time[split]
            upper = (mixed(key[split] + _GOLD_TWICE) & np.uint64(1)).astype(np.int64)
            for side in (0, 1):
                at = low[split] + side * s
                inside = at < w
                child = _range_key(e, at, s)
                holds = upper == side
                start = np.where(holds, t, t + _exponential(child, 0) / s)
                groups.append(
                    tuple(x[inside] for x in (b, e, w, at, s, child, start, np.zeros(len(b), np.int64)))
                )
        bag, element, weight, low, size, key, time, draw = (np.concatenate(g) for g in zip(*groups))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], positions: int = POSITIONS) -> np.ndarray:
    """A row of `positions` values per bag; a bag is its distinct elements (64-bit) and their weights."""
    result = np.full((len(bags), positions), np.inf)
    todo = np.array([i for i, (e, _) in enumerate(bags) if len(e)], np.int64)
    factor = np.log(positions) + 3
    while len(todo):
        bag = np.repeat(todo, [len(bags[i][0]) for i in todo])
        element = np.concatenate([bags[i][0] for i in todo])
        weight = np.concatenate([bags[i][1] for i in todo]).astype(np.int64)
        horizon = np.zeros(len(bags))
        total = np.array([bags[i][1].sum() for i in todo], np.float64)
        horizon[todo] = positions * factor / total
        result[todo] = np.inf
        _points(bag, element, weight, horizon, positions, result)
        todo = todo[~np.isfinite(result[todo]).all(axis=1)]
        factor *= 2
    return result


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of `rows` consecutive values, the band's number included."""
    values = np.ascontiguousarray(signature).view(np.uint64)
    groups = values.reshape(len(values), -1, rows)
    found = np.broadcast_to(np.arange(groups.shape[1], dtype=np.uint64) * _GOLD, groups.shape[:2]).copy()
    for i in range(rows):
        found = mixed(found * _C1 + groups[:, :, i])
    return found.view(np.int64)
