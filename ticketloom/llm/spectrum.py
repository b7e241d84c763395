"""Leading eigenpairs of a symmetric matrix by spectrum slicing: the small dense part of operator 11.

An LDL^T factorisation of A - s*I has as many positive eigenvalues in D as A has eigenvalues above s
(Sylvester's law of inertia). Bisection by these counts isolates each leading eigenvalue in an interval of its
own; Rayleigh quotient iteration, held in that interval, then converges cubically; and two further counts on
either side of the result certify its number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Pivots are 1x1 or 2x2; this threshold bounds the growth of the elements (Bunch and Kaufman).
_PIVOT = (1 + np.sqrt(17.0)) / 8


@dataclass
class Factors:
    """P A P^T = L D L^T with unit lower triangular L and blocks of order one or two in D."""

    order: np.ndarray
    lower: np.ndarray
    blocks: list[tuple[int, np.ndarray]]

    def positive(self) -> int:
        """The number of positive eigenvalues."""
        found = 0
        for _, block in self.blocks:
            if block.shape == (1, 1):
                found += int(block[0, 0] > 0)
            else:
                # A block of order two is taken only where its determinant is negative: one of either sign.
                found += 1
        return found

    def solve(self, b: np.ndarray) -> np.ndarray:
        """x with A x = b; a zero pivot counts as a tiny one."""
        n, low = len(b), self.lower
        x = b[self.order].copy()
        for j in range(n):
            x[j + 1 :] -= low[j + 1 :, j] * x[j]
        tiny = np.finfo(low.dtype).eps * max((abs(d).max() for _, d in self.blocks), default=1) or 1
        for k, d in self.blocks:
            if d.shape == (1, 1):
                x[k] /= d[0, 0] if d[0, 0] else tiny
            else:
                det = d[0, 0] * d[1, 1] - d[0, 1] * d[1, 0]
                one, two = x[k], x[k + 1]
                x[k], x[k + 1] = (d[1, 1] * one - d[0, 1] * two) / det, (d[0, 0] * two - d[1, 0] * one) / det
        for j in range(n - 1, -1, -1):
            x[j] -= low[j + 1 :, j] @ x[j + 1 :]
        out = np.empty_like(x)
        out[self.order] = x
        return out


def factors(matrix: np.ndarray) -> Factors:
    """LDL^T of a symmetric matrix with Bunch-Kaufman pivots."""
    a = matrix.copy()
    n = len(a)
    order, lower, blocks = np.arange(n), np.eye(n, dtype=a.dtype), []

    def swap(i: int, j: int, done: int) -> None:
        if i != j:
            a[[i, j]], order[[i, j]] = a[[j, i]], order[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            lower[[i, j], :done] = lower[[j, i], :done]

    k = 0
    while k < n:
        size = 1
        if k < n - 1:
            column = abs(a[k + 1 :, k])
            r = int(column.argmax())
            largest = column[r]
            r += k + 1
            if abs(a[k, k]) < _PIVOT * largest:
                row = abs(a[r, k:]).copy()
                row[r - k] = 0
                others = row.max()
                if abs(a[k, k]) * others < _PIVOT * largest**2:
                    if abs(a[r, r]) >= _PIVOT * others:
                        swap(k, r, k)
                    else:
                        swap(k + 1, r, k)
                        size = 2
        block = a[k : k + size, k : k + size].copy()
        rest = slice(k + size, n)
        if size == 1:
            if block[0, 0]:
                lower[rest, k] = a[rest, k] / block[0, 0]
        else:
            det = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            one, two = a[rest, k], a[rest, k + 1]
            lower[rest, k] = (one * block[1, 1] - two * block[1, 0]) / det
            lower[rest, k + 1] = (two * block[0, 0] - one * block[0, 1]) / det
        left = lower[rest, k : k + size]
        a[rest, rest] -= (left @ block) @ left.T
        blocks.append((k, block))
        k += size
    return Factors(order, lower, blocks)


class Spectrum:
    """The spectrum of one symmetric matrix, asked through counts."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.eye = np.eye(len(matrix), dtype=matrix.dtype)
        self.scale = abs(matrix).sum(axis=1).max(initial=0)
        self.eps = np.finfo(matrix.dtype).eps
        self.counts: dict = {}

    def above(self, shift) -> int:
        """How many eigenvalues are greater than the shift."""
        if shift not in self.counts:
            self.counts[shift] = factors(self.matrix - shift * self.eye).positive()
        return self.counts[shift]

    def _isolate(self, number: int):
        """low < eigenvalue of that number <= high, no other in between, unless it is a multiple one."""
        low, high = -self.scale * 2 - 1, self.scale * 2 + 1
        for shift, count in self.counts.items():
            if count >= number:
                low = max(low, shift)
            else:
                high = min(high, shift)
        while high - low > 8 * self.eps * self.scale:
            if self.above(low) == number and self.above(high) == number - 1:
                break
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= number else (low, middle)
        return low, high

    def pair(self, number: int, before: list[np.ndarray]):
        """The eigenvalue of that number, counted from 1 by falling value, and its unit vector."""
        n = len(self.matrix)
        low, high = self._isolate(number)
        start = 1 + np.arange(n, dtype=self.matrix.dtype) / n + (np.arange(n) % (number + 1) == 0)

        def unit(y):
            # Vectors found before are orthogonal; in the space of a multiple eigenvalue that has to be asked for.
            for _ in range(2):
                for v in before:
                    y = y - (v @ y) * v
            size = np.sqrt(y @ y)
            return y / size if size > 0 else None

        for _ in range(200):
            value = (low + high) / 2
            y = unit(start)
            for step in range(12):
                solved = factors(self.matrix - value * self.eye)
                self.counts[value] = solved.positive()
                y = solved.solve(y)
                y = unit(y / abs(y).max())
                if y is None:
                    break
                product = self.matrix @ y
                quotient = y @ product
                rest = product - quotient * y
                error = np.sqrt(rest @ rest)
                if step == 0:
                    # One step of inverse iteration at the middle leads into the interval.
                    continue
                if error <= 64 * n * self.eps * self.scale:
                    margin = 4 * error + 64 * n * self.eps * self.scale
                    if self.above(quotient - margin) >= number > self.above(quotient + margin):
                        return quotient, y
                    break
                if not low <= quotient <= high:
                    break
                value = quotient
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= number else (low, middle)
            start = y if y is not None else start[::-1] + number
        raise ArithmeticError(f"eigenvalue {number} was not certified")


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, at most `most`, and their unit vectors as rows.

    Eigenvalues that are not above the rounding of a double of the largest one count as zero and end the
    list. A vector's largest entry (the first of equal ones) is positive.
    """
    spectrum = Spectrum(matrix)
    values, vectors = [], []
    while spectrum.scale > 0 and len(values) < min(most, len(matrix)):
        value, vector = spectrum.pair(len(values) + 1, vectors)
        if value <= len(matrix) * np.finfo(np.float64).eps * (values[0] if values else 0):
            break
        vectors.append(vector * (1 if vector[abs(vector).argmax()] > 0 else -1))
        values.append(value)
    kind = matrix.dtype
    return np.array(values, kind), np.array(vectors, kind).reshape(len(vectors), len(matrix))
