"""Piece lattices of words, and what sums their paths.

A lattice has an edge for each substring of a word that is a piece of a fixed vocabulary. Words of one
length are worked on together: each bounded-length substring is hashed, and an equi-join on the hashes
with the vocabulary, confirmed by the characters, finds the edges. Words of any length have whole lattices;
longer ones than ``TOGETHER`` are worked on one by one, with rescaled sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tessera.llm.tokens import mix

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of up to so many code points are worked on by length, where no product of probabilities underflows.
TOGETHER = 32
_FILTER = np.uint64((1 << 19) - 1)
#: Expected counts are summed as multiples of this, so that sums don't depend on their order.
UNIT = 2.0**-24


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by length: sorted hashes, the pieces' numbers and code points in that order, and a filter of hashes."""

    hashes: dict[int, np.ndarray]
    numbers: dict[int, np.ndarray]
    points: dict[int, np.ndarray]
    seen: np.ndarray
    size: int

    @property
    def widest(self) -> int:
        return max(self.hashes, default=0)

    @staticmethod
    def of(pieces: list[str]) -> Vocabulary:
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p:
                by.setdefault(len(p), []).append(i)
        hashes, numbers, points = {}, {}, {}
        seen = np.zeros(int(_FILTER) + 1, bool)
        for n, own in by.items():
            rows = codes([pieces[i] for i in own], n)
            h = hash_codes(rows)
            order = np.argsort(h)
            hashes[n], numbers[n], points[n] = h[order], np.array(own, np.int64)[order], rows[order]
            seen[h & _FILTER] = True
        return Vocabulary(hashes, numbers, points, seen, len(pieces))

    def find(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the rows of code points, with these hashes, are pieces, and the pieces' numbers."""
        length = rows.shape[1]
        held = self.hashes.get(length)
        if held is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit = np.flatnonzero(self.seen[hashes & _FILTER])
        at = np.minimum(np.searchsorted(held, hashes[hit]), len(held) - 1)
        same = held[at] == hashes[hit]
        hit, at = hit[same], at[same]
        same = (self.points[length][at] == rows[hit]).all(axis=1)
        return hit[same], self.numbers[length][at[same]]


def codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row for each word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)


def hash_codes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        h = h * _BASE + rows[:, j] + np.uint64(1)
    return mix(h)


def edges(vocabulary: Vocabulary, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (start, end, words that have a piece there, its numbers) for all bounded substrings, by end."""
    length = rows.shape[1]
    wide = rows.astype(np.uint64) + np.uint64(1)
    open_at: dict[int, np.ndarray] = {}
    for end in range(1, length + 1):
        open_at[end - 1] = np.zeros(len(rows), np.uint64)
        for start in range(max(0, end - vocabulary.widest), end):
            open_at[start] = open_at[start] * _BASE + wide[:, end - 1]
            yield start, end, *vocabulary.find(mix(open_at[start]), rows[:, start:end])
        open_at.pop(end - vocabulary.widest, None)


def long_edges(vocabulary: Vocabulary, row: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (width, starts, numbers) of one long word's pieces, by width."""
    wide = row.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(row), np.uint64)
    for width in range(1, min(vocabulary.widest, len(row)) + 1):
        n = len(row) - width + 1
        h = h[:n] * _BASE + wide[width - 1 :]
        yield width, *vocabulary.find(mix(h), np.lib.stride_tricks.sliding_window_view(row, width))


def forward(vocabulary: Vocabulary, weights: np.ndarray, floor: np.ndarray, words: list[str], length: int) -> np.ndarray:
    """The logarithm of each word's probability under each model: the sum over all its segmentations.

    ``weights[model, piece]``; ``floor[model]`` is the probability of a code point that is no piece.
    """
    if length > TOGETHER:
        return np.stack([_long_forward(vocabulary, weights, floor, row) for row in codes(words, length)])
    rows = codes(words, length)
    n, models = len(words), weights.shape[0]
    alpha = np.zeros((length + 1, models, n))
    alpha[0] = 1.0
    for start, end, hit, piece in edges(vocabulary, rows):
        if len(hit):
            alpha[end][:, hit] += alpha[start][:, hit] * weights[:, piece]
        if end - start == 1 and len(hit) < n:
            miss = np.ones(n, bool)
            miss[hit] = False
            alpha[end][:, miss] += alpha[start][:, miss] * floor[:, None]
    return np.log(alpha[length].T)


def _lists(vocabulary: Vocabulary, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A long word's edges (end, start, piece or -1 for a code point that is no piece), sorted by end."""
    starts, ends, pieces = [], [], []
    single = np.full(len(row), -1)
    for width, at, number in long_edges(vocabulary, row):
        if width == 1:
            single[at] = number
            continue
        starts.append(at)
        ends.append(at + width)
        pieces.append(number)
    starts.append(np.arange(len(row)))
    ends.append(np.arange(len(row)) + 1)
    pieces.append(single)
    start, end, piece = (np.concatenate(x) for x in (starts, ends, pieces))
    order = np.lexsort((start, end))
    return end[order], start[order], piece[order]


def _long_sums(end: np.ndarray, start: np.ndarray, p: np.ndarray, n: int, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all paths to each place, divided by exp of the second result (a value for each place and model)."""
    edge = np.searchsorted(end, np.arange(1, n + 2))
    sums, scale = np.zeros((n + 1, p.shape[1])), np.zeros((n + 1, p.shape[1]))
    sums[0] = 1.0
    for i in range(1, n + 1):
        a, b = edge[i - 1], edge[i]
        from_ = start[a:b]
        base = scale[i - 1]
        value = (sums[from_] * np.exp(scale[from_] - base) * p[a:b]).sum(axis=0)
        if i % 8 == 0:
            base = base + np.log(value)
            value = np.ones_like(value)
        sums[i], scale[i] = value, base
    return sums, scale


def _long_forward(vocabulary: Vocabulary, weights: np.ndarray, floor: np.ndarray, row: np.ndarray) -> np.ndarray:
    end, start, piece = _lists(vocabulary, row)
    p = np.where((piece >= 0)[:, None], weights[:, np.maximum(piece, 0)].T, floor[None, :])
    sums, scale = _long_sums(end, start, p, len(row), vocabulary.widest)
    return np.log(sums[-1]) + scale[-1]


def expected(vocabulary: Vocabulary, weights: np.ndarray, floor: float, words: list[str], length: int, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, under one model (forward and backward).

    They are integers, in multiples of ``UNIT``, so that sums over words are the same in any order.
    """
    out = np.zeros(vocabulary.size, np.int64)

    def add(piece: np.ndarray, share: np.ndarray, times: np.ndarray | int) -> None:
        np.add.at(out, piece, np.rint(share / UNIT).astype(np.int64) * times)

    if length > TOGETHER:
        for row, times in zip(codes(words, length), counts.tolist(), strict=True):
            end, start, piece = _lists(vocabulary, row)
            p = np.where(piece >= 0, weights[np.maximum(piece, 0)], floor)[:, None]
            n = len(row)
            a, s = _long_sums(end, start, p, n, vocabulary.widest)
            back = np.lexsort((n - end, n - start))
            b, t = _long_sums((n - start)[back], (n - end)[back], p[back], n, vocabulary.widest)
            total = np.log(a[n, 0]) + s[n, 0]
            share = a[start, 0] * b[n - end, 0] * p[:, 0] * np.exp(s[start, 0] + t[n - end, 0] - total)
            add(piece[piece >= 0], share[piece >= 0], times)
        return out
    rows = codes(words, length)
    n = len(words)
    alpha, beta = np.zeros((length + 1, n)), np.zeros((length + 1, n))
    alpha[0], beta[length] = 1.0, 1.0
    held = []
    for start, end, hit, piece in edges(vocabulary, rows):
        p = np.full(n, floor if end - start == 1 else 0.0)
        p[hit] = weights[piece]
        held.append((start, end, hit, piece, p))
        alpha[end] += alpha[start] * p
    for start, end, _, _, p in sorted(held, key=lambda e: -e[0]):
        beta[start] += p * beta[end]
    for start, end, hit, piece, p in held:
        if len(hit):
            add(piece, (alpha[start] * p * beta[end] / alpha[length])[hit], counts[hit])
    return out
