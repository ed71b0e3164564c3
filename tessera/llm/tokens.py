"""Words of Arrow string columns as numpy offsets, and 64-bit hashes of words and of word windows.

Words are runs of bytes other than space, tab, newline, vertical tab, form feed and carriage return,
which in UTF-8 is the same as runs of other characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: spreads each bit of a uint64 over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of a column: byte spans in ``data``, and for each row the first of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def positions(self) -> np.ndarray:
        """The place of each word in its row."""
        return np.arange(len(self)) - np.repeat(self.first[:-1], self.counts)

    def list(self, row: int) -> list[bytes]:
        a, b = self.first[row], self.first[row + 1]
        if a == b:
            return []
        return self.data[self.starts[a] : self.ends[b - 1]].tobytes().split()

    def spans(self, firsts: np.ndarray, size: int) -> list[bytes]:
        """The runs of ``size`` words from each of ``firsts``, their words joined by single spaces."""
        if not len(firsts):
            return []
        lengths = self.ends - self.starts
        number = np.repeat(np.arange(len(self)), lengths)
        joined = np.full(int(lengths.sum()) + len(self), 32, np.uint8)
        joined[np.arange(len(number)) + number] = self.data[~_SPACE[self.data]]
        ends = np.cumsum(lengths + 1) - 1
        begins = (ends - lengths)[firsts].tolist()
        text = joined.tobytes()
        return [text[a:b] for a, b in zip(begins, ends[firsts + size - 1].tolist(), strict=True)]

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A hash of each word's bytes."""
        out = np.empty(len(self), np.uint64)
        base, a = _ODD[lane], 0
        inverse = pow(base, -1, 1 << 64)
        widest = int((self.ends - self.starts).max()) if len(self) else 0
        power, back = _powers(base, _CHUNK + widest + 1), _powers(inverse, _CHUNK + widest + 1)
        while a < len(self):
            lo = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.starts, lo + _CHUNK)))
            hi = self.ends[b - 1]
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
            s, e = self.starts[a:b] - lo, self.ends[a:b] - lo
            out[a:b] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            a = b
        return out


def split_words(texts: pa.Array | pa.ChunkedArray) -> Words:
    """Nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    n = len(texts)
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    lo, hi = int(off[0]), int(off[-1])
    data = np.frombuffer(buffers[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    off = off - lo
    word = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    after = np.zeros(len(data), bool)
    if len(data):
        before[1:], after[:-1] = word[:-1], word[1:]
        edges = off[(off > 0) & (off < len(data))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, off))


def window_hashes(hashes: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive values; the caller drops those that cross rows."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _ODD[lane] ^ 0x5851F42D4C957F2C
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(base, len(hashes)), out=sums[1:])
    return mix((sums[size:] - sums[:n]) * _powers(pow(base, -1, 1 << 64), n))
