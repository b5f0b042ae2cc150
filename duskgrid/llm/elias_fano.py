"""Elias-Fano coded monotone sequences: near the least bits possible, with access and successor search on many values at once.

Each of n values up to u is cut: the lower log2(u / n) bits are packed, the upper ones are a unary bit vector in which the
i-th value with upper part h sets bit h + i. A directory counts the ones before each word. All parts are flat arrays at
known places of one buffer, so a sequence is mapped from bytes, of a file or of a table's cell, without a copy.
"""

from __future__ import annotations

import numpy as np

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the k-th one of a byte.
_PLACE = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


def _words(places: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """n 64-bit words with bits put in at ascending places (words), those of one word together."""
    out = np.zeros(n, np.uint64)
    if len(places):
        first = np.flatnonzero(np.diff(places, prepend=-1))
        out[places[first]] = np.bitwise_or.reduceat(bits, first)
    return out


class EliasFano:
    """A non-decreasing sequence of integers from 0 on."""

    def __init__(self, header: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.header, self.low, self.high, self.ones = header, low, high, ones
        self.n, self.width, self.bits = (int(x) for x in header[:3])

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        width = max(0, (most // n).bit_length() - 1) if n else 0
        at = np.arange(n, dtype=np.int64) * width
        lower = values & np.uint64((1 << width) - 1)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            shift = (at & 63).astype(np.uint64)
            low |= _words(at >> 6, lower << shift, len(low))
            over = np.flatnonzero((at & 63) + width > 64)
            low |= _words((at[over] >> 6) + 1, lower[over] >> (np.uint64(64) - shift[over]), len(low))
        place = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = n + (most >> width) + 1
        high = _words(place >> 6, np.uint64(1) << (place & 63).astype(np.uint64), (bits + 63) // 64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32 if n < 1 << 32 else np.int64)
        return cls(np.array([n, width, bits, ones.itemsize], np.int64), low, high, ones)

    def parts(self) -> list[np.ndarray]:
        return [self.header, self.low, self.high, self.ones]

    @classmethod
    def mapped(cls, buffer, at: int) -> tuple["EliasFano", int]:
        """The sequence whose parts lie in buffer from at on, and where they end."""
        header = np.frombuffer(buffer, np.int64, 4, at)
        n, width, bits, item = (int(x) for x in header)
        out, at = [header], at + 32
        for kind, size in ((np.uint64, n * width // 64 + 2), (np.uint64, (bits + 63) // 64), (np.uint32 if item == 4 else np.int64, (bits + 63) // 64 + 1)):
            out.append(np.frombuffer(buffer, kind, size, at))
            at += -(-out[-1].nbytes // 8) * 8
        return cls(*out), at

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th one, or zero, of the upper bits."""
        if one:
            word = np.searchsorted(self.ones, k, "right") - 1
            left = k - self.ones[word].astype(np.int64)
        else:
            zeros = 64 * np.arange(len(self.ones), dtype=np.int64) - self.ones.astype(np.int64)
            word = np.searchsorted(zeros, k, "right") - 1
            left = k - zeros[word]
        inside = self.high[word] if one else ~self.high[word]
        each = _ONES[inside.astype("<u8").view(np.uint8).reshape(-1, 8)]
        upto = np.cumsum(each, axis=1, dtype=np.uint8)  # 64 at most
        byte = np.minimum((upto <= left[:, None]).sum(axis=1), 7)
        rows = np.arange(len(k))
        left = left - np.where(byte > 0, upto[rows, np.maximum(byte - 1, 0)], 0)
        b = (inside >> (8 * byte).astype(np.uint64)).astype(np.uint8)
        return word * 64 + 8 * byte + _PLACE[b, np.minimum(left, 7)]

    def _lower(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        up = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return (self.low[word] >> shift | up) & np.uint64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i) << self.width) | self._lower(i).astype(np.int64)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value that is at least x (n where there is none), for each x from 0 on."""
        x = np.asarray(x, np.int64)
        out = np.full(len(x), self.n, np.int64)
        h = x >> self.width
        within = np.flatnonzero(h <= self.bits - self.n - 1)
        if not self.n or not len(within):
            return out
        h, low = h[within], (x[within] & ((1 << self.width) - 1)).astype(np.uint64)
        a = np.zeros(len(h), np.int64)
        some = h > 0
        a[some] = self._select(h[some] - 1, False) - (h[some] - 1)
        b = self._select(h, False) - h  # values with this upper part lie from a to b
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) >> 1
            less = self._lower(mid) < low[open_]
            a[open_[less]], b[open_[~less]] = mid[less] + 1, mid[~less]
        out[within] = a
        return out


def packed(parts: list[np.ndarray]) -> bytes:
    """Arrays one after the other, each from a place that 8 divides."""
    return b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)
