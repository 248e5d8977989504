"""Elias-Fano sequences over arrays that may be memory-mapped, with vectorised access.

A rising sequence of n numbers below a universe u keeps the lower log2(u / n)
bits of each number as they are and the upper bits in unary, about two bits a
number. Reads work on arrays of positions at once.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
# SELECT[byte, k]: place of the k-th one in a byte
SELECT = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _ones = [i for i in range(8) if _byte >> i & 1]
    SELECT[_byte, : len(_ones)] = _ones


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of unsigned 64-bit numbers below ``universe``."""
    values = np.asarray(values, U64)
    n = len(values)
    width = max(0, (universe // max(1, n)).bit_length() - 1)
    low = values & U64((1 << width) - 1)
    words = np.zeros((n * width + 63) // 64 + 1, U64)
    if width and n:
        at = np.arange(n, dtype=U64) * U64(width)
        word, off = (at >> U64(6)).astype(np.int64), at & U64(63)
        np.bitwise_or.at(words, word, low << off)
        over = off + U64(width) > U64(64)
        np.bitwise_or.at(words, word[over] + 1, low[over] >> (U64(64) - off[over]))
    high = (values >> U64(width)).astype(np.int64)
    size = (int(high[-1]) if n else 0) + n + 1
    bits = np.zeros((size + 63) // 64 * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    upper = np.packbits(bits, bitorder="little").view(U64)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)])
    zeros = np.arange(len(ones)) * 64 - ones
    return {"low": words, "upper": upper, "ones": ones, "zeros": zeros, "shape": np.array([n, width], np.int64)}


class Sequence:
    """Reads what :func:`encode` gives."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.upper, self.ones, self.zeros = (arrays[k] for k in ("low", "upper", "ones", "zeros"))
        self.n, self.width = (int(x) for x in arrays["shape"])
        self.mask = U64((1 << self.width) - 1)

    def __len__(self) -> int:
        return self.n

    def _in_word(self, words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one in each 64-bit word."""
        parts = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
        before = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.int64)
        byte = (before <= k[:, None]).sum(1)
        rows = np.arange(len(words))
        k = k - np.where(byte > 0, before[rows, np.maximum(byte - 1, 0)], 0)
        return byte * 8 + SELECT[parts[rows, byte], k]

    def select_one(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, k, "right") - 1
        return word * 64 + self._in_word(self.upper[word], k - self.ones[word])

    def below(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have upper bits below ``high``: ones before the high-th zero."""
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        zeros = high[some] - 1
        inside = zeros < int(self.zeros[-1])
        out[some[~inside]] = self.n
        some, zeros = some[inside], zeros[inside]
        low = np.searchsorted(self.zeros, zeros, "right") - 1
        place = self._in_word(~self.upper[low], zeros - self.zeros[low]) + low * 64
        out[some] = np.minimum(place - zeros, self.n)
        return out

    def lower(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        at = i.astype(U64) * U64(self.width)
        word, off = (at >> U64(6)).astype(np.int64), at & U64(63)
        first = self.low[word] >> off
        # shifted twice, since a shift by 64 is not defined
        second = (self.low[word + 1] << U64(1)) << (U64(63) - off)
        return (first | second) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self.select_one(i) - i).astype(U64) << U64(self.width)) | self.lower(i)

    def find(self, targets: np.ndarray, first: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """The place of each target, or -1: its successor inside ``[first, after)``, if that is the target itself."""
        targets = np.asarray(targets, U64)
        if not self.n or not len(targets):
            return np.full(len(targets), -1)
        high = (targets >> U64(self.width)).astype(np.int64)
        low, top = self.below(high), self.below(high + 1)
        end = top.copy() if after is None else np.minimum(top, after)
        low = low if first is None else np.maximum(low, first)
        top, want = np.maximum(end, low), targets & self.mask
        end = top.copy()
        active = np.flatnonzero(low < top)
        while active.size:
            middle = (low[active] + top[active]) // 2
            less = self.lower(middle) < want[active]
            low[active[less]] = middle[less] + 1
            top[active[~less]] = middle[~less]
            active = active[low[active] < top[active]]
        hit = low < end
        hit[hit] = self.lower(low[hit]) == want[hit]
        return np.where(hit, low, -1)
