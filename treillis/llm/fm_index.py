"""A compressed full-text index: the Burrows-Wheeler transform of a text in a wavelet matrix.

Searches run backwards and over many patterns at once, as arrays."""
from __future__ import annotations

import numpy as np

#: Every so many positions of the text one is kept for locating.
SAMPLE = 8
SEPARATOR = 1


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by doubling the length that is sorted."""
    n, k = len(codes), 1
    rank = codes.astype(np.int64)
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = new
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class FmIndex:
    """Index of texts, each between separators; finds the places of patterns in them."""

    def __init__(self, texts: list[str]):
        joined = "\x01" + "\x01".join(texts) + "\x01"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.alphabet = np.unique(points)  # the separator is the smallest
        codes = np.concatenate((np.searchsorted(self.alphabet, points) + 1, [0]))
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate(([1], 1 + np.cumsum(self.lengths + 1)[:-1]))
        self.n = len(codes)
        order = suffix_array(codes)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(self.alphabet) + 1))))
        last = codes[order - 1]
        self.sampled = Bits(order % SAMPLE == 0)
        self.places = order[order % SAMPLE == 0]
        self.levels, self.zeros = [], []
        self.width = max(1, int(len(self.alphabet)).bit_length())
        for level in range(self.width - 1, -1, -1):
            bit = (last >> level) & 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            last = np.concatenate((last[bit == 0], last[bit == 1]))
        self.begin = self._walk(np.arange(len(self.alphabet) + 1), np.zeros(len(self.alphabet) + 1, dtype=np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the texts, each between separators, as one row each, and their lengths; 0 for unknown letters."""
        lengths = np.array([len(t) + 2 for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(f"\x01{t}\x01" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        codes = np.where(self.alphabet[at] == points, at + 1, 0)
        rows = np.zeros((len(texts), int(lengths.max(initial=1))), dtype=np.int64)
        rows[np.arange(rows.shape[1])[None, :] < lengths[:, None]] = codes
        return rows, lengths

    def _walk(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in zip(range(self.width - 1, -1, -1), self.levels, self.zeros):
            ones = bits.ones(i)
            i = np.where((code >> level) & 1, zeros + ones, i - ones)
        return i

    def step(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the patterns with one letter more before them; empty for unknown letters."""
        base = self.first[code] - self.begin[code]
        low, high = base + self._walk(code, low), base + self._walk(code, high)
        return np.where(code > 0, low, 0), np.where(code > 0, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the index."""
        rows, out = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            r = rows[open_]
            hit = self.sampled.get(r) == 1
            out[open_[hit]] = self.places[self.sampled.ones(r[hit])] + steps
            open_, r = open_[~hit], r[~hit]
            i, code = r, np.zeros(len(r), dtype=np.int64)
            for bits, zeros in zip(self.levels, self.zeros):  # the letter before, and its rank
                bit, ones = bits.get(i), bits.ones(i)
                code = code * 2 + bit
                i = np.where(bit == 1, zeros + ones, i - ones)
            rows[open_] = self.first[code] + i - self.begin[code]
            steps += 1
        return out

    def ranges_to_places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of each range: the range's number, the text's number and the place in it (-1: the separator before)."""
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        at = self.locate(np.repeat(low, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
        text = np.maximum(np.searchsorted(self.starts, at + 1, side="right") - 1, 0)
        return which, text, at - self.starts[text]
