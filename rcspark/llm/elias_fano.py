"""Elias-Fano sequences and a two-level n-gram trie on memory-mapped arrays, with vectorised queries."""

from __future__ import annotations

from pathlib import Path

import numpy as np

_CHUNK = 1 << 17
#: Of each byte: how many bits are set, and the place of each of them.
_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8))
_PLACE = np.array([[*[i for i in range(8) if b >> i & 1], *[0] * 8][:8] for b in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of n numbers below 2**62: the low bits of each packed side by side, the high bits in
    unary, and the number of ones before each 64-bit word of the unary part."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        low_bits = min(low_bits, 56)
        low = [np.zeros(0, np.uint8)]
        for k in range(0, n if low_bits else 0, _CHUNK):  # a chunk's bits fill whole bytes
            bits = np.unpackbits(np.ascontiguousarray(values[k : k + _CHUNK]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low_bits]
            low.append(np.packbits(bits.ravel(), bitorder="little"))
        low = np.append(np.concatenate(low), np.zeros(8, np.uint8))
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = ((int(at[-1]) if n else 0) + 2 + 63) // 64 * 64
        high = np.zeros(size, np.uint8)
        high[at] = 1
        words = np.packbits(high, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return cls(n, low_bits, low, words, ones)

    def save(self, path: Path) -> None:
        np.save(f"{path}.low.npy", self.low)
        np.save(f"{path}.high.npy", self.high)
        np.save(f"{path}.ones.npy", self.ones)
        np.save(f"{path}.head.npy", np.array([self.n, self.low_bits]))

    @classmethod
    def load(cls, path: Path) -> "EliasFano":
        n, low_bits = np.load(f"{path}.head.npy").tolist()
        return cls(n, low_bits, *[np.load(f"{path}.{x}.npy", mmap_mode="r") for x in ("low", "high", "ones")])

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.ones.nbytes

    def _in_word(self, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the set bit number ``rank`` of each word."""
        out = np.empty(len(words), np.int64)
        for at in range(0, len(words), _CHUNK):
            parts = np.ascontiguousarray(words[at : at + _CHUNK]).view(np.uint8).reshape(-1, 8)
            want = rank[at : at + _CHUNK]
            upto = np.cumsum(_ONES[parts], 1, dtype=np.uint8)
            byte = np.minimum((upto <= want[:, None]).sum(1), 7)
            row = np.arange(len(parts))
            before = np.where(byte > 0, upto[row, byte - 1], 0)
            out[at : at + _CHUNK] = 8 * byte + _PLACE[parts[row, byte], np.clip(want - before, 0, 7)]
        return out

    def _select(self, rank: np.ndarray, zeros: bool) -> np.ndarray:
        """Position of the zero or one number ``rank`` of the unary part."""
        before = 64 * np.arange(len(self.ones)) - self.ones if zeros else self.ones
        k = np.searchsorted(before, rank, "right") - 1
        k = np.minimum(k, len(self.high) - 1)
        words = np.asarray(self.high)[k]
        return 64 * k + self._in_word(~words if zeros else words, rank - before[k])

    def _lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low_bits
        window = np.asarray(self.low)[(bit >> 3)[:, None] + np.arange(8)]
        return (np.ascontiguousarray(window).view("<u8")[:, 0] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = (self._select(i, zeros=False) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._lows(i)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """Index of the first number with a high part of ``h`` or more."""
        n_zeros = 64 * len(self.high) - int(self.ones[-1])
        inside = np.clip(h - 1, 0, n_zeros - 1)
        start = np.where(h > 0, self._select(inside, zeros=True) + 1 - h, 0)
        return np.where(h > n_zeros, self.n, np.minimum(start, self.n))

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first number >= x, whether it equals x)."""
        x = np.asarray(x, np.uint64)
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        low = x & np.uint64((1 << self.low_bits) - 1)
        i, end = self._bucket(h), self._bucket(h + 1)
        to = end.copy()
        open_ = np.flatnonzero(i < to)
        while len(open_):  # binary search among the numbers with these high bits: there may be many
            mid = (i[open_] + to[open_]) >> 1
            below = self._lows(mid) < low[open_]
            i[open_[below]] = mid[below] + 1
            to[open_[~below]] = mid[~below]
            open_ = open_[i[open_] < to[open_]]
        equal = np.zeros(len(x), bool)
        inside = np.flatnonzero(i < end)
        equal[inside] = self._lows(i[inside]) == low[inside]
        return i, equal


def quantise(values: np.ndarray, bits: int = 8) -> tuple[np.ndarray, float, float]:
    """Codes, lowest value and step: value is about lowest + step * code."""
    if not len(values):
        return np.zeros(0, np.uint8), 0.0, 1.0
    low, high = float(values.min()), float(values.max())
    step = (high - low) / ((1 << bits) - 1) or 1.0
    return np.rint((values - low) / step).astype(np.uint8 if bits <= 8 else np.uint16), low, step


class Trie:
    """Contexts, and below each its successors with quantised log-probabilities.

    Level 1: the contexts' ids, sorted; their quantised back-off weights; pointers to their first successors. Level 2:
    each successor by its place among the trie's words (context-relative: made monotone by the context's place). All
    sequences are Elias-Fano coded.
    """

    LEVELS = ("contexts", "words", "pointers", "successors")

    def __init__(self, levels: dict[str, EliasFano], codes: np.ndarray, backoffs: np.ndarray, scale: np.ndarray):
        self.levels, self.codes, self.backoffs, self.scale = levels, codes, backoffs, scale

    @classmethod
    def build(cls, contexts, words, context_at, word_at, log_probs, log_backoffs) -> "Trie":
        """contexts, words: sorted ids; context_at, word_at: places of each bigram, sorted by both."""
        starts = np.searchsorted(context_at, np.arange(len(contexts) + 1))
        width = max(len(words), 1)
        levels = {
            "contexts": EliasFano.build(contexts), "words": EliasFano.build(words), "pointers": EliasFano.build(starts),
            "successors": EliasFano.build(np.asarray(context_at, np.uint64) * np.uint64(width) + np.asarray(word_at, np.uint64)),
        }
        codes, low, step = quantise(log_probs)
        backoffs, b_low, b_step = quantise(log_backoffs)
        return cls(levels, codes, backoffs, np.array([low, step, b_low, b_step]))

    def save(self, folder: Path) -> None:
        for k, level in self.levels.items():
            level.save(folder / k)
        for k in ("codes", "backoffs", "scale"):
            np.save(folder / f"{k}.npy", getattr(self, k))

    @classmethod
    def load(cls, folder: Path) -> "Trie":
        return cls({k: EliasFano.load(folder / k) for k in cls.LEVELS}, *[np.load(folder / f"{k}.npy", mmap_mode="r") for k in ("codes", "backoffs", "scale")])

    def nbytes(self) -> int:
        return sum(x.nbytes() for x in self.levels.values()) + self.codes.nbytes + self.backoffs.nbytes

    def score(self, context: np.ndarray, word: np.ndarray, log_p1: np.ndarray) -> np.ndarray:
        """log10 probability of each word after its context; log_p1: the words' own, to back off to."""
        contexts, c_at = np.unique(context, return_inverse=True)
        words, first, w_at = np.unique(word, return_index=True, return_inverse=True)
        return self.score_places(contexts, words, c_at, w_at, np.asarray(log_p1)[first])

    def score_places(self, contexts: np.ndarray, words: np.ndarray, c_at: np.ndarray, w_at: np.ndarray, log_p1: np.ndarray) -> np.ndarray:
        """As ``score``, of pairs given by their places among distinct contexts and words (with their log_p1)."""
        low, step, b_low, b_step = np.asarray(self.scale)
        c, has = self.levels["contexts"].successor(contexts)
        w, known = self.levels["words"].successor(words)
        backoff = np.zeros(len(contexts))
        backoff[has] = b_low + b_step * np.asarray(self.backoffs)[c[has]]
        out = backoff[c_at] + log_p1[w_at]
        ends = np.zeros(len(contexts), np.int64)
        ends[has] = self.levels["pointers"].get(c[has] + 1)
        both = np.flatnonzero(has[c_at] & known[w_at])
        if len(both):
            cb, wb = c_at[both], w_at[both]
            at, hit = self.levels["successors"].successor(c[cb].astype(np.uint64) * np.uint64(max(self.levels["words"].n, 1)) + w[wb].astype(np.uint64))
            hit &= at < ends[cb]
            out[both[hit]] = low + step * np.asarray(self.codes)[at[hit]]
        return out
