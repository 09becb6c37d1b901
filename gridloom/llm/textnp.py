"""Words and shingles of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import large_text

U = np.uint64
_BASE, _INV = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INV)):
                steps = np.full(n, base, U)
                steps[0] = 1
                _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def splits(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


#: A random number for each byte; A-Z share those of a-z where words are lower-cased.
BYTES = splits(256, 11)
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Texts:
    """The bytes of a text column; offsets[i]:offsets[i+1] is document i."""

    def __init__(self, column: pa.Array):
        a = large_text(column)
        self.offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1].copy() if len(a) else np.zeros(1, np.int64)
        first, last = int(self.offsets[0]), int(self.offsets[-1])
        data = a.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
        self.offsets -= first
        self.n = len(a)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes that are inside, cut between documents."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        at = self.offsets[:-1][self.offsets[:-1] < n]
        first[at] = inside[at]
        at = self.offsets[1:][self.offsets[1:] > 0] - 1
        last[at] = inside[at]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~SPACE[self.data])

    def counts(self, starts: np.ndarray) -> np.ndarray:
        """How many of the sorted starts each document has, as positions in starts: n + 1 numbers."""
        return np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
        """64-bit hashes of byte ranges by a prefix sum, without a loop over words."""
        n = len(self.data)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum(table[self.data] * up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def in_parts(texts: list[str], limit: int = 1 << 20):
    """(first position, Texts) of slices of a list with about ``limit`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, Texts(pa.array(texts[start:i], pa.string()))
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, Texts(pa.array(texts[start:], pa.string()))


def shingles(texts: Texts, size: int, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each document: (hash, document), sorted by both, and the count of each document.

    A document with fewer words than ``size`` has its whole sequence of words as the only shingle, one without words none.
    """
    starts, ends = texts.words()
    h = texts.hashes(starts, ends, table)
    at = texts.counts(starts)
    n_words = np.diff(at)
    doc_of = np.repeat(np.arange(texts.n), n_words)
    if len(h) >= size:
        joined = np.zeros(len(h) - size + 1, U)
        for k in range(size):
            joined = joined * U(0xC2B2AE3D27D4EB4F) + h[k : len(h) - size + 1 + k]
        whole = doc_of[: len(joined)] == doc_of[size - 1 :]
        got, docs = mix(joined[whole]), doc_of[: len(joined)][whole]
    else:
        got, docs = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        # a sequence of k words is hashed apart from those of any other length
        seq = np.zeros(len(short), U)
        left = n_words[short]
        for k in range(size - 1):
            has = left > k
            seq[has] = seq[has] * U(0xC2B2AE3D27D4EB4F) + h[at[short[has]] + k]
        got = np.concatenate([got, mix(seq + left.astype(U) * U(0x2545F4914F6CDD1D))])
        docs = np.concatenate([docs, short])
    order = np.lexsort((got, docs))
    got, docs = got[order], docs[order]
    fresh = np.ones(len(got), bool)
    fresh[1:] = (got[1:] != got[:-1]) | (docs[1:] != docs[:-1])
    got, docs = got[fresh], docs[fresh]
    return got, docs, np.bincount(docs, minlength=texts.n)


def set_codes(got: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """One signed 64-bit number for the whole shingle set of each document; 0 for the empty set."""
    out = np.zeros(n, U)
    if len(got):
        first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        out[docs[first]] = np.add.reduceat(mix(got ^ U(0xA0761D6478BD642F)), first)
    return out.view(np.int64)
