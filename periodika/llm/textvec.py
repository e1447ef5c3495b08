"""Words, lines and shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is known by a 64-bit hash of two polynomial sums of random values of its bytes, modulo 2^64 and modulo the prime 2^31 - 1, and of its
length; both come from prefix sums over the whole piece. Strings that collide by their structure modulo a power of two don't modulo a
prime. No word becomes a Python object.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_PRIME, _ROOT = (1 << 31) - 1, 1_220_703_125
#: Powers are kept for one block of bytes; those beyond are a product with the block's own, so what a worker keeps doesn't grow with texts.
BLOCK_BITS = 15
BLOCK = 1 << BLOCK_BITS

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a word in the sense of white space: blank and \x09-\x0D.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: Bytes of words made of digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _folded(x: np.ndarray) -> np.ndarray:
    """Values below 2^63 modulo the prime, up to one prime too much."""
    x = (x & U(_PRIME)) + (x >> U(31))
    return (x & U(_PRIME)) + (x >> U(31))


def _steps(base: int, modulus: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1)."""
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * base % modulus)
    return np.array(out, U)


def _far(base: int, modulus: int, n: int) -> np.ndarray:
    """Powers of the base by whole blocks: of 0, BLOCK, 2 BLOCK and so on below n."""
    return _steps(pow(base, BLOCK, modulus), modulus, (n >> BLOCK_BITS) + 1)


_INVERSE, _PRIME_INVERSE = pow(_BASE, -1, 1 << 64), pow(_ROOT, -1, _PRIME)
_UP, _DOWN = _steps(_BASE, 1 << 64, BLOCK), _steps(_INVERSE, 1 << 64, BLOCK)
_PRIME_UP, _PRIME_DOWN = _steps(_ROOT, _PRIME, BLOCK), _steps(_PRIME_INVERSE, _PRIME, BLOCK)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the n + 1 offsets; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which ``span_hash`` takes the hash of any run of bytes."""
    one, two = np.zeros(len(data) + 1, U), np.zeros(len(data) + 1, U)
    far, prime_far = _far(_BASE, 1 << 64, len(data)), _far(_ROOT, _PRIME, len(data))
    for i, begin in enumerate(range(0, len(data), BLOCK)):
        values = _BYTE[data[begin : begin + BLOCK]]
        n = len(values)
        own, prime_own = one[begin + 1 : begin + n + 1], two[begin + 1 : begin + n + 1]
        np.cumsum(values * _UP[:n], out=own)
        own *= far[i]
        own += one[begin]
        np.cumsum(_folded((values >> U(34)) * _folded(_PRIME_UP[:n] * prime_far[i])), out=prime_own)
        prime_own += two[begin]
    return one, two


def span_hash(sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    one, two = sums
    block, place = starts >> BLOCK_BITS, starts & (BLOCK - 1)
    down = _DOWN[place] * _far(_INVERSE, 1 << 64, len(one))[block]
    prime_down = _folded(_PRIME_DOWN[place] * _far(_PRIME_INVERSE, _PRIME, len(one))[block])
    first = (one[ends] - one[starts]) * down + (ends - starts).astype(U) * U(_BASE)
    second = _folded(_folded(two[ends] - two[starts]) * prime_down)
    second[second >= U(_PRIME)] -= U(_PRIME)
    return mix(first ^ mix(second + U(0x632BE59BD9B4E019)))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes that lie within one text."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    full = offsets[1:] > offsets[:-1]
    begin, end = offsets[:-1][full], offsets[1:][full] - 1
    first[begin], last[end] = mask[begin], mask[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """starts, ends: of each word, in bytes; hash: of each word; at: n + 1 indices, where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, mask: np.ndarray, sums: tuple[np.ndarray, np.ndarray] | None = None):
        self.starts, self.ends = runs(mask, offsets)
        self.hash = span_hash(prefix(data) if sums is None else sums, self.starts, self.ends)
        self.at = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.at)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of ``k`` words within one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        h = np.full(n, k, U)
        for j in range(k):
            h += self.hash[j : j + n] * _PLACE[j]
        inside = np.arange(n) + k <= np.repeat(self.at[1:], self.counts)[:n]
        return np.flatnonzero(inside), mix(h[inside])

    def whole(self, doc: np.ndarray, k: int) -> np.ndarray:
        """Hash of the first ``k`` words of each of the texts ``doc``: of the whole text if it has as many."""
        h = np.full(len(doc), k, U)
        for j in range(k):
            h += self.hash[self.at[doc] + j] * _PLACE[j]
        return mix(h)


def sums_by_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i + 1]] (numbers or truth values) for each i."""
    out, full = np.zeros(len(at) - 1, np.int64), at[1:] > at[:-1]
    if full.any():
        out[full] = np.add.reduceat(values[: at[-1]], at[:-1][full], dtype=np.int64)
    return out
