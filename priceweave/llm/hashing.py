"""Hashes of many pieces of one sequence at a time, in numpy.

Rolling gives any substring's hash from prefix sums. It is a polynomial modulo 2^64, for which unequal strings of equal
hash can be written down, so it only proposes: what it brings together is compared by another means. span_hashes tells
pieces apart. Each eight bytes are mixed with a number of their place that follows from a key, and the sums are mixed
again. The key is drawn anew for each run of an operator (draw), on the driver, and travels to the tasks in what they run:
which pieces collide depends on it, so no texts can be made beforehand that do. Two keys give 128 independent bits.
"""

from __future__ import annotations

import secrets

import numpy as np

# fixed values: an odd multiplier, its inverse modulo 2^64 follows; splitmix64's constants
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finish."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


#: Powers that a worker keeps.
KEPT = 1 << 21


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; up to KEPT kept by the worker, grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = n if n > KEPT else 1 << max(16, (n - 1).bit_length())
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if n <= KEPT:
            _powers[base] = have
    return have[:n]


class Rolling:
    """Hashes of substrings of one sequence of small integers."""

    def __init__(self, symbols: np.ndarray):
        table = mix(np.arange(int(symbols.max(initial=0)) + 1, dtype=np.uint64) + np.uint64(0x1234567)) if len(symbols) < 1 or symbols.max() < 1 << 20 else None
        values = table[symbols] if table is not None else mix(symbols.astype(np.uint64) + np.uint64(0x1234567))
        n = len(symbols)
        values = values * powers(BASE, n)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=self.prefix[1:])
        self.inverse = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def windows(self, k: int) -> np.ndarray:
        """The hash of each k symbols in a row."""
        return (self.prefix[k:] - self.prefix[:-k]) * self.inverse[: len(self.prefix) - k]


def _eights(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first eight of each span, the eights, their number in the span): bytes behind a span's end count as zeros."""
    n = np.maximum(-(-(end - start) // 8), 1)
    first = np.cumsum(n) - n
    number = np.arange(n.sum()) - np.repeat(first, n)
    at = np.repeat(start, n) + 8 * number
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))[np.minimum(at, len(raw))]
    left = np.repeat(end, n) - at
    short = left < 8
    eights[short] &= (np.uint64(1) << (np.uint64(8) * np.maximum(left[short], 0).astype(np.uint64))) - np.uint64(1)
    return first, eights, number


def draw() -> int:
    """A new key for span_hashes."""
    return secrets.randbits(63)


_places: dict[int, np.ndarray] = {}


def _of_places(key: int, n: int) -> np.ndarray:
    """Numbers of the first n places under a key; those of the last few keys are kept by the worker."""
    have = _places.get(key)
    if have is None or len(have) < n:
        size = n if n > KEPT else 1 << max(10, (n - 1).bit_length())
        have = mix(mix(np.arange(size, dtype=np.uint64) * np.uint64(BASE) + np.uint64(key)) ^ np.uint64(key * 0xD6E8FEB86659FD93 % (1 << 64)))
        if n <= KEPT:
            while len(_places) >= 4:
                _places.pop(next(iter(_places)))
            _places[key] = have
    return have


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0, streams: int = 1, first_stream: int = 0) -> list[np.ndarray]:
    """64-bit hashes of each span of these bytes; those of different streams are independent."""
    if not len(start):
        return [np.zeros(0, np.uint64) for _ in range(first_stream, first_stream + streams)]
    first, eights, number = _eights(raw, start, end)
    most = int(number.max()) + 2
    sizes = (end - start).astype(np.uint64)
    out = []
    for stream in range(first_stream, first_stream + streams):
        places = _of_places((key + stream * 0x9FB21C651E98DF25) % (1 << 63), most)
        # place 0 is the length's
        out.append(mix(np.add.reduceat(mix(eights + places[number + 1]), first) + mix(sizes + places[0])))
    return out
