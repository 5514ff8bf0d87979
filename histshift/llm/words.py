r"""Words ``[^\x20\x09-\x0D]+`` of UTF-8 texts, hashed with array operations.

No Python loop runs over words: word bounds come from a mask of white space, and each
word's 64-bit hash is a polynomial over its bytes (random value per byte, arithmetic modulo
2**64), taken as the difference of two prefix sums and then mixed. Words over ``LONG`` bytes,
for which such polynomials can be attacked, take xxh3 instead.
"""

from __future__ import annotations

import numpy as np
import xxhash

LONG = 512
CHUNK = 1 << 17
_B = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240607)
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(base & (2**64 - 1)), np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW = _powers(_B, CHUNK + LONG + 1)
_INV = _powers(pow(_B, -1, 1 << 64), CHUNK + LONG + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (multiply and xor-shift)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of two hashes."""
    return mix(a * np.uint64(0x9E3779B185EBCA87) + (b ^ np.uint64(0xC2B2AE3D27D4EB4F)))


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of each word and the index of each text's first word.

    ``offsets`` has one more entry than there are texts; words never cross texts.
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    space = np.ones(n + 2, bool)
    space[1:-1] = _SPACE[data]
    inside = ~space[1:-1]
    starts = np.flatnonzero(inside & (space[:-2] | first[:-1]))
    ends = np.flatnonzero(inside & (space[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word; ``lower``: A-Z count as a-z."""
    values = _LOWER if lower else _VALUES
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        if e[-1] <= CHUNK:
            sums = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(values[data[starts[i]:ends[j - 1]]] * _POW[:int(e[-1])], out=sums[1:])
            out[i:j] = (sums[e] - sums[s]) * _INV[s] + (e - s).astype(np.uint64)
        i = j
    out = mix(out)
    for k in np.flatnonzero(ends - starts > LONG):
        w = data[starts[k]:ends[k]].tobytes()
        out[k] = xxhash.xxh3_64_intdigest(w.lower() if lower else w)
    return out


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive hashes, by doubling: one step per bit of ``n``."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power, length, out, done = h, 1, None, 0
    while True:
        if n & length:
            out = power if out is None else pair(out[:len(power) - done], power[done:]) \
                if len(power) > done else np.zeros(0, np.uint64)
            done += length
        if done == n:
            return out[:len(h) - n + 1]
        power = pair(power[:-length], power[length:])
        length *= 2
