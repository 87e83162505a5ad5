"""Hashed word shingles of whole texts, in numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case (UTF-8
leaves those bytes to ASCII).  A word's hash is a polynomial over random byte values
modulo 2**64, found for all words of a buffer by one running sum; a shingle's mixes
its words' hashes.  Different shingles collide with probability near 2**-64.
"""

from __future__ import annotations

import functools

import numpy as np

WORDS = 5
BUFFER_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(_BASE))


_BYTE, _PLACE, _COUNT = _keys(256, 1000), _keys(WORDS, 2000) | np.uint64(1), _keys(WORDS + 1, 3000)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def _buffer(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    up, down = _powers(1 << (len(raw) - 1).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * up[:len(raw)])])
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    words = mix((sums[ends] - sums[starts]) * down[starts])
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, begins)
    if len(words) >= WORDS:
        full = mix(sum(words[i:len(words) - WORDS + 1 + i] * _PLACE[i] for i in range(WORDS)) + _COUNT[WORDS])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            s = np.sort(full[a:b - WORDS + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix(np.atleast_1d(sum(words[a + i] * _PLACE[i] for i in range(b - a)) + _COUNT[b - a])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None]):
    """Yields each text's sorted distinct shingle hashes (uint64)."""
    held, size = [], 0
    with np.errstate(over="ignore"):
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass")
            if held and size + len(raw) > BUFFER_BYTES:
                yield from _buffer(held)
                held, size = [], 0
            held.append(raw)
            size += len(raw) + 1
        if held:
            yield from _buffer(held)
