"""Sets of hashed word shingles of whole texts.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D after A-Z
became a-z. A shingle is WIDTH words in a row; a text with fewer words has its
whole sequence as its only shingle, one without words has none. Shingles are
compared by 64-bit hashes: two different shingles of a pair of texts of a
million shingles each collide with a chance below one in ten million.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Bytes hashed at a time; a piece ends at white space.
PIECE = 1 << 20

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(1, 1 << 63, WIDTH, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word: sums of byte values times powers of an odd number, by differences of prefix sums."""
    a = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~_SPACE[a], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * powers(_BASE, len(a)), dtype=np.uint64)))
    own = (sums[end] - sums[start]) * powers(_INVERSE, len(a) + 1)[start]
    return mix(own + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    if len(data) <= 2 * PIECE:
        return _word_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_word_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    w = word_hashes(text) if text else np.zeros(0, np.uint64)
    n = len(w)
    if n == 0:
        return w
    if n < WIDTH:
        return mix((w * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = w[: n - WIDTH + 1] * _PLACE[0]
    for k in range(1, WIDTH):
        total += w[k : n - WIDTH + 1 + k] * _PLACE[k]
    return np.unique(mix(total + np.uint64(WIDTH)))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union."""
    i = common(a, b)
    return bool(i) and 100 * i >= 75 * (len(a) + len(b) - i)
