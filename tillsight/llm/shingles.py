"""Word-shingle kernels on NumPy: whole batches of texts at once."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240607)
_BYTES = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PIECE = 1 << 19


def _powers(base, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES = [_powers(_BASE, PIECE), _powers(_BACK, PIECE)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def _hash_piece(a: np.ndarray):
    """Starts and 64-bit hashes of the words in an array of bytes."""
    if len(a) > len(_TABLES[0]):
        _TABLES[:] = [_powers(_BASE, len(a)), _powers(_BACK, len(a))]
    gap = _SPACE[a]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTES[a] * _TABLES[0][:len(a)], out=sums[1:])
    return start, mixed((sums[end] - sums[start]) * _TABLES[1][start] + (end - start).astype(np.uint64))


def words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (ASCII letters in lower case) of UTF-8 texts, and the
    number of words of each text. Long texts go in pieces cut at white space."""
    data = b"\n".join(texts).lower() + b"\n"
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    hashes, places, at = [], [], 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        if to < len(data):
            cut = max(data.rfind(c, at, to) for c in (b" ", b"\n"))
            if cut < at:
                cut = min(i for i in (data.find(c, to) for c in (b" ", b"\n")) if i >= 0)
            to = cut + 1
        start, h = _hash_piece(np.frombuffer(data, np.uint8, to - at, at))
        hashes.append(h)
        places.append(start + at)
        at = to
    h, place = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hashes, places))
    return h, np.diff(np.searchsorted(place, offsets))


def shingles(texts: list, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word windows of each text (repeats included) and
    how many each has. A shorter text is one shingle, one without words none."""
    h, n = words(texts)
    first = np.cumsum(np.concatenate([[0], n]))[:-1]
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    left = np.repeat(n, count)
    padded, total = np.concatenate([h, np.zeros(size, np.uint64)]), np.zeros(len(at), np.uint64)
    for k in range(size):
        total = total * _BASE + np.where(k < left, padded[at + k] | np.uint64(1), np.uint64(0))
    return mixed(total), count


def minhash(values: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values (32 bits) of each text; texts without shingles get zeros."""
    rng = np.random.default_rng(7)
    mask, factor = rng.integers(0, 1 << 64, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    out, some = np.zeros((len(counts), n), np.uint32), np.flatnonzero(counts)
    ends = np.cumsum(counts[some])
    i = at = 0
    while i < len(some):  # about 32k shingles at a time, so that they stay in the cache
        j = max(i + 1, int(np.searchsorted(ends, at + (1 << 15))))
        part, heads = values[at:ends[j - 1]], ends[i:j] - counts[some[i:j]] - at
        x = np.empty_like(part)
        for k in range(n):
            np.bitwise_xor(part, mask[k], out=x)
            np.multiply(x, factor[k], out=x)
            out[some[i:j], k] = np.minimum.reduceat(x, heads) >> np.uint64(32)
        i, at = j, int(ends[j - 1])
    return out
