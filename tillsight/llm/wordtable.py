"""A memo of words on NumPy: whole batches of words are looked up at once.

A word is known by two independent 64-bit hashes of its bytes (128 bits), found
with running sums over the batch; the table uses open addressing. It holds at
most ``most`` words and is emptied when full, so its memory is fixed.
"""

from __future__ import annotations

import numpy as np

from tillsight.llm.shingles import mixed

_RNG = np.random.default_rng(99)
_KINDS = [(_RNG.integers(0, 1 << 64, 256, np.uint64), int(_RNG.integers(0, 1 << 63)) * 2 + 1) for _ in range(2)]
_POWERS: dict = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 19), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have


def hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> list:
    """Two hashes of each stretch of an array of bytes."""
    out = []
    for table, base in _KINDS:
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(table[a] * _powers(base, len(a))[:len(a)], out=sums[1:])
        back = _powers(pow(base, -1, 1 << 64), len(a))
        out.append(mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)))
    return out


class WordTable:
    """Numbers words in the order in which they come, from 0."""

    def __init__(self, most: int):
        self.most, self.slots = most, 1 << (2 * most).bit_length()
        self.clear()

    def clear(self) -> None:
        self.n, self.at = 0, np.full(self.slots, -1, np.int32)
        self.one, self.two = np.zeros(self.most, np.uint64), np.zeros(self.most, np.uint64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if the table lacks it."""
        out, left = np.full(len(one), -1, np.int32), np.arange(len(one))
        slot = (one & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            number = self.at[slot]
            held = number >= 0
            left, slot, number = left[held], slot[held], number[held]
            same = (self.one[number] == one[left]) & (self.two[number] == two[left])
            out[left[same]] = number[same]
            left, slot = left[~same], (slot[~same] + 1) & (self.slots - 1)
        return out

    def add(self, one: np.ndarray, two: np.ndarray) -> None:
        """Distinct words that the table lacks; there must be room."""
        number = np.arange(self.n, self.n + len(one), dtype=np.int32)
        self.one[number], self.two[number] = one, two
        self.n += len(one)
        slot = (one & np.uint64(self.slots - 1)).astype(np.int64)
        while len(number):
            free = np.flatnonzero(self.at[slot] < 0)
            claimed, first = np.unique(slot[free], return_index=True)
            self.at[claimed] = number[free[first]]
            rest = np.ones(len(number), bool)
            rest[free[first]] = False
            number, slot = number[rest], (slot[rest] + 1) & (self.slots - 1)

    def numbers(self, one: np.ndarray, two: np.ndarray, learn) -> np.ndarray:
        """The number of each word; ``learn`` is called with the places of the
        first of each new word, after the table has taken them, in their order."""
        found = self.find(one, two)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = missing[_first(one[missing], two[missing])]
            if self.n + len(new) > self.most:
                if self.n == 0:
                    raise ValueError(f"more than {self.most} different words at once")
                learn(None)
                self.clear()
                return self.numbers(one, two, learn)
            self.add(one[new], two[new])
            learn(new)
            found[missing] = self.find(one[missing], two[missing])
        return found


def _first(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Places of the first of each distinct pair."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[new]
