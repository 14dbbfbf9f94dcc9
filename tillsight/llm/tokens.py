"""Exact ids of whole texts from a ``tokenizers`` file, at the cost of its distinct words.

For a tokenizer whose pre-tokenizer never joins text across white space and
drops it, a text's ids are the ids of its white-space separated words, one
after another. The library encodes each distinct word once per Python worker; a
table of bounded size (``WordTable``) gives the ids of all further ones in whole
batches. A full stop or comma between a letter and white space is a word of its
own, and ASCII letters are folded, if the tokenizer does so itself, which is
probed (texts with the start of a special token's name keep their case).
``tests/llm`` holds the result against the library's on whole texts.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

from tillsight.llm.common import batches_of
from tillsight.llm.wordtable import WordTable, hashes

_LOADED: dict = {}
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[44, 46]] = True
PIECE = 1 << 19


class WordMemo:
    """``most``: words kept at a time (about 60 bytes each)."""

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.table = Tokenizer.from_file(path), WordTable(most)
        self._empty()
        self.final = self._final_pieces()
        self.folds = all(self._ids([a]) == self._ids([b]) for a, b in (("ThE", "the"), ("the,", "the ,"), ("q.", "q .")))

    def _final_pieces(self):
        """Which ids end a word, by the file's end-of-word suffix; None if it has none."""
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        out[[i for piece, i in vocabulary.items() if suffix and piece.endswith(suffix)]] = True
        return out if suffix else None

    def _empty(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(self.table.most, np.int64), np.zeros(self.table.most, np.int32)

    def _ids(self, words: list) -> list:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list, first: int) -> None:
        words = [w.decode() for w in words]
        size, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = self.used
        # A word of letters alone ends with its only end-of-word piece, so many of them can be one text.
        letters = [i for i, w in enumerate(words) if self.final is not None and w.isalpha()]
        chunks = [letters[i:i + 256] for i in range(0, len(letters), 256)]
        found, flat, rest = self._ids([" ".join([words[i] for i in c]) for c in chunks]), [], []
        for c, ids in zip(chunks, found):
            ids = np.array(ids, np.uint32)
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(c) and ends[-1] == len(ids):
                size[c] = np.diff(ends, prepend=0)
                start[c] = at + ends - size[c]
                flat.append(ids)
                at += len(ids)
            else:
                rest += c
        alone = set(letters)
        rest += [i for i in range(len(words)) if i not in alone]
        if rest:
            ids = self._ids([words[i] for i in rest])
            size[rest] = np.fromiter(map(len, ids), np.int64, len(ids))
            start[rest] = at + np.cumsum(size[rest]) - size[rest]
            one = array("I")
            for x in ids:
                one.extend(x)
            flat.append(np.frombuffer(one, np.uint32))
        flat = np.concatenate(flat)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.size[first:first + len(words)], self.start[first:first + len(words)] = size, start

    def _piece(self, data: bytes):
        """ids of the words in some bytes, and per word where it starts and its number of ids."""
        a = np.frombuffer(data, np.uint8)
        edge = np.flatnonzero(np.diff(_SPACE[a], prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        if self.folds:
            cut = np.flatnonzero((end - start > 1) & _MARK[a[end - 1]] & _LETTER[a[end - 2]])
            start, end = np.insert(start, cut + 1, end[cut] - 1), np.insert(end, cut, end[cut] - 1)

        def learn(new):
            if new is None:
                self._empty()
            else:
                self._learn([data[i:j] for i, j in zip(start[new].tolist(), end[new].tolist())], self.table.n - len(new))

        number = self.table.numbers(*hashes(a, start, end), learn)
        size, at = self.size[number].astype(np.int64), self.start[number]
        ends = np.cumsum(size)
        places = np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[places], start, size

    def encode(self, texts: list) -> list:
        """Ids of each UTF-8 text as little-endian uint32 bytes."""
        out = []
        for a, b in batches_of(texts, PIECE):
            part = [t.lower() if self.folds and b"<|" not in t else t for t in texts[a:b]]
            if b - a == 1 and len(part[0]) > PIECE:
                out.append(b"".join(self._piece(x)[0].tobytes() for x in _cut(part[0])))
                continue
            ids, start, size = self._piece(b" ".join(part))
            offsets = np.cumsum([0] + [len(t) + 1 for t in part])
            ends = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, offsets)].tolist()
            ids = ids.astype("<u4", copy=False).tobytes()
            out += [ids[4 * i:4 * j] for i, j in zip(ends, ends[1:])]
        return out


def _cut(text: bytes):
    """A long text in pieces that end at white space."""
    at = 0
    while at < len(text):
        to = at + PIECE
        cut = max(text.rfind(c, at, to) for c in (b" ", b"\n"))
        if to < len(text) and cut < at:
            cut = min((i for i in (text.find(c, to) for c in (b" ", b"\n")) if i >= 0), default=len(text))
        to = len(text) if to >= len(text) else cut + 1
        yield text[at:to]
        at = to


def memo(path: str) -> WordMemo:
    """The worker's memo for a tokenizer file (kept between tasks)."""
    if path not in _LOADED:
        _LOADED[path] = WordMemo(path)
    return _LOADED[path]
