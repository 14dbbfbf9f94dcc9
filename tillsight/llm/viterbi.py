"""Token counts of a unigram tokenizer, without making tokens.

A unigram vocabulary (pieces with scores) segments a text so that the sum of
scores is largest. An Aho-Corasick automaton enumerates the pieces that end at each
place; the dynamic programme carries, for each place, the best score of a
segmentation up to it and its number of tokens.

Tie rules of the tokenizer: a path replaces another only if its score is
strictly higher, and places are tried from left to right, so among equal scores
the longest last piece wins. A character without a piece of its own may be
unknown, at 10 below the lowest score; it counts as its UTF-8 bytes where the
vocabulary has byte pieces, else a run of unknown characters counts as one.
A text gets one space in front, and spaces become U+2581.

As no piece goes on with a space after another character, and a line feed is in
no piece, every best segmentation has a cut before each run of spaces and around
each line feed (``Counter`` refuses other vocabularies); so a text's count is the sum of its words' counts, which are
kept in a table of bounded size (``WordTable``). Scores are summed exactly (doubles; the
vocabulary's scores are whole numbers or short fractions).

Defined cases: a null or empty text has 0 tokens; repeated rows are rows of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import batches_of, ship, text_bytes, text_of
from tillsight.llm.wordtable import WordTable, hashes

SPACE = "▁"
_LOADED: dict = {}


def vocabulary(path: str) -> tuple[dict, bool]:
    """Pieces and scores of a sentencepiece file, and whether it has byte pieces."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): model.get_score(i) for i in plain}, any(model.is_byte(i) for i in range(model.get_piece_size()))


class Counter:
    """``most``: words kept at a time."""

    def __init__(self, pieces: dict, byte_pieces: bool, most: int = 1_500_000):
        import ahocorasick
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece goes across a line feed or on with a space: words cannot be counted alone")
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown, self.byte_pieces = min(pieces.values()) - 10, byte_pieces
        self.table, self.known = WordTable(most), np.zeros(most, np.int32)
        self.space, self.piece = self.best(SPACE)[1], 1 << 19

    def best(self, word: str) -> tuple[float, int]:
        """Score and number of tokens of the best segmentation."""
        n, none = len(word), float("-inf")
        score, count, was_unknown = [0.0] + [none] * n, [0] * (n + 1), [False] * (n + 1)
        ends: list = [[] for _ in range(n)]
        for end, found in self.automaton.iter(word):
            ends[end].append(found)
        for at in range(n):
            top, tokens, unknown = none, 0, False
            for length, s in sorted(ends[at], reverse=True):  # from the earliest start
                s += score[at + 1 - length]
                if s > top:
                    top, tokens, unknown = s, count[at + 1 - length] + 1, False
            if word[at] not in self.single and score[at] + self.unknown > top:
                top, unknown = score[at] + self.unknown, True
                tokens = count[at] + (len(word[at].encode()) if self.byte_pieces else 0 if was_unknown[at] else 1)
            score[at + 1], count[at + 1], was_unknown[at + 1] = top, tokens, unknown
        return score[n], count[n]

    def count(self, texts: list) -> list:
        """Numbers of tokens of UTF-8 texts."""
        out = [0] * len(texts)
        for a, b in batches_of(texts, 1 << 19):
            plain = []
            for i in range(a, b):
                t = texts[i].replace(SPACE.encode(), b" ")  # the same once spaces are replaced
                if not t:
                    continue
                if not self.byte_pieces:  # a run of unknown characters may go across words
                    out[i] = self.best((" " + t.decode()).replace(" ", SPACE))[1]
                elif b"  " in t or t[:1] == b" ":
                    out[i] = self._runs(t.decode())
                else:
                    plain.append((i, t))
            if len(plain) == 1 and len(plain[0][1]) > self.piece:
                out[plain[0][0]] = self._long(plain[0][1])
            elif plain:
                for (i, _), n in zip(plain, self._plain([t for _, t in plain])):
                    out[i] = n
        return out

    def _long(self, text: bytes) -> int:
        """A long text, in pieces that end before a space or a line feed, so that the words of a piece fit in the
        table whatever the text. A piece after a space is a text of its own, as texts have a space in front; one after
        a line feed keeps the feed, and the space that then stands alone in front of it is taken off again."""
        at = total = 0
        while at < len(text):
            end = at + self.piece
            cut = max(text.rfind(c, at + 1, end) for c in (b" ", b"\n")) if end < len(text) else len(text)
            if cut < 0:  # a word longer than a piece
                cut = min((i for i in (text.find(c, end) for c in (b" ", b"\n")) if i >= 0), default=len(text))
            total += self._plain([text[at:cut]])[0] - (self.space if at and text[at:at + 1] == b"\n" else 0)
            if cut == len(text) - 1 and text[cut:] == b" ":  # a space at the end stands alone
                total += self.space
            at = cut + (text[cut:cut + 1] == b" ")
        return total

    def _runs(self, text: str) -> int:
        """A text with runs of spaces: a piece may hold several."""
        lines = (" " + text).split("\n")
        runs = [r.replace(" ", SPACE) for line in lines for r in re.findall(" +[^ ]*|[^ ]+", line)]
        return len(lines) - 1 + sum(self.best(r)[1] for r in runs)

    def _plain(self, texts: list) -> list:
        """Texts with single spaces only: counts of all words from the table."""
        data = b"\n".join(texts) + b"\n"
        a = np.frombuffer(data, np.uint8)
        edge = np.flatnonzero(np.diff((a == 32) | (a == 10), prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        first = np.zeros(len(a) + 1, bool)
        first[offsets] = True
        # a word at the start of a text or after a space has a space in front, one at the start of a later line has not
        spaced = first[start] | (a[start - 1] == 32)
        one, two = hashes(a, start, end)
        one = np.where(spaced, one, ~one)

        def learn(new):
            if new is not None:
                words = [(SPACE if s else "") + data[i:j].decode() for i, j, s in zip(start[new].tolist(), end[new].tolist(), spaced[new].tolist())]
                self.known[self.table.n - len(new):self.table.n] = [self.best(w)[1] for w in words]

        n = np.concatenate([[0], np.cumsum(self.known[self.table.numbers(one, two, learn)])])
        in_words = np.diff(n[np.searchsorted(start, offsets)])
        # a line feed is one byte piece, but those that end the texts here are not theirs; a space before one stands alone,
        # as does the space in front of a text that starts with a line feed
        feeds = np.concatenate([[0], np.cumsum(a == 10)])
        alone = np.zeros(len(a) + 1, np.int64)
        alone[1:] = np.cumsum((a == 10) & (np.concatenate([[0], a[:-1]]) == 32))
        head = a[offsets[:-1]] == 10
        per = lambda sums: np.diff(sums[offsets])
        return (in_words + per(feeds) - 1 + self.space * (per(alone) + head)).tolist()


def counter(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED[path] = Counter(*vocabulary(path))
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, n_tokens of every row; ``path``: a sentencepiece file on every worker."""
    text = text_of(text_col)
    part = ship(docs).select(F.col(id_col), F.length(text).cast("long").alias("_n"), text.alias("_text"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counter(path).count(text_bytes(batch.column(2))), pa.int64())],
                                             names=[id_col, "n_chars", "n_tokens"])

    return part.mapInArrow(run, f"{id_col} {part.schema[0].dataType.simpleString()}, n_chars long, n_tokens long")
