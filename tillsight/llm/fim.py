"""Fill-in-middle: texts are cut at two unit boundaries and their parts reordered.

Method: a wavelet matrix over character classes. Every code point of a text gets
one of seven classes (``CLASSES``); the sequence of classes is stored as three
planes of packed bits with a rank directory. The units of a text (lines,
paragraphs, sentences, words) end or start at characters of certain classes, so
the number of units up to a position is a sum of ranks (``Classes.count``), and the
position after a number of units is found by bisection on these ranks
(``Classes.locate``), first over the directory of pieces, then inside one piece.
Planes hold at most ``PIECE`` code points each; a text of any length is indexed
in as many pieces as it needs, about half a byte for each character.

A row's two cuts and its form come from the SHA-256 of ``seed:id`` (as decimals): of
its first four groups of eight hex digits, h1 and h2 modulo units + 1 are the cuts
(the smaller ends the prefix, the larger the middle), h3 modulo 100 decides
whether the text is transformed, h4 modulo 100 which of the two orders it gets.

Defined cases: a null text is an empty text; an empty text has no units and stays
plain, as does a text that holds one of the marks; a null id hashes as an
empty one; repeated rows are rows of their own, with equal cuts; equal cuts give an
empty middle; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import batches_of, ship, text_bytes

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
PIECE = 1 << 20
WORD_RANK = 512  # bits for each entry of a rank directory

#: What a character is: the rest of a word, the start of one, a full stop (or !, ?) in a word, one that
#: starts a word, white space, the line feed of a line with characters, the line feed of an empty line.
CLASSES = INSIDE, START, STOP, START_STOP, SPACE, LINE, BLANK = range(7)
PLANES = 3
#: The classes after whose characters a unit ends, or (word) before whose characters it starts.
UNITS = {"line": (LINE, BLANK), "paragraph": (BLANK,), "sentence": (STOP, START_STOP), "word": (START, START_STOP)}

_KIND = np.zeros(129, np.uint8)  # 0 of a word, 1 stop, 2 white space, 3 line feed; code points from 128 on: of a word
_KIND[[ord(c) for c in ".!?"]] = 1
_KIND[[ord(c) for c in " \t\v\f\r"]] = 2
_KIND[ord("\n")] = 3
#: Class of a character by its own kind and the kind of the one before it.
_CLASS = np.array([[INSIDE, INSIDE, START, START], [STOP, STOP, START_STOP, START_STOP],
                   [SPACE] * 4, [LINE, LINE, LINE, BLANK]], np.uint8)


def classes_of(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each code point; at ``starts`` a text begins, as after a line feed."""
    kind = _KIND[np.minimum(codes, 128)]
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[:1] = 3
    before[starts[starts < len(before)]] = 3
    return _CLASS[kind, before]


class WaveletMatrix:
    """Ranks of symbols below 2^planes: on each plane the bits of one binary digit,
    packed, the zeros' symbols going before the ones' on the next plane."""

    def __init__(self, symbols: np.ndarray, planes: int = PLANES):
        self.n, self.planes = len(symbols), []
        for level in range(planes - 1, -1, -1):
            bits = (symbols >> level) & 1
            ones = bits.astype(bool)
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
            words = np.zeros(-(-len(bits) // WORD_RANK) * WORD_RANK // 8 + 8, np.uint8)
            packed = np.packbits(bits, bitorder="little")
            words[:len(packed)] = packed
            words = words.view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            before = np.concatenate([[0], np.cumsum(counts)])  # ones before each 64-bit word
            directory = before[::WORD_RANK // 64].copy()       # kept each 512 bits
            self.planes.append((words, directory, self.n - int(before[-1])))

    @staticmethod
    def _ones(plane: tuple, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits of a plane."""
        words, directory, _ = plane
        per = WORD_RANK // 64
        block = at // WORD_RANK
        count = directory[block].copy()
        word = at // 64
        for k in range(per - 1):
            inner = block * per + k
            count += np.where(inner < word, np.bitwise_count(words[np.minimum(inner, len(words) - 1)]), 0).astype(np.int64)
        mask = (np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1)
        return count + np.bitwise_count(words[np.minimum(word, len(words) - 1)] & mask)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``at`` symbols, for an array of positions."""
        low, high = np.zeros(len(at), np.int64), np.asarray(at, np.int64)
        for level, plane in zip(range(len(self.planes) - 1, -1, -1), self.planes):
            a, b = self._ones(plane, low), self._ones(plane, high)
            low, high = (plane[2] + a, plane[2] + b) if symbol >> level & 1 else (low - a, high - b)
        return high - low


class Classes:
    """The characters of texts laid end to end, in pieces of at most ``PIECE``."""

    def __init__(self, texts: list[str], unit: str, piece: int = PIECE):
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {sorted(UNITS)}: {unit!r}")
        self.marks, self.opens, self.piece = UNITS[unit], unit == "word", piece
        self.from_ = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.pieces, counts, starts, held, size = [], [0], self.from_[:-1], [], 0
        done, last = 0, 3  # characters indexed so far; the kind of the one before

        def index(codes):
            nonlocal done
            inside = starts[(starts >= done) & (starts < done + len(codes))] - done
            symbols = classes_of(codes, inside)
            if len(symbols) and not (len(inside) and inside[0] == 0):
                symbols[0] = _CLASS[_KIND[min(int(codes[0]), 128)], last]
            self.pieces.append(WaveletMatrix(symbols))
            counts.append(counts[-1] + int(self._in_piece(len(self.pieces) - 1, np.array([len(codes)]))[0]))
            done += len(codes)
            return int(_KIND[min(int(codes[-1]), 128)])

        for t in texts:
            for a in range(0, len(t), piece):
                part = np.frombuffer(t[a:a + piece].encode("utf-32-le", "surrogatepass"), np.uint32)
                while size + len(part) >= piece:  # a piece is full
                    room = piece - size
                    last = index(np.concatenate([*held, part[:room]]))
                    part, held, size = part[room:], [], 0
                held.append(part)
                size += len(part)
        if size:
            last = index(np.concatenate(held))
        self.counts = np.array(counts, np.int64)

    def _in_piece(self, piece: int, at: np.ndarray) -> np.ndarray:
        return sum(self.pieces[piece].rank(c, at) for c in self.marks)

    def count(self, at: np.ndarray) -> np.ndarray:
        """Marked characters among the first ``at`` of all texts together."""
        at = np.asarray(at, np.int64)
        which = np.minimum(at // self.piece, len(self.pieces) - 1) if self.pieces else np.zeros(len(at), np.int64)
        out = np.zeros(len(at), np.int64)
        for p in np.unique(which) if self.pieces else ():
            mine = which == p
            out[mine] = self.counts[p] + self._in_piece(int(p), at[mine] - p * self.piece)
        return out

    def locate(self, number: np.ndarray) -> np.ndarray:
        """Position of the ``number``-th marked character (from 1), by bisection on ranks."""
        number = np.asarray(number, np.int64)
        which = np.searchsorted(self.counts, number, side="left") - 1
        out = np.zeros(len(number), np.int64)
        for p in np.unique(which):
            mine = which == p
            want = number[mine] - self.counts[p]
            low, high = np.zeros(len(want), np.int64), np.full(len(want), self.pieces[p].n, np.int64)
            while (low < high).any():  # the least position among whose first characters there are as many
                middle = (low + high) // 2
                enough = self._in_piece(int(p), middle) >= want
                low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
            out[mine] = p * self.piece + low - 1
        return out

    def units(self) -> np.ndarray:
        """Units of each text: its marked characters, and a rest after the last one (word: if it has none, the whole text)."""
        a, b = self.from_[:-1], self.from_[1:]
        n = self.count(b) - self.count(a)
        if self.opens:
            return np.where((n == 0) & (b > a), 1, n)
        closed = np.zeros(len(a), bool)
        some = b > a
        closed[some] = (self.count(b[some]) - self.count(b[some] - 1)) == 1
        return n + (some & ~closed)

    def after(self, number: np.ndarray) -> np.ndarray:
        """For each text the characters before the end of its first ``number`` units."""
        a, b = self.from_[:-1], self.from_[1:]
        base = self.count(a)
        marked = self.count(b) - base
        out = np.where(number > 0, b - a, 0)
        # a word unit ends before the next word's first character, other units after their own last character
        inner = (number > 0) & (number < marked if self.opens else number <= marked)
        at = self.locate(base[inner] + number[inner] + (1 if self.opens else 0))
        out[inner] = at - a[inner] + (0 if self.opens else 1)
        return out


def draws(key: str) -> list[int]:
    """Four unsigned 32-bit numbers for a key."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def transform(docs: DataFrame, unit: str = "line", rate: int = 100, spm_rate: int = 50, seed: int = 7,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    psm: mark P, prefix, mark S, suffix, mark M, middle; spm: mark S, suffix, mark P, prefix,
    mark M, middle. ``rate``: texts in a hundred that are transformed; ``spm_rate``: of
    these, how many in a hundred take the second order. No row leaves its partition.
    """
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for start, end in batches_of(raw):
                texts = [t.decode("utf-8", "surrogatepass") for t in raw[start:end]]
                index = Classes(texts, unit)
                n = index.units()
                keys = [draws(f"{seed}:{'' if i is None else i}") for i in ids[start:end]]
                cuts = np.sort([[h[0] % (m + 1), h[1] % (m + 1)] for h, m in zip(keys, n.tolist())], axis=1)
                firsts, lasts = index.after(cuts[:, 0]), index.after(cuts[:, 1])
                out = []
                for t, h, a, b in zip(texts, keys, firsts.tolist(), lasts.tolist()):
                    p, s, m = MARKS
                    if not t or h[2] % 100 >= rate or any(x in t for x in MARKS):
                        out.append(("plain", None, None, t))
                    elif h[3] % 100 < spm_rate:
                        out.append(("spm", a, b - a, f"{s}{t[b:]}{p}{t[:a]}{m}{t[a:b]}"))
                    else:
                        out.append(("psm", a, b - a, f"{p}{t[:a]}{s}{t[b:]}{m}{t[a:b]}"))
                form, prefix, middle, text = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                     pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(text, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    part = ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return part.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts between the marks, in their first order. A
    transformed text holds no mark of its own, and none can arise where parts meet."""
    parts = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
             .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
