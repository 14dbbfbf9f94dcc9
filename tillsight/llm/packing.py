"""Packing by minimum bin slack.

Texts become token ids with an end id. Whole stretches of ``capacity`` tokens
of a long text are sequences of their own; what remains of each text (1 to
capacity - 1 tokens) goes into a bounded window of remainders. From the window
each sequence takes the longest remainder and then the multiset of other
remaining lengths whose sum comes closest to the capacity: a subset-sum dynamic
programme on a bit set (bit s = sum s can be reached), stopped once the exact
fit is reachable and backtracked into counts per length. Slack that no
multiset closes is filled by cutting one remainder. What a partition has left
at its end, less than one sequence, is cut into sequences whose lengths are
powers of two, which need no padding.

Everything runs in one pass over each input partition, with no shuffle: the
window holds ``window`` remainders, so a task's memory does not grow with its
input, and a retried task repeats its result.

Defined cases: null or empty text: the end id alone; repeated rows or ids:
each row is packed on its own; a null id stays null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame

from tillsight.llm.common import ship, text_bytes
from tillsight.llm.tokens import memo

SCHEMA = "{id} {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def closest_multiset(counts: dict, space: int) -> dict:
    """Counts per length whose sum comes closest to ``space`` from below.

    ``counts``: how many remainders there are of each length. The bit set after
    each single item is kept, so backtracking from the best sum finds the items.
    """
    mask, reach, steps = (1 << (space + 1)) - 1, 1, []
    full = 1 << space
    for length in sorted((x for x in counts if x <= space), reverse=True):
        for _ in range(min(counts[length], space // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
            if reach & full:
                break
        if reach & full:
            break
    best, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> best & 1:
            taken[length] = taken.get(length, 0) + 1
            best -= length
    return taken


class Window:
    """Remainders by length; each is (id, ids, start, tokens of its text)."""

    def __init__(self):
        self.by_length, self.lengths, self.counts, self.n = {}, [], {}, 0

    def add(self, piece) -> None:
        k = len(piece[1])
        if k not in self.by_length:
            self.lengths.insert(bisect_left(self.lengths, k), k)
        self.by_length.setdefault(k, []).append(piece)
        self.counts[k] = self.counts.get(k, 0) + 1
        self.n += 1

    def take(self, k: int):
        stack = self.by_length[k]
        piece = stack.pop()
        self.counts[k] -= 1
        self.n -= 1
        if not stack:
            del self.by_length[k], self.counts[k]
            self.lengths.pop(bisect_left(self.lengths, k))
        return piece

    def total(self) -> int:
        return sum(k * n for k, n in self.counts.items())

    def sequence(self, capacity: int) -> list:
        """The pieces of one full sequence; the window must hold enough tokens."""
        first = self.take(self.lengths[-1])
        space, pieces = capacity - len(first[1]), [first]
        for k, n in closest_multiset(self.counts, space).items():
            pieces += [self.take(k) for _ in range(n)]
            space -= k * n
        while space:  # every remainder left is longer than the slack, or would have been taken
            i = bisect_left(self.lengths, space)
            k = self.lengths[min(i, len(self.lengths) - 1)]
            head, tail = cut(self.take(k), min(space, k))
            pieces.append(head)
            space -= len(head[1])
            if tail:
                self.add(tail)
        return pieces


def cut(piece, at: int):
    doc, ids, start, n = piece
    return (doc, ids[:at], start, n), (doc, ids[at:], start + at, n) if at < len(ids) else None


def pack_stream(stream, capacity: int, window: int):
    """Sequences, as lists of pieces, of a stream of (id, ids as an array)."""
    held = Window()
    for doc, ids in stream:
        n, whole = len(ids), len(ids) - len(ids) % capacity
        for at in range(0, whole, capacity):
            yield [(doc, ids[at:at + capacity], at, n)]
        if whole < n:
            held.add((doc, ids[whole:].copy(), whole, n))  # a view would keep the whole text's ids
        if held.n >= window:
            while held.n > window // 2 and held.total() >= capacity:
                yield held.sequence(capacity)
    while held.total() >= capacity:
        yield held.sequence(capacity)
    rest = held.total()
    while rest:
        size = 1 << rest.bit_length() - 1
        pieces, space = [], size
        while space:
            k = held.lengths[-1]
            head, tail = cut(held.take(k), min(space, k))
            pieces.append(head)
            space -= len(head[1])
            if tail:
                held.add(tail)
        yield pieces
        rest -= size


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, window: int = 2048,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start (in its text), length, doc_tokens,
    sequence_id, offset (in its sequence) and ids (little-endian uint32)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 36

        def stream():
            for batch in batches:
                names, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
                for at in range(0, len(texts), 256):
                    for doc, ids in zip(names[at:at + 256], memo(tokenizer).encode(texts[at:at + 256])):
                        yield doc, np.frombuffer(ids + end, "<u4")

        out, size = [], 0
        kinds = [ids_type, *[pa.int64()] * 5, pa.binary()]

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=columns)

        for k, pieces in enumerate(pack_stream(stream(), capacity, window)):
            offset = 0
            for doc, ids, start, n in pieces:
                out.append((doc, start, len(ids), n, first + k, offset, ids.tobytes()))
                offset += len(ids)
            size += offset
            if size >= 1 << 20:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_type
    field = docs.select(id_col).schema[0]
    ids_type = to_arrow_type(field.dataType)
    schema = SCHEMA.format(id=id_col, kind=field.dataType.simpleString())
    columns = [c.split()[0] for c in schema.split(", ")]
    return ship(docs).select(id_col, docs[text_col].cast("string")).mapInArrow(run, schema)
