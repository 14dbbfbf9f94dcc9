"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

State of a corpus (``LineState``):

* ``refcounts``: for each line key the exact number of documents that hold it;
* ``filters``: for each shard of keys one cuckoo filter of the keys found in at
  least ``min_docs`` documents, as a row (shard, n_buckets, table, stash).

``insert`` and ``delete`` change the counts by a batch of documents and move
only the keys that cross the threshold into or out of their shard's filter,
which a cuckoo filter allows in both directions; deleting what was inserted
restores counts and filters, and lines dropped on its account come back.
``apply`` splits a batch into lines, probes each distinct key in its shard's
filter, confirms the few candidates in the exact table, and drops the confirmed
lines, so a false positive of a filter never drops a line.

Scale: a key's rows are counted with partial aggregation, probing takes each
distinct key once (a line held by a third of all documents is one row there),
the number of shards follows the number of distinct keys, and the join from
confirmed keys back to documents is one that Spark splits where a key is hot.

Defined cases: a null or empty text is one empty line; every row is a document
of its own, also when its id or text is repeated or null; a line without key
characters never goes; an empty table gives no rows; columns not asked for
with ``keep`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import SPACE, ship, staged, text_bytes

SLOTS, KICKS = 4, 200
FILTER = "shard long, n_buckets long, table binary, stash binary"


class CuckooFilter:
    """16-bit fingerprints in buckets of four; 0 is a free slot. Keys of 16
    bytes that find no place go to a stash, so nothing is lost when it fills."""

    def __init__(self, n_buckets: int, table: bytes | None = None, stash: bytes = b""):
        self.n = n_buckets
        self.table = np.zeros((n_buckets, SLOTS), "<u2") if table is None else np.frombuffer(table, "<u2").reshape(-1, SLOTS).copy()
        self.stash = {stash[i:i + 16] for i in range(0, len(stash), 16)}

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        return cls(1 << max(4, int(n_keys / (SLOTS * 0.8))).bit_length())

    def _places(self, keys: np.ndarray):
        """keys: (n, 2) uint64. Fingerprint and the two buckets of each."""
        mark = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint64)
        mark[mark == 0] = 1
        mask = np.uint64(self.n - 1)
        one = (keys[:, 1] >> np.uint64(16)) & mask
        return mark, one, one ^ self._hop(mark)

    def _hop(self, mark):
        return (mark * np.uint64(0x5BD1E9955BD1E995) >> np.uint64(20)) & np.uint64(self.n - 1)

    def contains(self, data: bytes) -> np.ndarray:
        keys = np.frombuffer(data, "<u8").reshape(-1, 2)
        mark, one, two = self._places(keys)
        hit = (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)
        if self.stash:
            hit |= np.fromiter((data[i:i + 16] in self.stash for i in range(0, len(data), 16)), bool, len(keys))
        return hit

    def insert(self, key: bytes) -> None:
        mark, one, two = self._places(np.frombuffer(key, "<u8").reshape(1, 2))
        mark, at = mark[0], [int(one[0]), int(two[0])]
        for b in at:
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return
        b, path = at[0], []
        for k in range(KICKS):
            slot = (k * 7 + int(mark)) % SLOTS
            path.append((b, slot, self.table[b, slot]))
            mark, self.table[b, slot] = np.uint64(self.table[b, slot]), mark
            b ^= int(self._hop(np.array([mark]))[0])
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return
        for b, slot, old in reversed(path):  # no place: put all back, keep the key itself
            self.table[b, slot] = old
        self.stash.add(key)

    def delete(self, key: bytes) -> None:
        if key in self.stash:
            self.stash.discard(key)
            return
        mark, one, two = self._places(np.frombuffer(key, "<u8").reshape(1, 2))
        for b in (int(one[0]), int(two[0])):
            held = np.flatnonzero(self.table[b] == mark[0])
            if len(held):
                self.table[b, held[0]] = 0
                return

    def row(self, shard: int):
        import pyarrow as pa
        return pa.table({"shard": pa.array([shard], pa.int64()), "n_buckets": pa.array([self.n], pa.int64()),
                         "table": pa.array([self.table.tobytes()], pa.binary()),
                         "stash": pa.array([b"".join(sorted(self.stash))], pa.binary())})


@dataclass
class LineState:
    refcounts: DataFrame  # key binary, n_docs long
    filters: DataFrame    # FILTER
    n_shards: int
    min_docs: int
    min_chars: int


def keys_of_text(text: bytes, min_chars: int) -> list:
    """128-bit keys of a text's distinct lines, in order of appearance."""
    from xxhash import xxh3_128_digest
    keys = (line.strip(SPACE) for line in text.lower().split(b"\n"))  # bytes: A-Z only
    return [xxh3_128_digest(k) for k in dict.fromkeys(keys) if k and (min_chars <= 1 or len(k.decode()) >= min_chars)]


def line_keys(docs: DataFrame, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, key): each row's distinct line keys."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for at in range(0, len(texts), 1024):
                found = [keys_of_text(t, min_chars) for t in texts[at:at + 1024]]
                take = pa.array(np.repeat(np.arange(at, at + len(found)), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take),
                                                  pa.array([k for x in found for k in x], pa.binary())], names=["doc", "text_hash", "key"])

    part = ship(docs).select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
                       F.col(text_col).cast("string").alias("text"))
    return part.mapInArrow(run, f"doc {part.schema['doc'].dataType.simpleString()}, text_hash long, key binary")


def shard_of(key: str, n_shards: int):
    return F.pmod(F.xxhash64(key), F.lit(n_shards))


def _build(key, table):
    keys = table.column("key").to_pylist()
    made = CuckooFilter.sized(len(keys))
    for k in sorted(keys):
        made.insert(k)
    return made.row(table.column("shard")[0].as_py())


def _build_filters(refcounts: DataFrame, n_shards: int, min_docs: int) -> DataFrame:
    hot = refcounts.where(F.col("n_docs") >= min_docs).select(shard_of("key", n_shards).alias("shard"), "key")
    return hot.groupBy("shard").applyInArrow(_build, FILTER)


def build(keys: DataFrame, min_docs: int = 10, min_chars: int = 1, keys_per_shard: int = 1 << 15) -> LineState:
    """The state of the documents whose (staged) ``line_keys`` are given."""
    counts = staged(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs")), "line-refcounts")
    n_shards = max(1, -(-counts.count() // keys_per_shard))
    return LineState(counts, staged(_build_filters(counts, n_shards, min_docs), "line-filters"), n_shards, min_docs, min_chars)


def _change(state: LineState, docs: DataFrame, sign: int, **cols) -> LineState:
    delta = line_keys(docs, state.min_chars, **cols).groupBy("key").agg((F.lit(sign) * F.count(F.lit(1))).alias("n_docs"))
    both = state.refcounts.select("key", "n_docs", F.col("n_docs").alias("was")).unionByName(
        delta.select("key", "n_docs", F.lit(0).cast("long").alias("was")))
    new = staged(both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.sum("was").alias("was")), "line-refcounts")
    up, down = F.col("n_docs") >= state.min_docs, F.col("was") >= state.min_docs
    moved = new.where(up != down).select(shard_of("key", state.n_shards).alias("shard"), "key", up.alias("up"))

    def change(key, filters, table):
        shard = (filters if filters.num_rows else table).column("shard")[0].as_py()
        moves = sorted(zip(table.column("key").to_pylist(), table.column("up").to_pylist()))
        if filters.num_rows:
            held = CuckooFilter(*(filters.column(c)[0].as_py() for c in ("n_buckets", "table", "stash")))
        else:
            held = CuckooFilter.sized(len(moves))
        for k, _ in (m for m in moves if not m[1]):
            held.delete(k)
        for k, _ in (m for m in moves if m[1]):
            held.insert(k)
        return held.row(shard)

    filters = state.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(change, FILTER)
    return LineState(new.where("n_docs > 0").select("key", "n_docs"), staged(filters, "line-filters"),
                     state.n_shards, state.min_docs, state.min_chars)


def insert(state: LineState, docs: DataFrame, **cols) -> LineState:
    """The state with a further batch of documents."""
    return _change(state, docs, 1, **cols)


def delete(state: LineState, docs: DataFrame, **cols) -> LineState:
    """The state without documents that were inserted earlier."""
    return _change(state, docs, -1, **cols)


def _probe(key, keys, filters):
    import pyarrow as pa
    found = keys.column("key").combine_chunks()
    if keys.num_rows and filters.num_rows:
        held = CuckooFilter(*(filters.column(c)[0].as_py() for c in ("n_buckets", "table", "stash")))
        found = found.filter(pa.array(held.contains(b"".join(found.to_pylist()))))
    else:
        found = found.slice(0, 0)
    return pa.table({"key": found.cast(pa.binary())})


def frequent(state: LineState, keys: DataFrame) -> DataFrame:
    """Those of the distinct ``keys`` that at least ``min_docs`` documents hold:
    candidates from the filters, confirmed by the exact counts."""
    dealt = keys.select(shard_of("key", state.n_shards).alias("shard"), "key")
    maybe = dealt.groupBy("shard").cogroup(state.filters.groupBy("shard")).applyInArrow(_probe, "key binary")
    return maybe.join(state.refcounts.where(F.col("n_docs") >= state.min_docs), "key", "left_semi")


def apply(docs: DataFrame, state: LineState, keys: DataFrame | None = None, keep: tuple = (),
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, kept_text, n_lines, n_dropped and the ``keep`` columns of each row.
    ``keys``: the documents' line keys, if they are staged already."""
    keys = line_keys(docs, state.min_chars, id_col, text_col) if keys is None else keys
    drops = (keys.join(frequent(state, keys.select("key").distinct()), "key")
                 .groupBy("doc", "text_hash").agg(F.collect_set("key").alias("drop")))
    out = {"_kept": "string", "_lines": "long", "_dropped": "long"}
    part = ship(docs).select(F.struct(id_col, *keep).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    hit = (part["_row"][id_col].eqNullSafe(drops["doc"])) & (F.xxhash64("_text") == drops["text_hash"])
    joined = part.join(drops.hint("shuffle_hash"), hit, "left")  # the texts are not sorted
    joined = joined.select("_row", "_text", "drop")

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest
        for batch in batches:
            done = []
            for text, drop in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                n = text.count(b"\n") + 1
                if not drop:
                    done.append((text, n, 0))
                    continue
                drop = set(drop)
                lines = text.split(b"\n")
                left = [x for x in lines if xxh3_128_digest(x.lower().strip(SPACE)) not in drop]
                done.append((b"\n".join(left), n, n - len(left)))
            text, n, dropped = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary()).cast(pa.string()),
                                              pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=["_row", *out])

    kind = joined.schema["_row"].dataType.simpleString()
    done = joined.mapInArrow(run, f"_row {kind}, _kept string, _lines long, _dropped long")
    return done.select("_row.*", F.col("_kept").alias("kept_text"), F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))


def dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: tuple = (),
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Insert all documents into an empty state, then drop the lines it names."""
    keys = staged(line_keys(docs, min_chars, id_col, text_col), "line-keys")
    return apply(docs, build(keys, min_docs, min_chars), keys, keep, id_col, text_col)
