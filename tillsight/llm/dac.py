"""Token ids in directly addressable codes.

A shard file holds the ids of consecutive documents. Each id is split into
chunks of ``width`` bits, lowest first. Level k stores the k-th chunks of all
ids that have more than k chunks, with a bitmap of those that continue on level
k + 1 and a rank directory (ones before every 512th bit). The position of an
id's next chunk is the rank of its continuation bit, so any token, or any run
of tokens, is read without decoding what lies before it.

``write`` range-partitions the texts by id, encodes each partition in one
streaming pass into shards of about ``shard_tokens`` ids, and stores the shard
files as rows (part, shard, bytes) of a Parquet table, so that any file system
Spark writes to can hold them. ``read`` opens them with Spark again. The only
thing that is summed over all documents is one token count for each partition.

Defined cases: null or empty text: the end id alone; a null id comes first;
repeated ids stand next to each other, in the order of their texts; an empty
table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillsight.llm.common import ship, text_bytes
from tillsight.llm.tokens import memo

MAGIC = b"DAC1"
STRIDE = 512  # bits for each entry of a rank directory
BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Level:
    """Chunks, their continuation bitmap and its rank directory."""

    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bitmap, self.ranks = chunks, bitmap, ranks

    @classmethod
    def of(cls, chunks: np.ndarray, more: np.ndarray) -> Level:
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(BITS[bitmap].astype(np.uint64), np.arange(0, len(bitmap), STRIDE // 8)) if len(bitmap) else []
        return cls(chunks, bitmap, np.concatenate([[0], np.cumsum(ones)]).astype("<u4"))

    def rank(self, i: int) -> int:
        """Ones before bit i."""
        block, byte = i // STRIDE, i // 8
        ones = int(self.ranks[block]) + int(BITS[self.bitmap[block * (STRIDE // 8):byte]].sum())
        return ones + (bin(int(self.bitmap[byte]) & ((1 << i % 8) - 1)).count("1") if i % 8 else 0)

    def more(self, a: int, b: int) -> np.ndarray:
        return np.unpackbits(self.bitmap[a // 8:(b + 7) // 8], bitorder="little")[a % 8:a % 8 + b - a].astype(bool)


def encode(ids: np.ndarray, width: int = 8) -> bytes:
    """The codes of an array of unsigned 32-bit ids."""
    kind = "u1" if width <= 8 else "<u2"
    rest, parts, levels = ids.astype(np.uint32), [], 0
    while True:
        high = rest >> np.uint32(width)
        level = Level.of((rest & np.uint32((1 << width) - 1)).astype(kind), high > 0)
        parts += [struct.pack("<Q", len(rest)), level.chunks.tobytes(), level.bitmap.tobytes(), level.ranks.tobytes()]
        levels += 1
        rest = high[high > 0]
        if not len(rest):
            return struct.pack("<BB", width, levels) + b"".join(parts)


class Codes:
    """Reads codes in place."""

    def __init__(self, data):
        self.width, n_levels = struct.unpack_from("<BB", data)
        kind, at, self.levels = np.dtype("u1" if self.width <= 8 else "<u2"), 2, []
        for _ in range(n_levels):
            n, = struct.unpack_from("<Q", data, at)
            at += 8
            sizes, arrays = [(kind, n), (np.dtype("u1"), (n + 7) // 8), (np.dtype("<u4"), -(-((n + 7) // 8) * 8 // STRIDE) + 1)], []
            for t, m in sizes:
                arrays.append(np.frombuffer(data, t, m, at))
                at += t.itemsize * m
            self.levels.append(Level(*arrays))

    def __len__(self) -> int:
        return len(self.levels[0].chunks)

    def __getitem__(self, i: int) -> int:
        """One id, from one chunk and one rank on each of its levels."""
        value, shift = 0, 0
        for level in self.levels:
            value |= int(level.chunks[i]) << shift
            if not level.bitmap[i // 8] >> (i % 8) & 1:
                return value
            i, shift = level.rank(i), shift + self.width
        raise ValueError("codes end within an id")

    def run(self, a: int, b: int) -> np.ndarray:
        """The ids at a to b - 1: their next chunks lie together on each level."""
        out, at, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for level in self.levels:
            if b <= a:
                break
            out[at] |= level.chunks[a:b].astype(np.uint32) << np.uint32(shift)
            at = at[level.more(a, b)]
            a, shift = level.rank(a) if len(at) else 0, shift + self.width
            b = a + len(at)
        return out


def shard_bytes(start: int, docs: list, ids: np.ndarray, width: int) -> bytes:
    """A shard file: header, ids and token counts of its documents, codes.
    start: ids of the documents before it in its partition."""
    names = b"".join(struct.pack("<?q", d is None, d or 0) for d, _ in docs)
    counts = np.array([n for _, n in docs], "<u8").tobytes()
    return MAGIC + struct.pack("<QQ", start, len(docs)) + names + counts + encode(ids, width)


def open_shard(data: bytes) -> tuple[int, list, np.ndarray, Codes]:
    """start, document ids, their token counts, codes."""
    assert data[:4] == MAGIC
    start, n = struct.unpack_from("<QQ", data, 4)
    names = [None if null else d for null, d in struct.iter_unpack("<?q", data[20:20 + 9 * n])]
    counts = np.frombuffer(data, "<u8", n, 20 + 9 * n)
    return start, names, counts, Codes(memoryview(data)[20 + 17 * n:])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, width: int = 8, shard_tokens: int = 1 << 20,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts, in ascending order of id, into shard files at ``path``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, shard, start, held, ids = TaskContext.get().partitionId(), 0, 0, [], []

        def flush():
            array = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([start + len(array)], pa.int64()),
                 pa.array([shard_bytes(start, held, array, width)], pa.binary())], names=["part", "shard", "ends", "file"])

        size = 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for at in range(0, len(texts), 256):
                for d, x in zip(names[at:at + 256], memo(tokenizer).encode(texts[at:at + 256])):
                    held.append((d, len(x) // 4 + 1))
                    ids.append(x + end)
                    size += held[-1][1]
                    if size >= shard_tokens:
                        yield flush()
                        shard, start, held, ids, size = shard + 1, start + size, [], [], 0
        if held:
            yield flush()

    spark = docs.sparkSession
    part = ship(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    part = part.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("id").asc_nulls_first())
    (part.sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
         .mapInArrow(run, "part long, shard long, ends long, file binary").write.mode("overwrite").parquet(path))


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the files: id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of its ids as little-endian uint32)."""
    files = spark.read.schema("part long, shard long, ends long, file binary").parquet(path)

    def run(batches):
        import pyarrow as pa
        kinds = [pa.int64()] * 5
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                at, names, counts, codes = open_shard(data.as_py())
                ends, out = np.cumsum(counts).astype(int).tolist(), []
                for d, a, b in zip(names, [0, *ends], ends):
                    out.append((part, d, at + a, b - a, zlib.crc32(codes.run(a, b).astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 names=["part", id_col, "at", "n_tokens", "ids_crc32"])

    # One row for each partition that was written: as many as range partitions, whatever the data.
    parts = files.groupBy("part").agg(F.max("ends").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    found = ship(files).select("part", "file").mapInArrow(run, f"part long, {id_col} long, at long, n_tokens long, ids_crc32 long")
    return (found.join(F.broadcast(before), "part")
                 .select(id_col, (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))
