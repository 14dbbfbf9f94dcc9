"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Texts are sets of five-word shingles (words without regard to ASCII case; a
shorter text is one shingle). Documents of equal texts form one node.

1. Forest. ``trees`` prefix tries, each over ``depth`` MinHash values of a node.
   A pair of similarity s agrees in the first k values of some tree with
   probability 1 - (1 - s^k)^trees. Starting from whole signatures, the matched
   prefix is shortened until that reaches ``recall`` at the threshold
   (``matched_depth``).
2. Nodes that share a prefix of that length in a tree are candidates of each
   other; components of these matches go to verification.
3. Verification is exact and complete: within a component the shingle sets of
   all pairs are intersected, in blocks of a bounded number of shingles, so that a
   component of any size is spread over many tasks. Only counts of links and a
   spanning forest leave a block, never the pairs.
4. The recall is measured on the verified links: the part of them that the
   forest matched itself. While it is below ``recall``, the prefix is shortened
   by one more value and 2 to 4 run again.

Result: one row per document with the id of its class (least id of the
component of verified links), and how many other documents it is linked to.

Defined cases: texts without words are similar to nothing, each its own class;
repeated rows and ids are documents of their own, equal texts are linked; null
ids come after all others as class id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import WORD, ship, staged, text_bytes, text_of
from tillsight.llm.graph import components
from tillsight.llm.shingles import minhash, shingles

BLOCK_NODES, BLOCK_SHINGLES = 512, 400_000


def matched_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix that finds a pair at the threshold with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def signatures(docs: DataFrame, trees: int, depth: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc, key (of its text), n (shingles, repeats included), sig (MinHash values, 4 bytes each)."""
    part = ship(docs).select(F.col(id_col).alias("doc"), F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("key"),
                             F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for at in range(0, len(texts), 512):
                values, counts = shingles(texts[at:at + 512], size)
                sig = minhash(values, counts, trees * depth).astype(">u4")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(counts)), batch.column(1).slice(at, len(counts)), pa.array(counts, pa.int64()),
                    pa.array([row.tobytes() for row in sig], pa.binary())], names=["doc", "key", "n", "sig"])

    return part.mapInArrow(run, f"doc {part.schema['doc'].dataType.simpleString()}, key binary, n long, sig binary")


def matches(reps: DataFrame, trees: int, depth: int, k: int) -> DataFrame:
    """(a, b): nodes that share their first ``k`` values in a tree, each with the
    least node of that branch."""
    branch = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(
        t, F.substring("sig", t * (4 * depth) + 1, F.lit(4 * k))))
    rows = reps.select("node", F.explode(branch).alias("branch"))
    met = rows.groupBy("branch").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    return rows.join(met.select("branch", "a"), "branch").where("node != a").select("a", F.col("node").alias("b")).distinct()


def _linked(nodes, weights, sets, sig, left, right, same, share):
    """Links between the nodes at ``left`` and those at ``right`` (indices): per node
    the weight of its links; edges of a spanning forest; links and matched ones."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, cell, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = times[cell] > 1
    owner, cell = owner[use], (np.cumsum(times > 1) - 1)[cell[use]]
    order = np.argsort(cell, kind="stable")
    owner, cell = owner[order], cell[order]
    both = np.zeros((len(left), len(right)))
    step = 4096
    for at in range(0, int(cell[-1]) + 1 if len(cell) else 0, step):
        a, b = np.searchsorted(cell, [at, at + step])
        dense = np.zeros((len(sets), step), np.float32)
        dense[owner[a:b], cell[a:b] - at] = 1
        both += dense[left] @ dense[right].T
    n = np.array([len(s) for s in sets], float)
    union = n[left][:, None] + n[right][None, :] - both
    link = (both * share.denominator >= union * share.numerator) & (both > 0)
    if same:
        np.fill_diagonal(link, False)
    count = np.zeros(len(sets))
    count[left] += link @ weights[right]
    if not same:
        count[right] += link.T @ weights[left]
    met = np.zeros_like(link)
    for t in range(sig.shape[1]):
        met |= sig[left, t][:, None] == sig[right, t][None, :]
    # Spanning forest: lower labels along links until nothing changes.
    label = np.arange(len(sets))
    while True:
        old = label.copy()
        high = len(sets)
        label[left] = np.minimum(label[left], np.where(link, label[right][None, :], high).min(1, initial=high))
        label[right] = np.minimum(label[right], np.where(link, label[left][:, None], high).min(0, initial=high))
        label = label[label]
        if (label == old).all():
            break
    edges = [(nodes[label[i]], nodes[i]) for i in np.flatnonzero(label != np.arange(len(sets)))]
    return count, edges, int(link.sum()), int((link & met).sum())


def verified(cands: DataFrame, trees: int, depth: int, k: int, threshold: float) -> DataFrame:
    """(kind, a, b, n, m) from (component, node, weight, n_blocks, block, sig, set):
    kind 0: node a is linked to n documents of other texts; kind 1: a and b are
    linked, directly or not; kind 2: n links between texts, m of them matched."""
    share = Fraction(threshold).limit_denominator(10_000)
    small = cands["n_blocks"] == 1
    bins = F.pmod(F.xxhash64("component"), F.col("n_bins"))
    one = F.array(F.struct(F.lit(-1).cast("long").alias("i"), bins.alias("j")))
    many = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1),
                       lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    dealt = cands.withColumn("p", F.explode(F.when(small, one).otherwise(many)))
    dealt = dealt.select(F.when(small, F.lit(-1).cast("long")).otherwise(F.col("component")).alias("c"), F.col("p.i").alias("i"), F.col("p.j").alias("j"),
                         "component", "node", "weight", "block", "sig", "set")

    def run(key, table):
        import pyarrow as pa
        c, i, j = (x.as_py() for x in key)
        rows = sorted(zip(*(table.column(x).to_pylist() for x in ("component", "node", "weight", "block", "sig", "set"))), key=lambda r: r[:2])
        out, at = [], 0
        while at < len(rows):
            to = at
            part = {}
            while to < len(rows) and rows[to][0] == rows[at][0]:
                part[rows[to][1]] = rows[to]  # a repeated row is one node
                to += 1
            at, part = to, list(part.values())
            nodes, block = [r[1] for r in part], np.array([r[3] for r in part])
            weights, sets = np.array([r[2] for r in part], float), [np.frombuffer(r[5], "<u8") for r in part]
            whole = np.frombuffer(b"".join(r[4] for r in part), ">u4").reshape(len(part), trees, depth)[:, :, :k].astype(np.uint64)
            sig = np.zeros((len(part), trees), np.uint64)
            for x in range(k):
                sig = sig * np.uint64(0x9E3779B97F4A7C15) + whole[:, :, x]
            everything, same = np.arange(len(part)), c == -1 or i == j
            left, right = (everything, everything) if same else (np.flatnonzero(block == i), np.flatnonzero(block == j))
            count, edges, n, m = _linked(nodes, weights, sets, sig, left, right, same, share)
            out += [(0, a, None, int(x), None) for a, x in zip(nodes, count) if x]
            out += [(1, a, b, None, None) for a, b in edges]
            half = 2 if same else 1
            out.append((2, None, None, n // half, m // half))
        cols = list(zip(*out)) or [()] * 5
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("kind", "a", "b", "n", "m"), cols, [pa.int32()] + [pa.int64()] * 4)})

    return dealt.groupBy("c", "i", "j").applyInArrow(run, "kind int, a long, b long, n long, m long")


def classes(docs: DataFrame, threshold: float = 0.8, size: int = 5, trees: int = 24, depth: int = 6, recall: float = 0.999,
            id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (doc, key, n, sig), and of each text with words: key, first (its
    least id), label (of its class, unlike an id never shared or null), class_id, n_links."""
    signed = staged(signatures(docs, trees, depth, size, id_col, text_col), "jaccard-signatures")
    texts = signed.where("n > 0").groupBy("key", "doc").agg(F.count(F.lit(1)).alias("rows")).groupBy("key").agg(
        F.min("doc").alias("first"), F.sum("rows").alias("weight"), F.min_by("rows", "doc").alias("times"))
    texts = texts.withColumn("times", F.coalesce("times", "weight"))  # rows with the least id; without one, all
    # the ids of nodes are fixed by writing them
    texts = staged(texts.withColumn("node", F.monotonically_increasing_id()), "jaccard-texts")
    first = signed.select(F.col("doc").alias("d"), F.col("key").alias("k"), "n", "sig")
    reps = first.join(texts, (first["k"] == texts["key"]) & first["d"].eqNullSafe(texts["first"])).select("node", "first", "key", "weight", "times", "n", "sig")
    # one row for each node, however often its row is repeated
    reps = staged(reps.where("times = 1").unionByName(reps.where("times > 1").dropDuplicates(["node"])), "jaccard-nodes")
    k = matched_depth(threshold, trees, depth, recall)
    while True:
        parts = staged(components(matches(reps, trees, depth, k)), "jaccard-components")
        cands = staged(_sets(docs, parts, reps, size, id_col, text_col), "jaccard-sets")
        found = staged(verified(cands, trees, depth, k, threshold), "jaccard-links")
        n, m = found.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
        if k == 1 or m >= recall * n:
            break
        k -= 1
    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("other"))
    label = components(found.where("kind = 1").select("a", "b"))
    named = texts.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")).join(links, "node", "left")
    class_id = named.groupBy("label").agg(F.min("first").alias("class_id"))
    return signed, named.join(class_id, "label").select(
        "key", "first", "label", "class_id", (F.coalesce("other", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """id, text_key, class_id, n_links of every document; ``how``: as in ``classes``."""
    signed, named = classes(docs, id_col=id_col, text_col=text_col, **how)
    return signed.select("doc", "key").join(named, "key", "left").select(
        F.col("doc").alias(id_col), F.col("key").alias("text_key"),
        F.when(F.col("n_links").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _sets(docs: DataFrame, parts: DataFrame, reps: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct shingles of the candidates, with the blocks of their components."""
    cands = reps.join(parts, "node").withColumnRenamed("label", "component")
    sums = cands.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"))
    n_blocks = F.greatest(F.ceil(F.col("nodes") / BLOCK_NODES), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    sums = staged(sums.withColumn("n_blocks", n_blocks.cast("long")), "jaccard-sizes")
    small = sums.where("n_blocks = 1").agg(F.sum("shingles")).first()[0] or 0
    cands = (cands.join(sums.select("component", "n_blocks"), "component")
                  .withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
                  .withColumn("n_bins", F.lit(1 + small // (2 * BLOCK_SHINGLES)).cast("long")))
    text = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("t", F.unhex(F.md5("text")))
    # shuffle_hash: the texts are dealt out once, but not sorted
    def beside(some: DataFrame) -> DataFrame:
        return text.join(some.hint("shuffle_hash"), (text["t"] == some["key"]) & text["d"].eqNullSafe(some["first"])).select(*out, "text")

    out = ("component", "node", "weight", "n_blocks", "block", "n_bins", "sig")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            texts = text_bytes(batch.column(len(out)))
            for at in range(0, len(texts), 256):
                values, counts = shingles(texts[at:at + 256], size)
                ends = np.cumsum(counts)
                sets = [np.unique(values[b - n:b]).astype("<u8").tobytes() for n, b in zip(counts, ends)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, len(sets)) for i in range(len(out))] + [pa.array(sets, pa.binary())],
                                                 names=[*out, "set"])

    joined = beside(cands.where("times = 1"))
    if not reps.where("times > 1").isEmpty():  # a repeated row gives its node one set all the same
        joined = joined.unionByName(beside(cands.where("times > 1")).dropDuplicates(["node"]))
    return joined.mapInArrow(run, "component long, node long, weight long, n_blocks long, block long, n_bins long, sig binary, set binary")


def keep_one(docs: DataFrame, columns, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``columns`` of one document of each class: one whose id is the class id (of
    several texts with that id the one with the least key, of rows that repeat it one).
    Classes are told apart by label, so null ids, or one id on unlike texts, lose
    nothing. Documents without words all stay."""
    signed, named = classes(docs, id_col=id_col, text_col=text_col, **how)
    least = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key"))
    reps = named.groupBy("label").agg(least.alias("r")).select("label", F.col("r.first").alias("_id"), F.col("r.key").alias("_key"))
    # how many rows repeat the kept one
    found = (signed.select("doc", "key").join(reps, F.col("doc").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
                   .groupBy(F.col("_id").alias("_keep_id"), F.col("_key").alias("_keep_key")).agg(F.count(F.lit(1)).alias("_times")))
    key = F.unhex(F.md5(text_of(text_col)))
    kept = docs.join(found.hint("shuffle_hash"), docs[id_col].eqNullSafe(found["_keep_id"]) & (key == found["_keep_key"]))
    kept = kept.select(*[docs[c] for c in columns], "_keep_id", "_keep_key", "_times")
    again = kept.where("_times > 1").dropDuplicates(["_keep_id", "_keep_key"])
    return (kept.where("_times = 1").select(*columns).unionByName(again.select(*columns))
                .unionByName(docs.where(~text_of(text_col).rlike(WORD)).select(*columns)))
