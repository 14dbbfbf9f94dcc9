"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets. A source of weight w and S words gets ``share`` of all words by
   weight, but at most ``most`` times S; what is cut off is shared again by
   weight until no target is above its limit (``targets``).
2. Blocks. Every source is dealt by hash into blocks of about ``block_words``
   words; each pass over a source (epoch) holds each of its blocks once, in an
   order permuted by hash. The target asks for exactly ``quota`` of these
   blocks, the last one in part.
3. Splitting tree. The quotas of all sources are the root. Each node gives
   its first child half of its blocks: how many of each source is drawn from
   the multivariate hypergeometric distribution, source by source, each
   conditional on the draws before (``draw_left``). Leaves are output shards, so
   shard quotas sum exactly to the source quotas.
4. Drawing. A shard takes the next ``quota`` of a source's permuted blocks, so
   shards are disjoint; rows of a shard are shuffled locally by hash.

Only DataFrame functions; what is drawn depends on hashes of ids and the seed
alone, so reruns agree. Words are counted once per text and text never moves.

Scale: rows per source are pre-aggregated to blocks; running sums go over
blocks within groups of ``GROUP`` blocks and over groups, never over the rows of
a source; rows are ordered only within their block, whose expected number of
words and rows is fixed. The tree holds one row per node with an array over
sources; its depth follows the number of blocks drawn.

Defined cases: a null source is a source of its own, last in order; null or
empty texts have size 0 and are taken with 0 words; repeated rows are rows of
their own with equal hashes, ordered by size; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import WORD, staged, text_of

GROUP = 1024


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(*cols) -> Column:
    """A hash of columns as a number from 0 to below 1."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def source_sizes(sized: DataFrame) -> DataFrame:
    """source, source_size, n_rows of rows with (source, size)."""
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))


def targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_rows, rank (by code point, null last), target.

    Sources fill up in order of limit / weight: with the sources before one
    full, it is full too unless the words that remain, shared by weight among
    it and those after it, stay below its limit. One row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    base = (sources.withColumn("rank", F.row_number().over(ordered).cast("long")).withColumn("weight", w)
                   .withColumn("limit", F.lit(most) * F.col("source_size")))
    everything = Window.partitionBy(F.lit(1))
    filling = Window.partitionBy(F.lit(1)).orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    state = base.select("*", (F.lit(share) * F.sum("source_size").over(everything)).alias("words"),
                        F.sum("weight").over(everything).alias("weights"),
                        F.coalesce(F.sum("limit").over(filling), F.lit(0.0)).alias("full_words"),
                        F.coalesce(F.sum("weight").over(filling), F.lit(0.0)).alias("full_weights"))
    level = (F.col("words") - F.col("full_words")) / (F.col("weights") - F.col("full_weights"))
    open_level = F.min(F.when(F.col("level") * F.col("weight") < F.col("limit"), F.struct("fill", "level"))).over(everything)
    state = state.select("*", level.alias("level"), (F.col("limit") / F.col("weight")).alias("fill"))
    state = state.withColumn("open_level", open_level["level"])
    target = F.when(F.col("open_level").isNull() | (F.col("open_level") * F.col("weight") >= F.col("limit")), F.col("limit"))
    return state.select("source", "source_size", "n_rows", "rank", target.otherwise(F.col("open_level") * F.col("weight")).alias("target"))


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` blocks out of ``total`` are among ``good`` ones, at
    probability ``u``: inversion outwards from the mode, with probabilities
    relative to the mode's by the ratio of neighbours. Further out than 12
    standard deviations, where no u leads, nothing is summed."""
    good, total, draws = (x.cast("double") for x in (good, total, draws))
    bad, one = total - good, F.lit(1.0)
    low, high = F.greatest(F.lit(0.0), draws - bad), F.least(good, draws)
    mode = F.greatest(low, F.least(high, F.floor((draws + 1) * (good + 1) / (total + 2)).cast("double")))
    share = good / F.greatest(total, one)
    reach = F.ceil(F.sqrt(F.greatest(draws * share * (one - share), F.lit(0.0))) * 12 + 12).cast("int")

    def widen(s, _):
        """One further on both sides of the mode. a, b: the ends; wa, wb: their
        weights; mass: of all so far; left: what is left of the aim; k: found."""
        up = F.when(s["b"] < high, s["wb"] * (good - s["b"]) * (draws - s["b"]) / ((s["b"] + 1) * F.greatest(bad - draws + s["b"] + 1, one))).otherwise(0.0)
        down = F.when(s["a"] > low, s["wa"] * s["a"] * F.greatest(bad - draws + s["a"], F.lit(0.0)) / ((good - s["a"] + 1) * F.greatest(draws - s["a"] + 1, one))).otherwise(0.0)

        def moved(w):
            up, down = w["up"], w["down"]
            open_ = s["left"].isNotNull() & s["k"].isNull()
            k = F.when(open_ & (s["left"] < up), s["b"] + 1).when(open_ & (s["left"] < up + down), s["a"] - 1).otherwise(s["k"])
            return F.struct((s["a"] - 1).alias("a"), (s["b"] + 1).alias("b"), down.alias("wa"), up.alias("wb"),
                            (s["mass"] + up + down).alias("mass"), (s["left"] - up - down).alias("left"), k.alias("k"))

        return bound(F.struct(up.alias("up"), down.alias("down")), moved)

    def run(left, k):
        start = F.struct(mode.alias("a"), mode.alias("b"), one.alias("wa"), one.alias("wb"), one.alias("mass"),
                         left.cast("double").alias("left"), k.cast("double").alias("k"))
        return F.aggregate(F.sequence(F.lit(1), reach), start, widen)

    def search(aim):
        return F.coalesce(run(aim - 1, F.when(aim < 1, mode))["k"], mode)

    return bound(u * run(F.lit(None), F.lit(None))["mass"], search).cast("long")


def draw_left(quotas: Column, node: Column, seed: int) -> Column:
    """Blocks of each source that go to a node's first child: half of the
    node's blocks, source by source from what is left of both."""
    everything = F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q)
    start = F.struct(everything.alias("total"), F.floor(everything / 2).cast("long").alias("draws"), F.array().cast("array<long>").alias("got"))

    def step(s, q):
        k = hypergeometric(q, s["total"], s["draws"], unit(F.lit(seed), node, F.size(s["got"])))
        return bound(k, lambda k: F.struct((s["total"] - q).alias("total"), (s["draws"] - k).alias("draws"), F.concat(s["got"], F.array(k)).alias("got")))

    return F.aggregate(quotas, start, step)["got"]


def shard_quotas(quota: DataFrame, levels: int, seed: int) -> DataFrame:
    """(rank, quota) to (shard, rank, quota, before): the leaves of the tree;
    before: the source's blocks in earlier shards."""
    root = quota.groupBy().agg(F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("s"))
    nodes = root.select(F.lit(1).cast("long").alias("node"), F.col("s.rank").alias("ranks"), F.col("s.quota").alias("q"))
    for level in range(levels):
        halves = nodes.select("node", "ranks", "q", draw_left(F.col("q"), F.col("node"), seed).alias("l"))
        rest = F.zip_with("q", "l", lambda q, x: q - x)
        both = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("q")),
                       F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("q")))
        nodes = halves.select("ranks", F.explode(both).alias("c")).select("c.node", "ranks", "c.q")
        if level % 6 == 5:
            nodes = nodes.repartition("node")
    leaves = nodes.select((F.col("node") - (1 << levels)).alias("shard"), F.explode(F.arrays_zip("ranks", "q")).alias("e"))
    leaves = leaves.select("shard", F.col("e.ranks").alias("rank"), F.col("e.q").alias("quota"))
    ahead = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("before", F.coalesce(F.sum("quota").over(ahead), F.lit(0)).cast("long"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, block_words: int = 1 << 16, shard_blocks: int = 64,
        seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, text_hash and
    takes, an array of (epoch, shard, words, place): the epochs that draw the row,
    the output shard of each, the first so many words of the row it takes, and
    where the row stands in the shard's shuffled order. ``keep``: further columns
    to hand on, of other names than these."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
                        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), *keep)
    sized = staged(sized, "mix-sizes")
    goals = targets(source_sizes(sized), weights, share, most)
    goals = staged(goals.withColumn("n_blocks", F.greatest(F.lit(1), F.round((F.col("source_size") + F.col("n_rows")) / block_words)).cast("long")), "mix-targets")
    few = goals.count() <= 100_000  # one row per source; beyond this the joins shuffle
    side = F.broadcast(goals) if few else goals
    rows = sized.join(side, sized["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id", "text_hash"), F.col("n_blocks")))

    # Each source's tape: the blocks of all epochs in permuted order. The order is by group, then by hash
    # within the group, so that running sums never need more than a group or the list of groups together.
    blocks = staged(rows.groupBy("rank", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    tape = blocks.join(side, "rank").select("rank", "block", "words", "target", "n_blocks",
                                            F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("epoch"))
    tape = tape.withColumn("key", F.xxhash64(F.lit(seed), F.lit("tape"), "rank", "epoch", "block"))
    tape = tape.withColumn("group", F.pmod("key", F.ceil(F.col("n_blocks") / GROUP)))
    sums = tape.groupBy("rank", "epoch", "group").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("rank").orderBy("epoch", "group").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select("rank", "epoch", "group", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"),
                        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("rank", "epoch", "group").orderBy("key", "block").rowsBetween(Window.unboundedPreceding, -1)
    tape = (tape.join(heads, ["rank", "epoch", "group"])
                .select("rank", "block", "epoch", "words", F.round("target").cast("long").alias("goal"),
                        (F.col("w0") + F.coalesce(F.sum("words").over(inside), F.lit(0))).alias("words_before"),
                        (F.col("n0") + F.count(F.lit(1)).over(inside)).alias("number")))
    # What the target asks for is the start of the tape.
    drawn = staged(tape.where("words_before < goal").select(
        "rank", "block", "epoch", "words", "number", F.least("words", F.col("goal") - F.col("words_before")).alias("room")), "mix-drawn")

    # Each shard takes the next quota of a source's blocks.
    total = drawn.count()
    levels = max(0, (-(-total // shard_blocks) - 1).bit_length())
    quotas = shard_quotas(drawn.groupBy("rank").agg(F.count(F.lit(1)).alias("quota")), levels, seed).where("quota > 0")
    places = quotas.select("rank", "shard", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("quota") - 1)).alias("number"))
    per_block = (drawn.join(places, ["rank", "number"]).groupBy("rank", "block")
                      .agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "words", "room"))).alias("draws")))

    # A block taken whole gives its rows whole; of the last one, rows in hash order up to the target.
    ahead = (Window.partitionBy("rank", "block").orderBy(F.xxhash64(F.lit(seed), F.lit("row"), "id", "text_hash"), "id", "size", *keep)
                   .rowsBetween(Window.unboundedPreceding, -1))
    out = rows.join(per_block, ["rank", "block"], "left").withColumn("at", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    words = lambda d: F.greatest(F.lit(0), F.least(F.col("size"), d["room"] - F.col("at"))).cast("long")
    takes = F.transform("draws", lambda d: F.struct(
        d["epoch"].alias("epoch"), d["shard"].alias("shard"), words(d).alias("words"),
        F.xxhash64(F.lit(seed), F.lit("shuffle"), F.col("id"), F.col("text_hash"), d["epoch"]).alias("place")))
    takes = F.filter(F.coalesce(takes, F.array()), lambda t: (t["words"] > 0))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "text_hash", takes.alias("takes"), *keep)


def taken(takes: Column) -> Column:
    """Words that all epochs together take of a row."""
    return F.aggregate(takes, F.lit(0).cast("long"), lambda s, t: s + t["words"])


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, n), "")
