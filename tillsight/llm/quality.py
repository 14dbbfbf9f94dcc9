"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Each word gives two n-grams: the word itself and the character 3-gram at its
end. Both are hashed into ``buckets`` cells. Two multinomials with add-one
smoothing are counted over all documents: ``raw`` over every text, ``target``
over texts labelled as trusted. A document's score is the sum of
log(target / raw), to four decimals, over its n-grams divided by their number. Every document
whose score is below one threshold is rejected. The threshold is read off the
histogram of scores of all labelled documents (cells of ``CELL``): the middle of
the cut that tells trusted from untrusted ones best. Without untrusted labels
it lies ``MARGIN`` below the lowest trusted score; without any labels nothing is
rejected beyond the base rules.

Only DataFrame functions. Word features of a text stay in arrays of its row; the
corpus counts are aggregated per task before their shuffle (2 x ``buckets``
cells at most), and those cells are all that reaches the driver.

Defined cases: a null or empty text has no words, fails the base rules and has
a null score; repeated rows count and are judged as rows of their own; labels
with null or repeated ids count once (trusted wins); empty tables give no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import WORD, staged, text_of

CELL, MARGIN = 0.001, 0.05
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def grams(word: Column, buckets: int) -> Column:
    """The cells of a word's n-grams: words below ``buckets``, endings above."""
    return F.array(F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int"),
                   (F.pmod(F.xxhash64(F.right(word, F.lit(3))), F.lit(buckets)) + buckets).cast("int"))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> list:
    """log(target / raw) of each of the 2 x ``buckets`` cells, in order."""
    good = trusted.select(F.col(id_col).alias("_id"), F.lit(1).alias("good")).where(F.col("_id").isNotNull()).distinct()
    # shuffle_hash: the texts are dealt out by id once, but not sorted
    marked = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("t")).join(good.hint("shuffle_hash"), "_id", "left")
    each = marked.select("good", F.explode(F.split("t", SPACE)).alias("w")).where("w != ''")
    cells = (each.select("good", F.explode(grams(F.col("w"), buckets)).alias("g"))
                 .groupBy("g").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target")))
    side = (F.col("g") >= buckets).cast("int")
    total = Window.partitionBy(side)  # 2 x buckets rows at most
    ratio = F.log((F.col("target") + 1) / (F.sum("target").over(total) + buckets)) - F.log((F.col("raw") + 1) / (F.sum("raw").over(total) + buckets))
    found = {r[0]: r[1] for r in cells.select("g", F.round(ratio, 4).alias("x")).collect()}
    return [found.get(g, 0.0) for g in range(2 * buckets)]


def measures(docs: DataFrame, ratios: list, keep: tuple = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score and
    the ``keep`` columns (as struct ``row``), one pass over the texts."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    buckets = len(ratios) // 2
    df = docs.select(F.struct(id_col, *keep, F.xxhash64(F.col(text_col).cast("string")).alias("text_hash")).alias("row"), text_of(text_col).alias("t"))
    df = df.select("row", "t", words_of(F.col("t")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select("row", F.size("w").cast("long").alias("n_words"),
                   (F.length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
                   F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                   lines.alias("lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
                   F.transform("w", lambda x: F.xxhash64(F.right(x, F.lit(3)))).alias("e"))

    def ratio(hashes: Column, above: int):
        return F.aggregate(hashes, F.lit(0.0), lambda s, x: s + F.get(table, (F.pmod(x, F.lit(buckets)) + above).cast("int")))

    three = F.transform(F.slice("h", 1, F.greatest(F.size("h") - 2, F.lit(0))),
                        lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2)))
    df = df.select("row", "n_words", "word_chars", "n_symbols",
                   (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                   ((ratio(F.col("h"), 0) + ratio(F.col("e"), buckets)) / (2 * F.nullif(F.size("h"), F.lit(0)))).alias("score"),
                   three.alias("g"))
    # Windows found twice: equal neighbours among the sorted (hash, place) pairs; most texts have none.
    pairs = F.when(F.size(F.array_distinct("g")) < F.size("g"),
                   F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    df = df.withColumn("s", pairs).drop("g")
    twice = F.filter("s", lambda e, i: e["x"].eqNullSafe(F.get("s", i - 1)["x"]) | e["x"].eqNullSafe(F.get("s", i + 1)["x"]))
    places = F.sort_array(F.transform(twice, lambda e: e["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
                          lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n")))["n"]
    return df.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                     F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "score")


def threshold(scored: DataFrame) -> float | None:
    """The best cut between trusted and untrusted scores (columns ``good``
    0/1 and ``score``); the histogram has a bounded number of cells."""
    cells = (scored.where("good is not null and score is not null")
                   .groupBy(F.floor(F.col("score") / CELL).alias("cell")).agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")))
    cells = sorted((r[0], r[1], r[2] - r[1]) for r in cells.collect())
    good, bad = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not good:
        return None
    if not bad:
        return cells[0][0] * CELL - MARGIN
    best, kept_bad, lost = (-1.0, 0.0), bad, 0
    for i, (cell, g, b) in enumerate(cells):
        # a cut between the cell before and this one
        gain = (1 - lost / good) + (1 - kept_bad / bad)
        if gain > best[0]:
            below = cells[i - 1][0] + 1 if i else cell
            best = (gain, (below + cell) / 2 * CELL)
        lost, kept_bad = lost + g, kept_bad - b
    return best[1]


def judge(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 14, min_words: int = 50, max_repeat: float = 0.5,
          keep: tuple = (), id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """id, text_hash, the measures, base_failed, score, threshold, kept and the ``keep`` columns of every row."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).groupBy(
        F.col(id_col).alias("_id")).agg(F.max(F.col(quality_col).cast("long")).alias("good"))
    ratios = log_ratios(docs, marks.where("good = 1").withColumnRenamed("_id", id_col), buckets, id_col, text_col)
    m = measures(docs, ratios, keep, id_col, text_col)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.lit(max_repeat) * F.col("n_words"))
    m = staged(m.withColumn("base_failed", failed), "quality-measures")
    scored = m.where(~F.col("base_failed")).select(F.col("row")[id_col].alias("_id"), "score").join(marks, "_id")
    cut = threshold(scored)
    passed = F.lit(True) if cut is None else F.coalesce(F.col("score") >= F.lit(cut), F.lit(False))
    return m.select("row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score",
                    F.lit(cut).cast("double").alias("threshold"), (~F.col("base_failed") & passed).alias("kept"))
