"""Training-data pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns the next stage's documents (doc_id, text, lang, source, n_chars), the
last one the packed pieces. ``run`` writes each stage's result as Parquet in the
shared checkpoint folder and reads it back for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import jaccard, line_dedup, mix, packing, quality
from tillsight.llm.common import staged
from tillsight.llm.register import table, tokenizer
from tillsight.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    verdict = judged.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    # shuffle_hash: the texts are dealt out by id once, but not sorted
    kept = docs.join(verdict.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(verdict["_id"]) & (F.xxhash64("text") == verdict["_hash"]), "left_semi")
    return kept.select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold. Lines go, documents
    do not: one that had only such lines stays with an empty text (the mix, which
    draws words, is what leaves it out)."""
    done = line_dedup.dedup(docs, min_docs=10, min_chars=1, keep=("lang", "source"))
    return done.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs, COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, **how) -> DataFrame:
    """Each document as often as the mix takes it; the last take of a source may cut one
    document. A shard lies in one partition, in its shuffled order, so that packing
    reads mixed shards. Rows of equal id, text, source and lang are interchangeable:
    they become one row, which is given the takes of all of them. ``how``: as in ``mix.mix``."""
    same = ["_id", "_hash", "_source", "_lang"]
    drawn = mix.mix(docs, keep=("lang",), **how)
    drawn = staged(drawn.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("source").alias("_source"),
                                F.col("lang").alias("_lang"), "size", "takes"), "pipeline-takes")
    groups = drawn.groupBy(*same).agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("times"), F.first("takes").alias("takes"))
    groups = groups.where("times > 1 or size(takes) > 0").hint("shuffle_hash")
    found = docs.join(groups, docs["doc_id"].eqNullSafe(groups["_id"]) & (F.xxhash64("text") == groups["_hash"])
                      & docs["source"].eqNullSafe(groups["_source"]) & docs["lang"].eqNullSafe(groups["_lang"]))
    once = found.where("times = 1").select(*COLUMNS, "size", "takes")
    of_all = drawn.groupBy(*[F.col(c).alias(f"{c}s") for c in same]).agg(F.flatten(F.collect_list("takes")).alias("of_all"))
    again = found.where("times > 1").dropDuplicates(same).join(
        of_all, F.col("_id").eqNullSafe(F.col("_ids")) & (F.col("_hash") == F.col("_hashs"))
        & F.col("_source").eqNullSafe(F.col("_sources")) & F.col("_lang").eqNullSafe(F.col("_langs")))
    out = once.unionByName(again.select(*COLUMNS, "size", F.col("of_all").alias("takes")))
    out = out.select(*COLUMNS, "size", F.explode("takes").alias("t")).select(*COLUMNS, "size", "t.shard", "t.place", "t.words")
    text = F.when(F.col("words") >= F.col("size"), F.col("text")).otherwise(mix.first_words(F.col("text"), F.col("words")))
    out = out.withColumn("text", text).repartition("shard").sortWithinPartitions("shard", "place", "words")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    return packing.pack(docs, tokenizer())


STAGES = [("quality rules", quality_rules), ("line dedup", drop_lines), ("n-gram Jaccard join", near_duplicates),
          ("mixing sources", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch_path(spark, f"llm-pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: SQL cannot express the likelihood-ratio verdict, the draws of the mix or the packing; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None
