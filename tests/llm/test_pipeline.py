"""Every stage of the pipeline against a brute-force version, on its predecessor's rows."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.conftest import SF
from tests.llm.test_set_operators import WORD, brute_join, brute_targets, encoded
from tests.llm.test_text_operators import brute_lines, brute_measures
from tillsight.llm import quality


@pytest.fixture(scope="module")
def frames(spark, odd, tmp_path_factory):
    """(input, output) of each stage on the given documents and the odd rows together."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(odd.select(docs.columns)).unionByName(docs.where("doc_id < 5"))
    out, folder = [], tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        done = spark.read.parquet(f"{folder}/{k}")
        out.append((docs.collect(), done.collect(), done.columns))
        docs = done
    return out


def pairs(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_names_and_columns(frames):
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources", "packing"]
    for _, done, columns in frames[:-1]:
        assert columns == list(pipeline.COLUMNS) and all(r["n_chars"] == len(r["text"]) for r in done if r["text"] is not None)


def test_quality_stage(frames, spark):
    before, after, _ = frames[0]
    judged = quality.judge(spark.createDataFrame(before), spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {(r["doc_id"], r["text_hash"]) for r in judged.where("kept").collect()}
    hashed = spark.createDataFrame(before).select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    assert pairs(after) == Counter((r["doc_id"], r["text"]) for r in hashed if (r["doc_id"], r["h"]) in kept)
    assert not any(brute_measures(r["text"])[5] for r in after)


def test_line_stage(frames):
    before, after, _ = frames[1]
    want = [(d, t) for d, t, _, _ in brute_lines([(r["doc_id"], r["text"]) for r in before], 10)]
    assert pairs(after) == Counter(want)


def test_near_duplicate_stage(frames):
    before, after, _ = frames[2]
    classes = brute_join([(r["doc_id"], r["text"]) for r in before])
    keep = {d for d, c, _ in classes if d == c}
    empty = Counter(r["doc_id"] for r in before if not WORD.search(r["text"]))  # similar to nothing: all stay
    assert Counter(r["doc_id"] for r in after) == Counter({d: empty.get(d, 1) for d in keep})
    assert set(pairs(after)) <= set(pairs(before))


def test_mix_stage(frames):
    before, after, _ = frames[3]
    texts, sizes, taken = {r["doc_id"]: r["text"] for r in before}, Counter(), Counter()
    for r in before:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    times, cut = Counter(), 0
    for r in after:
        whole = texts[r["doc_id"]]
        assert r["text"] == whole or whole.startswith(r["text"])
        cut += r["text"] != whole
        times[r["doc_id"]] += 1
        taken[r["source"]] += len(WORD.findall(r["text"]))
    want = brute_targets(sizes)
    assert max(times.values()) <= 2 and cut <= len(sizes)
    assert all(abs(taken[s] - float(want[s])) <= 1 for s in sizes)
    assert all(WORD.search(r["text"]) for r in after)


def test_mix_stage_writes_shards_in_their_order(spark, tmp_path):
    rows = [(i if i % 3 else None, " ".join(f"t{i}w{k}" for k in range(5 + i % 9)), "en", "ab"[i % 2]) for i in range(300)]
    rows += [rows[1]] * 4 + [(*rows[1][:2], "fr", "a"), (*rows[1][:2], "fr", "b"), (7, "", "en", "a"), (7, None, None, None)]  # repeated rows, and ones that differ elsewhere
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    how = dict(block_words=64, shard_blocks=8)
    pipeline.mix_sources(spark, docs, SF, **how).write.parquet(f"{tmp_path}/mixed")
    got = []
    for f in sorted(os.listdir(f"{tmp_path}/mixed")):
        if f.endswith(".parquet"):
            part = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{tmp_path}/mixed/{f}").coalesce(1).collect()]
            got.append(part)
    hashed = {r["h"]: r["text"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    shards = defaultdict(list)
    for r in pipeline.mix.mix(docs, keep=("lang",), **how).collect():
        for t in r["takes"]:
            text = " ".join(hashed[r["text_hash"]].split(" ")[:t["words"]])
            shards[t["shard"]].append((t["place"], t["words"], (r["doc_id"], text, r["lang"], r["source"])))
    assert len(shards) >= 4 and sum(map(len, got)) == sum(map(len, shards.values()))
    text_of = lambda row: row[:2]  # noqa: E731  # equal rows of other lang share their place
    for s in shards.values():
        want = [x[2] for x in sorted(s, key=lambda x: x[:2])]
        runs = [part[i:i + len(want)] for part in got for i in range(len(part))]
        assert any(list(map(text_of, x)) == list(map(text_of, want)) and Counter(x) == Counter(want) for x in runs)


def test_packing_stage(frames):
    before, after, _ = frames[4]
    ids = defaultdict(list)
    for p in after:
        ids[p["doc_id"]].append((p["doc_tokens"], p["start"], np.frombuffer(bytes(p["ids"]), "<u4").tolist()))
    want = Counter()
    for r, x in zip(before, encoded([r["text"] for r in before])):
        want[r["doc_id"], len(x)] += len(x)
    have = Counter()
    for d, parts in ids.items():
        for n, _, x in parts:
            have[d, n] += len(x)
    assert have == want
    by_seq = Counter()
    for p in after:
        by_seq[p["sequence_id"]] += p["length"]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in by_seq.values())


def test_run_writes_in_the_shared_folder(spark):
    done = pipeline.run(spark, SF)
    folder = spark.conf.get("spark.checkpoint.dir")
    assert done.count() > 0 and all(folder.rstrip("/") in f for f in done.inputFiles()) and os.path.isdir(folder.removeprefix("file:"))


def test_empty_documents_go_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
