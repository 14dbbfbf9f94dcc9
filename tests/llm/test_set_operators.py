"""Top-k search, Jaccard join, mixing, token-id store, packing, pipeline, registration."""

import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import SF
from tillsight.llm import dac, jaccard, mix, mtree, packing, register, shingles, tokens

FILE = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sorted_rows(rows):
    return sorted(rows, key=repr)


# top-k search

def brute_top(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, v) for i, v in ok if sum(x * x for x in v) < 2 ** 62]  # scores fit in a long
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        vs = [v for i, v in ok if i == q]
        mine = min(vs, key=lambda v: np.array(v, "<i8").tobytes())
        scores = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in ok if i != q and len(v) == len(mine))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def test_top_k_is_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 700)]  # a third are one vector: ties and equal pages
    rows += [(700, None), (710, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (720, [float("nan")] * 6), (730, [1e30] * 6), (None, [1.0] * 6), (740, []), (750, []),
             (10, rows[10][1]), (20, [2.0] * 6), (760, [1.0, 2.0]), (770, [3.0, 2.0]), (760, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "?") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    for most, block in ((64, 16), (10_000, 2048)):
        got = mtree.top_k(df, F.col("id") % 10 == 0, k=5, pivots=8, most=most, block=block)
        assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 5, 10)
    assert mtree.top_k(df.where("false"), F.col("id") % 10 == 0).count() == 0


def test_top_k_of_a_repeated_query_row(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(100, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for times in (2, 7):  # rows of the query itself score highest, in the second case there are more than k
        rows = [(i, [float(v) for v in x[i]]) for i in [*range(100), *[0] * (times - 1)]]
        got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0, k=5)
        assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 5, 10)


def test_top_k_of_long_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [300000.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0]), (100, [-4e6, 5e6]), (7, [4e6, 5e6 + 0.0039]), (8, [1e300, 0.0])]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, k=5)
    want = brute_top(rows, 5, 50)
    assert {q for q, *_ in want} == {0, 50, 100} and sorted(tuple(r) for r in got.collect()) == want


def test_tree_leaves_out_most_distances():
    rng = np.random.default_rng(1)
    x = (np.repeat(rng.normal(size=(40, 8)) * 1000, 50, axis=0) + rng.normal(size=(2000, 8)) * 5).astype(np.int64)
    tree = mtree.Tree(np.arange(2000), x, float((x * x).sum(1).max()), leaf=64)
    for q in range(0, 2000, 100):
        got = sorted(tree.search(x[q], q, 5, None), key=lambda r: (-r[0], r[1]))
        want = sorted(((int(x[j] @ x[q]), j) for j in range(2000) if j != q), key=lambda r: (-r[0], r[1]))[:5]
        assert got == want
    assert tree.computed < 0.3 * 20 * 2000


# Jaccard join

def test_repeated_rows_have_one_set(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text)] * 300 + [(None, text + " more"), (5, "a b c d e f"), (5, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = []
    plain, jaccard.staged = jaccard.staged, lambda d, name: seen.append((name, plain(d, name))) or seen[-1][1]
    try:
        got = jaccard.join(df).collect()
    finally:
        jaccard.staged = plain
    assert [d.count() for name, d in seen if name == "jaccard-nodes"] == [3] and all(d.count() <= 3 for name, d in seen if name == "jaccard-sets")
    assert sorted((r.doc_id or 0, r.n_links) for r in got) == [(0, 300)] * 301 + [(5, 1)] * 2


def brute_sets(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_join(rows, threshold=Fraction(4, 5)):
    sets, n = [brute_sets(t) for _, t in rows], len(rows)
    links, up = [0] * n, list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                both = len(a & b)
                if both >= threshold * (len(a) + len(b) - both):
                    links[i] += 1
                    links[j] += 1
                    up[root(i)] = root(j)
    group = defaultdict(list)
    for i in range(n):
        group[root(i)].append(rows[i][0])
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return sorted_rows((rows[i][0], least(group[root(i)]), links[i]) for i in range(n))


def test_jaccard_join_is_brute_force(odd, spark):
    mid = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    near = []
    for i in range(700):  # a group beyond one block, similarities around the threshold
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 5)):
            w[k] = f"x{rng.integers(0, 40)}"
        near.append((i, " ".join(w)))
    group = spark.createDataFrame(near, "doc_id long, text string").repartition(4)
    for frame in (odd, group, mid):
        rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
        got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.join(frame).collect()]
        assert sorted_rows(got) == brute_join(rows)
    assert jaccard.join(odd.where("false")).count() == 0


def test_prefix_is_shortened_until_the_recall(docs):
    assert [jaccard.matched_depth(0.8, 24, 12, r) for r in (0.5, 0.9, 0.999, 0.99999)] == [12, 10, 6, 4]
    text = "a b c d e f g"
    values, counts = shingles.shingles([text.encode(), b"", b"A  b\tC", b" \n "])
    assert counts.tolist() == [3, 0, 1, 0] and len(set(values.tolist())) == 4
    sig = shingles.minhash(values, counts, 4)
    assert not sig[1].any() and sig[0].all()


def test_word_hashes_do_not_depend_on_where_they_stand():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(3000)]
    long = (" ".join(words) + " ") * 60  # several pieces
    h, n = shingles.words([long.encode(), b"x" * 1_200_000 + b" abc", " ".join(words).encode()])
    assert n.tolist() == [180_000, 2, 3000]
    assert (h[:3000] == h[-3000:]).all() and (h[177_000:180_000] == h[:3000]).all()
    assert len(set(h[:3000].tolist())) == len(set(words))


def test_keep_one_keeps_one_of_each_class(odd):
    kept = jaccard.keep_one(odd, ("doc_id", "text"))
    want = brute_join([(r["doc_id"], r["text"]) for r in odd.collect()])
    classes = Counter(c for d, c, _ in want if c is not None)
    got = Counter(r["doc_id"] for r in kept.collect())
    ids = {d for d, c, _ in want if d is not None and d == c}
    assert {d for d in got if d is not None} == ids and all(n == 1 for d, n in got.items() if d is not None) and classes


def test_keep_one_tells_classes_apart_without_ids(spark):
    null, other = (" ".join(f"{x}{i}" for i in range(100)) for x in "wv")
    rows = [(None, f"null {i} has five words or more") for i in range(6)]  # six classes of null ids
    rows += [(3, "one text under the id three"), (3, "quite another text with that same id")]
    rows += [(3, ""), (3, " "), (3, None), (None, None), (None, "\n"), (None, "\n")]  # without words: all stay
    copies = [rows[0], rows[7], (None, null), (None, null + " tail"), (4, other), (5, other), (None, other)]
    docs = spark.createDataFrame([(i, t, "?") for i, t in rows + copies], "doc_id long, text string, label string").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in jaccard.keep_one(docs, ("doc_id", "text")).collect())
    assert got.pop((None, null), 0) + got.pop((None, null + " tail"), 0) == 1
    assert got == Counter([*rows, (4, other)])


# mixing

def brute_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: Fraction(weights[i % 3]) for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        free = [s for s in order if s not in full]
        if not free:
            return full
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] > most * sizes[s]]
        if not over:
            return full | got
        full |= {s: Fraction(most * sizes[s]) for s in over}


def test_mix(odd, docs, spark):
    for frame, words in ((docs, 2048), (odd, 64), (docs, 1 << 16)):
        rows = Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in frame.collect())
        drawn = mix.mix(frame, block_words=words, shard_blocks=4).cache()
        got = drawn.collect()
        assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == rows
        sizes = Counter()
        for (_, s, n), k in rows.items():
            sizes[s] += n * k
        want, taken = brute_targets(sizes), Counter()
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]))
            took = sum(t["words"] for t in r["takes"])
            assert took <= 2 * r["size"] and all(0 < t["words"] <= r["size"] for t in r["takes"])
            assert len({t["epoch"] for t in r["takes"]}) == len(r["takes"])
            taken[r["source"]] += took
        slack = 0 if frame is docs else max(n for _, _, n in rows)  # rows with equal id and text are cut alike
        for s in sizes:
            assert abs(taken[s] - float(want[s])) <= 1 + slack
        again = mix.mix(frame.repartition(5), block_words=words, shard_blocks=4)
        assert sorted_rows(tuple(r) for r in again.collect()) == sorted_rows(tuple(r) for r in got)
    assert mix.mix(odd.where("false")).count() == 0


def test_hypergeometric_draws(spark):
    good, total, draws = 7, 30, 12
    u = spark.range(20_000).select(mix.hypergeometric(F.lit(good), F.lit(total), F.lit(draws), (F.col("id") + 0.5) / 20_000).alias("k"))
    n = Counter(r["k"] for r in u.collect())
    for k in range(good + 1):
        p = math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws)
        assert abs(n[k] / 20_000 - p) < 2e-4
    for g, t, d in ((0, 9, 4), (9, 9, 4), (5, 9, 0), (5, 9, 9), (0, 0, 0)):
        k = spark.range(1).select(mix.hypergeometric(F.lit(g), F.lit(t), F.lit(d), F.lit(0.7))).first()[0]
        assert max(0, d - (t - g)) <= k <= min(g, d)


def test_tree_quotas_are_exact(spark):
    quota = spark.createDataFrame([(1, 1000), (2, 1), (3, 0), (4, 333)], "rank long, quota long")
    got = mix.shard_quotas(quota, 4, 3).collect()
    assert {r: sum(x["quota"] for x in got if x["rank"] == r) for r in (1, 2, 3, 4)} == {1: 1000, 2: 1, 3: 0, 4: 333}
    per_shard = Counter()
    for x in got:
        per_shard[x["shard"]] += x["quota"]
    assert max(per_shard.values()) - min(per_shard.values()) <= 1
    ones = [x["quota"] for x in got if x["rank"] == 4]
    assert len(set(ones)) > 3  # drawn, not dealt evenly


def test_first_words(spark):
    df = spark.createDataFrame([(" a  bb\tc\nd ",)], "t string")
    got = df.select(*[mix.first_words(F.col("t"), F.lit(n)).alias(f"n{n}") for n in range(6)]).first()
    assert [len(WORD.findall(x)) for x in got] == [0, 1, 2, 3, 4, 4] and " a  bb\tc\nd ".startswith(got[2])


# token ids

@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=3000), st.sampled_from([4, 8, 12, 16]), st.data())
def test_codes_round_trip(ids, width, data):
    ids = np.array(ids, np.uint32)
    codes = dac.Codes(dac.encode(ids, width))
    assert len(codes) == len(ids) and (codes.run(0, len(ids)) == ids).all()
    if len(ids):
        i = data.draw(st.integers(0, len(ids) - 1))
        j = data.draw(st.integers(i, len(ids)))
        assert codes[i] == ids[i] and (codes.run(i, j) == ids[i:j]).all()


def encoded(texts):
    t = Tokenizer.from_file(FILE)
    return [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store_is_brute_force(odd, docs, spark, tmp_path):
    for k, frame in enumerate((docs, odd, odd.where("false"))):
        dac.write(frame, f"{tmp_path}/{k}", FILE, shard_tokens=5000)
        got = sorted((tuple(r) for r in dac.read(spark, f"{tmp_path}/{k}").collect()), key=lambda r: r[1])
        rows = sorted(((r["doc_id"], r["text"] or "") for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want, at = [], 0
        for (d, _), ids in zip(rows, encoded([t for _, t in rows])):
            want.append((d, at, len(ids), crc(ids)))
            at += len(ids)
        if frame is odd:  # a null text is as an empty one, but comes before it
            assert sorted_rows((r[0], r[2], r[3]) for r in got) == sorted_rows((r[0], r[2], r[3]) for r in want)
            assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
        else:
            assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 \t\x1c  'ts.é́Σσ<|endoftext|>中", max_size=60))
def test_word_memo_is_the_library(text):
    global _M
    if "_M" not in globals():
        _M = tokens.WordMemo(FILE, most=50), Tokenizer.from_file(FILE)
    memo, library = _M
    assert np.frombuffer(memo.encode([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


# packing

@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=9), st.integers(1, 90))
def test_closest_multiset(lengths, space):
    counts = Counter(lengths)
    got = packing.closest_multiset(dict(counts), space)
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums}
    assert all(n <= counts[k] for k, n in got.items())
    assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= space)


def test_packing_keeps_remainders_only():
    import tracemalloc
    tracemalloc.start()
    stream = ((i, np.arange(4096 * 100 + 5, dtype="<u4")) for i in range(200))
    most = 0
    for _ in packing.pack_stream(stream, 4096, 2048):
        most = max(most, tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert most < 20e6  # 200 texts of 1.6 MB each


def test_packing_is_whole_and_full(odd, docs, spark):
    for frame, capacity in ((docs, 4096), (odd, 64), (docs, 256)):
        rows = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
        want = Counter((d, len(i), crc(i)) for (d, _), i in zip(rows, encoded([t for _, t in rows])))
        pieces, by_seq, by_doc = packing.pack(frame, FILE, capacity=capacity, window=64).collect(), defaultdict(list), defaultdict(list)
        for p in pieces:
            ids = np.frombuffer(bytes(p["ids"]), "<u4")
            assert len(ids) == p["length"]
            by_seq[p["sequence_id"]].append(p)
            by_doc[p["doc_id"], p["doc_tokens"]].append((p["start"], ids))
        for seq in by_seq.values():
            at = 0
            for p in sorted(seq, key=lambda p: p["offset"]):
                assert p["offset"] == at
                at += p["length"]
            assert at <= capacity and at & (at - 1) == 0  # full, or a power of two: no padding
        have = Counter()
        for (d, n), parts in by_doc.items():
            parts = sorted(parts, key=lambda x: x[0])
            if sum(len(x) for _, x in parts) == n:  # one row of this id and length
                assert [s for s, _ in parts] == np.cumsum([0] + [len(x) for _, x in parts[:-1]]).tolist()
                have[d, n, crc(np.concatenate([x for _, x in parts]))] += 1
            else:
                assert sum(len(x) for _, x in parts) == n * sum(k for (a, b, _), k in want.items() if (a, b) == (d, n))
                have.update({w: k for w, k in want.items() if w[:2] == (d, n)})
        assert have == want
    assert packing.pack(odd.where("false"), FILE).count() == 0


# registration

def test_queries_match_their_sql(spark, duck):
    queries, oracles = register.queries(), register.oracles()
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries] == list(range(1, 11))
    for name, sql in oracles.items():
        df = queries[name](spark, SF)
        want = duck.execute(sql).fetchdf()
        columns = sorted(df.columns)
        assert columns == sorted(want.columns), name
        assert sorted_rows(tuple(r) for r in df.select(columns).collect()) == sorted_rows(want[columns].itertuples(index=False, name=None)), name


def test_native_plans(spark):
    for name in ("op4_quality_rules", "op5_secret_scan", "op7_source_mix"):
        df = register.queries()[name](spark, SF)
        assert not re.search(r"Python|Arrow|Pandas|CartesianProduct|NestedLoop", df._jdf.queryExecution().toString()), name
