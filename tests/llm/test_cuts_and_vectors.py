"""Fill-in-middle, whitening and nearest neighbours against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tillsight.llm import fim, onebit, register, whitening

UNITS = {
    "line": r"[^\n]*\n|[^\n]+",
    "word": r"(?s)\A[ \t\n]*[^ \t\n]*[ \t\n]*|[^ \t\n]+[ \t\n]*",
    "sentence": r"(?s)[^.!?]*[.!?]|[^.!?]+",
    "paragraph": r"(?s)(?:(?<=\n)|\A)\n|.+?(?:(?<=\n)\n|\Z)",
}


# fill-in-middle

def test_wavelet_ranks_are_counts():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        symbols = rng.integers(0, 7, n).astype(np.uint8)
        matrix = fim.WaveletMatrix(symbols)
        at = np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, 50)]))
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [int((symbols[:a] == s).sum()) for a in at]


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_units_and_cuts_are_those_of_a_pattern(unit):
    rng = random.Random(unit)
    for piece in (5, 64, fim.PIECE):
        for _ in range(6):
            texts = ["".join(rng.choice("ab é\U0001F600.?! \n\n\t") for _ in range(rng.choice([0, 0, 1, 5, 60]))) for _ in range(6)]
            units = [[u for u in re.findall(UNITS[unit], t) if u] for t in texts]
            index = fim.Classes(texts, unit, piece)
            assert index.units().tolist() == [len(u) for u in units]
            for share in (0, 0.4, 1):
                number = np.array([int(share * len(u)) for u in units])
                assert index.after(number).tolist() == [sum(map(len, u[:k])) for u, k in zip(units, number)]
    with pytest.raises(ValueError):
        fim.Classes([], "page")


def brute_fim(doc_id, text, rate=100, spm_rate=50, seed=7):
    text = text or ""
    lines = re.findall(UNITS["line"], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(lines), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return doc_id, len(lines), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(lines), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_of_odd_rows_is_brute_force(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(repr, map(tuple, fim.transform(odd).collect()))) == sorted(repr(brute_fim(*r)) for r in rows)
    assert fim.transform(none).count() == 0
    more = [(i, t) for i, t in enumerate(["a<P>b\n", "<\nP>x\nS>", "<S", "P>\n<", "a\n<M>", "x\r\ny\r\n\n\nz"] * 20)]
    df = spark.createDataFrame(more, "doc_id long, text string")
    done = fim.transform(df, rate=60, spm_rate=30, seed=1)
    assert sorted(map(tuple, done.collect()), key=repr) == sorted((brute_fim(i, t, 60, 30, 1) for i, t in more), key=repr)
    back = done.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in back} == dict(more)


def test_fill_in_middle_query_is_brute_force(spark, texts):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {tuple(r) for r in register.op11_fill_in_middle(spark, SF).collect()}
    want = {(*brute_fim(i, t)[:5], sha(brute_fim(i, t)[5]), sha(t or "")) for i, t in texts.items()}
    assert got == want


def test_a_long_text_is_cut_in_pieces():
    text = "\n".join(f"line {i} é" for i in range(60_000))
    index = fim.Classes(["x\n", text], "line", 1 << 16)
    assert len(index.pieces) > 10 and index.units().tolist() == [1, 60_000]
    want = sum(len(f"line {i} é\n") for i in range(33_333))
    assert index.after(np.array([1, 33_333])).tolist() == [2, want]


# whitening

def local(a):
    return lambda w: a @ w


@pytest.mark.parametrize("dim,k,kind", [(64, 32, "random"), (120, 5, "clusters"), (120, 8, "rank"), (40, 40, "decay"), (3, 32, "random"), (1, 1, "random")])
def test_eigenpairs_to_double_precision(dim, k, kind):
    rng = np.random.default_rng(dim)
    q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    e = {"random": rng.random(dim) + 0.5, "clusters": np.where(np.arange(dim) < 7, 2.0, 1.0) + rng.random(dim) * 1e-3,
         "rank": np.where(np.arange(dim) < 4, rng.random(dim) + 1, 0.0), "decay": 2.0 ** -np.arange(dim)}[kind]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.eigenpairs(local(a), dim, k)
    assert len(values) == min(k, dim, int((e > 0).sum()))
    assert np.abs(values - np.sort(e)[::-1][:len(values)]).max() < 1e-13 * e.max()
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-13 * e.max()
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_minres_solves_the_projected_equations():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((50, 50))
    a = a + a.T
    q, _ = np.linalg.qr(rng.standard_normal((50, 6)))
    p = np.eye(50) - q @ q.T
    theta, rhs = np.array([0.3, -2.0]), p @ rng.standard_normal((50, 2))
    t = whitening.minres(local(a), theta, q, rhs, 200, 1e-12)
    for j in range(2):
        assert np.linalg.norm(p @ (a - theta[j] * np.eye(50)) @ p @ t[:, j] - rhs[:, j]) < 1e-9


def check_whitening(rows, got, k, scale=64):
    """``got``: rows of by_component for vectors of one length."""
    ok = [(i, [math.floor(scale * x) + 1_000_000 for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    n, dim = len(ok), len(ok[0][1])
    sums = [sum(v[d] for _, v in ok) for d in range(dim)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(v, sums)] for _, v in ok])
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == sorted((i, sum((n * a - s) ** 2 for a, s in zip(v, sums))) for i, v in ok)
    assert len(got) == n * k and {r["component"] for r in got} == set(range(1, k + 1)) and {r["n"] for r in got} == {n}
    for r in got:
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(cov)) - 1) < 1e-9
        assert r["identity_error"] < 1e-9
    first = {}  # whitened vectors by id: their products do not depend on signs
    for r in got:
        first.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    white = np.array([[first[i][c] for c in range(1, k + 1)] for i, _ in ok])
    back = np.linalg.lstsq(centred, white, rcond=None)[0]  # the map itself: eigenvectors over roots
    assert np.abs(centred @ back - white).max() < 1e-8
    assert np.abs(cov @ back - back * values[:k]).max() < 1e-8 * values[0] * np.abs(back).max()
    assert np.abs(back.T @ cov @ back - np.eye(k)).max() < 1e-8


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=9) * np.arange(1, 10)]) for i in range(300)]
    good += [(300 + i, good[7][1]) for i in range(150)]  # a third are one vector
    odd = [(900, None), (901, [None] + [1.0] * 8), (902, [float("nan")] * 9), (903, [float("inf")] + [0.0] * 8), (904, []), (905, [1e300] * 9)]
    df = spark.createDataFrame([(i, v, "?") for i, v in good + odd], "vec_id long, embedding array<double>, n string").repartition(5)
    check_whitening(good, whitening.by_component(whitening.whiten(df, k=4)).collect(), 4)
    check_whitening(good, whitening.by_component(whitening.whiten(df, k=32)).collect(), 32)
    assert whitening.by_component(whitening.whiten(df.where("false"))).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [3.0]), (4, [5.0])], "vec_id long, embedding array<double>")
    white = {(r["vec_id"], r["dim"]): r for r in whitening.whiten(same).collect()}
    assert white[1, 2]["whitened"] == [] and white[1, 2]["deviation"] == 0 and white[1, 2]["n"] == 2
    assert [round(abs(white[i, 1]["whitened"][0]), 12) for i in (None, 4)] == [1.0, 1.0]
    wide = spark.createDataFrame([(i, [float(i) * 1e14, -1e15]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [int(r["deviation"]) for r in whitening.whiten(wide).orderBy("vec_id").collect()] == [
        (5 * int(64 * i * 1e14) - sum(int(64 * j * 1e14) for j in range(5))) ** 2 for i in range(5)]


def test_whitening_query(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, register.op12_whitening(spark, SF).collect(), 32)


# nearest neighbours

def brute_nearest(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in ok if i % every == 0}:
        mine = min((v for i, v in ok if i == q), key=lambda v: v.tobytes())
        out[q] = sorted(((-float(onebit.products(v[None], mine)[0]), i) for i, v in ok if i != q and len(v) == len(mine)))[:k]
    return out


def test_estimates_stay_within_their_widths():
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((4000, 100)), rng.standard_normal(100)
    shard = onebit.Shard(x, [[(i, 1)] for i in range(4000)], x.mean(0))
    guess, width = shard.estimate(q, onebit.rotated(q[None])[0])
    off = (guess - x @ q) / width
    assert shard.codes.shape == (4000, 2) and abs(off.mean()) < 0.1 and 0.8 < off.std() < 1.2 and (np.abs(off) > 2.5).mean() < 0.03
    y = rng.standard_normal((5, 100))
    assert np.abs(onebit.rotated(y) @ onebit.rotated(y).T - y @ y.T).max() < 1e-10


def test_nearest_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=24)]) for i in range(600)]
    rows += [(i, rows[20][1]) for i in range(600, 1000)]  # ties: a third of all rows are one vector
    rows += [(40, rows[40][1])] * 30 + [(41, rows[41][1])] * 5 + [(60, [9.0] * 24)]  # repeated rows, a query id with two vectors
    rows += [(1000, None), (1020, [1.0, None] + [0.0] * 22), (1040, [float("nan")] * 24), (None, [1.0] * 24), (1060, [0.0] * 24), (1080, []),
             (1100, [1e200] * 24), (1101, [-1e200] * 24), (1102, [1e-200] * 24), (1120, [1.0, 2.0]), (1121, [3.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(4)
    want = brute_nearest(rows, 20, 20)
    for settings in ({}, {"most": 64, "block": 16}):
        got = {}
        for r in onebit.nearest_neighbours(df, F.col("id") % 20 == 0, k=20, epsilon=6.0, **settings).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert got.keys() == want.keys()
        for q, best in want.items():
            assert [(r, i, s) for r, i, s in got[q]] == [(r, i, -s) for r, (s, i) in enumerate(best, 1)], q
    assert onebit.nearest_neighbours(df.where("false"), F.col("id") % 20 == 0).count() == 0


def test_nearest_query_finds_the_neighbours(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = register.op13_nearest(spark, SF)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest([(r["vec_id"], list(r["embedding"])) for r in table.collect()], 20, 20)
    hits = sum(len({i for i, _ in got[q]} & {i for _, i in best}) for q, best in want.items())
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert hits >= 0.97 * 20 * len(want)
    assert abs(onebit.recall(table, found, 20) - hits / (20 * len(want))) < 0.02
