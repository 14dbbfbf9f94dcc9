"""Embedding whitening by a block Jacobi-Davidson eigensolver.

Every entry c of a vector becomes the integer floor(scale * c) + offset. The sums of
all vectors are exact integers; every product with the covariance is one Spark job
that centres each vector before it multiplies and adds up one small block for
each partition, so the covariance itself is never formed (matrix-free).

Method. The search space V starts from a seeded random block. Rayleigh-Ritz on V
gives the leading Ritz pairs (theta, u) with residuals r = A u - theta u. Pairs whose
residual is at the rounding level of the products (``tolerance`` times the largest
Ritz value, in double precision) are locked. For the others the projected correction equations

    (I - Q Q') (A - theta I) (I - Q Q') t = -r,   Q = [locked, current Ritz vectors],

are solved to a rough tolerance by MINRES, all columns side by side, so that one inner
step is one job whatever the number of components. The corrections, made orthogonal
to V, extend it; beyond ``space`` columns V restarts from its best Ritz vectors. It ends
when all wanted pairs are locked, or fails after ``rounds``.

What the driver holds is bounded by the vectors' length d and the number of components k: V and
A V, d x ``space`` doubles, and one d x k block for each product.

Defined cases: vectors that are null or hold null or non-finite entries, or entries whose
integer does not fit in 63 bits, take no part; vectors are fitted with those of the same
length; a null id stays; repeated rows are rows of their own; there are as many
components as the covariance has eigenvalues above rounding (``rank_tolerance``
times the largest), at most k, so one vector or equal vectors have none; empty vectors
and an empty table give no rows; equal eigenvalues get some orthonormal basis of
their space; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import ship, staged

EPS = 2.0 ** -52
CELLS = 1 << 21  # entries of vectors that a task holds as doubles at once


def integers(vectors: DataFrame, scale: float, offset: int, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, x (little-endian int64) of the vectors that take part."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not v.is_valid:
                    continue
                a = np.array(v.values.to_numpy(zero_copy_only=False) if len(v) else [], float)  # a null is NaN
                with np.errstate(over="ignore"):
                    y = np.floor(a * scale)
                if np.isfinite(y).all() and (np.abs(y) < 2.0 ** 62).all():
                    out.append((i, len(y), (y.astype(np.int64) + offset).astype("<i8").tobytes()))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["id", "dim", "x"])

    part = ship(vectors).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return part.mapInArrow(run, "id long, dim long, x binary")


def blocks(column, dim: int):
    """The vectors of an Arrow column as matrices of at most about ``CELLS`` entries: (from, int64 matrix)."""
    rows = column.to_pylist()
    step = max(1, CELLS // dim)
    for at in range(0, len(rows), step):
        part = rows[at:at + step]
        yield at, np.frombuffer(b"".join(part), "<i8").reshape(len(part), dim)


@dataclass
class Moments:
    """Number, exact sums (Python integers) of the vectors of one length."""
    dim: int
    n: int
    sums: list

    def __post_init__(self):
        whole = [divmod(s, self.n) for s in self.sums]
        self.whole = np.array([w for w, _ in whole], np.int64)                # floor of each mean
        self.rest = np.array([float(Decimal(r) / self.n) for _, r in whole])  # and what is left, below 1

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: an exact difference of integers, then one rounding."""
        return (x - self.whole).astype(float) - self.rest


def moments(x: DataFrame, dim: int) -> Moments:
    """Exact sums: 32-bit halves of each entry added up in 64 bits in a task, as decimals across tasks."""
    def run(batches):
        import pyarrow as pa
        n, low, high = 0, [0] * dim, [0] * dim
        for batch in batches:
            for _, m in blocks(batch.column(0), dim):
                n += len(m)
                low = [a + int(b) for a, b in zip(low, (m & 0xFFFFFFFF).sum(0))]
                high = [a + int(b) for a, b in zip(high, (m >> 32).sum(0))]
        if n:
            total = [Decimal(a + (b << 32)) for a, b in zip(low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total, pa.decimal128(38, 0)), pa.array([n] * dim, pa.int64())],
                                             names=["i", "s", "n"])

    parts = x.select("x").mapInArrow(run, "i int, s decimal(38,0), n long")
    rows = sorted(parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect())  # one row per dimension
    return Moments(dim, rows[0]["n"], [int(r["s"]) for r in rows])


def products(x: DataFrame, m: Moments):
    """A function W -> A W of d x b blocks, A the covariance (divisor n): one job for each call."""
    def apply(w: np.ndarray) -> np.ndarray:
        dim, width = m.dim, w.shape[1]

        def run(batches):
            import pyarrow as pa
            total = np.zeros((dim, width))
            for batch in batches:
                for _, rows in blocks(batch.column(0), dim):
                    c = m.centred(rows)
                    total += c.T @ (c @ w)
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "y"])

        parts = x.select("x").mapInArrow(run, "i int, y array<double>")
        sums = [F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(width)]
        out = np.zeros((dim, width))
        for r in parts.groupBy("i").agg(*sums).collect():  # one row per dimension
            out[r[0]] = r[1:]
        return out / m.n
    return apply


def trace_of(x: DataFrame, m: Moments) -> float:
    """Sum of the variances."""
    def run(batches):
        import pyarrow as pa
        total = 0.0
        for batch in batches:
            for _, rows in blocks(batch.column(0), m.dim):
                c = m.centred(rows)
                total += float((c * c).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["t"])

    return x.select("x").mapInArrow(run, "t double").agg(F.sum("t")).first()[0] / m.n


def _orthogonal(block: np.ndarray, *to: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the spans of ``to`` (orthonormal each)."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(3):  # again, as cancellation leaves parts along the others
        for q in to:
            block = block - q @ (q.T @ block)
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(1.0, s[0])] if s[0] > 1e-10 else block[:, :0]
    return block


def minres(product, theta: np.ndarray, q: np.ndarray, rhs: np.ndarray, steps: int, drop: float) -> np.ndarray:
    """Columns t with (I - QQ')(A - theta I)(I - QQ') t near rhs, by MINRES on all columns
    side by side: one ``product`` for each step, until every residual fell to ``drop`` of its start."""
    def project(b):
        b = b - q @ (q.T @ b)
        return b - q @ (q.T @ b)

    v = project(rhs)
    beta = np.linalg.norm(v, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v, v_old, t = v / first, np.zeros_like(v), np.zeros_like(v)
    w, w_old = np.zeros_like(v), np.zeros_like(v)
    c, c_old, s, s_old = (np.ones(len(theta)), np.ones(len(theta)), np.zeros(len(theta)), np.zeros(len(theta)))
    eta, beta = beta.copy(), np.zeros(len(theta))
    for _ in range(steps):
        y = project(product(v) - v * theta)
        alpha = (v * y).sum(0)
        y = y - alpha * v - beta * v_old
        y = project(y)
        beta_new = np.linalg.norm(y, axis=0)
        # the newest column of the tridiagonal matrix under the last two rotations, and the next rotation
        d = c * alpha - c_old * s * beta
        r1 = np.hypot(d, beta_new)
        r2, r3 = s * alpha + c_old * c * beta, s_old * beta
        safe = np.where(r1 > 0, r1, 1.0)
        c_old, c, s_old, s = c, np.where(r1 > 0, d / safe, 1.0), s, beta_new / safe
        w, w_old = np.where(r1 > 0, (v - r3 * w_old - r2 * w) / safe, 0.0), w
        t = t + (c * eta) * w
        eta = -s * eta
        alive = beta_new > 1e-14 * np.maximum(1.0, np.abs(theta))
        v_old, v, beta = v, np.where(alive, y / np.where(alive, beta_new, 1.0), 0.0), np.where(alive, beta_new, 0.0)
        if (np.abs(eta) <= drop * first).all():
            break
    return project(t)


def eigenpairs(product, dim: int, k: int, space: int | None = None, steps: int = 8, rounds: int = 200, tolerance: float | None = None,
               rank_tolerance: float = 1e-13, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors (d x k) of the symmetric positive
    semi-definite operator ``product``; fewer where eigenvalues are zero to rounding."""
    k = min(k, dim)
    space = min(dim, max(space or 4 * k, k + 8))
    tolerance = tolerance or 64 * EPS
    random = np.random.default_rng(seed)
    v = _orthogonal(random.standard_normal((dim, min(dim, k + 4))))
    av = product(v)
    locked, a_locked = np.zeros((dim, 0)), np.zeros((dim, 0))
    for _ in range(rounds):
        basis, a_basis = np.hstack([locked, v]), np.hstack([a_locked, av])
        h = basis.T @ a_basis
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, au = basis @ y[:, :k], a_basis @ y[:, :k]
        residual = au - u * theta[:k]
        size = np.linalg.norm(residual, axis=0)
        done = size <= tolerance * max(theta[0], 0.0)
        if not theta[0] > 0:
            return np.zeros(0), np.zeros((dim, 0))
        if done.all():
            keep = theta[:k] > rank_tolerance * theta[0]
            return theta[:k][keep], u[:, keep]
        n_locked = int(np.argmin(done))  # converged pairs in front are locked
        locked, a_locked = u[:, :n_locked], au[:, :n_locked]
        open_ = ~done
        t = minres(product, theta[:k][open_], u, -residual[:, open_], steps, 1e-2)
        if basis.shape[1] + t.shape[1] > space:  # restart: the best Ritz vectors beyond the locked ones
            keep = min(basis.shape[1], max(k + 4, space - t.shape[1]))
            v, av = basis @ y[:, n_locked:keep], a_basis @ y[:, n_locked:keep]
        else:
            v, av = basis @ y[:, n_locked:], a_basis @ y[:, n_locked:]
        new = _orthogonal(t, locked, v)
        if not new.shape[1]:
            new = _orthogonal(random.standard_normal((dim, min(k, dim - locked.shape[1] - v.shape[1]))), locked, v)
        if new.shape[1]:
            v, av = np.hstack([v, new]), np.hstack([av, product(new)])
    raise RuntimeError(f"residuals {size.max():.3g} after {rounds} rounds")


@dataclass
class Model:
    """What whitening needs for the vectors of one length."""
    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.moments.centred(x) @ (self.vectors / np.sqrt(self.values))


def identity_error(x: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened vectors' covariance (centred first) minus the identity."""
    k, n, dim = len(model.values), model.moments.n, model.moments.dim
    if not k:
        return 0.0

    def summed(of):
        def run(batches):
            import pyarrow as pa
            total = None
            for batch in batches:
                for _, rows in blocks(batch.column(0), dim):
                    part = of(model.whiten(rows))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "y"])

        parts = x.select("x").mapInArrow(run, "i int, y double").groupBy("i").agg(F.sum("y")).collect()  # at most k * k rows
        out = np.zeros(len(parts))
        for i, y in parts:
            out[i] = y
        return out / n

    mean = summed(lambda z: z.sum(0))
    return float(np.abs(summed(lambda z: (z - mean).T @ (z - mean)).reshape(k, k) - np.eye(k)).max())


def fit(x: DataFrame, dim: int, k: int, **solver) -> Model:
    m = moments(x, dim)
    values, vectors = eigenpairs(products(x, m), dim, k, **solver)
    model = Model(m, values, vectors, trace_of(x, m))
    model.identity_error = identity_error(x, model)
    return model


def deviations(rows: np.ndarray, m: Moments) -> list[int]:
    """Exact sums over the dimensions of (n x - S)^2, as Python integers."""
    rest = np.array([s - int(w) * m.n for s, w in zip(m.sums, m.whole)], dtype=object)
    apart = rows - m.whole
    most = int(np.abs(apart).max(initial=0)) + 1
    if m.dim * (most * m.n) ** 2 < 2 ** 63:
        y = apart * m.n - rest.astype(np.int64)
        return (y * y).sum(1).tolist()
    y = apart.astype(object) * m.n - rest
    return (y * y).sum(1).tolist()


def whiten(vectors: DataFrame, k: int = 32, scale: float = 64.0, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding",
           **solver) -> DataFrame:
    """vec_id, dim, n, deviation (decimal, exact; null beyond 38 digits), whitened (array), explained (array: share
    of the total variance of each component), identity_error; one row for each vector that takes part."""
    spark = vectors.sparkSession
    x = staged(integers(vectors, scale, offset, id_col, vector_col), "white-vectors")
    schema = "vec_id long, dim long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    out = None
    for dim, in x.select("dim").distinct().orderBy("dim").collect():  # one row per length of vectors
        if dim:
            part = _apply(x.where(F.col("dim") == dim), dim, k, schema, solver)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _apply(x: DataFrame, dim: int, k: int, schema: str, solver: dict) -> DataFrame:
    model = fit(x, dim, k, **solver)
    explained = (model.values / model.trace).tolist() if model.trace > 0 else []
    limit = 10 ** 38

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at, rows in blocks(batch.column(1), dim):
                n = len(rows)
                far = [Decimal(v) if v < limit else None for v in deviations(rows, model.moments)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n), pa.array([dim] * n, pa.int64()), pa.array([model.moments.n] * n, pa.int64()),
                    pa.array(far, pa.decimal128(38, 0)), pa.array(list(model.whiten(rows)), pa.list_(pa.float64())),
                    pa.array([explained] * n, pa.list_(pa.float64())), pa.array([model.identity_error] * n, pa.float64())],
                    names=["vec_id", "dim", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.select("id", "x").mapInArrow(run, schema)


def by_component(white: DataFrame) -> DataFrame:
    """One row for each vector and component, numbered from 1."""
    each: Column = F.posexplode(F.arrays_zip("whitened", "explained"))
    rows = white.select("vec_id", "n", "deviation", "identity_error", each.alias("c", "z"))
    return rows.select("vec_id", (F.col("c") + 1).alias("component"), "n", F.expr("try_cast(deviation AS long)").alias("deviation"),
                       F.col("z.whitened").alias("whitened"), F.col("z.explained").alias("explained"), "identity_error")
