"""Tree models of all tenants at once.

Fit. Each tenant's rows (at most ``FIT_ROWS``, the reference's own bound on the rows
it fits) become one packed set of bin codes; one Spark job then grows every model
of every tenant, a task for each (tenant, model, block of trees), so neither the number
of jobs nor the plan depends on the number of tenants. A level's histogram is one
aggregation keyed by (node, feature, bin); a child's is counted for the smaller
child only and subtracted from the parent's for the other.

* random forest: bootstrapped rows, trees grown level by level;
* boosted trees "A": level by level, ridge 1, each round on the residuals;
* boosted trees "B": leaf by leaf from a queue of gains, at least 20 rows a leaf.

Values are binned per feature: a column with at most ``BINS`` distinct values (a forest's
``bins``) has a bin for each, so its splits are exact; others have quantile bins.

Models are a table: one row per (tenant, model, tree) with the tree's arrays (feature,
threshold, children, value, cover, gain), so a prediction is ``base`` + the sum of a value
from each tree, whatever the model. Rows are scored in salted chunks of a tenant
(``_beside_models``): a tenant with a third of all rows is many groups.
"""

from __future__ import annotations

import heapq
import time
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions.core import ORG, checked_broadcast, split_rank
from tillsight.operators.features import NON_FEATURES, SERIES

# Fixed values that must equal the reference's: sizes, rates and seeds of G02 random forest,
# G03 boosted trees "A", G04 boosted trees "B", and its bound on the rows used to fit. What
# it leaves to the libraries' defaults is written out.
SPECS = {
    "random_forest": dict(kind="forest", trees=100, depth=10, seed=42, bins=64),
    "xgboost": dict(kind="levels", trees=200, depth=8, rate=0.1, ridge=1.0, least_rows=1),
    "lightgbm": dict(kind="leaves", trees=200, depth=8, rate=0.1, ridge=0.0, least_rows=20, leaves=31),
}
FIT_ROWS = 50_000
BINS = 255
BLOCK = 5        # trees of a forest that one task grows
CHUNK = 16_384   # rows of a tenant scored together
NOISE = 1e-9     # gains closer than this share count as equal, as sums are rounded

MODELS = (f"{ORG} string, model string, tree int, features array<string>, base double, feature array<int>, threshold array<double>, "
          "left array<int>, right array<int>, value array<double>, cover array<double>, gain array<double>, seconds double")
ARRAYS = (("feature", np.int64), ("threshold", float), ("left", np.int64), ("right", np.int64), ("value", float), ("cover", float), ("gain", float))


# ---------------------------------------------------------------- binning

def edges_of(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Rising split points of a column: between all distinct values, or between quantiles."""
    values = np.sort(x)
    steps = np.flatnonzero(values[1:] > values[:-1])  # a value's last place
    if len(steps) >= bins:
        at = np.linspace(0, len(values) - 1, bins + 1)[1:-1].astype(int)
        steps = np.unique(steps[np.minimum(np.searchsorted(steps, at), len(steps) - 1)])
    low, high = values[steps], values[steps + 1]
    middle = low + (high - low) / 2
    return np.where(middle < high, middle, low)


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value in its column."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if edges else np.zeros((len(x), 0), np.int64)


class Binned:
    """Bin codes of a set of rows, columns one after the other in one range of bins."""

    def __init__(self, codes: np.ndarray, edges: list[np.ndarray], bins: int = BINS):
        columns = [(codes[:, j].astype(np.int64), e) for j, e in enumerate(edges)]
        columns = [self._coarser(c, e, bins) if len(e) >= bins else (c, e) for c, e in columns]
        self.edges = [e for _, e in columns]
        sizes = np.array([len(e) + 1 for e in self.edges], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.total = int(self.start[-1])
        self.codes = np.stack([c for c, _ in columns], 1) + self.start[:-1] if columns else np.zeros((len(codes), 0), np.int64)
        self.column = np.repeat(np.arange(len(edges)), sizes)  # of each bin
        self.last = np.zeros(self.total, bool)
        self.last[self.start[1:] - 1] = True                  # no split after a column's last bin

    @staticmethod
    def _coarser(codes: np.ndarray, edges: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring bins joined into at most ``bins`` of about equal counts."""
        upto = np.cumsum(np.bincount(codes, minlength=len(edges) + 1))
        keep = np.unique(np.searchsorted(upto, np.linspace(0, len(codes), bins + 1)[1:-1]))
        keep = keep[keep < len(edges)]
        return np.searchsorted(keep, codes, side="left"), edges[keep]

    def histogram(self, rows: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray | None) -> np.ndarray:
        """(2, nodes, bins): sums of g and of h (None: 1) by (node, feature, bin)."""
        if nodes > 1:  # node by node, so that the sums in use stay in the cache
            order = np.argsort(node, kind="stable")
            rows, node, g, h = rows[order], node[order], g[order], None if h is None else h[order]
        at = self.codes[rows]
        if nodes > 1:
            at += (node * self.total)[:, None]
        at, width = at.ravel(), self.codes.shape[1]
        out = np.empty((2, nodes * self.total))
        out[0] = np.bincount(at, np.repeat(g, width), nodes * self.total)
        out[1] = np.bincount(at, None if h is None else np.repeat(h, width), nodes * self.total)
        return out.reshape(2, nodes, self.total)

    def best(self, hist: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Gain and bin of the best split of each node; the first of equal ones."""
        nodes = hist.shape[1]
        gains, bins = np.empty(nodes), np.empty(nodes, np.int64)
        step = max(1, (1 << 16) // self.total)
        for a in range(0, nodes, step):  # as many nodes as the cache holds
            left_g, left_h = np.cumsum(hist[0, a:a + step], axis=1), np.cumsum(hist[1, a:a + step], axis=1)
            total_g, total_h = left_g[:, self.start[1] - 1].copy()[:, None], left_h[:, self.start[1] - 1].copy()[:, None]  # every column holds all rows
            for left in (left_g, left_h):  # less the columns before
                before = np.zeros((len(left), len(self.edges)))
                before[:, 1:] = left[:, self.start[1:-1] - 1]
                left -= before[:, self.column]
            right_g, right_h = total_g - left_g, total_h - left_h
            ok = (left_h >= least) & (right_h >= least)
            ok &= ~self.last
            left_g *= left_g
            right_g *= right_g
            left_h += ridge
            right_h += ridge
            np.divide(left_g, left_h, out=left_g, where=ok)
            np.divide(right_g, right_h, out=right_g, where=ok)
            left_g += right_g
            left_g -= total_g ** 2 / (total_h + ridge)
            left_g[~ok] = -np.inf
            most = left_g.max(1)
            gains[a:a + step] = most
            bins[a:a + step] = (left_g >= (most - np.abs(most) * NOISE)[:, None]).argmax(1)
        return gains, bins

    def split(self, b: int) -> tuple[int, float]:
        column = int(self.column[b])
        return column, float(self.edges[column][b - self.start[column]])


# --------------------------------------------------------------- growing

class _Tree:
    def __init__(self):
        self.rows = []

    def add(self, g: float, h: float) -> int:
        self.rows.append([-1, 0.0, -1, -1, g, h, 0.0])
        return len(self.rows) - 1

    def arrays(self, ridge: float, factor: float) -> dict:
        columns = [np.array([r[i] for r in self.rows], t) for i, (_, t) in enumerate(ARRAYS)]
        tree = dict(zip((n for n, _ in ARRAYS), columns))
        tree["value"] = factor * tree["value"] / (tree["cover"] + ridge)
        return tree


def grow_levels(data: Binned, rows: np.ndarray, g: np.ndarray, h: np.ndarray | None, depth: int, ridge: float, least: float, factor: float):
    """A tree grown level by level on ``rows`` (g, h: gradients and weights of those rows; h None: 1):
    (tree arrays, node of each row)."""
    tree, node = _Tree(), np.zeros(len(rows), np.int64)
    weights = np.ones(len(rows)) if h is None else h
    tree.add(float(g.sum()), float(weights.sum()))
    least_gain = NOISE * max(float((g * g / np.maximum(weights, 1e-300)).sum()), 1e-300)
    open_ = np.array([0])  # nodes of this level, in order
    hist = data.histogram(rows, node, 1, g, h)
    for level in range(depth):
        gain, bins = data.best(hist, ridge, least)
        go = np.flatnonzero(gain > least_gain)
        if not len(go):
            break
        slot = np.full(len(tree.rows), -1)
        slot[open_[go]] = np.arange(len(go))
        at = slot[node]  # which split a row takes part in
        inside = np.flatnonzero(at >= 0)
        splits = [data.split(int(bins[s])) for s in go]
        columns, cut = np.array([c for c, _ in splits]), bins[go]
        right = data.codes[rows[inside], columns[at[inside]]] > cut[at[inside]]
        key = 2 * at[inside] + right
        sums_g = np.bincount(key, g[inside], 2 * len(go))
        sums_h = np.bincount(key, weights[inside], 2 * len(go))
        counts = np.bincount(key, minlength=2 * len(go))
        first = len(tree.rows)
        for s, (column, threshold) in enumerate(splits):
            parent = tree.rows[open_[go[s]]]
            parent[0], parent[1], parent[6] = column, threshold, float(gain[go[s]])
            parent[2], parent[3] = (tree.add(float(sums_g[2 * s + k]), float(sums_h[2 * s + k])) for k in (0, 1))
        node[inside] = first + key
        if level + 1 < depth:
            pair = np.arange(len(go))
            small = np.where(counts[::2] <= counts[1::2], 0, 1)  # of each pair, the child with fewer rows
            open_ = first + np.concatenate([2 * pair + small, 2 * pair + 1 - small])
            mine = small[key // 2] == key % 2
            below = np.empty((2, 2 * len(go), data.total))
            below[:, :len(go)] = data.histogram(rows[inside[mine]], key[mine] // 2, len(go), g[inside[mine]], None if h is None else h[inside[mine]])
            np.subtract(hist if len(go) == hist.shape[1] else hist[:, go], below[:, :len(go)], out=below[:, len(go):])
            hist = below
    return tree.arrays(ridge, factor), node


def grow_leaves(data: Binned, g: np.ndarray, depth: int, ridge: float, least: float, leaves: int, factor: float):
    """A tree grown leaf by leaf: the leaf with the largest gain is split next, up to ``leaves``."""
    tree, node = _Tree(), np.zeros(len(g), np.int64)
    tree.add(float(g.sum()), float(len(g)))
    least_gain = NOISE * max(float((g * g).sum()), 1e-300)
    queue = []

    def offer(n, rows, hist, level):
        if level < depth and len(rows) >= 2 * least:
            gain, bins = data.best(hist, ridge, least)
            if gain[0] > least_gain:
                heapq.heappush(queue, (-float(gain[0]), n, int(bins[0]), rows, hist, level))

    rows = np.arange(len(g))
    offer(0, rows, data.histogram(rows, np.zeros(len(g), np.int64), 1, g, None), 0)
    for _ in range(leaves - 1):
        if not queue:
            break
        gain, n, b, rows, hist, level = heapq.heappop(queue)
        column, threshold = data.split(b)
        right = data.codes[rows, column] > b
        parts = [rows[~right], rows[right]]
        parent = tree.rows[n]
        parent[0], parent[1], parent[6] = column, threshold, -gain
        kids = [tree.add(float(g[p].sum()), float(len(p))) for p in parts]
        parent[2], parent[3] = kids
        small = 0 if len(parts[0]) <= len(parts[1]) else 1
        counted = data.histogram(parts[small], np.zeros(len(parts[small]), np.int64), 1, g[parts[small]], None)
        hists = [None, None]
        hists[small], hists[1 - small] = counted, hist - counted
        for k, p, x in zip(kids, parts, hists):
            node[p] = k
            offer(k, p, x, level + 1)
    return tree.arrays(ridge, factor), node


def fit_trees(data: Binned, y: np.ndarray, spec: dict, numbers: range, key: str):
    """(tree number, tree arrays) of one model; a forest's trees are drawn for ``key`` and
    their number, so blocks of them can be grown apart. The base: 0, or the mean when boosted."""
    if spec["kind"] == "forest":
        for t in numbers:
            random = np.random.default_rng([spec["seed"], zlib.crc32(key.encode()), t])
            times = np.bincount(random.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
            rows = np.flatnonzero(times)
            tree, _ = grow_levels(data, rows, (times * y)[rows], times[rows], spec["depth"], 0.0, 1.0, 1.0 / spec["trees"])
            yield t, tree
        return
    every, rest = np.arange(len(y)), y - y.mean()
    for t in numbers:
        if spec["kind"] == "levels":
            tree, node = grow_levels(data, every, rest, None, spec["depth"], spec["ridge"], spec["least_rows"], spec["rate"])
        else:
            tree, node = grow_leaves(data, rest, spec["depth"], spec["ridge"], spec["least_rows"], spec["leaves"], spec["rate"])
        rest = rest - tree["value"][node]
        yield t, tree


# -------------------------------------------------------------- Spark jobs

def numeric_features(df: DataFrame, target: str = "sales") -> list[str]:
    """Columns that can be features."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in NON_FEATURES | {target}
            and not f.name.startswith("_")]


def feature_array(features: list[str]):
    """One array of doubles, for ``_matrix``."""
    return F.array(*[F.col(c).cast("double") for c in features])


def by_hash(keys: list[str]):
    """An order of rows that has nothing to do with their values."""
    return F.xxhash64(F.lit(43), *[F.col(k) for k in keys])


def fit_sample(frame: DataFrame, keys: list[str], fit_rows: int = FIT_ROWS) -> DataFrame:
    """All rows of a tenant with at most ``fit_rows``; of others those with the smallest key hashes, four standard
    deviations fewer than ``fit_rows`` in the mean, so that the bound holds. A filter: no row is moved."""
    aim = max(1.0, fit_rows - 4 * fit_rows ** 0.5)
    share = F.when(F.count(F.lit(1)) <= fit_rows, F.lit(1.0)).otherwise(aim / F.count(F.lit(1)))
    bound = checked_broadcast(frame.groupBy(ORG).agg((share * 2.0 ** 64 - 2.0 ** 63).alias("_bound")))  # one row per tenant
    rows = frame.join(bound, frame[ORG].eqNullSafe(bound[ORG])).drop(bound[ORG])
    return rows.where(by_hash(keys).cast("double") <= F.col("_bound")).select(frame.columns)


def _whole(column):
    import pyarrow as pa
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def value_matrix(column, width: int) -> np.ndarray:
    """Feature values of rows; E11 tail: NULL and non-finite values are 0."""
    x = _whole(column).flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    return x if np.isfinite(x).all() else np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)


def pack(train: DataFrame, features: list[str], keys: list[str], target: str = "sales", bins: int = BINS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per tenant: its fit rows (of ``fit_sample``, ``fit_rows`` at most) as bin codes, split points and target.
    Features without two values are left out (E11)."""
    schema = f"{ORG} string, features array<string>, edges array<array<double>>, codes binary, y binary"
    width = len(features)

    def run(key, table):
        import pyarrow as pa
        order = np.argsort(table.column("_h").to_numpy(), kind="stable")[:fit_rows]  # its place: rows come in any order
        x = value_matrix(table.column("_x"), width)[order]
        y = table.column("_y").to_numpy()[order]
        varies = [j for j in range(width) if x[:, j].min() < x[:, j].max()]
        edges = [edges_of(x[:, j], bins) for j in varies]
        codes = coded(x[:, varies], edges)
        return pa.table({ORG: pa.array([key[0].as_py()], pa.string()), "features": pa.array([[features[j] for j in varies]], pa.list_(pa.string())),
                         "edges": pa.array([[e.tolist() for e in edges]], pa.list_(pa.list_(pa.float64()))),
                         "codes": pa.array([codes.astype("<u2").tobytes()], pa.binary()), "y": pa.array([y.astype("<f8").tobytes()], pa.binary())})

    rows = train.where(F.col(target).isNotNull())
    return rows.select(ORG, by_hash(keys).alias("_h"), feature_array(features).alias("_x"), F.col(target).cast("double").alias("_y")).groupBy(ORG).applyInArrow(run, schema)


def _unpacked(row: dict, bins: int) -> tuple[Binned, np.ndarray]:
    y = np.frombuffer(row["y"], "<f8")
    return Binned(np.frombuffer(row["codes"], "<u2").reshape(len(y), len(row["edges"])), [np.array(e) for e in row["edges"]], bins), y


def fit_models(packed: DataFrame, models=tuple(SPECS), specs: dict | None = None) -> DataFrame:
    """G02-G04 for every tenant of ``packed`` (stored): the table ``MODELS``, in one job. Boosted rounds follow
    each other and take one task for each tenant; a forest takes one for each ``BLOCK`` trees."""
    specs = {m: (specs or {}).get(m, SPECS[m]) for m in models}
    fits = [(m, a, min(a + step, s["trees"])) for m, s in specs.items()
            for step in [BLOCK if s["kind"] == "forest" else s["trees"]] for a in range(0, s["trees"], step)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(m).alias("model"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                               for i, (m, a, b) in enumerate(fits)]))
    tasks = max(1, min(4096, 4 * len(fits) * packed.count()))  # one row per tenant; more partitions than fits, so few share one
    spread = packed.withColumn("_f", each).select("*", "_f.*").drop("_f").repartition(tasks, ORG, "slot")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for r in batch.to_pylist():
                data, y = _unpacked(r, specs[r["model"]].get("bins", BINS))
                base = 0.0 if specs[r["model"]]["kind"] == "forest" else float(y.mean())
                began = time.perf_counter()
                out = list(fit_trees(data, y, specs[r["model"]], range(r["a"], r["b"]), r[ORG] or ""))
                n = len(out)
                seconds = (time.perf_counter() - began) / max(1, n)
                cols = {ORG: pa.array([r[ORG]] * n, pa.string()), "model": pa.array([r["model"]] * n, pa.string()),
                        "tree": pa.array([t for t, _ in out], pa.int32()), "features": pa.array([r["features"]] * n, pa.list_(pa.string())),
                        "base": pa.array([base] * n, pa.float64())}
                for name, kind in ARRAYS:
                    cols[name] = pa.array([tree[name] for _, tree in out], pa.list_(pa.int32() if kind is np.int64 else pa.float64()))
                cols["seconds"] = pa.array([seconds] * n, pa.float64())
                yield pa.RecordBatch.from_pydict(cols)

    # few rows at once reach Python, as each holds a tenant's rows
    return spread.mapInArrow(run, MODELS)


def tree_arrays(table) -> list[dict]:
    """The rows of ``MODELS`` in an Arrow table, arrays as NumPy arrays, by model and tree."""
    import pyarrow.compute as pc
    table = table.take(pc.sort_indices(table, sort_keys=[("model", "ascending"), ("tree", "ascending")]))
    out = [{"model": m, "tree": t, "features": f, "base": b} for m, t, f, b in zip(*(table.column(c).to_pylist() for c in ("model", "tree", "features", "base")))]
    for name, kind in ARRAYS:
        column = _whole(table.column(name))
        ends, values = column.offsets.to_numpy() - column.offsets[0].as_py(), column.flatten().to_numpy(zero_copy_only=False).astype(kind)
        for i, tree in enumerate(out):
            tree[name] = values[ends[i]:ends[i + 1]]
    return out


def of_model(trees: list[dict]):
    """(model, its trees) in order."""
    for name in dict.fromkeys(t["model"] for t in trees):
        yield name, [t for t in trees if t["model"] == name]


class Forest:
    """The trees of one tenant's model, laid end to end: prediction for a matrix of feature values."""

    def __init__(self, rows: list[dict], columns: list[str]):
        at = {c: j for j, c in enumerate(columns)}
        self.base = rows[0]["base"]
        self.first = np.concatenate([[0], np.cumsum([len(r["feature"]) for r in rows])])
        place = np.array([at[f] for f in rows[0]["features"]] or [0])
        join = lambda name: np.concatenate([r[name] for r in rows])
        base = np.repeat(self.first[:-1], np.diff(self.first))
        feature = join("feature")
        self.leaf = feature < 0
        self.feature = np.where(self.leaf, 0, place[np.maximum(feature, 0)])
        self.threshold = np.where(self.leaf, np.inf, join("threshold"))
        own = np.arange(len(feature))
        self.left = np.where(self.leaf, own, join("left") + base)
        self.right = np.where(self.leaf, own, join("right") + base)
        self.value = join("value")

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        roots = self.first[:-1]
        for a in range(0, len(x), 2048):
            part = x[a:a + 2048]
            row = np.arange(len(part))[:, None]
            node = np.broadcast_to(roots, (len(part), len(roots)))
            while True:
                after = np.where(part[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
                if (after == node).all():
                    break
                node = after
            out[a:a + 2048] = self.base + self.value[node].sum(1)
        return out


def _beside_models(rows: DataFrame, models: DataFrame, run, schema: str, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """``run(rows table, trees)`` for each chunk of about ``chunk`` rows of a tenant, next to the tenant's models."""
    sizes = rows.groupBy(ORG).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_chunks"))
    sizes = checked_broadcast(sizes)  # one row per tenant
    salted = rows.join(sizes, ORG).withColumn("_chunk", F.pmod(F.xxhash64(*keys), F.col("_chunks"))).drop("_chunks")
    beside = models.join(sizes, ORG).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - F.lit(1).cast("long")))).drop("_chunks")
    beside = beside.select(*[F.col(c).alias(f"m_{c}") for c in beside.columns])  # names of its own: both sides may stem from one frame
    return salted.groupBy(ORG, "_chunk").cogroup(beside.groupBy(f"m_{ORG}", "m__chunk")).applyInArrow(
        lambda left, right: run(left, tree_arrays(right.rename_columns([n[2:] for n in right.column_names]))), schema)


def score(rows: DataFrame, models: DataFrame, features: list[str], keys: list[str], keep: list[str] = (), chunk: int = CHUNK) -> DataFrame:
    """G09 for all tenants: (keys, keep, model, pred), one row per row and model of its tenant; predictions floored at 0."""
    out = [*keys, *keep]
    x = rows.select(*dict.fromkeys([ORG, *out]), feature_array(features).alias("_x"))
    types = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in out), "model string", "pred double"])

    def run(table, trees):
        import pyarrow as pa
        x = value_matrix(table.column("_x"), len(features)) if table.num_rows else np.zeros((0, len(features)))
        parts = []
        for name, mine in of_model(trees) if table.num_rows else ():
            pred = np.maximum(Forest(mine, features).predict(x), 0.0)
            parts.append(table.select(out).append_column("model", pa.array([name] * len(x), pa.string())).append_column("pred", pa.array(pred)))
        if not parts:
            return table.select(out).slice(0, 0).append_column("model", pa.array([], pa.string())).append_column("pred", pa.array([], pa.float64()))
        return pa.concat_tables(parts)

    return _beside_models(x, models, run, schema, keys, chunk)


def importance(models: DataFrame) -> DataFrame:
    """Gain of each feature as a share of its tenant's model (organization_id, model, feature, importance):
    within each tree as a share of the tree's gain for a forest, over all trees' gains when boosted. Features without a split have 0."""
    nodes = models.select(ORG, "model", "tree", "base", "features", F.posexplode(F.arrays_zip("feature", "gain")).alias("_n", "_z")).where(F.col("_z.feature") >= 0)
    gains = nodes.groupBy(ORG, "model", "tree", F.element_at("features", F.col("_z.feature") + 1).alias("feature")).agg(F.sum("_z.gain").alias("g"))
    per_tree = gains.groupBy(ORG, "model", "tree").agg(F.sum("g").alias("t"))
    forest = F.col("model") == "random_forest"
    share = gains.join(per_tree, [ORG, "model", "tree"]).withColumn("g", F.when(forest, F.col("g") / F.col("t")).otherwise(F.col("g")))
    each = share.groupBy(ORG, "model", "feature").agg(F.sum("g").alias("g"))
    total = each.groupBy(ORG, "model").agg(F.sum("g").alias("t"))
    named = models.select(ORG, "model", F.explode("features").alias("feature")).distinct()
    full = named.join(each, [ORG, "model", "feature"], "left").join(checked_broadcast(total), [ORG, "model"], "left")
    return full.select(ORG, "model", "feature", F.coalesce(F.col("g") / F.col("t"), F.lit(0.0)).alias("importance"))


# ------------------------------------------------- recursive forecasts

LAG = r"sales_lag_(\d+)$"
ROLLING = r"sales_rolling_(mean|std|max|min)_(\d+)$"


def refreshed(x: np.ndarray, ring: np.ndarray, features: list[str]) -> None:
    """Write the lags and rolling statistics that follow from the last values (``ring``: series x time, NaN where a
    series is shorter) into the feature matrix. The day itself is not known yet, so both end with the day before."""
    import re
    import warnings
    for j, name in enumerate(features):
        if m := re.match(LAG, name):
            lag = int(m[1])
            x[:, j] = np.nan_to_num(ring[:, -lag]) if lag <= ring.shape[1] else 0.0
        elif m := re.match(ROLLING, name):
            last = ring[:, -int(m[2]):]
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", RuntimeWarning)  # all NaN, or one value
                value = {"mean": np.nanmean, "max": np.nanmax, "min": np.nanmin}[m[1]](last, axis=1) if m[1] != "std" else np.nanstd(last, axis=1, ddof=1)
            x[:, j] = np.nan_to_num(value)


def forecast_recursive(models: DataFrame, frame: DataFrame, features: list[str], horizon: int = 28, target: str = "sales", chunk: int = 20_000) -> DataFrame:
    """G13, recursive: (series, date, model, predicted_sales). Each series carries a ring of its last 28 values
    through the horizon: a day's prediction becomes the newest value, from which the next day's lags and rolling
    statistics are computed. Calendar parts follow the date; all other features stay those of the
    series' last row, as in the default forecast (``models.future_frame``). One job whatever the horizon."""
    ring_size = 28
    w = Window.partitionBy(*SERIES).orderBy(F.desc("date"))
    recent = frame.select(*SERIES, "date", F.col(target).cast("double").alias("_y"), feature_array(features).alias("_x")).withColumn(
        "_n", F.row_number().over(w)).where(F.col("_n") <= ring_size)
    ring = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.coalesce("_y", F.lit(float("nan"))).alias("y")))), lambda v: v["y"])
    series = recent.groupBy(*SERIES).agg(ring.alias("_ring"), F.max(F.when(F.col("_n") == 1, F.col("_x"))).alias("_x"))
    origin = checked_broadcast(frame.groupBy(ORG).agg(F.max("date").alias("_origin")))  # one row per tenant
    state = series.join(origin, ORG)
    schema = ", ".join([*(f"{c} string" for c in SERIES), "date date", "model string", "predicted_sales double"])

    def run(table, trees):
        import datetime
        import pyarrow as pa
        parts, n = [], table.num_rows
        for name, mine in of_model(trees) if n else ():
            forest = Forest(mine, features)
            x = value_matrix(table.column("_x"), len(features)).copy()
            rings = np.full((n, ring_size + horizon), np.nan)
            for i, values in enumerate(table.column("_ring").to_pylist()):
                rings[i, ring_size - len(values):ring_size] = values
            day0 = table.column("_origin")[0].as_py()
            for h in range(horizon):
                day = day0 + datetime.timedelta(days=h + 1)
                parts_of = {"year": day.year, "month": day.month, "day": day.day, "dayofweek": day.weekday(), "quarter": (day.month + 2) // 3,
                            "is_weekend": int(day.weekday() >= 5)}
                for j, f in enumerate(features):
                    if f in parts_of:
                        x[:, j] = parts_of[f]
                refreshed(x, rings[:, h:h + ring_size], features)
                rings[:, ring_size + h] = np.maximum(forest.predict(x), 0.0)
                parts.append(table.select(SERIES).append_column("date", pa.array([day] * n, pa.date32())).append_column(
                    "model", pa.array([name] * n, pa.string())).append_column("predicted_sales", pa.array(rings[:, ring_size + h])))
        if not parts:
            return pa.table({**{c: pa.array([], pa.string()) for c in SERIES}, "date": pa.array([], pa.date32()), "model": pa.array([], pa.string()),
                             "predicted_sales": pa.array([], pa.float64())})
        return pa.concat_tables(parts)

    return _beside_models(state, models, run, schema, SERIES, chunk)


# ------------------------------------------------------ attribution

def tree_shapley(tree: dict, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float]:
    """Path-dependent Shapley values of one tree for rows ``x`` (columns ``at[feature]``): (rows x features, expected value).

    A leaf with value v and unique path features 1..m gives feature j
    v * (o_j - z_j) * sum over subsets S of the others of |S|!(m-1-|S|)!/m! * prod o_i (i in S) * prod z_i (others),
    where z is the share of the cover that follows the path at the feature's splits and o is 1 for rows that do. The weights
    are integrals of s^|S| (1-s)^(m-1-|S|), so the sum is the integral over s of prod (z_i (1-s) + o_i s), a
    polynomial of degree m-1, which Gauss-Legendre points integrate exactly.
    """
    out, expected = np.zeros((len(x), len(at))), 0.0
    goes_left = x[:, at[np.maximum(tree["feature"], 0)]] <= tree["threshold"]  # rows x nodes
    leaves = {}  # by number of unique features: (value, features, shares, conditions)
    stack = [(0, {})]
    while stack:
        n, path = stack.pop()
        f = int(tree["feature"][n])
        if f < 0:
            expected += float(tree["value"][n]) * float(np.prod([z for z, _ in path.values()]))
            if path:
                leaves.setdefault(len(path), []).append((float(tree["value"][n]), path))
            continue
        for child, left in ((int(tree["left"][n]), True), (int(tree["right"][n]), False)):
            z, conditions = path.get(f, (1.0, ()))
            stack.append((child, {**path, f: (z * float(tree["cover"][child] / tree["cover"][n]), (*conditions, (n, left)))}))
    for m, group in leaves.items():
        points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
        for a in range(0, len(group), 64):
            part = group[a:a + 64]
            v = np.array([value for value, _ in part])
            z = np.array([[share for share, _ in path.values()] for _, path in part])
            o = np.ones((len(part), m, len(x)))
            for i, (_, path) in enumerate(part):
                for j, (_, conditions) in enumerate(path.values()):
                    for n, left in conditions:
                        o[i, j] *= goes_left[:, n] if left else ~goes_left[:, n]
            total = np.zeros_like(o)
            for s, weight in zip((points + 1) / 2, weights / 2):
                each = z[:, :, None] * (1 - s) + o * s
                total += weight * each.prod(1)[:, None] / each
            total *= v[:, None, None] * (o - z[:, :, None])
            for i, (_, path) in enumerate(part):
                out[:, list(path)] += total[i].T
    return out, expected


def attributions(models: DataFrame, rows: DataFrame, features: list[str], keys: list[str], chunk: int = 512) -> DataFrame:
    """For each row (``keys``) and model of its tenant the prediction (before the floor at 0), the base value and the
    attributions (one for each of ``features``, in order): prediction = base value + their sum."""
    x = rows.select(*dict.fromkeys([ORG, *keys]), feature_array(features).alias("_x"))
    types = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "model string, prediction double, base_value double, feature_values array<double>, attributions array<double>"])

    def run(table, trees):
        import pyarrow as pa
        parts = []
        for name, mine in of_model(trees) if table.num_rows else ():
            x = value_matrix(table.column("_x"), len(features))
            place = np.array([features.index(f) for f in mine[0]["features"]] or [0])
            phi, base = np.zeros((len(x), len(features))), mine[0]["base"]
            for t in mine:
                part, expected = tree_shapley(t, x, place)
                base += expected
                phi[:, place] += part
            doubles = pa.list_(pa.float64())
            parts.append(table.select(keys).append_column("model", pa.array([name] * len(x), pa.string())).append_column(
                "prediction", pa.array(Forest(mine, features).predict(x))).append_column("base_value", pa.array([base] * len(x), pa.float64())).append_column(
                "feature_values", pa.array(list(x), doubles)).append_column("attributions", pa.array(list(phi), doubles)))
        if not parts:
            empty = table.select(keys).slice(0, 0)
            for n, k in (("model", pa.string()), ("prediction", pa.float64()), ("base_value", pa.float64()), ("feature_values", pa.list_(pa.float64())),
                         ("attributions", pa.list_(pa.float64()))):
                empty = empty.append_column(n, pa.array([], k))
            return empty
        return pa.concat_tables(parts)

    return _beside_models(x, models, run, schema, keys, chunk)


def ranked_attributions(attr: DataFrame, features: list[str], top_n: int = 20) -> DataFrame:
    """G16 global: mean |attribution| of each feature per tenant and model, largest first. The tasks that hold the rows add up
    their sums of |attribution|, one row for each tenant, model and feature; these few are added by key."""
    width = len(features)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        held = {}
        for batch in batches:
            whole = batch.filter(pc.is_valid(batch.column("attributions")))
            flat = whole.column("attributions").flatten()
            known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
            size = np.where(known, np.abs(flat.to_numpy(zero_copy_only=False).reshape(-1, width)), 0.0)
            tenants, models = (pc.dictionary_encode(whole.column(c), null_encoding="encode") for c in (ORG, "model"))
            pair = tenants.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(models.dictionary)) + models.indices.to_numpy(zero_copy_only=False)
            for k in np.unique(pair):
                key = (tenants.dictionary[int(k) // len(models.dictionary)].as_py(), models.dictionary[int(k) % len(models.dictionary)].as_py())
                mine = pair == k
                s, n = held.get(key, (0.0, 0))
                held[key] = s + size[mine].sum(0), n + known[mine].sum(0)
        if held:
            yield pa.RecordBatch.from_arrays([
                pa.array([t for t, _ in held for _ in range(width)], pa.string()), pa.array([m for _, m in held for _ in range(width)], pa.string()),
                pa.array(features * len(held), pa.string()), pa.array(np.concatenate([s for s, _ in held.values()])),
                pa.array(np.concatenate([n for _, n in held.values()]).astype(np.int64))], names=[ORG, "model", "feature", "s", "n"])

    parts = attr.select(ORG, "model", "attributions").mapInArrow(run, f"{ORG} string, model string, feature string, s double, n long")
    rows = parts.groupBy(ORG, "model", "feature").agg((F.when(F.sum("n") > 0, F.sum("s") / F.sum("n"))).alias("mean_abs_attribution"))
    w = Window.partitionBy(ORG, "model").orderBy(F.desc("mean_abs_attribution"), "feature")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def attribution_dependence(attr: DataFrame, features: list[str], feature: str, bins: int = 20) -> DataFrame:
    """Mean attribution of one feature per tenant, model and equal-width bucket of its value."""
    i = features.index(feature)
    one = attr.select(ORG, "model", F.col("feature_values")[i].alias("v"), F.col("attributions")[i].alias("a"))
    span = checked_broadcast(one.groupBy(ORG, "model").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi")))  # one row per tenant and model
    width = F.col("_hi") - F.col("_lo")
    bucket = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("_lo")) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    return one.join(span, [ORG, "model"]).groupBy(ORG, "model", bucket.cast("int").alias("bucket")).agg(
        F.avg("v").alias("feature_value"), F.avg("a").alias("mean_attribution"), F.count(F.lit(1)).alias("n"))


def permutation_importance(models: DataFrame, rows: DataFrame, features: list[str], keys: list[str], target: str = "sales", seed: int = 42,
                           chunk: int = 2048) -> DataFrame:
    """G16, the cheap variant: (organization_id, model, feature, importance): how much a model's mean absolute error on ``rows``
    grows when the feature's values are permuted within the tenant. Nothing is fitted again.

    The permutation is a bijection of ranks: rows are ranked by a seeded hash of their keys (``split_rank``, so no
    tenant's rows meet in one task), and a row takes the value of the row a feature's own number of ranks further on, the
    last followed by the first. A feature that no tree splits on has exactly 0.
    """
    width = len(features)
    x = rows.where(F.col(target).isNotNull()).select(*dict.fromkeys([ORG, *keys]), F.col(target).cast("double").alias("_y"), feature_array(features).alias("_x"))
    ranked = split_rank(x, [ORG], [F.xxhash64(F.lit(seed), *keys), *keys], "_rank")
    sizes = checked_broadcast(x.groupBy(ORG).agg(F.count(F.lit(1)).alias("_rows")))  # one row per tenant
    ranked = ranked.join(sizes, ORG)
    shift = F.pmod(F.xxhash64(F.lit(seed), "_j"), F.greatest(F.col("_rows") - 1, F.lit(1))) + 1
    gives = ranked.select(ORG, "_rank", "_rows", F.posexplode("_x").alias("_j", "_v")).select(
        ORG, (F.pmod(F.col("_rank") - 1 - shift, F.col("_rows")) + 1).alias("_to"), "_j", "_v")
    other = gives.groupBy(ORG, "_to").agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", F.coalesce("_v", F.lit(0.0)).alias("v")))),
                                                      lambda e: e["v"]).alias("_other"))  # one value per feature
    other = other.select(F.col(ORG).alias("_o"), "_to", "_other")
    both = ranked.join(other, (F.col(ORG) == F.col("_o")) & (F.col("_rank") == F.col("_to"))).select(*dict.fromkeys([ORG, *keys]), "_y", "_x", "_other")
    schema = f"{ORG} string, model string, feature string, n long, grown double"

    def run(table, trees):
        import pyarrow as pa
        out = []
        if table.num_rows:
            x, other = value_matrix(table.column("_x"), width), value_matrix(table.column("_other"), width)
            y, tenant = table.column("_y").to_numpy(), table.column(ORG)[0].as_py()
            for name, mine in of_model(trees):
                forest = Forest(mine, features)
                used = {mine[0]["features"][f] for t in mine for f in np.unique(t["feature"]) if f >= 0}
                error = np.abs(np.maximum(forest.predict(x), 0.0) - y)
                for j, feature in enumerate(features):
                    grown = 0.0
                    if feature in used:
                        moved = x.copy()
                        moved[:, j] = other[:, j]
                        grown = float((np.abs(np.maximum(forest.predict(moved), 0.0) - y) - error).sum())
                    out.append((tenant, name, feature, len(y), grown))
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64())
        cols = list(zip(*out)) or [()] * 5
        return pa.table({c.split()[0]: pa.array(v, k) for c, v, k in zip(schema.split(", "), cols, kinds)})

    parts = _beside_models(both, models, run, schema, keys, chunk)
    return parts.groupBy(ORG, "model", "feature").agg((F.sum("grown") / F.sum("n")).alias("importance"))
