"""Exact top-k inner products by best-first search in M-trees.

Inner products become distances: with M the largest norm of all vectors, x is
lengthened by sqrt(M^2 - |x|^2) and a query q by 0; then
d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so the nearest vectors score highest and the
triangle inequality holds.

Index. Vectors are dealt to the nearest of at most ``pivots`` pivots; a cell with
more than ``most`` vectors is dealt by hash into several trees. A tree is bulk
loaded in one task into pages: a routing page holds its entries' centres, covering
radii and distances to the page's own centre, a leaf page its vectors and
their distances to its centre.

Search. A query first visits one tree of its nearest cell; its k-th best score there
is the bound with which it visits the trees of all cells that the triangle
inequality does not exclude. In a tree, pages are opened in the order of their least
possible distance, until that exceeds the k-th best. An entry whose stored distance
to the page's centre differs from the query's by more than the bound (and its
radius) is left out without computing its distance. Queries come in blocks of
``block``, so neither a tree's task nor its memory grows with their number.

Scores are exact integer products; distances only exclude, with a slack for
rounding, and equal scores are never excluded, so ties go to smaller ids.

Defined cases: rows without id, null vectors, vectors with null or non-finite
components take no part, nor do vectors whose scaled squared length is 2^62 or more
(their scores need not fit in a long); vectors are compared with those of the same length; an empty
vector scores 0; every repeated row is a candidate, rows with the query's id are
not; of query rows that repeat an id, the one with the least bytes asks; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import ship, staged

LEAF, FAN = 512, 16  # rows of a leaf page: as many as one product takes in little time; entries of a routing page
SLACK = 1e-7


def scaled(vectors: DataFrame, id_col: str, vector_col: str, factor: float) -> DataFrame:
    """id, dim, x (floor(factor * component) as little-endian int64), norm2 (double)."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            lists, ids, out = batch.column(1), batch.column(0).to_pylist(), []
            for i, v in zip(ids, lists):
                if i is None or not v.is_valid:
                    continue
                a = np.array(v.values.to_numpy(zero_copy_only=False) if len(v) else [], float)  # a null is NaN
                with np.errstate(over="ignore"):
                    y = np.floor(a * factor)
                # by Cauchy-Schwarz no product of two such vectors, nor any part of its sum, leaves 63 bits
                if np.isfinite(y).all() and float(y @ y) < 2.0 ** 62:
                    out.append((i, len(y), y.astype("<i8").tobytes(), float(y @ y)))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.float64()))],
                                             names=["id", "dim", "x", "norm2"])

    part = ship(vectors).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return part.mapInArrow(run, "id long, dim long, x binary, norm2 double")


def lengthened(x: np.ndarray, most: float) -> np.ndarray:
    """Rows of integers with the further coordinate; ``most``: the largest squared norm."""
    x = x.astype(float)
    return np.hstack([x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))[:, None]])


def matrix(rows: list, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), dim)


class Tree:
    """Pages: a leaf is (first row, distances of its rows to the centre), a routing
    page is (child pages, centres, radii, distances to its own centre). Rows are
    stored leaf by leaf, as doubles where their products are exact so."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: float, leaf: int = LEAF):
        self.most, self.leaf, self.pages, self.order = most, leaf, [], []
        points = lengthened(x, most)
        self.root, self.centre, self.radius = self._load(points, np.argsort(ids, kind="stable"))
        order = np.concatenate(self.order)
        del self.order
        self.ids, self.x = ids[order], x[order]
        if x.size and x.shape[1] * float(np.abs(x).max()) ** 2 < 2 ** 53 and most < 2 ** 53:
            self.x = self.x.astype(float)  # no product of two such rows, nor of one with a query, is rounded
        self.computed = 0

    def _load(self, points, rows):
        centre = points[rows].mean(0)
        far = np.linalg.norm(points[rows] - centre, axis=1)
        if len(rows) <= self.leaf:
            self.pages.append((sum(map(len, self.order)), far))
            self.order.append(rows)
        else:
            heads, near = [int(far.argmax())], None
            for _ in range(FAN):  # heads far from each other
                d = np.linalg.norm(points[rows] - points[rows[heads[-1]]], axis=1)
                near = d if near is None else np.minimum(near, d)
                heads.append(int(near.argmax()))
            nearest = np.stack([np.linalg.norm(points[rows] - points[rows[h]], axis=1) for h in heads[:FAN]], 1).argmin(1)
            groups = [rows[nearest == g] for g in range(FAN)]
            groups = [g for g in groups if len(g)]
            if len(groups) == 1:  # equal vectors
                groups = np.array_split(rows, FAN)
            kids = [self._load(points, g) for g in groups]
            centres = np.array([c for _, c, _ in kids])
            self.pages.append(([k for k, _, _ in kids], centres, np.array([r for _, _, r in kids]), np.linalg.norm(centres - centre, axis=1)))
        return len(self.pages) - 1, centre, float(far.max())

    def search(self, q: np.ndarray, own: int, k: int, floor: int | None) -> list:
        """The k best (score, id) for an integer vector, of those with a score of at least ``floor``."""
        qf = q.astype(float)
        far2 = float(qf @ qf) + self.most
        exact = self.x.dtype == float and float(qf @ qf) < 2 ** 53
        q, x = (qf, self.x) if exact else (q, self.x if self.x.dtype != float else self.x.astype(np.int64))
        point, slack = np.append(qf, 0.0), SLACK * (1 + far2 ** 0.5)
        best: list = []  # a heap with the worst of the best in front: (score, -id)

        def least():
            """Scores below this no longer count."""
            worst = best[0][0] if len(best) == k else None
            return worst if floor is None or worst is not None and worst > floor else floor

        def reach():
            worst = least()
            return float("inf") if worst is None else max(0.0, far2 - 2 * worst) ** 0.5 + slack

        most = reach()
        d = float(np.linalg.norm(point - self.centre))
        queue = [(max(0.0, d - self.radius), self.root, d)]
        while queue and queue[0][0] <= most:
            _, page, d = heapq.heappop(queue)
            page = self.pages[page]
            if len(page) == 2:
                first, apart = page
                open_ = np.flatnonzero(np.abs(d - apart) <= most) + first
                self.computed += len(open_)
                whole = len(open_) == len(apart)
                scores = (x[first:first + len(apart)] if whole else x[open_]) @ q
                if (worst := least()) is None and len(scores) > 4 * k:
                    others = scores[self.ids[open_] != own]  # rows of the query itself are no candidates, however many
                    worst = np.partition(others, -k)[-k] if len(others) > k else None
                use = np.flatnonzero(scores >= worst) if worst is not None else range(len(scores))
                for j in use:
                    s, i = int(scores[j]), int(self.ids[open_[j]])
                    if i != own:
                        if len(best) < k:
                            heapq.heappush(best, (s, -i))
                        elif (s, -i) > best[0]:
                            heapq.heapreplace(best, (s, -i))
                most = reach()
            else:
                kids, centres, radii, apart = page
                open_ = np.flatnonzero(np.abs(d - apart) - radii <= most)
                ds = np.linalg.norm(centres[open_] - point, axis=1)
                for j, e in zip(open_.tolist(), ds.tolist()):
                    if e - radii[j] <= most:
                        heapq.heappush(queue, (max(0.0, e - radii[j]), kids[j], e))
        return [(s, -i) for s, i in best]


def _visit(tree_rows, query_rows, k: int):
    import pyarrow as pa
    out = []
    if tree_rows.num_rows:
        tree = pickle.loads(tree_rows.column("tree")[0].as_py())
        for i, x, floor in zip(*(query_rows.column(c).to_pylist() for c in ("id", "x", "floor"))):
            out += [(i, v, s) for s, v in tree.search(np.frombuffer(x, "<i8"), i, k, floor)]
    cols = list(zip(*out)) or [()] * 3
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols)})


def top_k(vectors: DataFrame, query: Column, k: int = 5, factor: float = 256.0, pivots: int = 256, most: int = 4096, block: int = 2048,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``query`` (a condition on the
    column id) picks, the k rows of other ids with the highest products."""
    spark = vectors.sparkSession
    x = staged(scaled(vectors, id_col, vector_col, factor), "mtree-vectors")
    sizes = x.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("most")).collect()  # one row per length
    results = []
    for dim, n, most2 in sorted(sizes):
        mine = x.where(F.col("dim") == dim)
        n_pivots = max(1, min(pivots, n // most * 4))
        heads = mine.orderBy(F.xxhash64("id"), "id", "x").limit(n_pivots).collect()  # at most ``pivots`` vectors
        results.append(_search(spark, mine, query, k, dim, most2, lengthened(matrix([r["x"] for r in heads], dim), most2), most, block))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(spark, mine: DataFrame, query: Column, k: int, dim: int, most2: float, heads: np.ndarray, most: int, block: int) -> DataFrame:
    def nearest(batches):
        import pyarrow as pa
        for batch in batches:
            rows = batch.column(1).to_pylist()
            for at in range(0, len(rows), 1024):
                points = lengthened(matrix(rows[at:at + 1024], dim), most2)
                d = np.sqrt(np.maximum(0, (points ** 2).sum(1)[:, None] + (heads ** 2).sum(1)[None] - 2 * points @ heads.T))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(points)), batch.column(1).slice(at, len(points)),
                                                  pa.array(d.argmin(1), pa.int64()), pa.array(d.min(1), pa.float64())], names=["id", "x", "cell", "far"])

    dealt = staged(mine.select("id", "x").mapInArrow(nearest, "id long, x binary, cell long, far double"), "mtree-cells")
    cells = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).withColumn(
        "parts", F.ceil(F.col("n") / most)).collect()  # at most one row per pivot
    parts = {c["cell"]: (c["parts"], c["radius"]) for c in cells}
    n_parts = F.element_at(F.create_map(*[F.lit(v) for c, (p, _) in parts.items() for v in (c, p)]), F.col("cell"))

    def build(key, table):
        import pyarrow as pa
        order = np.argsort(np.array(table.column("id").to_pylist()), kind="stable")
        rows = table.column("x").to_pylist()
        tree = Tree(np.array(table.column("id").to_pylist())[order], matrix([rows[i] for i in order], dim), most2)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()),
                         "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    trees = dealt.withColumn("part", F.pmod(F.xxhash64("id", "x"), n_parts))
    trees = staged(trees.groupBy("cell", "part").applyInArrow(build, "cell long, part long, tree binary"), "mtree-trees")
    asked = mine.where(query).groupBy("id").agg(F.min("x").alias("x"))
    n_blocks = max(1, -(-asked.count() // block))
    asked = staged(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))), "mtree-queries")
    slack = SLACK * (1 + (2 * most2) ** 0.5)
    names, radii = np.array(sorted(parts)), np.array([parts[c][1] for c in sorted(parts)])
    counts = np.array([parts[c][0] for c in sorted(parts)])
    centres = heads[names]

    def route(first: bool):
        def run(batches):
            import pyarrow as pa
            for batch in batches:
                cols = [batch.column(i).to_pylist() for i in range(4)]
                for i, row, b, floor in zip(*cols):
                    q = np.frombuffer(row, "<i8").astype(float)
                    d = np.linalg.norm(centres - np.append(q, 0.0), axis=1)
                    home = int(d.argmin())
                    if first:
                        out = [(int(names[home]), i % int(counts[home]))]
                    else:
                        reach = float("inf") if floor is None else max(0.0, q @ q + most2 - 2 * floor) ** 0.5 + slack
                        out = [(int(names[c]), p) for c in np.flatnonzero(d - radii <= reach) for p in range(int(counts[c]))
                               if (c, p) != (home, i % int(counts[home]))]
                    if out:
                        c, p = zip(*out)
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in (
                            (c, pa.int64()), (p, pa.int64()), ([b] * len(out), pa.int64()), ([i] * len(out), pa.int64()),
                            ([row] * len(out), pa.binary()), ([floor] * len(out), pa.int64()))], names=["cell", "part", "block", "id", "x", "floor"])
        return run

    def visit(queries: DataFrame, first: bool) -> DataFrame:
        sent = queries.select("id", "x", "block", "floor").mapInArrow(route(first), "cell long, part long, block long, id long, x binary, floor long")
        blocks = trees.select("cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), "tree")
        return blocks.groupBy("cell", "part", "block").cogroup(sent.groupBy("cell", "part", "block")).applyInArrow(
            lambda t, q: _visit(t, q, k), "query_id long, vec_id long, score long")

    home = staged(visit(asked.withColumn("floor", F.lit(None).cast("long")), True), "mtree-home")
    floor = home.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
    floor = floor.where(F.col("n") >= k).select("id", "floor")  # fewer than k: no bound yet
    rest = visit(asked.join(floor, "id", "left"), False)
    return home.unionByName(rest)
