"""Approximate nearest neighbours over learned partitions.

1. A sample of at most ``SAMPLE`` vectors (smallest hashed ids) goes to the
   driver. Its neighbour graph is cut into equal parts: recursive bisection at the
   median of an approximate Fiedler vector, improved by swaps that cut fewer edges.
2. A small network learns, for a vector, how its neighbours are spread over the
   parts. It places every vector of the table in its most probable part.
3. A query goes to its most probable parts: as many as gave ``TARGET`` of the
   sample's true neighbours, and at least enough to hold ``MIN_ROWS`` vectors.
4. Parts are dealt into blocks of ``BLOCK_ROWS`` vectors by ``BLOCK_QUERIES``
   queries (a part or a much repeated vector never meets in one task); each pair
   of blocks gives its nearest, reranked by exact double-precision distances.

Up to ``EXACT_ROWS`` vectors there is one part, i.e. an exact search.

Edge cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part; rows with a null id neither; rows
that repeat an id count once, with the smallest of their vectors; a query never
finds its own id; ties go to the smaller id; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SAMPLE, NEIGHBOURS, PART_ROWS, MOST_PARTS = 8_192, 10, 64, 64
EXACT_ROWS, TARGET, MIN_ROWS = 200, 0.95, 128
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024
HIDDEN, EPOCHS, RATE = 64, 30, 0.003


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest other rows, in blocks."""
    norm, out = (x * x).sum(1), np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        d = norm[None, :] - 2 * x[at:at + 1024] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at:at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each row of a neighbour graph; parts is a power of two, sizes differ by one row a bisection."""
    n = len(graph)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    rng, out, step = np.random.default_rng(5), np.zeros(n, np.int64), 1
    while step < parts:
        fresh = out * 2
        for p in range(step):
            rows = np.nonzero(out == p)[0]
            local = np.full(n, -1)
            local[rows] = np.arange(len(rows))
            inside = (local[a] >= 0) & (local[b] >= 0)
            u, v, m = local[a[inside]], local[b[inside]], len(rows)
            u, v = np.concatenate([u, v]), np.concatenate([v, u])
            degree = np.maximum(np.bincount(u, minlength=m), 1)
            f = rng.normal(size=m)
            for _ in range(60):
                f = 0.5 * f + 0.5 * np.bincount(u, f[v], m) / degree
                f -= (f * degree).sum() / degree.sum()
                f /= np.linalg.norm(f) or 1.0
            side = np.zeros(m, bool)
            side[np.argsort(f, kind="stable")[m // 2:]] = True
            for _ in range(10):  # swap the rows that gain most, as many from either side
                gain = np.bincount(u, side[u] != side[v], m) - np.bincount(u, side[u] == side[v], m)
                left = np.nonzero(~side & (gain > 0))[0]
                right = np.nonzero(side & (gain > 0))[0]
                count = min(len(left), len(right)) // 2
                if not count:
                    break
                side[left[np.argsort(-gain[left], kind="stable")[:count]]] = True
                side[right[np.argsort(-gain[right], kind="stable")[:count]]] = False
            fresh[rows] += side
        out, step = fresh, step * 2
    return out


@dataclass
class Router:
    """Standardised vector -> probabilities of parts; one hidden layer."""

    mean: np.ndarray
    scale: float
    layers: list[np.ndarray]
    probes: int = 1

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit_router(x: np.ndarray, parts: int) -> Router:
    """Cuts the sample's graph, trains the network (Adam on cross-entropy) and calibrates the number of probes."""
    mean, scale = x.mean(0), float(x.std()) or 1.0
    dims, rng = x.shape[1], np.random.default_rng(7)
    if parts == 1:
        return Router(mean, scale, [np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
    graph = nearest(x, NEIGHBOURS)
    part = balanced_parts(graph, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x)), part), 1.0)
    for j in range(NEIGHBOURS):
        np.add.at(goal, (np.arange(len(x)), part[graph[:, j]]), 1.0)
    goal /= goal.sum(1, keepdims=True)
    layers = [rng.normal(0, (2 / dims) ** 0.5, (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (2 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
    first, second, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    router, z = Router(mean, scale, layers), (x - mean) / scale
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at:at + 256]
            h = np.maximum(z[rows] @ layers[0] + layers[1], 0)
            o = h @ layers[2] + layers[3]
            p = np.exp(o - o.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - goal[rows]) / len(rows)
            back = (d @ layers[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((z[rows].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] -= RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    ranks = np.argsort(np.argsort(-router.probabilities(x), axis=1, kind="stable"), axis=1)
    place = router.probabilities(x).argmax(1)
    need = ranks[np.arange(len(x))[:, None], place[graph]]
    while router.probes < parts and (need < router.probes).mean() < TARGET:
        router.probes += 1
    return router


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>): one per id, finite, not zero, of the commonest length."""
    vec = F.col(vec_col).cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    v = (rows.select(F.col(id_col).alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
         .where((F.size("vec") > 0) & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)))
    lengths = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    n = lengths[0][0] if lengths else 0
    return v.where(F.size("vec") == n).groupBy("id").agg(F.min("vec").alias("vec"))


def _placed(router: Router, id_type: str, vectors: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(part=router.probabilities(np.stack(f["vec"].to_list())).argmax(1).astype(np.int32))

    return vectors.mapInPandas(run, f"id {id_type}, vec array<double>, part int")


def _routed(router: Router, sizes: dict[int, int], id_type: str, queries: DataFrame) -> DataFrame:
    held = np.array([sizes.get(p, 0) for p in range(router.layers[3].shape[0])])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                order = np.argsort(-router.probabilities(np.stack(f["vec"].to_list())), axis=1, kind="stable")
                enough = (np.cumsum(held[order], axis=1) < MIN_ROWS).sum(1) + 1
                yield f.assign(part=[o[:max(router.probes, e)].astype(np.int32) for o, e in zip(order, enough)])

    return queries.mapInPandas(run, f"id {id_type}, vec array<double>, part array<int>").withColumn("part", F.explode("part"))


def _searcher(k: int):
    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            rows = rows.sort_values("id")
            v, ids = np.stack(rows["vec"].to_list()), rows["id"].to_numpy()
            norm = (v * v).sum(1)
            for q_id, q in zip(queries["id"], queries["vec"]):
                q = np.asarray(q)
                rough = norm - 2 * (v @ q) + q @ q
                rough[ids == q_id] = np.inf
                kth = np.partition(rough, min(k, len(rough)) - 1)[min(k, len(rough)) - 1]
                near = np.nonzero((rough <= kth + 1e-9 * (q @ q + norm.max())) & (ids != q_id))[0]
                diff = v[near] - q
                d = np.sqrt((diff * diff).sum(1))
                first = np.argsort(d, kind="stable")[:k]  # rows are in id order, so ties stay so
                out += [(q_id, ids[near[j]], d[j]) for j in first]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"score": float})

    return search


def search(rows: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``every``."""
    id_type = rows.schema[id_col].dataType.simpleString()
    vectors = stored(usable(rows, id_col, vec_col), "vectors")
    total = vectors.count()
    got = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect() if total else []
    parts = 1
    while total > EXACT_ROWS and parts < MOST_PARTS and 2 * parts * PART_ROWS <= len(got):
        parts *= 2
    sample = np.array([r[1] for r in got]) if got else np.zeros((1, 1))
    router = fit_router(sample, parts)
    placed = stored(_placed(router, id_type, vectors), "placed")
    sizes = {r[0]: r[1] for r in placed.groupBy("part").count().collect()}
    queries = vectors.where(F.col("id") % every == 0)
    q_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    blocks = F.coalesce(*[F.when(F.col("part") == p, F.lit(max(1, -(-n // BLOCK_ROWS)))) for p, n in sorted(sizes.items())], F.lit(1))
    routed = (_routed(router, sizes, id_type, queries).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)))
              .withColumn("vb", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))))
    dealt = (placed.withColumn("vb", F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint")))))
    keys = ["part", "vb", "qb"]
    found = routed.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(
        _searcher(k), f"query_id {id_type}, vec_id {id_type}, score double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
