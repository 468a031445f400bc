"""Approximate nearest neighbours with learned partitions.

A bounded sample gives a neighbour graph, whose nodes are split into parts of equal size with few cut edges.  A small
network learns, for a vector, how its neighbours spread over the parts.  It assigns every row to its most probable
part and sends a query to as many of the most probable ones as the sample needs for the wanted recall; there all rows
are compared exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.common import written

#: Rows of one part that a task compares at once; larger parts are dealt out in blocks.
BLOCK_ROWS = 8192


@dataclass(frozen=True)
class Router:
    """Weights of the classifier (empty for a single part), and how many parts a query visits."""

    weights: tuple[np.ndarray, ...]
    parts: int
    probes: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.ones((len(x), 1))
        mean, scale, w1, b1, w2, b2 = self.weights
        return _softmax(np.maximum((x - mean) / scale @ w1 + b1, 0) @ w2 + b2)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that can take part: with an id, of the most frequent length, not all
    zero, and without null or non-finite components."""
    v = F.col("embedding")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size(v) == (sizes["d"] if sizes else 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of every row, itself left out."""
    norms = (x * x).sum(axis=1)
    out = np.empty((len(x), k), dtype=np.int64)
    for a in range(0, len(x), 1024):
        d = norms[None, :] - 2 * x[a : a + 1024] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[a : a + 1024] = np.take_along_axis(near, np.take_along_axis(d, near, axis=1).argsort(axis=1, kind="stable"), axis=1)
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """Split the graph's nodes into parts of nearly equal size: regions grow from seeds over edges until they are
    full, then nodes move to the part where most of their neighbours are, as long as it has room."""
    n, k = graph.shape
    room = -(-n // parts)
    order = np.argsort(graph.ravel(), kind="stable")
    ends = np.searchsorted(graph.ravel()[order], np.arange(n + 1))
    back = order // k
    near = [np.concatenate((graph[i], back[ends[i] : ends[i + 1]])) for i in range(n)]
    part = np.full(n, -1)
    free = rng.permutation(n).tolist()
    for p in range(parts):
        queue, size = [], 0
        while size < room:
            if not queue:
                while free and part[free[-1]] >= 0:
                    free.pop()
                if not free:
                    break
                queue = [free.pop()]
            i = queue.pop(0)
            if part[i] < 0:
                part[i] = p
                size += 1
                queue += [int(j) for j in graph[i] if part[j] < 0]
    most = int(room * 1.1) + 1
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n).tolist():
            votes = np.bincount(part[near[i]], minlength=parts)
            best = int(votes.argmax())
            old = part[i]
            if best != old and votes[best] > votes[old] and sizes[best] < most:
                part[i] = best
                sizes[best] += 1
                sizes[old] -= 1
                moved += 1
        if moved < n / 200:
            break
    return part


def _train(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 30) -> tuple[np.ndarray, ...]:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / scale
    d, p = z.shape[1], target.shape[1]
    w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, p)), np.zeros(p)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for a in range(0, len(z), 256):
            own = order[a : a + 256]
            h = np.maximum(z[own] @ w[0] + w[1], 0)
            g = (_softmax(h @ w[2] + w[3]) - target[own]) / len(own)
            back = (g @ w[2].T) * (h > 0)
            t += 1
            for i, grad in enumerate((z[own].T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0))):
                grad = grad + 1e-5 * w[i]
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                w[i] = w[i] - 0.003 * (m[i] / (1 - 0.9**t)) / ((v[i] / (1 - 0.999**t)) ** 0.5 + 1e-8)
    return (mean, scale, *w)


def fit(rows: DataFrame, sample_rows: int = 8192, rows_per_part: int = 1024, most_parts: int = 128, k: int = 10, recall: float = 0.95, seed: int = 5) -> Router:
    """Learn the parts from about `sample_rows` rows of `usable` rows, chosen by a hash of their values.

    There is one part for every `rows_per_part` rows, at most `most_parts`.  A quarter of the sample is kept out of
    the training: the probes are the fewest parts that hold `recall` of its neighbours in the rest.
    """
    n = rows.count()
    parts = min(most_parts, n // rows_per_part)
    if parts < 2:
        return Router((), 1, 1)
    draw = F.pmod(F.xxhash64("embedding", "vec_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = rows.where(draw < min(1.0, sample_rows / n)).select("vec_id", "embedding").orderBy("vec_id", "embedding").toArrow()
    x = np.array(found["embedding"].to_pylist(), dtype=np.float64)
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(x)) < len(x) // 4
    own, test = x[~held], x[held]
    parts = min(parts, len(own) // (4 * k))
    if parts < 2:
        return Router((), 1, 1)
    graph = neighbour_graph(own, k)
    part = balanced_parts(graph, parts, rng)
    spread = np.zeros((len(own), parts))
    for j in range(k):
        spread[np.arange(len(own)), part[graph[:, j]]] += 1 / k
    weights = _train(own, spread, rng)
    router = Router(weights, parts, parts)
    home = router.probabilities(own).argmax(axis=1)
    ranked = np.argsort(-router.probabilities(test), axis=1, kind="stable")
    place = np.argsort(ranked, axis=1)
    norms = (own * own).sum(axis=1)
    near = np.argpartition(norms[None, :] - 2 * test @ own.T, k - 1, axis=1)[:, :k]
    needed = np.sort(place[np.arange(len(test))[:, None], home[near]].ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return Router(weights, parts, probes)


def assign(rows: DataFrame, router: Router) -> DataFrame:
    """Every row with its part."""
    shared = rows.sparkSession.sparkContext.broadcast(router)

    @F.arrow_udf("int")
    def home(x: pa.Array) -> pa.Array:
        return pa.array(shared.value.probabilities(_matrix(x)).argmax(axis=1).astype(np.int32))

    return rows.withColumn("part", F.lit(0) if router.parts == 1 else home("embedding"))


def _matrix(x: pa.Array) -> np.ndarray:
    return np.asarray(x.flatten(), dtype=np.float64).reshape(len(x), -1) if len(x) else np.zeros((0, 1))


def _route(queries: DataFrame, router: Router, sizes: dict[int, int], k: int) -> DataFrame:
    """Queries with each part they visit: the probes, and further ones until k rows besides their own are there."""
    counts = np.array([sizes.get(p, 0) for p in range(router.parts)])
    shared = queries.sparkSession.sparkContext.broadcast((router, counts))

    @F.arrow_udf("array<int>")
    def visits(x: pa.Array) -> pa.Array:
        own, held = shared.value
        ranked = np.argsort(-own.probabilities(_matrix(x)), axis=1, kind="stable").astype(np.int32)
        enough = (np.cumsum(held[ranked], axis=1) <= k).sum(axis=1) + 1
        return pa.array([r[: max(own.probes, e)].tolist() for r, e in zip(ranked, enough, strict=True)], pa.list_(pa.int32()))

    return queries.withColumn("part", F.explode(visits("embedding")))


def _nearest(k: int):
    def compare(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if len(queries) and len(rows):
            ids = rows["vec_id"].to_numpy()
            x = _matrix(rows["embedding"].combine_chunks())
            for q, v in zip(queries["query_id"].to_pylist(), _matrix(queries["embedding"].combine_chunks()), strict=True):
                score = np.sqrt(((x - v) ** 2).sum(axis=1))
                score[ids == q] = np.inf
                if len(score) > k:
                    near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
                else:
                    near = np.arange(len(score))
                near = near[np.lexsort((ids[near], score[near]))][:k]
                found += [(q, int(ids[i]), float(score[i])) for i in near if score[i] != np.inf]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return compare


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, router: Router | None = None, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance in doubles) of the k nearest rows found for each query.

    Both sides have an id and a vector; rows that bear a query's id are its own and are left out, and of several
    queries with one id the least vector counts.  Ties go to the smaller id.  Vectors that are null, zero, of another
    length, or hold null or non-finite components take no part.  No rows: no results.
    """
    rows = usable(vectors, vec_id, embedding)
    router = router or fit(rows)
    index = written(assign(rows, router), "index")
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    blocks = {p: max(1, -(-n // BLOCK_ROWS)) for p, n in sizes.items()}
    spark = vectors.sparkSession
    table = F.broadcast(spark.createDataFrame(list(blocks.items()) or [(0, 1)], "part int, blocks int"))
    asked = usable(queries, vec_id, embedding).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    width = index.select(F.size("embedding").alias("d")).first()
    asked = asked.where(F.size("embedding") == (width["d"] if width else 0)).withColumnRenamed("vec_id", "query_id")
    routed = _route(asked, router, sizes, k).join(table, "part")
    routed = routed.select("query_id", "embedding", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = index.join(table, "part").withColumn("block", F.pmod(F.hash("vec_id"), F.col("blocks"))).drop("blocks")
    near = routed.groupBy("part", "block").cogroup(dealt.groupBy("part", "block")).applyInArrow(_nearest(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
