"""Approximate nearest neighbours (largest inner product) by learned partitions.

On a bounded sample of the vectors a neighbour graph is built and cut into ``parts`` partitions of
near-equal size that keep neighbours together. A small classifier learns to tell from a vector
where its neighbours lie. It then places every row in its most probable partition and routes each
query to several partitions, most probable first: as many as the sample's own queries need to find
``target`` of their neighbours. Found candidates are reranked by the exact inner product.

Each partition's rows lie in blocks of bounded size (dealt by a hash of the id), and so do the
queries, so a partition that holds a third of all rows is many groups. Only the sample
(``sample_rows``, a stated bound) reaches the driver.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows without id; equal scores go by the smaller
vec_id; rows that share an id are one candidate, with their best score; with fewer candidates
than ``k`` all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
RESULT = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether the vector is finite in all components and not zero."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(x, lambda c: c != 0), F.lit(False))


def valid_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that take part, and their length."""
    good = vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    size = good.groupBy(F.size("embedding").alias("d")).count().orderBy(
        F.desc("count"), F.desc("d")).first()
    d = size["d"] if size else 0
    return good.where(F.size("embedding") == d), d


def bounded_sample(df: DataFrame, rows: int, key: str) -> DataFrame:
    """About ``rows`` rows at most, picked by a hash of ``key``."""
    share = rows / max(df.count(), 1)
    return df if share >= 1 else df.where(
        F.pmod(F.xxhash64(key), F.lit(1 << 31)) < F.lit(int(share * (1 << 31))))


def matrix(column) -> np.ndarray:
    """An Arrow list column of vectors of one length, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def neighbour_lists(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` largest inner products of each row with the others."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at:at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.empty((len(s), 0), int)
        out[at:at + 1024] = top
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rng, rounds: int = 8
                       ) -> np.ndarray:
    """Partition of the graph's nodes: centres give a first one, then nodes move to where most of
    their neighbours are, as long as no partition exceeds its share by over 10 %."""
    n = len(x)
    room = int(np.ceil(1.1 * n / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(6):
        near = np.argsort(-(x @ centres.T - 0.5 * (centres ** 2).sum(1)), axis=1)
        size = np.zeros(parts, np.int64)
        for i in rng.permutation(n):
            part[i] = next(p for p in near[i] if size[p] < room)
            size[part[i]] += 1
        centres = np.stack([x[part == p].mean(0) if size[p] else centres[p]
                            for p in range(parts)])
    linked: list[list[int]] = [list(r) for r in graph]
    for i, row in enumerate(graph):
        for j in row:
            linked[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[linked[i]], minlength=parts)
            votes[size >= room] = -1
            best = int(np.argmax(votes))
            if votes[best] > np.count_nonzero(part[linked[i]] == part[i]):
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer; log-probability of each partition."""

    def __init__(self, d: int, parts: int, hidden: int, rng):
        self.w1 = rng.normal(0, (2 / max(d, 1)) ** 0.5, (d, hidden))
        self.b1 = np.zeros(hidden)
        self.w2 = rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts))
        self.b2 = np.zeros(parts)
        self.scale = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def train(self, x: np.ndarray, target: np.ndarray, rng, epochs: int = 40,
              rate: float = 3e-3) -> None:
        """Cross entropy against the partitions' shares among each vector's neighbours (Adam)."""
        self.scale = 1 / max(float(np.sqrt((x ** 2).sum(1).mean())), 1e-12) * x.shape[1] ** 0.5
        x = x * self.scale
        names = ("w1", "b1", "w2", "b2")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 128):
                i = order[at:at + 128]
                h = np.maximum(x[i] @ self.w1 + self.b1, 0)
                z = h @ self.w2 + self.b2
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                e = (p - target[i]) / len(i)
                back = (e @ self.w2.T) * (h > 0)
                grads = {"w1": x[i].T @ back + 1e-4 * self.w1, "b1": back.sum(0),
                         "w2": h.T @ e + 1e-4 * self.w2, "b2": e.sum(0)}
                step += 1
                for n, g in grads.items():
                    first[n] += 0.1 * (g - first[n])
                    second[n] += 0.001 * (g * g - second[n])
                    v = getattr(self, n)
                    v -= rate * (first[n] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)


def fit_router(x: np.ndarray, parts: int, k: int, target: float, seed: int = 7):
    """A trained router and the number of partitions a query needs."""
    rng = np.random.default_rng(seed)
    parts = max(1, min(parts, len(x) // 8))
    graph = neighbour_lists(x, 10)
    part = balanced_partition(x, graph, parts, rng) if parts > 1 else np.zeros(len(x), int)
    router = Router(x.shape[1], parts, 96, rng)
    held = rng.random(len(x)) < 0.1            # queries that the router hasn't seen
    share = np.zeros((len(x), parts))
    for j in range(graph.shape[1]):
        np.add.at(share, (np.arange(len(x)), part[graph[:, j]]), 1)
    share[np.arange(len(x)), part] += 1
    share /= share.sum(1, keepdims=True)
    router.train(x[~held], share[~held], rng)
    place = router.scores(x).argmax(1)
    near = neighbour_lists(x, k)[held]
    rank = np.argsort(np.argsort(-router.scores(x[held]), axis=1), axis=1)
    need = np.take_along_axis(rank, place[near], axis=1)
    found = [(need < m).mean() if need.size else 1.0 for m in range(1, parts + 1)]
    probes = next((m for m, f in enumerate(found, 1) if f >= target), parts)
    return router, probes


def best_of_block(queries, query_ids, rows, row_ids, k: int):
    """(query_id, vec_id, score) of each query's ``k`` best rows of a block; ties to the smaller
    id. A product finds them, the exact sum in one order ranks them."""
    out = []
    for at in range(0, len(queries), 256):
        q = queries[at:at + 256]
        s = q @ rows.T
        s[query_ids[at:at + 256, None] == row_ids[None, :]] = -np.inf
        if len(rows) > k:
            least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        else:
            least = np.full(len(q), -np.inf)
        for i in range(len(q)):
            margin = 1e-9 * max(1.0, abs(least[i])) if np.isfinite(least[i]) else 0.0
            pick = np.flatnonzero((s[i] >= least[i] - margin) & (s[i] > -np.inf))
            exact = (rows[pick] * q[i]).sum(axis=1)
            order = np.lexsort((row_ids[pick], -exact))[:k]
            out.append((np.full(len(order), query_ids[at + i]), row_ids[pick][order],
                        exact[order]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def search(vectors: DataFrame, is_query: Column, k: int = 20, parts: int = 16,
           sample_rows: int = 4096, target: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row for which
    ``is_query`` holds."""
    spark = vectors.sparkSession
    rows, d = valid_vectors(vectors)
    sample = bounded_sample(rows, sample_rows, "vec_id").orderBy("vec_id").select("embedding")
    x = np.array([r[0] for r in sample.collect()], dtype=np.float64).reshape(-1, max(d, 1))
    empty = spark.createDataFrame([], RESULT)
    if len(x) < 1:
        return _ranked(empty, k)
    router, probes = fit_router(x, parts, k, target)
    parts = len(router.b2)
    shipped = spark.sparkContext.broadcast(router)      # bounded by its shape

    def route(count):
        def run(batches):
            for b in batches:
                top = np.argsort(-shipped.value.scores(matrix(b.column("embedding"))), axis=1,
                                 kind="stable")[:, :count]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("embedding"),
                     pa.array(list(top.astype(np.int32)), pa.list_(pa.int32()))],
                    ["vec_id", "embedding", "parts"])
        return run

    schema = rows.select("vec_id", "embedding", F.array(F.lit(0)).alias("parts")).schema
    placed = rows.mapInArrow(route(1), schema).select("vec_id", "embedding",
                                                      F.col("parts")[0].alias("part")).checkpoint()
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    blocks = F.array(*[F.lit(max(1, -(-sizes.get(p, 0) // BLOCK_ROWS))) for p in range(parts)])
    of_part = F.element_at(blocks, F.col("part") + 1)
    asked = rows.where(is_query)
    query_blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    index = (placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), of_part).cast("int"))
             .withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))
    wanted = (asked.mapInArrow(route(probes), schema)
              .select("vec_id", "embedding", F.explode("parts").alias("part"))
              .withColumn("block", F.explode(F.sequence(F.lit(0), of_part - 1)))
              .withColumn("asked", F.pmod(F.xxhash64("vec_id", F.lit(1)),
                                          F.lit(query_blocks)).cast("int")))

    def compare(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        r = r.assign(_bytes=[v.tobytes() for v in r["embedding"]])
        r = r.drop_duplicates(["vec_id", "_bytes"])
        a, b, s = best_of_block(
            np.stack(q["embedding"].to_numpy()).astype(np.float64), q["vec_id"].to_numpy(),
            np.stack(r["embedding"].to_numpy()).astype(np.float64), r["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    keys = ["part", "block", "asked"]
    found = wanted.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(compare, RESULT)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def exact_nearest(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> dict:
    """Brute force, to measure recall: query id -> its ``k`` nearest ids."""
    at = {int(v): i for i, v in enumerate(ids)}
    q = np.array([at[int(v)] for v in queries], dtype=int)
    a, b, _ = best_of_block(x[q], ids[q], x, ids, k)
    out: dict[int, list[int]] = {}
    for query, found in zip(a.tolist(), b.tolist()):
        out.setdefault(query, []).append(found)
    return out
