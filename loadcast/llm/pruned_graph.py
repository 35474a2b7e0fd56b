"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors are one node. Nodes lie in the shards of their ``overlap`` nearest centres, which
are fitted on a bounded sample; a shard larger than ``BLOCK_ROWS`` is cut into blocks, and every
pair of its blocks is one piece of work, so no group grows without bound. In each piece a flat
graph is built whose adjacency lists are robust-pruned: a candidate goes when a kept neighbour is
nearer to it (by ``ALPHA``) than the node is. A node's lists from all its shards are united.

Over the united graph every node is searched for, greedily from the piece's medoid with a beam;
from all hits the range is expanded along the graph until no new node within the threshold
appears, and every link is verified by the cosine in double precision. A pair that lies in
several pieces is counted in the first only. Components are settled inside the pieces first, so
what leaves a piece is one edge a node at most, not its pairs.

The overlap is at least what lets ``min_recall`` of the pairs at the threshold meet in a shard:
this is counted on sampled nodes that the centres are not fitted on, each with a vector planted at
just that angle, so it needs no links in the data. Recall is audited besides: the links of sampled
nodes are compared with a
comparison against all nodes, more of them (up to ``AUDIT_MOST``) until ``AUDIT_LINKED`` have
links. Where the mean share found per linked node is under ``min_recall``, the overlap is doubled
and the graph is built anew. Without any linked node in the sample nothing is audited: a warning
says so, and audited_recall is null.

Defined cases: vectors that are null, zero, of another length than most or hold null or
non-finite components link with nothing; so do rows without id (component_id is null there);
rows that share an id are one vertex; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components
from .partition_ann import bounded_sample, matrix, valid_vectors

log = logging.getLogger(__name__)

BLOCK_ROWS = 2048
SHARD_ROWS = 1024
CANDIDATES, DEGREE, ALPHA, BEAM = 48, 24, 1.2, 16
AUDIT_ROWS, AUDIT_LINKED, AUDIT_MOST = 256, 200, 4096
PLANTED = 4096
PAIRS_AT_ONCE = 1 << 19


def unit_rows(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def fit_centres(x: np.ndarray, k: int, seed: int = 5, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i:i + 4096] @ centres.T).argmax(1)
                               for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        filled = np.bincount(near, minlength=k) > 0
        centres[filled] = unit_rows(sums[filled])
    return centres


def needed_overlap(x: np.ndarray, centres: np.ndarray, threshold: float, min_recall: float,
                   seed: int = 7) -> int:
    """Least overlap with which ``min_recall`` of the pairs share a shard that unit rows form with
    vectors at the threshold angle, each in a random direction."""
    rng = np.random.default_rng(seed)
    x = x[:PLANTED]
    aside = rng.normal(size=x.shape)
    aside = unit_rows(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * aside

    def ranks(rows):
        order = np.argsort(-(rows @ centres.T), axis=1, kind="stable")
        out = np.empty_like(order)
        np.put_along_axis(out, order, np.arange(order.shape[1])[None, :], axis=1)
        return out

    need = np.concatenate([np.maximum(ranks(x[i:i + 256]), ranks(y[i:i + 256])).min(axis=1) + 1
                           for i in range(0, len(x), 256)])
    return int(np.quantile(need, min_recall, method="inverted_cdf"))


def robust_prune(x: np.ndarray) -> np.ndarray:
    """(len(x), DEGREE) neighbour indices, -1 where there are fewer. Rows are unit vectors, so
    squared distance is 2 - 2 cosine."""
    n = len(x)
    c = min(CANDIDATES, n - 1)
    out = np.full((n, DEGREE), -1, np.int64)
    if c < 1:
        return out
    y = x.astype(np.float32)
    for at in range(0, n, 256):
        s = y[at:at + 256] @ y.T
        own = np.arange(len(s))
        s[own, at + own] = -np.inf
        cand = np.argpartition(-s, c - 1, axis=1)[:, :c]
        dist = 2 - 2 * np.take_along_axis(s, cand, axis=1)
        between = 2 - 2 * np.einsum("bid,bjd->bij", y[cand], y[cand], optimize=True)
        alive = np.ones(dist.shape, bool)
        for r in range(min(DEGREE, c)):
            best = np.where(alive, dist, np.inf).argmin(axis=1)
            some = alive[own, best]
            out[at + own[some], r] = cand[own[some], best[some]]
            alive[own, best] = False
            alive &= ~((ALPHA * between[own, best] <= dist) & some[:, None])
            if not alive.any():
                break
    return out


class Graph:
    """United neighbour lists with their reverses: all of them in one run of indices, and the
    first ``2 * DEGREE`` of each node (own before reverse) as a padded array for the beam."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int):
        own = np.unique(a[a != b] * n + b[a != b])
        back = np.setdiff1d(own % n * n + own // n, own, assume_unique=True)
        a, b = np.concatenate([own, back]) // n, np.concatenate([own, back]) % n
        order = np.argsort(a, kind="stable")
        a, self.near = a[order], b[order]
        self.degree = np.bincount(a, minlength=n)
        self.start = np.concatenate([[0], np.cumsum(self.degree)[:-1]])
        place = np.arange(len(a)) - self.start[a]
        short = place < 2 * DEGREE
        width = max(1, min(2 * DEGREE, int(self.degree.max(initial=0))))
        self.padded = np.full((n, width), -1, np.int64)
        self.padded[a[short], place[short]] = self.near[short]

    def neighbours(self, nodes: np.ndarray) -> np.ndarray:
        """The lists of the nodes, one after the other."""
        d = self.degree[nodes]
        shift = self.start[nodes] - np.concatenate([[0], np.cumsum(d)[:-1]])
        return self.near[np.repeat(shift, d) + np.arange(d.sum())]


def beam_search(x: np.ndarray, graph: np.ndarray, start: int) -> np.ndarray:
    """For each row as query the ``BEAM`` nearest nodes that a greedy search from ``start``
    meets."""
    n = len(x)
    y = x.astype(np.float32)
    pool = np.full((n, BEAM), -1, np.int64)
    near = np.full((n, BEAM), -np.inf, np.float32)
    done = np.ones((n, BEAM), bool)
    pool[:, 0], near[:, 0], done[:, 0] = start, y @ y[start], False
    live = np.arange(n)
    width = graph.shape[1]
    while len(live):
        open_near = np.where(done[live], -np.inf, near[live])
        pick = open_near.argmax(axis=1)
        go = open_near[np.arange(len(live)), pick] > -np.inf
        live, pick = live[go], pick[go]
        if not len(live):
            break
        done[live, pick] = True
        for part in np.array_split(np.arange(len(live)), max(1, len(live) * width // 40_000)):
            q = live[part]
            nb = graph[pool[q, pick[part]]]
            s = np.einsum("qd,qrd->qr", y[q], y[nb])
            known = (nb[:, :, None] == pool[q][:, None, :]).any(axis=2)
            s[(nb < 0) | known] = -np.inf
            all_near = np.concatenate([near[q], s], axis=1)
            top = np.argpartition(-all_near, BEAM - 1, axis=1)[:, :BEAM]
            near[q] = np.take_along_axis(all_near, top, axis=1)
            pool[q] = np.take_along_axis(np.concatenate([pool[q], nb], axis=1), top, axis=1)
            done[q] = np.take_along_axis(np.concatenate([done[q], np.isneginf(s)], axis=1), top,
                                         axis=1)
            done[q] |= np.isneginf(near[q])
            pool[q] = np.where(np.isneginf(near[q]), -1, pool[q])
    return pool


def range_links(x: np.ndarray, graph: Graph, threshold: float) -> np.ndarray:
    """Verified links as a symmetric matrix of flags: greedy search from the medoid, then
    expansion along the graph from every hit. Memory is a few flags a pair of the piece's nodes,
    however many links there are."""
    n = len(x)
    seen, hit, fresh = (np.zeros(n * n, bool) for _ in range(3))

    def visit(pairs):
        seen[pairs] = True
        for i in range(0, len(pairs), 1 << 14):
            k = pairs[i:i + (1 << 14)]
            u, w = np.divmod(k, n)
            near = k[(x[u] * x[w]).sum(axis=1) >= threshold]
            hit[near] = True
            fresh[near] = True

    pool = beam_search(x, graph.padded, int((x @ x.mean(axis=0)).argmax()))
    rows = np.repeat(np.arange(n), pool.shape[1])
    own = np.arange(n) * (n + 1)
    met = pool.reshape(-1) >= 0
    visit(np.unique(rows[met] * n + pool.reshape(-1)[met]))
    for flags in (seen, hit, fresh):      # a search that misses its own node goes on from it
        flags[own] = True
    while len(pairs := np.flatnonzero(fresh)):
        fresh[pairs] = False
        reach = np.cumsum(graph.degree[pairs % n])
        at = 0
        while at < len(pairs):
            done = reach[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(reach, done + PAIRS_AT_ONCE, "right")))
            u, w = np.divmod(pairs[at:end], n)
            new = np.repeat(u, graph.degree[w]) * n + graph.neighbours(w)
            visit(np.unique(new[~seen[new]]))
            at = end
    hit[own] = False
    links = hit.reshape(n, n)
    return links | links.T


def local_components(links: np.ndarray) -> np.ndarray:
    """Smallest index that each index reaches over the links."""
    n = len(links)
    label = np.arange(n)
    while True:
        new = label.copy()
        for at in range(0, n, 256):
            new[at:at + 256] = np.minimum(label[at:at + 256], np.where(
                links[at:at + 256], label, n).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def count_links(links: np.ndarray, copies: np.ndarray, shards: np.ndarray, shard: int,
                apart: np.ndarray | None) -> np.ndarray:
    """Copies linked to each node by pairs that this piece counts: those that share no smaller
    shard, and lie in different blocks where ``apart`` tells the blocks."""
    count = np.zeros(len(links), np.int64)
    some = np.flatnonzero(links.any(axis=1))
    smaller = np.where(shards < shard, shards, -1)
    for at in range(0, len(some), 128):
        u = some[at:at + 128]
        ours = links[np.ix_(u, some)]
        for i in range(shards.shape[1]):
            for j in range(shards.shape[1]):
                mine, other = smaller[u, i], smaller[some, j]
                ours &= ~((mine[:, None] == other[None, :]) & (mine >= 0)[:, None])
        if apart is not None:
            ours &= apart[u][:, None] != apart[some][None, :]
        count[u] = ours @ copies[some]
    return count


def _pieces(nodes: DataFrame, centres, overlap: int) -> DataFrame:
    """Every node in each piece of work it belongs to: shard, i, j (blocks), own block, and the
    sorted list of its shards."""
    def assign(batches):
        for b in batches:
            s = unit_rows(matrix(b.column("v"))) @ centres.value.T
            k = min(overlap, s.shape[1])
            near = np.sort(np.argsort(-s, axis=1, kind="stable")[:, :k], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))],
                [*b.schema.names, "shards"])

    schema = nodes.select("*", F.array(F.lit(0)).alias("shards")).schema
    placed = (nodes.mapInArrow(assign, schema)
              .select("*", F.explode("shards").alias("shard")).checkpoint())
    sizes = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    blocks = F.element_at(F.array(*[
        F.lit(max(1, -(-sizes.get(s, 0) // BLOCK_ROWS)))
        for s in range(max(sizes, default=0) + 1)]), F.col("shard") + 1)
    return (placed.withColumn("blocks", blocks)
            .withColumn("block", F.pmod(F.xxhash64("rep", "shard"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumns({"i": F.least("block", "other").cast("int"),
                          "j": F.greatest("block", "other").cast("int")})
            .select("shard", "i", "j", "block", "shards", "rep", "copies", "v"))


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    return unit_rows(np.stack(pdf["v"].to_numpy()).astype(np.float64))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep", ignore_index=True)
    lists = robust_prune(_vectors(pdf))
    rep = pdf["rep"].to_numpy()
    return pd.DataFrame({"rep": rep, "near": [rep[r[r >= 0]] for r in lists]})


def _search(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        n, rep, block = len(pdf), pdf["rep"].to_numpy(), pdf["block"].to_numpy()
        x = _vectors(pdf)
        size = np.array([0 if v is None else len(v) for v in pdf["near"]])
        a = np.repeat(np.arange(n), size)
        ids = (np.concatenate([v for v in pdf["near"] if v is not None and len(v)])
               if size.sum() else np.empty(0, np.int64))
        b = np.clip(np.searchsorted(rep, ids), 0, n - 1)
        here = rep[b] == ids
        links = range_links(x, Graph(a[here], b[here], n), threshold)
        first = pdf.iloc[0]
        count = count_links(links, pdf["copies"].to_numpy(), np.stack(pdf["shards"].to_numpy()),
                            int(first["shard"]), block if first["i"] != first["j"] else None)
        root = rep[local_components(links)]
        return pd.DataFrame({"rep": rep, "links": count, "root": root})
    return run


def audit_recall(nodes: DataFrame, links: DataFrame, threshold: float) -> float | None:
    """Mean share of a linked node's links that ``links`` (rep, links) has, against a comparison of
    sampled nodes (picked by a hash) with all nodes; None if no sampled node has a link."""
    n, whole = max(nodes.count(), 1), 1 << 31
    place = F.pmod(F.xxhash64("rep"), F.lit(whole))
    rows, low, linked, total = AUDIT_ROWS, 0, 0, 0.0
    while low < whole and rows <= AUDIT_MOST and linked < AUDIT_LINKED:
        high = min(whole, -(-rows * whole // n))
        more, found = _audit(nodes, nodes.where((place >= low) & (place < high)), links, threshold)
        linked, total = linked + more, total + found
        rows, low = 4 * rows, high
    return total / linked if linked else None


def _audit(nodes: DataFrame, sample: DataFrame, links: DataFrame, threshold: float
           ) -> tuple[int, float]:
    """How many nodes of the sample have links, and the sum of the shares found."""
    picked = sample.select("rep", "v").collect()                               # bounded
    if not picked:
        return 0, 0.0
    asked = nodes.sparkSession.sparkContext.broadcast((
        np.array([r["rep"] for r in picked]),
        unit_rows(np.array([r["v"] for r in picked], dtype=np.float64))))

    def count(batches):
        ids, q = asked.value
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            x, rep = unit_rows(matrix(b.column("v"))), b.column("rep").to_numpy()
            copies = b.column("copies").to_numpy()
            for i in range(0, len(ids), AUDIT_ROWS):
                s = x @ q[i:i + AUDIT_ROWS].T >= threshold
                s &= rep[:, None] != ids[None, i:i + AUDIT_ROWS]
                total[i:i + AUDIT_ROWS] += copies @ s
        seen = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(total[seen])],
                                         ["rep", "truth"])

    truth = (nodes.select("rep", "copies", "v").mapInArrow(count, "rep long, truth long")
             .groupBy("rep").agg(F.sum("truth").alias("truth")).where("truth > 0"))
    share = F.least("truth", F.coalesce("links", F.lit(0))) / F.col("truth")
    r = truth.join(links, "rep", "left").agg(F.count("*"), F.sum(share)).first()
    return r[0], r[1] or 0.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, overlap: int = 3,
                    sample_rows: int = 32_768, min_recall: float = 0.995) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) of every row."""
    spark = vectors.sparkSession
    valid, d = valid_vectors(vectors)
    keys = ["h1", "h2"]

    def keyed(df):
        return df.withColumns({"h1": F.xxhash64("embedding"), "h2": F.hash("embedding")})

    nodes = (keyed(valid).groupBy(*keys)
             .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"),
                  F.first("embedding").alias("v")).checkpoint())
    n = nodes.count()
    recall = None
    if n:
        x = unit_rows(np.array([r["v"] for r in bounded_sample(
            nodes.select("rep", "v"), sample_rows, "rep").orderBy("rep").collect()],
            dtype=np.float64))
        k = max(1, min(-(-n // SHARD_ROWS), len(x) // 8))
        planted = x[::8]                        # rows in the order of their ids
        fitted = fit_centres(np.delete(x, np.s_[::8], axis=0) if len(x) > 1 else x, k)
        overlap = max(overlap, needed_overlap(planted, fitted, threshold, min_recall))
        centres = spark.sparkContext.broadcast(fitted)
        piece = ["shard", "i", "j"]
        while True:
            pieces = _pieces(nodes.select("rep", "copies", "v"), centres, overlap)
            lists = (pieces.groupBy(*piece).applyInPandas(_build, "rep long, near array<long>")
                     .groupBy("rep")
                     .agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
                     .checkpoint())
            found = (pieces.join(lists, "rep", "left").groupBy(*piece)
                     .applyInPandas(_search(threshold), "rep long, links long, root long")
                     .checkpoint())
            links = found.groupBy("rep").agg(F.sum("links").alias("links")).checkpoint()
            recall = audit_recall(nodes, links, threshold)
            if recall is None:
                log.warning("no sampled node has a link: recall is not audited, overlap %d is "
                            "that of planted pairs", overlap)
            if recall is None or recall >= min_recall or overlap >= k:
                break
            overlap = min(2 * overlap, k)
        parts = connected_components(found.where("rep != root").select(
            F.col("rep").alias("a"), F.col("root").alias("b")))
        result = (nodes.select(*keys, "rep", "copies").join(links, "rep", "left")
                  .join(parts, F.col("rep") == F.col("node"), "left")
                  .select(*[F.col(c).alias(f"n{c}") for c in keys],
                          (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                          F.coalesce("component", "rep").alias("component")).checkpoint())
    else:
        result = spark.createDataFrame([], "nh1 long, nh2 int, links long, component long")
    rows = keyed(vectors.select("vec_id", "embedding")).select("vec_id", *keys, (
        F.col("vec_id").isNotNull()).alias("named"))
    component = F.coalesce(F.when(F.col("named"), F.col("component")), F.col("vec_id"))
    return (rows.join(result, (F.col("h1") == F.col("nh1")) & (F.col("h2") == F.col("nh2")),
                      "left")
            .select("vec_id",
                    F.coalesce(F.when(F.col("named"), F.col("links")), F.lit(0)).cast("long")
                    .alias("n_links"),
                    component.alias("component_id"),
                    F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
                    F.lit(recall).cast("double").alias("audited_recall")))
