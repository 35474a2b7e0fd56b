"""Random forests of regression trees (M9), grown on one binned table.

Feature values are binned once (``feature_bins``, ``binned_rows``); several forests, such as the
one of each cross-validation fold and the final one, then grow side by side over the same table: a
forest learns from the rows whose ``fold`` is below its bound.

A tree's node with more than ``LOCAL_ROWS`` rows is split by a pass over the table: each task adds
up histograms of its rows for all such nodes of all trees, the histograms of a node are summed in
one place and its best split reaches the driver. Below that size a node's rows are dealt to one
task, which grows the rest of the subtree. The trees are dealt in rounds, as the rows of all bags
are many times the table; what a round shuffled is deleted before the next one. Both use the same
search, so that the size changes the work and not the forest. The bag of a tree is a Poisson(1)
count drawn from a hash of the row's id and the tree's number, and the features a node may use are
drawn from its place: neither depends on partitions.

A forest is a table of nodes; node ``i`` has the children ``2 i`` (feature <= threshold) and
``2 i + 1``. Importances are an aggregate over it. To predict, the nodes are collected and shared
with the tasks: trees x 2^(depth + 1) nodes at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import release_disk

LOCAL_ROWS = 500_000
BATCH_ROWS = 50_000       # rows that a task bags and routes at a time
PASS_ROWS, PASS_TASKS = 200_000, 256
ROOTS_A_TASK = 8          # subtrees that one task grows, one after another
#: a round deals the trees of so many rows before bagging, or of the table so many times over
ROUND_ROWS, ROUND_TABLES = 15_000_000, 4
NODES = ("forest int, tree int, node int, feature int, bin int, threshold double, weight double, "
         "prediction double, impurity double, gain double")
TIE = 1e-10
#: P(X <= k) of a Poisson variable with mean 1, k = 0, 1, ...
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(16)])
#: the count by a hash's upper 12 bits; 255 where the lower ones decide
_COUNTS = np.where(np.searchsorted(_POISSON, np.arange(4096) / 4096, "right")
                   == np.searchsorted(_POISSON, np.arange(1, 4097) / 4096, "left"),
                   np.searchsorted(_POISSON, np.arange(4096) / 4096, "right"), 255).astype(np.uint8)


@dataclass(frozen=True)
class ForestParams:
    """``features``: how many a node chooses from (None: all); ``min_split`` and ``min_leaf``
    count bagged rows."""
    trees: int = 50
    depth: int = 15
    min_split: int = 5
    min_leaf: int = 2
    features: int | None = None
    bootstrap: bool = True
    bins: int = 32
    seed: int = 42

    def __post_init__(self):
        if not (1 <= self.depth <= 20 and 2 <= self.bins <= 256):
            raise ValueError("a forest has 1 to 20 levels and 2 to 256 bins a feature")


# ------------------------------------------------------------------------------ bins
def feature_bins(rows: DataFrame, x: str, size: int, bins: int) -> list[list[float]]:
    """Ascending thresholds of each feature of the array column ``x``: all values but the largest
    where there are ``bins`` or fewer, else quantiles (of a sketch). Two aggregates."""
    value = [F.element_at(F.col(x), i + 1) for i in range(size)]
    probs = [k / bins for k in range(1, bins)]
    first = rows.agg(*[F.approx_count_distinct(v).alias(f"n{i}") for i, v in enumerate(value)],
                     *[F.percentile_approx(v, probs, 10_000).alias(f"q{i}")
                       for i, v in enumerate(value)]).first()
    few = [i for i in range(size) if first[f"n{i}"] <= 2 * bins]   # a set of 2 bins and some more
    sets = rows.agg(*[F.collect_set(value[i]).alias(f"s{i}") for i in few]).first() if few else {}
    out = []
    for i in range(size):
        if i in few and len(sets[f"s{i}"]) <= bins:
            out.append(sorted(sets[f"s{i}"])[:-1])
        else:
            out.append(sorted(set(first[f"q{i}"] or [])))
    return out


def _bin_rows(x: pa.Array, thresholds: list[list[float]]) -> np.ndarray:
    """Bin numbers (rows x features): bin <= k if and only if the value <= threshold k."""
    values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(thresholds))
    return np.stack([np.searchsorted(t, values[:, i], "left") for i, t in enumerate(thresholds)],
                    axis=1).astype(np.uint8)


def binned_rows(rows: DataFrame, x: str, y: str, thresholds: list[list[float]]) -> DataFrame:
    """(id, fold, y, bins) of ``rows`` with columns id (long), fold (int) and the given ones."""
    def run(batches):
        for b in batches:
            codes = _bin_rows(b.column("x"), thresholds)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("fold"), b.column("y"),
                 pa.array([r.tobytes() for r in codes], pa.binary())], ["id", "fold", "y", "bins"])

    return rows.select("id", F.col("fold").cast("int").alias("fold"),
                       F.col(y).cast("double").alias("y"), F.col(x).alias("x")).mapInArrow(
        run, "id long, fold int, y double, bins binary")


# ------------------------------------------------------------------------------ search
def _bag(ids: np.ndarray, tree: int, params: ForestParams) -> np.ndarray:
    """How often each row is in the tree's bag."""
    if not params.bootstrap:
        return np.ones(len(ids), np.uint8)
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(
            1 + tree + params.seed * 1_000_003)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    count = _COUNTS[z >> np.uint64(52)]
    unclear = np.flatnonzero(count == 255)
    count[unclear] = np.searchsorted(_POISSON, (z[unclear] >> np.uint64(11)) * 2.0 ** -53, "right")
    return count


def _choices(level: int, tree: int, size: int, params: ForestParams) -> np.ndarray:
    """The features that each node of a level may use (nodes x features, ascending)."""
    if params.features is None or params.features >= size:
        return np.broadcast_to(np.arange(size), (1 << level, size))
    drawn = np.random.default_rng([params.seed, tree, level]).random((1 << level, size))
    return np.sort(drawn.argsort(axis=1)[:, :params.features], axis=1)


def _by_feature(codes: np.ndarray) -> np.ndarray:
    """The codes of rows x features, feature after feature."""
    return np.ascontiguousarray(codes.T).reshape(-1)


def _histogram(columns, length, at, node, nodes, feature, bins, values):
    """Sums of each of ``values`` by (node, bin), where a row's bin is that of its node's
    ``feature``. ``columns``: the codes ``_by_feature`` of ``length`` rows, ``at``: the rows'
    places there, ``node``: their nodes' places."""
    cell = (feature * length)[node]
    cell += at
    cell = node * bins + columns[cell]
    return [np.bincount(cell, v, nodes * bins).reshape(nodes, bins) for v in values]


class _Search:
    """The best split of each of some nodes, from histograms that come feature by feature.
    Sums are of the bag count w, of w y and of w y^2."""

    def __init__(self, w, s, q, params: ForestParams):
        self.w, self.s, self.q, self.params = w, s, q, params
        n = len(w)
        with np.errstate(all="ignore"):
            self.mean = np.where(w > 0, s / w, 0.0)
            self.impurity = np.maximum(np.where(w > 0, q / w - self.mean ** 2, 0.0), 0.0)
        self.best = np.full(n, -np.inf)
        self.feature, self.bin = np.full(n, -1), np.zeros(n, np.int64)

    def add(self, nodes, feature, hw, hs):
        """A feature's histograms of some ``nodes`` (their places, ascending)."""
        lw = np.cumsum(hw, axis=1)
        least = self.params.min_leaf
        possible = np.flatnonzero((hw > 0) & (lw >= least)
                                  & (lw <= self.w[nodes][:, None] - least))
        if not len(possible):
            return
        row, at = np.divmod(possible, hw.shape[1])
        lw, ls = lw.reshape(-1)[possible], np.cumsum(hs, axis=1).reshape(-1)[possible]
        rw, rs = self.w[nodes][row] - lw, self.s[nodes][row] - ls
        score = ls ** 2 / lw + rs ** 2 / rw
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        most = np.maximum.reduceat(score, first)
        # equal up to rounding: the first bin, the first feature
        near = np.flatnonzero(score >= np.repeat(most, np.diff(np.r_[first, len(row)])) * (1 - TIE))
        near = near[np.r_[True, row[near][1:] != row[near][:-1]]]
        here, score = nodes[row[near]], score[near]
        best = self.best[here]
        better = score > np.where(best > 0, best * (1 + TIE), best)
        here = here[better]
        self.best[here] = score[better]
        self.feature[here] = feature[row[near]][better]
        self.bin[here] = at[near][better]

    def close(self):
        """Splits that gain nothing are none."""
        with np.errstate(all="ignore"):
            self.gain = np.where(np.isfinite(self.best),
                                 (self.best - self.s ** 2 / self.w) / self.w, 0.0)
        split = ((self.w >= self.params.min_split) & (self.gain > 0)
                 & (self.gain > 1e-10 * self.impurity) & (self.impurity > 0))
        self.feature = np.where(split, self.feature, -1)
        self.gain = np.where(split, self.gain, 0.0)
        return self


def _grow(codes, y, w, root: int, tree: int, params: ForestParams) -> dict[str, np.ndarray]:
    """All nodes of the subtree under ``root`` over some rows."""
    columns, length, size = _by_feature(codes), *codes.shape
    rows, place, ids = np.arange(length), np.zeros(length, np.int64), np.array([root])
    values = [w, w * y, w * y * y]
    out = []
    for level in range(root.bit_length() - 1, params.depth + 1):
        if not len(ids):
            break
        k = len(ids)
        search = _Search(*[np.bincount(place, v, k) for v in values], params)
        if level < params.depth:
            is_open = (search.w >= params.min_split) & (search.impurity > 0)
            nodes = np.flatnonzero(is_open)
            choice = _choices(level, tree, size, params)[ids[nodes] - (1 << level)]
            at, inside, own = rows, place, values[:2]
            if len(nodes) < k:
                some = is_open[place]
                inside = (np.cumsum(is_open) - 1)[place[some]]
                at, own = rows[some], [v[some] for v in own]
            for j in range(choice.shape[1] if len(nodes) else 0):
                search.add(nodes, choice[:, j], *_histogram(
                    columns, length, at, inside, len(nodes), choice[:, j], params.bins, own))
        search.close()
        out.append((ids, search.feature, search.bin, search.w, search.mean, search.impurity,
                    search.gain))
        split = search.feature >= 0
        if not split.all():
            stay = split[place]
            rows, place, values = rows[stay], place[stay], [v[stay] for v in values]
        right = columns[(search.feature * length)[place] + rows] > search.bin[place]
        place = (2 * (np.cumsum(split) - 1))[place] + right
        ids = np.stack([2 * ids[split], 2 * ids[split] + 1], axis=1).reshape(-1)
    return [np.concatenate(c) for c in zip(*out)]


# ------------------------------------------------------------------------------ trees
class _Tops:
    """What is split so far: per tree dense arrays by node. ``state``: 0 unknown, 1 split, 2 to
    be grown by one task, 3 a leaf, 4 to be split by a pass."""

    def __init__(self, trees: int):
        self.feature = [np.full(2, -1) for _ in range(trees)]
        self.bin = [np.zeros(2, np.int64) for _ in range(trees)]
        self.state = [np.zeros(2, np.int8) for _ in range(trees)]

    def grow_to(self, tree: int, node: int):
        while node >= len(self.state[tree]):
            for name, fill in (("feature", -1), ("bin", 0), ("state", 0)):
                old = getattr(self, name)[tree]
                getattr(self, name)[tree] = np.r_[old, np.full(len(old), fill, old.dtype)]

    def route(self, tree: int, columns: np.ndarray, length: int, rows: np.ndarray) -> np.ndarray:
        """The node that each of ``rows`` stands in."""
        return _route(self.feature[tree], self.bin[tree], columns, length, rows)


def _route(feature, cut, columns, length, rows) -> np.ndarray:
    """The leaf of each of ``rows``, whose codes ``columns`` holds ``_by_feature``: a node
    without a feature is its own left child, and no code passes its bin."""
    here = np.arange(len(feature))
    left = np.where(feature >= 0, 2 * here, here)
    start = np.maximum(feature, 0).astype(np.int64) * length
    cut = np.where(feature >= 0, cut, 255)
    node = np.ones(len(rows), np.int64)
    for _ in range(len(feature).bit_length()):
        if not (feature[node] >= 0).any():
            break
        node = left[node] + (columns[start[node] + rows] > cut[node])
    return node


def _batches(batches, size: int):
    """(ids, folds, y, codes) of each batch of ``BATCH_ROWS`` rows or a few more."""
    held = []

    def joined():
        codes = np.frombuffer(b"".join(c for b in held for c in b.column("bins").to_pylist()),
                              np.uint8)
        columns = [np.concatenate([b.column(c).to_numpy() for b in held])
                   for c in ("id", "fold", "y")]
        return *columns, codes.reshape(-1, size)

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.num_rows for h in held) >= BATCH_ROWS:
            yield joined()
            held.clear()
    if held:
        yield joined()


def _bagged(ids, folds, codes, bounds, params, asked):
    """(tree number, places of its bagged rows among ``at``, ``at``, their counts, codes of the
    rows ``at`` by feature) for the trees ``asked`` for: rows of a forest are taken once."""
    for forest, bound in enumerate(bounds):
        trees = [t for t in range(forest * params.trees, (forest + 1) * params.trees) if t in asked]
        at = np.flatnonzero(folds < bound) if trees else ()
        if not len(at):
            continue
        columns, own = _by_feature(codes[at]), ids[at]
        for tree in trees:
            w = _bag(own, tree % params.trees, params)
            places = np.flatnonzero(w)
            yield tree, places, at, w[places], columns


def _split_pass(binned: DataFrame, size, bounds, params, tops: _Tops, level, shift):
    """Rows (tree number, node, sums, best split, sums of its two sides) of all nodes in state
    4."""
    shared = binned.sparkSession.sparkContext.broadcast(tops)

    def sums(batches):
        state, cells = shared.value, {}
        asked = {t for t, s in enumerate(state.state) if (s == 4).any()}
        for ids, folds, y, codes in _batches(batches, size):
            y = y - shift
            for tree, places, at, w, columns in _bagged(ids, folds, codes, bounds, params, asked):
                nodes = np.flatnonzero(state.state[tree] == 4)
                place = np.full(len(state.state[tree]), -1)
                place[nodes] = np.arange(len(nodes))
                node = place[state.route(tree, columns, len(at), places)]
                if len(nodes) < 1 << level:
                    some = node >= 0
                    places, node, w = places[some], node[some], w[some]
                own = y[at[places]]
                values = [w.astype(float), w * own, w * own * own]
                choice = _choices(level, tree % params.trees, size, params)[nodes - (1 << level)]
                stacked = np.stack([np.stack(_histogram(columns, len(at), places, node, len(nodes),
                                                        choice[:, j], params.bins, values))
                                    for j in range(choice.shape[1])], axis=0)
                cells[tree] = cells.get(tree, 0) + stacked
        out = [(tree, int(n), c[:, :, k].tobytes()) for tree, c in cells.items()
               for k, n in enumerate(np.flatnonzero(state.state[tree] == 4))]
        kinds = [pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 3, kinds)],
            ["tree", "node", "cells"])

    def best(table: pa.Table) -> pa.Table:
        tree, node = table["tree"][0].as_py(), table["node"][0].as_py()
        cells = sum(np.frombuffer(c) for c in table["cells"].to_pylist())
        choice = _choices(level, tree % params.trees, size, params)[node - (1 << level)]
        cells = cells.reshape(len(choice), 3, 1, params.bins)
        search = _Search(*cells[0].sum(axis=2), params)
        for j, feature in enumerate(choice):
            search.add(np.array([0]), np.array([feature]), *cells[j][:2])
        search.close()
        sides = [0.0] * 6
        if search.feature[0] >= 0:
            chosen = cells[list(choice).index(search.feature[0]), :, 0]
            cut = search.bin[0] + 1
            sides = [*chosen[:, :cut].sum(axis=1), *chosen[:, cut:].sum(axis=1)]
        return pa.table([pa.array([v]) for v in (
            tree, node, int(search.feature[0]), int(search.bin[0]), float(search.w[0]),
            float(search.mean[0]), float(search.impurity[0]), float(search.gain[0]))]
            + [pa.array([[float(v) for v in sides]])],
            ["tree", "node", "feature", "bin", "weight", "prediction", "impurity", "gain",
             "sides"])

    return (binned.mapInArrow(sums, "tree int, node int, cells binary")
            .groupBy("tree", "node").applyInArrow(
                best, "tree long, node long, feature long, bin long, weight double, prediction "
                      "double, impurity double, gain double, sides array<double>").collect())


def _rounds(tops: _Tops, rows: list[int], table: int, params: ForestParams) -> list[list[int]]:
    """The trees with nodes in state 2, by the round that deals them. ``rows``: those that each
    forest learns from."""
    most = max(ROUND_ROWS, ROUND_TABLES * table)
    rounds, dealt = [], most
    for tree, state in enumerate(tops.state):
        if (state == 2).any():
            own = rows[tree // params.trees]
            if dealt + own > most:
                rounds.append([])
                dealt = 0
            rounds[-1].append(tree)
            dealt += own
    return rounds


def _subtrees(binned: DataFrame, size, bounds, params, tops: _Tops, shift, trees) -> DataFrame:
    """Nodes below those in state 2 of some ``trees``, each grown by one task from its rows."""
    spark, asked = binned.sparkSession, set(trees)
    shared = spark.sparkContext.broadcast(tops)
    roots = sum(int((tops.state[t] == 2).sum()) for t in trees)

    def deal(batches):
        state, part = shared.value, TaskContext.get().partitionId() << 32
        for turn, (ids, folds, y, codes) in enumerate(_batches(batches, size)):
            out = []
            for tree, places, at, w, columns in _bagged(ids, folds, codes, bounds, params, asked):
                node = state.route(tree, columns, len(at), places)
                some = np.flatnonzero(state.state[tree][node] == 2)
                order = some[np.argsort(node[some], kind="stable")]
                node, places, w = node[order], at[places[order]], w[order]
                ends = np.flatnonzero(np.r_[node[1:] != node[:-1], True]) + 1 if len(node) else []
                own_codes, own_y = codes[places], y[places]
                for a, b in zip(np.r_[0, ends[:-1]] if len(node) else [], ends):
                    out.append((tree, int(node[a]), part + turn, own_codes[a:b].tobytes(),
                                own_y[a:b].tobytes(), w[a:b].tobytes()))
            kinds = [pa.int32()] * 2 + [pa.int64()] + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, kinds)],
                ["tree", "node", "part", "codes", "y", "w"])

    def grow(table: pa.Table) -> pa.Table:
        tree, root = table["tree"][0].as_py(), table["node"][0].as_py()
        # sums are taken in one order, whatever came first
        order = np.argsort(table["part"].to_numpy())
        codes, y, w = (
            np.frombuffer(b"".join(map(table[c].to_pylist().__getitem__, order)), kind)
            for c, kind in (("codes", np.uint8), ("y", np.float64), ("w", np.uint8)))
        columns = _grow(codes.reshape(len(y), size), y - shift, w.astype(float), root,
                        tree % params.trees, params)
        return pa.table([pa.array(np.full(len(columns[0]), tree)), *map(pa.array, columns)],
                        ["tree", "node", "feature", "bin", "weight", "prediction", "impurity",
                         "gain"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), roots // ROOTS_A_TASK)
    return (binned.mapInArrow(deal, "tree int, node int, part long, codes binary, y binary, "
                                    "w binary")
            .repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(
                grow, "tree long, node long, feature long, bin long, weight double, "
                      "prediction double, impurity double, gain double"))


def grow_forests(binned: DataFrame, thresholds: list[list[float]], bounds: list[int],
                 params: ForestParams = ForestParams()) -> DataFrame:
    """The nodes (see ``NODES``) of one forest per bound: ``forest`` k learns from the rows of
    ``binned`` whose fold is below ``bounds[k]``. Checkpointed."""
    spark, size = binned.sparkSession, len(thresholds)
    if max(map(len, thresholds), default=0) >= params.bins:
        raise ValueError("a feature has more thresholds than bins")
    counts = binned.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()
    rows = [sum(r["n"] for r in counts if r["fold"] < b) for b in bounds]
    shift = sum(r["s"] for r in counts) / max(sum(r["n"] for r in counts), 1)
    # a pass sends a node's sums from every task: tasks of many rows, so that sums stay few
    tasks = max(4 * spark.sparkContext.defaultParallelism,
                min(PASS_TASKS, sum(r["n"] for r in counts) // PASS_ROWS))
    if binned.rdd.getNumPartitions() > tasks:
        binned = binned.coalesce(tasks)
    tops = _Tops(len(bounds) * params.trees)
    for tree in range(len(tops.state)):
        n = rows[tree // params.trees]
        tops.state[tree][1] = 0 if n == 0 else 2 if n <= LOCAL_ROWS else 4
    found = []
    for level in range(params.depth):
        if not any((s == 4).any() for s in tops.state):
            break
        for r in _split_pass(binned, size, bounds, params, tops, level, shift):
            tree, node = r["tree"], r["node"]
            found.append(tuple(r)[:8])
            tops.state[tree][node] = 3 if r["feature"] < 0 else 1
            if r["feature"] >= 0:
                tops.feature[tree][node], tops.bin[tree][node] = r["feature"], r["bin"]
                tops.grow_to(tree, 2 * node + 1)
                for child, (w, s, q) in ((2 * node, r["sides"][:3]),
                                         (2 * node + 1, r["sides"][3:])):
                    # a leaf at full depth needs no rows: the pass has summed it up
                    if level + 1 == params.depth:
                        found.append((tree, child, -1, 0, w, s / w,
                                      max(q / w - (s / w) ** 2, 0.0), 0.0))
                    tops.state[tree][child] = 3 if level + 1 == params.depth else \
                        4 if w > LOCAL_ROWS else 2
        release_disk(spark)
    above = spark.createDataFrame(found, "tree long, node long, feature long, bin long, "
                                         "weight double, prediction double, impurity double, "
                                         "gain double")
    nodes = _named_nodes(above, thresholds, params, shift).checkpoint()
    for trees in _rounds(tops, rows, sum(r["n"] for r in counts), params):
        nodes = nodes.unionByName(_named_nodes(
            _subtrees(binned, size, bounds, params, tops, shift, trees), thresholds, params,
            shift).checkpoint())
        release_disk(spark)
    return nodes


def _named_nodes(nodes: DataFrame, thresholds, params: ForestParams, shift) -> DataFrame:
    cut = F.array(*[F.array(*[F.lit(float(v)) for v in t]).cast("array<double>")
                    for t in thresholds])
    return nodes.select(
        F.floor(F.col("tree") / params.trees).cast("int").alias("forest"),
        (F.col("tree") % params.trees).cast("int").alias("tree"),
        F.col("node").cast("int").alias("node"), F.col("feature").cast("int").alias("feature"),
        F.when(F.col("feature") >= 0, F.col("bin").cast("int")).alias("bin"),
        F.when(F.col("feature") >= 0, F.get(F.get(cut, F.col("feature").cast("int")),
                                            F.col("bin").cast("int"))).alias("threshold"),
        "weight", (F.col("prediction") + F.lit(shift)).alias("prediction"), "impurity", "gain")


def importances(nodes: DataFrame) -> DataFrame:
    """(feature, importance): per tree the impurity that a feature's splits take away, weighted
    by rows, as a share of the tree's; the mean over the trees that split, as a share of all."""
    gains = (nodes.where("feature >= 0").groupBy("tree", "feature")
             .agg(F.sum(F.col("weight") * F.col("gain")).alias("g")))
    shares = gains.join(gains.groupBy("tree").agg(F.sum("g").alias("all")), "tree")
    mean = shares.groupBy("feature").agg(F.sum(F.try_divide("g", "all")).alias("m"))
    total = mean.agg(F.sum("m").alias("total"))
    return mean.join(F.broadcast(total)).select(     # one row
        "feature", F.try_divide("m", "total").alias("importance"))


# ------------------------------------------------------------------------------ prediction
class ForestModel:
    """Predicts from a table of one forest's nodes."""

    def __init__(self, nodes: DataFrame, thresholds: list[list[float]]):
        self.nodes, self.thresholds = nodes, thresholds
        table = nodes.select("tree", "node", "feature", "bin", "prediction").toArrow()
        tree, node = table["tree"].to_numpy(), table["node"].to_numpy()
        trees = np.unique(tree)
        width = 1 << int(node.max(initial=1)).bit_length()
        self._feature = np.full((len(trees), width), -1, np.int16)
        self._bin = np.zeros((len(trees), width), np.uint8)
        self._mean = np.zeros((len(trees), width))
        at = (np.searchsorted(trees, tree), node)
        self._feature[at] = table["feature"].to_numpy()
        self._bin[at] = table["bin"].fill_null(0).to_numpy()
        self._mean[at] = table["prediction"].to_numpy()

    def predict(self, columns: list[Column]) -> Column:
        """The mean of the trees' predictions for feature columns (doubles, not null)."""
        thresholds = self.thresholds
        shared = self.nodes.sparkSession.sparkContext.broadcast(
            (self._feature, self._bin, self._mean))

        @F.arrow_udf("double")
        def forest(x: pa.Array) -> pa.Array:
            feature, cut, mean = shared.value
            columns = _by_feature(_bin_rows(x, thresholds))
            rows, total = np.arange(len(x)), np.zeros(len(x))
            for t in range(len(feature)):
                total += mean[t][_route(feature[t], cut[t], columns, len(x), rows)]
            return pa.array(total / max(len(feature), 1))

        return forest(F.array(*[c.cast("double") for c in columns]))
