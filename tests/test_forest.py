"""Forests on a binned table, held against trees grown by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcast.operators import forest as FO


def _table(spark, n=600, seed=1, parts=3):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.integers(0, 6, n), rng.integers(0, 40, n) / 4, rng.normal(size=n)]
    y = 3.0 * (x[:, 0] > 2) + 0.5 * x[:, 1] * (x[:, 2] > 0) + rng.normal(scale=0.2, size=n)
    df = spark.createDataFrame(
        [(i, int(i * 4 // n) - 1, [float(v) for v in r], float(t))
         for i, (r, t) in enumerate(zip(x, y))], "id long, fold int, x array<double>, y double")
    return df.repartition(parts), x, y


def _by_hand(x, y, thresholds, depth, min_split=5, min_leaf=2, node=1):
    """Exhaustive search: {node: (feature, threshold, rows, mean)}."""
    out = {node: (-1, None, len(y), y.mean())}
    if node.bit_length() > depth or len(y) < min_split:
        return out
    best = None
    for f, cuts in enumerate(thresholds):
        for c in cuts:
            left = x[:, f] <= c
            if min_leaf <= left.sum() <= len(y) - min_leaf:
                sse = sum(((p - p.mean()) ** 2).sum() for p in (y[left], y[~left]))
                if best is None or sse < best[0] - 1e-9:
                    best = (sse, f, c, left)
    if best is None or best[0] >= ((y - y.mean()) ** 2).sum() - 1e-9:
        return out
    _, f, c, left = best
    out[node] = (f, c, len(y), y.mean())
    for child, side in ((2 * node, left), (2 * node + 1, ~left)):
        out |= _by_hand(x[side], y[side], thresholds, depth, min_split, min_leaf, child)
    return out


def _nodes(df):
    return {(r["forest"], r["tree"], r["node"]): r for r in df.collect()}


@pytest.mark.parametrize("local_rows", [10 ** 6, 100, 3])
def test_a_tree_equals_the_exhaustive_one(spark, monkeypatch, local_rows):
    """Whether passes over the table or single tasks split the nodes."""
    monkeypatch.setattr(FO, "LOCAL_ROWS", local_rows)
    df, x, y = _table(spark)
    params = FO.ForestParams(trees=1, depth=4, bootstrap=False, bins=64)
    cuts = FO.feature_bins(df, "x", 3, 64)
    assert cuts[0] == [0, 1, 2, 3, 4] and len(cuts[1]) == 39
    got = _nodes(FO.grow_forests(FO.binned_rows(df, "x", "y", cuts).checkpoint(), cuts, [9],
                                 params))
    want = _by_hand(x, y, cuts, 4)
    assert {n for _, _, n in got} == set(want)
    for (_, _, n), r in got.items():
        feature, cut, rows, mean = want[n]
        assert (r["feature"], r["threshold"], r["weight"]) == (feature, cut, rows)
        assert r["prediction"] == pytest.approx(mean, abs=1e-9)


def test_forests_of_folds_do_not_depend_on_partitions_or_sizes(spark, monkeypatch):
    params = FO.ForestParams(trees=4, depth=6, features=2, seed=3)
    results = []
    for parts, local_rows in ((1, 10 ** 6), (5, 10 ** 6), (3, 60)):
        monkeypatch.setattr(FO, "LOCAL_ROWS", local_rows)
        df, x, y = _table(spark, parts=parts)
        cuts = FO.feature_bins(df, "x", 3, 32)
        nodes = FO.grow_forests(FO.binned_rows(df, "x", "y", cuts).checkpoint(), cuts,
                                [0, 2, 9], params)
        results.append({k: (r["feature"], r["bin"], r["weight"], round(r["prediction"], 9))
                        for k, r in _nodes(nodes).items()})
    assert results[0] == results[1] == results[2]
    roots = {k[0]: v[2] for k, v in results[0].items() if k[1:] == (0, 1)}
    for forest, rows in ((0, 150), (1, 450), (2, 600)):       # a bag is about as large as its rows
        assert abs(roots[forest] - rows) < 5 * math.sqrt(rows)


def test_prediction_follows_the_nodes_and_learns(spark):
    df, x, y = _table(spark, 3000)
    cuts = FO.feature_bins(df, "x", 3, 32)
    nodes = FO.grow_forests(FO.binned_rows(df, "x", "y", cuts).checkpoint(), cuts, [9],
                            FO.ForestParams(trees=10, depth=8, features=2)).where("forest = 0")
    model = FO.ForestModel(nodes, cuts)
    got = {r["id"]: r["p"] for r in df.select("id", model.predict(
        [F.col("x")[i] for i in range(3)]).alias("p")).collect()}
    table = _nodes(nodes)
    for i in range(0, 3000, 97):
        means = []
        for t in range(10):
            n = 1
            while table[0, t, n]["feature"] >= 0:
                r = table[0, t, n]
                n = 2 * n + int(x[i, r["feature"]] > r["threshold"])
            means.append(table[0, t, n]["prediction"])
        assert got[i] == pytest.approx(np.mean(means), abs=1e-9)
    p = np.array([got[i] for i in range(3000)])
    assert 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.9
    shares = {r["feature"]: r["importance"] for r in FO.importances(nodes).collect()}
    assert sum(shares.values()) == pytest.approx(1) and set(shares) == {0, 1, 2}
    gain = np.zeros(3)
    for t in range(10):
        own = [r for (_, tree, _), r in table.items() if tree == t and r["feature"] >= 0]
        total = sum(r["weight"] * r["gain"] for r in own)
        for r in own:
            gain[r["feature"]] += r["weight"] * r["gain"] / total / 10
    assert [shares[f] for f in range(3)] == pytest.approx(list(gain))


def test_constant_targets_and_empty_folds(spark):
    df = spark.createDataFrame([(i, 0, [float(i)], 2.5) for i in range(20)],
                               "id long, fold int, x array<double>, y double")
    cuts = FO.feature_bins(df, "x", 1, 32)
    nodes = FO.grow_forests(FO.binned_rows(df, "x", "y", cuts).checkpoint(), cuts, [0, 1],
                            FO.ForestParams(trees=2))
    rows = nodes.collect()
    assert {(r["forest"], r["tree"], r["node"]) for r in rows} == {(1, 0, 1), (1, 1, 1)}
    assert all(r["feature"] == -1 and r["prediction"] == 2.5 for r in rows)
    model = FO.ForestModel(nodes.where("forest = 1"), cuts)
    assert df.select(model.predict([F.col("x")[0]])).distinct().first()[0] == 2.5
    with pytest.raises(ValueError):
        FO.ForestParams(bins=1)


def test_leaves_at_full_depth_are_summed_up_by_the_pass(spark, monkeypatch):
    """No task is dealt the rows of a leaf, however many they are."""
    def refuse(*_):
        raise AssertionError("rows were dealt")
    df, x, y = _table(spark)
    cuts = FO.feature_bins(df, "x", 3, 64)
    binned = FO.binned_rows(df, "x", "y", cuts).checkpoint()
    for depth in (1, 2):
        params = FO.ForestParams(trees=1, depth=depth, bootstrap=False, bins=64)
        whole = _nodes(FO.grow_forests(binned, cuts, [9], params))
        with monkeypatch.context() as m:
            m.setattr(FO, "LOCAL_ROWS", 20)
            m.setattr(FO, "_subtrees", refuse)
            by_passes = _nodes(FO.grow_forests(binned, cuts, [9], params))
        assert set(whole) == set(by_passes) and len(whole) == 2 ** (depth + 1) - 1
        for key, r in whole.items():
            for name, value in r.asDict().items():
                want = value if value is None else pytest.approx(value, rel=1e-9, abs=1e-9)
                assert by_passes[key][name] == want


def test_subtrees_are_dealt_in_rounds_of_few_rows(spark, monkeypatch):
    """A round shuffles no more rows than it may, and rounds change nothing."""
    df, x, y = _table(spark)
    cuts = FO.feature_bins(df, "x", 3, 32)
    binned = FO.binned_rows(df, "x", "y", cuts).checkpoint()
    params, bounds, seen = FO.ForestParams(trees=4, depth=6, features=2), [0, 2, 9], []

    def grown():
        return {k: r.asDict() for k, r in _nodes(FO.grow_forests(binned, cuts, bounds,
                                                                 params)).items()}

    whole, grow = grown(), FO._subtrees
    monkeypatch.setattr(FO, "ROUND_ROWS", 1200)
    monkeypatch.setattr(FO, "ROUND_TABLES", 1)
    monkeypatch.setattr(FO, "_subtrees", lambda *a: seen.append(a[-1]) or grow(*a))
    assert grown() == whole
    assert sorted(t for r in seen for t in r) == list(range(12))
    assert [sum((150, 450, 600)[t // 4] for t in r) for r in seen] == [1050, 900, 1050, 1200,
                                                                       600]
    monkeypatch.setattr(FO, "LOCAL_ROWS", 60)       # the tops by passes
    assert {k: v["weight"] for k, v in grown().items()} == {k: v["weight"]
                                                            for k, v in whole.items()}


def test_bags_are_the_poisson_counts_of_the_hash():
    """The table of counts decides as the distribution does, at its steps too."""
    ids = np.random.default_rng(0).integers(-2 ** 62, 2 ** 62, 200_000)
    bag = FO._bag(ids, 3, FO.ForestParams())
    shares = np.bincount(bag, minlength=8)[:8] / len(ids)
    want = [math.exp(-1) / math.factorial(k) for k in range(8)]
    assert shares == pytest.approx(want, abs=0.005)
    for step in FO._POISSON[:6]:
        assert FO._COUNTS[int(step * 4096)] == 255
