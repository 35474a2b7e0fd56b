"""Operators on embeddings, held against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcast.llm import partition_ann, pruned_graph

SCHEMA = "vec_id long, embedding array<float>, label int, part string, rep string, v string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame(
        [(i if i is None else int(i), None if v is None else [None if c is None else float(c)
                                                             for c in v], 0, "x", "y", "z")
         for i, v in zip(ids, vectors)], SCHEMA)


BAD = [None, [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7,
       [1.0, 2.0]]


def random_vectors(n, seed=0, d=8):
    return np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)


def test_nearest_by_learned_partitions(spark):
    x = random_vectors(1500)
    x[100:400] = x[100]                        # a hot vector
    vectors = [*x.tolist(), *BAD]
    df = table(spark, vectors)
    rows = partition_ann.search(df.unionByName(df.where("vec_id % 100 = 0")),
                                F.col("vec_id") % 20 == 0, 10, parts=8, sample_rows=800).collect()
    ids = np.arange(1500)
    want = partition_ann.exact_nearest(x.astype(np.float64), ids, ids[::20], 10)
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(want)
    found = 0
    for q, found_rows in got.items():
        found_rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found_rows] == list(range(1, len(found_rows) + 1))
        assert [(-r["score"], r["vec_id"]) for r in found_rows] == \
            sorted((-r["score"], r["vec_id"]) for r in found_rows)
        assert len({r["vec_id"] for r in found_rows}) == len(found_rows)
        assert q not in {r["vec_id"] for r in found_rows}
        for r in found_rows:
            assert r["score"] == pytest.approx(float(
                x[q].astype(float) @ x[r["vec_id"]].astype(float)), abs=1e-12)
        found += len({r["vec_id"] for r in found_rows} & set(want[q]))
    assert found / (10 * len(want)) >= 0.9


def test_exact_nearest_breaks_ties_by_id():
    x = np.ones((50, 4))
    near = partition_ann.exact_nearest(x, np.arange(50), np.array([0, 7]), 5)
    assert near == {0: [1, 2, 3, 4, 5], 7: [0, 1, 2, 3, 4]}


def test_few_and_no_vectors(spark):
    few = partition_ann.search(table(spark, random_vectors(4).tolist()),
                               F.col("vec_id") % 2 == 0, 20).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == \
        [(q, r) for q in (0, 2) for r in (1, 2, 3)]
    assert partition_ann.search(table(spark, BAD), F.col("vec_id") % 2 == 0).count() == 0
    assert partition_ann.search(table(spark, BAD).limit(0), F.lit(True)).count() == 0


def near_by_hand(x, threshold):
    u = pruned_graph.unit_rows(x.astype(np.float64))
    s = u @ u.T >= threshold
    np.fill_diagonal(s, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[s[i]]]) for i in range(len(x))])
        if (new == label).all():
            return s.sum(1), label
        label = new


@pytest.mark.parametrize("block_rows", [2048, 60])
def test_near_duplicates(spark, monkeypatch, block_rows):
    monkeypatch.setattr(pruned_graph, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(pruned_graph, "SHARD_ROWS", 80)
    rng = np.random.default_rng(1)
    base = random_vectors(250, 2, 16)
    near = np.concatenate([b + rng.normal(scale=0.12, size=(k, 16)) for b, k in
                           zip(base[:12], [2, 2, 3, 5, 8, 13, 90, 4, 4, 2, 2, 3])])
    x = np.concatenate([base, near, base[20:21].repeat(40, 0), 3 * base[30:33]]).astype(np.float32)
    bad = [None, [0.0] * 16, [float("nan")] * 16, [1.0, 2.0]]
    order = rng.permutation(len(x))
    df = table(spark, [*x[order].tolist(), *bad, x[0].tolist()],
               [*range(len(x)), 9001, 9002, 9003, 9004, None])
    got = {r["vec_id"]: r for r in pruned_graph.near_duplicates(df, 0.95).collect()}
    links, label = near_by_hand(np.concatenate([x[order], x[:1]]), 0.95)
    assert len(got) == len(x) + 5
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found >= 0.99 * links[:-1].sum() - 1
    assert all(got[i]["n_links"] <= links[i] for i in range(len(x)))
    without_last, _ = near_by_hand(x[order], 0.95)
    _, parts = near_by_hand(x[order], 0.95)
    wrong = sum(got[i]["component_id"] != parts[i] for i in range(len(x)))
    assert wrong <= 0.01 * len(x)
    for i in range(len(x)):
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    for i in (9001, 9002, 9003, 9004):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)
    assert got[0]["audited_recall"] >= 0.995


def test_near_duplicates_empty(spark):
    df = table(spark, BAD)
    assert [tuple(r)[1:3] for r in pruned_graph.near_duplicates(df).orderBy("vec_id").collect()] \
        == [(0, i) for i in range(len(BAD))]
    assert pruned_graph.near_duplicates(df.limit(0)).count() == 0


def test_robust_prune_keeps_the_nearest():
    x = pruned_graph.unit_rows(random_vectors(300, 5, 8).astype(np.float64))
    lists = pruned_graph.robust_prune(x)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    assert (lists[:, 0] == s.argmax(1)).all()
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in lists)


def test_search_over_the_graph_finds_the_range():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, 24))
    x = pruned_graph.unit_rows(np.repeat(centre, 30, 0) + rng.normal(scale=0.1, size=(600, 24)))
    lists = pruned_graph.robust_prune(x)
    a = np.repeat(np.arange(600), (lists >= 0).sum(1))
    graph = pruned_graph.Graph(a, lists[lists >= 0], 600)
    links = pruned_graph.range_links(x, graph, 0.95)
    truth = (x @ x.T >= 0.95)
    np.fill_diagonal(truth, False)
    assert truth[links].all() and (links == links.T).all()
    assert links.sum() >= 0.99 * truth.sum()
    label = pruned_graph.local_components(links)
    assert all(label[i] == label[j] for i, j in zip(*np.nonzero(links)))
    shards = np.tile([1, 4, 7], (600, 1))
    shards[:300, 0] = 2
    assert (pruned_graph.count_links(links, np.ones(600, int), shards, 1, None)
            == links.sum(1)).all()
    only = pruned_graph.count_links(links, np.ones(600, int), shards, 4, None)
    assert (only == np.r_[links[:300, 300:].sum(1), links[300:, :300].sum(1)]).all()


def test_near_duplicates_match_sql(spark):
    import duckdb
    from loadcast.llm.oracle import SQL
    from loadcast.llm.queries import op10_pruned_graph
    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{base}/embeddings.parquet')")
    want = con.execute(SQL["op10_pruned_graph"]).fetchall()
    columns = [d[0] for d in con.description]
    got = op10_pruned_graph(spark, base).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_audit_counts_lost_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(9)
    pairs = rng.normal(size=(20, 64)).repeat(2, 0)
    x = np.concatenate([rng.normal(size=(1, 64)).repeat(100, 0), pairs])
    x += rng.normal(scale=0.01, size=x.shape)
    links, _ = near_by_hand(x, 0.95)
    assert sorted(set(links)) == [1, 99]
    nodes = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x.astype(float).tolist())],
                                  "rep long, copies long, v array<double>")
    found = spark.createDataFrame([(i, 99) for i in range(100)], "rep long, links long")
    assert pruned_graph.audit_recall(nodes, found, 0.95) == pytest.approx(100 / 140)
    assert pruned_graph.audit_recall(nodes.where("rep in (0, 100)"), found, 0.95) is None


def test_overlap_grows_with_the_shards():
    x = pruned_graph.unit_rows(random_vectors(3000, 4, 64).astype(np.float64))
    few, many = (pruned_graph.needed_overlap(x, x[:k], 0.95, 0.995) for k in (2, 1000))
    assert few <= 2 and many > 3
