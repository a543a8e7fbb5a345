import math
import random
import tracemalloc

import numpy as np
import pytest

from freshet.llm import ann_search, topk_search


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    centers = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    out = [(i, [c + rng.gauss(0, 0.25) for c in centers[i % 9]]) for i in range(400)]
    for i in range(0, 400, 40):
        out[i + 1] = (i + 1, list(out[i][1]))
    out += [(400, None), (401, [1.0, None] + [0.0] * 10), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (404, [0.0] * 12), (405, [0.5]), (406, []), (420, [-1.0] * 12)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, list int").repartition(3)


def usable(rows):
    return {i: np.array(list(v) + [0.0] * (12 - len(v))) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}


def test_topk(table, rows, spark):
    vectors = {i: np.floor(64 * v).astype(int) for i, v in usable(rows).items()}
    for block in (4096, 50):
        topk_search.BLOCK_ROWS = block
        got: dict = {}
        for r in topk_search.top_inner_products(table, table.where("vec_id % 20 = 0"), k=7).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for q, v in vectors.items():
            if q % 20 == 0:
                best = sorted((-int(v @ w), i) for i, w in vectors.items() if i != q)[:7]
                assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q
    topk_search.BLOCK_ROWS = 4096
    few = table.where("vec_id < 3")
    assert topk_search.top_inner_products(few, few, k=20).count() == 6
    assert topk_search.top_inner_products(table.limit(0), table.limit(0), k=5).count() == 0
    twice = few.unionByName(few)
    assert topk_search.top_inner_products(twice, twice, k=20).count() == 6


def test_ann_recall_and_scores(table, rows):
    vectors = {i: v for i, v in usable(rows).items() if v.any()}
    got: dict = {}
    for r in ann_search.nearest(table, table.where("vec_id % 10 = 0"), k=5, list_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    cos = lambda a, b: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
    for q, v in vectors.items():
        if q % 10 == 0:
            best = sorted((-round(cos(v, w), 12), i) for i, w in vectors.items() if i != q)[:5]
            assert q not in [i for i, _ in got[q]]
            assert all(abs(s - cos(v, vectors[i])) < 1e-12 for i, s in got[q])
            hits += len({i for _, i in best} & {i for i, _ in got[q]})
            total += 5
    assert hits / total >= 0.9


def test_ann_recall_with_many_lists(spark):
    """Random directions, hundreds of lists: the worst case for lists, where a fixed number of them loses recall."""
    import pandas as pd

    x = np.random.default_rng(4).normal(size=(16_000, 32))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()})).repartition(4)
    got: dict = {}
    for r in ann_search.nearest(df, df.where("vec_id % 100 = 0"), k=5, list_rows=32).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cos = unit[::100] @ unit.T
    cos[np.arange(160), np.arange(0, 16_000, 100)] = -2
    best = np.argsort(-cos, axis=1)[:, :5]
    assert sum(len(set(b) & got[100 * i]) for i, b in enumerate(best.tolist())) / best.size >= 0.93


def test_ann_edges(table, spark):
    few = table.where("vec_id < 3")
    assert ann_search.nearest(few, few, k=5).count() == 6
    assert ann_search.nearest(table.limit(0), table.limit(0), k=5).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id long, embedding array<double>")
    got = ann_search.nearest(same, same.where("vec_id = 2"), k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 3, 4, 5]


def test_centroids_are_fitted_in_little_memory():
    """The driver's blocks don't grow with the number of centroids: n * n orders of 8 bytes would be 128 MB here."""
    x = np.random.default_rng(3).normal(size=(6000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    tracemalloc.start()
    graph = ann_search.CentroidGraph.build(x, 4000)
    ann_search.bounds_for_recall(graph, x[:1000], np.repeat(np.arange(1000), 2), x[:2000], (16, 0.1, 4), 0.1, 1, 8, 0.98)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 72e6
    cos = graph.centroids @ graph.centroids.T
    np.fill_diagonal(cos, -2)
    assert (graph.links[:, 0] == cos.argmax(1)).mean() > 0.99


def test_graph_finds_the_nearest_centroid():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = ann_search.CentroidGraph.build(x, 200)
    nodes, _ = graph.search(x[:200], 16)
    assert (nodes[:, 0] == np.argmax(x[:200] @ graph.centroids.T, axis=1)).mean() > 0.95


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e-310])
def test_ann_of_very_large_and_small_components(spark, size):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(size * c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for exact in (False, True):
        got = ann_search.nearest(df, df.where("vec_id % 20 = 0"), k=5, exact=exact).collect()
        assert len(got) == 15
        assert all(abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-9 or size < 1e-300 for r in got)


def test_ann_exact(table, rows):
    vectors = {i: v for i, v in usable(rows).items() if v.any()}
    got: dict = {}
    for r in ann_search.nearest(table, table.where("vec_id % 10 = 0"), k=5, part_rows=64, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.score)
    cos = lambda a, b: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
    for q, v in vectors.items():
        if q % 10 == 0:
            best = sorted((-cos(v, w) for i, w in vectors.items() if i != q))[:5]
            assert np.allclose(got[q], [-s for s in best], atol=1e-12)


def test_topk_of_components_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [1e18, 1.0]), (1, [1e18, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="fit a long"):
        topk_search.top_inner_products(df, df, k=1)
