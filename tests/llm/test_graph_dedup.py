"""Recall and precision of the graph search against brute force, pruning, and edge cases."""

import numpy as np

from sparkfeat.llm import graph_dedup as gd
from sparkfeat.llm.ngram_join import joined


def vectors(seed=0, n=500, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    for k in range(0, n, 5):
        x[k + 1] = x[k] + 0.1 * rng.standard_normal(dim)
        if k % 25 == 0:
            x[k + 2] = x[k]
            x[k + 3] = x[k] * 2
    return x


def brute(x):
    """(class, links) of each vector, copies included."""
    u = gd.unit(x.astype(np.float64))
    near = (u @ u.T >= 0.9) | (x[:, None] == x[None]).all(axis=2)
    np.fill_diagonal(near, False)
    root = joined(len(x), *np.nonzero(near))
    return [(int(root[k]), int(near[k].sum())) for k in range(len(x))]


def found(spark, x, **how):
    df = spark.createDataFrame([(k, v.tolist(), 1.5) for k, v in enumerate(x)], "vec_id long, embedding array<float>, cosine double")
    got = {r.vec_id: (r.class_id, r.links) for r in gd.near_duplicates(df, **how).collect()}
    assert set(got) == set(range(len(x)))
    return [got[k] for k in range(len(x))]


def test_classes_against_brute_force(spark):
    x = vectors()
    want = brute(x)
    got = found(spark, x, shard=100, queries=8)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want) and sum(g == w for g, w in zip(got, want)) >= 0.95 * len(x)
    assert found(spark, x, queries=None) == want


def test_a_dense_group_over_several_shards(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[:200] = x[0] + 0.28 * rng.standard_normal((200, 16))
    want = brute(x)
    assert max(n for _, n in want) > 100
    got = found(spark, x, shard=40, overlap=2, queries=16)
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)


def test_one_node(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0]), (5, [1.0, 2.0]), (7, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, gd.near_duplicates(df).collect())) == [(3, 3, 1), (5, 3, 1), (7, 7, 0)]


def test_robust_prune_definition():
    x = gd.unit(np.random.default_rng(1).standard_normal((60, 8)))
    sim = x[1:] @ x[0]
    near = np.argsort(-sim) + 1
    kept = near[gd.robust_prune(near[None], (x[near] @ x[0])[None], x, 10, 1.2)[0]].tolist()
    d = lambda a, b: np.linalg.norm(x[a] - x[b])
    want: list[int] = []
    for c in near.tolist():
        if len(want) < 10 and all(1.2 * d(k, c) > d(0, c) for k in want):
            want.append(c)
    assert kept == want


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (None, [1.0, 0.0]), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (8, [0.0, 1.0]), (9, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, gd.near_duplicates(df).collect()))
    assert got == [(1, 1, 2), (2, 1, 2), (3, 1, 2), *((k, k, 0) for k in range(4, 10))]
    assert gd.near_duplicates(df.limit(0)).count() == 0


def planted(n, pairs, dim=64, seed=3):
    """Isotropic vectors of which ``pairs`` have one partner each, at a cosine of about 0.92."""
    rng = np.random.default_rng(seed)
    x = gd.unit(rng.standard_normal((n, dim))).astype(np.float32)
    for k in range(pairs):
        x[2 * k + 1] = x[2 * k] + 0.42 * gd.unit(rng.standard_normal((1, dim)))[0]
    return x


def test_recall_is_met_with_many_shards_and_isolated_pairs(spark):
    for n, pairs in ((2000, 12), (2000, 600)):
        x = planted(n, pairs)
        want = brute(x)
        got = found(spark, x, shard=10, overlap=1)
        assert all(g[1] <= w[1] for g, w in zip(got, want)) and sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)
        assert sum(w[1] for w in want) >= 1.8 * pairs
