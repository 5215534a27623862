"""The Voronoi join on repeated ids, odd shapes and clustered vectors."""

from __future__ import annotations

import numpy as np

from quire.llm import voronoi as V


def vectors(spark, rows):
    return V.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))


def brute(rows, queries, k):
    width = max(len(v) for _, v in rows)
    x = {n: np.array([*np.floor(np.array(v) * 1024).astype(int), *[0] * (width - len(v))]) for n, (_, v) in enumerate(rows)}
    out = []
    for q in queries:
        mine = min((x[n].tolist() for n, (i, _) in enumerate(rows) if i == q))
        order = sorted((-int(x[n] @ np.array(mine)), i) for n, (i, _) in enumerate(rows) if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(order)]
    return sorted(out)


def test_repeated_ids_shorter_and_zero_vectors(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=4).round(2).tolist()) for i in range(40)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (7, [0.0] * 4), (50, [0.0] * 4), (60, [1.0, 2.0]), (61, [0.5]), (20, [-9.0, 0.0, 0.0, 1.0])]
    table = vectors(spark, rows)
    for pivots, block, asked in ((4, 10, 2), (48, 20_000, 4096)):
        got = V.top_k(table, table.where("vec_id % 10 = 0"), 6, pivots, block, asked).collect()
        assert sorted(map(tuple, got)) == brute(rows, [0, 10, 20, 30, 50, 60], 6)


def test_large_integers_are_multiplied_exactly(spark):
    rows = [(i, [float(2**20 + i), 1.0 + i]) for i in range(12)]
    small = vectors(spark, rows)
    got = V.top_k(small, small.where("vec_id = 3"), 4).collect()
    assert sorted(map(tuple, got)) == brute(rows, [3], 4)


def test_clustered_vectors_are_sent_to_few_groups(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + r.normal(size=16) * 0.05).round(4).tolist()) for i in range(1200)]
    table = vectors(spark, rows)
    queries = table.where("vec_id % 10 = 0")
    plan = V.Plan(table, queries, 5, 24, 20_000, 5)
    copies = plan.sent.count() / table.count()
    assert copies < 6  # of 24 groups
    got = V.top_k(table, queries, 5, 24, 20_000, 5).collect()
    assert sorted(map(tuple, got)) == brute(rows, range(0, 1200, 10), 5)


def test_one_group_of_queries_copies_nothing(spark):
    r = np.random.default_rng(8)
    table = vectors(spark, [(i, r.normal(size=16).tolist()) for i in range(500)])
    plan = V.Plan(table, table.where("vec_id % 100 = 0"), 5, 48, 20_000, 4096)
    assert plan.sent.count() <= 500
