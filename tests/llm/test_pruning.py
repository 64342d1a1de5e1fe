"""Bounds drop candidates and lose none; a query leaves out its own row only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrill.llm import topk


def searched(x, queries, k=6):
    floor = np.sort(queries @ x[:300].T, axis=1)[:, -k] * 1.0
    s = topk.Searcher(queries, floor, k)
    for i in range(0, len(x), 500):
        s.add(np.arange(i, min(i + 500, len(x))), x[i : i + 500])
    want = np.sort(queries @ x.T, axis=1)[:, -k:]
    assert np.array_equal(want, np.array([[-b[0] for b in r][::-1] for r in s.best]))
    return s.products / s.pairs


def test_few_products_on_clustered_vectors_and_some_saved_on_random_ones():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 64)).cumsum(1)
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    clustered = np.floor(256 * (centres[rng.integers(0, 40, 3000)] + 0.03 * rng.standard_normal((3000, 64))))
    assert searched(clustered, clustered[::50]) < 0.05
    random = rng.standard_normal((3000, 64))
    random = np.floor(256 * random / np.linalg.norm(random, axis=1)[:, None])
    assert searched(random, random[::50]) < 0.6


@pytest.mark.parametrize("d", [1, 2, 3, 17, 40])
def test_bounds_hold_at_every_level(d):
    rng = np.random.default_rng(d)
    q, x = (np.floor(256 * rng.standard_normal((n, d))) for n in (20, 200))
    for s in topk.LEVELS:
        if s < d:
            assert (topk._statistics(q, s) @ topk._statistics(x, s).T + 1e-6 >= q @ x.T - 1e-9 * np.abs(q @ x.T)).all()


def test_repeated_queries_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    x = [[float(v) for v in r] for r in rng.standard_normal((60, 8))]
    rows = [(i, v, "s") for i, v in enumerate(x)] + [(50, x[50], "s"), (50, x[3], "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, SCORE string").repartition(4)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=3).collect()
    ints = [(i, np.floor(256 * np.array(v))) for i, v, _ in rows]
    want = []
    for a, (i, q) in enumerate(ints):
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for b, (j, v) in enumerate(ints) if b != a)[:3]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_levels_that_do_not_pay_are_left_out(monkeypatch):
    monkeypatch.setattr(topk, "PROBED", 1000)
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.standard_normal((6000, 64)))
    s = topk.Searcher(x[:20], np.full(20, -np.inf), 6)
    for i in range(0, len(x), 500):
        s.add(np.arange(i, i + 500), x[i : i + 500])
    assert not s._pays(1) and s.seen[1][0] < s.pairs / 2  # bounds of one segment drop next to nothing here
    assert [[b[1] for b in best] for best in s.best] == [np.lexsort((np.arange(len(x)), -(q @ x.T)))[:6].tolist() for q in x[:20]]
