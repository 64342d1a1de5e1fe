"""Hard negatives against a brute-force loop, and the bit-planes' intervals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrill.llm import grid, hard_negatives

def moved():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def brute(rows, positives=5, negatives=3):
    ready = []
    for i, v, label in rows:
        if i is None or label is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        ready.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, q, own) in enumerate(ready):
        if i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v, strict=True)), j, label) for b, (j, v, label) in enumerate(ready) if b != a and len(v) == len(q)]
        for p, j, _ in sorted(s for s in scored if s[2] == own)[:positives]:
            fit = sorted(s for s in scored if s[2] != own and 50 * -p <= 100 * -s[0] <= 95 * -p)[:negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, LABEL string").repartition(5)
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 50 == 0, moved(), **options).collect()))


def clustered(n, d, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((3, d))
    x = centres[rng.integers(0, 3, n)] + rng.standard_normal((n, d))
    return [(i, [float(c) for c in v], int(label)) for i, (v, label) in enumerate(zip(x / np.linalg.norm(x, axis=1)[:, None], rng.integers(0, labels, n), strict=True))]


@pytest.mark.parametrize("d", [1, 3, 24])
def test_equals_brute_force(spark, d):
    rows = clustered(400, d, d)
    got = mined(spark, rows)
    assert got == brute(rows) and (got or d == 1)


def test_nulls_ties_copies_and_other_lengths(spark):
    rows = clustered(160, 6, 9)
    rows += [(50, rows[50][1], rows[50][2])] * 3 + [(3, rows[3][1], rows[3][2])] * 4 + [(700 + i, rows[5][1], i % 4) for i in range(12)]  # repeated anchors and rows, ties
    rows += [(None, [1.0] * 6, 1), (200, None, 1), (250, [1.0] * 6, None), (300, [], 1), (350, [None] + [1.0] * 5, 1), (400, [float("nan")] * 6, 1), (450, [float("inf")] * 6, 2)]
    rows += [(500, [0.5, 0.5], 1), (501, [0.5, 0.25], 1), (502, [0.25, 0.25], 2), (550, [0.0] * 6, 3), (600, [-0.5] * 6, 2)]
    assert mined(spark, rows) == brute(rows)


def test_one_label_empty_and_tiny_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []
    same = [(i, [1.0, float(i)], 1) for i in range(1, 60) if i % 7]
    assert mined(spark, same) == []


def test_products_beyond_doubles(spark):
    rows = [(i, [float(1 << 18) * (1 + i % 13) + i, -float(1 << 16) * (i % 5)], i % 3) for i in range(120)]
    assert mined(spark, rows) == brute(rows)


def test_cells_of_any_size_agree(spark, monkeypatch):
    rows = clustered(500, 8, 4)
    want = brute(rows)
    monkeypatch.setattr(grid, "ANCHORS", 24)
    monkeypatch.setattr(grid, "CANDIDATES", 800)
    assert mined(spark, rows) == want


@pytest.mark.parametrize("magnitude", [1, 100, 5000])
def test_intervals_hold_the_score_and_most_pairs_go_before_the_last_plane(magnitude):
    rng = np.random.default_rng(magnitude)
    q, x = (np.floor(magnitude * rng.standard_normal((n, 64))) for n in (40, 4000))
    exact = q @ x.T
    top = np.sort(exact, axis=1)[:, -5:-4]
    state = hard_negatives.Windows(np.arange(40), q, top, np.full((40, 1), np.inf), 5, False)
    i, j, s = state.survivors(np.arange(40), x)
    assert sorted(zip(i, j, s, strict=True)) == sorted((a, b, exact[a, b]) for a, b in zip(*np.nonzero(exact >= top), strict=True))
    if magnitude > 1:
        assert state.terms < 0.75 * state.pairs * hard_negatives.planes(x.astype(np.int64))
    whole = x.astype(np.int64)
    for b in range(hard_negatives.planes(whole)):
        known = q @ ((whole >> b) << b).T.astype(float)
        rest = (1 << b) - 1
        assert (known + rest * np.minimum(q, 0).sum(1)[:, None] <= exact).all() and (known + rest * np.maximum(q, 0).sum(1)[:, None] >= exact).all()
