"""Whitening against exact sums in Python and numpy's eigenvectors."""

import math
import random
from fractions import Fraction

import numpy as np

from polyview.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "clash", "clash") for i, v in vectors], SCHEMA).repartition(4)


def check(spark, vectors, width, components=16):
    got = whiten(table(spark, vectors), components).collect()
    kept = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in vectors
            if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = [[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit]
    cov = np.array([[float(Fraction(sum(r[a] * r[b] for r in centred), n ** 3)) for b in range(width)] for a in range(width)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == k * len(kept)
    rows = {}
    for r in got:
        exact = int(r.exact_deviation)
        rows.setdefault((r.vec_id, exact), []).append(r)
        assert r.n == n and r.deviation == (exact if exact < 1 << 63 else None) and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-12
    signs = {}
    for i, x in kept:
        d = [n * c - s for c, s in zip(x, sums, strict=True)]
        mine = rows[i, sum(v * v for v in d)]
        want = (np.array(d, float) / n) @ axes[:, :k] / np.sqrt(values[:k])
        for r in mine:
            w = want[r.component - 1]
            if abs(w) > 1e-6:
                sign = round(r.whitened / w)
                assert abs(r.whitened - sign * w) < 1e-7 and signs.setdefault(r.component, sign) == sign


def test_against_exact_sums(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 0.1 + j) + 0.5 * (j == 3) for j in range(6)]) for i in range(200)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(300)]  # one vector holds most rows
    vectors += [(None, vectors[3][1]), (5, vectors[4][1]), (6, None), (7, []), (8, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
                (9, [float("nan")] * 6), (10, [float("inf")] * 6), (11, [1.0] * 5)]
    check(spark, vectors, 6)
    check(spark, vectors, 6, 2)


def test_less_than_full_rank(spark):
    rng = random.Random(2)
    vectors = [(i, [float(a), float(a), -float(a), 2.5]) for i, a in enumerate(rng.sample(range(1000), 50))]
    check(spark, vectors, 4)


def test_large_entries_stay_exact(spark):
    vectors = [(i, [(-1.0) ** i * 2.0 ** 33 * (i % 5), float(i)]) for i in range(40)]
    check(spark, vectors, 2)


def test_no_rows(spark):
    assert whiten(table(spark, [(1, [1.0])]).limit(0)).collect() == []
    assert whiten(table(spark, [(1, None), (2, [])])).collect() == []
    assert whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
