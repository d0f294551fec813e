"""Ball k-means against comparing every vector with every centroid."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from talus.llm import ballkmeans as B


@pytest.mark.parametrize("spread", [3, 1000, 1 << 27])
def test_balls_give_the_nearest(spread):
    """Ties (small numbers), equal centroids, and the largest components."""
    rng = np.random.default_rng(spread)
    for _ in range(30):
        v = rng.integers(-spread, spread + 1, (200, 6))
        centres = np.concatenate([c := rng.integers(-spread, spread + 1, (12, 6)), c[:2]])
        old = rng.integers(0, len(centres), len(v))
        for a, b in zip(B.reassign(v, old, centres), B.nearest(v, centres), strict=True):
            assert (a == b).all()


def test_balls_compare_less():
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (40, 8))
    v = (centres[rng.integers(0, 40, 5000)] + rng.integers(-40, 40, (5000, 8))).astype(np.int64)
    count = []
    B.reassign(v, B.nearest(v, centres)[0], centres, count)
    assert sum(count) < 0.01 * 40 * len(v)


def plain(rows, k, rounds, dims, scale, salt):
    kept = [(i, [int(np.floor(scale * float(x))) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    named = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None) + sorted(("~", v) for i, v in kept if i is None)
    centres = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            if members := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                centres[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return sorted(((-1 if i is None else i), near(v)[1], near(v)[0]) for i, v in kept), centres


def test_rounds(spark):
    """Nulls everywhere, other lengths, non-finite components, repeated rows and ids, other columns."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(150)] + [(7, [0.5] * 5), (None, [1.0, -2.0, 0.0, 3.0, 1.0]), (200, None), (201, [1.0] * 4), (202, [1.0, None, 1.0, 1.0, 1.0])]
    rows += [(203, [float("nan")] * 5), (204, [float("inf")] * 5), *[(i, rng.normal(size=5).tolist()) for i in (300, 300)], (5, [0.25] * 5), (5, [0.25] * 5)]
    df = spark.createDataFrame([(i, e, 3, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    found, centres = B.cluster(df, 9, 4, 5, 16, "s")
    want, c = plain(rows, 9, 4, 5, 16, "s")
    assert sorted((-1 if r[0] is None else r[0], r[2], r[3]) for r in found.select("vec_id", "v", "cluster", "distance").collect()) == want
    assert centres.tolist() == c


def test_few_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, 1e30])], "vec_id long, embedding array<double>")
    assert sorted(r["distance"] for r in B.cluster(df, 40, 5, 2)[0].collect()) == [0, 0]
    assert B.cluster(df.limit(0), 40, 5, 2)[0].count() == 0
