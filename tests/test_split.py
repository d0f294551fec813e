"""Grouped quantiles, floods over edge tables and the splitting of components, against plain versions."""

import heapq

import numpy as np
import pandas as pd
import pytest

from talus.operators import graph, split, summary, surface
from tests import plain_split


def test_quantiles_of_groups(spark):
    r = np.random.default_rng(0)
    v = np.concatenate([r.normal(0, 1, 3000), np.full(4000, 0.25), r.normal(5, 2, 500), [np.nan, np.inf, 7.0, np.nan]])
    g = np.concatenate([np.zeros(7000, int), np.ones(500, int), [1, 1, 2, 3]])
    rows = spark.createDataFrame(pd.DataFrame({"g": g, "v": v})).selectExpr("IF(g = 2, NULL, g) AS g", "v")
    got = {x["g"]: x["q"] for x in summary.quantiles(rows, "v", [0.0, 0.1, 0.5, 0.9997], "g").collect()}
    assert set(got) == {0, 1, None} and got[None] == [7.0] * 4  # group 3 has no value
    for k in (0, 1):
        own = v[(g == k) & ~np.isnan(v)]
        assert got[k][:3] == pytest.approx(np.quantile(own, [0.0, 0.1, 0.5]).tolist(), rel=1e-12)
    assert got[0][3] == pytest.approx(np.quantile(v[:7000], 0.9997)) and got[1][3] == np.inf
    assert summary.quantiles(rows, "v", [0.5]).first()["q"] == pytest.approx([np.quantile(v[~np.isnan(v)], 0.5)])
    assert summary.quantiles(rows.where("false"), "v", [0.5], "g").count() == 0


def barriers(n: int, edges, source: dict) -> dict:
    """{id: {source: least largest weight}} by a search from every source."""
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    out = {i: {} for i in range(n)}
    for s in set(source.values()):
        heap, seen = [(-1.0, i) for i, t in source.items() if t == s], set()
        while heap:
            w, i = heapq.heappop(heap)
            if i in seen:
                continue
            seen.add(i)
            out[i][s] = w
            for j, x in near.get(i, []):
                if j not in seen and (j not in source or source[j] == s):
                    heapq.heappush(heap, (max(w, x), j))
    return out


@pytest.mark.parametrize(("seed", "at_once"), [(0, 0), (1, 60), (2, 1000)])
def test_floods_take_the_lowest_pass(spark, seed, at_once):
    """In rounds over the table, in rounds and then in one task, and in one task only."""
    r = np.random.default_rng(seed)
    n = 120
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(r.integers(0, n, 170), r.integers(0, n, 170), r.integers(0, 6, 170), strict=True)] + [(200, 201, 1)]
    source = {int(i): int(s) for i, s in zip(r.choice(n, 8, replace=False), [0, 0, 1, 2, 2, 5, 6, 7], strict=True)}
    e = spark.createDataFrame(edges, "a long, b long, w int")
    got = graph.flooded(e, spark.createDataFrame(list(source.items()), "id long, source long"), at_once).toPandas()
    assert got["id"].is_unique
    got = dict(zip(got["id"], got["source"], strict=True))
    ways = barriers(202, edges, source)
    assert set(got) == {i for i, w in ways.items() if w}
    assert sorted(map(tuple, graph.flooded(e, spark.createDataFrame(list(source.items()), "id long, source long"), 1000 - at_once).collect())) == sorted(got.items())
    for i, s in got.items():
        assert source[i] == s if i in source else ways[i][s] == min(ways[i].values())


def test_no_edges_and_no_sources(spark):
    none, one = spark.createDataFrame([], "a long, b long, w int"), spark.createDataFrame([(3, 4)], "id long, source long")
    assert [tuple(x) for x in graph.flooded(none, one).collect()] == [(3, 4)]
    ring = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 0, 1)], "a long, b long, w int")
    assert graph.flooded(ring, one.where("false")).count() == 0


def test_smoothing_equals_the_grid_version(spark):
    r = np.random.default_rng(1)
    n, height = r.integers(0, 4, (7, 5)), r.random((7, 5))
    plain = plain_split._smooth(height * n, 1.25) / plain_split._smooth(n.astype(float), 1.25)
    full = [(9, int(x), int(y), 5, 7, int(n[y, x]), float(height[y, x])) for y in range(7) for x in range(5) if n[y, x]]
    got = split.smoothed(spark.createDataFrame(full, "root long, gx long, gy long, nx long, ny long, n long, height double"), 1.25).collect()
    assert len(got) == len(full)
    for x in got:
        assert x["smooth"] == pytest.approx(plain[x["gy"], x["gx"]], rel=1e-12)


def test_gaps_are_crossed_by_the_shortest(spark):
    """Two tops on a strip of cells; an island two cells off the first, another past it, and one out of reach."""
    cells = [(i, 1, i, 0, 0.5 - 0.01 * i) for i in range(6)] + [(10, 1, 0, 2, 0.9), (11, 1, 0, 4, 0.1), (12, 1, 30, 30, 0.5)]
    c = spark.createDataFrame(cells, "id long, root long, gx long, gy long, smooth double")
    tops = spark.createDataFrame([(0, 0), (5, 5)], "id long, source long")
    got = {x["id"]: x["source"] for x in split.regions(c, tops, 2).collect()}
    assert got[10] == got[11] == 0 and got[0] == 0 and got[5] == 5 and 12 not in got and set(got) == {*range(6), 10, 11}


def hills(r, tops, n=500):
    xy = np.concatenate([r.normal(0, 2.2, (n, 2)) + t for t in tops])
    far = np.min([((xy - t) ** 2).sum(axis=1) for t in tops], axis=0)
    return xy, np.exp(-far / 12)


def test_split_equals_the_plain_version(spark):
    r = np.random.default_rng(0)
    kinds = [[[0, 0], [11, 0]], [[0, 0], [10, 1], [4, 10]], [[0, 0]], [[0, 0], [9, 0]]]
    frames, plain = [], []
    for root, tops in enumerate(kinds):
        xy, top = hills(r, np.array(tops, float), 500 if root < 3 else 20)
        frames.append(pd.DataFrame({"root": root, "x": xy[:, 0], "y": xy[:, 1], "score": top, "local_relief": 0.5 * top, "top_hat": top - 0.1}))
        plain.append(plain_split.split_parts(xy, top, 0.5 * top, top - 0.1, top >= 0.56, 1.0, 2.5, 5, 50))
    rows = pd.concat(frames, ignore_index=True)
    rows["pid"], rows["plain"] = np.arange(len(rows)), np.concatenate(plain)
    got = split.split(spark.createDataFrame(rows.drop(columns="plain")), 1.0, 2.5, 5, 50).toPandas()
    both = rows.merge(got, on=["pid", "root"])
    assert len(both) == len(got) == len(rows) and got["pid"].is_unique
    for root, own in both.groupby("root"):
        assert set(own["plain"]) == set(own["part"]), root
        assert (own["plain"] == own["part"]).mean() > 0.97, root  # cells of equal cost may go either way
    assert (both[both["root"] == 3]["part"] == 0).all() and both[both["root"] == 0]["part"].nunique() >= 2
    assert split.split(spark.createDataFrame(rows.drop(columns="plain")).where("false"), 1.0, 2.5, 5, 50).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 5, 11])
def test_opening_equals_sliding_windows(spark, radius):
    g = np.random.default_rng(radius).random((9, 14))

    def slide(t, f):
        for axis in (0, 1):
            t = np.stack([f(np.take(t, range(max(0, i - radius), min(t.shape[axis], i + radius + 1)), axis=axis), axis=axis) for i in range(t.shape[axis])], axis=axis)
        return t

    want = slide(slide(g, np.min), np.max)
    cells = spark.createDataFrame([(x, y, float(g[x, y])) for x in range(9) for y in range(14)], "gx long, gy long, value double")
    got = surface.opened(cells, radius).collect()
    assert len(got) == g.size and all(c["value"] == want[c["gx"], c["gy"]] for c in got)


def test_tables_of_the_splitting_are_not_gathered(spark):
    """However small their files are: the driver would hold the rows of a table that it broadcasts."""
    from talus.operators import split

    t = split.cut(spark.range(1000).selectExpr("id", "id DIV 10 AS root"))
    plan = spark.range(1000).join(t.where("root > 3").select("id", "root"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
