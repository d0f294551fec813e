import math
import uuid

import numpy as np
import pandas as pd
import pytest

from talus import catalog
from talus import model as M
from talus.functions import geometry as G
from talus.operators import blocks, fit, graph, labels, roughness, spatial, summary
from talus.operators import surface as S
from talus.plans import engine
from talus.sources import files
from talus.streaming import rollup


def frame(spark, p, **more):
    return spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], **more}))


def brute(p, k):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return [sorted((d[i, j], j) for j in range(len(p)) if j != i)[:k] for i in range(len(p))]


@pytest.mark.parametrize("kind", ["uniform", "clusters", "duplicates", "flat", "outlier"])
def test_knn_equals_brute_force(spark, kind, monkeypatch):
    for name, value in (("TILE", 60), ("MOST", 120), ("PART", 90), ("SCAN", 8)):
        monkeypatch.setattr(spatial, name, value)
    r = np.random.default_rng(1)
    p = r.random((400, 3))
    if kind == "clusters":
        p = np.concatenate([r.normal(0, 0.01, (300, 3)), r.random((100, 3)) * 10])
    if kind == "duplicates":
        p = np.repeat(p[:80], 4, axis=0)
    if kind == "flat":
        p[:, 2] = 0
    if kind == "outlier":
        p[:380] = p[:380] * 1e-3
        p[0] = 50
    got = {}
    for row in spatial.knn(frame(spark, p), 5).collect():
        got.setdefault(row["pid"], []).append((row["dist"], row["nid"]))
    want = brute(p, 5)
    assert all([j for _, j in sorted(got[i])] == [j for _, j in want[i]] for i in range(len(p)))


def test_no_task_gets_a_dense_ball(spark, monkeypatch, tmp_path):
    """One far outlier and one dense ball: what a task compares with stays bounded, and so does the number of distances."""
    for name, value in (("TILE", 100), ("MOST", 300), ("PART", 800), ("SCAN", 50)):
        monkeypatch.setattr(spatial, name, value)
    plain = spatial.k_nearest

    def counted(q, ids, pts, all_ids, k, skip_self):
        with open(f"{tmp_path}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{len(q)} {len(pts)}")
        return plain(q, ids, pts, all_ids, k, skip_self)

    monkeypatch.setattr(spatial, "k_nearest", counted)
    r = np.random.default_rng(5)
    p = np.concatenate([r.normal(0, 1e-3, (4000, 3)), r.random((100, 3)), [[900.0, 900, 900]]])
    out = spatial.knn(frame(spark, p).repartition(8), 5).toPandas()
    sizes = [tuple(map(int, f.read_text().split())) for f in tmp_path.iterdir()]
    assert len(out) == 5 * len(p) and sizes and max(n for _, n in sizes) <= 1.3 * 800 and sum(a * b for a, b in sizes) <= len(p) ** 2 / 2
    want = brute(p, 5)
    got = out.sort_values(["pid", "rank"]).groupby("pid")["nid"].apply(list)
    assert all(got[i] == [j for _, j in want[i]] for i in range(len(p)))


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_few_points(spark, n):
    p = np.random.default_rng(n).random((n, 3))
    assert spatial.knn(frame(spark, p), 5).count() == n * min(5, n - 1)


def test_empty_cloud(spark):
    assert spatial.knn(spark.createDataFrame([], "pid long, x double, y double, z double"), 5).count() == 0


def test_forest_with_flat_cycle(spark):
    t = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, 5)], "pid long, parent long")
    assert {r["pid"]: r["root"] for r in graph.forest_roots(t).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: None, 6: None, 7: None}


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_components_and_forests_in_chunks(spark, monkeypatch, chunk):
    """Random graphs and forests with circles against plain walks, contracted whole and in chunks of a few rows."""
    monkeypatch.setattr(graph, "CHUNK", chunk)
    r = np.random.default_rng(chunk)
    e = r.integers(0, 120, (90, 2))
    root = list(range(120))
    for _ in range(120):
        for a, b in e.tolist():
            root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame(e.tolist(), "a long, b long").repartition(3)
    got = {x["id"]: x["root"] for x in graph.components(spark.range(120), edges).collect()}
    assert got == dict(enumerate(root))
    parent = [int(r.integers(0, 200)) if r.random() < 0.95 else i for i in range(200)]
    want = {}
    for i in range(200):
        j = i
        for _ in range(200):
            j = parent[j]
        want[i] = j if parent[j] == j else None
    rows = spark.createDataFrame(list(enumerate(parent)), "pid long, parent long").repartition(4)
    assert {x["pid"]: x["root"] for x in graph.forest_roots(rows).collect()} == want and None in want.values()
    pid, far = np.arange(200), np.array(parent)
    ends, sink, round_ = graph.followed(pid, far)
    assert {i: None if c else int(x) for i, x, s, c in zip(pid.tolist(), ends, sink, round_, strict=True) if s or c} == want


def test_components_of_a_long_chain(spark):
    n = 60
    nodes = spark.range(n + 2)
    e = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(n, n + 1)], "a long, b long")
    got = {r["id"]: r["root"] for r in graph.components(nodes, e).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[n] == got[n + 1] == n


def test_detrend_removes_a_quadratic(spark):
    r = np.random.default_rng(0)
    p = r.random((500, 3)) * [50, 20, 1] + [1000, 500, 0]
    p[:, 2] = 3 + 0.2 * p[:, 0] - 0.1 * p[:, 1] + 0.01 * p[:, 0] ** 2 + 0.02 * p[:, 0] * p[:, 1] - 0.03 * p[:, 1] ** 2
    out, c = S.detrend(frame(spark, p))
    assert abs(out.toPandas()["z"]).max() < 1e-5
    assert c[3] == pytest.approx(0.01, abs=1e-6) and c[4] == pytest.approx(0.02, abs=1e-6)


def test_rotation_levels_a_tilted_plane(spark):
    p = np.random.default_rng(0).random((200, 3))
    p[:, 2] = 0.7 * p[:, 0] - 0.2 * p[:, 1]
    assert S.rotate_horizontal(frame(spark, p)).toPandas()["z"].std() < 1e-9


def test_normals_point_up(spark):
    p = np.random.default_rng(0).random((200, 3))
    p[:, 2] = 0.5 * p[:, 0]
    f = frame(spark, p)
    n = S.normals(spatial.knn(f, 12), f).toPandas()
    want = np.array([-0.5, 0, 1]) / math.sqrt(1.25)
    assert np.abs(n[["nx", "ny", "nz"]].to_numpy() - want).max() < 1e-6


@pytest.mark.parametrize("strategy", ["bounded_pca", "hybrid_direct"])
def test_ellipsoid_is_recovered(spark, strategy):
    """Out of one part and out of many: the same model."""
    r = np.random.default_rng(3)
    u = r.normal(size=(1500, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    q = S.rotation_of([1, 2, 3], 0.7)
    f = frame(spark, u * [3, 2, 1.6] @ q.T + [5, 6, 7], label=1, surface=10.0 / 1500)
    whole, parts = (fit.fit(f, strategy=strategy, part=n).first() for n in (10_000, 100))
    assert whole["r"] == pytest.approx([3, 2, 1.6], rel=0.03) and whole["c"] == pytest.approx([5, 6, 7], abs=0.05) and whole["acover"] > 80
    for k in ("r", "c", "d_mean", "r2", "v", "a", "acover", "aratio", "extents", "n"):
        assert parts[k] == pytest.approx(whole[k], rel=1e-6), k


@pytest.mark.parametrize("shape", ["blob", "grid", "flat", "line", "same", "two", "one"])
def test_a_block_is_the_sum_of_its_parts(spark, shape):
    """Boxes, hulls and sums out of parts equal those of one array, for solid, flat and tiny segments."""
    r = np.random.default_rng(5)
    p = {"blob": r.normal(size=(3000, 3)) * [3, 2, 1], "grid": np.stack(np.meshgrid(*[np.arange(7.0)] * 3), -1).reshape(-1, 3) * [3, 2, 1], "flat": np.column_stack([r.random((300, 2)) * [2, 1], np.full(300, 0.5)]), "line": np.outer(r.random(200), [1, 2, 3]), "same": np.ones((50, 3)), "two": np.array([[1.0, 2, 3], [2, 5, 1]]), "one": np.array([[1.0, 2, 3]])}[shape] + 10
    f = frame(spark, p, label=7, surface=1.0)
    got = fit.fit(f, sizing="block", part=60).first()
    want = fit.block(p, float(len(p)), None)
    assert got["n"] == len(p) and got["extents"] == pytest.approx(fit.cuboid(p)[1], abs=1e-9) and got["c"] == pytest.approx(want["c"], abs=1e-8)
    assert (got["v"], got["a"], got["acover"]) == pytest.approx((want["v"], want["a"], want["acover"]), rel=1e-8, abs=1e-9)
    if shape == "blob":
        assert len(fit.summaries(fit.dealt(f, 60)).where("size(corners) > 0").collect()) == 50
        mid, size = (p.min(axis=0) + p.max(axis=0)) / 2, np.ptp(p, axis=0).max()
        sums = [x["total"] for x in fit.moments(f, 60).orderBy("i").collect()]
        assert sums == pytest.approx(fit.monomial_sums((p - mid) / size), rel=1e-9, abs=1e-9)


def test_cuboid_and_hull():
    r = np.random.default_rng(0)
    p = np.concatenate([r.random((300, 3)), [[i, j, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)]]) * [4, 2, 1]
    v, a = fit.hull(p)
    assert v == pytest.approx(8, rel=1e-9) and a == pytest.approx(28, rel=1e-9)
    assert fit.hull(np.zeros((5, 3))) is None
    assert fit.cuboid(p)[1] == pytest.approx([4, 2, 1], rel=0.2)


def test_fit_does_not_depend_on_partitions(spark):
    p = np.random.default_rng(2).random((300, 3))
    f = frame(spark, p, label=np.arange(300) % 4, surface=np.ones(300))
    a, b = (fit.fit(f.repartition(n)).orderBy("label").toPandas() for n in (1, 7))
    assert (a["major_diameter"] == b["major_diameter"]).all() and (a["acover"] == b["acover"]).all()


def test_minima_filter_drops_equal_roughness(spark):
    f = frame(spark, np.random.default_rng(0).random((50, 3)))
    assert S.minima(f, f.selectExpr("pid", "1e0 AS rough")).count() == 0
    with pytest.raises(ValueError):
        roughness.roughness(f, M.Parameters(), "other")


@pytest.mark.parametrize("mode", ["matlab", "fast"])
def test_roughness_counts_every_draw(spark, mode):
    """Against a plain version on the same draws: as many centres a scale as the rule says, each as often as it was drawn."""
    from talus.operators import summary as U

    r, n = np.random.default_rng(3), 24
    p = np.repeat([[0, 0, 0], [2, 0, 0.1], [0, 2, 0.1], [2, 2, 0]], 6, axis=0) + r.random((n, 3)) * [0.07, 0.07, 0.03]
    f, par = frame(spark, p), M.Parameters(minscale=0.1, maxscale=1.0, nscale=3)
    area = float(np.prod(np.ptp(p[:, :2], axis=0)))
    many = round(area) if mode == "matlab" else 3
    radii = np.geomspace(0.1, 1.0, many)
    draws = [max(1, round(many / x**2)) if mode == "matlab" else min(n, int(np.clip(area / x**2, 32, 512))) for x in radii]
    assert draws[0] / n > 3 or mode == "fast"
    points, total = U.placed(f, 0)
    at = {g["place"]: g["pid"] for g in points.collect()}
    assert total == n and sorted(at) == list(range(n))
    drawn = roughness.scale_table(spark, radii.tolist(), draws).selectExpr("scale", f"pmod(xxhash64(i, scale, 0), {n}L) AS place").collect()
    assert [sum(g["scale"] == i for g in drawn) for i in range(many)] == draws
    sums, weights = np.zeros(n), np.zeros(n)
    for i, radius in enumerate(radii.tolist()):
        for c in range(n):
            w = sum(g["scale"] == i and at[g["place"]] == c for g in drawn)
            near = np.flatnonzero(((p - p[c]) ** 2).sum(axis=1) <= radius**2)
            if w and len(near) >= (3 if mode == "matlab" else 6):
                q = p[near] - p[near].mean(axis=0)
                normal = np.linalg.svd(q)[2][2]
                off = -(q @ (normal if normal[2] > 0 else -normal))
                sums[near] += w * (off if mode == "matlab" else np.abs(off)) / radius
                weights[near] += w
    want = np.divide(sums, weights, out=np.zeros(n), where=weights > 0)
    got = roughness.roughness(f, par, mode).orderBy("pid").toPandas()["rough"]
    assert np.allclose(got, want, atol=1e-9)


def test_label_queries_join_whole_clouds(spark):
    duckdb, d = pytest.importorskip("duckdb"), "/root/testdata/sf0.001"
    q, o = catalog.queries(), catalog.oracle_sql()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    for name in ("processed_label_transfer", "grow_cell_labels"):
        got, want = q[name](spark, d), con.execute(o[name])
        assert got.columns == [c[0] for c in want.description]
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_ramp_rounds_as_its_sql(spark, tmp_path):
    """Values halfway between two of the 256 steps, where the order of multiplying and dividing decides."""
    duckdb = pytest.importorskip("duckdb")
    at = [0.0, 500.1, *(c / 100 for c in range(50_011) if 510 * c % 50_010 == 0)]
    rows = [(i, pd.Timestamp("2024-01-01"), i, v) for i, v in enumerate(at)]
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "value"]).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = catalog.queries()["colour_ramp"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.oracle_sql()["colour_ramp"]).fetchall()) and len(got) > 30


def test_smrf_flags_bumps_only(spark):
    r = np.random.default_rng(0)
    p = np.concatenate([r.random((3000, 3)) * [30, 30, 0], r.random((60, 3)) * [1, 1, 0.2] + [12, 12, 2.0]])
    p[:, 2] += 0.05 * p[:, 0]
    out = S.nonground(frame(spark, p), 1.0, window=6.0).orderBy("pid").toPandas()["nonground"].to_numpy()
    assert out[3000:].mean() > 0.9 and out[:3000].mean() < 0.05


def bumps(seed=0):
    r = np.random.default_rng(seed)
    xy = r.random((2500, 2)) * [6, 3]
    z = np.zeros(len(xy))
    for cx, cy in ((1.5, 1.5), (4.5, 1.5)):
        d = (xy[:, 0] - cx) ** 2 + (xy[:, 1] - cy) ** 2
        z = np.where(d < 1, np.sqrt(np.maximum(1 - d, 0)), z)
    return np.column_stack([xy, z])


def test_run_finds_two_bumps(spark):
    par = M.Parameters(rotdetrend=False, denoise=False, nmin=50)
    out = engine.run(frame(spark, bumps()), par, strategy="bounded_pca", cap_fraction=0.0)
    assert out.counts["points"] == 2500 and out.counts["accepted"] >= 2
    g = out.granulo.toPandas().sort_values("Dmax", ascending=False).head(2)
    assert g["Dmax"].between(1.0, 4.0).all()
    shown = engine.coloured(frame(spark, bumps()), out)
    assert set(shown) == {"volume", "elongation", "azimuth"} and shown["elongation"].count() == 2500
    with pytest.raises(ValueError):
        engine.run(frame(spark, bumps()), par, mode="other") if par.denoise else engine.run(frame(spark, bumps()), M.Parameters(), mode="other")


def test_polygons_last_wins_and_states():
    s = labels.normalise_zones([{"mode": "block", "vertices_xy": [[0, 0], [1, 0], [1, 1]]}, {"mode": "non-block", "vertices_xy": [[0, 0], [1, 1]]}])
    assert s["mode_order"] == ["block"] and s["zones"]["non-block"] is None
    s = labels.replace_zone(s, "non-block", [[0, 0], [2, 0], [2, 2]])
    assert labels.replace_zone(s, "block", [[0, 0], [3, 0], [3, 3]])["mode_order"] == ["non-block", "block"]
    i = labels.add_instance([{"id": 4, "vertices_xy": [[0, 0], [1, 0], [1, 1]]}], [[0, 0], [2, 0], [2, 2]])
    assert [p["id"] for p in i] == [4, 5] and labels.undo_instance(i) == i[:1]


def test_polygons_of_any_numbers_and_number(spark):
    """Against the even-odd rule by hand: many sizes, corners that Python prints with an exponent, points on edges and corners, no points, no area."""
    r = np.random.default_rng(0)
    turn = np.linspace(0, 2 * np.pi, 24, endpoint=False)
    ring = lambda cx, cy, s: [(float(cx + a * np.cos(b)), float(cy + a * np.sin(b))) for a, b in zip(s, turn, strict=True)]
    zones = [(i + 1, ring(*r.uniform(-100, 100, 2), 10 ** r.uniform(-1, 2) * r.uniform(0.3, 1, 24))) for i in range(60)]
    zones += [(91, ring(0, 0, np.ones(24))), (92, [(0, 0), (1e-5, 0), (1e-5, 1e-5), (0, 1e-5)]), (93, [(1, 1), (2, 1)]), (94, [(0, 0), (0, 5), (0, 9)]), (95, [(1e16, 0), (2e16, 0), (2e16, 3)]), (96, [(-50, -50), (50, -50), (50, 50), (0, 0), (-50, 50)])]
    p = r.uniform(-110, 110, (4000, 2))
    p[:200] = np.round(p[:200] / 10) * 10
    p[200:300] = [50, 0] + r.integers(-2, 3, (100, 2)) * 25
    p = np.concatenate([p, [[5e-6, 5e-6], [np.nan, 0], [np.inf, 1], [1.5e16, 1.0]]])
    want = np.zeros(len(p), int)
    for code, c in zones:
        n, x, y = np.zeros(len(p), int), p[:, 0], p[:, 1]
        for (x1, y1), (x2, y2) in zip(c, c[1:] + c[:1], strict=True):
            n += ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) if y1 != y2 else 0
        lo, hi = np.min(c, axis=0), np.max(c, axis=0)
        want[(n % 2 == 1) & (p >= lo).all(axis=1) & (p <= hi).all(axis=1) & (len(c) > 2)] = code
    f = frame(spark, np.column_stack([p, p[:, 0]]))
    out = spatial.polygon_codes(f, zones)
    assert (out.orderBy("pid").toPandas()["code"].to_numpy() == want).all() and len(set(want)) > 20
    assert f.where(G.in_polygon("x", "y", zones[60][1])).count() == (np.hypot(p[:, 0], p[:, 1]) < 0.99).sum() and f.where(G.in_polygon("x", "y", zones[61][1])).count() >= 1
    size = lambda z: len(spatial.polygon_codes(f, z)._jdf.queryExecution().optimizedPlan().toString())
    assert size([(i, ring(i, i, np.ones(24))) for i in range(2000)]) < 1.2 * size([(i, ring(i, i, np.ones(24))) for i in range(2)])
    assert spatial.polygon_codes(f, []).where("code <> 0").count() == 0


def test_zone_labels(spark):
    p = np.array([[0.5, 0.2, 0], [1.5, 0.2, 0], [9, 9, 0]])
    state = {"block": [[0, 0], [1, 0], [1, 1]], "non-block": [[0, 0], [2, 0], [2, 2]]}
    got = [r["code"] for r in labels.zone_labels(frame(spark, p), state).orderBy("pid").collect()]
    assert got == [-1, -1, 0]


@pytest.mark.parametrize("text", [True, False])
def test_ply_round_trip(spark, tmp_path, text):
    p = np.random.default_rng(0).random((20, 3))
    path = tmp_path / "c.ply"
    path.write_bytes(files.ply_bytes(p, np.full((20, 3), 300), text))
    t = files.read_cloud(spark, str(path)).orderBy("pid").toPandas()
    assert (t[["x", "y", "z"]].to_numpy() == p).all() and (t["red"] == 255).all()


def test_las_and_refusals(spark, tmp_path):
    import struct

    head = bytearray(227)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 2, 0
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<H", head, 105, 20)
    struct.pack_into("<I", head, 107, 2)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 10, 20, 30)
    body = b"".join(struct.pack("<3iHBBbBH", i * 100, 200, 300, 7, 0, 2, 0, 0, 0) for i in (1, 2))
    path = tmp_path / "c.las"
    path.write_bytes(bytes(head) + body)
    t = files.read_cloud(spark, str(path)).orderBy("pid").toPandas()
    assert t["x"].tolist() == [11, 12] and t["z"].tolist() == [33, 33]
    head[104] = 128
    path.write_bytes(bytes(head) + body)
    with pytest.raises(Exception, match="LAZ"):
        files.read_cloud(spark, str(path)).collect()
    with pytest.raises(RuntimeError):
        files.read_cloud(spark, "a.LAZ")
    with pytest.raises(ValueError):
        files.read_cloud(spark, "a.obj")


def test_xyz_and_parameters(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("# note\n1 2 3 9\n 4  5 nan\n7 8 9\n")
    assert files.read_xyz(spark, str(tmp_path / "a.xyz")).count() == 2
    (tmp_path / "param.csv").write_text("﻿Name,denoise,nnptcloud,cf,nmin,res\na.ply,TRUE,20.0,0.8,,0.5\na.ply,0,9,,,\nb.ply,no,x,,,\n")
    p = files.read_parameters(spark, str(tmp_path / "param.csv"), "a.ply")
    assert p.denoise and p.nnptcloud == 20 and p.radfactor == 0.8 and p.nmin == 50 and p.minnpoint == 50 and p.res == 0.5
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_parameters(spark, str(tmp_path / "param.csv"), "b.ply")
    assert files.read_parameters(spark, str(tmp_path / "param.csv"), "c.ply") == M.Parameters()
    assert files.run_folders(str(tmp_path), "a")["index"] == "1" and files.run_folders(str(tmp_path), "a")["index"] == "2"


def test_stream_equals_batch(spark, tmp_path):
    f = frame(spark, np.random.default_rng(0).random((300, 3)) * 4)
    for i in range(3):
        f.where(f"pid % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rollup.stream_voxels(s, 1.0, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    a = rollup.read_voxels(spark, str(tmp_path / "out")).orderBy("cx", "cy", "cz").toPandas()
    b = S.voxels(f, 1.0).orderBy("cx", "cy", "cz").toPandas()
    assert (a["n"] == b["n"]).all() and np.allclose(a[["x", "y", "z"]], b[["x", "y", "z"]])


def test_draws_with_replacement_ignore_partitions(spark):
    rows = spark.range(500).selectExpr("id * 7 AS pid", "id AS x")
    draw = lambda r: sorted((g["pid"], g["x"]) for g in summary.bootstrap_sample(r, 300, seed=3).collect())
    one = draw(rows.repartition(1))
    assert len(one) == 300 and one == draw(rows.repartition(7)) and len(set(one)) < 300 and all(p == 7 * x for p, x in one)
    assert len(draw(rows.limit(20))) == 20 and draw(rows.limit(0)) == []


def test_points_meet_the_last_polygons_first(spark, monkeypatch):
    """Many polygons over one another: the codes are those of all polygons, but of those that others hide none is laid out."""
    r = np.random.default_rng(4)
    at, half = r.uniform(0, 20, (600, 2)), r.uniform(3, 6, 600)
    zones = [(i + 1, [(x - s, y - s), (x + s, y - s / 2), (x + s, y + s), (x, y + s / 3), (x - s, y + s)]) for i, ((x, y), s) in enumerate(zip(at.tolist(), half.tolist(), strict=True))]
    zones[3] = (4, [(90, 90), (99, 90), (99, 99)])
    p = np.concatenate([r.uniform(0, 20, (2000, 3)), [[98, 91, 0], [40, 40, 0], [np.nan, 3, 0]]])
    f, want, (x, y) = frame(spark, p), np.zeros(len(p), int), p[:, :2].T
    for code, c in zones:
        want[sum(((b > y) != (e > y)) & (x < (d - a) * (y - b) / (e - b) + a) for (a, b), (d, e) in zip(c, c[1:] + c[:1], strict=True) if b != e) % 2 == 1] = code
    laid, plain = [], spatial.polygon_cells

    def counted(*a):
        out = plain(*a)
        laid.append(out.agg({"*": "count"}).first()[0] and out.selectExpr("sum(size(inside))").first()[0])
        return out

    monkeypatch.setattr(spatial, "polygon_cells", counted)
    monkeypatch.setattr(spatial, "FIRST", 30, raising=False)
    got = spatial.polygon_codes(f, zones)
    assert got.columns == [*f.columns, "code"] and got.orderBy("pid").toPandas()["code"].tolist() == want.tolist() and want[2000] == 4
    counts, everything = sum(laid), plain(spatial.polygon_table(spark, zones)).selectExpr("sum(size(inside))").first()[0]
    assert counts < everything / 4


def test_balls_are_summed_without_pairs(spark, monkeypatch):
    """Counts and eigenvalues of balls against all pairs, in many small parts; on a lattice many points lie at the radius itself."""
    for name, value in (("BALL_ASK", 60), ("BALL_HAVE", 90), ("BALL_LEAF", (7, 5)), ("BALL_BLOCK", 64)):
        monkeypatch.setattr(spatial, name, value, raising=False)
    monkeypatch.setattr(spatial, "radius_join", None)
    monkeypatch.setattr(roughness, "radius_join", None, raising=False)
    r = np.random.default_rng(2)
    p = np.concatenate([r.integers(0, 9, (500, 3)) * 0.1 + 1000, r.normal(1000, 0.3, (300, 3)), [[0, 0, 0], [np.nan, 0, 0]]])
    got = roughness.neighbourhood_eigenvalues(frame(spark, p), 0.6).orderBy("pid").toPandas()
    inside = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)) <= 0.3
    assert len(got) == len(p) - 1
    for i in range(len(p) - 1):
        e = np.maximum(np.linalg.eigvalsh(np.cov(p[inside[i]].T)), 1e-12) if inside[i].sum() >= 10 else np.full(3, np.nan)
        assert got.loc[i, ["e0", "e1", "e2"]].to_numpy(float) == pytest.approx(e / e.sum(), abs=1e-6, nan_ok=True)
    counts = spatial.ball_moments(frame(spark, p), 0.3).orderBy("pid").toPandas()["n"]
    assert counts.tolist() == inside.sum(axis=1)[:-1].tolist()


def test_elongation_and_volume(spark):
    m = spark.createDataFrame([(1, [2.0, 1.5, 1.0], 10.0), (2, [1.0, 1.0, 1.0], 0.0)], "label long, r array<double>, v double")
    got = {g["label"]: (g["elongation"], g["log_volume"]) for g in summary.elongation(m).collect()}
    assert got == {1: (0.5, 1.0), 2: (0.0, -12.0)}


def test_density_equals_all_pairs(spark):
    """Against the sum of kernels over all pairs, for a lump with outliers; flat points and nulls."""
    r = np.random.default_rng(3)
    p = np.concatenate([r.normal(0, [0.1, 0.02], (600, 2)) @ np.array([[1, 0.5], [0, 1]]), r.random((60, 2)), [[4.0, 4.0]]])
    n, cov = len(p), np.cov(p.T) * len(p) ** (-1 / 3)
    d = p[:, None] - p[None]
    want = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", d, np.linalg.inv(cov), d)).sum(axis=1) / (n * 2 * np.pi * np.sqrt(np.linalg.det(cov)))
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)]
    got = summary.density(spark.createDataFrame(rows, "pid long, tx double, ty double").repartition(3)).orderBy("pid").toPandas()
    assert got["density"][:2].isna().all() and got["density"][2:].to_numpy() == pytest.approx(want, rel=1e-3)
    line = spark.createDataFrame([(i, i / 7, i / 7) for i in range(9)], "pid long, tx double, ty double")
    assert {x["density"] for x in summary.density(line).collect()} == {1.0} and summary.density(line.limit(0)).count() == 0


def test_density_makes_its_points_once(spark, tmp_path):
    """Points that cost much to make are not made again for each of the steps."""

    def made(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    points = spark.createDataFrame([(i, i / 7, (i * i % 11) / 7) for i in range(40)], "pid long, tx double, ty double").coalesce(1)
    assert summary.density(points.mapInArrow(made, points.schema)).count() == 40 and len(list(tmp_path.iterdir())) == 1


def test_radius_pairs_copy_half_the_cells(spark):
    """Each pair once, on a lattice with negative coordinates and copies of points; a point is copied to 14 cells, not to 27."""
    r = np.random.default_rng(6)
    p = np.concatenate([r.integers(-3, 4, (150, 3)) * 0.5, r.normal(0, 1, (150, 3))])
    got = spatial.radius_pairs(frame(spark, p), 0.5)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    assert sorted(map(tuple, got.collect())) == sorted((i, j, d[i, j]) for i in range(300) for j in range(i + 1, 300) if d[i, j] <= 0.5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "-1,0,1" not in plan.replace(" ", "")
