"""Whole runs, sessions and the command line, over files."""

import json
import zipfile

import numpy as np
import pandas as pd
import pytest

from talus import model as M
from talus.operators import blocks, fit, labels, spatial, summary
from talus.plans import cli, engine
from talus.sources import files, points


def frame(spark, p, **more):
    return spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], **more}))


def bumps(n=1500):
    r = np.random.default_rng(2)
    xy = r.random((n, 2)) * [6, 3]
    z = sum(np.sqrt(np.maximum(0, 1 - ((xy - c) ** 2).sum(axis=1))) for c in ([1.5, 1.5], [4.5, 1.5]))
    return np.column_stack([xy, z + 0.01 * r.random(n)])


def box_field(n=700):
    """Five boxes' tops and sides on a gentle slope."""
    r = np.random.default_rng(3)
    ground = np.column_stack([r.random((4000, 2)) * [20, 20], np.zeros(4000)])
    ground[:, 2] = 0.02 * ground[:, 0] + 0.01 * r.random(4000)
    out = [ground]
    for k, c in enumerate([[4, 4], [15, 5], [10, 10], [5, 15], [15, 15]]):
        a, (w, d, h) = 0.3 * k, (2.4, 1.6, 1.2)
        local = np.column_stack([(r.random(n) - 0.5) * w, (r.random(n) - 0.5) * d, np.full(n, h)])
        side = r.random(n) < 0.5
        edge = r.random(n) < 0.5
        local[side & edge, 0] = np.sign(local[side & edge, 0]) * w / 2
        local[side & ~edge, 1] = np.sign(local[side & ~edge, 1]) * d / 2
        local[side, 2] = r.random(side.sum()) * h
        turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        out.append(np.column_stack([local[:, :2] @ turn.T + c, local[:, 2] + 0.02 * c[0]]))
    return np.concatenate(out)


def test_blocks_on_a_slope(spark):
    """Block sizing with the ground filter: what is found lies on the boxes."""
    p = box_field()
    own = np.concatenate([np.zeros(4000, int), np.repeat(np.arange(1, 6), 700)])
    for ground, parts in (("smrf", False),):
        out = engine.run(frame(spark, p), M.Parameters(denoise=False, nmin=30), sizing="block", ground=ground, parts=parts, smrf={"cell": 0.5, "window": 4.0})
        found = out.labels.toPandas()
        assert found["pid"].is_unique and len(found)
        on_boxes = own[found["pid"].to_numpy()]
        assert (on_boxes > 0).mean() > 0.7
        up = out.ground.where("nonground").toPandas()["pid"]
        assert found["pid"].isin(up).all() and out.notes["prefilter_points"] == len(up) and out.notes["candidate_points"] <= len(found)
        models = out.models.toPandas()
        assert (models["aratio"] <= 1 + 1e-9).all() and (models["aratio"] > 0).all() and out.counts["models"] == len(models) == out.counts["final_labels"]
    clouds = engine.ground_clouds(engine.S.normalise(frame(spark, p)), out.cloud, out.ground)
    mask, height = clouds["ground_mask"].toPandas(), clouds["height_above_ground"].toPandas()
    assert set(clouds) == {"height_above_ground", "ground_mask"} and len(mask) == len(height) == len(p)
    assert (mask["red"] == 244).sum() == len(up) and set(mask["red"]) == {244, 61} and height.loc[height["height"].idxmax(), "red"] == 252
    assert {"elevation", "fitted_cuboids", "granulo_edges"} <= set(figs := engine.figures(out, "block", 500)) and "fitted_ellipsoids" not in figs
    assert figs["elevation"].count() <= 2 * 500


def test_boxes_of_one_and_two_points():
    c, ext, q, corners = fit.cuboid(np.array([[1.0, 2, 3], [2.0, 5, 1]]))
    assert c.tolist() == [1.5, 3.5, 2] and ext.tolist() == [3, 2, 1] and np.linalg.det(q) == pytest.approx(1)
    assert corners[:4].tolist() == [[1, 2, 3]] * 4 and corners[4:].tolist() == [[2, 5, 1]] * 4
    assert fit.cuboid(np.array([[1.0, 2, 3]]))[1].tolist() == [0, 0, 0]


def test_hull_of_many_points():
    r = np.random.default_rng(4)
    p = r.normal(size=(20_000, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    v, a = fit.hull(p)
    assert 4.1 < v < 4 / 3 * np.pi and 12.4 < a < 4 * np.pi
    assert fit.hull(r.random((5000, 3)) * [2, 3, 4])[0] == pytest.approx(24, rel=0.05)
    cube = np.array([[i, j, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)], float)
    assert fit.hull(np.concatenate([cube, cube * 0.5 + 0.2])) == pytest.approx((1, 6)) and fit.hull(cube[:, [0, 1, 1]] * [1, 1, 0]) is None


def test_command_line_runs(spark, tmp_path, capsys):
    cloud, root = tmp_path / "c.ply", str(tmp_path / "out")
    cloud.write_bytes(files.ply_bytes(bumps(), text=False))
    (tmp_path / "param.csv").write_text("Name,denoise,rotdetrend,nmin\nc.ply,no,no,40\n")
    assert cli.main(["run", "--pointcloud", str(cloud), "--output-root", root, "--save-grains", "--save-colored-clouds", "--orientation-mode", "matlab", "--max-ellipsoid-cloud-fraction", "0"]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["accepted"] >= 1 and out["points"] == 1500 and out["written"]["grains"] == out["final_labels"]
    for k in ("volume", "elongation", "azimuth"):
        t = files.read_cloud(spark, out["written"]["clouds"][k]).toPandas()
        assert len(t) == 1500 and t["red"].notna().all()
    table = pd.read_csv(out["written"]["csv"], header=None)
    assert len(table) == out["accepted"] and table.shape[1] == 9 and zipfile.is_zipfile(out["written"]["csv"].replace(".csv", ".xlsx"))
    assert {"elevation", "labels_clean", "fitted_ellipsoids"} <= set(out["written"]["figures"])
    assert spark.read.parquet(f"{out['paths']['Figure']}/labels_ini").count() == 1500
    with pytest.raises(SystemExit):
        cli.main(["run"])


def test_label_sessions(spark, tmp_path, capsys):
    cloud, root = tmp_path / "c.ply", str(tmp_path / "out")
    cloud.write_bytes(files.ply_bytes(bumps(), text=False))
    polygons = tmp_path / "p.json"
    polygons.write_text(json.dumps({"zones": {"block": [[0, 0], [3, 0], [3, 3], [0, 3]]}}))
    line = lambda *a: (cli.main([*a, str(cloud), "--output-root", root, "--no-rotate-horizontal"]), json.loads(capsys.readouterr().out.strip().splitlines()[-1]))[1]
    first = line("label", "--polygons", str(polygons), "--max-display-points", "100")
    assert sum(first["counts"].values()) == 1500 and 600 < first["counts"]["1"] < 900 and not first["reloaded"]
    assert spark.read.parquet(first["paths"]["sample"]).count() == 100
    assert set(files.read_cloud(spark, first["paths"]["preview"]).toPandas()["red"]) == {222, 120}
    again = line("label")
    assert again["counts"] == first["counts"]
    (tmp_path / "out/Label/c/zones_polygons.json").write_text("{}")
    assert line("label")["reloaded"] and line("label")["counts"] == first["counts"]
    assert line("label", "--reset-session")["counts"] == {"0": 1500}
    polygons.write_text(json.dumps([{"vertices": [[0, 0], [2, 0], [2, 3], [0, 3]]}, {"vertices": [[4, 0], [6, 0], [6, 3], [4, 3]]}]))
    third = line("label-instances", "--polygons", str(polygons), "--seed", "5")
    assert set(third["counts"]) == {"0", "1", "2"}
    view = frame(spark, bumps() + [1, 0, 0])
    with pytest.raises(RuntimeError):
        labels.load_session(view, labels.session_paths(root, "c", "instances"))
    labels.clear_session(labels.session_paths(root, "c", "instances"))
    assert labels.prepare_view(view, True, True).count() == 1500


def test_files_of_a_folder_keep_their_points_apart(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i}.ply").write_bytes(files.ply_bytes(np.full((3, 3), float(i)), text=False))
    t = files.read_cloud(spark, str(tmp_path / "*.ply")).orderBy("pid").toPandas()
    assert t["pid"].is_unique and t["x"].tolist() == [1, 1, 1, 2, 2, 2] and t["pid"].tolist()[:3] == [0, 1, 2]


def test_ply_of_a_frame(spark, tmp_path):
    p = np.random.default_rng(0).random((5000, 3))
    f = frame(spark, p, red=300, green=-1, blue=7).repartition(5)
    for text in (True, False):
        got = files.write_ply(f, str(tmp_path / f"a{text}.ply"), text).collect()
        back = files.read_cloud(spark, got[0]["path"]).toPandas()
        assert [g["n"] for g in got] == [5000] and (np.sort(back["x"]) == np.sort(p[:, 0])).all() and set(back["red"]) == {255} and set(back["green"]) == {0}
    many = files.write_ply(f.select("x", "y", "z"), str(tmp_path / "b.ply"), parts=True).collect()
    assert len(many) == 5 and files.read_cloud(spark, str(tmp_path / "b.*.ply")).count() == 5000


def test_the_grain_of_label_0_is_written(spark, tmp_path):
    f = frame(spark, np.random.default_rng(0).random((6, 3)), label=[0, 0, 1, 1, 1, None]).selectExpr("x", "y", "z", "CAST(CASE WHEN isnan(label) THEN NULL ELSE label END AS BIGINT) AS label")
    out = {g["label"]: g["n"] for g in files.write_ply_groups(f, str(tmp_path), "c").collect()}
    assert out == {0: 2, 1: 3} and (tmp_path / "c_grain_0.ply").exists()


def test_las_dimensions(spark, tmp_path):
    import struct

    head = bytearray(375)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 4, 7
    struct.pack_into("<I", head, 96, 375)
    struct.pack_into("<H", head, 105, 36)
    struct.pack_into("<Q", head, 247, 1)
    struct.pack_into("<6d", head, 131, 0.5, 0.5, 0.5, 0, 0, 0)
    body = struct.pack("<3iHBBBBhHd3H", 2, 4, 6, 77, 0x32, 0x95, 6, 9, -100, 5, 12.25, 65535, 256, 0)
    (tmp_path / "c.las").write_bytes(bytes(head) + body)
    t = files.read_cloud(spark, str(tmp_path / "c.las")).first().asDict()
    t |= t["extra"]
    want = {"x": 1, "y": 2, "z": 3, "intensity": 77, "return_number": 2, "number_of_returns": 3, "classification": 6, "user_data": 9, "scan_angle": -100, "point_source_id": 5, "gps_time": 12.25, "red": 255, "green": 1, "red_16": 65535, "synthetic": 1, "withheld": 1, "key_point": 0, "scanner_channel": 1, "edge_of_flight_line": 1}
    assert {k: t[k] for k in want} == want


def test_a_file_is_read_and_written_by_many_tasks(spark, tmp_path):
    """Splits give the same rows; x, y and z alone build no map; colours of a file are bytes by its largest; a failed write leaves nothing."""
    import struct

    head = bytearray(227)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 2, 2
    struct.pack_into("<IxxxxxH", head, 96, 227, 26)
    struct.pack_into("<I", head, 107, 1000)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 10, 20, 30)
    head[104] = 2
    (tmp_path / "c.las").write_bytes(bytes(head) + b"".join(struct.pack("<3iHBBbBH3H", i, 2 * i, 3 * i, i % 500, 0, 2, 0, 0, 0, 0, 7, 65 * i) for i in range(1000)))
    whole, split = (files.read_cloud(spark, str(tmp_path / "c.las"), split=s) for s in (1 << 26, 26 * 64))
    assert split.rdd.getNumPartitions() == 16 and sorted(whole.collect(), key=lambda r: r["pid"]) == sorted(split.collect(), key=lambda r: r["pid"])
    assert [r["blue"] for r in split.orderBy("pid").collect()] == [65 * i // 256 for i in range(1000)]
    few = files.read_cloud(spark, str(tmp_path / "c.las"), ["pid", "z"], 26 * 64)
    assert few.columns == ["pid", "z"] and few.where("pid = 999").first()["z"] == pytest.approx(3 * 999 * 0.01 + 30)
    p = np.random.default_rng(0).random((3000, 3))
    order = frame(spark, p).repartitionByRange(6, "pid").sortWithinPartitions("pid")
    for text in (False, True):
        (tmp_path / "one.ply").write_bytes(files.ply_bytes(p, text=text))
        assert files.write_ply(order, str(tmp_path / "many.ply"), text).first()["n"] == 3000
        assert (tmp_path / "many.ply").read_bytes() == (tmp_path / "one.ply").read_bytes()
        back = files.read_cloud(spark, str(tmp_path / "many.ply"), ["pid", "x", "y", "z"], 4096).orderBy("pid").toPandas()
        assert (back[["x", "y", "z"]].to_numpy() == p).all()
    assert files.write_ply(order.limit(0), str(tmp_path / "none.ply")).first()["n"] == 0 and files.read_cloud(spark, str(tmp_path / "none.ply")).count() == 0
    w = points.BlockWriter({"path": str(tmp_path / "x.ply"), "size": "9", "run": "r"})
    with pytest.raises(OSError):
        w.commit([points.Written(5), None])
    assert not list(tmp_path.glob("x.ply*")) and not list(tmp_path.glob("*.tmp"))


def test_defaults_of_the_command_line():
    a = cli.build_parser().parse_args(["run", "c.ply"])
    assert (a.smrf_max_window, a.smrf_height_threshold, a.smrf_slope_threshold, a.max_ellipsoid_cloud_fraction) == (12.0, 0.35, 0.75, 0.25)
    a = cli.build_parser().parse_args(["run", "c.ply", "--smrf-height-threshold", "0", "--smrf-slope-threshold", "0"])
    assert engine.ground_options({"cell": 0.0, "height": a.smrf_height_threshold, "slope": a.smrf_slope_threshold, "window": None}, 0.5) == (1.5, {"height": 0.0, "slope": 0.0})


def test_growing_stays_inside_the_filter(spark):
    """Points that the ground filter leaves out don't join a block, however near and well scored."""
    r = np.random.default_rng(1)
    p = r.random((400, 3)) * [4, 1, 0.5]
    f = frame(spark, p)
    own = f.where("pid % 5 = 0 AND x < 2").selectExpr("pid", "pid DIV 100 AS label")
    score = f.selectExpr("pid", "1e0 AS score")
    grown = blocks.grow(f, own, score, 0.6, f.where("x < 2").select("pid")).toPandas()
    assert (p[grown["pid"].to_numpy(), 0] < 2).all() and len(grown) == (p[:, 0] < 2).sum()
    assert (p[blocks.grow(f, own, score, 0.6).toPandas()["pid"].to_numpy(), 0] >= 2).any()


def test_growing_makes_no_table_of_pairs(spark, monkeypatch):
    """Points on a lattice, so that many are equally near and many lie at the radius itself: the nearest by (distance, id), found without all pairs within the radius."""
    monkeypatch.setattr(spatial, "radius_join", None)
    for name, value in (("TILE", 60), ("MOST", 120), ("PART", 90), ("SCAN", 8)):
        monkeypatch.setattr(spatial, name, value)
    r = np.random.default_rng(3)
    p = np.concatenate([r.integers(0, 12, (600, 3)) * [1.0, 1.0, 0.5], [[60, 0, 0], [62, 0, 0], [np.nan, 1, 1], [90, 0, 0]]])
    own = np.append(r.random(600) < 0.1, [True, False, False, False])
    want = {}
    for i in range(len(p)):
        d = np.sqrt(((p[i] - p) ** 2).sum(axis=1))
        near = [(d[j], j) for j in np.flatnonzero(own & (d <= 2.0))]
        if own[i] or near:
            want[i] = i if own[i] else int(min(near)[1])
    f = frame(spark, p)
    got = blocks.grow(f, f.where(f"pid IN ({', '.join(map(str, np.flatnonzero(own)))})").selectExpr("pid", "pid AS label"), f.selectExpr("pid", "1e0 AS score"), 2.0).collect()
    assert {g["pid"]: g["label"] for g in got} == want and len(got) == len(want) and 601 in want and 602 not in want
    some = blocks.grow(f, f.where("pid < 60").selectExpr("pid", "pid AS label"), f.selectExpr("pid", "CASE WHEN pid % 3 = 0 THEN 0e0 ELSE 1e0 END AS score"), 2.0, f.where("x < 6").select("pid")).toPandas()["pid"]
    near = [np.sqrt(((q - p[:60]) ** 2).sum(axis=1)).min() <= 2.0 for q in p]
    assert sorted(some) == [i for i in range(len(p)) if i < 60 or near[i] and i % 3 and p[i, 0] < 6]


def test_flat_blocks_have_no_volume():
    p = np.column_stack([np.random.default_rng(0).random((50, 2)), np.zeros(50)])
    m = fit.block(p, 1.0, None)
    assert m["v"] == 0 and m["aratio"] == 0 and m["acover"] == 0 and m["a"] == pytest.approx(2 * np.prod(fit.cuboid(p)[1][:2])) and m["fitok"]


def test_samples_and_colours(spark):
    f = frame(spark, np.random.default_rng(0).random((1000, 3))).repartition(7)
    got = sorted(r["pid"] for r in summary.stride_sample(f, 100).collect())
    assert got == list(range(0, 1000, 10))
    lab = f.selectExpr("*", "CASE WHEN pid < 30 THEN 1 ELSE 0 END AS label")
    some = summary.display_sample(lab, 50, 1).collect()
    assert len(some) == 50 and sum(r["label"] for r in some) == 30
    for name in summary.RAMPS:
        out = summary.colour_ramp(f.selectExpr("pid", "CASE WHEN pid = 5 THEN NULL WHEN pid = 6 THEN double('nan') ELSE pid * 1e0 END AS v"), "v", name).orderBy("pid").toPandas()
        assert tuple(out.loc[0, ["red", "green", "blue"]]) == summary.ramp(name)[0] and tuple(out.loc[999, ["red", "green", "blue"]]) == summary.ramp(name)[255]
        assert (out.loc[[5, 6], ["red", "green", "blue"]] == 96).all(axis=None)
    inst = summary.instance_colours(spark.range(20).withColumnRenamed("id", "code")).toPandas()
    assert len(set(map(tuple, inst[["red", "green", "blue"]].to_numpy()))) == 20 and inst[["red", "green", "blue"]].to_numpy().min() >= 0


def test_matlab_orientation(spark):
    m = spark.sql("SELECT 1L AS label, true AS fitok, true AS aqualityok, true AS sizecapok, array(0e0, 0e0, 0e0) AS c, array(1e0, 1e0, 1e0) AS r, array(0e0, 1e0, 0e0) AS axis_map, array(1e0, 1e0, 1e0) AS axis_x")
    a = summary.orientations(m, "matlab").first()
    assert a["angle_map"] == pytest.approx(np.pi / 2) and a["angle_x"] == pytest.approx(np.pi / 4 + np.pi / 2)
    assert summary.orientations(m).first()["angle_map"] == pytest.approx(0, abs=1e-12)


def test_exact_quantiles_of_many_values(spark):
    r = np.random.default_rng(8)
    v = np.concatenate([r.normal(size=3000), np.full(1500, 0.25), [np.nan]])
    t = spark.createDataFrame(pd.DataFrame({"v": v}))
    for share in (0.0, 0.05, 0.5, 0.55, 0.6, 0.61, 0.8, 0.999, 1.0):
        for keep in (50, 2000, 10_000):
            assert summary.exact_quantile(t, "v", share, keep) == pytest.approx(np.quantile(v[:-1], share), abs=1e-12)
    assert summary.exact_quantile(t.limit(0), "v", 0.5) is None
