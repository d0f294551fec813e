"""Command line: run, label and label-instances over files.

On a cluster start it with spark-submit: the session then keeps the master that is set there, and --shared or spark.checkpoint.dir names the folder
that driver and executors share."""

from __future__ import annotations

import argparse
import json
import os

from talus.model import SMRF, Parameters
from talus.operators import labels as L
from talus.operators.summary import display_sample
from talus.plans import engine
from talus.session import get_session
from talus.sources import files


def build_parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="talus")
    sub = top.add_subparsers(dest="command", required=True)
    switch = argparse.BooleanOptionalAction

    def command(name: str, root: str):
        p = sub.add_parser(name)
        p.add_argument("cloud", nargs="?")
        p.add_argument("--pointcloud", help="the same as the first argument")
        p.add_argument("--output-root", "--output", dest="output", default=root)
        p.add_argument("--seed", type=int, default=0)
        p.add_argument("--master", help="Spark's master; by default what the launcher set, else all cores of this machine")
        p.add_argument("--shared", help="folder for tables between stages")
        return p

    r = command("run", "outputs")
    r.add_argument("--param-csv")
    r.add_argument("--preprocess-mode", default="matlab", choices=["matlab", "fast"])
    r.add_argument("--sizing-mode", default="ellipsoid", choices=["ellipsoid", "block"])
    r.add_argument("--fit-strategy", default="hybrid_direct", choices=["pca_maxabs", "bounded_pca", "hybrid_direct"])
    r.add_argument("--orientation-mode", default="atan2", choices=["atan2", "matlab"])
    r.add_argument("--ground-mode", default="none", choices=["none", "smrf"])
    r.add_argument("--smrf-cell-size", type=float, default=0.0, help="0: by the spacing of the points")
    for name in ("window", "height", "slope"):
        r.add_argument({"window": "--smrf-max-window"}.get(name, f"--smrf-{name}-threshold"), type=float, default=SMRF[name])
    r.add_argument("--block-split", action=switch, default=False)
    r.add_argument("--max-ellipsoid-cloud-fraction", type=float, default=0.25, help="0: no cap")
    r.add_argument("--save-grains", "--export-grains", dest="save_grains", action=switch, default=False)
    r.add_argument("--save-colored-clouds", action=switch, default=False)
    r.add_argument("--skip-plots", action="store_true")
    r.add_argument("--workers", type=int, default=0, help="cores of this machine; 0: what the master says")
    for name in ("label", "label-instances"):
        p = command(name, "labels")
        p.add_argument("--polygons", help="JSON of polygons drawn elsewhere")
        p.add_argument("--reset-session", "--reset", dest="reset", action=switch, default=False)
        p.add_argument("--detrend", action=switch, default=False)
        p.add_argument("--rotate-horizontal", action=switch, default=True)
        p.add_argument("--max-display-points", type=int, default=120_000)
    return top


def run(spark, a: argparse.Namespace, name: str) -> dict:
    csv = a.param_csv or os.path.join(os.path.dirname(a.cloud) or ".", "param.csv")
    par = files.read_parameters(spark, csv, os.path.basename(a.cloud)) if os.path.exists(csv) else Parameters()
    paths = files.run_folders(a.output, name)
    smrf = {"cell": a.smrf_cell_size, "window": a.smrf_max_window, "height": a.smrf_height_threshold, "slope": a.smrf_slope_threshold}
    cloud = files.read_cloud(spark, a.cloud, ["pid", "x", "y", "z"])
    out = engine.run(
        cloud,
        par,
        a.preprocess_mode,
        a.sizing_mode,
        a.fit_strategy,
        a.max_ellipsoid_cloud_fraction,
        a.ground_mode,
        a.block_split,
        a.seed,
        a.orientation_mode,
        smrf,
    )
    written: dict = {"csv": None, "clouds": {}, "figures": []}
    if par.savegranulo:
        written["csv"] = os.path.join(paths["Excel"], f"{name}_granulo.csv")
        files.write_granulo(out.granulo, written["csv"])
    if a.save_grains:
        written["grains"] = files.write_ply_groups(out.cloud.join(out.labels.select("pid", "label"), "pid"), paths["Grain"], name).count()
    raw = engine.S.normalise(cloud)
    clouds = engine.coloured(raw, out, a.orientation_mode) if a.save_colored_clouds else {}
    written["clouds"] |= {k: os.path.join(paths["Cloud"], f"{name}_by_{k}.ply") for k in clouds}
    if a.save_colored_clouds and out.ground is not None:
        ground = engine.ground_clouds(raw, out.cloud, out.ground)
        written["clouds"] |= {k: os.path.join(paths["Cloud"], f"{name}_{k}.ply") for k in ground}
        clouds |= ground
    for k, t in clouds.items():
        files.write_ply(t, written["clouds"][k]).collect()
    if not a.skip_plots and par.saveplot:
        for k, t in engine.figures(out, a.sizing_mode, orientation=a.orientation_mode).items():
            t.write.mode("overwrite").parquet(os.path.join(paths["Figure"], k))
            written["figures"].append(k)
    return out.counts | ({"blocks": out.notes} if out.notes else {}) | {"paths": paths, "written": written}


def label(spark, a: argparse.Namespace, name: str) -> dict:
    kind = "zones" if a.command == "label" else "instances"
    paths = L.session_paths(a.output, name, kind)
    if a.reset:
        L.clear_session(paths)
    view = L.prepare_view(files.read_cloud(spark, a.cloud, ["pid", "x", "y", "z"]), a.rotate_horizontal, a.detrend)
    state = None
    for p in (a.polygons, paths["polygons"]):
        if p and os.path.exists(p):
            with open(p) as f:
                state = json.load(f)
            break
    drawn = bool(L.normalise_zones(state)["mode_order"] if kind == "zones" else L.normalise_instances(state))
    if not drawn and os.path.exists(paths["labels"]):
        return {"counts": {str(r["code"]): r["n"] for r in L.counts(L.load_session(view, paths)).collect()}, "paths": paths, "reloaded": True}
    labelled = L.zone_labels(view, state) if kind == "zones" else L.instance_labels(view, state)
    meta = L.save_session(labelled, state or {}, paths, seed=a.seed, kind=kind)
    display_sample(labelled.withColumn("label", engine.F.col("code")), a.max_display_points, a.seed).write.mode("overwrite").parquet(paths["sample"])
    return {"counts": meta["counts"], "paths": paths, "reloaded": False}


def main(argv: list[str] | None = None) -> int:
    parser = build_parser()
    a = parser.parse_args(argv)
    a.cloud = a.pointcloud or a.cloud
    if not a.cloud:
        parser.error("a point cloud is needed")
    workers = getattr(a, "workers", 0)
    spark = get_session(a.master or (f"local[{workers}]" if workers else None), shared=a.shared)
    print(json.dumps((run if a.command == "run" else label)(spark, a, files.safe_name(a.cloud))))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
