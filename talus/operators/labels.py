"""Labels from polygons drawn on a view, and sessions that keep them."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators import spatial
from talus.operators.summary import display_sample, instance_colours
from talus.operators.surface import detrend, rotate_horizontal
from talus.sources.files import write_ply

ZONES = {"block": 1, "non-block": -1}
#: Fixed values.
ZONE_RGB = {1: (222, 92, 48), -1: (44, 123, 182), 0: (120, 120, 120)}


def prepare_view(cloud: DataFrame, rotate: bool = True, flatten: bool = False) -> DataFrame:
    cloud = rotate_horizontal(cloud) if rotate else cloud
    return detrend(cloud)[0] if flatten else cloud


def normalise_zones(state) -> dict:
    """{"zones": {name: corners or None}, "mode_order": [...]} out of that form, a bare dict of zones, or the old list of polygons."""
    zones, order = dict.fromkeys(ZONES), []
    if isinstance(state, list):
        for p in state:
            if p.get("mode") in ZONES:
                zones[p["mode"]] = p.get("vertices_xy")
                order = [m for m in order if m != p["mode"]] + [p["mode"]]
    elif isinstance(state, dict):
        found = state.get("zones", state)
        zones |= {k: v for k, v in found.items() if k in ZONES}
        order = list(state.get("mode_order") or [k for k in ZONES if zones[k]])
    zones = {k: [tuple(map(float, c)) for c in v] if v and len(v) >= 3 else None for k, v in zones.items()}
    order = [m for m in dict.fromkeys(order) if zones.get(m)]
    return {"zones": zones, "mode_order": order + [m for m in ZONES if zones[m] and m not in order]}


def normalise_instances(state) -> list[dict]:
    """[{id, vertices_xy}] by id; missing ids are the next free one."""
    out, top = [], 0
    for p in (state.get("instances", []) if isinstance(state, dict) else state or []):
        corners = p.get("vertices_xy") or p.get("vertices") or []
        if len(corners) >= 3:
            i = int(p["id"]) if p.get("id") is not None else top + 1
            top = max(top, i)
            out.append({"id": i, "vertices_xy": [tuple(map(float, c)) for c in corners]})
    return sorted(out, key=lambda p: p["id"])


def zone_labels(view: DataFrame, state) -> DataFrame:
    """code of the last drawn zone that holds the point: 1 block, -1 not, 0 unknown."""
    s = normalise_zones(state)
    return spatial.polygon_codes(view, [(ZONES[m], s["zones"][m]) for m in s["mode_order"]])


def instance_labels(view: DataFrame, state) -> DataFrame:
    return spatial.polygon_codes(view, [(p["id"], p["vertices_xy"]) for p in normalise_instances(state)])


def replace_zone(state, mode: str, corners) -> dict:
    s = normalise_zones(state)
    return normalise_zones({"zones": s["zones"] | {mode: corners}, "mode_order": [m for m in s["mode_order"] if m != mode] + [mode]})


def clear_zone(state, mode: str) -> dict:
    return replace_zone(state, mode, None)


def add_instance(state, corners) -> list[dict]:
    s = normalise_instances(state)
    return normalise_instances([*s, {"id": max([0, *(p["id"] for p in s)]) + 1, "vertices_xy": corners}])


def undo_instance(state) -> list[dict]:
    return normalise_instances(state)[:-1]


def counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("code").agg(F.count("*").alias("n"))


def session_paths(root: str, name: str, kind: str = "zones") -> dict[str, str]:
    d = os.path.join(root, "Label", name)
    return {
        "dir": d,
        "labels": f"{d}/{kind}.parquet",
        "meta": f"{d}/{kind}.json",
        "polygons": f"{d}/{kind}_polygons.json",
        "preview": f"{d}/{kind}.ply",
        "sample": f"{d}/{kind}_sample.parquet",
    }


def cloud_extent(view: DataFrame) -> dict:
    e = spatial.extent(view)
    return {k: e[k] for k in ("n", "lox", "hix", "loy", "hiy", "loz", "hiz")}


def preview_colours(labels: DataFrame, kind: str = "zones") -> DataFrame:
    """red, green, blue by zone, or by instance."""
    if kind == "instances":
        return instance_colours(labels)
    zone = lambda i: f"CAST(CASE WHEN code > 0 THEN {ZONE_RGB[1][i]} WHEN code < 0 THEN {ZONE_RGB[-1][i]} ELSE {ZONE_RGB[0][i]} END AS SMALLINT)"
    return labels.selectExpr("*", f"{zone(0)} AS red", f"{zone(1)} AS green", f"{zone(2)} AS blue")


def save_session(labels: DataFrame, state, paths: dict[str, str], preview: int = 10_000, seed: int = 0, kind: str = "zones") -> dict:
    """Labels as Parquet, counts, the cloud's extent and polygons as JSON, a sampled preview as PLY."""
    os.makedirs(paths["dir"], exist_ok=True)
    labels.select("pid", "code").write.mode("overwrite").parquet(paths["labels"])
    meta = {"counts": {str(r["code"]): r["n"] for r in counts(labels).collect()}, "cloud": cloud_extent(labels)}  # a row a code
    for k, v in (("meta", meta), ("polygons", state)):
        with open(paths[k], "w") as f:
            json.dump(v, f)
    write_ply(preview_colours(display_sample(labels.withColumn("label", F.col("code")), preview, seed), kind), paths["preview"], text=True).collect()
    return meta


def load_session(view: DataFrame, paths: dict[str, str]) -> DataFrame:
    """view with its saved codes; labels of a cloud of another size or place raise."""
    saved = view.sparkSession.read.parquet(paths["labels"])
    now = cloud_extent(view)
    with open(paths["meta"]) as f:
        then = json.load(f)["cloud"]
    width = max([1e-9, *(now[f"hi{c}"] - now[f"lo{c}"] for c in "xyz")]) if now["n"] else 1.0
    if now["n"] != then["n"] or saved.count() != now["n"] or any(abs(now[k] - then[k]) > 1e-6 * width for k in now if k != "n" and now["n"]):
        raise RuntimeError("saved labels belong to another cloud")
    return view.join(saved, "pid")


def clear_session(paths: dict[str, str]) -> None:
    import shutil

    for k in ("labels", "meta", "polygons", "preview", "sample"):
        shutil.rmtree(paths[k], ignore_errors=True) if os.path.isdir(paths[k]) else os.path.exists(paths[k]) and os.remove(paths[k])
    if os.path.isdir(paths["dir"]) and not os.listdir(paths["dir"]):
        os.rmdir(paths["dir"])
