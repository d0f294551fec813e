"""The whole run: a cloud in, segments, models and the grain table out; every stage is a DataFrame of the one before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus import model as M
from talus.operators import blocks, fit, roughness, spatial, summary
from talus.operators import surface as S
from talus.session import cut


@dataclass
class Result:
    cloud: DataFrame
    neighbours: DataFrame
    labels: DataFrame
    models: DataFrame
    granulo: DataFrame
    counts: dict
    turned: DataFrame
    initial: DataFrame
    merged: DataFrame
    ground: DataFrame | None = None
    notes: dict | None = None


def ground_options(smrf: dict | None, gap: float) -> tuple[float, dict]:
    """The ground filter's cell (0: by the spacing of the points) and its other options; one that isn't given takes its default, a zero counts."""
    how = {k: v for k, v in (smrf or {}).items() if v is not None}
    return how.pop("cell", None) or max(M.SMRF["cell_factor"] * gap, M.SMRF["min_cell"]), how


def run(
    cloud: DataFrame,
    par: M.Parameters | None = None,
    mode: str = "matlab",
    sizing: str = "ellipsoid",
    strategy: str = "bounded_pca",
    cap_fraction: float = 0.25,
    ground: str = "none",
    parts: bool = False,
    seed: int = 0,
    orientation: str = "atan2",
    smrf: dict | None = None,
) -> Result:
    """cloud (pid, x, y, z). mode: matlab or fast preparation; sizing: ellipsoid or block; ground: none or smrf (block sizing), with smrf's cell,
    window, height and slope; orientation: atan2 or matlab."""
    par = par or M.Parameters()
    if (par.denoise or par.minima) and mode not in ("matlab", "fast"):
        raise ValueError(f"unknown preprocess mode: {mode}")
    if sizing == "block" and ground not in ("none", "smrf"):
        raise ValueError(f"unknown ground mode: {ground}")
    if orientation not in ("atan2", "matlab"):
        raise ValueError(f"unknown orientation mode: {orientation}")
    k, height, notes = par.nnptcloud, None, None
    raw = cut(S.normalise(cloud).select("pid", "x", "y", "z"))
    pts = raw
    if par.denoise:
        n, t = M.MATLAB_DENOISE if mode == "matlab" else (k, 2.0)
        pts = cut(S.denoise(pts, spatial.knn(pts, n), n, t).select("pid", "x", "y", "z"))
    if par.decimate and par.res > 0:
        pts = cut(S.voxels(pts, par.res).select("pid", "x", "y", "z"))
    if par.minima:
        pts = cut(S.minima(pts, roughness.roughness(pts, par, mode, seed)).select("pid", "x", "y", "z"))
    cap = S.span_cap(pts, cap_fraction).first()[0]
    turned = cut(S.detrend(S.rotate_horizontal(pts))[0]) if par.rotdetrend else pts
    nbr = cut(spatial.knn(pts, k))
    surface = S.nearest_area(nbr)
    if sizing == "block":
        only = None
        if ground == "smrf":
            cell, how = ground_options(smrf, S.spacing(nbr) or M.EPS)
            height = cut(S.nonground(turned, cell, **how))
            only = height.where("nonground").select("pid")
        labels, notes = blocks.segment(pts, turned, nbr, cut(S.block_score(S.surface_features(nbr, turned, k))), k, par.minnpoint, parts, only)
        first = merged = labels
    else:
        normal = cut(S.normals(nbr, pts))
        first = cut(S.watershed(S.receivers(nbr, turned)))
        merged = S.relabel(first, S.merge_edges(pts, nbr, first, normal, k, par.radfactor, par.maxangle1))
        labels = cut(S.clean(pts, nbr, merged, normal, k, par.maxangle2, par.minnpoint, par.minflatness)) if par.clean else merged
    segments = pts.join(labels.where("label IS NOT NULL").select("pid", "label"), "pid").join(surface, "pid")
    models = cut(fit.fit(segments, par, strategy, cap, sizing, seed))
    number = lambda t: t.where("label IS NOT NULL").select("label").distinct().count()
    counts = {"raw_points": raw.count(), "points": pts.count(), "initial_labels": number(first), "merged_labels": number(merged), "final_labels": number(labels)}
    counts |= models.agg(F.count("*").alias("models"), F.count_if(F.expr(summary.ACCEPTED)).alias("accepted")).first().asDict()
    return Result(pts, nbr, labels, models, summary.granulo(models, orientation), counts, turned, first, merged, height, notes)


#: Which colour map shows what.
COLOURS = {"volume": "viridis", "elongation": "plasma", "azimuth": "twilight"}


def coloured(raw: DataFrame, result: Result, orientation: str = "atan2") -> dict[str, DataFrame]:
    """The raw cloud coloured by the volume, elongation and angle of the grain of its nearest processed point."""
    own = result.cloud.join(result.labels.select("pid", "label"), "pid", "left")
    near = spatial.nearest_label(raw, own).select("pid", "label")
    o = summary.orientations(result.models, orientation).selectExpr("label", "angle_map AS azimuth")
    v = summary.elongation(summary.accepted(result.models)).withColumnRenamed("log_volume", "volume").join(o, "label", "left")
    at = cut(raw.join(near, "pid").join(v, "label", "left"))
    return {c: summary.colour_ramp(at, c, ramp).select("pid", "x", "y", "z", "red", "green", "blue") for c, ramp in COLOURS.items()}


def ground_clouds(raw: DataFrame, cloud: DataFrame, ground: DataFrame) -> dict[str, DataFrame]:
    """The raw cloud coloured by height above ground and by the ground mask."""
    own = cloud.join(ground, "pid").selectExpr("pid", "x", "y", "z", "struct(height_above_ground, nonground) AS label")
    at = cut(raw.join(spatial.nearest_label(raw, own).select("pid", "label"), "pid").selectExpr("pid", "x", "y", "z", "label.height_above_ground AS height", "label.nonground AS up"))
    return {"height_above_ground": summary.colour_ramp(at, "height", "inferno"), "ground_mask": summary.colour_binary(at, "up", (244, 131, 66), (61, 92, 140))}


def figures(result: Result, sizing: str = "ellipsoid", most: int = 25_000, orientation: str = "atan2") -> dict[str, DataFrame]:
    """What the figures of a run draw, as tables: the set depends on the sizing, as does what a box or an ellipsoid stands for."""
    some = cut(summary.stride_sample(result.turned.select("pid", "x", "y", "z"), most))
    of = lambda labels: some.join(labels.select("pid", "label"), "pid", "left")
    out = {"elevation": some, "labels_ini": of(result.initial), "labels_cluster": of(result.merged)}
    if sizing == "ellipsoid":
        out |= {"labels_clean": of(result.labels), "fitted_ellipsoids": summary.ellipsoid_mesh(result.models)}
    angles = summary.orientations(result.models, orientation)
    out |= {"fitted_cuboids": summary.box_edges(result.models), "granulo_edges": summary.edges(result.models)}
    return out | {"rose_map": summary.rose(angles, "angle_map", mirrored=True), "rose_x": summary.rose(angles, "angle_x")}
