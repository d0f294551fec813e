"""Multiscale distance to local planes, for the minima filter."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions import geometry as G
from talus.model import Parameters
from talus.operators.spatial import ball_moments, extent
from talus.operators.summary import placed
from talus.operators.surface import eigen_table, stepwise
from talus.session import cut

#: Draws that one row of the table of scales stands for.
AT_ONCE = 1000


def scale_table(spark, radii: list[float], draws: list[int]) -> DataFrame:
    """(scale, r, level, i): a row for each draw; level: the least power of two that is no less than r."""
    rows = [(n, r, math.ceil(math.log2(r)), k) for n, (r, k) in enumerate(zip(radii, draws, strict=True))]
    t = spark.createDataFrame(rows, "scale int, r double, level int, draws long")  # a row a scale
    t = t.selectExpr("scale", "r", "level", "draws", f"explode(sequence(0L, (draws - 1) DIV {AT_ONCE})) AS part")
    return t.selectExpr("scale", "r", "level", f"explode(sequence(part * {AT_ONCE}, least(draws, (part + 1) * {AT_ONCE}) - 1)) AS i")


def balls(cloud: DataFrame, centres: DataFrame, levels: list[int]) -> DataFrame:
    """(scale, r, w, centre, pid, x, y, z): every point within r of a centre, all scales in one join on cells of the level's size."""
    size = "CAST(pow(2e0, level) AS DOUBLE)"
    own = cloud.selectExpr("pid", "x", "y", "z", f"explode(array({', '.join(map(str, levels))})) AS level")
    own = own.selectExpr("*", *[f"CAST(floor({c} / {size}) AS BIGINT) AS g{c}" for c in "xyz"])
    right = centres.selectExpr("scale", "r", "level", "w", "pid AS centre", "x AS bx", "y AS by", "z AS bz")
    for c in "xyz":
        right = right.selectExpr("*", f"explode(sequence(CAST(floor((b{c} - r) / {size}) AS BIGINT), CAST(floor((b{c} + r) / {size}) AS BIGINT))) AS g{c}")
    near = "(x - bx) * (x - bx) + (y - by) * (y - by) + (z - bz) * (z - bz) <= r * r"
    return own.join(right, ["level", "gx", "gy", "gz"]).where(near).select("scale", "r", "w", "centre", "pid", "x", "y", "z")


def roughness(cloud: DataFrame, par: Parameters, mode: str = "matlab", seed: int = 0) -> DataFrame:
    """(pid, rough): mean over scales and random centres of the distance to the plane of a centre's ball, by its radius.

    matlab: signed distance; fast: absolute distance, six points at least. Centres are drawn with replacement, and one drawn again counts
    again. Points in no ball have 0."""
    if mode not in ("matlab", "fast"):
        raise ValueError(f"unknown preprocess mode: {mode}")
    box = extent(cloud)
    n = box["n"]
    if n < (3 if mode == "matlab" else 16):
        return cloud.selectExpr("pid", "0e0 AS rough")
    area = max((box["hix"] - box["lox"]) * (box["hiy"] - box["loy"]), par.minscale**2)
    many = max(1, round(area)) if mode == "matlab" else max(par.nscale, 1)
    top = min(par.maxscale, math.sqrt(area))
    radii = np.geomspace(par.minscale, top, many).tolist() if top > par.minscale else [par.minscale]
    draws = [max(1, round(many / r**2)) if mode == "matlab" else min(n, int(np.clip(area / r**2, 32, 512))) for r in radii]
    points, total = placed(cloud.select("pid", "x", "y", "z"), seed)
    drawn = scale_table(cloud.sparkSession, radii, draws).selectExpr("scale", "r", "level", f"pmod(xxhash64(i, scale, {seed}), {total}L) AS place")
    drawn = drawn.groupBy("scale", "r", "level", "place").agg(F.count("*").alias("w"))
    centres = cut(drawn.join(points, "place").drop("place"))
    pairs = balls(cloud, centres, sorted({math.ceil(math.log2(r)) for r in radii}))
    p = eigen_table(pairs, ddof=0, normals=True, keys=("scale", "centre")).where(f"n >= {3 if mode == 'matlab' else 6}")
    p = p.selectExpr("scale", "centre", "sx / n AS mx", "sy / n AS my", "sz / n AS mz", "nx", "ny", "nz")
    off = "-((x - mx) * nx + (y - my) * ny + (z - mz) * nz)"
    d = pairs.join(p, ["scale", "centre"]).selectExpr("pid", f"{off if mode == 'matlab' else f'abs({off})'} * w / r AS v", "w")
    mean = d.groupBy("pid").agg((F.sum("v") / F.sum("w")).alias("rough"))
    return cloud.select("pid").join(mean, "pid", "left").selectExpr("pid", "coalesce(rough, 0e0) AS rough")


def neighbourhood_eigenvalues(cloud: DataFrame, diameter: float, least: int = 10) -> DataFrame:
    """(pid, e0 <= e1 <= e2) of the ball of a diameter around each point, itself included; null with fewer points."""
    e = stepwise(ball_moments(cloud, diameter / 2), [G.covariance(1), *G.eigen_steps()]).selectExpr("pid", "n", *G.normalised())
    return e.selectExpr("pid", *[f"CASE WHEN n >= {least} THEN e{i} END AS e{i}" for i in range(3)])


def ternary(cloud: DataFrame, diameter: float, least: int = 10) -> DataFrame:
    return neighbourhood_eigenvalues(cloud, diameter, least).selectExpr("pid", f"{diameter!r}D AS diameter", "e0", "e1", "e2", *G.barycentric())
