"""Preparation, local surface, watershed segmentation, merging and cleaning; block score and ground filter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus import model as M
from talus.functions import geometry as G
from talus.operators.graph import components, forest_roots
from talus.operators.summary import array_quantile, exact_quantile
from talus.session import cut


def sql(text: str, **tables: DataFrame) -> DataFrame:
    return next(iter(tables.values())).sparkSession.sql(text, **tables)


# preparation


def normalise(cloud: DataFrame) -> DataFrame:
    """Finite rows, moved so that the least of each coordinate is 0."""
    some = cloud.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in "xyz"))
    low = F.broadcast(some.agg(*[F.min(c).alias(f"lo{c}") for c in "xyz"]))  # one row
    return some.join(low).selectExpr(*[c if c not in "xyz" else f"{c} - lo{c} AS {c}" for c in cloud.columns])


def voxels(cloud: DataFrame, size: float, id_column: str | None = "pid") -> DataFrame:
    """One point for each occupied cell: its mean, named by its least id (the cell itself names it where there is no id)."""
    cells = cloud.selectExpr("*", *[f"CAST(floor({c} / {size!r}) AS BIGINT) AS c{c}" for c in "xyz"])
    ids = [F.min(id_column).alias("pid")] if id_column else []
    return cells.groupBy("cx", "cy", "cz").agg(*ids, F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"])


def span_cap(cloud: DataFrame, fraction: float) -> DataFrame:
    """The largest extent of the cloud times a fraction; null where that is not positive."""
    return cloud.agg(F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("span")).selectExpr(f"CASE WHEN {fraction!r} > 0 AND span > 0 THEN {fraction!r} * span END AS cap")


def denoise(cloud: DataFrame, nbr: DataFrame, k: int, sigmas: float) -> DataFrame:
    """Points whose mean distance to k neighbours is at most the mean plus so many population deviations of all; with k + 1 points or fewer, all."""
    mean = nbr.where(F.col("rank") <= k).groupBy("pid").agg(F.avg("dist").alias("mean_dist"))
    top = F.broadcast(mean.agg((F.avg("mean_dist") + sigmas * F.stddev_pop("mean_dist")).alias("top"), F.count("*").alias("n")))  # one row
    return cloud.join(mean, "pid", "left").join(top).where(f"n <= {k + 1} OR mean_dist <= top").drop("top", "n")


def minima(cloud: DataFrame, rough: DataFrame) -> DataFrame:
    """Points rougher than all but a twentieth go, and those as rough as that bound."""
    bound = exact_quantile(rough, "rough", 0.95)
    return cloud.join(rough, "pid").where(f"rough < {bound!r}D" if bound is not None else "false").drop("rough")


def plane(cloud: DataFrame) -> DataFrame:
    """One row: centre, upward unit normal and eigenvalues of the least-squares plane."""
    m = cloud.agg(*[F.expr(e.format(x="x", y="y", z="z")).alias(k) for k, e in G.MOMENTS.items()])
    return stepwise(m, [G.covariance(0), *G.eigen_steps(), *G.normal_steps(), "sx / n AS mx, sy / n AS my, sz / n AS mz"])


def rotation_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The turn of unit vector a to unit vector b."""
    v, c = np.cross(a, b), float(a @ b)
    if c < -1 + 1e-12:
        axis = np.cross(a, [1.0, 0, 0]) if abs(a[0]) < 0.9 else np.cross(a, [0, 1.0, 0])
        axis /= np.linalg.norm(axis)
        return 2 * np.outer(axis, axis) - np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + k + k @ k / (1 + c)


def rotation_of(axis: np.ndarray, theta: float) -> np.ndarray:
    u = np.asarray(axis, float) / max(np.linalg.norm(axis), M.EPS)
    k = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
    return np.eye(3) + np.sin(theta) * k + (1 - np.cos(theta)) * (k @ k)


def rotate_horizontal(cloud: DataFrame) -> DataFrame:
    """Turned about the centre so that the plane's normal points up: the matrix is nine numbers in the plan."""
    p = plane(cloud).first()
    if p["n"] < 3:
        return cloud
    r, c = rotation_between(np.array([p["nx"], p["ny"], p["nz"]]), np.array([0, 0, 1.0])), (p["mx"], p["my"], p["mz"])
    turn = lambda i: " + ".join(f"({float(r[i, j])!r}D) * ({a} - ({float(c[j])!r}D))" for j, a in enumerate("xyz")) + f" + ({float(c[i])!r}D)"
    return cloud.selectExpr(*[a if a not in "xyz" else f"{turn('xyz'.index(a))} AS {a}" for a in cloud.columns])


def detrend(cloud: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """z less the least-squares quadratic of x and y; the sums are one aggregate over scaled coordinates, the 6 x 6 system is solved on the driver."""
    s = cloud.agg(*[f(c).alias(f"{k}{c}") for c in "xy" for f, k in ((F.avg, "m"), (F.stddev_pop, "d"))], F.count("*").alias("n")).first()
    if not s["n"]:
        return cloud, np.zeros(6)
    m, d = [s["mx"], s["my"]], [s["dx"] or 1.0, s["dy"] or 1.0]
    u, v = f"((x - ({m[0]!r}D)) / {d[0]!r}D)", f"((y - ({m[1]!r}D)) / {d[1]!r}D)"
    terms = ["1e0", u, v, f"{u} * {u}", f"{u} * {v}", f"{v} * {v}"]
    sums = cloud.selectExpr(*[f"{t} AS b{i}" for i, t in enumerate(terms)], "z").agg(
        *[F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"s{i}{j}") for i in range(6) for j in range(i, 6)],
        *[F.sum(F.col(f"b{i}") * F.col("z")).alias(f"t{i}") for i in range(6)],
    ).first()
    a = np.array([[sums[f"s{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
    coef = np.linalg.lstsq(a, np.array([sums[f"t{i}"] for i in range(6)]), rcond=None)[0]
    fitted = " + ".join(f"({float(c)!r}D) * {t}" for c, t in zip(coef, terms, strict=True))
    # the same surface in unscaled coordinates
    (p, q), (e, f) = m, d
    c0, c1, c2, c3, c4, c5 = coef
    plain = np.array([c0 - c1 * p / e - c2 * q / f + c3 * p * p / e**2 + c4 * p * q / (e * f) + c5 * q * q / f**2, c1 / e - 2 * c3 * p / e**2 - c4 * q / (e * f), c2 / f - 2 * c5 * q / f**2 - c4 * p / (e * f), c3 / e**2, c4 / (e * f), c5 / f**2])
    return cloud.selectExpr(*[a if a != "z" else f"z - ({fitted}) AS z" for a in cloud.columns]), plain


# local surface


def spacing(nbr: DataFrame) -> float | None:
    """Median distance to the nearest neighbour."""
    return exact_quantile(nbr.where("rank = 1"), "dist", 0.5)


def nearest_area(nbr: DataFrame) -> DataFrame:
    """(pid, surface): the disc that reaches to the nearest neighbour."""
    return nbr.where("rank = 1").selectExpr("pid", "pi() * dist * dist AS surface")


def neighbour_coordinates(nbr: DataFrame, cloud: DataFrame) -> DataFrame:
    return nbr.join(cloud.selectExpr("pid AS nid", "x", "y", "z"), "nid")


def scales(k: int) -> list[int]:
    return sorted({6, max(6, k // 2), k}) if k > 6 else [k]


def stepwise(rows: DataFrame, steps: list[str]) -> DataFrame:
    """rows with the columns of each SELECT list, one over the other. Each is a row of its own kind (inline), so that Spark doesn't put the steps
    into one another: a column that is used often would be computed as often, and the code would outgrow a method."""
    for s in steps:
        rows = rows.selectExpr("*", f"inline(array(struct({s})))")
    return rows


def eigen_table(rows: DataFrame, ddof: int = 1, normals: bool = False, keys: tuple[str, ...] = ("pid",), xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """rows (keys, x, y, z), many for each key: moments, eigenvalues l0 <= l1 <= l2 and, if asked, the upward normal."""
    m = rows.groupBy(*keys).agg(*[F.expr(e.format(x=xyz[0], y=xyz[1], z=xyz[2])).alias(k) for k, e in G.MOMENTS.items()])
    return stepwise(m, [G.covariance(ddof), *G.eigen_steps(), *(G.normal_steps() if normals else [])])


def normals(nbr: DataFrame, cloud: DataFrame) -> DataFrame:
    return eigen_table(neighbour_coordinates(nbr, cloud), normals=True).select("pid", "nx", "ny", "nz")


def surface_features(nbr: DataFrame, cloud: DataFrame, k: int = 20) -> DataFrame:
    """The seven features of each point from its k neighbours; one pass over the neighbour table with sums by nested scale."""
    rows = cut(neighbour_coordinates(nbr, cloud))
    z = rows.groupBy("pid").agg(F.array_sort(F.collect_list("z")).alias("zs"), F.stddev_pop("z").alias("local_zstd"))  # k heights
    z = z.selectExpr("pid", f"array({array_quantile('zs', 0.15)}, {array_quantile('zs', 0.85)}) AS qz", "local_zstd")
    own = cloud.selectExpr("pid", "z AS own").join(z, "pid").selectExpr("pid", "own - qz[0] AS top_hat", "qz[1] - qz[0] AS local_relief", "local_zstd")
    shapes = None
    for s in scales(k):
        e = eigen_table(rows.where(F.col("rank") <= s)).selectExpr("pid", *[f"greatest(l{i}, {G.EPS}) AS l{i}" for i in range(3)])
        e = e.selectExpr("pid", f"{s} AS s", "l0 / l2 AS scatter", "l0 / (l0 + l1 + l2) AS curve", "(l1 - l0) / l2 AS planar")
        shapes = e if shapes is None else shapes.unionByName(e)
    shapes = shapes.groupBy("pid").agg(
        F.max(F.when(F.col("s") == k, F.col("scatter"))).alias("scattering"),
        F.avg("curve").alias("curvature_mean"),
        F.max("curve").alias("curvature_max"),
        F.avg("planar").alias("planarity_mean"),
    )
    return own.join(shapes, "pid").select("pid", *M.BLOCK_FEATURES)


def block_score(features: DataFrame) -> DataFrame:
    """features with score: a logistic function of the standardised features (a constant one counts 0)."""
    one = F.broadcast(features.agg(*[f(c).alias(f"{k}_{c}") for c in M.BLOCK_FEATURES for f, k in ((F.avg, "m"), (F.stddev_pop, "d"))]))
    terms = " + ".join(f"({w!r}D) * ({c} - m_{c}) / CASE WHEN d_{c} > 0 THEN d_{c} ELSE 1e0 END" for w, c in zip(M.BLOCK_WEIGHTS, M.BLOCK_FEATURES, strict=True))
    return features.join(one).selectExpr(*features.columns, f"1e0 / (1e0 + exp(-greatest(-50e0, least(50e0, {terms} + ({M.BLOCK_BIAS!r}D))))) AS score")


# watershed


def receivers(nbr: DataFrame, cloud: DataFrame) -> DataFrame:
    """(pid, parent): the neighbour of the steepest way up; a point above all its neighbours is its own parent."""
    slope = nbr.join(cloud.selectExpr("pid", "x AS ax", "y AS ay", "z AS az"), "pid").join(cloud.selectExpr("pid AS nid", "x", "y", "z"), "nid")
    slope = slope.selectExpr("pid", "nid", "rank", "(az - z) / greatest(sqrt((ax - x) * (ax - x) + (ay - y) * (ay - y) + (az - z) * (az - z)), 1e-12) AS slope")
    return slope.groupBy("pid").agg(
        F.min_by("nid", F.struct("slope", "rank")).alias("near"),
        F.min("slope").alias("least"),
    ).selectExpr("pid", "CASE WHEN least > 0 THEN pid ELSE near END AS parent")


def watershed(parents: DataFrame) -> DataFrame:
    """(pid, label, donors): label is the sink's id, 0-like null where a flat cycle has none; donors counts the points that drain here directly."""
    donors = parents.where("pid <> parent").groupBy(F.col("parent").alias("pid")).agg(F.count("*").alias("donors"))
    return forest_roots(parents).withColumnRenamed("root", "label").join(donors, "pid", "left").selectExpr("pid", "label", "coalesce(donors, 0) AS donors")


def border_angles(nbr: DataFrame, labels: DataFrame, normal: DataFrame, k: int) -> DataFrame:
    """(li, lj, mean_angle) from border points: a quarter of the neighbours have another label and nothing drains to the point."""
    at = labels.select("pid", "label", "donors")
    rows = nbr.join(at, "pid").join(at.selectExpr("pid AS nid", "label AS lj"), "nid")
    border = rows.groupBy("pid").agg(
        F.sum(F.when(F.col("label").eqNullSafe(F.col("lj")), 1).otherwise(0)).alias("same"),
        F.max("donors").alias("d"),
        F.max("label").alias("li"),
    ).where(f"{k} - same >= {k / 4!r} AND d = 0 AND li IS NOT NULL").select("pid", "li")
    n = normal.select("pid", "nx", "ny", "nz")
    pairs = rows.where("lj IS NOT NULL").select("pid", "nid", "lj").join(border, "pid").join(n.selectExpr("pid", "nx AS ax", "ny AS ay", "nz AS az"), "pid").join(
        n.selectExpr("pid AS nid", "nx AS bx", "ny AS by", "nz AS bz"),
        "nid",
    )
    return pairs.selectExpr("li", "lj", f"{G.angle(('ax', 'ay', 'az'), ('bx', 'by', 'bz'))} AS a").groupBy("li", "lj").agg(F.avg("a").alias("mean_angle"))


def label_neighbours(nbr: DataFrame, labels: DataFrame) -> DataFrame:
    at = labels.where("label IS NOT NULL")
    return nbr.join(at.selectExpr("pid", "label AS li"), "pid").join(at.selectExpr("pid AS nid", "label AS lj"), "nid").select("li", "lj").distinct()


def merge_edges(cloud: DataFrame, nbr: DataFrame, labels: DataFrame, normal: DataFrame, k: int, radfactor: float, max_angle: float) -> DataFrame:
    """(li, lj) of labels to join: close sinks for their areas, touching, and a border no sharper than max_angle (none counts as 0)."""
    area = nbr.where("rank = 1").join(labels.where("label IS NOT NULL"), "pid").groupBy("label").agg(F.sum(F.expr("pi() * dist * dist")).alias("area"))
    sinks = area.join(cloud.selectExpr("pid AS label", "x", "y", "z"), "label").selectExpr("label", "sqrt(area / pi()) AS radius", "x", "y", "z")
    angles = border_angles(nbr, labels, normal, k)
    e = label_neighbours(nbr, labels).where("li <> lj").join(
        sinks.selectExpr("label AS li", "radius AS ra", "x AS ax", "y AS ay", "z AS az"),
        "li",
    ).join(sinks.selectExpr("label AS lj", "radius AS rb", "x AS bx", "y AS by", "z AS bz"), "lj").join(angles, ["li", "lj"], "left")
    near = f"{radfactor * M.RADIUS_CORRECTION!r}D * (ra + rb) > sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz))"
    return e.where(f"{near} AND coalesce(mean_angle, 0e0) <= {max_angle!r}").select("li", "lj")


def relabel(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels joined along (li, lj): every label becomes the least of its component."""
    comp = components(labels.where("label IS NOT NULL").selectExpr("label AS id").distinct(), edges.selectExpr("li AS a", "lj AS b"))
    return cut(labels.join(comp.withColumnRenamed("id", "label"), "label", "left").selectExpr("pid", "root AS label", "donors"))


def flat_labels(cloud: DataFrame, labels: DataFrame, least_points: int, least_flatness: float) -> DataFrame:
    """Labels with shape: n, ratios of singular values and whether they stay."""
    rows = cloud.join(labels.where("label IS NOT NULL").select("pid", "label"), "pid").selectExpr("label AS pid", "x", "y", "z")
    e = eigen_table(rows, ddof=0).selectExpr("pid AS label", "n", "sqrt(greatest(l0, 0e0)) AS s3", "sqrt(greatest(l1, 0e0)) AS s2", "sqrt(greatest(l2, 0e0)) AS s1")
    return e.selectExpr("label", "n", "s2 / nullif(s1, 0e0) AS r2", "s3 / nullif(s1, 0e0) AS r3").selectExpr(
        "*",
        f"coalesce(n >= {least_points} AND (r3 > {least_flatness!r} OR r2 > {2 * least_flatness!r}), false) AS stays",
    )


def clean(cloud: DataFrame, nbr: DataFrame, labels: DataFrame, normal: DataFrame, k: int, max_angle: float, least_points: int, least_flatness: float) -> DataFrame:
    """Joins labels whose border is nearly flat (a missing border is none), then drops small and sheet-like ones."""
    joined = relabel(labels, border_angles(nbr, labels, normal, k).where(f"mean_angle > 0 AND mean_angle <= {max_angle!r}").select("li", "lj"))
    keep = flat_labels(cloud, joined, least_points, least_flatness).where("stays").select("label")
    return joined.join(keep.withColumn("ok", F.lit(True)), "label", "left").selectExpr("pid", "CASE WHEN ok THEN label END AS label", "donors")


# ground filter on a raster


def min_raster(cloud: DataFrame, cell: float) -> DataFrame:
    """Least height of each occupied cell, from the least x and y."""
    low = F.broadcast(cloud.agg(F.min("x").alias("lx"), F.min("y").alias("ly")))
    return cloud.join(low).selectExpr(
        f"CAST(floor((x - lx) / {cell!r}) AS BIGINT) AS gx",
        f"CAST(floor((y - ly) / {cell!r}) AS BIGINT) AS gy",
        "z",
    ).groupBy("gx", "gy").agg(F.min("z").alias("value"))


def fill_raster(raster: DataFrame, nx: int, ny: int) -> DataFrame:
    """Every cell of the grid; an empty one takes the nearest occupied cell's value (ties to the smaller column, then row)."""
    from talus.operators.spatial import nearest

    spark = raster.sparkSession
    full = spark.range(nx * ny).selectExpr(f"id % {nx} AS gx", f"id DIV {nx} AS gy")
    key = f"gx * {ny} + gy"
    holes = full.join(raster, ["gx", "gy"], "left_anti")
    near = nearest(
        holes.selectExpr(f"{key} AS pid", "gx * 1e0 AS x", "gy * 1e0 AS y", "0e0 AS z"),
        cut(raster.selectExpr(f"{key} AS pid", "gx * 1e0 AS x", "gy * 1e0 AS y", "0e0 AS z")),
        1,
        False,
    )
    filled = near.join(raster.selectExpr(f"{key} AS nid", "value"), "nid").selectExpr(f"pid DIV {ny} AS gx", f"pid % {ny} AS gy", "value")
    return cut(raster.select("gx", "gy", "value").unionByName(filled))


def opened(raster: DataFrame, radius: int) -> DataFrame:
    """Grey opening by a square of a raster with every cell of a rectangle: minima along rows and columns, then maxima; windows end at the grid's edge.

    A window's radius doubles from step to step by the values at its two sides and its middle, so a row costs the logarithm of the radius, in one sort for each direction."""
    steps, reach = [], 0
    while reach < radius:
        steps.append(min(max(reach, 1), radius - reach))
        reach += steps[-1]
    for f in ("least", "greatest"):
        for line, along in (("gy", "gx"), ("gx", "gy")):
            w = f"OVER (PARTITION BY {line} ORDER BY {along})"
            for d in steps:
                raster = raster.selectExpr("gx", "gy", f"{f}(lag(value, {d}) {w}, value, lead(value, {d}) {w}) AS value")
    return raster


def ground_surface(raster: DataFrame, window_cells: int) -> DataFrame:
    radius = 1
    while radius <= window_cells:
        raster = cut(opened(raster, radius))
        radius *= 2
    return raster


def slopes(raster: DataFrame, cell: float) -> DataFrame:
    """Length of the gradient: central differences, one-sided at the edge."""
    side = lambda a, b: f"(coalesce(lead(value) OVER w{a}, value) - coalesce(lag(value) OVER w{a}, value)) / nullif((CASE WHEN lead(value) OVER w{a} IS NULL THEN 0 ELSE 1 END + CASE WHEN lag(value) OVER w{a} IS NULL THEN 0 ELSE 1 END) * {cell!r}, 0e0)"
    return sql(
        f"SELECT gx, gy, sqrt(pow(coalesce({side('x', 'y')}, 0e0), 2) + pow(coalesce({side('y', 'x')}, 0e0), 2)) AS value FROM {{raster}} WINDOW wx AS (PARTITION BY gy ORDER BY gx), wy AS (PARTITION BY gx ORDER BY gy)",
        raster=raster,
    )


def nonground(cloud: DataFrame, cell: float, window: float = M.SMRF["window"], height: float = M.SMRF["height"], slope: float = M.SMRF["slope"]) -> DataFrame:
    """(pid, ground_height, height_above_ground, threshold, nonground)."""
    from talus.operators.spatial import bilinear

    b = cloud.agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy")).first()
    if b["lx"] is None:
        return cloud.selectExpr("pid", "z AS ground_height", "z AS height_above_ground", "z AS threshold", "false AS nonground")
    size = lambda c: (int((b["hx"] - b["lx"]) // c) + 1) * (int((b["hy"] - b["ly"]) // c) + 1)
    if size(cell) > M.SMRF["max_cells"]:
        cell *= (size(cell) / M.SMRF["max_cells"]) ** 0.5
    nx, ny = int((b["hx"] - b["lx"]) // cell) + 1, int((b["hy"] - b["ly"]) // cell) + 1
    top = ground_surface(fill_raster(cut(min_raster(cloud, cell)), nx, ny), max(1, round(window / max(cell, M.EPS))))
    at = cloud.selectExpr("pid", f"x - ({b['lx']!r}D) AS x", f"y - ({b['ly']!r}D) AS y")
    both = top.withColumnRenamed("value", "ground_height").join(slopes(top, cell).withColumnRenamed("value", "steep"), ["gx", "gy"])
    out = cloud.select("pid", "z").join(bilinear(both, at, cell, nx, ny, "ground_height", "steep"), "pid").selectExpr(
        "pid",
        "ground_height",
        "z - ground_height AS height_above_ground",
        f"{height!r}D + {slope!r}D * steep * {cell!r}D AS threshold",
    )
    return out.selectExpr("*", "height_above_ground > threshold AS nonground")
