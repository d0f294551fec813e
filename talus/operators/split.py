"""Components of blocks taken apart at the low ground between their tops, over a table of grid cells: no component is one task's."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus import model as M
from talus import session
from talus.operators import spatial
from talus.operators.graph import components, flooded
from talus.operators.summary import in_order, quantiles

KEYS = ["root", "gx", "gy"]


def cut(df: DataFrame) -> DataFrame:
    """``session.cut`` for tables that grow with the points: they are joined by sorting. Files are much smaller than their rows, so that Spark would take some for small and gather
    them on the driver."""
    return session.cut(df).hint("merge")


#: Parts of a cell's height.
WEIGHTS = {"score": 0.60, "top": 0.25, "relief": 0.15}


def _unit(v: str) -> str:
    """SQL: v between the two quantiles q of its component, clipped; 1 where they are equal, 0 for what is not finite."""
    q = f"q_{v}"
    inner = f"CASE WHEN {q}[1] - {q}[0] < {M.EPS!r} THEN 1e0 ELSE greatest(0e0, least(1e0, ({v} - {q}[0]) / ({q}[1] - {q}[0]))) END"
    return f"CASE WHEN {q} IS NULL OR isnan({v}) OR abs({v}) = double('inf') THEN 0e0 ELSE {inner} END"


def heights(cells: DataFrame) -> DataFrame:
    """cells (root, gx, gy, n, score, top, relief) with height: the weighted unit intervals of the three values within a component."""
    three = cells.selectExpr("root", f"stack(3, {', '.join(f'{v!r}, {v}' for v in WEIGHTS)}) AS (name, value)").where("abs(value) < double('inf')")
    q = quantiles(three, "value", [0.1, 0.9], "root", "name").groupBy("root").agg(*[F.max(F.when(F.col("name") == v, F.col("q"))).alias(f"q_{v}") for v in WEIGHTS])
    return cells.join(q, "root", "left").selectExpr(*cells.columns, " + ".join(f"{w!r}D * {_unit(v)}" for v, w in WEIGHTS.items()) + " AS height")


def smoothed(cells: DataFrame, sigma: float) -> DataFrame:
    """cells (root, gx, gy, nx, ny, n, height) with smooth: the Gaussian mean of height by n. A border cell stands for all beyond the border."""
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w = (w / w.sum())[reach:]
    lists = {"near": w, "beyond": np.append(np.cumsum(w[::-1])[::-1][1:], 0.0)}
    lists = {k: f"array({', '.join(f'{float(x)!r}D' for x in v)})[abs(d)]" for k, v in lists.items()}
    grid = cells.selectExpr(*KEYS, "nx", "ny", "n * height AS p", "CAST(n AS DOUBLE) AS q")
    for g, size in (("gx", "nx"), ("gy", "ny")):
        spread = grid.selectExpr("*", f"explode(sequence(-{reach}, {reach})) AS d").where(f"{g} + d >= 0 AND {g} + d < {size}")
        spread = spread.selectExpr(*[f"{g} + d AS {g}" if c == g else c for c in (*KEYS, "nx", "ny", "p", "q")], f"{lists['near']} + {lists['beyond']} * (IF({g} = 0, 1, 0) + IF({g} = {size} - 1, 1, 0)) AS w")
        grid = spread.groupBy(*KEYS, "nx", "ny").agg(F.sum(F.col("w") * F.col("p")).alias("p"), F.sum(F.col("w") * F.col("q")).alias("q"))
    return cells.join(grid.selectExpr(*KEYS, f"p / greatest(q, {M.EPS!r}) AS smooth"), KEYS)


def markers(cells: DataFrame, reach: float) -> DataFrame:
    """cells (id, root, gx, gy, smooth): (id, source) of the tops from which parts grow. source is a top's number within its component, highest first, joined
    to the component by the caller. Tops no farther apart than ``reach`` are one."""
    s = M.SPLIT
    around = cells.selectExpr("root", "inline(transform(sequence(0, 8), t -> struct(gx + t % 3 - 1 AS gx, gy + t DIV 3 - 1 AS gy))) ", "smooth AS other")
    around = around.groupBy(*KEYS).agg(F.max("other").alias("near"))
    bound = quantiles(cells, "smooth", [s["marker_quantile"]], "root").selectExpr("root", "q[0] AS bound")
    tops = cut(cells.join(around, KEYS).join(bound, "root").where("smooth >= bound AND smooth >= near - 1e-9").select("id", *KEYS, "smooth"))
    many = tops.groupBy("root").count().where(f"count >= {s['min_markers']}")
    tops = tops.join(many, "root", "left_semi")
    # components lie apart along the third axis
    at = cut(tops.selectExpr("id AS pid", "root", "gx * 1e0 AS x", "gy * 1e0 AS y", f"root * {4 * reach!r}D AS z", "smooth"))
    joined = at.join(components(at.selectExpr("pid AS id"), spatial.radius_pairs(at.select("pid", "x", "y", "z"), reach).selectExpr("pid AS a", "nid AS b")).selectExpr("id AS pid", "root AS top"), "pid")
    joined = cut(joined)
    high = joined.groupBy("root", "top").agg(F.max("smooth").alias("high")).withColumn("part", F.expr("row_number() OVER (PARTITION BY root ORDER BY high DESC, top)")).where(f"part <= {s['max_markers']}")
    kept = high.withColumn("parts", F.expr("count(*) OVER (PARTITION BY root)")).where(f"parts >= {s['min_markers']}")
    return joined.join(kept, ["root", "top"]).selectExpr("pid AS id", "root", "top AS source", "part")


def regions(cells: DataFrame, tops: DataFrame, reach: int) -> DataFrame:
    """(id, source) of the cells (id, root, gx, gy, smooth): each belongs to the top from which it is reached over the lowest pass, by cells that share a side. Passes
    are compared by cost (0 to 255), then by height, then by the cells' numbers. What no top reaches so is joined by the shortest gaps of at most ``reach``
    cells each way."""
    c = cells.selectExpr("id", *KEYS, "CAST(greatest(0e0, least(255e0, rint(255 * (1 - smooth)))) AS INT) AS cost", "1 - smooth AS depth")
    weight = "struct(greatest(c.cost, o.cost) AS cost, greatest(c.depth, o.depth) AS depth) AS w"

    def beside(t: DataFrame) -> DataFrame:
        o = t.selectExpr("root", "inline(array(struct(gx - 1 AS gx, gy), struct(gx, gy - 1 AS gy)))", "id", "cost", "depth")
        return t.alias("c").join(o.alias("o"), KEYS).selectExpr("c.id AS a", "o.id AS b", weight)

    got = cut(flooded(beside(c), tops))
    rest = cut(c.join(got.select("id"), "id", "left_anti"))
    if rest.isEmpty():
        return got
    side = 2 * reach + 1
    offsets = f"transform(sequence(0, {side * side - 1}), t -> struct(gx + t % {side} - {reach} AS gx, gy + t DIV {side} - {reach} AS gy, CAST(pow(t % {side} - {reach}, 2) + pow(t DIV {side} - {reach}, 2) AS INT) AS gap))"
    wide = rest.selectExpr("root", "id AS near", f"inline({offsets})").where("gap > 1").join(c.selectExpr(*KEYS, "id"), KEYS)
    wide = wide.selectExpr("near AS a", "id AS b", "struct(256 AS cost, CAST(gap AS DOUBLE) AS depth) AS w")
    return flooded(beside(rest).union(wide), got)


def split(rows: DataFrame, gap: float, radius: float, min_seeds: int, least: int) -> DataFrame:
    """rows (pid, root, x, y, score, local_relief, top_hat) of components whose points lie within the radius of one another: (pid, root, part). part is 0 where a component
    stays whole, else the number of the point's part, -1 where that is too small.

    Cells of the grid are rows throughout: smoothing, tops and floods are joins, sums and rounds over them."""
    s, cell = M.SPLIT, max(M.SPLIT["grid_factor"] * gap, M.EPS)
    ends = [f(c).alias(f"{k}{c}") for c in "xy" for k, f in (("l", F.min), ("h", F.max))]
    big = rows.groupBy("root").agg(F.count("*").alias("points"), F.count_if(F.col("score") >= M.SEED_SCORE).alias("seeds"), *ends)
    big = big.where(f"points >= {max(least, 2 * s['min_points'])} AND seeds >= {max(2 * min_seeds, 2 * s['min_points'])}")
    place = lambda v, c: f"CAST(floor(({v} - l{c}) / {cell!r}D) AS BIGINT)"
    big = big.selectExpr("root", "lx", "ly", f"{place('hx', 'x')} + 1 AS nx", f"{place('hy', 'y')} + 1 AS ny").where("nx >= 2 AND ny >= 2")
    pts = cut(rows.join(big, "root").selectExpr("pid", "root", f"{place('x', 'x')} AS gx", f"{place('y', 'y')} AS gy", "nx", "ny", "score", "local_relief", "top_hat"))
    whole = rows.selectExpr("pid", "root", "CAST(0 AS BIGINT) AS part")
    if pts.isEmpty():
        return whole
    sums = [F.count("*").alias("n"), F.avg("score").alias("score"), F.greatest(F.max("top_hat"), F.lit(0.0)).alias("top"), F.avg("local_relief").alias("relief")]
    cells = cut(pts.groupBy(*KEYS, "nx", "ny").agg(*sums))
    cells = cut(cells.join(cells.groupBy("root").count().where("count >= 4"), "root", "left_semi"))
    hills = cut(in_order(smoothed(cut(heights(cells)), s["sigma"]).select(*KEYS, "smooth"), "root", "gy", "gx").withColumnRenamed("place_", "id"))
    tops = cut(markers(hills, max(1.0, s["peak_fraction"] * radius / cell)))
    if tops.isEmpty():
        return whole
    own = hills.join(tops.select("root").distinct(), "root", "left_semi")
    got = regions(own, tops.select("id", "source"), int(radius // cell) + 1).join(tops.select("source", "part").distinct(), "source").hint("merge")
    held = cut(pts.select("pid", *KEYS, "score").join(own.select("id", *KEYS), KEYS).join(got, "id").select("pid", "root", "part", "score"))
    size = held.groupBy("root", "part").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= M.SEED_SCORE).alias("seeds"))
    size = size.withColumn("good", F.expr(f"n >= {max(s['min_points'], 2 * min_seeds)} AND seeds >= {min_seeds}"))
    size = size.withColumn("goods", F.expr("count_if(good) OVER (PARTITION BY root)")).withColumn("all", F.expr("sum(n) OVER (PARTITION BY root)"))  # at most max_markers rows a component
    size = cut(size.where(f"goods >= 2 AND all >= {max(2 * min_seeds, s['min_points'])}").select("root", "part", "good"))
    parts = held.join(size, ["root", "part"]).selectExpr("pid", "CAST(IF(good, part, -1) AS BIGINT) AS part")
    apart = size.selectExpr("root", "true AS apart").distinct()
    return rows.select("pid", "root").join(apart, "root", "left").join(parts, "pid", "left").selectExpr("pid", "root", "CASE WHEN apart THEN coalesce(part, -1L) ELSE 0L END AS part")
