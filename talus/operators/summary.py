"""Grain-size distribution, orientations, histograms, colours, figures' tables, labels' counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions import geometry as G
from talus.session import cut

ACCEPTED = "fitok AND aqualityok AND coalesce(sizecapok, true)"


def accepted(models: DataFrame) -> DataFrame:
    return models.where(ACCEPTED)


def edges(models: DataFrame) -> DataFrame:
    """(what, i, lin, log): bin edges for diameter, volume and area; ceil(sqrt(m)) edges, two at least."""
    a = accepted(models)
    b = a.agg(
        F.count("*").alias("m"),
        F.min(F.expr("2 * r[2]")).alias("dlo"),
        F.max(F.expr("2 * r[0]")).alias("dhi"),
        F.min("v").alias("vlo"),
        F.max("v").alias("vhi"),
        F.min("a").alias("alo"),
        F.max("a").alias("ahi"),
    ).where("m > 0")
    b = b.selectExpr(
        "greatest(2, CAST(ceil(sqrt(m)) AS INT)) AS nbin",
        "inline(array(struct('diameter' AS what, greatest(dlo, 1e-6) AS lo, dhi AS hi), struct('volume' AS what, greatest(vlo, 1e-9) AS lo, vhi AS hi), struct('area' AS what, greatest(alo, 1e-9) AS lo, ahi AS hi)))",
    )
    b = b.selectExpr("what", "nbin", "lo", "greatest(hi, lo * 1.01e0) AS hi").selectExpr("*", "explode(sequence(0, nbin - 1)) AS i")
    return b.selectExpr("what", "i", "lo + (hi - lo) * i / (nbin - 1) AS lin", "exp(ln(lo) + (ln(hi) - ln(lo)) * i / (nbin - 1)) AS log")


def orientations(models: DataFrame, mode: str = "atan2") -> DataFrame:
    """label with map-view and x-view angles (0 to pi): each axis turned toward the viewer first."""
    m = accepted(models).selectExpr("*", "CASE WHEN axis_map[1] < 0 THEN -1 ELSE 1 END AS sm", "CASE WHEN axis_x[2] < 0 THEN -1 ELSE 1 END AS sx")
    return m.selectExpr(
        "label",
        "c",
        "r",
        f"{G.orientation('sm * axis_map[1]', 'sm * axis_map[0]', mode)} AS angle_map",
        f"{G.orientation('sx * axis_x[1]', 'sx * axis_x[2]', mode)} AS angle_x",
    )


def granulo(models: DataFrame, mode: str = "atan2") -> DataFrame:
    """Export table: one row a grain, numbered in the order of labels; angles in degrees."""
    o = in_order(orientations(models, mode), "label")
    return o.select(
        (F.col("place_") + 1).alias("Ngrain"),
        *[F.col("c")[i].alias(f"{a}c") for i, a in enumerate("XYZ")],
        *[(2 * F.col("r")[i]).alias(n) for i, n in enumerate(("Dmax", "Dmed", "Dmin"))],
        F.degrees("angle_map").alias("angle_Mview"),
        F.degrees("angle_x").alias("angle_Xview"),
    )


def histogram(rows: DataFrame, value: str, lo: float, hi: float, n: int, log: bool = False) -> DataFrame:
    """(bin from 1, n) with the last bin closed; a value outside has no bin."""
    t, a, b = (f"ln({value})", f"ln({lo!r}D)", f"ln({hi!r}D)") if log else (value, f"{lo!r}D", f"{hi!r}D")
    return rows.where(f"{value} BETWEEN {lo!r}D AND {hi!r}D").selectExpr(f"least({n}, 1 + CAST(floor(({t} - {a}) / ({b} - {a}) * {n}) AS INT)) AS bin").groupBy("bin").agg(F.count("*").alias("n"))


def rose(rows: DataFrame, angle: str, n: int = 20, mirrored: bool = False) -> DataFrame:
    """Angles of 0 to pi in n bins; map view is drawn mirrored."""
    a = f"(pi() - {angle})" if mirrored else angle
    return histogram(rows.selectExpr(f"{a} - pi() * floor({a} / pi()) AS angle"), "angle", 0.0, 3.141592653589793, n)


def colour_binary(rows: DataFrame, flag: str, yes: tuple[int, int, int], no: tuple[int, int, int]) -> DataFrame:
    return rows.selectExpr("*", *[f"CAST(CASE WHEN {flag} THEN {y} ELSE {n} END AS SMALLINT) AS {c}" for c, y, n in zip(("red", "green", "blue"), yes, no, strict=True)])


#: Colours of the four public colour maps at equal steps; what lies between is mixed by a rule.
RAMPS = {
    "viridis": ["440154", "472d7b", "3b528b", "2c728e", "21918c", "28ae80", "5ec962", "addc30", "fde725"],
    "plasma": ["0d0887", "4c02a1", "7e03a8", "aa2395", "cc4778", "e66c5c", "f89540", "fdc527", "f0f921"],
    "inferno": ["000004", "210c4a", "57106e", "8a226a", "bc3754", "e45a31", "f98e09", "f9cb35", "fcffa4"],
    "twilight": ["e2d9e2", "9ebbc9", "6785be", "5e43a5", "2f1436", "741e4f", "b25652", "cca389", "e2d9e2"],
}


def ramp(name: str = "viridis") -> list[tuple[int, int, int]]:
    """256 colours."""
    stops = [[int(h[i : i + 2], 16) for i in (0, 2, 4)] for h in RAMPS[name]]
    out = []
    for i in range(256):
        at, part = divmod(i / 255 * (len(stops) - 1), 1)
        a, b = stops[int(at)], stops[min(int(at) + 1, len(stops) - 1)]
        out.append(tuple(round(x + (y - x) * part) for x, y in zip(a, b, strict=True)))
    return out


def colour_ramp(rows: DataFrame, value: str, name: str = "viridis") -> DataFrame:
    """red, green, blue of a value between its least and largest; grey where it is null or not finite."""
    ok = f"{value} IS NOT NULL AND NOT isnan({value}) AND abs({value}) < double('inf')"
    b = F.broadcast(rows.where(ok).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_")))  # one row
    lut = ramp(name)
    at = f"1 + CAST(rint(greatest(0e0, least(255e0, 255 * ({value} - lo_) / CASE WHEN hi_ > lo_ THEN hi_ - lo_ ELSE 1e0 END))) AS INT)"
    arrays = [f"array({', '.join(str(c[i]) for c in lut)})" for i in range(3)]
    return rows.join(b).selectExpr(
        *rows.columns,
        *[f"CAST(CASE WHEN {ok} THEN element_at({a}, {at}) ELSE 96 END AS SMALLINT) AS {c}" for a, c in zip(arrays, ("red", "green", "blue"), strict=True)],
    )


#: The public map of twenty colours, and the grey of points without an instance.
TAB20 = [
    "1f77b4", "aec7e8", "ff7f0e", "ffbb78", "2ca02c", "98df8a", "d62728", "ff9896", "9467bd", "c5b0d5",
    "8c564b", "c49c94", "e377c2", "f7b6d2", "7f7f7f", "c7c7c7", "bcbd22", "dbdb8d", "17becf", "9edae5",
]
NO_INSTANCE = 120


def instance_colours(rows: DataFrame, code: str = "code") -> DataFrame:
    """red, green, blue of instance numbers: twenty colours over the range from 1 to the largest number; grey for 0."""
    top = F.broadcast(rows.agg(F.greatest(F.max(code), F.lit(1)).alias("top_")))  # one row
    at = f"least(20, 1 + CAST(floor(20 * ({code} - 1) / CASE WHEN top_ > 1 THEN CAST(top_ - 1 AS DOUBLE) ELSE 1e0 END) AS INT))"
    channel = lambda k: f"CAST(CASE WHEN {code} > 0 THEN element_at(array({', '.join(str(int(h[2 * k : 2 * k + 2], 16)) for h in TAB20)}), {at}) ELSE {NO_INSTANCE} END AS SMALLINT)"
    return rows.join(top).selectExpr(*rows.columns, *[f"{channel(k)} AS {c}" for k, c in enumerate(("red", "green", "blue"))])


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """rows with place_, from 0, in the order of the columns: counted by range over parts of the sorted table, so no window runs over the whole of it."""
    dealt = cut(rows.repartitionByRange(*by).withColumn("part_", F.spark_partition_id()))
    sizes = dealt.groupBy("part_").agg(F.count("*").alias("m"))
    before = sizes.selectExpr("part_", "sum(m) OVER (ORDER BY part_) - m AS before_")  # one row a partition
    place = F.expr(f"before_ + row_number() OVER (PARTITION BY part_ ORDER BY {', '.join(by)}) - 1")
    return dealt.join(F.broadcast(before), "part_").withColumn("place_", place).select(*rows.columns, "place_")


def stride_sample(rows: DataFrame, most: int = 25_000) -> DataFrame:
    """Every n-th point in the order of ids, n so that about ``most`` stay, for a figure."""
    n = max(rows.count() // most, 1)
    return rows if n == 1 else in_order(rows, "pid").where(f"place_ % {n} = 0").drop("place_")


def display_sample(rows: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """Labelled points first, then a seeded draw without replacement."""
    return rows.orderBy(F.col("label") == 0, F.xxhash64("pid", F.lit(seed))).limit(most)


def placed(rows: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """rows with place, 0 to their number less one, in the order of a seeded hash of their ids (which need not be dense); and their number.

    Places are dealt by range over buckets of the hash: bucket sizes come first, so no window runs over the whole table."""
    n = 1 << 12
    keyed = rows.withColumn("h_", F.xxhash64("pid", F.lit(seed))).withColumn("b_", F.pmod("h_", F.lit(n)).cast("int"))
    sizes = keyed.groupBy("b_").agg(F.count("*").alias("m"))
    before = sizes.selectExpr("b_", "sum(m) OVER (ORDER BY b_) - m AS before")  # one row a bucket: 4,096 at most
    out = keyed.join(F.broadcast(before), "b_").withColumn("place", F.expr("before + row_number() OVER (PARTITION BY b_ ORDER BY h_, pid) - 1"))
    return out.select(*rows.columns, "place"), sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]


def bootstrap_sample(rows: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """min(``most``, rows) draws with replacement. A draw is a place in the order of a seeded hash."""
    own, total = placed(rows, seed)
    draws = rows.sparkSession.range(min(most, total)).selectExpr(f"pmod(xxhash64(id, {seed}), {max(total, 1)}L) AS place")
    return own.join(draws, "place").select(rows.columns)


def elongation(models: DataFrame) -> DataFrame:
    """1 - shortest / longest radius and log10 of the volume of each model (radii longest first)."""
    return models.selectExpr("label", "1 - r[2] / greatest(r[0], 1e-12) AS elongation", "log10(greatest(v, 1e-12)) AS log_volume")


def largest(models: DataFrame, value: str, most: int = 30) -> DataFrame:
    """The models of the largest values, ties to the smaller label."""
    return models.orderBy(F.expr(value).desc(), "label").limit(most)


def quantiles(rows: DataFrame, value: str, shares: list[float], *by: str) -> DataFrame:
    """(by, q): exact quantiles of each group, between two values by their distance. Null and NaN are left out; a group without a value has no row.

    Equal values are counted first, then dealt out by range of (group, value), so that neither a large group nor a frequent value is one task's; sums over the parts
    give every value its places, and those that a share asks for are picked."""
    names = [f"by{i}_" for i in range(len(by))]
    key = f"struct({', '.join(f'{c} AS {n}' for c, n in zip(by, names, strict=True)) or '0 AS all_'}) AS k_"
    some = rows.where(f"{value} IS NOT NULL AND NOT isnan({value})").selectExpr(key, f"CAST({value} AS DOUBLE) AS v_").groupBy("k_", "v_").agg(F.count("*").alias("n_"))
    dealt = cut(some.repartitionByRange("k_", "v_").withColumn("part_", F.spark_partition_id()))
    sizes = dealt.groupBy("k_", "part_").agg(F.sum("n_").alias("m_"))
    sizes = sizes.selectExpr("k_", "part_", "sum(m_) OVER (PARTITION BY k_ ORDER BY part_) - m_ AS before_", "sum(m_) OVER (PARTITION BY k_) AS total_")
    held = dealt.join(sizes, ["k_", "part_"]).selectExpr("k_", "v_", "n_", "total_ - 1 AS last_", "before_ + sum(n_) OVER (PARTITION BY k_, part_ ORDER BY v_) AS end_")
    pick = lambda at: f"max(CASE WHEN end_ > {at} AND end_ - n_ <= {at} THEN v_ END)"
    both = [F.expr(pick(f"{f}({s!r}D * last_)")).alias(f"{f}{i}_") for i, s in enumerate(shares) for f in ("floor", "ceil")]
    found = held.groupBy("k_").agg(F.max("last_").alias("last_"), *both)
    q = ", ".join(f"CASE WHEN floor{i}_ = ceil{i}_ THEN floor{i}_ ELSE floor{i}_ + (ceil{i}_ - floor{i}_) * ({s!r}D * last_ - floor({s!r}D * last_)) END" for i, s in enumerate(shares))
    return found.selectExpr(*[f"k_.{n} AS {c}" for c, n in zip(by, names, strict=True)], f"array({q}) AS q")


def array_quantile(values: str, share: float) -> str:
    """SQL: the quantile of a sorted array, which must be small."""
    at = f"{share!r}D * (size({values}) - 1)"
    low, high = (f"element_at({values}, CAST({f}({at}) AS INT) + 1)" for f in ("floor", "ceil"))
    return f"CASE WHEN size({values}) > 0 THEN {low} + ({high} - {low}) * ({at} - floor({at})) END"


def exact_quantile(rows: DataFrame, value: str, share: float, keep: int = 200_000) -> float | None:
    """The quantile of a whole table, between two values by their distance (null and NaN are left out); None if there is no value.

    Bounds that an approximate quantile suggests are narrowed until no more than ``keep`` values lie between them, with counts at every step,
    so the result is exact and no task gets all values."""
    t = rows.selectExpr(f"CAST({value} AS DOUBLE) AS v").where("v IS NOT NULL AND NOT isnan(v)")
    n = t.count()
    if not n:
        return None
    at = share * (n - 1)
    k, below, inside, m, width = int(at), 0, t, n, 0.02
    first = last = None
    while m > keep and first is None:
        s = (k - below) / max(1, m - 1)
        lo, hi = inside.agg(F.expr(f"approx_percentile(v, array({max(0.0, s - width)!r}, {min(1.0, s + width)!r}), 10000)")).first()[0]
        v = F.col("v")
        counts = inside.agg(F.count_if(v < lo), F.count_if(v == lo), F.count_if((v > lo) & (v < hi)), F.count_if((v == hi) & (v > lo))).first()
        c = np.cumsum([below, *counts]).tolist()
        if k < c[1] or k >= c[4]:
            width *= 2
        elif c[2] <= k < c[3]:
            inside, below, m = inside.where((v > lo) & (v < hi)), c[2], counts[2]
        else:  # a value that is there often
            first, end = (lo, c[2]) if k < c[2] else (hi, c[4])
            last = first if k + 1 < end else None
    if first is None:
        values = np.sort(inside.toArrow().column("v").to_numpy())  # keep values at most
        first = float(values[k - below])
        last = float(values[k + 1 - below]) if k + 1 - below < m else None
    if last is None:
        last = t.where(F.col("v") > first).agg(F.min("v")).first()[0]
    return first if last is None else first + (last - first) * (at - k)


def box_edges(models: DataFrame, most: int = 30) -> DataFrame:
    """(label, edge, from corner, to corner) of the largest boxes: the table a figure draws."""
    pairs = [(a, b) for a in range(8) for b in range(a + 1, 8) if (a ^ b) in (1, 2, 4)]
    top = largest(models, "extents[0] * extents[1] * extents[2]", most)
    each = ", ".join(f"struct({i} AS edge, slice(corners, {3 * a + 1}, 3) AS p, slice(corners, {3 * b + 1}, 3) AS q)" for i, (a, b) in enumerate(pairs))
    return top.selectExpr("label", f"inline(array({each}))")


def ellipsoid_mesh(models: DataFrame, around: int = 24, down: int = 12) -> DataFrame:
    """(label, i, j, x, y, z): mesh corners of accepted ellipsoids, largest first in a figure."""
    m = accepted(models).selectExpr("label", "c", "r", "rot", f"explode(sequence(0, {around - 1})) AS i").selectExpr("*", f"explode(sequence(0, {down - 1})) AS j")
    m = m.selectExpr("*", f"2 * pi() * i / {around - 1} AS u", f"pi() * j / {down - 1} AS t").selectExpr(
        "*",
        "r[0] * cos(u) * sin(t) AS a",
        "r[1] * sin(u) * sin(t) AS b",
        "r[2] * cos(t) AS d",
    )
    return m.selectExpr("label", "i", "j", *[f"c[{k}] + rot[{3 * k}] * a + rot[{3 * k + 1}] * b + rot[{3 * k + 2}] * d AS {n}" for k, n in enumerate("xyz")])


def sphere_points(spark, n: int) -> DataFrame:
    """n points spread over the unit sphere by the golden angle."""
    return spark.range(n).selectExpr(
        "id",
        f"acos(1 - 2 * (id + 0.5e0) / {n}) AS t",
        "pi() * (1 + sqrt(5e0)) * id AS u",
    ).selectExpr("id", "cos(u) * sin(t) AS x", "sin(u) * sin(t) AS y", "cos(t) AS z")


#: Step of the density's grid and reach of its kernel, in kernel widths.
DENSITY_STEP, DENSITY_REACH = 0.05, 6.0


def _smoothed(axis: str):
    """A grid (i, j, w) convolved with the kernel along one axis, a line of cells at a time; cells out of reach of all others stay out."""
    n, spread = round(DENSITY_REACH / DENSITY_STEP), 1 - DENSITY_STEP**2 / 3  # what dealing to cells and reading between them spreads, the kernel lacks
    kernel = np.exp(-0.5 * (np.arange(-n, n + 1) * DENSITY_STEP) ** 2 / spread) / np.sqrt(2 * np.pi * spread)
    other = "j" if axis == "i" else "i"

    def run(t: pa.Table) -> pa.Table:
        at, w = t.column(axis).to_numpy(), t.column("w").to_numpy()
        low = int(at.min())
        line, full = np.zeros(int(at.max()) - low + 1), np.zeros(int(at.max()) - low + 1)
        np.add.at(line, at - low, w)
        full[at - low] = 1
        near = np.flatnonzero(np.convolve(full, np.ones(2 * n + 1)) > 0.5)
        return pa.table({axis: near + low - n, other: np.full(len(near), t.column(other)[0].as_py()), "w": np.convolve(line, kernel)[near]}).select(["i", "j", "w"])

    return run


def density(points: DataFrame, x: str = "tx", y: str = "ty") -> DataFrame:
    """points (pid, x, y) with density: the Gaussian kernel estimate of all points at each, its width by Scott's rule from their covariance; 1 where that is
    singular, null where a coordinate is.

    Points are dealt to the four cells around them on a grid over coordinates in which the kernel is round; the counts are smoothed along one axis, then along the
    other, and read between the cells. The work grows with points and cells, not with pairs."""
    points = cut(points)  # read four times
    ok = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in (x, y))
    s = points.where(ok).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("xx"), F.covar_samp(x, y).alias("xy"), F.var_samp(y).alias("yy")).first()
    flat = s["n"] < 3 or not s["xx"] > 0 or not s["xx"] * s["yy"] - s["xy"] ** 2 > 1e-14 * s["xx"] * s["yy"]
    if flat:
        return points.selectExpr("*", f"CASE WHEN {ok} THEN 1e0 END AS density")
    root = np.linalg.cholesky(np.array([[s["xx"], s["xy"]], [s["xy"], s["yy"]]]) * s["n"] ** (-1 / 3))
    (a, _), (b, c) = np.linalg.inv(root) / DENSITY_STEP
    at = points.where(ok).selectExpr("pid", f"{float(a)!r}D * ({x} - ({s['mx']!r}D)) AS u", f"({float(b)!r}D) * ({x} - ({s['mx']!r}D)) + {float(c)!r}D * ({y} - ({s['my']!r}D)) AS v")
    at = at.selectExpr("pid", "CAST(floor(u) AS BIGINT) AS i", "CAST(floor(v) AS BIGINT) AS j", "u - floor(u) AS a", "v - floor(v) AS b")
    corner = lambda p, q: f"struct(i + {p} AS i, j + {q} AS j, {'a' if p else '(1 - a)'} * {'b' if q else '(1 - b)'} AS w)"
    dealt = at.selectExpr("pid", f"inline(array({corner(0, 0)}, {corner(0, 1)}, {corner(1, 0)}, {corner(1, 1)}))")
    grid = dealt.groupBy("i", "j").agg(F.sum("w").alias("w"))
    for axis, other in (("i", "j"), ("j", "i")):
        grid = grid.groupBy(other).applyInArrow(_smoothed(axis), "i long, j long, w double")
    read = dealt.join(grid.withColumnRenamed("w", "height"), ["i", "j"]).groupBy("pid").agg((F.sum(F.col("w") * F.col("height")) / float(s["n"] * root[0, 0] * root[1, 1])).alias("density"))
    return points.join(read, "pid", "left")
