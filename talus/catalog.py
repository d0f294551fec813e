"""Every query of the engine with the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus import model as M
from talus.functions import geometry as G
from talus.operators import blocks, fit, labels, roughness, spatial, summary
from talus.operators import surface as S
from talus.sources import files
from talus.sources import tables as T

K, MERGE_ANGLE, CLEAN_ANGLE, FACTOR = 20, 60.0, 60.0, 2.5
RADIUS, CELL = 0.035, 20.0
ZONES = {
    "zones": {"block": [[2.0, 1.0], [30.0, 5.0], [40.0, 60.0], [10.0, 80.0]], "non-block": [[20.0, 40.0], [49.0, 40.0], [49.0, 90.0], [35.0, 55.0], [20.0, 90.0]]},
    "mode_order": ["block", "non-block"],
}
INSTANCES = {"instances": [{"id": 1, "vertices_xy": [[1, 1], [20, 1], [20, 50]]}, {"id": 2, "vertices_xy": [[10, 10], [30, 10], [30, 70], [10, 70]]}, {"vertices_xy": [[25, 5], [45, 95], [48, 5]]}]}

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            O[name] = " ".join(sql.split())
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.selectExpr(*[f"{G.r(c, digits)} AS {c}" if c in columns else f"`{c}`" for c in df.columns])


r = G.r
# SQL views that the checks share

PTS = "pts AS (SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label AS grp FROM embeddings)"
EVT = "evt AS (SELECT event_id AS pid, (epoch_us(ts) / 3.6e9) % 720 AS x, CAST(user_id AS DOUBLE) AS y, value AS z FROM events)"
LI = "li AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, 100 * l_discount AS z, l_returnflag AS grp FROM lineitem)"
NBR = f"{PTS}, nbr AS (SELECT * FROM (SELECT pid, nid, dist, CAST(row_number() OVER (PARTITION BY pid ORDER BY dist, nid) AS INTEGER) AS rank FROM (SELECT a.pid, b.pid AS nid, {G.distance()} AS dist FROM pts a JOIN pts b ON a.pid <> b.pid)) WHERE rank <= {K})"
COORD = "co AS (SELECT n.pid, n.rank, p.x, p.y, p.z FROM nbr n JOIN pts p ON n.nid = p.pid)"


# The checks' geometry is written apart from the engine's: roots of the characteristic polynomial by Newton's steps from outside, vectors from
# the adjugate matrix, angles by the arc cosine, polygons by winding numbers.


def _vector(name: str, root: str) -> str:
    """Columns {name}x, {name}y, {name}z: the unit eigenvector of a root, from the column of adj(C - root I) with the largest diagonal."""
    a, b, c = (f"(c{d} - {root})" for d in ("xx", "yy", "zz"))
    adj = [
        [f"({b} * {c} - cyz * cyz)", f"(cxz * cyz - cxy * {c})", f"(cxy * cyz - cxz * {b})"],
        [f"(cxz * cyz - cxy * {c})", f"({a} * {c} - cxz * cxz)", f"(cxy * cxz - {a} * cyz)"],
        [f"(cxy * cyz - cxz * {b})", f"(cxy * cxz - {a} * cyz)", f"({a} * {b} - cxy * cxy)"],
    ]
    d = [f"abs({adj[i][i]})" for i in range(3)]
    pick = lambda i: f"CASE WHEN {d[0]} >= {d[1]} AND {d[0]} >= {d[2]} THEN {adj[0][i]} WHEN {d[1]} >= {d[2]} THEN {adj[1][i]} ELSE {adj[2][i]} END"
    return ", ".join(f"{pick(i)} AS {name}{x}_" for i, x in enumerate("xyz"))


def eig(rows: str, key: str, ddof: int = 1, normals: bool = False, major: bool = False) -> str:
    """DuckDB subquery: moments, covariance, l0 <= l1 <= l2 and, if asked, the upward normal (nx, ny, nz) and the major axis (mx, my, mz)."""
    cov = ", ".join(f"(s{p} - s{p[0]} * s{p[1]} / n) / nullif(n - {ddof}, 0) AS c{p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz"))
    sums = ", ".join(["count(*) AS n", *(f"sum({c}) AS s{c}" for c in "xyz"), *(f"sum({p[0]} * {p[1]}) AS s{p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz"))])
    t = f"(SELECT *, {cov} FROM (SELECT {key + ', ' if key else ''}{sums} FROM {rows}{' GROUP BY ' + key if key else ''}))"
    t = f"(SELECT *, cxx + cyy + czz AS tr, cxx * cyy - cxy * cxy + cxx * czz - cxz * cxz + cyy * czz - cyz * cyz AS mi, cxx * (cyy * czz - cyz * cyz) - cxy * (cxy * czz - cyz * cxz) + cxz * (cxy * cyz - cyy * cxz) AS de FROM {t})"
    step = "CASE WHEN abs(3 * x * x - 2 * tr * x + mi) > 1e-300 THEN x - (((x - tr) * x + mi) * x - de) / (3 * x * x - 2 * tr * x + mi) ELSE x END"
    newton = lambda start: f"list_reduce(range(1, 91)::DOUBLE[], lambda x, i: {step}, CAST({start} AS DOUBLE))"
    t = f"(SELECT *, {newton('tr')} AS l2, {newton('0')} AS l0 FROM {t})"
    t = f"(SELECT *, tr - l0 - l2 AS l1 FROM {t})"
    for name, root, on in (("n", "l0", normals), ("m", "l2", major)):
        if on:
            size = f"greatest(sqrt({name}x_ * {name}x_ + {name}y_ * {name}y_ + {name}z_ * {name}z_), 1e-300)"
            t = f"(SELECT *, {', '.join(f'CASE WHEN {name}z_ < 0 THEN -1 ELSE 1 END * {name}{x}_ / {size} AS {name}{x}' for x in 'xyz')} FROM (SELECT *, {_vector(name, root)} FROM {t}))"
    return t


def arc(a: str, b: str) -> str:
    """Degrees between the unit normals of two rows."""
    return f"degrees(acos(greatest(-1, least(1, {a}.nx * {b}.nx + {a}.ny * {b}.ny + {a}.nz * {b}.nz))))"


def wound(corners) -> str:
    """Whether x, y is inside: the polygon winds round it."""
    turns = []
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]], strict=True):
        left = f"(({x2 - x1}) * (y - ({y1})) - (x - ({x1})) * ({y2 - y1}))"
        turns.append(f"CASE WHEN {y1} <= y AND {y2} > y AND {left} > 0 THEN 1 WHEN {y1} > y AND {y2} <= y AND {left} < 0 THEN -1 ELSE 0 END")
    return f"({' + '.join(turns)}) <> 0"


RECV = f"""{NBR}, sl AS (SELECT n.pid, n.nid, n.rank, (a.z - b.z) / greatest({G.distance()}, 1e-12) AS slope FROM nbr n JOIN pts a ON a.pid = n.pid JOIN pts b ON b.pid = n.nid),
  recv AS (SELECT pid, CASE WHEN min(slope) > 0 THEN pid ELSE arg_min(nid, (slope, rank)) END AS parent FROM sl GROUP BY pid)"""
LABELS = f"""{RECV}, walk AS (SELECT pid, parent, 0 AS depth FROM recv UNION ALL SELECT w.pid, n.parent, w.depth + 1 FROM walk w JOIN recv n ON n.pid = w.parent WHERE n.parent <> w.parent AND w.depth < 60),
  lab AS (SELECT w.pid, max(CASE WHEN n.pid = n.parent THEN n.pid END) AS label FROM walk w JOIN recv n ON n.pid = w.parent GROUP BY w.pid),
  don AS (SELECT parent AS pid, count(*) AS donors FROM recv WHERE pid <> parent GROUP BY parent),
  seg AS (SELECT l.pid, l.label, coalesce(d.donors, 0) AS donors FROM lab l LEFT JOIN don d ON d.pid = l.pid)"""
BORDER = f"""{LABELS}, {COORD}, nor AS (SELECT pid, nx, ny, nz FROM {eig('co', 'pid', normals=True)} AS e),
  nl AS (SELECT n.pid, n.nid, a.label AS li, b.label AS lj, a.donors FROM nbr n JOIN seg a ON a.pid = n.pid JOIN seg b ON b.pid = n.nid),
  bor AS (SELECT pid FROM nl WHERE li IS NOT NULL AND donors = 0 GROUP BY pid HAVING {K} - sum(CASE WHEN li = lj THEN 1 ELSE 0 END) >= {K / 4}),
  ang AS (SELECT li, lj, avg({arc('a', 'b')}) AS mean_angle FROM nl JOIN bor ON bor.pid = nl.pid JOIN nor a ON a.pid = nl.pid JOIN nor b ON b.pid = nl.nid WHERE lj IS NOT NULL GROUP BY li, lj)"""
EDGES = f"""{BORDER}, rad AS (SELECT s.label, sqrt(sum(pi() * n.dist * n.dist) / pi()) AS radius FROM nbr n JOIN seg s ON s.pid = n.pid WHERE n.rank = 1 AND s.label IS NOT NULL GROUP BY s.label),
  me AS (SELECT DISTINCT l.li, l.lj FROM nl l JOIN rad a ON a.label = l.li JOIN rad b ON b.label = l.lj JOIN pts p ON p.pid = l.li JOIN pts q ON q.pid = l.lj LEFT JOIN ang g ON g.li = l.li AND g.lj = l.lj
    WHERE l.li <> l.lj AND {FACTOR * M.RADIUS_CORRECTION!r} * (a.radius + b.radius) > {G.distance('p', 'q')} AND coalesce(g.mean_angle, 0) <= {MERGE_ANGLE})"""
MERGED = f"""{EDGES}, both_ AS (SELECT li AS a, lj AS b FROM me UNION SELECT lj, li FROM me), reach AS (SELECT DISTINCT label AS a, label AS b FROM seg WHERE label IS NOT NULL UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON both_.a = reach.b),
  comp AS (SELECT a AS label, min(b) AS root FROM reach GROUP BY a)"""


class Cloud:
    """The vector cloud with what the segmentation queries build on it, each step once."""

    def __init__(self, spark, d):
        self.pts = T.vectors(spark, d)
        self.nbr = S.cut(spatial.knn(self.pts, K))

    def normals(self):
        return S.normals(self.nbr, self.pts)

    def labels(self):
        return S.cut(S.watershed(S.receivers(self.nbr, self.pts)))

    def edges(self, seg):
        return S.merge_edges(self.pts, self.nbr, seg, self.normals(), K, FACTOR, MERGE_ANGLE)


@query("normalise_cloud", f"WITH {PTS} SELECT pid, {r('x - min(x) OVER ()')} AS x, {r('y - min(y) OVER ()')} AS y, {r('z - min(z) OVER ()')} AS z FROM pts")
def _(spark, d):
    return rounded(S.normalise(T.vectors(spark, d).select("pid", "x", "y", "z")), "x", "y", "z")


@query(
    "voxel_downsample",
    f"WITH {LI} SELECT CAST(floor(x / 5.0) AS BIGINT) AS cx, CAST(floor(y / 5.0) AS BIGINT) AS cy, CAST(floor(z / 5.0) AS BIGINT) AS cz, count(*) AS n, {r('avg(x)')} AS x, {r('avg(y)')} AS y, {r('avg(z)')} AS z FROM li GROUP BY 1, 2, 3",
)
def _(spark, d):
    return rounded(S.voxels(T.lines(spark, d), 5.0, None), "x", "y", "z")


@query("cloud_span_cap", f"WITH {LI} SELECT {r('0.15 * greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z))')} AS cap FROM li")
def _(spark, d):
    return rounded(S.span_cap(T.lines(spark, d), 0.15), "cap")


@query("knn_graph", f"WITH {NBR} SELECT pid, rank, nid, {r('dist', 6)} AS dist FROM nbr")
def _(spark, d):
    return rounded(spatial.knn(T.vectors(spark, d), K), "dist", digits=6).select("pid", "rank", "nid", "dist")


@query("spacing_median", f"WITH {NBR} SELECT {r('quantile_cont(dist, 0.5)', 6)} AS spacing FROM nbr WHERE rank = 1")
def _(spark, d):
    found = spark.createDataFrame([(S.spacing(Cloud(spark, d).nbr),)], "spacing double")
    return rounded(found, "spacing", digits=6)


@query("nearest_surface", f"WITH {NBR} SELECT pid, {r('pi() * dist * dist', 6)} AS surface FROM nbr WHERE rank = 1")
def _(spark, d):
    return rounded(S.nearest_area(Cloud(spark, d).nbr), "surface", digits=6)


@query(
    "statistical_denoise",
    f"WITH {NBR}, m AS (SELECT pid, avg(dist) AS md FROM nbr WHERE rank <= 4 GROUP BY pid), t AS (SELECT avg(md) + stddev_pop(md) AS top FROM m) SELECT m.pid, {r('m.md', 6)} AS mean_dist FROM m, t WHERE m.md <= t.top",
)
def _(spark, d):
    c = Cloud(spark, d)
    return rounded(S.denoise(c.pts, c.nbr, 4, 1.0).select("pid", "mean_dist"), "mean_dist", digits=6)


@query(
    "event_denoise",
    f"WITH {EVT}, m AS (SELECT a.pid, list_avg(min({G.distance()}, 4)) AS md FROM evt a JOIN evt b ON a.pid <> b.pid GROUP BY a.pid), t AS (SELECT avg(md) + stddev_pop(md) AS top FROM m) SELECT m.pid, {r('m.md', 6)} AS mean_dist FROM m, t WHERE m.md <= t.top",
)
def _(spark, d):
    c = T.events(spark, d)
    return rounded(S.denoise(c, spatial.knn(c, 4), 4, 1.0).select("pid", "mean_dist"), "mean_dist", digits=6)


_TERMS = ["1e0", "u", "v", "u * u", "u * v", "v * v"]


def solved(n: int, rows: str) -> str:
    """DuckDB subquery: c0 ... of the symmetric system a{i}{j} (i <= j), b{i} in one row, by elimination."""
    names = [f"m{i}{j}" for i in range(n) for j in range(n + 1)]
    first = ", ".join(f"{f'a{min(i, j)}{max(i, j)}' if j < n else f'b{i}'} AS m{i}{j}" for i in range(n) for j in range(n + 1))
    t = f"(SELECT {first} FROM {rows})"
    for k in range(n):
        step = ", ".join(f"{f'm{k}{j} / m{k}{k}' if i == k else f'm{i}{j} - m{i}{k} * m{k}{j} / m{k}{k}'} AS m{i}{j}" for i in range(n) for j in range(n + 1))
        t = f"(SELECT {step} FROM {t})"
    assert len(names) == n * (n + 1)
    return f"(SELECT {', '.join(f'm{i}{n} AS c{i}' for i in range(n))} FROM {t})"


_SUMS6 = ", ".join([f"sum({_TERMS[i]} * {_TERMS[j]}) AS a{i}{j}" for i in range(6) for j in range(i, 6)] + [f"sum({_TERMS[i]} * z) AS b{i}" for i in range(6)])


@query(
    "quadratic_detrend",
    f"WITH {EVT}, s AS (SELECT avg(x) AS mx, stddev_pop(x) AS dx, avg(y) AS my, stddev_pop(y) AS dy FROM evt), w AS (SELECT pid, x, y, z, (x - mx) / dx AS u, (y - my) / dy AS v FROM evt, s), q AS (SELECT {_SUMS6} FROM w), k AS (SELECT * FROM {solved(6, 'q')}) SELECT pid, {r('x')} AS x, y, {r('z - (' + ' + '.join(f'c{i} * {t}' for i, t in enumerate(_TERMS)) + ')')} AS z FROM w, k",
)
def _(spark, d):
    return rounded(S.detrend(T.events(spark, d))[0], "x", "z")


@query("detrend_normal_equations", f"WITH {EVT}, w AS (SELECT x / 720 AS u, y / (SELECT max(y) FROM evt) AS v, z / (SELECT max(z) FROM evt) AS z FROM evt), q AS (SELECT {_SUMS6} FROM w), k AS (SELECT * FROM {solved(6, 'q')}) SELECT unnest(range(6)) AS term, round(unnest([{', '.join(f'c{i}' for i in range(6))}]), 7) + 0 AS coefficient FROM k")
def _(spark, d):
    """The surface itself: the coefficients of its six terms."""
    c = S.detrend(unit_events(spark, d).selectExpr("pid", "x", "y", "z"))[1]
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(c)], "term long, coefficient double"), "coefficient", digits=7)


@query("rotate_horizontal", f"""WITH {PTS}, n AS (SELECT nx, ny, nz, sx / n AS cx, sy / n AS cy, sz / n AS cz FROM {eig('pts', '', 0, normals=True)} AS e),
  q AS (SELECT pid, x - cx AS x, y - cy AS y, z - cz AS z, nx, ny, nz, cx, cy, cz FROM pts, n), w AS (SELECT *, -nx * z AS ax, -ny * z AS ay, nx * x + ny * y AS az FROM q)
  SELECT pid, {r('cx + x + ax - nx * az / (1 + nz)')} AS x, {r('cy + y + ay - ny * az / (1 + nz)')} AS y, {r('cz + z + az + (nx * ax + ny * ay) / (1 + nz)')} AS z FROM w""")
def _(spark, d):
    return rounded(S.rotate_horizontal(T.vectors(spark, d).select("pid", "x", "y", "z")), "x", "y", "z")


@query(
    "plane_fit_coeffs",
    f"WITH {LI} SELECT n, {r('-nx / nz')} AS a, {r('-ny / nz')} AS b, {r('(sz + nx / nz * sx + ny / nz * sy) / n')} AS c FROM {eig('li', '', 0, normals=True)} AS t",
)
def _(spark, d):
    p = S.plane(T.lines(spark, d)).selectExpr("n", "-nx / nz AS a", "-ny / nz AS b", "(sz + nx / nz * sx + ny / nz * sy) / n AS c")
    return rounded(p, "a", "b", "c")


@query("point_covariance_eigs", f"WITH {NBR}, {COORD} SELECT pid, {r('l0')} AS l0, {r('l1')} AS l1, {r('l2')} AS l2 FROM {eig('co', 'pid')} AS e")
def _(spark, d):
    c = Cloud(spark, d)
    return rounded(S.eigen_table(S.neighbour_coordinates(c.nbr, c.pts)).select("pid", "l0", "l1", "l2"), "l0", "l1", "l2")


@query("point_normals", f"WITH {NBR}, {COORD} SELECT pid, {r('nx')} AS nx, {r('ny')} AS ny, {r('nz')} AS nz FROM {eig('co', 'pid', normals=True)} AS e")
def _(spark, d):
    return rounded(Cloud(spark, d).normals(), "nx", "ny", "nz")


_SHAPES = " UNION ALL ".join(f"SELECT pid, {s} AS s, greatest(l0, 1e-12) AS l0, greatest(l1, 1e-12) AS l1, greatest(l2, 1e-12) AS l2 FROM {eig(f'(SELECT * FROM co WHERE rank <= {s}) AS c{s}', 'pid')} AS e{s}" for s in S.scales(K))
FEATS = f"""{NBR}, {COORD}, sh AS ({_SHAPES}), zz AS (SELECT pid, quantile_cont(z, 0.15) AS lo, quantile_cont(z, 0.85) AS hi, stddev_pop(z) AS sd FROM co GROUP BY pid),
  sc AS (SELECT pid, max(CASE WHEN s = {K} THEN l0 / l2 END) AS scattering, avg(l0 / (l0 + l1 + l2)) AS curvature_mean, max(l0 / (l0 + l1 + l2)) AS curvature_max, avg((l1 - l0) / l2) AS planarity_mean FROM sh GROUP BY pid),
  ft AS (SELECT p.pid, p.z - zz.lo AS top_hat, zz.hi - zz.lo AS local_relief, zz.sd AS local_zstd, scattering, curvature_mean, curvature_max, planarity_mean FROM pts p JOIN zz ON zz.pid = p.pid JOIN sc ON sc.pid = p.pid)"""
_STD = " + ".join(f"({w!r}) * ({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END" for w, c in zip(M.BLOCK_WEIGHTS, M.BLOCK_FEATURES, strict=True))


@query("local_surface_features", f"WITH {FEATS} SELECT pid, {', '.join(f'{r(c)} AS {c}' for c in M.BLOCK_FEATURES)} FROM ft")
def _(spark, d):
    c = Cloud(spark, d)
    return rounded(S.surface_features(c.nbr, c.pts, K), *M.BLOCK_FEATURES)


@query(
    "blockiness_score",
    f"WITH {FEATS} SELECT pid, {r('1 / (1 + exp(-greatest(-50, least(50, t))))')} AS score FROM (SELECT pid, {_STD} + ({M.BLOCK_BIAS!r}) AS t FROM ft)",
)
def _(spark, d):
    c = Cloud(spark, d)
    return rounded(S.block_score(S.surface_features(c.nbr, c.pts, K)).select("pid", "score"), "score")


_EVT3 = f"{EVT}, ev AS (SELECT pid, x / 720 AS x, y / (SELECT max(y) FROM evt) AS y, z / (SELECT max(z) FROM evt) AS z FROM evt)"


def unit_events(spark, d):
    e = T.events(spark, d)
    top = F.broadcast(e.agg(F.max("y").alias("my"), F.max("z").alias("mz")))  # one row
    return e.join(top).selectExpr("pid", "x / 720 AS x", "y / my AS y", "z / mz AS z")


@query(
    "radius_pairs",
    f"WITH {_EVT3} SELECT a.pid, b.pid AS nid, {r(G.distance(), 6)} AS dist FROM ev a JOIN ev b ON a.pid < b.pid AND abs(a.x - b.x) <= {RADIUS} AND abs(a.y - b.y) <= {RADIUS} WHERE {G.distance()} <= {RADIUS}",
)
def _(spark, d):
    return rounded(spatial.radius_pairs(unit_events(spark, d), RADIUS), "dist", digits=6)


_COMP = f"{PTS}, ed AS (SELECT a.pid AS a, b.pid AS b FROM pts a JOIN pts b ON a.pid <> b.pid WHERE {G.distance()} <= 0.12), reach AS (SELECT pid AS a, pid AS b FROM pts UNION SELECT reach.a, ed.b FROM reach JOIN ed ON ed.a = reach.b)"


@query("radius_components", f"WITH RECURSIVE {_COMP} SELECT a AS id, min(b) AS root FROM reach GROUP BY a")
def _(spark, d):
    return blocks.radius_components(T.vectors(spark, d), 0.12)


@query("steepest_receiver", f"WITH {RECV} SELECT pid, parent FROM recv")
def _(spark, d):
    c = Cloud(spark, d)
    return S.receivers(c.nbr, c.pts)


@query("watershed_roots", f"WITH RECURSIVE {LABELS} SELECT pid, label, donors FROM seg")
def _(spark, d):
    return Cloud(spark, d).labels()


@query(
    "watershed_sizes",
    f"WITH RECURSIVE {LABELS} SELECT s.label, count(*) AS n, {r('min(p.z)')} AS zmin, {r('max(p.z)')} AS zmax, {r('avg(p.x)')} AS xmean FROM seg s JOIN pts p ON p.pid = s.pid WHERE s.label IS NOT NULL GROUP BY s.label",
)
def _(spark, d):
    c = Cloud(spark, d)
    rows = c.pts.drop("label").join(c.labels().where("label IS NOT NULL"), "pid")
    return rounded(
        rows.groupBy("label").agg(F.count("*").alias("n"), F.min("z").alias("zmin"), F.max("z").alias("zmax"), F.avg("x").alias("xmean")),
        "zmin",
        "zmax",
        "xmean",
    )


@query(
    "label_neighbour_graph",
    f"WITH RECURSIVE {LABELS} SELECT DISTINCT a.label AS li, b.label AS lj FROM nbr n JOIN seg a ON a.pid = n.pid JOIN seg b ON b.pid = n.nid WHERE a.label IS NOT NULL AND b.label IS NOT NULL",
)
def _(spark, d):
    c = Cloud(spark, d)
    return S.label_neighbours(c.nbr, c.labels())


@query("border_angles", f"WITH RECURSIVE {BORDER} SELECT li, lj, {r('mean_angle', 3)} AS mean_angle FROM ang")
def _(spark, d):
    c = Cloud(spark, d)
    return rounded(S.border_angles(c.nbr, c.labels(), c.normals(), K), "mean_angle", digits=3)


@query("merge_edges", f"WITH RECURSIVE {EDGES} SELECT li, lj FROM me")
def _(spark, d):
    c = Cloud(spark, d)
    return c.edges(c.labels())


@query("merge_components", f"WITH RECURSIVE {MERGED} SELECT s.pid, c.root AS label, s.donors FROM seg s LEFT JOIN comp c ON c.label = s.label")
def _(spark, d):
    c = Cloud(spark, d)
    seg = c.labels()
    return S.relabel(seg, c.edges(seg))


_FLAT = f"SELECT label, n, {r('sqrt(greatest(l1, 0e0)) / nullif(sqrt(greatest(l2, 0e0)), 0e0)')} AS r2, {r('sqrt(greatest(l0, 0e0)) / nullif(sqrt(greatest(l2, 0e0)), 0e0)')} AS r3"


@query(
    "flatness_filter",
    f"WITH RECURSIVE {MERGED}, fin AS (SELECT c.root AS label, p.x, p.y, p.z FROM seg s JOIN comp c ON c.label = s.label JOIN pts p ON p.pid = s.pid) {_FLAT} FROM {eig('fin', 'label', 0)} AS e WHERE n >= 5",
)
def _(spark, d):
    c = Cloud(spark, d)
    seg = c.labels()
    return rounded(S.flat_labels(c.pts.drop("label"), S.relabel(seg, c.edges(seg)), 5, 0.1).where("n >= 5").select("label", "n", "r2", "r3"), "r2", "r3")


_CLEAN = f"""{BORDER}, be AS (SELECT li, lj FROM ang WHERE mean_angle > 0 AND mean_angle <= {CLEAN_ANGLE}), both_ AS (SELECT li AS a, lj AS b FROM be UNION SELECT lj, li FROM be),
  reach AS (SELECT DISTINCT label AS a, label AS b FROM seg WHERE label IS NOT NULL UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON both_.a = reach.b), comp AS (SELECT a AS label, min(b) AS root FROM reach GROUP BY a),
  fin AS (SELECT c.root AS label, p.x, p.y, p.z FROM seg s JOIN comp c ON c.label = s.label JOIN pts p ON p.pid = s.pid),
  sh AS (SELECT label, n, sqrt(greatest(l1, 0)) / nullif(sqrt(greatest(l2, 0)), 0) AS r2, sqrt(greatest(l0, 0)) / nullif(sqrt(greatest(l2, 0)), 0) AS r3 FROM {eig('fin', 'label', 0)} AS e)"""


@query(
    "clean_labels",
    f"WITH RECURSIVE {_CLEAN} SELECT s.pid, sh.label, s.donors FROM seg s LEFT JOIN comp c ON c.label = s.label LEFT JOIN sh ON sh.label = c.root AND sh.n >= 5 AND (sh.r3 > 0.1 OR sh.r2 > 0.2)",
)
def _(spark, d):
    c = Cloud(spark, d)
    return S.clean(c.pts.drop("label"), c.nbr, c.labels(), c.normals(), K, CLEAN_ANGLE, 5, 0.1)


_GRID = f"{EVT}, b AS (SELECT min(x) AS lx, min(y) AS ly FROM evt), ras AS (SELECT CAST(floor((x - lx) / {CELL}) AS BIGINT) AS gx, CAST(floor((y - ly) / {CELL}) AS BIGINT) AS gy, min(z) AS value FROM evt, b GROUP BY 1, 2)"


@query("smrf_min_raster", f"WITH {_GRID} SELECT gx, gy, {r('value')} AS value FROM ras")
def _(spark, d):
    return rounded(S.min_raster(T.events(spark, d), CELL), "value")


_NEAR = lambda s, o: f"{o} AS (SELECT a.gx, a.gy, max(b.value) AS value FROM {s} a JOIN {s} b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 GROUP BY a.gx, a.gy)"


@query("smrf_opening", f"WITH {_GRID}, {_NEAR('ras', 'ero').replace('max(', 'min(')}, {_NEAR('ero', 'dil')} SELECT gx, gy, {r('value')} AS value FROM dil")
def _(spark, d):
    return rounded(S.opened(S.min_raster(T.events(spark, d), CELL), 1), "value")


_SQUARE = lambda s, o, r, f: f"{o} AS (SELECT a.gx, a.gy, {f}(b.value) AS value FROM {s} a JOIN {s} b ON abs(a.gx - b.gx) <= {r} AND abs(a.gy - b.gy) <= {r} GROUP BY a.gx, a.gy)"
_STEP = lambda a, b: f"coalesce((coalesce(p.value, t.value) - coalesce(m.value, t.value)) / nullif((CASE WHEN p.value IS NULL THEN 0 ELSE 1 END + CASE WHEN m.value IS NULL THEN 0 ELSE 1 END) * {CELL}, 0), 0) AS d{a} FROM top t LEFT JOIN top p ON p.g{a} = t.g{a} + 1 AND p.g{b} = t.g{b} LEFT JOIN top m ON m.g{a} = t.g{a} - 1 AND m.g{b} = t.g{b}"
_AT = lambda t, o: f"{o} AS (SELECT q.pid, sum(t.value * (CASE WHEN k.i = 0 THEN 1 - (q.fx - q.a) ELSE q.fx - q.a END) * (CASE WHEN k.j = 0 THEN 1 - (q.fy - q.b) ELSE q.fy - q.b END)) AS v FROM q CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j) CROSS JOIN n JOIN {t} t ON t.gx = least(q.a + k.i, nx - 1) AND t.gy = least(q.b + k.j, ny - 1) GROUP BY q.pid)"
_GROUND = f"""{_GRID}, n AS (SELECT CAST(floor((max(x) - min(x)) / {CELL}) AS BIGINT) + 1 AS nx, CAST(floor((max(y) - min(y)) / {CELL}) AS BIGINT) + 1 AS ny FROM evt),
  full_ AS (SELECT i AS gx, j AS gy FROM n, unnest(range(nx)) a(i), unnest(range(ny)) b(j)),
  fil AS (SELECT f.gx, f.gy, arg_min(r.value, ((f.gx - r.gx) * (f.gx - r.gx) + (f.gy - r.gy) * (f.gy - r.gy), r.gx * ny + r.gy)) AS value FROM full_ f, ras r, n GROUP BY f.gx, f.gy),
  {_SQUARE('fil', 'e1', 1, 'min')}, {_SQUARE('e1', 'd1', 1, 'max')}, {_SQUARE('d1', 'e2', 2, 'min')}, {_SQUARE('e2', 'top', 2, 'max')},
  sx AS (SELECT t.gx, t.gy, {_STEP('x', 'y')}), sy AS (SELECT t.gx, t.gy, {_STEP('y', 'x')}), steep AS (SELECT sx.gx, sx.gy, sqrt(dx * dx + dy * dy) AS value FROM sx JOIN sy ON sy.gx = sx.gx AND sy.gy = sx.gy),
  q AS (SELECT pid, z, fx, fy, CAST(floor(fx) AS BIGINT) AS a, CAST(floor(fy) AS BIGINT) AS b FROM (SELECT pid, z, greatest(0, least(nx - 1, (x - lx) / {CELL})) AS fx, greatest(0, least(ny - 1, (y - ly) / {CELL})) AS fy FROM evt, b, n)),
  {_AT('top', 'gh')}, {_AT('steep', 'st')}"""


@query("smrf_filled_slopes", f"WITH {_GROUND} SELECT t.gx, t.gy, {r('t.value')} AS value, {r('s.value')} AS slope FROM top t JOIN steep s ON s.gx = t.gx AND s.gy = t.gy")
def _(spark, d):
    c = T.events(spark, d)
    b = c.agg(*[f(x).alias(k + x) for x in "xy" for f, k in ((F.min, "l"), (F.max, "h"))]).first()
    nx, ny = (int((b["h" + x] - b["l" + x]) // CELL) + 1 for x in "xy")
    top = S.ground_surface(S.fill_raster(S.cut(S.min_raster(c, CELL)), nx, ny), 2)
    return rounded(top.join(S.slopes(top, CELL).withColumnRenamed("value", "slope"), ["gx", "gy"]), "value", "slope")


@query(
    "smrf_nonground",
    f"WITH {_GROUND} SELECT q.pid, {r('gh.v', 9)} AS ground_height, {r('q.z - gh.v', 9)} AS height_above_ground, {r(f'0.35 + 0.75 * st.v * {CELL}', 9)} AS threshold, q.z - gh.v > 0.35 + 0.75 * st.v * {CELL} AS nonground FROM q JOIN gh ON gh.pid = q.pid JOIN st ON st.pid = q.pid",
)
def _(spark, d):
    return rounded(S.nonground(T.events(spark, d), CELL, window=40.0), "ground_height", "height_above_ground", "threshold", digits=9)


@query("bilinear_lookup", f"""WITH {LI}, g AS (SELECT i AS gx, j AS gy, CAST(i * i + 3 * j AS DOUBLE) AS value FROM range(0, 11) a(i), range(0, 21) b(j)),
  p AS (SELECT o_orderkey AS pid, greatest(0e0, least(10e0, (o_orderkey % 1000) / 90e0)) AS fx, greatest(0e0, least(20e0, o_totalprice / 20000)) AS fy FROM orders),
  q AS (SELECT pid, fx, fy, CAST(floor(fx) AS BIGINT) AS a, CAST(floor(fy) AS BIGINT) AS b FROM p)
  SELECT pid, {r('sum(g.value * (CASE WHEN k.i = 0 THEN 1 - (fx - a) ELSE fx - a END) * (CASE WHEN k.j = 0 THEN 1 - (fy - b) ELSE fy - b END))', 9)} AS value
  FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j), g WHERE g.gx = least(a + k.i, 10) AND g.gy = least(b + k.j, 20) GROUP BY pid""")
def _(spark, d):
    grid = spark.range(11 * 21).selectExpr("id DIV 21 AS gx", "id % 21 AS gy").selectExpr("gx", "gy", "CAST(gx * gx + 3 * gy AS DOUBLE) AS value")
    at = T.table(spark, d, "orders").selectExpr("o_orderkey AS pid", "(o_orderkey % 1000) / 90e0 AS x", "o_totalprice / 20000 AS y")
    return rounded(spatial.bilinear(grid, at, 1.0, 11, 21), "value", digits=9)


@query(
    "nearest_label_transfer",
    f"WITH {PTS}, c AS (SELECT a.pid, b.pid AS nid, b.grp, {G.distance()} AS dist, row_number() OVER (PARTITION BY a.pid ORDER BY {G.distance()}, b.pid) AS rn FROM pts a JOIN pts b ON b.grp < 5) SELECT pid, nid, {r('dist', 6)} AS dist, grp AS label FROM c WHERE rn = 1",
)
def _(spark, d):
    c = T.vectors(spark, d)  # of the ten classes five have a label to give
    return rounded(spatial.nearest_label(c, c.where("label < 5")), "dist", digits=6)


@query(
    "grow_labels",
    f"WITH {PTS}, c AS (SELECT a.pid, b.pid AS nid, {G.distance()} AS dist FROM pts a JOIN pts b ON b.grp < 5 AND a.grp >= 5), k AS (SELECT pid, arg_min(nid, (dist, nid)) AS nid FROM c WHERE dist <= 0.2 GROUP BY pid) SELECT pid, CAST(grp AS BIGINT) AS label FROM pts WHERE grp < 5 UNION ALL SELECT k.pid, CAST(p.grp AS BIGINT) FROM k JOIN pts p ON p.pid = k.nid",
)
def _(spark, d):
    c = T.vectors(spark, d)
    own = c.where("label < 5").selectExpr("pid", "CAST(label AS BIGINT) AS label")
    c = c.select("pid", "x", "y", "z")
    return blocks.grow(c, own, c.selectExpr("pid", "1e0 AS score"), 0.2)


@query(
    "grow_within_filter",
    f"WITH {PTS}, c AS (SELECT a.pid, b.pid AS nid, {G.distance()} AS dist FROM pts a JOIN pts b ON b.grp < 5 AND a.grp >= 5 AND a.grp <> 7 AND a.z > 0), k AS (SELECT pid, arg_min(nid, (dist, nid)) AS nid FROM c WHERE dist <= 0.2 GROUP BY pid) SELECT pid, CAST(grp AS BIGINT) AS label FROM pts WHERE grp < 5 UNION ALL SELECT k.pid, CAST(p.grp AS BIGINT) FROM k JOIN pts p ON p.pid = k.nid",
)
def _(spark, d):
    """Growing where a filter lets it and the score is enough."""
    c = T.vectors(spark, d)
    own = c.where("label < 5").selectExpr("pid", "CAST(label AS BIGINT) AS label")
    score = c.selectExpr("pid", "CASE WHEN label = 7 THEN 0e0 ELSE 1e0 END AS score")
    return blocks.grow(c.select("pid", "x", "y", "z"), own, score, 0.2, c.where("z > 0").select("pid"))


_CELL = ", ".join(f"floor({c} / 0.1)" for c in "xyz")


@query(
    "processed_label_transfer",
    f"WITH {PTS}, v AS (SELECT min(pid) AS pid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts GROUP BY {_CELL}), c AS (SELECT a.pid, b.pid AS nid, {G.distance()} AS dist, row_number() OVER (PARTITION BY a.pid ORDER BY {G.distance()}, b.pid) AS rn FROM pts a CROSS JOIN v b) SELECT c.pid, nid, {r('dist', 6)} AS dist, p.grp AS label FROM c JOIN pts p ON p.pid = nid WHERE rn = 1",
)
def _(spark, d):
    c = T.vectors(spark, d)
    return rounded(spatial.nearest_label(c, S.voxels(c, 0.1).select("pid", "x", "y", "z").join(c.select("pid", "label"), "pid")), "dist", digits=6)


@query(
    "grow_cell_labels",
    f"WITH {PTS}, w AS (SELECT *, count(*) OVER (PARTITION BY {_CELL}) AS n, min(pid) OVER (PARTITION BY {_CELL}) AS label FROM pts), c AS (SELECT a.pid, b.pid AS nid, b.label, {G.distance()} AS dist FROM w a JOIN w b ON a.n < 3 AND b.n >= 3), k AS (SELECT pid, arg_min(label, (dist, nid)) AS label FROM c WHERE dist <= 0.2 GROUP BY pid) SELECT pid, label FROM w WHERE n >= 3 UNION ALL SELECT pid, label FROM k",
)
def _(spark, d):
    c = T.vectors(spark, d).select("pid", "x", "y", "z")
    own = c.selectExpr("pid", f"count(*) OVER (PARTITION BY {_CELL}) AS n", f"min(pid) OVER (PARTITION BY {_CELL}) AS label").where("n >= 3").select("pid", "label")
    return blocks.grow(c, own, c.selectExpr("pid", "1e0 AS score"), 0.2)


_AXES = "(SELECT *, ny * mz - nz * my AS bx, nz * mx - nx * mz AS by_, nx * my - ny * mx AS bz FROM " + eig("pts", "grp", normals=True, major=True) + ")"


@query("group_obb_extent", f"""WITH {PTS}, ax AS (SELECT * FROM {_AXES} AS t), pr AS (SELECT p.grp, p.x * mx + p.y * my + p.z * mz AS a, p.x * bx + p.y * by_ + p.z * bz AS b, p.x * nx + p.y * ny + p.z * nz AS c FROM pts p JOIN ax ON ax.grp = p.grp),
  e AS (SELECT grp, count(*) AS n, list_reverse_sort([max(a) - min(a), max(b) - min(b), max(c) - min(c)]) AS e FROM pr GROUP BY grp) SELECT CAST(grp AS BIGINT) AS label, n, {r('e[1]')} AS e0, {r('e[2]')} AS e1, {r('e[3]')} AS e2 FROM e""")
def _(spark, d):
    rows = T.vectors(spark, d).selectExpr("CAST(label AS BIGINT) AS label", "x", "y", "z", "0e0 AS surface")
    return rounded(fit.fit(rows, sizing="block").selectExpr("label", "n", *[f"extents[{i}] AS e{i}" for i in range(3)]), "e0", "e1", "e2")


_BOX = f"{LI}, s AS (SELECT grp, count(*) AS n, max(x) - min(x) AS a, max(y) - min(y) AS b, max(z) - min(z) AS c FROM li GROUP BY grp)"


@query(
    "ellipsoid_area_volume",
    f"WITH {_BOX} SELECT grp, {r('exp(ln((exp(1.6075 * ln(a * b)) + exp(1.6075 * ln(b * c)) + exp(1.6075 * ln(c * a))) / 3) / 1.6075) * 12.566370614359172', 2)} AS area, {r('a * b * c * 4.1887902047863905', 2)} AS volume FROM s",
)
def _(spark, d):
    s = T.lines(spark, d).groupBy("grp").agg(*[(F.max(c) - F.min(c)).alias(o) for c, o in zip("xyz", "abc", strict=True)])
    return rounded(s.selectExpr("grp", f"{G.ellipsoid_area('a', 'b', 'c')} AS area", f"{G.ellipsoid_volume('a', 'b', 'c')} AS volume"), "area", "volume", digits=2)


_CUBES = " + ".join(f"{64 // 8**i} * CAST(floor(8 * {c}) AS BIGINT)" for i, c in enumerate("xyz"))
SEGS = f"{_EVT3}, sg AS (SELECT {_CUBES} AS label, x, y, z FROM ev), sm AS (SELECT * FROM sg WHERE label IN (SELECT label FROM sg GROUP BY label HAVING count(*) >= 6))"


def event_segments(spark, d) -> DataFrame:
    """Events of one cube of the unit box, where there are six and more: segments that grow in number and size with the table."""
    rows = unit_events(spark, d).selectExpr(f"{_CUBES} AS label", "x", "y", "z", "0.01e0 AS surface")
    return rows.join(rows.groupBy("label").agg(F.count("*").alias("n")).where("n >= 6").select("label"), "label", "left_semi")


_UVW = ["1e0" if not any(m) else " * ".join(c for c, k in zip("uvw", m, strict=True) for _ in range(k)) for m in fit.MONOMIALS]


@query("segment_moments", f"""WITH {SEGS}, b AS (SELECT label, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (min(z) + max(z)) / 2 AS mz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z), 1e-8) AS size FROM sm GROUP BY label),
  u AS (SELECT sm.label, (x - mx) / size AS u, (y - my) / size AS v, (z - mz) / size AS w FROM sm JOIN b ON b.label = sm.label), s AS (SELECT label, [{', '.join(f'sum({t})' for t in _UVW)}] AS t FROM u GROUP BY label)
  SELECT label, CAST(unnest(range({len(_UVW)})) AS INTEGER) AS i, {r('unnest(t)', 7)} AS total FROM s""")
def _(spark, d):
    """The sums that boxes and quadrics are fitted from, out of parts of four points."""
    return rounded(fit.moments(event_segments(spark, d), part=4), "total", digits=7)


_SEGAX = "(SELECT *, ny * mz - nz * my AS bx, nz * mx - nx * mz AS by_, nx * my - ny * mx AS bz FROM " + eig("sm", "label", normals=True, major=True) + ")"
BOXES = f"""{SEGS}, ax AS (SELECT * FROM {_SEGAX} AS t), pr AS (SELECT p.label, p.x * mx + p.y * my + p.z * mz AS a, p.x * bx + p.y * by_ + p.z * bz AS b, p.x * nx + p.y * ny + p.z * nz AS c FROM sm p JOIN ax ON ax.label = p.label),
  ex AS (SELECT label, count(*) AS n, max(a) - min(a) AS a, max(b) - min(b) AS b, max(c) - min(c) AS c FROM pr GROUP BY label),
  bo AS (SELECT ex.label, ex.n, list_reverse_sort([a, b, c]) AS e, CASE WHEN a >= b AND a >= c THEN [mx, my, mz] WHEN b >= c THEN [bx, by_, bz] ELSE [nx, ny, nz] END AS q FROM ex JOIN ax ON ax.label = ex.label),
  cap AS (SELECT 0.14 * greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS cap FROM ev)"""


def segment_boxes(spark, d) -> DataFrame:
    """Block models of the segments, from parts of four points, under a size cap."""
    return fit.fit(event_segments(spark, d), sizing="block", cap=S.span_cap(unit_events(spark, d), 0.14).first()[0], part=4)


@query("segment_boxes", f"WITH {BOXES} SELECT label, n, {r('e[1]')} AS e0, {r('e[2]')} AS e1, {r('e[3]')} AS e2, e[1] <= cap + 1e-9 AS sizecapok FROM bo, cap")
def _(spark, d):
    t = segment_boxes(spark, d).selectExpr("label", "n", *[f"extents[{i}] AS e{i}" for i in range(3)], "sizecapok")
    return rounded(t, "e0", "e1", "e2")


def toy_models(spark, d):
    """A model table with known columns out of the events, for the summary operators."""
    return T.events(spark, d).selectExpr(
        "pid AS label",
        "pid % 7 <> 0 AS fitok",
        "pid % 11 <> 0 AS aqualityok",
        "CAST(NULL AS BOOLEAN) AS sizecapok",
        "array(x, y, z) AS c",
        "array(1 + z / 10, 1 + z / 20, 1 + z / 40) AS r",
        "array(x - 360, y - 40, z) AS axis_map",
        "array(z, x - 300, y - 50) AS axis_x",
        "1 + z AS v",
        "2 + z AS a",
    )


MOD = f"{EVT}, mod AS (SELECT pid AS label, x, y, z, 1 + z / 10 AS r0, 1 + z / 20 AS r1, 1 + z / 40 AS r2, 1 + z AS v, 2 + z AS a FROM evt WHERE pid % 7 <> 0 AND pid % 11 <> 0)"
_AM = "(atan2(CASE WHEN y - 40 < 0 THEN -1 ELSE 1 END * (y - 40), CASE WHEN y - 40 < 0 THEN -1 ELSE 1 END * (x - 360)) + pi() / 2)"


@query("accepted_models", f"WITH {BOXES} SELECT count(*) AS n FROM bo, cap WHERE e[1] <= cap + 1e-9")
def _(spark, d):
    return summary.accepted(segment_boxes(spark, d)).agg(F.count("*").alias("n"))


_TURN = lambda y, x, s: f"(atan2(CASE WHEN {s} < 0 THEN -1 ELSE 1 END * {y}, CASE WHEN {s} < 0 THEN -1 ELSE 1 END * {x}) + pi() / 2)"
_MAPPED, _SIDE = _TURN("q[2]", "q[1]", "q[2]"), _TURN("q[2]", "q[3]", "q[3]")


@query(
    "orientation_angles",
    f"WITH {BOXES} SELECT label, {r(f'{_MAPPED} - pi() * floor({_MAPPED} / pi())')} AS angle_map, {r(f'{_SIDE} - pi() * floor({_SIDE} / pi())')} AS angle_x FROM bo, cap WHERE e[1] <= cap + 1e-9",
)
def _(spark, d):
    return rounded(summary.orientations(segment_boxes(spark, d)).select("label", "angle_map", "angle_x"), "angle_map", "angle_x")


_EDGE = lambda w, lo, hi: f"SELECT '{w}' AS what, greatest(2, CAST(ceil(sqrt(count(*))) AS INTEGER)) AS nbin, {lo} AS lo, greatest({hi}, {lo} * 1.01) AS hi FROM mod"


@query(
    "size_distribution_edges",
    f"WITH {MOD}, e AS ({_EDGE('diameter', 'greatest(min(2 * r2), 1e-6)', 'max(2 * r0)')} UNION ALL {_EDGE('volume', 'greatest(min(v), 1e-9)', 'max(v)')} UNION ALL {_EDGE('area', 'greatest(min(a), 1e-9)', 'max(a)')}), k AS (SELECT *, CAST(unnest(range(nbin)) AS INTEGER) AS i FROM e) SELECT what, i, {r('lo + (hi - lo) * i / (nbin - 1)', 7)} AS lin, {r('exp(ln(lo) + (ln(hi) - ln(lo)) * i / (nbin - 1))', 7)} AS log FROM k",
)
def _(spark, d):
    return rounded(summary.edges(toy_models(spark, d)), "lin", "log", digits=7)


@query(
    "histogram_log_bins",
    f"WITH {LI} SELECT least(24, 1 + CAST(floor((ln(y) - ln(0.5)) / (ln(120.0) - ln(0.5)) * 24) AS INTEGER)) AS bin, count(*) AS n FROM li WHERE y BETWEEN 0.5 AND 120.0 GROUP BY 1",
)
def _(spark, d):
    return summary.histogram(T.lines(spark, d), "y", 0.5, 120.0, 24, log=True)


@query(
    "angle_rose",
    f"WITH {MOD}, t AS (SELECT {_AM} - pi() * floor({_AM} / pi()) AS g FROM mod), u AS (SELECT (pi() - g) - pi() * floor((pi() - g) / pi()) AS angle FROM t) SELECT least(20, 1 + CAST(floor(angle / 3.141592653589793 * 20) AS INTEGER)) AS bin, count(*) AS n FROM u WHERE angle BETWEEN 0 AND 3.141592653589793 GROUP BY 1",
)
def _(spark, d):
    return summary.rose(summary.orientations(toy_models(spark, d)), "angle_map", 20, mirrored=True)


@query("top_k_volume", f"WITH {MOD} SELECT label, {r('v')} AS v FROM mod ORDER BY mod.v DESC, label LIMIT 30")
def _(spark, d):
    return rounded(summary.largest(summary.accepted(toy_models(spark, d)), "v", 30).select("label", "v"), "v")


@query(
    "quantiles",
    f"WITH {LI} SELECT grp, {r('quantile_cont(y, 0.1)')} AS q10, {r('quantile_cont(y, 0.5)')} AS q50, {r('quantile_cont(y, 0.92)')} AS q92, {r('quantile_cont(y, 0.9997)')} AS q9997 FROM li GROUP BY grp",
)
def _(spark, d):
    q = summary.quantiles(T.lines(spark, d), "y", [0.1, 0.5, 0.92, 0.9997], "grp")
    return rounded(q.selectExpr("grp", "q[0] AS q10", "q[1] AS q50", "q[2] AS q92", "q[3] AS q9997"), "q10", "q50", "q92", "q9997")


@query(
    "minima_filter",
    f"WITH {EVT}, b AS (SELECT quantile_cont(z, 0.95) AS bound FROM evt) SELECT pid, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z FROM evt, b WHERE z < bound",
)
def _(spark, d):
    cloud = T.events(spark, d)
    return rounded(S.minima(cloud, cloud.selectExpr("pid", "z AS rough")), "x", "y", "z")


@query("elongation_volume", f"WITH {MOD} SELECT label, {r('1 - r2 / greatest(r0, 1e-12)')} AS elongation, {r('log10(greatest(v, 1e-12))')} AS log_volume FROM mod")
def _(spark, d):
    m = T.events(spark, d).where("pid % 7 <> 0 AND pid % 11 <> 0").selectExpr("pid AS label", "1 + z / 10 AS r0", "1 + z / 40 AS r2", "1 + z AS v")
    return rounded(summary.elongation(m.selectExpr("label", "array(r0, r0, r2) AS r", "v")), "elongation", "log_volume")


@query(
    "stride_sample",
    f"WITH {EVT}, n AS (SELECT greatest(count(*) // 1000, 1) AS n FROM evt), o AS (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS place FROM evt) SELECT pid FROM o, n WHERE place % n = 0",
)
def _(spark, d):
    return summary.stride_sample(T.events(spark, d), 1000).select("pid")


@query("bootstrap_sample")
def _(spark, d):
    return summary.bootstrap_sample(T.events(spark, d), 1000).groupBy("pid").agg(F.count("*").alias("draws"))


@query(
    "robust_unit_interval",
    f"WITH {LI}, b AS (SELECT quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM li) SELECT grp, {r('avg(greatest(0e0, least(1e0, (y - lo) / (hi - lo))))')} AS u FROM li, b GROUP BY grp",
)
def _(spark, d):
    return rounded(blocks.robust_unit(T.lines(spark, d), "y").groupBy("grp").agg(F.avg("unit").alias("u")), "u")


def _zone_sql(zones) -> str:
    code = "0"
    for value, corners in zones:
        code = f"CASE WHEN {wound(corners)} THEN {value} ELSE {code} END"
    return f"CAST({code} AS INTEGER)"


_ZN = labels.normalise_zones(ZONES)
_Z = [(labels.ZONES[m], _ZN["zones"][m]) for m in _ZN["mode_order"]]
_I = [(p["id"], p["vertices_xy"]) for p in labels.normalise_instances(INSTANCES)]


@query("points_in_polygon", f"WITH {LI} SELECT grp, count(*) AS n FROM li WHERE {wound(_Z[0][1])} GROUP BY grp")
def _(spark, d):
    return T.lines(spark, d).where(G.in_polygon("x", "y", _Z[0][1])).groupBy("grp").agg(F.count("*").alias("n"))


@query("zone_labels_last_wins", f"WITH {LI} SELECT {_zone_sql(_Z)} AS code, count(*) AS n FROM li GROUP BY 1")
def _(spark, d):
    return labels.counts(labels.zone_labels(T.lines(spark, d), ZONES))


@query("instance_labels", f"WITH {LI} SELECT {_zone_sql(_I)} AS code, count(*) AS n FROM li GROUP BY 1")
def _(spark, d):
    return labels.counts(labels.instance_labels(T.lines(spark, d), INSTANCES))


_CORNERS = [(0.0, -1.0), (1.0, -0.4), (0.6, 0.8), (0.1, 0.1), (-0.8, 0.9), (-1.0, -0.2)]
_POLY = "po AS (SELECT p_partkey AS ord, CAST(p_partkey % 97 + 1 AS INTEGER) AS code, (p_partkey * 37 % 7200) / 1e1 AS cx, (p_partkey * 53 % 1000) / 2e1 AS cy, p_size AS s FROM part)"
_EDGES6 = " UNION ALL ".join(f"SELECT ord, code, cx, cy, s, cx + s * {a!r} AS x1, cy + s * {b!r} / 8 AS y1, cx + s * {c!r} AS x2, cy + s * {e!r} / 8 AS y2 FROM po" for (a, b), (c, e) in zip(_CORNERS, [*_CORNERS[1:], _CORNERS[0]], strict=True))


@query(
    "polygon_join",
    f"""WITH {EVT}, {_POLY}, ed AS ({_EDGES6}), me AS (SELECT e.pid, p.ord FROM evt e JOIN po p ON e.x BETWEEN p.cx - p.s AND p.cx + p.s AND e.z BETWEEN p.cy - p.s / 8e0 AND p.cy + p.s / 8e0),
  tu AS (SELECT me.pid, me.ord, ed.code, sum(CASE WHEN y1 <= z AND y2 > z AND (x2 - x1) * (z - y1) - (x - x1) * (y2 - y1) > 0 THEN 1 WHEN y1 > z AND y2 <= z AND (x2 - x1) * (z - y1) - (x - x1) * (y2 - y1) < 0 THEN -1 ELSE 0 END) AS turns FROM me JOIN evt e ON e.pid = me.pid JOIN ed ON ed.ord = me.ord GROUP BY me.pid, me.ord, ed.code),
  la AS (SELECT pid, arg_max(code, ord) AS code FROM tu WHERE turns <> 0 GROUP BY pid) SELECT e.pid, coalesce(la.code, 0) AS code FROM evt e LEFT JOIN la ON la.pid = e.pid""",
)
def _(spark, d):
    """A polygon for each part, placed and sized by its key; the last one that holds a point gives it its code."""
    corners = ", ".join(f"struct(cx + p_size * {a!r}D AS x, cy + p_size * {b!r}D / 8 AS y)" for a, b in _CORNERS)
    t = T.table(spark, d, "part").selectExpr("*", "(p_partkey * 37 % 7200) / 1e1 AS cx", "(p_partkey * 53 % 1000) / 2e1 AS cy")
    polygons = t.selectExpr("p_partkey AS ord", "CAST(p_partkey % 97 + 1 AS INT) AS code", f"array({corners}) AS corners")
    return spatial.polygon_codes(T.events(spark, d), polygons, "x", "z").select("pid", "code")


@query(
    "ternary_coordinates",
    f"WITH {PTS}, co AS (SELECT a.pid, b.x, b.y, b.z FROM pts a JOIN pts b ON {G.distance()} <= 0.2), g AS (SELECT pid, greatest(l0, 1e-12) AS a, greatest(l1, 1e-12) AS b, greatest(l2, 1e-12) AS c FROM {eig('co', 'pid')} AS m WHERE n >= 10), e AS (SELECT pid, a / (a + b + c) AS e0, b / (a + b + c) AS e1, c / (a + b + c) AS e2 FROM g), w AS (SELECT *, 3 * e0 AS ball, (1 - 3 * e0) * (e2 - e1) AS line FROM e) SELECT pid, CAST(0.4 AS DOUBLE) AS diameter, {', '.join(f'{r(c)} AS {c}' for c in ('e0', 'e1', 'e2'))}, {r('0 * line + 1 * (1 - line - ball) + 0.5 * ball')} AS tx, {r('0.8660254037844386 * ball')} AS ty FROM w",
)
def _(spark, d):
    return rounded(roughness.ternary(T.vectors(spark, d), 0.4).where("e0 IS NOT NULL"), "e0", "e1", "e2", "tx", "ty")


@query("ternary_density")
def _(spark, d):
    """The ternary plot with the density of its points, as it is coloured."""
    t = roughness.ternary(T.vectors(spark, d), 0.4).where("e0 IS NOT NULL").select("pid", "tx", "ty")
    return rounded(summary.density(t), "tx", "ty", "density")


@query(
    "param_row_lookup",
    "SELECT p_name AS name, coalesce(CASE WHEN p_size > 25 THEN p_size END, 20) AS nnptcloud, lower(trim(p_brand)) IN ('brand#11', 'brand#12') AS denoise FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1",
)
def _(spark, d):
    rows = T.table(spark, d, "part").selectExpr(
        "p_name AS Name",
        "p_partkey AS place",
        "CASE WHEN p_size > 25 THEN concat(p_size, '.0') ELSE ' ' END AS nnptcloud",
        "CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN ' Yes' ELSE 'no' END AS denoise",
    )
    return files.parameter_rows(rows, "place").select("name", "nnptcloud", "denoise")


@query(
    "colour_binary",
    f"WITH {EVT} SELECT pid, CAST(CASE WHEN z > 50 THEN 220 ELSE 90 END AS SMALLINT) AS red, CAST(CASE WHEN z > 50 THEN 80 ELSE 90 END AS SMALLINT) AS green, CAST(CASE WHEN z > 50 THEN 40 ELSE 90 END AS SMALLINT) AS blue FROM evt",
)
def _(spark, d):
    return summary.colour_binary(T.events(spark, d), "z > 50", (220, 80, 40), (90, 90, 90)).select("pid", "red", "green", "blue")


def _mixed(channel: int) -> str:
    stops = [int(h[2 * channel : 2 * channel + 2], 16) for h in summary.RAMPS["viridis"]]
    at = "CAST(floor(k * 8 / 255) AS INTEGER)"
    return f"CAST(round({stops}[{at} + 1] + ({stops}[least({at} + 2, 9)] - {stops}[{at} + 1]) * (k * 8 / 255 - floor(k * 8 / 255))) AS SMALLINT)"


@query(
    "colour_ramp",
    f"WITH {EVT}, b AS (SELECT min(z) AS lo, max(z) AS hi FROM evt), k AS (SELECT pid, round_even(255 * (z - lo) / (hi - lo), 0) AS k FROM evt, b) SELECT pid, {', '.join(f'{_mixed(i)} AS {c}' for i, c in enumerate(('red', 'green', 'blue')))} FROM k",
)
def _(spark, d):
    return summary.colour_ramp(T.events(spark, d), "z").select("pid", "red", "green", "blue")


@query(
    "fibonacci_sphere",
    f"SELECT i AS id, {r('cos(pi() * (1 + sqrt(5e0)) * i) * sin(acos(1 - 2 * (i + 0.5e0) / 500))')} AS x, {r('sin(pi() * (1 + sqrt(5e0)) * i) * sin(acos(1 - 2 * (i + 0.5e0) / 500))')} AS y, {r('1 - 2 * (i + 0.5e0) / 500')} AS z FROM range(500) t(i)",
)
def _(spark, d):
    return rounded(summary.sphere_points(spark, 500), "x", "y", "z")


def _segments(spark, d):
    return T.vectors(spark, d).selectExpr("CAST(label AS BIGINT) AS label", "x", "y", "z", "0.01e0 AS surface")


@query("ellipsoid_fit")
def _(spark, d):
    return fit.fit(_segments(spark, d)).selectExpr("label", "n", "fitok", "aqualityok", "round(major_diameter, 3) AS major_diameter")


@query("hybrid_fit")
def _(spark, d):
    return fit.fit(_segments(spark, d), strategy="hybrid_direct").selectExpr("label", "n", "fitok", "round(major_diameter, 3) AS major_diameter")


@query("convex_hull_volume")
def _(spark, d):
    return fit.fit(_segments(spark, d), sizing="block").selectExpr("label", "n", "round(v, 4) AS volume", "round(a, 4) AS area", "round(acover, 2) AS fill")


@query("roughness_multiscale")
def _(spark, d):
    return rounded(roughness.roughness(T.vectors(spark, d), M.Parameters(minscale=0.1, maxscale=0.5), "fast"), "rough", digits=6)


@query("block_split")
def _(spark, d):
    c = T.events(spark, d)
    top = F.broadcast(c.agg(F.avg("z").alias("top")))  # one row
    c = c.join(top).selectExpr("pid", "CAST(y AS BIGINT) DIV 10 AS root", "x / 24 AS x", "y AS y", "z / (z + top) AS score", "z AS local_relief", "z AS top_hat")
    return blocks.split(c, 1.0, 2.0, 5, 30).groupBy("root", "part").agg(F.count("*").alias("n"))


@query("block_segments")
def _(spark, d):
    c = Cloud(spark, d)
    pts = c.pts.drop("label")
    return blocks.segment(pts, pts, c.nbr, S.cut(S.block_score(S.surface_features(c.nbr, pts, K))), K, 5, True)[0].groupBy("label").agg(F.count("*").alias("n"))


@query("roughness_matlab")
def _(spark, d):
    return rounded(roughness.roughness(T.vectors(spark, d), M.Parameters(minscale=0.1, maxscale=0.5), "matlab"), "rough", digits=6)


_TWENTY = "1f77b4 aec7e8 ff7f0e ffbb78 2ca02c 98df8a d62728 ff9896 9467bd c5b0d5 8c564b c49c94 e377c2 f7b6d2 7f7f7f c7c7c7 bcbd22 dbdb8d 17becf 9edae5"
_PICK = lambda k: f"CAST(CASE WHEN grp > 0 THEN CAST(concat('0x', substr(split('{_TWENTY}', ' ')[least(20, 1 + CAST(floor(20 * (grp - 1) / greatest(top - 1, 1e0)) AS INTEGER))], {2 * k + 1}, 2)) AS INTEGER) ELSE 120 END AS SMALLINT)"


@query("instance_colours", f"WITH {PTS}, t AS (SELECT greatest(max(grp), 1) AS top FROM pts) SELECT pid, CAST(grp AS INTEGER) AS code, {', '.join(f'{_PICK(k)} AS {c}' for k, c in enumerate(('red', 'green', 'blue')))} FROM pts, t")
def _(spark, d):
    return summary.instance_colours(T.vectors(spark, d).selectExpr("pid", "CAST(label AS INT) AS code"))


@query("granulo_export")
def _(spark, d):
    return rounded(summary.granulo(fit.fit(_segments(spark, d))), "Xc", "Yc", "Zc", "Dmax", "Dmed", "Dmin", "angle_Mview", "angle_Xview", digits=3)


@query("box_edges")
def _(spark, d):
    return summary.box_edges(fit.fit(_segments(spark, d), sizing="block"))


@query("ellipsoid_mesh")
def _(spark, d):
    return rounded(summary.ellipsoid_mesh(fit.fit(_segments(spark, d))), "x", "y", "z", digits=3)


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict:
    return dict(O)

