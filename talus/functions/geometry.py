"""Geometry as SQL text that Spark (whole-stage code) and any ANSI engine evaluate alike."""

from __future__ import annotations

EPS = "1e-12"
#: Sums whose values give a 3x3 covariance.
MOMENTS = {
    "n": "count(*)", "sx": "sum({x})", "sy": "sum({y})", "sz": "sum({z})", "sxx": "sum({x} * {x})", "sxy": "sum({x} * {y})", "sxz": "sum({x} * {z})",
    "syy": "sum({y} * {y})", "syz": "sum({y} * {z})", "szz": "sum({z} * {z})",
}


def r(x: str, digits: int = 4) -> str:
    """Rounded, without a negative zero."""
    return f"(round({x}, {digits}) + 0.0e0)"


def moments(x: str = "x", y: str = "y", z: str = "z") -> str:
    return ", ".join(f"{e.format(x=x, y=y, z=z)} AS {k}" for k, e in MOMENTS.items())


def covariance(ddof: int = 1) -> str:
    """cxx ... czz of the moments; null under ddof + 1 rows."""
    of = lambda a, b: f"(s{a}{b} - s{a} * s{b} / n) / nullif(n - {ddof}, 0) AS c{a}{b}"
    return ", ".join(of(*p) for p in ("xx", "xy", "xz", "yy", "yz", "zz"))


def eigen_steps() -> list[str]:
    """SELECT lists, each over the one before: the eigenvalues l0 <= l1 <= l2 of cxx ... czz by the trigonometric closed form."""
    return [
        "(cxx + cyy + czz) / 3 AS q, cxy * cxy + cxz * cxz + cyz * cyz AS p1",
        "sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * p1) / 6) AS p",
        "CASE WHEN p > 1e-300 THEN ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * p * p * p) ELSE 0e0 END AS hd",
        "acos(greatest(-1e0, least(1e0, hd))) / 3 AS phi",
        "q + 2 * p * cos(phi) AS l2, q + 2 * p * cos(phi + 2 * pi() / 3) AS l0",
        "3 * q - l0 - l2 AS l1",
    ]


def normal_steps() -> list[str]:
    """After eigen_steps: the unit eigenvector (nx, ny, nz) of l0, turned upward: the longest cross product of two rows of C - l0 I."""
    a, b, c = ("cxx - l0", "cxy", "cxz"), ("cxy", "cyy - l0", "cyz"), ("cxz", "cyz", "czz - l0")
    cross = lambda u, v: [f"(({u[1]}) * ({v[2]}) - ({u[2]}) * ({v[1]}))", f"(({u[2]}) * ({v[0]}) - ({u[0]}) * ({v[2]}))", f"(({u[0]}) * ({v[1]}) - ({u[1]}) * ({v[0]}))"]
    rows = []
    for i, (u, v) in enumerate(((a, b), (a, c), (b, c))):
        rows += [f"{e} AS k{i}{axis}" for e, axis in zip(cross(u, v), "xyz", strict=True)]
    return [
        ", ".join(rows),
        ", ".join(f"k{i}x * k{i}x + k{i}y * k{i}y + k{i}z * k{i}z AS m{i}" for i in range(3)),
        ", ".join(f"CASE WHEN m0 >= m1 AND m0 >= m2 THEN k0{c} WHEN m1 >= m2 THEN k1{c} ELSE k2{c} END AS v{c}" for c in "xyz"),
        "greatest(sqrt(vx * vx + vy * vy + vz * vz), 1e-300) AS vn, CASE WHEN vz < 0 THEN -1e0 ELSE 1e0 END AS up",
        "up * vx / vn AS nx, up * vy / vn AS ny, up * vz / vn AS nz",
    ]


def nest(source: str, steps: list[str]) -> str:
    """SELECT over SELECT, for engines that have no lateral aliases everywhere."""
    for s in steps:
        source = f"(SELECT *, {s} FROM {source} AS t)"
    return source


def normalised(floor: str = EPS) -> list[str]:
    """e0 <= e1 <= e2: eigenvalues clipped below and divided by their sum."""
    clip = lambda k: f"greatest(l{k}, {floor})"
    total = f"({clip(0)} + {clip(1)} + {clip(2)})"
    return [f"{clip(k)} / {total} AS e{k}" for k in range(3)]


def angle(a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
    """Degrees between two vectors, 0 to 180."""
    cx, cy, cz = f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"
    return f"degrees(atan2(sqrt({cx} * {cx} + {cy} * {cy} + {cz} * {cz}), greatest(-1e0, least(1e0, {a[0]} * {b[0]} + {a[1]} * {b[1]} + {a[2]} * {b[2]}))))"


def distance(a: str = "a", b: str = "b") -> str:
    d = lambda c: f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})"
    return f"sqrt({d('x')} + {d('y')} + {d('z')})"


def ellipsoid_area(a: str, b: str, c: str) -> str:
    """Knud Thomsen's approximation."""
    p = "1.6075e0"
    return f"4 * pi() * pow((pow({a} * {b}, {p}) + pow({a} * {c}, {p}) + pow({b} * {c}, {p})) / 3, 1 / {p})"


def ellipsoid_volume(a: str, b: str, c: str) -> str:
    return f"4e0 / 3 * pi() * {a} * {b} * {c}"


def barycentric() -> list[str]:
    """tx, ty of e0 <= e1 <= e2 with sum 1: corners of the triangle are line, plane and ball."""
    c = "(3 * e0)"
    b = f"(1 - (1 - {c}) * (e2 - e1) - {c})"
    return [f"(2 * {b} + {c}) / 2 AS tx", f"sqrt(3e0) / 2 * {c} AS ty"]


def orientation(y: str, x: str, mode: str = "atan2") -> str:
    """Angle of an axis from its two components, 0 to pi; mode matlab takes the arc tangent of their ratio (0 where x is nearly
    0)."""
    at = f"atan2({y}, {x})" if mode == "atan2" else f"CASE WHEN abs({x}) < {EPS} THEN 0e0 ELSE atan(({y}) / ({x})) END"
    turned = f"({at} + pi() / 2)"
    return f"({turned} - pi() * floor({turned} / pi()))"


def in_polygon(x: str, y: str, corners: list[tuple[float, float]]) -> str:
    """Even-odd rule behind an inclusive box; fewer than three corners hold nothing."""
    if len(corners) < 3:
        return "false"
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    n = lambda v: f"({float(v)!r}D)"
    crossings = []
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            crossings.append(f"CASE WHEN ({n(y1)} > {y}) <> ({n(y2)} > {y}) AND {x} < {n(x2 - x1)} * ({y} - {n(y1)}) / {n(y2 - y1)} + {n(x1)} THEN 1 ELSE 0 END")
    return f"({x} BETWEEN {n(min(xs))} AND {n(max(xs))} AND {y} BETWEEN {n(min(ys))} AND {n(max(ys))} AND mod({' + '.join(crossings) or '0'}, 2) = 1)"
