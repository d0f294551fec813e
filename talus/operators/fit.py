"""Shape of each segment, from parts that any number of tasks work on.

A segment's points are dealt into parts of at most PART points. A part is summed up by what adds up or merges: 35 sums of monomials up to the fourth
order (the scatter matrix of all quadrics has no others), the corners of its convex hull (extremes along any axis are among them, and the hull of all corners is the
hull of all points), and the points of the least hashes as a sample. One small solve a segment makes boxes, hulls and models out of these; a second pass
over the parts measures how well ellipsoids fit. No task holds more than a part, or the summaries of one segment's parts."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.model import EPS, Parameters
from talus.session import cut

SCHEMA = (
    "label long, n long, fitok boolean, aqualityok boolean, sizecapok boolean, c array<double>, r array<double>, rot array<double>, axis_map array<double>, axis_x array<double>, "
    "d_mean double, r2 double, v double, a double, major_diameter double, aratio double, acover double, extents array<double>, corners array<double>"
)


#: Points of a part; of a sample; directions that measure the cover.
PART, SAMPLE, DIRECTIONS = 100_000, 300, 200
#: Exponents of x, y and z of the summed monomials, by order and then alphabetically.
MONOMIALS = [tuple(m.count(c) for c in "xyz") for k in range(5) for m in combinations_with_replacement("xyz", k)]
_PLACE = {m: i for i, m in enumerate(MONOMIALS)}
#: Terms of a quadric with their factors: six of the second order, then the linear ones and 1.
QUADRIC = [((2, 0, 0), 1), ((0, 2, 0), 1), ((0, 0, 2), 1), ((0, 1, 1), 2), ((1, 0, 1), 2), ((1, 1, 0), 2), ((1, 0, 0), 2), ((0, 1, 0), 2), ((0, 0, 1), 2), ((0, 0, 0), 1)]


def right_handed(q: np.ndarray) -> np.ndarray:
    q = q.copy()
    if np.linalg.det(q) < 0:
        q[:, -1] *= -1
    return q


def monomial_sums(p: np.ndarray) -> np.ndarray:
    """Sums of MONOMIALS over the rows of p."""
    powers = [np.ones_like(p), p]
    for _ in range(3):
        powers.append(powers[-1] * p)
    return np.array([(powers[a][:, 0] * powers[b][:, 1] * powers[c][:, 2]).sum() for a, b, c in MONOMIALS])


def scatter(sums: np.ndarray) -> np.ndarray:
    """The 10 x 10 matrix of sums of products of quadric terms."""
    return np.array([[f * g * sums[_PLACE[tuple(np.add(a, b))]] for b, g in QUADRIC] for a, f in QUADRIC])


def mean_and_axes(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and principal axes as columns by falling variance."""
    n, one = sums[0], np.eye(3, dtype=int)
    mean = np.array([sums[_PLACE[tuple(one[i])]] for i in range(3)]) / max(n, 1)
    if n < 2:
        return mean, np.eye(3)
    second = np.array([[sums[_PLACE[tuple(one[i] + one[j])]] for j in range(3)] for i in range(3)])
    _, q = np.linalg.eigh((second - n * np.outer(mean, mean)) / (n - 1))
    return mean, right_handed(q[:, ::-1])


def cuboid(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centre, extents, axes by falling extent, and the eight corners of the box along the principal axes; two points span the box of their
    coordinates, whose corners are four times the one and four times the other."""
    mid = (p.min(axis=0) + p.max(axis=0)) / 2
    mean, q = mean_and_axes(monomial_sums(p - mid))
    return box(p, len(p), mean + mid, q)


def box(p: np.ndarray, n: int, mean: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cuboid of n points with this mean and these axes, whose hull has the corners p."""
    if n == 2:
        p = np.repeat(p, 2, axis=0)[:2] if len(p) == 1 else p
        ext = np.abs(p[1] - p[0])
        order = np.argsort(-ext, kind="stable")
        return p.mean(axis=0), ext[order], right_handed(np.eye(3)[:, order]), np.repeat(p, 4, axis=0)
    local = (p - mean) @ q
    lo, hi = local.min(axis=0), local.max(axis=0)
    order = np.argsort(-(hi - lo), kind="stable")
    lo, hi, q = lo[order], hi[order], q[:, order]
    flip = np.linalg.det(q) < 0
    if flip:
        q = right_handed(q)
        lo[-1], hi[-1] = -hi[-1], -lo[-1]
    signs = np.array([[i >> 2 & 1, i >> 1 & 1, i & 1] for i in range(8)])
    return mean + (lo + hi) / 2 @ q.T, hi - lo, q, mean + np.where(signs == 1, hi, lo) @ q.T


class Hull:
    """Convex hull by quickhull. A facet is three corners, seen from outside in turn, and keeps the points over it; the farthest of one facet's points is added, what
    it sees is found from neighbour to neighbour, and only the points of those facets are dealt out again. None is made of flat points."""

    def __init__(self, p: np.ndarray, first: list[int], scale: float):
        self.p, self.rows, self.inside, self.tol = p, p.tolist(), p[first].mean(axis=0), 1e-10 * scale
        self.facets: dict[int, tuple[int, int, int]] = {}
        self.planes: dict[int, tuple[float, float, float, float]] = {}
        self.over: dict[int, np.ndarray] = {}
        self.beside: dict[tuple[int, int], int] = {}
        self.todo: list[int] = []
        self.made = 0
        a, b, c, d = first
        self._add([(a, b, c), (a, b, d), (a, c, d), (b, c, d)], np.arange(len(p)))
        while self.todo:
            k = self.todo.pop()
            if k in self.facets and len(self.over[k]):
                self._extend(k)

    def _add(self, facets: list[tuple[int, int, int]], points: np.ndarray) -> None:
        tri = np.array(facets)
        x = self.p[tri]
        n = np.cross(x[:, 1] - x[:, 0], x[:, 2] - x[:, 0])
        inward = (n * (x[:, 0] - self.inside)).sum(axis=1) < 0
        tri[inward] = tri[inward][:, [0, 2, 1]]
        n[inward] *= -1
        n /= np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)
        level = (n * x[:, 0]).sum(axis=1)
        if len(points):
            far = self.p[points] @ n.T - level
            best = far.argmax(axis=1)
            out = far[np.arange(len(points)), best] > self.tol
        for i, (t, plane) in enumerate(zip(map(tuple, tri.tolist()), np.column_stack([n, level]).tolist(), strict=True)):
            k, self.made = self.made, self.made + 1
            self.facets[k], self.planes[k] = t, plane
            self.over[k] = points[out & (best == i)] if len(points) else points
            for j in range(3):
                self.beside[t[j], t[(j + 1) % 3]] = k
            if len(self.over[k]):
                self.todo.append(k)

    def _extend(self, k: int) -> None:
        a, b, c, level = self.planes[k]
        far = int(self.over[k][(self.p[self.over[k]] @ np.array([a, b, c])).argmax()])
        x, y, z = self.rows[far]
        seen, stack, rim = {k}, [k], []
        while stack:
            f = self.facets[stack.pop()]
            for i, j in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])):
                other = self.beside[j, i]
                if other not in seen:
                    a, b, c, level = self.planes[other]
                    if a * x + b * y + c * z - level > self.tol / 10:
                        seen.add(other)
                        stack.append(other)
                    else:
                        rim.append((i, j, other))
        points = np.concatenate([self.over[f] for f in seen])
        for f in seen:
            t = self.facets.pop(f)
            del self.planes[f], self.over[f]
            for j in range(3):
                if self.beside.get((t[j], t[(j + 1) % 3])) == f:
                    del self.beside[t[j], t[(j + 1) % 3]]
        self._add([(i, j, far) for i, j, other in rim if other not in seen], points[points != far])

    def measures(self) -> tuple[float, float]:
        """Volume and area."""
        x = self.p[np.array(list(self.facets.values()))] - self.inside
        return float(np.abs((np.cross(x[:, 0], x[:, 1]) * x[:, 2]).sum(axis=1)).sum() / 6), float(np.linalg.norm(np.cross(x[:, 1] - x[:, 0], x[:, 2] - x[:, 0]), axis=1).sum() / 2)

    def corners(self) -> np.ndarray:
        return self.p[np.unique(np.array(list(self.facets.values())))]


def _flat_corners(p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Corners of points of a plane with the axes u and v, or of a line: the two chains of turns to one side."""
    at = np.column_stack([p @ u, p @ v])
    order = np.lexsort((at[:, 1], at[:, 0]))

    def chain(rows):
        out: list[int] = []
        for i in rows:
            while len(out) > 1:
                (ax, ay), (bx, by), (cx, cy) = at[out[-2]], at[out[-1]], at[i]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                out.pop()
            out.append(int(i))
        return out

    return p[np.unique(chain(order) + chain(order[::-1]))]


def convex(p: np.ndarray) -> tuple[tuple[float, float] | None, np.ndarray]:
    """Volume and area of the convex hull (None if the points are flat), and its corners."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return None, p
    a = int(p[:, 0].argmin())
    b = int(((p - p[a]) ** 2).sum(axis=1).argmax())
    c = int((np.cross(p - p[a], p[b] - p[a]) ** 2).sum(axis=1).argmax())
    n = np.cross(p[b] - p[a], p[c] - p[a])
    height = (p - p[a]) @ n
    d = int(np.abs(height).argmax())
    scale = float(np.ptp(p, axis=0).max())
    if np.linalg.norm(n) <= 1e-12 * scale**2 or abs(height[d]) <= 1e-10 * scale * np.linalg.norm(n):
        u = (p[b] - p[a]) / max(np.linalg.norm(p[b] - p[a]), 1e-300)
        v = p[c] - p[a] - (p[c] - p[a]) @ u * u
        return None, _flat_corners(p, u, v / max(np.linalg.norm(v), 1e-300))
    h = Hull(p, [a, b, c, d], scale)
    return h.measures(), h.corners()


def hull(p: np.ndarray) -> tuple[float, float] | None:
    """Volume and area of the convex hull; None if the points are flat."""
    return convex(p)[0]


def area_of(r: np.ndarray) -> float:
    p = 1.6075
    return float(4 * np.pi * (((r[0] * r[1]) ** p + (r[0] * r[2]) ** p + (r[1] * r[2]) ** p) / 3) ** (1 / p))


def surface_samples(r, c, q, n: int, rng) -> np.ndarray:
    """Uniform directions scaled by the radii: denser where the surface is less curved, as the cover measure expects."""
    u = rng.normal(size=(n, 3))
    return u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), EPS) * r @ q.T + c


def direct(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Algebraic least squares over quadrics with the constraint 4 J - I^2 > 0; centre, radii (falling), axes."""
    if len(p) < 9:
        return None
    mean, size = p.mean(axis=0), max(float(np.ptp(p, axis=0).max()), 1e-8)
    return direct_from(monomial_sums((p - mean) / size), mean, size)


def direct_from(sums: np.ndarray, mean: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The same out of sums over (p - mean) / size."""
    if sums[0] < 9:
        return None
    s = scatter(sums)
    k = np.zeros((6, 6))
    k[:3, :3] = 1 - 2 * np.eye(3)
    k[3:, 3:] = -4 * np.eye(3)
    try:
        back = np.linalg.solve(s[6:, 6:], s[6:, :6])
        w, v = np.linalg.eig(np.linalg.solve(k, s[:6, :6] - s[:6, 6:] @ back))
    except np.linalg.LinAlgError:
        return None
    real = np.isfinite(w) & (np.abs(w.imag) < 1e-8)
    if not real.any():
        return None
    w, v = w[real].real, v[:, real].real
    g = v[:, np.flatnonzero(w > 0)[0] if (w > 0).any() else np.abs(w).argmin()]
    h = -back @ g
    a = np.array([[g[0], g[5], g[4]], [g[5], g[1], g[3]], [g[4], g[3], g[2]]])
    if np.trace(a) < 0:
        a, h = -a, -h
    try:
        centre = np.linalg.solve(a, -h[:3])
        level = -(h[3] + h[:3] @ centre)
        e, q = np.linalg.eigh(a)
    except np.linalg.LinAlgError:
        return None
    if (e <= 0).any() or level <= 0:
        return None
    return centre * size + mean, np.sqrt(level / e) * size, right_handed(q)


def bounded(sample: np.ndarray, centre, radii, q) -> tuple[np.ndarray, np.ndarray]:
    """Centre and radii refined by reweighted Gauss-Newton steps with soft-L1 weights inside bounds: a quarter of a radius, and half to one and a half times."""
    local = (sample - centre) @ q
    hi = np.concatenate([0.25 * radii, np.full(3, np.log(1.5))])
    lo = np.concatenate([-0.25 * radii, np.full(3, np.log(0.5))])
    t, damp = np.zeros(6), 1e-3

    def at(t):
        u = (local - t[:3]) / (radii * np.exp(t[3:]))
        return u, (u * u).sum(axis=1) - 1

    cost = lambda f: float((2 * (np.sqrt(1 + f * f) - 1)).sum())
    u, f = at(t)
    for _ in range(120):
        j = np.concatenate([-2 * u / (radii * np.exp(t[3:])), -2 * u * u], axis=1)
        w = 1 / np.sqrt(1 + f * f)
        g, hess = j.T @ (w * f), j.T @ (w[:, None] * j)
        free = ~((t <= lo) & (g > 0) | (t >= hi) & (g < 0))
        step = np.zeros(6)
        if free.any():
            m = hess[np.ix_(free, free)]
            step[free] = -np.linalg.solve(m + damp * np.diag(np.maximum(np.diag(m), 1e-12)), g[free])
        new = np.clip(t + step, lo, hi)
        un, fn = at(new)
        if cost(fn) < cost(f):
            done = np.abs(new - t).max() < 1e-10
            t, u, f, damp = new, un, fn, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e8:
                break
    return centre + t[:3] @ q.T, radii * np.exp(t[3:])


def sample_keys(p: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each point: the points of the least ones are a sample that doesn't depend on order or parts."""
    bits = np.ascontiguousarray(p).view(np.uint64)
    h = np.full(len(p), np.uint64(seed * 2 + 1))
    for i in range(3):
        h = (h ^ bits[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def ellipsoid_of(strategy: str, n: int, sums: np.ndarray, mid: np.ndarray, size: float, mean, q, corners: np.ndarray, sample: np.ndarray) -> list[dict]:
    """Candidate ellipsoids. pca_maxabs: radii that hold all points; bounded_pca: refined; hybrid_direct: the algebraic fit as well, if there is one."""
    if n < 3:
        return []
    c, r = mean, np.maximum(np.abs((corners - mean) @ q).max(axis=0), 1e-4)
    if strategy in ("bounded_pca", "hybrid_direct") and n >= 9:
        c, r = bounded(sample, c, r, q)
    order = np.argsort(-r, kind="stable")
    base = {"c": c, "r": r[order], "rot": right_handed(q[:, order])}
    out = [base | {"axis_map": base["rot"][:, 0], "axis_x": base["rot"][:, 0]}]
    if found := direct_from(sums, mid, size) if strategy == "hybrid_direct" else None:
        c, r, q = found
        r = r.copy()
        r[2] = max(r[2], r[0] / 2)
        r[1] = max(r[1], r[2])
        order = np.argsort(-r, kind="stable")
        out.append({"c": c, "r": r[order], "rot": right_handed(q[:, order]), "axis_map": q[0].copy(), "axis_x": base["rot"][:, 0]})
    return out


def measured(p: np.ndarray, c, r, q, samples: np.ndarray) -> np.ndarray:
    """What adds up over parts: distance to the surface, squared misfit, scale and its square; then, for each sample of the surface, whether it is the nearest of a point."""
    local = (p - c) @ q
    scale = np.maximum(np.sqrt(((local / r) ** 2).sum(axis=1)), EPS)
    matched = np.zeros(len(samples))
    for x in np.array_split(p, max(1, len(p) // 2000)):
        matched[((x[:, None] - samples[None]) ** 2).sum(axis=2).argmin(axis=1)] = 1
    return np.concatenate([[np.linalg.norm(local - local / scale[:, None], axis=1).sum(), ((scale - 1) ** 2).sum(), scale.sum(), (scale**2).sum()], matched])


def judged(model: dict, n: int, total: np.ndarray, surface: float, par: Parameters, cap: float | None) -> dict:
    r, cover = model["r"], 100 * float((total[4:] > 0).sum()) / DIRECTIONS
    area, spread = area_of(r), max(total[3] - total[2] ** 2 / n, 0.0)
    return model | {
        "fitok": True, "aqualityok": bool(cover > par.aquality_thresh), "sizecapok": bool(cap is None or 2 * r[0] <= cap + 1e-9), "d_mean": float(total[0] / n), "r2": 1 - float(total[1]) / (float(spread) + EPS),
        "v": 4 / 3 * np.pi * float(r.prod()), "a": area, "major_diameter": 2 * float(r[0]), "aratio": surface / max(area, EPS), "acover": cover,
    }


def block(p: np.ndarray, surface: float, cap: float | None) -> dict:
    """Box and hull of an irregular block; cover is how much of the box the hull fills."""
    return block_of(cuboid(p), hull(p), cap)


def block_of(cuboid_: tuple, found: tuple[float, float] | None, cap: float | None) -> dict:
    c, ext, q, _ = cuboid_
    r = np.maximum(ext / 2, 1e-4)
    # a flat block has the box's volume, which is 0, and its area
    whole = float(np.prod(ext))
    v, a = found or (whole, float(2 * (ext[0] * ext[1] + ext[0] * ext[2] + ext[1] * ext[2])))
    return {
        "fitok": True, "aqualityok": True, "sizecapok": bool(cap is None or ext[0] <= cap + 1e-9), "c": c, "r": r, "rot": q, "axis_map": q[:, 0], "axis_x": q[:, 0], "d_mean": 0.0, "r2": 1.0, "v": v, "a": a,
        "major_diameter": float(ext[0]), "aratio": v / max(whole, EPS), "acover": 100 * min(1.0, v / max(whole, EPS)),
    }


# over DataFrames

_STATS = ["mid0", "mid1", "mid2", "size"]


def dealt(points: DataFrame, part: int = PART) -> DataFrame:
    """points (label, x, y, z, surface) with the middle and size of their segment and the number of their part, which their coordinates decide."""
    stats = points.groupBy("label").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{c}") for c in "xyz" for f, k in ((F.min, "lo"), (F.max, "hi"))])
    mids = [f"(lo{c} + hi{c}) / 2 AS mid{i}" for i, c in enumerate("xyz")]
    stats = stats.selectExpr("label", *mids, "greatest(hix - lox, hiy - loy, hiz - loz, 1e-8) AS size", f"CAST(ceil(n / {part}) AS INT) AS parts")
    return points.select("label", "x", "y", "z", "surface").join(stats, "label").selectExpr("label", "pmod(xxhash64(x, y, z), parts) AS part", "x", "y", "z", "surface", *_STATS)


def _sorted(t: pa.Table) -> np.ndarray:
    p = np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1)
    return p[np.lexsort(p.T[::-1])]


_SUMMARY = "label long, part long, surface double, mid0 double, mid1 double, mid2 double, size double, sums array<double>, corners array<double>, sample array<double>"


def summaries(points: DataFrame, seed: int = 0) -> DataFrame:
    """dealt points: what is kept of each part."""

    def run(t: pa.Table) -> pa.Table:
        p = _sorted(t)
        one = lambda c: t.column(c)[0].as_py()
        mid, size = np.array([one(f"mid{i}") for i in range(3)]), one("size")
        sample = p[np.argsort(sample_keys(p, seed), kind="stable")[:SAMPLE]]
        row = {"label": one("label"), "part": one("part"), "surface": float(np.sort(t.column("surface").to_numpy()).sum()), **{k: one(k) for k in _STATS}}
        return pa.Table.from_pylist([row | {"sums": monomial_sums((p - mid) / size).tolist(), "corners": convex(p)[1].ravel().tolist(), "sample": sample.ravel().tolist()}])

    return points.groupBy("label", "part").applyInArrow(run, _SUMMARY)


def moments(points: DataFrame, part: int = PART) -> DataFrame:
    """(label, i, total): the sums of each segment's monomials about the middle of its box, in its sizes."""
    each = summaries(dealt(points, part)).selectExpr("label", "posexplode(sums) AS (i, v)")
    return each.groupBy("label", "i").agg(F.sum("v").alias("total"))


def _merged(pdf: pd.DataFrame, seed: int) -> dict:
    """One segment out of its parts."""
    pdf = pdf.sort_values("part")
    first = pdf.iloc[0]
    mid, size, sums = np.array([first[f"mid{i}"] for i in range(3)]), float(first["size"]), np.sum(np.stack(pdf["sums"]), axis=0)
    stack = lambda c: np.concatenate(pdf[c].to_numpy()).reshape(-1, 3)
    mean, q = mean_and_axes(sums)
    mean, sample = mean * size + mid, stack("sample")
    found, corners = convex(stack("corners"))
    sample = sample[np.argsort(sample_keys(sample, seed), kind="stable")[:SAMPLE]]
    n = int(round(sums[0]))
    return {"n": n, "sums": sums, "mid": mid, "size": size, "mean": mean, "q": q, "corners": corners, "hull": found, "sample": sample, "surface": float(pdf["surface"].sum()), "box": box(corners, n, mean, q)}


def fit(points: DataFrame, par: Parameters | None = None, strategy: str = "bounded_pca", cap: float | None = None, sizing: str = "ellipsoid", seed: int = 0, part: int = PART) -> DataFrame:
    """points (label, x, y, z, surface): one model a label. What is drawn follows (seed, label) and the points, so partitions don't matter."""
    par = par or Parameters()
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    table = lambda rows: pd.DataFrame([{k: (v.ravel().tolist() if isinstance(v := r.get(k), np.ndarray) else v) for k in names} for r in rows])
    own = lambda key, m: {"label": int(key[0]), "n": m["n"], "extents": m["box"][1], "corners": m["box"][3]}
    rows = dealt(points, part)
    if sizing == "block":

        def blocks(key, pdf: pd.DataFrame) -> pd.DataFrame:
            m = _merged(pdf, seed)
            return table([block_of(m["box"], m["hull"], cap) | own(key, m)])

        return summaries(rows, seed).groupBy("label").applyInPandas(blocks, SCHEMA)
    rows = cut(rows)

    def proposed(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m = _merged(pdf, seed)
        found = ellipsoid_of(strategy, m["n"], m["sums"], m["mid"], m["size"], m["mean"], m["q"], m["corners"], m["sample"])
        none = {"fitok": False, "aqualityok": False, "sizecapok": True}
        out = table([x | own(key, m) for x in found or [none]])
        return out.assign(k=range(len(out)), surface=m["surface"], parts=int(pdf["part"].max()) + 1)

    models = cut(summaries(rows, seed).groupBy("label").applyInPandas(proposed, f"{SCHEMA}, k int, surface double, parts int"))

    def measure(key, a: pa.Table, b: pa.Table) -> pa.Table:
        p, out = _sorted(a), []
        for m in b.to_pylist() if len(p) else ():
            c, r, q = np.array(m["c"]), np.array(m["r"]), np.array(m["rot"]).reshape(3, 3)
            samples = surface_samples(r, c, q, DIRECTIONS, np.random.default_rng([seed, abs(m["label"]), m["k"]]))
            out.append({"label": m["label"], "part": m["part"], "k": m["k"], "total": measured(p, c, r, q, samples).tolist()})
        return pa.Table.from_pylist(out, pa.schema([("label", pa.int64()), ("part", pa.int64()), ("k", pa.int32()), ("total", pa.list_(pa.float64()))]))

    asked = models.where("c IS NOT NULL").selectExpr("label", "explode(sequence(0L, parts - 1L)) AS part", "k", "c", "r", "rot")
    totals = rows.groupBy("label", "part").cogroup(asked.groupBy("label", "part")).applyInArrow(measure, "label long, part long, k int, total array<double>")
    totals = totals.groupBy("label", "k").agg(F.array_sort(F.collect_list(F.struct("part", "total"))).alias("totals"))  # a row a part

    def judge(batches):
        for pdf in batches:
            out = []
            for m in pdf.to_dict("records"):
                if m["totals"] is not None:
                    m |= {x: np.array(m[x], float) for x in ("c", "r", "rot", "axis_map", "axis_x", "extents", "corners")}
                    m = judged(m, m["n"], np.sum([np.asarray(t["total"], float) for t in m["totals"]], axis=0), m["surface"], par, cap)
                out.append(m | {"k": m["k"]})
            yield table(out).assign(k=[m["k"] for m in out]) if out else pd.DataFrame(columns=[*names, "k"])

    done = models.join(totals, ["label", "k"], "left").select(*names, "k", "surface", "totals").mapInPandas(judge, f"{SCHEMA}, k int")
    # the algebraic fit if it is accepted, else the other
    good = "CASE WHEN k > 0 AND NOT (fitok AND aqualityok AND sizecapok) THEN -1 ELSE k END"
    return done.groupBy("label").agg(F.max_by(F.struct(*names), F.expr(good)).alias("m")).select("m.*")
