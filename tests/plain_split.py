"""Splitting one component of blocks point by point in memory: what the joined version is compared with."""

import heapq

import numpy as np

from talus import model as M


def unit_interval(v: np.ndarray, lo: float = 0.1, hi: float = 0.9) -> np.ndarray:
    """Scaled between two quantiles and clipped; 1 where they are equal, 0 for what is not finite."""
    ok = np.isfinite(v)
    if not ok.any():
        return np.zeros_like(v)
    a, b = np.quantile(v[ok], [lo, hi])
    out = np.ones_like(v) if b - a < M.EPS else np.clip((v - a) / (b - a), 0, 1)
    return np.where(ok, out, 0.0)


def _smooth(g: np.ndarray, sigma: float) -> np.ndarray:
    n = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        pad = np.pad(g, [(n, n) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        g = sum(w[i] * np.take(pad, range(i, i + g.shape[axis]), axis=axis) for i in range(2 * n + 1))
    return g


def _peaks_joined(at: np.ndarray, radius: float) -> list[list[int]]:
    left, out = set(range(len(at))), []
    while left:
        stack, group = [left.pop()], []
        while stack:
            i = stack.pop()
            group.append(i)
            near = [j for j in left if ((at[i] - at[j]) ** 2).sum() <= radius * radius]
            left.difference_update(near)
            stack += near
        out.append(sorted(group))
    return sorted(out)


def _flood(cost: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Each cell joins the marker that reaches it over the least highest cost."""
    out, heap, k = markers.copy(), [], 0
    for i, j in zip(*np.nonzero(markers), strict=True):
        heapq.heappush(heap, (int(cost[i, j]), k, int(i), int(j)))
        k += 1
    while heap:
        c, _, i, j = heapq.heappop(heap)
        for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
            if 0 <= a < cost.shape[0] and 0 <= b < cost.shape[1] and not out[a, b]:
                out[a, b] = out[i, j]
                heapq.heappush(heap, (max(c, int(cost[a, b])), k, a, b))
                k += 1
    return out


def split_parts(xy, score, relief, top_hat, seed, gap: float, radius: float, min_seeds: int, least: int) -> np.ndarray:
    """Part number of each point of one component; all 0 if it stays whole, -1 for points of parts that are too small."""
    s, whole = M.SPLIT, np.zeros(len(xy), np.int64)
    if len(xy) < max(least, 2 * s["min_points"]) or seed.sum() < max(2 * min_seeds, 2 * s["min_points"]):
        return whole
    cell = max(s["grid_factor"] * gap, M.EPS)
    g = np.floor((xy - xy.min(axis=0)) / cell).astype(int)
    shape = tuple(g.max(axis=0)[::-1] + 1)
    if min(shape) < 2:
        return whole
    flat = g[:, 1] * shape[1] + g[:, 0]
    total = lambda w=None: np.bincount(flat, w, shape[0] * shape[1]).reshape(shape)
    count = total().astype(float)
    full = count > 0
    if full.sum() < 4:
        return whole
    tops = np.zeros(shape[0] * shape[1])
    np.maximum.at(tops, flat, top_hat)
    metric = np.zeros(shape)
    metric[full] = 0.60 * unit_interval(total(score)[full] / count[full]) + 0.25 * unit_interval(tops.reshape(shape)[full]) + 0.15 * unit_interval(total(relief)[full] / count[full])
    smooth = np.where(full, _smooth(metric * count, s["sigma"]) / np.maximum(_smooth(count, s["sigma"]), M.EPS), 0.0)
    pad = np.pad(smooth, 1, mode="edge")
    near = np.max([pad[i : i + shape[0], j : j + shape[1]] for i in range(3) for j in range(3)], axis=0)
    at = np.argwhere(full & (smooth >= np.quantile(smooth[full], s["marker_quantile"])) & (smooth >= near - 1e-9))
    if len(at) < s["min_markers"]:
        return whole
    groups = _peaks_joined(at.astype(float), max(1.0, s["peak_fraction"] * radius / cell))
    groups.sort(key=lambda k: -max(smooth[tuple(at[i])] for i in k))
    markers = np.zeros(shape, np.int64)
    for n, group in enumerate(groups[: s["max_markers"]], 1):
        for i in group:
            markers[tuple(at[i])] = n
    if markers.max() < s["min_markers"]:
        return whole
    cost = np.full(shape, 255)
    cost[full] = np.clip(np.rint(255 * (1 - smooth[full])), 0, 255)
    part = np.where(full, _flood(cost, markers), 0)[g[:, 1], g[:, 0]]
    if (part > 0).sum() < max(2 * min_seeds, s["min_points"]):
        return whole
    good = [k for k in np.unique(part[part > 0]) if (part == k).sum() >= max(s["min_points"], 2 * min_seeds) and seed[part == k].sum() >= min_seeds]
    return np.where(np.isin(part, good), part, -1) if len(good) >= 2 else whole
