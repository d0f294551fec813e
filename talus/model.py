"""Parameters with their defaults, and constants: fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

EPS = 1e-12
RADIUS_CORRECTION = 5 / 6
MATLAB_DENOISE = (4, 1.0)
BLOCK_WEIGHTS = [-0.023834724887191214, 0.3749972213604831, 0.16049088185639013, 0.1526697997514414, 0.019609862134321893, -0.03296003735371144, 0.1904630084496496]
BLOCK_FEATURES = ["top_hat", "local_relief", "local_zstd", "scattering", "curvature_mean", "curvature_max", "planarity_mean"]
BLOCK_BIAS = -0.09309884486786109
SUPPORT, SEED_SCORE, GROW_SCORE = 0.48, 0.56, 0.45
CONNECT_FACTOR, GROW_FACTOR = 2.5, 1.25
SMRF = {"cell_factor": 3.0, "min_cell": 0.5, "max_cells": 6_000_000, "window": 12.0, "height": 0.35, "slope": 0.75}
SPLIT = {
    "size_quantile": 0.9997,
    "min_factor": 20,
    "marker_quantile": 0.92,
    "grid_factor": 1.0,
    "sigma": 1.25,
    "peak_fraction": 0.9,
    "min_points": 12,
    "min_markers": 2,
    "max_markers": 48,
}


@dataclass(frozen=True)
class Parameters:
    name: str = ""
    iplot: bool = True
    saveplot: bool = True
    denoise: bool = True
    decimate: bool = False
    minima: bool = False
    rotdetrend: bool = True
    clean: bool = True
    gridbynumber: bool = True
    savegranulo: bool = True
    savegrain: bool = True
    res: float = 0.002
    nscale: int = 4
    minscale: float = 0.04
    maxscale: float = 2.0
    nnptcloud: int = 20
    radfactor: float = 0.6
    maxangle1: float = 60.0
    maxangle2: float = 10.0
    minflatness: float = 0.1
    fitmethod: str = "direct"
    aquality_thresh: float = 10.0
    mindiam: float = 0.04
    naxis: int = 2
    nmin: int = 50
    dx_gbn: float = 0.0

    @property
    def minnpoint(self) -> int:
        return max(self.nnptcloud, self.nmin)


#: Columns of a parameter table whose names differ from the fields.
COLUMNS = {"name": "Name", "radfactor": "cf", "aquality_thresh": "Aquality_thresh"}
