"""Depth pictures to points: a map over frames, then voxel thinning across them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..schemas import POINTS
from .select import voxel_thin


def rays(k: np.ndarray, h: int, w: int, dist: np.ndarray | None = None) -> np.ndarray:
    """Direction with z = 1 of every pixel; lens terms undone by fixed-point rounds."""
    u, v = np.meshgrid(np.arange(w, dtype=float), np.arange(h, dtype=float))
    x0, y0 = (u - k[0, 2]) / k[0, 0], (v - k[1, 2]) / k[1, 1]
    x, y = x0.copy(), y0.copy()
    if dist is not None and np.any(dist):
        k1, k2, p1, p2, k3 = (list(dist) + [0.0] * 5)[:5]
        for _ in range(20):
            r2 = x * x + y * y
            f = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
            x, y = (x0 - 2 * p1 * x * y - p2 * (r2 + 2 * x * x)) / f, (y0 - p1 * (r2 + 2 * y * y) - 2 * p2 * x * y) / f
    return np.stack([x, y, np.ones_like(x)], -1)


def _median5(d: np.ndarray) -> np.ndarray:
    p = np.pad(d, 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (5, 5)).reshape(*d.shape, 25), axis=-1)


def _all_near(ok: np.ndarray, r: int) -> np.ndarray:
    """True where the whole square of radius r inside the picture is true."""
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        ok = np.lib.stride_tricks.sliding_window_view(np.pad(ok, pad, constant_values=True), 2 * r + 1, axis=axis).all(-1)
    return ok


def lift(depth: np.ndarray, k: np.ndarray, pose: np.ndarray, stride: int = 4, near: float = 0.2, far: float = 8.0, edge: float = 0.05, radius: int = 3, smooth: bool = True, dist=None, directions: np.ndarray | None = None):
    """(points, normals, pixels) in the world: pixels of valid depth away from jumps and borders,
    normals from central differences over ``radius`` pixels, facing the camera."""
    valid = np.isfinite(depth) & (depth > near) & (depth < far)
    d = np.where(valid, depth, 0).astype(float)
    d = _median5(d) if smooth else d
    p = d[..., None] * (rays(k, *depth.shape, dist) if directions is None else directions)
    r = max(1, radius)
    h, w = depth.shape
    n = np.zeros_like(p)
    jump = np.ones_like(valid)
    if h > 2 * r and w > 2 * r:
        inner = (slice(r, -r), slice(r, -r))
        across, down = p[r:-r, 2 * r :] - p[r:-r, : -2 * r], p[2 * r :, r:-r] - p[: -2 * r, r:-r]
        n[inner] = np.cross(across, down)
        limit = edge * d[inner]
        jump[inner] = (np.abs(d[r:-r, 2 * r :] - d[r:-r, : -2 * r]) > limit) | (np.abs(d[2 * r :, r:-r] - d[: -2 * r, r:-r]) > limit)
    size = np.linalg.norm(n, axis=-1)
    n /= np.maximum(size, 1e-12)[..., None]
    n *= np.where((n * p).sum(-1) > 0, -1.0, 1.0)[..., None]
    keep = valid & ~jump & _all_near(valid, r) & (size > 0)
    rim = np.zeros_like(keep)
    rim[r + 1 : h - r - 1, r + 1 : w - r - 1] = True
    chosen = np.zeros_like(keep)
    chosen[::stride, ::stride] = True
    v, u = np.nonzero(keep & rim & chosen)
    return p[v, u] @ pose[:3, :3].T + pose[:3, 3], n[v, u] @ pose[:3, :3].T, np.stack([u, v], 1)


def fuse(views: DataFrame, stride: int = 4, voxel: float | None = 0.02, near: float = 0.2, far: float = 8.0, edge: float = 0.05, seed: int = 0, smooth: bool = True) -> DataFrame:
    """``views`` (schema VIEWS; masked pixels don't count) -> points that remember their view,
    one a voxel. Map only up to the thinning; rays are kept per size and intrinsics."""

    def run(batches):
        known: dict = {}
        for b in batches:
            for x in b.itertuples(index=False):
                k, pose = np.array([list(r) for r in x.K], float), np.array([list(r) for r in x.T], float)
                depth = np.asarray(x.depth, float).reshape(x.h, x.w)
                if x.mask is not None:
                    depth = np.where(np.asarray(x.mask, bool).reshape(x.h, x.w), depth, 0)
                key = (x.h, x.w, k.tobytes())
                if key not in known:
                    known = {**known, key: rays(k, x.h, x.w)} if len(known) < 8 else {key: rays(k, x.h, x.w)}
                p, n, px = lift(depth, k, pose, stride, near, far, edge, smooth=smooth, directions=known[key])
                yield pd.DataFrame({
                    "scene_id": x.scene_id, "point_id": x.view_id * 100_000_000 + px[:, 1].astype(np.int64) * x.w + px[:, 0], "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2],
                    "r": pd.array([None] * len(p), "Int16"), "g": pd.array([None] * len(p), "Int16"), "b": pd.array([None] * len(p), "Int16"), "view_id": np.full(len(p), x.view_id, np.int32),
                })

    points = views.mapInPandas(run, POINTS)
    return voxel_thin(points, ["scene_id"], voxel, seed=seed) if voxel else points
