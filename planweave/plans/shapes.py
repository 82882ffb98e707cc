"""Exact arithmetic of rectilinear regions, for plan-sized inputs inside one group.

A region is an array of disjoint boxes (x0, y0, x1, y1). Two regions meet on the grid of all
their coordinates, where union, difference and intersection are boolean masks; connected
parts and outlines come from the same mask. A plan has tens of boxes, so grids stay small."""

from __future__ import annotations

import numpy as np

Box = tuple[float, float, float, float]
EMPTY = np.zeros((0, 4))


def boxes(items) -> np.ndarray:
    out = np.asarray(list(items), float).reshape(-1, 4)
    return out[(out[:, 2] > out[:, 0] + 1e-12) & (out[:, 3] > out[:, 1] + 1e-12)]


def axes(*regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([r for r in regions]) if regions else EMPTY

    def merged(v: np.ndarray) -> np.ndarray:
        v = np.unique(v)
        return v[np.concatenate([[True], np.diff(v) > 1e-9])] if len(v) else v

    return merged(every[:, [0, 2]].ravel()), merged(every[:, [1, 3]].ravel())


def mask(region: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """[i, j]: whether the cell from xs[i], ys[j] is covered."""
    nx, ny = max(0, len(xs) - 1), max(0, len(ys) - 1)
    d = np.zeros((nx + 1, ny + 1), int)
    for x0, y0, x1, y1 in region:
        i0, i1 = np.searchsorted(xs, [x0 - 1e-9, x1 - 1e-9])
        j0, j1 = np.searchsorted(ys, [y0 - 1e-9, y1 - 1e-9])
        d[i0, j0] += 1
        d[i1, j0] -= 1
        d[i0, j1] -= 1
        d[i1, j1] += 1
    return d.cumsum(0).cumsum(1)[:nx, :ny] > 0


def from_mask(m: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Disjoint boxes, runs along y joined."""
    out = []
    for i in range(m.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], m[i].astype(int), [0]])))
        out += [(xs[i], ys[a], xs[i + 1], ys[b]) for a, b in zip(edge[::2], edge[1::2])]
    return boxes(out)


def union(*regions: np.ndarray) -> np.ndarray:
    xs, ys = axes(*regions)
    return from_mask(mask(np.concatenate(regions), xs, ys), xs, ys) if len(xs) else EMPTY


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    xs, ys = axes(a, b)
    return from_mask(mask(a, xs, ys) & ~mask(b, xs, ys), xs, ys) if len(xs) else EMPTY


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    xs, ys = axes(a, b)
    return from_mask(mask(a, xs, ys) & mask(b, xs, ys), xs, ys) if len(xs) else EMPTY


def area(region: np.ndarray) -> float:
    """Area, overlaps counted once."""
    u = union(region) if len(region) > 1 else region
    return float(((u[:, 2] - u[:, 0]) * (u[:, 3] - u[:, 1])).sum())


def grow(region: np.ndarray, r: float) -> np.ndarray:
    """Square dilation; a negative ``r`` erodes."""
    if r >= 0:
        return union(region + np.array([-r, -r, r, r])) if len(region) else EMPTY
    if not len(region):
        return EMPTY
    x0, y0, x1, y1 = region[:, 0].min() - 1, region[:, 1].min() - 1, region[:, 2].max() + 1, region[:, 3].max() + 1
    outside = minus(boxes([(x0, y0, x1, y1)]), region)
    return minus(region, outside + np.array([r, r, -r, -r]))


def labels(m: np.ndarray, barrier_x: np.ndarray | None = None, barrier_y: np.ndarray | None = None) -> np.ndarray:
    """4-connected components of a mask, -1 outside; barriers[i, j] close the edge after cell (i, j)."""
    out = np.full(m.shape, -1)
    k = 0
    for start in zip(*np.nonzero(m)):
        if out[start] >= 0:
            continue
        stack = [start]
        out[start] = k
        while stack:
            i, j = stack.pop()
            for a, b, shut in (
                (i + 1, j, barrier_x is not None and i < barrier_x.shape[0] and barrier_x[i, j]),
                (i - 1, j, barrier_x is not None and i > 0 and barrier_x[i - 1, j]),
                (i, j + 1, barrier_y is not None and j < barrier_y.shape[1] and barrier_y[i, j]),
                (i, j - 1, barrier_y is not None and j > 0 and barrier_y[i, j - 1]),
            ):
                if not shut and 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and m[a, b] and out[a, b] < 0:
                    out[a, b] = k
                    stack.append((a, b))
        k += 1
    return out


def parts(region: np.ndarray) -> list[np.ndarray]:
    """Connected parts, largest first."""
    xs, ys = axes(region)
    if not len(xs):
        return []
    lab = labels(mask(region, xs, ys))
    return sorted((from_mask(lab == k, xs, ys) for k in range(lab.max() + 1)), key=lambda r: -area(r))


def outline(region: np.ndarray) -> list[list[tuple[float, float]]]:
    """Rings of a connected region: the outer one counter-clockwise first, holes after it clockwise."""
    xs, ys = axes(region)
    m = np.pad(mask(region, xs, ys), 1)
    step: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j in zip(*np.nonzero(m)):
        a, b = i - 1, j - 1
        if not m[i, j - 1]:
            step.setdefault((a, b), []).append((a + 1, b))
        if not m[i + 1, j]:
            step.setdefault((a + 1, b), []).append((a + 1, b + 1))
        if not m[i, j + 1]:
            step.setdefault((a + 1, b + 1), []).append((a, b + 1))
        if not m[i - 1, j]:
            step.setdefault((a, b + 1), []).append((a, b))
    rings = []
    while step:
        at = min(step)
        ring, before = [], None
        while at in step:
            options = step[at]
            # where two corners touch, keep turning left so that parts stay simple
            if len(options) > 1 and before is not None:
                d = (at[0] - before[0], at[1] - before[1])
                options.sort(key=lambda n: -(d[0] * (n[1] - at[1]) - d[1] * (n[0] - at[0])))
            nxt = options.pop(0)
            if not options:
                del step[at]
            ring.append((float(xs[at[0]]), float(ys[at[1]])))
            before, at = at, nxt
        rings.append(corners(ring))
    rings.sort(key=lambda r: -abs(ring_area(r)))
    return [r if (ring_area(r) > 0) == (k == 0) else r[::-1] for k, r in enumerate(rings)]


def corners(ring: list[tuple[float, float]], tol: float = 1e-9) -> list[tuple[float, float]]:
    """The ring without repeated and collinear vertices."""
    pts = [p for k, p in enumerate(ring) if abs(p[0] - ring[k - 1][0]) > 1e-6 or abs(p[1] - ring[k - 1][1]) > 1e-6]
    out = []
    for k, b in enumerate(pts):
        a, c = pts[k - 1], pts[(k + 1) % len(pts)]
        if abs((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])) > tol:
            out.append(b)
    return out if len(out) >= 3 else pts


def ring_area(ring) -> float:
    p = np.asarray(ring, float)
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def region_of(ring, holes=()) -> np.ndarray:
    """Boxes of a rectilinear polygon: even-odd over the grid of its coordinates."""
    rings = [np.asarray(r, float) for r in (ring, *holes)]
    xs, ys = np.unique(np.concatenate(rings)[:, 0]), np.unique(np.concatenate(rings)[:, 1])
    cx, cy = (xs[1:] + xs[:-1]) / 2, (ys[1:] + ys[:-1]) / 2
    inside = np.zeros((len(cx), len(cy)), bool)
    for r in rings:
        q = np.roll(r, -1, axis=0)
        for (ax, ay), (bx, by) in zip(r, q):
            if abs(ay - by) > 1e-12:  # an upright edge flips everything to its left
                x_at = ax + (cy - ay) / (by - ay) * (bx - ax)
                hit = (ay > cy) != (by > cy)
                inside ^= (cx[:, None] < x_at[None, :]) & hit[None, :]
    return from_mask(inside, xs, ys)


def contains(region: np.ndarray, x: float, y: float) -> bool:
    return bool(((region[:, 0] <= x) & (x <= region[:, 2]) & (region[:, 1] <= y) & (y <= region[:, 3])).any())


def edge_distance(rings, x: float, y: float) -> float:
    """Distance of a point from outlines."""
    best = np.inf
    for r in rings:
        p = np.asarray(r, float)
        d = np.roll(p, -1, axis=0) - p
        t = np.clip(((x - p[:, 0]) * d[:, 0] + (y - p[:, 1]) * d[:, 1]) / np.maximum((d**2).sum(1), 1e-30), 0, 1)
        best = min(best, float(np.hypot(p[:, 0] + t * d[:, 0] - x, p[:, 1] + t * d[:, 1] - y).min()))
    return best


def along(region: np.ndarray, a, b) -> list[tuple[float, float]]:
    """Stations of an axis-parallel segment that lie in a region, as merged intervals from ``a``."""
    (ax, ay), (bx, by) = a, b
    length = float(np.hypot(bx - ax, by - ay))
    if length == 0 or not len(region):
        return []
    if abs(bx - ax) >= abs(by - ay):
        hit = region[(region[:, 1] <= ay + 1e-9) & (region[:, 3] >= ay - 1e-9)]
        spans = hit[:, [0, 2]] - ax if bx > ax else ax - hit[:, [2, 0]]
    else:
        hit = region[(region[:, 0] <= ax + 1e-9) & (region[:, 2] >= ax - 1e-9)]
        spans = hit[:, [1, 3]] - ay if by > ay else ay - hit[:, [3, 1]]
    spans = np.clip(spans, 0, length)
    return merge([(float(s), float(e)) for s, e in spans if e > s], 1e-9)


def merge(intervals: list[tuple[float, float]], gap: float) -> list[tuple[float, float]]:
    out: list[list[float]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def rest(length: float, covered: list[tuple[float, float]], least: float = 0.0) -> list[tuple[float, float]]:
    """What intervals leave of [0, length]."""
    out, at = [], 0.0
    for a, b in covered:
        if a - at > least:
            out.append((at, a))
        at = max(at, b)
    if length - at > least:
        out.append((at, length))
    return out


def without_jogs(ring, min_edge: float, keep: float = 0.6):
    """An axis-parallel ring without edges shorter than ``min_edge``: the shortest one goes, its
    two neighbours meeting on the line of the longer; given up if too much area goes."""
    start = corners([tuple(map(float, p)) for p in ring])
    pts = start if ring_area(start) >= 0 else start[::-1]
    for _ in range(200):
        n = len(pts)
        if n <= 4:
            break
        p = np.array(pts)
        lengths = np.abs(np.roll(p, -1, axis=0) - p).sum(1)
        k = int(lengths.argmin())
        if lengths[k] >= min_edge:
            break
        order = [pts[(k + s) % n] for s in range(-1, n - 1)]  # the short edge joins order[1] and order[2]
        a, b, c, d = order[:4]
        axis = 1 if abs(b[0] - a[0]) >= abs(b[1] - a[1]) else 0
        first = abs(b[0] - a[0]) + abs(b[1] - a[1]) >= abs(d[0] - c[0]) + abs(d[1] - c[1])
        line = b[axis] if first else c[axis]
        fix = lambda q: (q[0], line) if axis == 1 else (line, q[1])  # noqa: B023, E731
        pts = corners([fix(a) if not first else a, fix(d) if first else d, *order[4:]])
    if len(pts) < 4 or abs(ring_area(pts)) < keep * abs(ring_area(start)):
        return ring
    return pts


def snapped(ring, walls, reach: float = 2.5, min_overlap: float = 0.35):
    """Each edge of a counter-clockwise axis-parallel ring on the inner face of the parallel wall
    within ``reach`` that covers most of it (ties: the nearer). ``walls`` are (a, b, thickness)."""
    pts = [tuple(map(float, p)) for p in ring]
    if ring_area(pts) < 0:
        pts = pts[::-1]
    p = np.array(pts)
    d = np.roll(p, -1, axis=0) - p
    length = np.hypot(d[:, 0], d[:, 1])
    unit = d / np.maximum(length, 1e-12)[:, None]
    out_dir = np.stack([unit[:, 1], -unit[:, 0]], 1)
    move = np.zeros(len(p))
    for k in range(len(p)):
        best = None
        for a, b, th in walls:
            a, b = np.asarray(a, float), np.asarray(b, float)
            wl = np.hypot(*(b - a))
            if wl < 0.3 or abs((b - a) @ unit[k]) / wl < np.cos(np.radians(10)):
                continue
            off = float((a - p[k]) @ out_dir[k])
            t = sorted(((a - p[k]) @ unit[k], (b - p[k]) @ unit[k]))
            cover = min(length[k], t[1]) - max(0.0, t[0])
            if abs(off) > reach or cover < min_overlap * length[k]:
                continue
            face = off - np.sign(off) * th / 2 if abs(off) > th / 2 else 0.0
            if best is None or (cover, -abs(off)) > best[0]:
                best = ((cover, -abs(off)), face)
        if best is not None:
            move[k] = best[1]
    shift = out_dir * move[:, None]
    moved = p + shift + np.roll(shift, 1, axis=0)
    if abs(ring_area(moved)) < 0.5 * abs(ring_area(pts)) or ring_area(moved) <= 0:
        return ring
    return [tuple(map(float, q)) for q in moved]
