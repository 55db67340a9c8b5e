"""The rotated rectangle of least area around a polygon: convex hull, then one rectangle for each hull edge, one side of which lies on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the leftmost; points on an edge aren't corners."""
    rows = np.unique(points, axis=0)
    if len(rows) < 3:
        return rows

    def chain(ordered: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(rows) + chain(rows[::-1]))


def least_rectangle(points: np.ndarray) -> np.ndarray:
    """Four corners of the rectangle of least area, of equal ones that of the first hull edge; a point or a line has area 0."""
    corners = hull(points)
    edges = np.roll(corners, -1, axis=0) - corners
    edges = edges[np.hypot(*edges.T) > 0] if len(corners) > 1 else np.array([[1.0, 0.0]])
    along = edges / np.hypot(edges[:, 0], edges[:, 1])[:, None]
    across = np.stack([-along[:, 1], along[:, 0]], 1)
    u, v = corners @ along.T, corners @ across.T  # points x edges
    best = int(np.argmin(np.round((u.max(0) - u.min(0)) * (v.max(0) - v.min(0)), 9)))
    at = lambda a, b: a * along[best] + b * across[best]
    low, high, near, far = u[:, best].min(), u[:, best].max(), v[:, best].min(), v[:, best].max()
    return np.array([at(low, near), at(high, near), at(high, far), at(low, far)])


def _hulls(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``hull`` of many polygons of as many different, sorted points (polygons x points x 2): numbers of their corners, and how many there are."""
    n, each = rows.shape[1], np.arange(len(rows))
    if n < 3:
        return np.tile(np.arange(n), (len(rows), 1)), np.full(len(rows), n)
    found, size = np.empty((len(rows), 2 * n), np.int64), np.zeros(len(rows), np.int64)
    for order in (range(n), range(n - 1, -1, -1)):
        base = size.copy()
        for t in order:
            left = np.flatnonzero(size - base > 1)
            while len(left):
                a, b, p = rows[left, found[left, size[left] - 2]], rows[left, found[left, size[left] - 1]], rows[left, t]
                left = left[(b[:, 0] - a[:, 0]) * (p[:, 1] - a[:, 1]) <= (b[:, 1] - a[:, 1]) * (p[:, 0] - a[:, 0])]
                size[left] -= 1
                left = left[size[left] - base[left] > 1]
            found[each, size] = t
            size += 1
        size -= 1  # a chain's last point is the other's first
    return found, size


def _rectangles(corners: np.ndarray) -> np.ndarray:
    """``least_rectangle`` of many hulls of as many corners (hulls x corners x 2)."""
    edges = np.roll(corners, -1, axis=1) - corners if corners.shape[1] > 1 else np.tile([[[1.0, 0.0]]], (len(corners), 1, 1))
    along = edges / np.hypot(edges[..., 0], edges[..., 1])[..., None]
    across = np.stack([-along[..., 1], along[..., 0]], -1)
    on = lambda axis: corners[:, :, None, 0] * axis[:, None, :, 0] + corners[:, :, None, 1] * axis[:, None, :, 1]
    u, v = on(along), on(across)  # hulls x points x edges
    low, high, near, far = u.min(1), u.max(1), v.min(1), v.max(1)
    best = np.argmin(np.round((high - low) * (far - near), 9), axis=1)
    pick = lambda a: a[np.arange(len(a)), best]
    at = lambda a, b: pick(a)[:, None] * pick(along) + pick(b)[:, None] * pick(across)
    return np.stack([at(low, near), at(high, near), at(high, far), at(low, far)], 1)


def least_rectangles(points: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """``least_rectangle`` of many polygons at once (count x 4 x 2): ``owner`` numbers each point's polygon. Those of one size go together."""
    out = np.full((count, 4, 2), np.nan)
    odd = np.unique(owner[~np.isfinite(points).all(1)])
    for k in odd:
        out[k] = least_rectangle(points[owner == k])
    even = ~np.isin(owner, odd)
    points, owner = points[even], owner[even]
    order = np.lexsort((points[:, 1], points[:, 0], owner))
    points, owner = points[order], owner[order]
    new = np.ones(len(points), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (points[1:] != points[:-1]).any(1)
    points, owner = points[new], owner[new]
    ids, first, sizes = np.unique(owner, return_index=True, return_counts=True)
    for n in np.unique(sizes):
        mine = np.flatnonzero(sizes == n)
        rows = points[first[mine][:, None] + np.arange(n)]
        found, corners = _hulls(rows)
        for h in np.unique(corners):
            at = np.flatnonzero(corners == h)
            out[ids[mine[at]]] = _rectangles(rows[at[:, None], found[at, :h]])
    return out


def _clockwise(quads: np.ndarray) -> np.ndarray:
    """``geometry.clockwise`` of many quads."""
    by_x = np.take_along_axis(quads, np.lexsort((quads[..., 1], quads[..., 0]), axis=-1)[..., None], 1)
    left, right = (np.take_along_axis(s, np.lexsort((s[..., 0], s[..., 1]), axis=-1)[..., None], 1) for s in (by_x[:, :2], by_x[:, 2:]))
    return np.stack([left[:, 0], right[:, 0], right[:, 1], left[:, 1]], 1)


@F.arrow_udf(ArrayType(ArrayType(DoubleType())))
def _least(polygons: pa.Array) -> pa.Array:
    pairs = polygons.flatten()
    if (np.asarray(pairs.value_lengths()) != 2).any():
        raise ValueError("points have two numbers each")
    points = pairs.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    sizes = polygons.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    found = _clockwise(least_rectangles(points, np.repeat(np.arange(len(sizes)), sizes), len(sizes)))
    none = sizes == 0
    corners = found[~none].reshape(-1)
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(corners) + 1, 2), pa.int32()), pa.array(corners))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~none * 4)]), pa.int32()), inner, mask=pa.array(none))


def least_quad(polygon: Column | str) -> Column:
    """The least rectangle around an array of points (two numbers each), clockwise from the top left; null without points."""
    points = F.col(polygon) if isinstance(polygon, str) else polygon
    return _least(points.cast("array<array<double>>"))


def quad_area(quad: Column | str) -> Column:
    """The area of four corners in order."""
    q = F.col(quad) if isinstance(quad, str) else quad
    cross = lambda a, b: a[0] * b[1] - a[1] * b[0]
    return F.abs(cross(q[0], q[1]) + cross(q[1], q[2]) + cross(q[2], q[3]) + cross(q[3], q[0])) / 2


def crop_size(quad: Column | str) -> Column:
    """struct(width, height, turned): whole lengths of the longer sides of a crop along the quad, and whether it is so high that it is turned."""
    q = F.col(quad) if isinstance(quad, str) else quad
    far = lambda a, b: F.hypot(a[0] - b[0], a[1] - b[1])
    w, h = F.floor(F.greatest(far(q[0], q[1]), far(q[2], q[3]))), F.floor(F.greatest(far(q[0], q[3]), far(q[1], q[2])))
    return F.struct(w.alias("width"), h.alias("height"), ((h > 0) & (h / F.greatest(w, F.lit(1)) >= 1.5)).alias("turned"))
