"""Planar geometry of polygons kept as rings: array<array<struct<x: double, y: double>>>.

A ring may or may not repeat its first point.  The first ring is the outer one;
centroids sum the signed areas of all rings, so holes must run the other way.
Parts of a multi-part polygon are further outer rings.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.expr import let

RINGS = "array<array<struct<x:double,y:double>>>"


def unit_square(x: Column, y: Column) -> Column:
    corner = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    return F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)))


def _segments(rings: Column) -> Column:
    """array<struct<ax, ay, bx, by>> of all rings, closed."""

    def ring(r: Column) -> Column:
        after = lambda i: F.coalesce(F.get(r, i + 1), F.get(r, F.lit(0)))
        seg = lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), after(i)["x"].alias("bx"), after(i)["y"].alias("by"))
        return F.filter(F.transform(r, seg), lambda s: (s["ax"] != s["bx"]) | (s["ay"] != s["by"]))

    return F.flatten(F.transform(rings, ring))


def centroid(rings: Column) -> Column:
    """struct<x, y>: area centroid; the mean of the vertices if the area is 0."""

    def of(s: Column) -> Column:
        cross = lambda t: t["ax"] * t["by"] - t["bx"] * t["ay"]
        total = lambda f: F.aggregate(s, F.lit(0.0), lambda acc, t: acc + f(t))
        n = F.greatest(F.size(s), F.lit(1))
        area = total(cross)
        mean = lambda c: total(lambda t: t[f"a{c}"]) / n
        weighted = lambda c: total(lambda t: (t[f"a{c}"] + t[f"b{c}"]) * cross(t)) / (3 * F.nullif(area, F.lit(0.0)))
        return F.struct(F.coalesce(weighted("x"), mean("x")).alias("x"), F.coalesce(weighted("y"), mean("y")).alias("y"))

    return let(_segments(rings), of)


def bbox(rings: Column) -> Column:
    """struct<x0, y0, x1, y1>."""
    points = F.flatten(rings)
    side = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.struct(side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))


def vertices(polygons: DataFrame, node: str = "node_id", rings: str = "rings") -> DataFrame:
    """`(node_id, x, y)`: the different vertices of each polygon."""
    return polygons.select(F.col(node).alias("node_id"), F.explode(F.array_distinct(F.flatten(rings))).alias("p")).select("node_id", "p.x", "p.y")


def segments(polygons: DataFrame, node: str = "node_id", rings: str = "rings") -> DataFrame:
    return polygons.select(F.col(node).alias("node_id"), F.explode(_segments(F.col(rings))).alias("s")).select("node_id", "s.*")


def wkb_rings(data: bytes | None) -> list | None:
    """Rings of a WKB polygon or multi-polygon, either byte order; None for null.  Z, M and SRID, ISO or extended, are read over."""
    if data is None:
        return None
    at = 0

    def take(fmt: str):
        nonlocal at
        out = struct.unpack_from(order + fmt, data, at)
        at += struct.calcsize(order + fmt)
        return out

    def geometry() -> list:
        nonlocal at, order
        order = "<" if data[at] == 1 else ">"
        at += 1
        (kind,) = take("I")
        if kind & 0x20000000:
            take("I")  # SRID
        plain, more = kind & 0x1FFFFFFF, bool(kind & 0x80000000) + bool(kind & 0x40000000)
        more += {0: 0, 1: 1, 2: 1, 3: 2}.get(plain // 1000, 0)
        kind = plain % 1000
        (n,) = take("I")
        if kind == 6:
            return [r for _ in range(n) for r in geometry()]
        if kind != 3:
            raise ValueError(f"WKB type {kind} is neither a polygon nor a multi-polygon")
        return [_ring(take, 2 + more) for _ in range(n)]

    order = "<"
    return geometry()


def _ring(take, width: int) -> list:
    (n,) = take("I")
    flat = take(f"{width * n}d")
    points = [{"x": flat[i], "y": flat[i + 1]} for i in range(0, width * n, width)]
    return points[:-1] if n > 1 and points[0] == points[-1] else points


def _inside(p: np.ndarray, segs: np.ndarray, eps: float) -> np.ndarray:
    """Points strictly inside the polygon of the segments (even-odd), off its boundary by more than eps."""
    a, b = segs[None, :, :2], segs[None, :, 2:]
    q = p[:, None, :]
    d, t = b - a, q - a
    share = np.clip((t * d).sum(-1) / (d * d).sum(-1), 0, 1)
    off = np.sqrt(((t - share[..., None] * d) ** 2).sum(-1)).min(axis=1)
    spans = (a[..., 1] > q[..., 1]) != (b[..., 1] > q[..., 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = a[..., 0] + (q[..., 1] - a[..., 1]) / d[..., 1] * d[..., 0]
    return ((spans & (q[..., 0] < x)).sum(axis=1) % 2 == 1) & (off > eps)


def relation(a: np.ndarray, b: np.ndarray, eps: float = 1e-9) -> tuple[bool, int, float]:
    """For the segments (n x 4) of two polygons: whether interiors meet, the dimension in which boundaries meet (-1: not), and the shared length."""
    length, dim = 0.0, -1
    cuts: tuple[list, list] = ([[0.0, 1.0] for _ in a], [[0.0, 1.0] for _ in b])
    for i, s in enumerate(a):
        p, r = s[:2], s[2:] - s[:2]
        n = np.hypot(*r)
        for j, u in enumerate(b):
            q, v = u[:2], u[2:] - u[:2]
            m, cross = np.hypot(*v), r[0] * v[1] - r[1] * v[0]
            w = q - p
            if abs(cross) > eps * n * m:
                t, k = (w[0] * v[1] - w[1] * v[0]) / cross, (w[0] * r[1] - w[1] * r[0]) / cross
                if -eps / n <= t <= 1 + eps / n and -eps / m <= k <= 1 + eps / m:
                    dim = max(dim, 0)
                    cuts[0][i].append(min(max(t, 0), 1))
                    cuts[1][j].append(min(max(k, 0), 1))
            elif abs(w[0] * r[1] - w[1] * r[0]) <= eps * n:
                t0, t1 = sorted(((w @ r) / n**2, ((w + v) @ r) / n**2))
                low, high = max(t0, 0.0), min(t1, 1.0)
                if high >= low - eps / n:
                    dim = max(dim, 1 if (high - low) * n > eps else 0)
                    length += max(0.0, high - low) * n
                    cuts[0][i] += [min(max(low, 0), 1), min(max(high, 0), 1)]
                    cuts[1][j] += [min(max(((p + x * r - q) @ v) / m**2, 0), 1) for x in (low, high)]

    def middles(segs, parts):
        out = []
        for s, c in zip(segs, parts):
            c = np.unique(c)
            out += [s[:2] + (x + y) / 2 * (s[2:] - s[:2]) for x, y in zip(c, c[1:]) if y - x > eps]
        return np.array(out).reshape(-1, 2)

    meet = bool(_inside(middles(a, cuts[0]), b, eps).any() or _inside(middles(b, cuts[1]), a, eps).any())
    if not meet and dim == 1:  # equal outlines: a point just inside a, at any of its sides
        mid, d = (a[:, :2] + a[:, 2:]) / 2, a[:, 2:] - a[:, :2]
        side = np.stack([-d[:, 1], d[:, 0]], axis=1) * 1e-4
        near = np.concatenate([mid + side, mid - side])
        near = near[_inside(near, a, 0.0)]
        meet = bool(len(near) and _inside(near, b, 0.0).any())
    return meet, dim, length


def relations(a: np.ndarray, b: np.ndarray, eps: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`relation` of many pairs at once, `a` (pairs x n x 4) and `b` (pairs x m x 4)."""
    n_a, n_b = a.shape[1], b.shape[1]
    p, r = a[:, :, None, :2], (a[..., 2:] - a[..., :2])[:, :, None]
    q, v = b[:, None, :, :2], (b[..., 2:] - b[..., :2])[:, None]
    n, m = np.hypot(r[..., 0], r[..., 1]), np.hypot(v[..., 0], v[..., 1])
    w = q - p
    cross = r[..., 0] * v[..., 1] - r[..., 1] * v[..., 0]
    wr, wv = w[..., 0] * r[..., 1] - w[..., 1] * r[..., 0], w[..., 0] * v[..., 1] - w[..., 1] * v[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, k = wv / cross, wr / cross
        crossing = np.abs(cross) > eps * n * m
        point = crossing & (-eps / n <= t) & (t <= 1 + eps / n) & (-eps / m <= k) & (k <= 1 + eps / m)
        t0, t1 = (w * r).sum(-1) / n**2, ((w + v) * r).sum(-1) / n**2
        low, high = np.maximum(np.minimum(t0, t1), 0.0), np.minimum(np.maximum(t0, t1), 1.0)
        along = ~crossing & (np.abs(wr) <= eps * n) & (high >= low - eps / n)
        back = [((p + x[..., None] * r - q) * v).sum(-1) / m**2 for x in (low, high)]
    dim = np.where(along, np.where((high - low) * n > eps, 1, 0), np.where(point, 0, -1)).reshape(len(a), -1).max(axis=1)
    length = np.where(along, np.maximum(0.0, high - low) * n, 0.0).reshape(len(a), -1).sum(axis=1)

    def middles(segs, cuts):
        """Middle points of the parts of each segment, NaN for a part of no length."""
        ends = np.zeros(cuts[0].shape[:2] + (1,))
        c = np.sort(np.concatenate([ends, ends + 1, *cuts], axis=2), axis=2)
        x, y = c[..., :-1], c[..., 1:]
        mid = np.where(y - x > eps, (x + y) / 2, np.nan)[..., None]
        return (segs[:, :, None, :2] + mid * (segs[..., 2:] - segs[..., :2])[:, :, None]).reshape(len(segs), -1, 2)

    pick = lambda x, y: np.clip(np.where(point, x, np.where(along, y, 0.0)), 0, 1)
    also = lambda y: np.clip(np.where(along, y, 0.0), 0, 1)
    meet = _any_inside(middles(a, [pick(t, low), also(high)]), b, eps)
    meet |= _any_inside(middles(b, [x.transpose(0, 2, 1) for x in (pick(k, back[0]), also(back[1]))]), a, eps)
    if (same := np.flatnonzero(~meet & (dim == 1))).size:  # equal outlines: a point just inside a, at any of its sides
        s = a[same]
        mid, d = (s[..., :2] + s[..., 2:]) / 2, s[..., 2:] - s[..., :2]
        side = np.stack([-d[..., 1], d[..., 0]], axis=-1) * 1e-4
        near = np.concatenate([mid + side, mid - side], axis=1)
        near = np.where(_each_inside(near, s, 0.0)[..., None], near, np.nan)
        meet[same] = _any_inside(near, b[same], 0.0)
    return meet, dim, length


def _each_inside(points: np.ndarray, segs: np.ndarray, eps: float) -> np.ndarray:
    """`_inside` of many polygons at once: points (pairs x k x 2), segs (pairs x n x 4); a NaN point lies in none."""
    a, b = segs[:, None, :, :2], segs[:, None, :, 2:]
    q = points[:, :, None, :]
    d, t = b - a, q - a
    share = np.clip((t * d).sum(-1) / (d * d).sum(-1), 0, 1)
    off = np.sqrt(((t - share[..., None] * d) ** 2).sum(-1)).min(axis=2)
    spans = (a[..., 1] > q[..., 1]) != (b[..., 1] > q[..., 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = a[..., 0] + (q[..., 1] - a[..., 1]) / d[..., 1] * d[..., 0]
        return ((spans & (q[..., 0] < x)).sum(axis=2) % 2 == 1) & (off > eps)


def _any_inside(points: np.ndarray, segs: np.ndarray, eps: float) -> np.ndarray:
    """Whether any of a pair's points lies inside the pair's polygon; only points in its box are looked at."""
    x, y = points[..., 0], points[..., 1]
    ends = [segs[..., 0::2], segs[..., 1::2]]
    (x0, y0), (x1, y1) = ([f(e.reshape(len(segs), -1), axis=1)[:, None] for e in ends] for f in (np.min, np.max))
    which, k = np.nonzero((x > x0) & (x < x1) & (y > y0) & (y < y1))
    out = np.zeros(len(segs), bool)
    out[which[_each_inside(points[which, k][:, None], segs[which], eps)[:, 0]]] = True
    return out
