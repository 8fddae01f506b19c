"""Polygon kernels on arrays: a polygon is a list of rings, each an array of (x, y) rows
without the first point at the end; a point is inside where an odd number of rings wind
around it, so parts and holes are rings alike, and crossing rings are valid input.

All overlays cut the plane into level slabs at every corner and crossing.  Inside a slab
no edges cross, so from left to right each stretch between two edges is inside or outside
each polygon as a whole: the result is a list of trapezoids, from which areas, inner points
and outlines follow.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Polygon = list[np.ndarray]
#: Coordinates that differ by less are one.
SNAP = 1e-7


def box(x0: float, y0: float, x1: float, y1: float) -> Polygon:
    return [np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)]


def ring_area(ring: np.ndarray) -> float:
    """Positive if the ring runs counter-clockwise."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _edges(polygons: list[Polygon]) -> tuple[np.ndarray, np.ndarray]:
    """Upward edges (x0, y0, x1, y1) of all polygons, and whose they are."""
    parts, whose = [], []
    for k, polygon in enumerate(polygons):
        for ring in polygon:
            if len(ring) > 2:
                parts.append(np.hstack([ring, np.roll(ring, -1, axis=0)]))
                whose.append(np.full(len(ring), k))
    if not parts:
        return np.zeros((0, 4)), np.zeros(0, np.int64)
    e, w = np.concatenate(parts), np.concatenate(whose)
    keep = np.abs(e[:, 1] - e[:, 3]) > SNAP
    e, w = e[keep], w[keep]
    down = e[:, 1] > e[:, 3]
    e[down] = e[down][:, [2, 3, 0, 1]]
    return e, w


def _levels(e: np.ndarray) -> np.ndarray:
    """Heights of all ends and crossings of edges."""
    ys = [e[:, 1], e[:, 3]]
    d = e[:, 2:] - e[:, :2]
    for i in range(len(e) - 1):
        rest = np.arange(i + 1, len(e))
        rest = rest[(e[rest, 1] < e[i, 3]) & (e[rest, 3] > e[i, 1])]
        if not len(rest):
            continue
        cross = d[i, 0] * d[rest, 1] - d[i, 1] * d[rest, 0]
        some = np.abs(cross) > 1e-12
        rest, cross = rest[some], cross[some]
        gap = e[rest, :2] - e[i, :2]
        t = (gap[:, 0] * d[rest, 1] - gap[:, 1] * d[rest, 0]) / cross
        u = (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / cross
        hit = (t > 0) & (t < 1) & (u > 0) & (u < 1)
        ys.append(e[i, 1] + t[hit] * d[i, 1])
    y = np.unique(np.concatenate(ys))
    return y[np.concatenate(([True], np.diff(y) > SNAP))] if len(y) else y


def overlay(polygons: list[Polygon], wanted: Callable[[np.ndarray], bool]) -> np.ndarray:
    """Trapezoids (y0, y1, left at y0, left at y1, right at y0, right at y1) of the points for
    which ``wanted`` holds, given for each polygon whether they are inside it."""
    e, whose = _edges(polygons)
    out = []
    levels = _levels(e) if len(e) else np.zeros(0)
    for lo, hi in zip(levels[:-1], levels[1:], strict=True):
        mid = (lo + hi) / 2
        on = np.flatnonzero((e[:, 1] < mid) & (e[:, 3] > mid))
        if not len(on):
            continue
        slope = (e[on, 2] - e[on, 0]) / (e[on, 3] - e[on, 1])
        at = lambda y: e[on, 0] + (y - e[on, 1]) * slope  # noqa: B023, E731
        left, right, middle = at(lo), at(hi), at(mid)
        inside, open_ = np.zeros(len(polygons), bool), None
        order = np.argsort(middle, kind="stable")
        # Edges that lie on one another count as one place, so that polygons side by side join.
        last = np.append(np.diff(middle[order]) > SNAP, True)
        for k, ends in zip(order, last, strict=True):
            inside[whose[on[k]]] ^= True
            if not ends:
                continue
            now = bool(wanted(inside))
            if now and open_ is None:
                open_ = k
            elif not now and open_ is not None:
                if middle[k] - middle[open_] > SNAP / 10:
                    out.append((lo, hi, left[open_], right[open_], left[k], right[k]))
                open_ = None
    return np.array(out) if out else np.zeros((0, 6))


def area(t: np.ndarray) -> float:
    return float(((t[:, 1] - t[:, 0]) * (t[:, 4] - t[:, 2] + t[:, 5] - t[:, 3]) / 2).sum())


def inner_point(t: np.ndarray) -> tuple[float, float] | None:
    """A point inside: the middle of the trapezoid with the widest middle."""
    if not len(t):
        return None
    left, right = (t[:, 2] + t[:, 3]) / 2, (t[:, 4] + t[:, 5]) / 2
    k = int(np.argmax(right - left))
    return float((left[k] + right[k]) / 2), float((t[k, 0] + t[k, 1]) / 2)


def rings(t: np.ndarray) -> Polygon:
    """The outlines of trapezoids: outer rings counter-clockwise, holes clockwise."""
    snap = lambda x, y: (round(float(x), 6), round(float(y), 6))
    edges: list[tuple] = []
    for y0, y1, l0, l1, r0, r1 in t:
        edges += [(snap(r0, y0), snap(r1, y1)), (snap(l1, y1), snap(l0, y0))]
    levels = np.unique(np.round(np.concatenate([t[:, 0], t[:, 1]]), 6)) if len(t) else []
    for y in levels:
        above, below = t[np.abs(t[:, 0] - y) < 1e-6], t[np.abs(t[:, 1] - y) < 1e-6]
        spans = [(a, b, 1) for a, b in above[:, [2, 4]]] + [(a, b, -1) for a, b in below[:, [3, 5]]]
        cuts = np.unique(np.round([v for s in spans for v in s[:2]], 6))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            m = (a + b) / 2
            up, down = any(s[0] < m < s[1] for s in spans if s[2] == 1), any(s[0] < m < s[1] for s in spans if s[2] == -1)
            if up != down:
                edges.append((snap(a, y), snap(b, y)) if up else (snap(b, y), snap(a, y)))
    out: dict[tuple, list[tuple]] = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, []).append(b)
    found = []
    while out:
        start = at = min(out)
        ring, came = [], None
        while at in out:
            choice = out[at]
            if came and len(choice) > 1:
                angle = lambda n: (np.arctan2(n[1] - at[1], n[0] - at[0]) - np.arctan2(came[1] - at[1], came[0] - at[0])) % (2 * np.pi)  # noqa: B023, E731
                to = max(choice, key=angle)
            else:
                to = choice[0]
            choice.remove(to)
            if not choice:
                del out[at]
            ring.append(at)
            came, at = at, to
            if at == start:
                break
        ring = straight(np.array(ring))
        if len(ring) > 2 and abs(ring_area(ring)) > 1e-4:  # less is what rounding leaves
            found.append(ring)
    return found


def straight(ring: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """A ring without the corners that lie on the line between their neighbours."""
    while len(ring) > 3:
        a, b = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
        off = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) / np.maximum(np.hypot(*(a + b).T), 1e-12)
        drop = np.flatnonzero(off <= tolerance)
        if not len(drop):
            break
        # Of neighbouring corners only every other goes at a time.
        keep = np.ones(len(ring), bool)
        last = -2
        for k in drop:
            if k - last > 1 and not (k == len(ring) - 1 and not keep[0]):
                keep[k], last = False, k
        ring = ring[keep]
    return ring


def both(a: Polygon, b: Polygon) -> np.ndarray:
    return overlay([a, b], lambda s: s[0] and s[1])


def less(a: Polygon, b: Polygon) -> np.ndarray:
    return overlay([a, b], lambda s: s[0] and not s[1])


def union(polygons: list[Polygon]) -> np.ndarray:
    return overlay(polygons, np.any)


def disc(x: float, y: float, radius: float, quarter: int) -> np.ndarray:
    turn = np.arange(4 * quarter) * (np.pi / 2 / quarter)
    return np.stack([x + radius * np.cos(turn), y + radius * np.sin(turn)], axis=1)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    p = np.unique(np.round(points, 9), axis=0)
    if len(p) < 3:
        return p

    def chain(order: np.ndarray) -> list:
        out: list = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def _outline(polygon: Polygon, distance: float, quarter: int) -> list[Polygon]:
    """The edges of a polygon, each as thick as twice the distance, with round ends."""
    out = []
    for ring in polygon:
        for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            out.append([hull(np.concatenate([disc(*a, distance, quarter), disc(*b, distance, quarter)]))])
    return out


def convex(polygon: Polygon) -> np.ndarray | None:
    """The ring of a convex polygon, counter-clockwise from its lowest corner (of several the
    leftmost), or None where the polygon is another one."""
    if len(polygon) != 1:
        return None
    ring = polygon[0]
    ring = ring[np.any(ring != np.roll(ring, 1, axis=0), axis=1)]
    if len(ring) < 3 or abs(ring_area(ring)) <= SNAP:
        return None
    if ring_area(ring) < 0:
        ring = ring[::-1]
    d = np.roll(ring, -1, axis=0) - ring
    angle = np.arctan2(d[:, 1], d[:, 0])
    turn = (np.roll(angle, -1) - angle) % (2 * np.pi)
    if turn.max() >= np.pi or turn.sum() > 7:  # a turn to the right, or more than once around
        return None
    return np.roll(ring, -int(np.lexsort((ring[:, 0], ring[:, 1]))[0]), axis=0)


def _grown(ring: np.ndarray, distance: float, quarter: int) -> np.ndarray:
    """The sum of a ring of ``convex`` and a disc: the edges of both in the order of their angles."""
    round_ = np.roll(disc(0.0, 0.0, distance, quarter), quarter, axis=0)  # from its lowest corner
    d = np.concatenate([np.roll(r, -1, axis=0) - r for r in (ring, round_)])
    order = np.argsort(np.arctan2(d[:, 1], d[:, 0]) % (2 * np.pi), kind="stable")
    return ring[0] + round_[0] + np.concatenate([np.zeros((1, 2)), np.cumsum(d[order[:-1]], axis=0)])


def _shrunk(ring: np.ndarray, distance: float, quarter: int) -> np.ndarray:
    """The centres of discs inside a ring of ``convex``: each side moves in by the disc's reach."""
    d = np.roll(ring, -1, axis=0) - ring
    out = np.stack([d[:, 1], -d[:, 0]], axis=1) / np.hypot(d[:, 0], d[:, 1])[:, None]
    reach = (out @ disc(0.0, 0.0, distance, quarter).T).max(axis=1)
    core = ring
    for (px, py), (nx, ny) in zip(ring - out * reach[:, None], out, strict=True):
        core = clip_half(core, px, py, nx, ny)
    return core


def _slabs(ring: np.ndarray) -> np.ndarray:
    """The trapezoids of a ring of ``convex``."""
    y = ring[:, 1]
    top = np.flatnonzero(y >= y.max() - SNAP)
    right = ring[np.flatnonzero(y[: top[0] + 1] <= y[0] + SNAP)[-1] : top[0] + 1]
    left = np.concatenate([ring[top[-1] :], ring[:1]])[::-1]
    levels = np.unique(y)
    levels = levels[np.concatenate(([True], np.diff(levels) > SNAP))]
    l, r = np.interp(levels, left[:, 1], left[:, 0]), np.interp(levels, right[:, 1], right[:, 0])
    return np.stack([levels[:-1], levels[1:], l[:-1], l[1:], r[:-1], r[1:]], axis=1)


def buffer(polygon: Polygon, distance: float, quarter: int = 8) -> np.ndarray:
    """Grown by a distance, or shrunk by a negative one; round corners have ``quarter``
    segments to a right angle.  Convex polygons need no overlay."""
    if distance == 0:
        return overlay([polygon], lambda s: s[0])
    ring = convex(polygon)
    if ring is not None:
        ring = _grown(ring, distance, quarter) if distance > 0 else convex([_shrunk(ring, -distance, quarter)])
        return np.zeros((0, 6)) if ring is None else _slabs(ring)
    rim = _outline(polygon, abs(distance), quarter)
    if distance > 0:
        return overlay([polygon, *rim], np.any)
    return overlay([polygon, *rim], lambda s: s[0] and not s[1:].any())


def opened(polygon: Polygon, distance: float, quarter: int = 8) -> np.ndarray:
    """Shrunk and grown again: what is narrower than twice the distance goes."""
    ring = convex(polygon)
    if ring is not None and distance > 0:
        core = _shrunk(ring, distance, quarter)
        core = [core] if len(core) and abs(ring_area(core)) > 1e-4 else []
    else:
        core = rings(buffer(polygon, -distance, quarter))
    return buffer(core, distance, quarter) if core else np.zeros((0, 6))


def closed(polygon: Polygon, distance: float, quarter: int = 8) -> np.ndarray:
    """Grown and shrunk again: gaps narrower than twice the distance are filled."""
    return buffer(rings(buffer(polygon, distance, quarter)), -distance, quarter)


def clean(polygon: Polygon | None, least_area: float = 4.0) -> Polygon | None:
    """A valid polygon of the same points inside, or None where there is too little of it."""
    if not polygon:
        return None
    t = overlay([polygon], lambda s: s[0])
    return rings(t) if area(t) >= least_area else None


def without_holes(polygon: Polygon) -> Polygon:
    """For rings that run as ``rings`` gives them."""
    return [r for r in polygon if ring_area(r) > 0]


def without_small_parts(polygon: Polygon, least_area: float) -> Polygon:
    return [r for r in polygon if abs(ring_area(r)) >= least_area]


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker between the two corners that lie farthest apart."""
    a = int(np.argmax(np.hypot(*(ring - ring[0]).T)))

    def thin(line: np.ndarray) -> np.ndarray:
        keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
        while todo:
            i, j = todo.pop()
            if j - i < 2:
                continue
            d = line[j] - line[i]
            off = np.abs(d[0] * (line[i + 1 : j, 1] - line[i, 1]) - d[1] * (line[i + 1 : j, 0] - line[i, 0])) / max(np.hypot(*d), 1e-12)
            k = int(np.argmax(off))
            if off[k] > tolerance:
                keep.add(i + 1 + k)
                todo += [(i, i + 1 + k), (i + 1 + k, j)]
        return line[sorted(keep)]

    return np.concatenate([thin(ring[: a + 1])[:-1], thin(np.concatenate([ring[a:], ring[:1]]))[:-1]])


def segmentize(ring: np.ndarray, most: float) -> np.ndarray:
    """A ring with corners put in, so that no edge is longer than ``most``."""
    out = []
    for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        n = max(1, int(np.ceil(np.hypot(*(b - a)) / most - 1e-9)))
        out.append(a + (b - a) * (np.arange(n) / n)[:, None])
    return np.concatenate(out)


def set_precision(ring: np.ndarray, grid: float) -> np.ndarray:
    r = np.round(ring / grid) * grid
    return r[np.any(r != np.roll(r, 1, axis=0), axis=1)]


def clip_half(ring: np.ndarray, px: float, py: float, nx: float, ny: float) -> np.ndarray:
    """The part of a convex ring on the side of the line through (px, py) that (nx, ny) points away from."""
    if not len(ring):
        return ring
    side = ((ring[:, 0] - px) * nx + (ring[:, 1] - py) * ny).tolist()
    corner = ring.tolist()
    out = []
    for (ax, ay), (bx, by), u, v in zip(corner, corner[1:] + corner[:1], side, side[1:] + side[:1], strict=True):
        if u <= 0:
            out.append((ax, ay))
        if (u < 0 < v) or (v < 0 < u):
            t = u / (u - v)
            out.append((ax + (bx - ax) * t, ay + (by - ay) * t))
    return np.array(out) if len(out) > 2 else np.zeros((0, 2))


def cells(own: np.ndarray, points: np.ndarray, reach: float, block: int = 2_000_000) -> list[np.ndarray]:
    """The Voronoi cell of each row of ``own`` among ``points``, cut to a square of ``reach`` to
    each side.  All cells are clipped at a time by their nearest points, then the next ones, until
    these lie more than twice as far off as any corner of the cell."""
    out: list = [None] * len(own)
    order = np.argsort(own[:, 0], kind="stable")
    points = points[np.argsort(points[:, 0], kind="stable")]
    far = 2 * np.sqrt(2) * reach
    at = 0
    while at < len(order):
        lo = np.searchsorted(points[:, 0], own[order[at], 0] - far)
        span = np.searchsorted(points[:, 0], own[order[at:], 0] + far, side="right") - lo
        # As many cells as there is room for their distances to all points near them.
        n = max(1, int(np.searchsorted(span * np.arange(1, len(span) + 1), block, side="right")))
        who = order[at : at + n]
        near = points[lo : lo + span[n - 1]]
        for k, c in zip(who, _cells(own[who], near, reach), strict=True):
            out[k] = c
        at += n
    return out


def _cells(own: np.ndarray, near: np.ndarray, reach: float) -> list[np.ndarray]:
    d = np.hypot(own[:, None, 0] - near[None, :, 0], own[:, None, 1] - near[None, :, 1])
    d[d == 0] = np.inf
    corner = own[:, None, :] + reach * np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)], float)[None]
    many = np.full(len(own), 4)
    live, known, rank = np.arange(len(own)), min(16, d.shape[1]), 0
    nearest = _first(d, known)
    while len(live) and rank < d.shape[1]:
        if rank == known:
            known = min(2 * known, d.shape[1])
            nearest = _first(d, known)
        p = nearest[live, rank]
        dist = d[live, p]
        c, m = corner[live], many[live]
        valid = np.arange(c.shape[1]) < m[:, None]
        reach2 = np.where(valid, np.hypot(c[:, :, 0] - own[live, None, 0], c[:, :, 1] - own[live, None, 1]), 0.0).max(axis=1)
        go = (dist <= 2 * reach2 * (1 + 1e-9)) & (m > 0)
        live, p, c, m, valid = live[go], p[go], c[go], m[go], valid[go]
        if not len(live):
            break
        normal = near[p] - own[live]
        middle = (own[live] + near[p]) / 2
        u = ((c - middle[:, None]) * normal[:, None]).sum(axis=2)
        to = np.where(np.arange(1, c.shape[1] + 1) < m[:, None], np.arange(1, c.shape[1] + 1), 0)
        v, b = np.take_along_axis(u, to, 1), np.take_along_axis(c, to[:, :, None], 1)
        crosses = valid & (((u < 0) & (v > 0)) | ((v < 0) & (u > 0)))
        t = np.divide(u, u - v, out=np.zeros_like(u), where=crosses)
        both = np.stack([c, c + (b - c) * t[:, :, None]], axis=2).reshape(len(live), -1, 2)
        keep = np.stack([valid & (u <= 0), crosses], axis=2).reshape(len(live), -1)
        m = keep.sum(axis=1)
        width = max(int(m.max()), corner.shape[1])
        if width > corner.shape[1]:
            corner = np.concatenate([corner, np.zeros((len(corner), width - corner.shape[1], 2))], axis=1)
        first = np.argsort(~keep, axis=1, kind="stable")[:, :width]
        corner[live, : first.shape[1]] = np.take_along_axis(both, first[:, :, None], 1)
        many[live] = np.where(m > 2, m, 0)
        rank += 1
    return [c[:m] for c, m in zip(corner, many, strict=True)]


def _first(d: np.ndarray, many: int) -> np.ndarray:
    """The columns of the ``many`` least values of each row, ascending."""
    some = np.argpartition(d, many - 1, axis=1)[:, :many] if many < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


def perimeter(polygon: Polygon) -> float:
    return float(sum(np.hypot(*(np.roll(r, -1, axis=0) - r).T).sum() for r in polygon))
