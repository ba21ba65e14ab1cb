"""Which pieces can be the nearest of which points, within one block of points and pieces.

A block's points are halved along their longer side until few are left. Of the
block's pieces only those go down with a half that can be the nearest of one of
its points: no piece may be farther from the half's middle than the nearest one (or
the k-th nearest road) by more than the half's own size allows. So a point is measured against the few
pieces around it, however many the block holds.
"""

from __future__ import annotations

import numpy as np

#: Points at which halving ends, and point-piece pairs measured in one go.
FEW, PAIRS = 16, 1 << 18


def _measure(x, y, kx, ky, p):
    """Distances of points to pieces after scaling the axes, as ``geo.piece_distance`` works them out."""
    dx, dy = (p[2] - p[0]) * kx, (p[3] - p[1]) * ky
    qx, qy = (x - p[0]) * kx, (y - p[1]) * ky
    square = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(square > 0, np.maximum(0.0, np.minimum(1.0, (qx * dx + qy * dy) / square)), 0.0)
    return np.hypot(qx - t * dx, qy - t * dy)


def _settled(x, y, kx, ky: float, pieces, radius: float, bound, slack: float = 0.0):
    """Few points at a time, the pieces that can win there, and whether the points are one place.

    ``bound`` gives of the distances of pieces to a middle (and of their positions) the one up to which pieces win there;
    pieces up to ``slack`` behind that are kept. Points and pieces without a finite place are left out.
    """
    stack = [(np.flatnonzero(np.isfinite(x) & np.isfinite(y)), np.flatnonzero(np.isfinite(pieces).all(axis=0)))]
    while stack:
        points, near = stack.pop()
        if not len(points) or not len(near):
            continue
        px, py, scale = x[points], y[points], kx[points]
        x0, x1, y0, y1 = px.min(), px.max(), py.min(), py.max()
        wide = np.abs(scale).max()
        half = np.hypot((x1 - x0) / 2 * wide, (y1 - y0) / 2 * ky)
        if len(near) > 1:
            # a point's own scale is at most the widest one and shrinks a distance by no more than ``low``
            low = np.abs(scale).min() / wide if wide else 1.0
            d = _measure((x0 + x1) / 2, (y0 + y1) / 2, wide, ky, pieces[:, near])
            reach = min(bound(d, near) + half, radius) * (1 + 1e-9) + 1e-5 + slack
            near = near[(d - half) * low <= reach]
            if not len(near):
                continue
        if half == 0 and np.ptp(scale) == 0:
            yield points, near, True
        elif len(points) <= FEW or len(near) <= FEW:
            yield points, near, False
        else:
            along = px if (x1 - x0) * wide >= (y1 - y0) * ky else py
            cut = np.argpartition(along, len(points) // 2)
            stack += [(points[cut[:len(points) // 2]], near), (points[cut[len(points) // 2:]], near)]


def _measured(x, y, kx, ky: float, pieces, points, near):
    """Slices of the points with their distances to the pieces, ``PAIRS`` at a time."""
    held, step = pieces[:, near], max(1, PAIRS // max(len(near), 1))
    for at in range(0, len(points), step):
        some = points[at:at + step]
        yield some, _measure(x[some, None], y[some, None], kx[some, None], ky, held[:, None, :])


def winners(x, y, kx, ky: float, pieces, order, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of points and of the pieces that win there: the smallest distance to the micrometre within
    ``radius``, then the smallest ``order``; pieces equal in both are all named.

    ``x, y`` are the points, ``kx`` holds a scale for each of them; ``pieces`` has the rows ``ax, ay, bx, by``.
    """
    hits: tuple[list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    for points, near, one in _settled(x, y, kx, ky, pieces, radius, lambda d, near: d.min()):
        for some, d in _measured(x, y, kx, ky, pieces, points[:1] if one else points, near):
            um = np.where(d <= radius, np.floor(d * 1e6 + 0.5), np.inf)
            least = um.min(axis=1, keepdims=True)
            tied = (um == least) & np.isfinite(least)
            rank = np.where(tied, order[near][None, :], np.iinfo(np.int64).max)
            i, j = np.nonzero(tied & (rank == rank.min(axis=1, keepdims=True)))
            hits[0].append(np.repeat(points, len(j)) if one else some[i])
            hits[1].append(np.tile(near[j], len(points)) if one else near[j])
    return np.concatenate(hits[0]), np.concatenate(hits[1])


def k_winners(x, y, kx, ky: float, pieces, road, radius: float, k: int, digits: int | None, who) -> tuple[np.ndarray, ...]:
    """The ``k`` nearest roads within ``radius`` of each of ``who``, which may have several points: positions of a point of
    theirs and of a piece of the road, the distance (rounded to ``digits`` if given) and the rank from 1.

    A road's distance is that of its nearest piece; equal distances go to the smallest ``road``.
    """
    unit = 0.0 if digits is None else 10.0 ** -digits

    def bound(d, near) -> float:
        """Distance of the k-th road."""
        m, n = min(4 * k, len(near)), len(near)
        while True:
            nearest = np.argpartition(d, m - 1)[:m] if m < n else np.arange(n)
            nearest = nearest[np.argsort(d[nearest], kind="stable")]
            first = np.sort(np.unique(road[near[nearest]], return_index=True)[1])
            if len(first) >= k:
                return d[nearest[first[k - 1]]]
            if m == n:
                return np.inf
            m = min(4 * m, n)

    # roads up to a unit behind the k-th can have its rounded distance, and come before it
    hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for points, near, one in _settled(x, y, kx, ky, pieces, radius, bound, 2 * unit):
        near = near[np.argsort(road[near], kind="stable")]
        starts = np.flatnonzero(np.diff(road[near], prepend=road[near[0]] - 1))
        for some, d in _measured(x, y, kx, ky, pieces, points[:1] if one else points, near):
            d = np.minimum.reduceat(np.where(d <= radius, d, np.inf), starts, axis=1)
            if unit:  # half up, with the guard of ``numbers.rounded``
                d = np.floor((d + 1e-9) * 10.0 ** digits + 0.5) / 10.0 ** digits
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            d = np.take_along_axis(d, best, axis=1)
            i, j = np.nonzero(np.isfinite(d))
            found, at = d[i, j], near[starts[best[i, j]]]
            hits.append((np.repeat(points, len(j)), np.tile(at, len(points)), np.tile(found, len(points))) if one else (some[i], at, found))
    i, j, d = (np.concatenate(column) for column in zip(*hits))
    # a road counts once for each of ``who``
    nearest = np.lexsort((d, road[j], who[i]))
    i, j, d = i[nearest], j[nearest], d[nearest]
    once = np.ones(len(i), bool)
    once[1:] = (who[i[1:]] != who[i[:-1]]) | (road[j[1:]] != road[j[:-1]])
    i, j, d = i[once], j[once], d[once]
    ranked = np.lexsort((road[j], d, who[i]))
    i, j, d = i[ranked], j[ranked], d[ranked]
    begin = np.flatnonzero(np.diff(who[i], prepend=-1)) if len(i) else np.zeros(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(begin, np.diff(begin, append=len(i))) + 1
    return tuple(column[rank <= k] for column in (i, j, d, rank))
