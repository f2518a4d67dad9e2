"""Points and boxes of many groups at a time, in numpy: a tree over the points that boxes go down together.

A node is a set of points with its bounds. Boxes that miss the bounds stay out, those that cover them are settled for all of the node's points at
once, and only boxes whose edge runs through the bounds go down to the halves (cut at the median). An edge crosses about the square root of the
nodes, so n points and m boxes take some m * sqrt(n) steps at worst, however they lie, and pairs are only tested in small leaves.
"""

from __future__ import annotations

import numpy as np

LEAF_PAIRS = 2_048


def _split(idx: np.ndarray, group: np.ndarray, x: np.ndarray, y: np.ndarray, bounds) -> tuple[np.ndarray, np.ndarray]:
    g0, g1, x0, x1, y0, y1 = bounds
    mid = len(idx) // 2
    if g0 < g1:         # points come in order of their groups
        cut = np.searchsorted(group[idx], group[idx[mid]], "left" if group[idx[mid]] > g0 else "right")
        return idx[:cut], idx[cut:]
    at = (x if x1 - x0 >= y1 - y0 else y)[idx]
    order = np.argpartition(at, mid)
    return idx[order[:mid]], idx[order[mid:]]


def _bounds(idx: np.ndarray, group: np.ndarray, x: np.ndarray, y: np.ndarray):
    return group[idx[0]], group[idx[-1]], x[idx].min(), x[idx].max(), y[idx].min(), y[idx].max()


def _sides(boxes: np.ndarray, bg: np.ndarray, b: np.ndarray, bounds) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the boxes that cover the bounds, of those whose edge runs through them)."""
    g0, g1, x0, x1, y0, y1 = bounds
    own, of = b[boxes], bg[boxes]
    touch = (of >= g0) & (of <= g1) & (own[:, 0] <= x1) & (own[:, 2] >= x0) & (own[:, 1] <= y1) & (own[:, 3] >= y0)
    cover = touch & (g0 == g1) & (own[:, 0] <= x0) & (own[:, 2] >= x1) & (own[:, 1] <= y0) & (own[:, 3] >= y1)
    return boxes[cover], boxes[touch & ~cover]


def _inside(boxes: np.ndarray, bg: np.ndarray, b: np.ndarray, idx: np.ndarray, group: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Boxes x points: borders belong to the box."""
    own, px, py = b[boxes][:, :, None], x[idx], y[idx]
    return (bg[boxes][:, None] == group[idx]) & (own[:, 0] <= px) & (own[:, 2] >= px) & (own[:, 1] <= py) & (own[:, 3] >= py)


def first_box(group, x, y, box_group, boxes) -> tuple[np.ndarray, int]:
    """(number of the first box of its own group around every point, or -1; pairs tested).

    Points come in order of their groups, the boxes (x1, y1, x2, y2) of a group in order of preference.
    """
    best = np.full(len(x), len(boxes), np.int64)
    todo = [(np.arange(len(x)), np.arange(len(boxes)))] if len(x) and len(boxes) else []
    tested = 0
    while todo:
        idx, some = todo.pop()
        bounds = _bounds(idx, group, x, y)
        cover, cross = _sides(some, box_group, boxes, bounds)
        if len(cover):
            best[idx] = np.minimum(best[idx], cover[0])
        if bounds[0] == bounds[1]:
            cross = cross[cross < best[idx].max()]          # the worst that is found already
        if not len(cross):
            continue
        if len(cross) * len(idx) <= LEAF_PAIRS or len(idx) == 1:
            hit = _inside(cross, box_group, boxes, idx, group, x, y)
            tested += hit.size
            best[idx] = np.minimum(best[idx], np.where(hit.any(axis=0), cross[hit.argmax(axis=0)], len(boxes)))
            continue
        todo += [(half, cross) for half in _split(idx, group, x, y, bounds)]
    return np.where(best < len(boxes), best, -1), tested


def any_flags(group, x, y, flags, box_group, boxes) -> tuple[np.ndarray, int]:
    """(per box and flag: some point of its group inside has it; pairs tested). Points come in order of their groups."""
    found = np.zeros((len(boxes), flags.shape[1]), bool)
    todo = [(np.arange(len(x)), np.arange(len(boxes)))] if len(x) and len(boxes) else []
    tested = 0
    while todo:
        idx, some = todo.pop()
        here = flags[idx].any(axis=0)
        some = some[(here & ~found[some]).any(axis=1)]      # the others have all that is to be had here
        if not len(some):
            continue
        bounds = _bounds(idx, group, x, y)
        cover, cross = _sides(some, box_group, boxes, bounds)
        found[cover] |= here
        if not len(cross):
            continue
        if len(cross) * len(idx) <= LEAF_PAIRS or len(idx) == 1:
            hit = _inside(cross, box_group, boxes, idx, group, x, y)
            tested += hit.size
            found[cross] |= (hit[:, :, None] & flags[idx][None]).any(axis=1)
            continue
        todo += [(half, cross) for half in _split(idx, group, x, y, bounds)]
    return found, tested
