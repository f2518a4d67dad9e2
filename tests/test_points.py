"""Points in boxes: against all pairs, in the number of pairs tested, and cut into tiles."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajspark.functions import spatial
from trajspark.operators import matching as J
from trajspark.operators import points as P


def brute(group, x, y, box_group, boxes):
    return ((box_group[:, None] == group) & (boxes[:, 0:1] <= x) & (boxes[:, 2:3] >= x) & (boxes[:, 1:2] <= y) & (boxes[:, 3:4] >= y))


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 60), st.integers(0, 60), st.integers(1, 5), st.sampled_from([1, 16, 2_048]))
def test_search_equals_all_pairs(seed, n, m, groups, leaf):
    r = np.random.default_rng(seed)
    group, box_group = np.sort(r.integers(0, groups, n)), np.sort(r.integers(0, groups, m))
    x, y = r.integers(0, 12, n) / 8, r.integers(0, 12, n) / 8          # many on borders, many equal
    at = r.integers(-2, 12, (m, 2)) / 8
    boxes = np.hstack([at, at + r.integers(0, 8, (m, 2)) / 8])
    flags = r.random((n, 2)) < .4
    kept, spatial.LEAF_PAIRS = spatial.LEAF_PAIRS, leaf
    try:
        first, _ = spatial.first_box(group, x, y, box_group, boxes)
        some, _ = spatial.any_flags(group, x, y, flags, box_group, boxes)
    finally:
        spatial.LEAF_PAIRS = kept
    inside = brute(group, x, y, box_group, boxes)
    assert first.tolist() == [int(c.argmax()) if c.any() else -1 for c in inside.T] if m else (first == -1).all()
    assert (some == (inside[:, :, None] & flags[None]).any(axis=1)).all()


def layout(kind, n, r):
    """As many boxes as points: small ones, thin ones, a pile around one place, and full screens."""
    x, y = r.random(n), r.random(n)
    if kind == "small":
        at, size = r.random((n, 2)), r.random((n, 2)) * 2 / np.sqrt(n)
    elif kind == "thin":
        at = r.random((n, 2)) * [1, .1]
        size = np.stack([r.random(n) * 2 / n, np.full(n, .9)], axis=1)
    elif kind == "pile":
        half = np.sort(r.random(n))[:, None] / 2 * np.ones(2)
        at, size = .5 - half, 2 * half
    else:
        at, size = -r.random((n, 2)), 2 + r.random((n, 2))
    boxes = np.hstack([at, at + size])
    return x, y, boxes[np.argsort(size.prod(axis=1), kind="stable")]


@pytest.mark.parametrize("kind", ["small", "thin", "pile", "full"])
def test_pairs_grow_with_rows(kind):
    """Ten times the points and boxes on one screen: some ten times the pairs, where all pairs are a hundred times as many."""
    tested = {}
    for n in (2_000, 20_000):
        x, y, boxes = layout(kind, n, np.random.default_rng(3))
        zero = np.zeros(n, np.int64)
        _, a = spatial.first_box(zero, x, y, zero, boxes)
        _, b = spatial.any_flags(zero, x, y, np.ones((n, 1), bool), zero, boxes)
        tested[n] = np.array([a, b])
    assert (tested[20_000] < 40 * np.maximum(tested[2_000], 2_000)).all() and (tested[20_000] < 20_000 ** 2 / 50).all(), tested


def scene(spark, seed):
    r = random.Random(seed)
    unit = lambda: r.randint(-3, 23) / 20
    points = [(k, r.choice(["a", "a", "b", None]), r.choice([(unit(), unit())] * 9 + [None])) for k in range(300)]
    boxes = []
    for k in range(150):
        x, y = unit(), unit()
        boxes.append((k, r.choice(["a", "a", "b", None]), k // 2, (x, y, x + r.randint(0, 12) / 20, y + r.randint(0, 12) / 20), r.choice(["t", "u", "", None])))
    boxes += [(k + 500, *b[1:]) for k, b in enumerate(boxes[:30])]
    return points, boxes


def located(points, boxes, pad):
    out = {}
    for i, s, p in points:
        around = [((b[2] - b[0]) * (b[3] - b[1]), o, k) for k, t, o, b, text in boxes if p and s is not None and s == t and (text or "").strip()
                  and b[0] - pad <= p[0] <= b[2] + pad and b[1] - pad <= p[1] <= b[3] + pad]
        out[i] = min(around)[:2] if around else None
    return out


@pytest.mark.parametrize("tile_rows", [50_000, 20])
def test_locate_points_in_tiles(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(P, "TILE_ROWS", tile_rows)
    points, boxes = scene(spark, 5)
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    p = spark.createDataFrame(points, "point_id int, screen_id string, point struct<x:double,y:double>").repartition(3)
    b = spark.createDataFrame(boxes, f"box_id int, screen_id string, ord int, bbox {box}, text string").repartition(3)
    by_id = {k: ((c[2] - c[0]) * (c[3] - c[1]), o) for k, _, o, c, _ in boxes}
    for pad in (0.0, 0.03125):
        got = J.locate_points(p, b, pad=pad).collect()
        assert len(got) == len(points)
        assert {r["point_id"]: by_id.get(r["box_id"]) for r in got} == located(points, boxes, pad)


@pytest.mark.parametrize("tile_rows", [50_000, 20])
def test_covered_in_tiles(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(P, "TILE_ROWS", tile_rows)
    _, boxes = scene(spark, 6)
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    truth = spark.createDataFrame([(k, s, c) for k, s, _, c, _ in boxes], f"truth_id int, screen_id string, bbox {box}").repartition(3)
    elements = spark.createDataFrame([(s, c, k % 5 == 0) for k, s, _, c, _ in boxes[40:90]], f"screen_id string, bbox {box}, listed boolean")
    got = {r["truth_id"]: (r["any"], r["shown"]) for r in J.covered_by(truth, elements, {"any": F.lit(True), "shown": F.col("listed")}).collect()}
    want = {}
    for k, s, _, b, _ in boxes:
        hits = [e % 5 == 0 for e, t, _, c, _ in boxes[40:90] if s is not None and s == t
                and b[0] <= (c[0] + c[2]) / 2 <= b[2] and b[1] <= (c[1] + c[3]) / 2 <= b[3]]
        want[k] = (bool(hits), any(hits))
    assert got == want


def test_groups_over_many_batches(spark):
    """Groups longer than an Arrow batch stay whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        points, boxes = scene(spark, 7)
        box = "struct<x1:double,y1:double,x2:double,y2:double>"
        p = spark.createDataFrame(points, "point_id int, screen_id string, point struct<x:double,y:double>")
        b = spark.createDataFrame(boxes, f"box_id int, screen_id string, ord int, bbox {box}, text string")
        by_id = {k: ((c[2] - c[0]) * (c[3] - c[1]), o) for k, _, o, c, _ in boxes}
        assert {r["point_id"]: by_id.get(r["box_id"]) for r in J.locate_points(p, b).collect()} == located(points, boxes, 0.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
