"""Overlap merge of crowded screens, and the connected parts it stands on."""

from __future__ import annotations

import random

import pytest

from trajspark import fixed_values as V
from trajspark.operators import components as C
from trajspark.operators import matching as J

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    return both / (area(a) + area(b) - both)


def greedy(primary, candidates, near):
    kept = list(primary)
    for b in candidates:
        if not any(iou(b, o) > V.CV_DEDUP_IOU for o in kept if near(b, o)):
            kept.append(b)
    return kept


def merged(spark, primary, candidates, **options):
    frame = lambda boxes: spark.createDataFrame([("s", k, b, f"t{k}", "x") for k, b in enumerate(boxes)], f"screen_id string, ord int, bbox {BOX}, text string, source string")
    rows = J.merge_boxes(frame(primary), frame(candidates), **options).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(len(rows)))
    return [tuple(r["bbox"]) for r in rows]


def test_a_long_chain(spark, monkeypatch):
    """1,000 boxes, each over the next, in a shuffled order of priority: few steps, as the greedy rule has it."""
    pins = []
    for module in (C, J):
        monkeypatch.setattr(module, "stage", lambda df, f=module.stage: (pins.append(1), f(df))[1])
    n = 1_000
    chain = [(k / n, 0.5, (k + 4) / n, 0.51) for k in range(n)]
    random.Random(1).shuffle(chain)
    got = merged(spark, chain[:1], chain[1:], fold_rows=200)
    assert got == greedy(chain[:1], chain[1:], lambda a, b: abs(a[0] - b[0]) < 5 / n)
    assert len(pins) < 60


@pytest.mark.parametrize("fold_pairs", [1_000_000, 3])
def test_parts_and_rounds(spark, monkeypatch, fold_pairs):
    """The same boxes whether parts are folded or settled in rounds."""
    whole = J._merge_parts
    monkeypatch.setattr(J, "_merge_parts", lambda both, screen, limit: whole(both, screen, limit, fold_pairs))
    r = random.Random(7)
    boxes = [(x, y, x + w, y + h) for x, y, w, h in ((r.randint(0, 40) / 50, r.randint(0, 40) / 50, r.randint(1, 9) / 50, r.randint(1, 9) / 50) for _ in range(160))]
    boxes = list(dict.fromkeys(boxes))
    assert merged(spark, boxes[:20], boxes[20:], fold_rows=50) == greedy(boxes[:20], boxes[20:], lambda a, b: True)


@pytest.mark.parametrize("n_primary", [0, 700])
def test_a_dense_pile_makes_few_pairs(spark, monkeypatch, n_primary):
    """1,400 different boxes about one spot: pairs grow with the boxes, not with their square, and the greedy rule holds."""
    pairs, whole = [], J._overlaps

    def counted(*args):
        found = whole(*args)
        pairs.append(found.count())
        return found
    monkeypatch.setattr(J, "_overlaps", counted)
    monkeypatch.setattr(J, "FIRST_BOXES", 50, raising=False)
    r = random.Random(5)
    boxes = [(x, y, x + w, y + h) for x, y, w, h in ((0.4 + r.random() / 10, 0.4 + r.random() / 10, 0.02 + r.random() / 8, 0.02 + r.random() / 8) for _ in range(1_400))]
    got = merged(spark, boxes[:n_primary], boxes[n_primary:], fold_rows=100)
    assert got == greedy(boxes[:n_primary], boxes[n_primary:], lambda a, b: True)
    assert sum(pairs) < 20 * len(boxes)


@pytest.mark.parametrize("limit", [0.3, 0.5, 0.05])
def test_meeting_finds_all_pairs_once(spark, limit):
    """Thin, flat, tiny, full-screen and outlying boxes, with edges on powers of two."""
    r = random.Random(11)
    side = lambda: r.choice([2.0 ** -r.randint(0, 12), r.random() / 3, 1e-7, 0.0])
    boxes = [(x, y, x + side(), y + side()) for x, y in ((r.choice([0.0, 0.25, 0.5, r.random() / 2, -0.1]), r.choice([0.0, 0.5, r.random() / 4])) for _ in range(400))]
    frame = spark.createDataFrame([("s", k, b) for k, b in enumerate(boxes)], f"screen_id string, ord int, bbox {BOX}")
    got = [(x["a"], x["z"]) for x in J._overlaps(frame, "screen_id", limit).collect()]
    solid = [k for k, b in enumerate(boxes) if b[2] > b[0] and b[3] > b[1]]
    want = [(a, z) for a in solid for z in solid if a < z and iou(boxes[a], boxes[z]) > limit]
    assert len(want) > 20 and sorted(got) == want


def test_components(spark):
    r = random.Random(3)
    chain = [("g", k, k + 1) for k in range(0, 300)] + [("h", 300 - k, 299 - k) for k in range(300)]
    some = [("g", r.randint(1000, 1400), r.randint(1000, 1400)) for _ in range(180)] + [("k", 5, 5)]
    top = {}

    def find(v):
        while top.setdefault(v, v) != v:
            v = top[v]
        return v
    for g, a, b in chain + some:
        if a != b:
            top[find((g, a))] = find((g, b))
    got = {(x["graph"], x["node"]): (x["graph"], x["root"]) for x in C.components(spark.createDataFrame(chain + some, "graph string, a int, b int"), "graph").collect()}
    assert got.keys() == top.keys()
    assert len({(find(v), got[v]) for v in got}) == len({find(v) for v in got}) == len(set(got.values()))
    assert C.components(spark.createDataFrame([], "graph string, a int, b int"), "graph").count() == 0
