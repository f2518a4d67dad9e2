"""Joins: lookups, points in boxes, predictions against truth, plan coverage, box merging."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import geometry as G
from ..functions.stats import round_exact
from ..functions.strings import bag_f1, char_bag, is_blank, let
from ..session import broadcast_if_small, pin, stage
from .components import components
from .ordered import HOT_ROWS, OrderedRows
from .points import any_inside, first_box, sides

MAX_LEVEL = 20          # finest grid: about a million cells per side
FOLD_PAIRS = 1_000_000  # of a connected part that is folded in one task
FIRST_BOXES = 2_000     # of a screen that are settled at first; each step after it takes twice as many in all


def lookup_join(rows: DataFrame, table: DataFrame, on, how: str = "left", max_rows: int = 200_000,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``rows`` to a table with one row per key, whatever a key's share of the rows is.

    A small table is broadcast. Otherwise only the table rows of hot keys are (there are at most
    all rows / ``hot_rows`` of them), and the rest is an ordinary shuffle join. Rows keep or
    lose their own row only, so the join is "left" or "inner".
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how is left or inner, not {how}")
    on = [on] if isinstance(on, str) else list(on)
    small = broadcast_if_small(table, max_rows)
    if small is not None:
        return rows.join(small, on, how)
    hot = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(*on)
    if hot.isEmpty():
        return rows.join(table, on, how)
    hot = F.broadcast(hot)
    few = F.broadcast(table.join(hot, on, "left_semi"))
    cold = rows.join(hot, on, "left_anti").join(table, on, how)
    return cold.unionByName(rows.join(hot, on, "left_semi").join(few, on, how))


def _level(side: Column) -> Column:
    """Finest grid level whose cells are at least ``side`` wide."""
    lev = F.floor(-F.log2(F.greatest(side, F.lit(2.0 ** -MAX_LEVEL))))
    return F.greatest(F.least(lev, F.lit(MAX_LEVEL)), F.lit(0)).cast("int")


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v * F.pow(F.lit(2.0), level))


def box_cells(boxes: DataFrame, coarser: int, bbox: str = "bbox") -> DataFrame:
    """One row per cell that a box with an area touches: at the levels of its width and of its height, and at up to ``coarser`` coarser ones of each.

    Cells at a level are at least as wide (high) as the box, so a box touches about 2 x 2 of them, however thin it is.
    """
    b = F.col(bbox)
    # a box in pixels would touch millions of cells
    unit = F.greatest(*[F.abs(b[c]) for c in ("x1", "y1", "x2", "y2")]) <= 4

    def span(a, z, lev):
        lo, hi = _cell(b[a], F.col(lev)), _cell(b[z], F.col(lev))
        cells = F.when(F.coalesce(unit, F.lit(True)), F.sequence(lo, hi))
        return F.explode(F.coalesce(cells, F.raise_error(F.lit("a box is not given in shares of its screen")).cast("array<bigint>")))

    d = boxes.filter((b["x2"] > b["x1"]) & (b["y2"] > b["y1"])).withColumns({"_lx": _level(b["x2"] - b["x1"]), "_ly": _level(b["y2"] - b["y1"])})
    for own, lev in (("_lx", "_gx"), ("_ly", "_gy")):
        d = d.withColumn(lev, F.explode(F.sequence(F.greatest(F.col(own) - coarser, F.lit(0)), F.col(own))))
    return d.withColumn("_cx", span("x1", "x2", "_gx")).withColumn("_cy", span("y1", "y2", "_gy"))


def locate_points(points: DataFrame, boxes: DataFrame, screen: str = "screen_id", pad: float = 0.0) -> DataFrame:
    """Smallest named box around each point (the widened box decides the hit, its own area the rank).

    points: screen, point and any other columns, which are kept; a null point finds nothing.
    boxes: screen, box_id, ord, bbox, text. Copies are folded first: equal boxes to the one listed
    first, equal points to one lookup.
    """
    named = (boxes.filter(~is_blank("text")).groupBy(screen, "bbox")
             .agg(F.min(F.struct("ord", "box_id", "text")).alias("first")))
    named = named.select(screen, *sides("bbox", pad), G.box_area("bbox").alias("area"), "first.ord", "first.box_id", F.col("first.text").alias("box_text"))
    pointed = points.filter(F.col("point").isNotNull())
    x, y = (F.col("point")[c].cast("double") for c in ("x", "y"))
    spots = pointed.select(screen, x.alias("x"), y.alias("y")).distinct()
    best = first_box(spots, named, [screen], ["area", "ord", "box_id", "box_text"], ["box_id", "box_text"])
    best = best.select(F.col(screen).alias("_screen"), F.col("x").alias("_x"), F.col("y").alias("_y"), "box_id", "box_text")
    pointed = pointed.withColumns({"_screen": F.col(screen), "_x": x, "_y": y})
    found = lookup_join(pointed, best, ["_screen", "_x", "_y"], "left").drop("_screen", "_x", "_y")
    blank = points.filter(F.col("point").isNull()).withColumns(
        {c: F.lit(None).cast(best.schema[c].dataType) for c in ("box_id", "box_text")})
    return found.unionByName(blank)


def covered(truth: DataFrame, elements: DataFrame, screen: str = "screen_id", key: str = "truth_id") -> DataFrame:
    """Add ``covered``: the centre of some element of the screen lies in the truth box."""
    return covered_by(truth, elements, {"covered": F.lit(True)}, screen, key)


def covered_by(truth: DataFrame, elements: DataFrame, kinds: dict, screen: str = "screen_id", key: str = "truth_id") -> DataFrame:
    """Add one column per kind of element (name: condition): some element of the kind has its centre in the truth box. One join for all."""
    point = G.box_center("bbox")
    centres = (elements.select(screen, point["x"].cast("double").alias("x"), point["y"].cast("double").alias("y"), *[c.alias(n) for n, c in kinds.items()])
               .groupBy(screen, "x", "y").agg(*[F.max(F.coalesce(n, F.lit(False))).alias(n) for n in kinds]))
    boxes = truth.select(screen, *sides("bbox", 0.0), key)
    hits = any_inside(centres, boxes, [screen], key, list(kinds)).groupBy(key).agg(*[F.max(n).alias(n) for n in kinds])
    return truth.join(hits, key, "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in kinds})


def hit_test(truth: DataFrame, preds: DataFrame, key: str = "index") -> DataFrame:
    """Predicted point in the truth box; no prediction is a miss."""
    j = truth.join(preds, key, "left")
    return j.withColumn("hit", F.coalesce(G.contains("bbox", "pred_point"), F.lit(False)))


def attach_test_rows(cases: DataFrame, test: DataFrame, key: str = "i") -> DataFrame:
    """Test row of each case by its recorded row number (unique, so no key is hot)."""
    return cases.join(test, key)


def build_cases(truth: DataFrame, preds: DataFrame, key: str = "i", pointed=V.POINTED_TYPES,
                failed: str = V.PARSE_FAILED, keep=()) -> DataFrame:
    """Truth (i, action, ``keep``) and predictions (i, pred_action) as scored cases.

    A row without a prediction is a failure. The distance exists only if both actions point;
    ``dist`` is rounded to three digits, ``dist_raw`` is not.
    """
    g, p = F.col("action"), F.col("pred_action")
    d = G.distance(g["point"], p["point"])
    d = F.when(g["type"].isin(*pointed) & p["type"].isin(*pointed), d)
    return truth.join(preds, key, "left").select(
        key, *keep, g["type"].alias("gt"), F.coalesce(p["type"], F.lit(failed)).alias("pred"),
        round_exact(d, 3).alias("dist"), d.alias("dist_raw"), g["text"].alias("gt_text"), p["text"].alias("pred_text"))


def best_match(reference, predicted, score=bag_f1, prepare=char_bag) -> Column:
    """Best score of each reference item among the predictions of the same row.

    Both lists are plans of at most eight items, so this stays inside the row. ``prepare`` is
    applied once per item before the pairs are scored (None: score the texts themselves).
    """
    ref, got = (F.col(c) if isinstance(c, str) else c for c in (reference, predicted))
    if prepare is not None:
        ref, got = F.transform(ref, lambda t: prepare(t)), F.transform(got, lambda t: prepare(t))
    return let({"ref": ref, "got": got}, lambda v: F.transform(v["ref"], lambda r: F.coalesce(
        F.array_max(F.transform(v["got"], lambda g: score(r, g))), F.lit(0.0))))


def plan_coverage(reference, predicted, score=bag_f1, prepare=char_bag) -> Column:
    """Mean of the best scores; 0 for an empty reference or prediction."""
    best = best_match(reference, predicted, score, prepare)
    return F.coalesce(let({"b": best}, lambda v: F.try_divide(
        F.aggregate(v["b"], F.lit(0.0), lambda a, x: a + x), F.size(v["b"]))), F.lit(0.0))


def _fold(primary: Column, candidates: Column, limit: float) -> Column:
    return F.aggregate(candidates, primary, lambda acc, c: F.when(
        F.exists(acc, lambda o: G.iou(o["bbox"], c["bbox"]) > limit), acc).otherwise(F.array_append(acc, c)))


def merge_boxes(primary: DataFrame, candidates: DataFrame, screen: str = "screen_id",
                limit: float = V.CV_DEDUP_IOU, fold_rows: int = 2_000) -> DataFrame:
    """Keep the primaries; add a candidate only if it overlaps nothing kept before it; renumber from 0.

    Both sides: screen, ord, bbox, text, source. An equal box later in the list never survives,
    so copies are folded first. Screens of ordinary size are folded inside a row; of a screen with
    more than ``fold_rows`` boxes, connected parts of the overlaps are folded side by side.
    """
    cand = candidates.withColumn("_flat", G.box_area("bbox") <= 0)
    solid = (cand.filter(~F.col("_flat")).groupBy(screen, "bbox")
             .agg(F.min(F.struct("ord", "text", "source")).alias("f"))
             .select(screen, "f.ord", "bbox", "f.text", "f.source"))
    cand = solid.unionByName(cand.filter("_flat").drop("_flat").select(*solid.columns))
    both = primary.select(screen, F.lit(0).alias("tier"), "ord", "bbox", "text", "source").unionByName(
        cand.select(screen, F.lit(1).alias("tier"), "ord", "bbox", "text", "source"))
    crowded = pin(both.groupBy(screen).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > fold_rows).select(screen))
    if crowded.isEmpty():
        return _merge_folded(both, screen, limit)
    small = broadcast_if_small(crowded)
    crowded = crowded if small is None else small
    normal = _merge_folded(both.join(crowded, screen, "left_anti"), screen, limit)
    return normal.unionByName(_merge_parts(both.join(crowded, screen, "left_semi"), screen, limit))


def _merge_folded(both: DataFrame, screen: str, limit: float) -> DataFrame:
    item = F.struct("tier", "ord", "bbox", "text", "source")
    g = both.groupBy(screen).agg(F.sort_array(F.collect_list(item)).alias("b"))
    kept = _fold(F.filter("b", lambda e: e["tier"] == 0), F.filter("b", lambda e: e["tier"] == 1), limit)
    return g.select(screen, F.posexplode(kept).alias("id", "e")).select(screen, "id", "e.bbox", "e.text", "e.source")


def _meeting(one: DataFrame, other: DataFrame, screen: str, limit: float, how: str) -> DataFrame:
    """Join of ``one`` (screen, bbox, ...) to ``other`` (screen, bbox, ...; names get a ``2``) on an overlap above the limit.

    Widths, and heights, of two such boxes are less than 1 / ``limit`` apart. They meet once: at the coarser of both levels, in the
    cell where their overlap begins.
    """
    coarser = min(MAX_LEVEL, int(math.log2(1 / max(limit, 2.0 ** -MAX_LEVEL)) + 1e-9) + 1)
    a, b = box_cells(one, coarser), box_cells(other, coarser)
    b = b.select(*[F.col(c).alias(c + "2") for c in b.columns])
    met = F.col(screen) == F.col(screen + "2")
    for g in ("_gx", "_gy", "_cx", "_cy"):
        met &= F.col(g) == F.col(g + "2")
    for own, lev, cell, start in (("_lx", "_gx", "_cx", "x1"), ("_ly", "_gy", "_cy", "y1")):
        met &= F.col(lev) == F.least(own, own + "2")
        met &= F.col(cell) == _cell(F.greatest(F.col("bbox")[start], F.col("bbox2")[start]), F.col(lev))
    return a.join(b, met & (G.iou("bbox", "bbox2") > limit), how)


def _overlaps(boxes: DataFrame, screen: str, limit: float) -> DataFrame:
    """Pairs (a before z by ``ord``) whose overlap is above the limit."""
    pairs = _meeting(boxes.select(screen, "ord", "bbox"), boxes.select(screen, "ord", "bbox"), screen, limit, "inner").filter("ord < ord2")
    return pairs.select(screen, F.col("ord").alias("a"), F.col("ord2").alias("z"))


def _free(boxes: DataFrame, kept: DataFrame, screen: str, limit: float) -> DataFrame:
    """Those of ``boxes`` (screen, ord, bbox, ...) that overlap no box of ``kept`` (screen, bbox) above the limit.

    Where boxes are dense, a kept box of about the same size and place settles most of them, one test each; only the rest
    looks at all kept boxes around it.
    """
    def place(d, parts):
        b, at = F.col("bbox"), {}
        for axis in ("x", "y"):
            lev = F.floor(F.log2(b[axis + "2"] - b[axis + "1"]) * parts)
            at |= {"_l" + axis: lev, "_c" + axis: F.floor((b[axis + "1"] + b[axis + "2"]) * parts / F.pow(F.lit(2.0), lev / parts))}
        return d.withColumns(at), [screen, *at]

    solid = kept.select(screen, "bbox").filter("bbox.x2 > bbox.x1 and bbox.y2 > bbox.y1")
    rest = boxes
    for parts in (1, 2):
        some, keys = place(solid, parts)
        rest, _ = place(rest, parts)
        rest = rest.join(some.groupBy(*keys).agg(F.min("bbox").alias("_seen")), keys, "left")
        rest = rest.filter(F.col("_seen").isNull() | ~(G.iou("_seen", "bbox") > limit)).select(*boxes.columns)
    rest = stage(rest)
    hit = _meeting(rest.select(screen, "ord", "bbox"), solid, screen, limit, "left_semi").select(screen, "ord").distinct()
    return stage(rest.join(hit, [screen, "ord"], "left_anti"))


def _lost(boxes: DataFrame, screen: str, limit: float, fold_pairs: int) -> DataFrame:
    """(screen, ord) of what the greedy choice among ``boxes`` leaves out: connected parts of the overlaps are folded, each in a task by priority.

    Parts are found in about as many steps as the logarithm of their length. A part of more than ``fold_pairs`` pairs is settled in rounds.
    """
    edges = stage(_overlaps(boxes, screen, limit))
    label = components(edges.withColumnRenamed("z", "b"), screen)
    placed = stage(edges.join(label.withColumnRenamed("node", "a"), [screen, "a"]))
    sizes = placed.groupBy(screen, "root").agg(F.count(F.lit(1)).alias("_n"))
    huge = stage(sizes.filter(F.col("_n") > fold_pairs).select(screen, "root"))
    kind, unit = boxes.schema[screen].dataType.simpleString(), boxes.schema["ord"].dataType.simpleString()

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["z", "a"])
        out = set()
        for a, z in zip(part["a"].tolist(), part["z"].tolist(), strict=True):       # all of a is decided: it comes before z
            if a not in out:
                out.add(z)
        return pd.DataFrame({screen: [part[screen].iloc[0]] * len(out), "ord": sorted(out)})

    lost = (placed.join(huge, [screen, "root"], "left_anti").groupBy(screen, "root").applyInPandas(fold, f"`{screen}` {kind}, ord {unit}"))
    if not huge.isEmpty():
        lost = lost.unionByName(_lost_in_rounds(placed.join(huge, [screen, "root"], "left_semi").select(screen, "a", "z"), screen))
    return lost


def _merge_parts(both: DataFrame, screen: str, limit: float, fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    """What overlaps a primary is out. Of the rest, the first few of each screen are settled, then as many again, and so on: what is
    kept thins out all that follows, so that pairs within a step stay few even where boxes are dense."""
    both = pin(both)
    rest = _free(both.filter("tier = 1").select(screen, "ord", "bbox"), both.filter("tier = 0").select(screen, "bbox").distinct(), screen, limit)
    rest = stage(OrderedRows(rest, screen, ["ord"]).position("_p").df())
    most, done = rest.agg(F.max("_p")).first()[0] or 0, 0
    kept = rest.limit(0).select(screen, "ord")
    while done < most:
        done = max(FIRST_BOXES, 2 * done)
        now = rest.filter(F.col("_p") <= done)
        fresh = stage(now.join(_lost(now, screen, limit, fold_pairs), [screen, "ord"], "left_anti"))
        kept = kept.unionByName(fresh.select(screen, "ord"))
        if done < most:
            rest = _free(rest.filter(F.col("_p") > done), fresh, screen, limit)
    out = both.filter("tier = 0").unionByName(both.filter("tier = 1").join(kept, [screen, "ord"], "left_semi").select(*both.columns))
    ranked = OrderedRows(out, screen, ["tier", "ord"]).position("_p").df()
    return ranked.select(screen, (F.col("_p") - 1).cast("int").alias("id"), "bbox", "text", "source")


def _lost_in_rounds(pairs: DataFrame, screen: str) -> DataFrame:
    """(screen, ord) of what greedy choice leaves out: in each round, all that waits for nothing undecided is kept, and what it overlaps goes."""
    pairs = stage(pairs)
    open_ = pairs.select(screen, F.col("a").alias("ord")).union(pairs.select(screen, F.col("z").alias("ord"))).distinct()
    lost = None
    while True:
        waiting = pairs.select(screen, F.col("z").alias("ord")).distinct()
        fresh = stage(open_.join(waiting, [screen, "ord"], "left_anti"))
        hit = stage(pairs.join(fresh.withColumnRenamed("ord", "a"), [screen, "a"], "left_semi").select(screen, F.col("z").alias("ord")).distinct())
        lost = hit if lost is None else lost.unionByName(hit)
        open_ = stage(open_.join(fresh.unionByName(hit), [screen, "ord"], "left_anti"))
        if open_.isEmpty():
            return lost
        for end in ("a", "z"):
            pairs = pairs.join(open_.withColumnRenamed("ord", end), [screen, end], "left_semi")
        pairs = stage(pairs)


def resolve_element_ids(cases: DataFrame, elements: DataFrame, screen: str = "screen_id") -> DataFrame:
    """Element id of an answer as an integer, and the centre of that element on its screen.

    14 and 14.0 are taken; 1.9, text and booleans are not. Adds element_id, point, reject_reason.
    """
    v = F.expr("try_cast(trim(element) as double)")
    good = v.isNotNull() & (v == F.floor(v)) & (F.abs(v) < 2 ** 31)
    d = cases.withColumn("element_id", F.when(good, v.cast("long")))
    e = elements.select(screen, F.col("id").cast("long").alias("element_id"), G.box_center("bbox").alias("point"))
    # answers without an id get one of many keys that no element has: a null key would gather them in one task
    spread = -1 - F.pmod(F.xxhash64(screen, "element_id", *[c for c, t in cases.dtypes if c != screen and "map<" not in t]), F.lit(1024))
    d = d.withColumn("_eid", F.coalesce("element_id", spread))
    d = lookup_join(d, e.withColumnRenamed("element_id", "_eid"), [screen, "_eid"]).drop("_eid")
    return d.withColumn("reject_reason", F.when(F.col("element_id").isNull(), "element_not_integer")
                        .when(F.col("point").isNull(), "element_unknown"))


def probe_spaces(preds: DataFrame, by: str = "prompt", spaces=V.COORD_SPACES) -> DataFrame:
    """Hits of a predicted box centre under each coordinate space, and out-of-range counts.

    preds: prompt, box (x1..y2 or null), bbox (truth, unit), w, h, rw, rh.
    """
    d = preds.filter(F.col("box").isNotNull()).withColumn("space", F.explode(F.array(*[F.lit(s) for s in spaces])))
    c = G.box_center("box")
    p = G.from_space(c["x"], c["y"], "space", "w", "h", "rw", "rh")
    box = F.col("box")
    beyond = (box["x2"] > F.col("rw")) | (box["y2"] > F.col("rh"))
    return d.withColumn("_p", p).groupBy(by, "space").agg(
        F.count(F.lit(1)).alias("parsed"), F.count_if(G.contains("bbox", "_p")).alias("hits"),
        F.count_if(beyond).alias("beyond_size"),
        F.count_if(F.greatest(box["x1"], box["y1"], box["x2"], box["y2"]) > 1000).alias("beyond_1000"))


def best_space(probe: DataFrame, by: str = "prompt") -> DataFrame:
    """The space with the most hits per prompt (ties by name)."""
    return probe.groupBy(by).agg(F.min(F.struct((-F.col("hits")).alias("h"), F.col("space"))).alias("m")).select(
        by, F.col("m.space").alias("space"), (-F.col("m.h")).alias("hits"))


