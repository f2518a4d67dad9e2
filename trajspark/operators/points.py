"""Points and boxes of the same screen, joined without forming all pairs.

Both sides of a screen meet in a task, in order, and are searched there by ``functions.spatial``. A screen with more than
``TILE_ROWS`` points and boxes is cut into tiles, about as many as it has that often: a point lies in one
tile, a box goes to those it touches. What lies outside of the screen belongs to the tiles at its border.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spatial
from ..session import broadcast_if_small, pin

TILE_ROWS = 50_000
MAX_DEPTH = 10          # 1024 tiles per side, about a pixel or two each
SIDES = ("x1", "y1", "x2", "y2")


def _tile(v: Column) -> Column:
    side = F.expr("shiftleft(1, _depth)")
    return F.least(F.greatest(F.floor(v * side), F.lit(0)), side - 1).cast("int")


def _with_depth(rows: DataFrame, screen: list[str], crowded: DataFrame | None, few: bool) -> DataFrame:
    if crowded is None:
        return rows.withColumn("_depth", F.lit(0))
    return rows.join(F.broadcast(crowded) if few else crowded, screen, "left").withColumn("_depth", F.coalesce("_depth", F.lit(0)))


def _batches_of_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that come in order of ``keys``, as many as a batch ends: (rows, number of each row's group)."""
    def steps(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            c = t.column(k).combine_chunks()
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        return new

    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        both = pa.concat_tables([held[-2].slice(held[-2].num_rows - 1), held[-1]]) if len(held) > 1 else held[-1]
        starts = np.flatnonzero(steps(both)) - (1 if len(held) > 1 else 0)
        if len(starts):
            whole = pa.concat_tables([*held[:-1], held[-1].slice(0, starts[-1])])
            held = [held[-1].slice(starts[-1])]
            if whole.num_rows:
                yield whole, steps(whole).cumsum()
    if held:
        whole = pa.concat_tables(held)
        yield whole, steps(whole).cumsum()


def _meet(points: DataFrame, boxes: DataFrame, screen: list[str], order: list[str],
          search: Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``search`` over (points, their groups, boxes in ``order``, their groups), some tiles at a time; rows without a screen or with null coordinates stay out."""
    known = reduce_and([F.col(c).isNotNull() for c in screen])
    points = points.filter(known & F.col("x").isNotNull() & F.col("y").isNotNull())
    boxes = boxes.filter(known & reduce_and([F.col(c).isNotNull() for c in SIDES]))
    sizes = points.select(*screen).unionByName(boxes.select(*screen)).groupBy(*screen).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > TILE_ROWS)
    crowded = sizes.select(*screen, F.least(F.lit(MAX_DEPTH), F.ceil(F.log(F.col("_n") / TILE_ROWS) / F.log(F.lit(4.0)))).cast("int").alias("_depth"))
    crowded = pin(crowded)          # counted once; what is asked below looks at few rows
    few = broadcast_if_small(crowded) is not None
    if few and crowded.isEmpty():
        crowded = None
    span = lambda a, z: F.explode(F.sequence(_tile(F.col(a)), F.greatest(_tile(F.col(a)), _tile(F.col(z)))))
    p = _with_depth(points, screen, crowded, few).withColumns({"_tx": _tile(F.col("x")), "_ty": _tile(F.col("y"))}).drop("_depth")
    b = _with_depth(boxes, screen, crowded, few).withColumn("_tx", span("x1", "x2")).withColumn("_ty", span("y1", "y2")).drop("_depth")
    keys = [*screen, "_tx", "_ty"]
    rows = (p.withColumn("_box", F.lit(False)).unionByName(b.withColumn("_box", F.lit(True)), allowMissingColumns=True)
            .repartition(*keys).sortWithinPartitions(*keys, "_box", *order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _batches_of_groups(batches, keys):
            box = t.column("_box").to_numpy()
            if box.any() and not box.all():
                yield from search(t.filter(pa.array(~box)), group[~box], t.filter(pa.array(box)), group[box]).to_batches()

    return rows.mapInArrow(run, schema)


def reduce_and(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def _corners(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(c).to_numpy() for c in SIDES], axis=1)


def _fields(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def sides(bbox: str, pad: float) -> list[Column]:
    b = F.col(bbox)
    return [(b[c].cast("double") + (pad if c in ("x2", "y2") else -pad)).alias(c) for c in SIDES]


def first_box(points: DataFrame, boxes: DataFrame, screen: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """(screen, x, y, carry) of every point that lies in a box, from the first box around it by ``order``.

    points: screen, x, y. boxes: screen, x1, y1, x2, y2, ``order`` and ``carry`` columns.
    """
    def search(p: pa.Table, group: np.ndarray, b: pa.Table, box_group: np.ndarray) -> pa.Table:
        best, _ = spatial.first_box(group, p.column("x").to_numpy(), p.column("y").to_numpy(), box_group, _corners(b))
        hit = np.flatnonzero(best >= 0)
        own, found = p.select([*screen, "x", "y"]).take(hit), b.select(carry).take(best[hit])
        return pa.table([*own.columns, *found.columns], names=[*own.column_names, *found.column_names])

    schema = f"{_fields(points, screen)}, x double, y double, {_fields(boxes, carry)}"
    return _meet(points, boxes, screen, order, search, schema)


def any_inside(points: DataFrame, boxes: DataFrame, screen: list[str], key: str, flags: list[str]) -> DataFrame:
    """(key, flags) of every box and tile with a flag set: some point inside the box has it. points: screen, x, y, flags; boxes: screen, x1, y1, x2, y2, key."""
    def search(p: pa.Table, group: np.ndarray, b: pa.Table, box_group: np.ndarray) -> pa.Table:
        marks = np.stack([p.column(f).to_numpy() for f in flags], axis=1).astype(bool)
        found, _ = spatial.any_flags(group, p.column("x").to_numpy(), p.column("y").to_numpy(), marks, box_group, _corners(b))
        hit = np.flatnonzero(found.any(axis=1))
        return pa.table([b.column(key).take(hit), *[pa.array(found[hit, k]) for k in range(len(flags))]], names=[key, *flags])

    schema = f"{_fields(boxes, [key])}, " + ", ".join(f"`{f}` boolean" for f in flags)
    return _meet(points, boxes, screen, [], search, schema)
