"""Limits, spread and grid samples, quotas and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import geometry as G
from ..functions.strings import is_blank, let
from .ordered import HOT_ROWS, OrderedRows
from .ranking import global_rank, hash_cutoffs, below, seed_hash, top_n


def head(df: DataFrame, n: int, *order) -> DataFrame:
    return top_n(df, n, order)


def failure_sample(df: DataFrame, n: int, hit: str, *order) -> DataFrame:
    """First ``n`` misses in order, for inspection."""
    return top_n(df.filter(~F.coalesce(F.col(hit), F.lit(False))), n, order)


def spread_sample(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Rows at the positions int(i * N / n) in the order of the columns ``order``.

    Only these columns are ranked; the at most ``n`` keys picked go out to the rows. Of rows that are equal in all of them as many are
    taken as positions fall on them.
    """
    keys = df.select(*order)
    ranked = global_rank(keys, order, "_rank")
    total = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    r, step = (F.col("_rank") - 1).cast("double"), total.cast("double") / F.lit(float(n))
    guess = F.ceil(r / step)
    taken = F.lit(False)
    for d in (-1, 0, 1):
        i = guess + d
        taken = taken | ((i >= 0) & (i < n) & (F.floor(i * step) == r))
    picked = ranked.filter((total <= n) | taken).groupBy(*[F.col(c).alias("_k_" + c) for c in order]).agg(F.count(F.lit(1)).alias("_take"))
    same = [F.col(c).eqNullSafe(F.col("_k_" + c)) for c in order]
    found = df.join(F.broadcast(picked), same)      # at most n keys
    equal = W.partitionBy(*order).orderBy(*order)
    return (found.withColumn("_rn", F.row_number().over(equal)).filter("_rn <= _take")
            .drop("_rn", "_take", *["_k_" + c for c in order]))


def grid_sample(df: DataFrame, n: int, bbox: str, order: str, by=(), grid: int = 3) -> DataFrame:
    """Round-robin over grid cells: the first of every cell, then the second, ... until ``n``.

    Ranks above ``n`` are pruned inside each task before anything is shuffled.
    """
    by = list(by)
    c = G.box_center(bbox)

    def cell(v):
        return F.least(F.lit(grid - 1), (v * grid).cast("int"))

    d = df.withColumn("_gx", cell(c["x"])).withColumn("_gy", cell(c["y"]))
    w = W.partitionBy(*by, "_gx", "_gy").orderBy(order)
    d = d.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    if not by:
        out = d.orderBy("_rn", "_gx", "_gy").limit(n)
    else:
        pick = W.partitionBy(*by).orderBy("_rn", "_gx", "_gy")
        out = d.withColumn("_pick", F.row_number().over(pick)).filter(F.col("_pick") <= n).drop("_pick")
    return out.drop("_rn", "_gx", "_gy")


def seeded_order(df: DataFrame, key, seed: int, name: str = "shuffle_key") -> DataFrame:
    """Add a seeded random sort key that every engine computes alike."""
    return df.withColumn(name, seed_hash(key, seed))


def seeded_sample(df: DataFrame, key, n: int, seed: int) -> DataFrame:
    """``n`` random rows (all if there are fewer); ``key`` must be unique."""
    d = seeded_order(df, key, seed, "_h")
    cut = hash_cutoffs(d, "_h", lambda total: F.least(total, F.lit(n)))
    return d.filter(below("_h", cut)).drop("_h")


def length_batches(df: DataFrame, size: int, seed: int, length: Column, key: str) -> DataFrame:
    """Cut rows sorted by length into batches and give the batches a random order.

    Adds ``batch`` and ``batch_order``; sort by (batch_order, batch_rank) to read them out.
    """
    d = global_rank(df.withColumn("_len", length), ["_len", key], "batch_rank")
    return (d.withColumn("batch", F.expr(f"(batch_rank - 1) div {int(size)}"))
            .withColumn("batch_order", seed_hash("batch", seed)).drop("_len"))


def quota_room(limit: int, reserved: int, named: Column) -> Column:
    """Places for unnamed elements: what is guaranteed to them or what the named leave free."""
    return F.greatest(F.lit(min(reserved, limit // 2)), F.lit(limit) - named)


def select_with_quota(elements: DataFrame, screen: str = "screen_id", order: str = "id", limit: int = V.MAX_ELEMENTS,
                      reserved: int = V.RESERVED_FOR_UNNAMED) -> DataFrame:
    """Elements to show per screen: named ones first, icon boxes with their guaranteed places.

    Adds ``shown`` (1-based place). No more than ``limit`` rows of either kind can matter, so
    both are pruned to that before they are counted.
    """
    limit = limit if isinstance(limit, int) else max(limit)
    named = ~is_blank("text")
    d = elements.withColumn("_named", named).filter(F.col("_named") | (F.col("source") == "cv"))
    w = W.partitionBy(screen, "_named").orderBy(order)
    d = d.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    whole = W.partitionBy(screen)          # at most 2 * limit rows
    n_named = F.count_if("_named").over(whole)
    n_other = F.count_if(~F.col("_named")).over(whole)
    d = d.withColumn("_a", n_named).withColumn("_b", n_other)
    keep = F.least(F.least(quota_room(limit, reserved, F.col("_a")), F.lit(limit)), F.col("_b"))
    d = d.withColumn("_keep", keep)
    first = F.least(F.col("_a"), F.lit(limit) - F.col("_keep"))
    ok = F.when(F.col("_named"), F.col("_rn") <= first).otherwise(F.col("_rn") <= F.col("_keep"))
    place = F.when(F.col("_named"), F.col("_rn")).otherwise(first + F.col("_rn"))
    return d.filter(ok).withColumn("shown", place.cast("int")).drop("_named", "_rn", "_a", "_b", "_keep")


def screen_lists(elements: DataFrame, screen: str = "screen_id", order: str = "id", limit=V.MAX_ELEMENTS,
                 name: str = "elements") -> DataFrame:
    """One array per screen with all that a list of up to ``limit`` elements (the largest, of several) can show.

    Of either kind only the first ``limit`` can ever be chosen, so arrays hold at most twice that
    many, however many elements a screen has; the rest is pruned inside each task.
    """
    limit = limit if isinstance(limit, int) else max(limit)
    named = ~is_blank("text")
    d = elements.withColumn("_named", named).filter(F.col("_named") | (F.col("source") == "cv"))
    w = W.partitionBy(screen, "_named").orderBy(order)
    d = d.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    item = F.struct(F.col(order).alias("_o"), "id", "bbox", "text", "source")
    return d.groupBy(screen).agg(F.transform(F.sort_array(F.collect_list(item)), lambda e: F.struct(
        e["id"].alias("id"), e["bbox"].alias("bbox"), e["text"].alias("text"), e["source"].alias("source"))).alias(name))


def named_of(elements) -> Column:
    """Elements of an array that have a text."""
    e = F.col(elements) if isinstance(elements, str) else elements
    return F.filter(e, lambda x: ~is_blank(x["text"]))


def other_of(elements) -> Column:
    """Icon boxes of an array: no text, but a known source."""
    e = F.col(elements) if isinstance(elements, str) else elements
    return F.filter(e, lambda x: is_blank(x["text"]) & (x["source"] == "cv"))


def quota_split(named: Column, other: Column, limit, reserved: int = V.RESERVED_FOR_UNNAMED) -> tuple[Column, Column]:
    """How many of ``named`` and of ``other`` elements (counts) a list of ``limit`` shows."""
    k = F.lit(limit) if isinstance(limit, int) else limit
    half = F.least(F.lit(reserved), F.floor(k / 2).cast("int"))
    kept = F.least(F.least(F.greatest(half, k - named), k), other)
    return F.least(named, k - kept), kept


def take_with_quota(named: Column, other: Column, limit, reserved: int = V.RESERVED_FOR_UNNAMED) -> Column:
    first, kept = quota_split(F.size(named), F.size(other), limit, reserved)
    return F.concat(F.slice(named, F.lit(1), first), F.slice(other, F.lit(1), kept))


def select_array_with_quota(elements, limit, reserved: int = V.RESERVED_FOR_UNNAMED) -> Column:
    """The same over an array column (one screen per row); ``limit`` is a number or a column."""
    k = F.lit(limit) if isinstance(limit, int) else limit
    return let({"named": named_of(elements), "other": other_of(elements), "k": k}, lambda v: take_with_quota(
        v["named"], v["other"], v["k"], reserved))


def two_stage_topk(df: DataFrame, bbox: str, order: str, by=(), n: int = V.CV_MAX_ELEMENTS,
                   typical: float = V.CV_TYPICAL_SIDE) -> DataFrame:
    """The ``n`` largest boxes per group, then ranked by how close they are to icon size."""
    by = list(by)
    d = df.withColumn("_area", G.box_area(bbox))
    if by:
        area = W.partitionBy(*by).orderBy(F.desc("_area"), order)
        d = d.withColumn("_rn", F.row_number().over(area)).filter(F.col("_rn") <= n).drop("_rn")
    else:
        d = d.orderBy(F.desc("_area"), order).limit(n)
    like = W.partitionBy(*(by or [F.lit(0)])).orderBy("_like", F.desc("_area"), order)      # at most n rows per group
    d = d.withColumn("_like", G.icon_likeness(bbox, typical))
    return d.withColumn("id", (F.row_number().over(like) - 1).cast("int")).drop("_area", "_like")


def filter_detections(df: DataFrame, screen: str = "screen_id", order=("id",), min_conf: float = V.MIN_CONFIDENCE,
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    """Detections of enough confidence, renumbered from 0 per screen without gaps."""
    d = df.filter(F.col("confidence") >= min_conf)
    o = OrderedRows(d, screen, list(order), hot_rows).position("_p")
    return o.df().withColumn("new_id", (F.col("_p") - 1).cast("int")).drop("_p")
