"""Running values and look-back over ordered groups, safe when one group is huge.

A window puts a whole group into one task. Here groups above ``hot_rows`` rows are cut into
range partitions of (keys, order) first: windows then run inside the pieces, and a small
table with one row per piece carries the state from piece to piece. Groups below the limit
take the plain window, which is one shuffle for any number of calls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import pin

HOT_ROWS = 2_000_000
PIECE_ROWS = 500_000    # of a piece, about, once there are PIECES
PIECES = 64
SEG = "_segment"

_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def _combine(fn: str, carry: Column, local: Column) -> Column:
    if fn == "max":
        return F.greatest(carry, local)
    if fn == "min":
        return F.least(carry, local)
    both = F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    return both if fn == "count" else F.when(carry.isNull() & local.isNull(), None).otherwise(both)


def same_keys(a: DataFrame, b: DataFrame, keys) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


class OrderedRows:
    """Rows of ``df`` grouped by ``keys`` and ordered by the columns ``order`` (ascending, unique per group)."""

    def __init__(self, df: DataFrame, keys, order, hot_rows: int | None = HOT_ROWS, _parts=None):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.order = [order] if isinstance(order, str) else list(order)
        self._parts = _parts if _parts is not None else self._cut(df, hot_rows)

    def _cut(self, df: DataFrame, hot_rows: int | None):
        if hot_rows is None:        # the caller knows a bound on the group size
            return [(df, False)]
        sizes = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
        hot = sizes.filter(F.col("_n") > hot_rows)
        total = hot.agg(F.sum("_n")).first()[0]
        if not total:
            return [(df, False)]
        # there are at most (all rows / hot_rows) hot keys, so this side is small by construction
        hot = F.broadcast(hot.drop("_n"))
        cold = df.join(hot, same_keys(df, hot, self.keys), "left_anti")
        big = df.join(hot, same_keys(df, hot, self.keys), "left_semi")
        # the driver gets a sample and a row of carries per piece, so a low limit does not make ever more of them
        pieces = max(2, min(2 * -(-int(total) // hot_rows), PIECES + int(total) // PIECE_ROWS))
        big = pin(big.repartitionByRange(pieces, *self.keys, *self.order).withColumn(SEG, F.spark_partition_id()))
        return [(cold, False), (big, True)]

    def _with(self, parts) -> "OrderedRows":
        return OrderedRows(None, self.keys, self.order, _parts=parts)

    def map(self, fn) -> "OrderedRows":
        """Apply a row-wise DataFrame transformation."""
        return self._with([(fn(d), hot) for d, hot in self._parts])

    def _window(self, hot: bool):
        return W.partitionBy(*self.keys, *([SEG] if hot else [])).orderBy(*self.order)

    def running(self, specs: dict, before: bool = False) -> "OrderedRows":
        """Add running aggregates ``{name: (fn, column)}``; ``before`` leaves the own row out."""
        end = -1 if before else 0
        out = []
        for d, hot in self._parts:
            w = self._window(hot).rowsBetween(W.unboundedPreceding, end)
            r = d.select("*", *[_AGG[fn](c).over(w).alias(n) for n, (fn, c) in specs.items()])
            if hot:
                totals = d.groupBy(*self.keys, SEG).agg(
                    *[_AGG[fn](c).alias("_t_" + n) for n, (fn, c) in specs.items()])
                prior = W.partitionBy(*self.keys).orderBy(SEG).rowsBetween(W.unboundedPreceding, -1)
                fold = {"count": F.sum}
                carry = totals.select(*[F.col(k) for k in self.keys], SEG, *[
                    fold.get(fn, _AGG[fn])("_t_" + n).over(prior).alias("_c_" + n) for n, (fn, c) in specs.items()])
                r = self._attach(r, carry)
                r = r.select(*[c for c in r.columns if c not in specs and not c.startswith("_c_")], *[
                    _combine(fn, F.col("_c_" + n), F.col(n)).alias(n) for n, (fn, c) in specs.items()])
            out.append((r, hot))
        return self._with(out)

    def previous(self, name: str, payload: Column, k: int) -> "OrderedRows":
        """Add an array with the ``payload`` of up to ``k`` rows before the own one, oldest first."""
        out = []
        for d, hot in self._parts:
            w = self._window(hot).rowsBetween(-k, -1)
            boxed = F.struct(payload.alias("v"))
            r = d.withColumn(name, F.collect_list(boxed).over(w))
            if hot:
                back = W.partitionBy(*self.keys, SEG).orderBy(*[F.col(o).desc() for o in self.order])
                last = (d.withColumn("_v", boxed).withColumn("_back", F.row_number().over(back))
                        .filter(F.col("_back") <= k)
                        .groupBy(*self.keys, SEG)
                        .agg(F.collect_list(F.struct("_back", "_v")).alias("_tail")))
                last = last.withColumn("_tail", F.transform(F.array_sort(
                    "_tail", lambda a, b: b["_back"] - a["_back"]), lambda t: t["_v"]))
                prior = W.partitionBy(*self.keys).orderBy(SEG).rowsBetween(-k, -1)
                carry = last.select(*[F.col(c) for c in self.keys], SEG,
                                    F.flatten(F.collect_list("_tail").over(prior)).alias("_c_tail"))
                r = self._attach(r, carry)
                both = F.concat(F.col("_c_tail"), F.col(name))
                r = r.withColumn(name, F.slice(both, F.greatest(F.size(both) - k + 1, F.lit(1)), k)).drop("_c_tail")
            out.append((r.withColumn(name, F.transform(name, lambda s: s["v"])), hot))
        return self._with(out)

    def _attach(self, rows: DataFrame, carry: DataFrame) -> DataFrame:
        # one row per piece of a hot group: bounded by the number of pieces
        on = self.keys + [SEG]
        c = carry.select(*[F.col(k).alias("_k_" + k) for k in on], *[c for c in carry.columns if c not in on])
        cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in on])
        return rows.join(F.broadcast(c), cond, "left").drop(*["_k_" + k for k in on])

    def position(self, name: str = "position") -> "OrderedRows":
        """Add the 1-based position inside the group."""
        return self.running({name: ("count", F.lit(1))})

    def df(self) -> DataFrame:
        parts = [d.drop(SEG) for d, _ in self._parts]
        return reduce(lambda a, b: a.unionByName(b), parts)
