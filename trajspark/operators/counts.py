"""Frequency tables and simple profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, share
from ..functions.strings import nonempty
from ..session import pin
from .ordered import OrderedRows



def value_counts(df: DataFrame, *cols: str, limit: int | None = None) -> DataFrame:
    """How often each combination occurs, most common first, ties by value."""
    out = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *cols)
    return out.limit(limit) if limit else out


def array_value_counts(df: DataFrame, array_col: str) -> DataFrame:
    """``value_counts`` over the items of an array column."""
    return value_counts(df.select(F.explode(array_col).alias("item")), "item")


def length_summary(df: DataFrame, length: Column, entity: str | None = None, by=()) -> DataFrame:
    """Row count, shortest, longest and mean length; distinct entities if a column is named."""
    d = df.select(*by, length.alias("_len"), *([F.col(entity).alias("_e")] if entity else []))
    aggs = [F.count(F.lit(1)).alias("n"), F.min("_len").cast("long").alias("min_len"),
            F.max("_len").cast("long").alias("max_len"), F.avg("_len").alias("avg_len")]
    if entity:
        aggs.append(F.count_distinct("_e").alias("entities"))
    return d.groupBy(*by).agg(*aggs)


def reject_report(df: DataFrame, source: str = "source", reason: str = "reject_reason") -> DataFrame:
    """Rejected rows per source and reason."""
    return value_counts(df.filter(F.col(reason).isNotNull()), source, reason)


def dataset_profile(df: DataFrame, thought: str = "thought", by=("split",)) -> DataFrame:
    """Rows, and how many of them carry a thought, per split."""
    has = nonempty(thought).isNotNull()
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(has).alias("with_thought"),
                               share(has).alias("thought_share"))


def series_table(df: DataFrame, group: str, series: str, value: Column, names=None) -> DataFrame:
    """Chart-ready table: one row per group, one column per series."""
    return df.groupBy(group).pivot(series, list(names) if names else None).agg(value)


def counted_values(df: DataFrame, value: str, by=()) -> DataFrame:
    """How often each value occurs per group (``_v``, ``_n``): pinned, so what it came from runs once."""
    return pin(df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v"))
               .agg(F.count(F.lit(1)).alias("_n")))


def medians(df: DataFrame, value: str, by=()) -> DataFrame:
    """Exact medians per group: ``median_upper`` (item n // 2) and ``median_mid`` (interpolated).

    Equal values are counted before anything is ordered; a group with very many distinct
    values is cut into pieces by ``OrderedRows``.
    """
    return medians_of(counted_values(df, value, by), by)


def medians_of(counted: DataFrame, by=()) -> DataFrame:
    by = list(by)
    keys = by or ["_all"]
    c = counted if by else counted.withColumn("_all", F.lit(0))
    cum = OrderedRows(c, keys, "_v").running({"_cum": ("sum", F.col("_n"))}).df()
    totals = c.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    lo, hi = F.expr("(_total + 1) div 2"), F.expr("_total div 2 + 1")
    out = cum.join(totals, keys).groupBy(*keys).agg(
        F.max("_total").alias("n_values"),
        F.min(F.when(F.col("_cum") >= lo, F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("_cum") >= hi, F.col("_v"))).alias("median_upper"))
    return out.select(*by, "n_values", "median_upper", ((F.col("_lo") + F.col("median_upper")) / 2).alias("median_mid"))


def rate_table(df: DataFrame, hit: Column, dims, more: dict | None = None) -> DataFrame:
    """Hit rate overall and per value of each dimension, in one scan (grouping sets).

    Columns: dimension ("all" or the column name), value, hit, total, rate, and a count for each of the conditions ``more``.
    """
    more = more or {}
    d = df.select(*[F.col(c).cast("string").alias(c) for c in dims], F.coalesce(hit, F.lit(False)).alias("_hit"),
                  *[F.coalesce(c, F.lit(False)).alias("_" + n) for n, c in more.items()])
    sets = [[]] + [[F.col(c)] for c in dims]
    g = d.groupingSets(sets, *dims).agg(
        F.grouping_id().alias("_gid"), F.count_if("_hit").alias("hit"), F.count(F.lit(1)).alias("total"), *[F.count_if("_" + n).alias(n) for n in more])
    full = (1 << len(dims)) - 1
    name, val = F.when(F.col("_gid") == full, F.lit("all")), F.when(F.col("_gid") == full, F.lit("all"))
    for i, c in enumerate(dims):
        gid = full & ~(1 << (len(dims) - 1 - i))
        name, val = name.when(F.col("_gid") == gid, F.lit(c)), val.when(F.col("_gid") == gid, F.col(c))
    return g.select(name.alias("dimension"), val.alias("value"), "hit", "total", ratio("hit", "total").alias("rate"), *more)
