"""Splits, balancing, exact de-duplication, overlaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.strings import text_key
from .matching import lookup_join
from .ranking import below, hash_cutoffs, prefix_counts, seed_hash


def _int(c: Column) -> Column:
    return F.floor(c).cast("long")


def group_size(ratio: float) -> Callable[[Column], Column]:
    """Number of held-out groups: at least one."""
    return lambda total: F.greatest(F.lit(1), _int(total * ratio))


def split_by_group(df: DataFrame, key: str, ratio: float = 0.1, seed: int = 42,
                   names=("train", "val")) -> DataFrame:
    """Whole groups go to one side. The choice is a hash cut-off over the distinct keys, so the
    rows themselves are neither shuffled nor joined."""
    keys = df.select(key).distinct().withColumn("_h", seed_hash(key, seed))
    cut = hash_cutoffs(keys, "_h", group_size(ratio))
    return (df.withColumn("_h", seed_hash(key, seed))
            .withColumn("split", F.when(below("_h", cut), names[1]).otherwise(names[0])).drop("_h"))


def split_rows(df: DataFrame, key, want: Callable[[Column], Column] | None = None, ratio: float = 0.1,
               seed: int = 42, at_least_one: bool = False, names=("train", "val")) -> DataFrame:
    """Row-wise split of exactly int(N * ratio) rows, or max(1, N // 10) with ``at_least_one``."""
    if want is None:
        want = (lambda t: F.greatest(F.lit(1), F.expr("1") * _int(t / 10))) if at_least_one else (
            lambda t: _int(t * ratio))
    d = df.withColumn("_h", seed_hash(key, seed))
    cut = hash_cutoffs(d, "_h", want)
    return d.withColumn("split", F.when(below("_h", cut), names[1]).otherwise(names[0])).drop("_h")


def split_map(df: DataFrame, key: str) -> DataFrame:
    """One row per group with its split."""
    return df.groupBy(key).agg(F.max("split").alias("split"))


def apply_split(df: DataFrame, mapping: DataFrame, key: str, default: str = "train") -> DataFrame:
    """Give the rows of another table the split of their group."""
    return lookup_join(df, mapping, key).withColumn("split", F.coalesce("split", F.lit(default)))


def overlap(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys present on both sides."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_semi")


def difference(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` does not have."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def assert_disjoint(a: DataFrame, b: DataFrame, *keys: str) -> None:
    """Fail if a group is on both sides."""
    leaked = overlap(a, b, *keys).take(5)
    if leaked:
        raise ValueError(f"found on both sides: {[tuple(r) for r in leaked]}")


def respect_holdout(df: DataFrame, split: str = "split", test: str = "test") -> tuple[DataFrame, DataFrame]:
    """(pool, held out): the official test part stays whole and leaves the pool; rows without a split are pool."""
    held = F.col(split).eqNullSafe(F.lit(test))
    return df.filter(~held), df.filter(held)


def balance_quotas(have: DataFrame, ref: DataFrame, cls: str) -> DataFrame:
    """How many rows of each class to keep so that shares follow a reference.

    The tightest class with at least 10 % of the reference sets the total; without one, the
    tightest class that occurs in it; without any, everything stays. Both inputs are counts
    per class (class, n): one row per action type.
    """
    all_ref = F.sum("r").over(W.partitionBy(F.lit(0)))
    t = (have.withColumnRenamed("n", "have").join(ref.withColumnRenamed("n", "r"), cls, "full")
         .withColumn("share", F.coalesce("r", F.lit(0)) / all_ref))
    possible = F.when(F.col("have").isNotNull() & (F.col("share") > 0), F.col("have") / F.col("share"))
    one = W.partitionBy(F.lit(0))
    k = F.coalesce(F.min(F.when(F.col("share") >= V.MAJOR_SHARE, possible)).over(one), F.min(possible).over(one))
    t = t.withColumn("_k", k).filter(F.col("have").isNotNull())
    quota = F.when(F.col("_k").isNull(), F.col("have")).otherwise(
        F.least(F.col("have"), F.bround(F.col("_k") * F.col("share")).cast("long")))
    return t.select(cls, "have", quota.cast("long").alias("quota"))


def balance_to_reference(samples: DataFrame, reference: DataFrame, cls: str, key, seed: int = 42) -> DataFrame:
    """Down-sample classes to the shares of a reference; rows are picked in seeded order."""
    d = samples.withColumn("_h", seed_hash(key, seed))
    counts = prefix_counts(d, "_h", [cls])          # classes are counted and cut from the same read
    quotas = balance_quotas(counts.groupBy(cls).agg(F.sum("_n").alias("n")),
                            reference.groupBy(cls).agg(F.count(F.lit(1)).alias("n")), cls)
    cuts = hash_cutoffs(d, "_h", quotas.select(cls, F.col("quota").alias("want")), by=[cls], counts=counts)
    cuts = F.broadcast(cuts.withColumnRenamed(cls, "_cls"))         # one row per action type
    return d.join(cuts, F.col(cls).eqNullSafe(F.col("_cls")) & (F.col("_h") <= F.col("cutoff"))).drop("_h", "_cls", "cutoff")


def dedupe_samples(df: DataFrame, keys=("prompt", "response"), order=("ord",), within=()) -> DataFrame:
    """Keep the first of equal samples, whatever their image, inside each split.

    Each task first keeps one row per key it sees, so copies do not travel.
    """
    w = W.partitionBy(*within, "_key").orderBy(*order)
    return (df.withColumn("_key", text_key(*keys)).withColumn("_rn", F.row_number().over(w))
            .filter("_rn = 1").drop("_key", "_rn"))


def union_samples(*parts: DataFrame) -> DataFrame:
    """All sample kinds under one schema; ``part`` keeps the order in which they were given."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out
