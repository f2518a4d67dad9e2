"""Ranks and cuts over a whole table without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import pin

PREFIX = 3      # hex digits of the hash that make a bucket: at most 16**3 = 4096 buckets, and as many inside of each


def seed_hash(key, seed: int) -> Column:
    """A seeded order that any engine reproduces: md5 of ``seed:key``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def prefix_counts(df: DataFrame, hash_col: str, by=()) -> DataFrame:
    """Rows per class and prefix of the hash (``_b``, ``_n``): one read, counted inside each task before anything moves."""
    return df.groupBy(*by, F.substring(hash_col, 1, PREFIX).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))


def _edge(counts: DataFrame, by: list[str], want: Column) -> DataFrame:
    """The bucket that holds the wanted row (one per ``by``) and how many of its rows are wanted (``_rest``)."""
    up_to = W.partitionBy(*(by or [F.lit(1)])).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("_cum", F.sum("_n").over(up_to)).withColumn("_want", want.cast("long"))
    inside = (F.col("_cum") - F.col("_n") < F.col("_want")) & (F.col("_want") <= F.col("_cum"))
    return counts.filter(inside).select(*by, "_b", (F.col("_want") - F.col("_cum") + F.col("_n")).alias("_rest"))


def _in_edge(d: DataFrame, edge: DataFrame, by: list[str], bucket: Column) -> DataFrame:
    """Rows of the edge buckets. Null-safe, so that no filter is inferred on one reader of a shared exchange only."""
    edge = edge.select(*[F.col(c).alias("_e_" + c) for c in by], F.col("_b").alias("_e"), "_rest")
    on = bucket.eqNullSafe(F.col("_e"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col("_e_" + c))
    return d.join(F.broadcast(edge), on).drop("_e", *["_e_" + c for c in by])       # at most one row per class


def hash_cutoffs(df: DataFrame, hash_col: str, want, by=(), counts: DataFrame | None = None) -> DataFrame:
    """The n-th smallest hash (per ``by``), one row each, column ``cutoff``; no row where n is 0.

    ``want`` is a function of the number of hashes that gives n, or a table (``by``, want). Hashes are even, so one read counts them per
    prefix and finds the prefix the n-th hash lies in (``counts``: the same ``prefix_counts`` where the caller has them), and a second
    one takes that prefix's rows, 1 of 4096, into an exchange; counting there per longer prefix leaves 1 row of 16 million to be
    ordered. Windows run over at most 4096 counts per ``by``, which must have few values (classes, splits). Null hashes do not count.
    """
    by = list(by)
    d = df.select(*by, F.col(hash_col).alias("_h"))
    counts = counts if counts is not None else prefix_counts(d, "_h", by)
    # no filter, which would go below the counting and so part the readers of one exchange
    counts = counts.withColumn("_n", F.when(F.col("_b").isNull(), 0).otherwise(F.col("_n")))
    if isinstance(want, DataFrame):
        wanted = want.select(*[F.col(c).alias("_w_" + c) for c in by], F.col("want").alias("_wanted"))
        same = [F.col(c).eqNullSafe(F.col("_w_" + c)) for c in by]
        counts = counts.join(F.broadcast(wanted), same).drop(*["_w_" + c for c in by])        # one row per class
        n = F.col("_wanted")
    else:
        n = want(F.sum("_n").over(W.partitionBy(*(by or [F.lit(1)]))))
    inner = _in_edge(d, _edge(counts, by, n), by, F.substring("_h", 1, PREFIX))
    longer = F.substring("_h", 1, 2 * PREFIX)
    inner = inner.withColumnRenamed("_rest", "_left").repartition(*by, longer)          # read twice, moved once
    finer = inner.groupBy(*by, "_left", longer.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    # true of every row; both readers of the exchange thus need the same columns of it
    last = _in_edge(inner, _edge(finer, by, F.col("_left")), by, longer).filter(F.coalesce(F.col("_rest") <= F.col("_left"), F.lit(True)))
    nth = W.partitionBy(*by, "_rest").orderBy("_h")
    return (last.withColumn("_rn", F.row_number().over(nth)).filter(F.col("_rn") == F.col("_rest"))
            .select(*by, F.col("_h").alias("cutoff")))


def below(hash_col: str, cutoff: DataFrame) -> Column:
    """Condition: the row's hash is among the first n (false for n = 0)."""
    return F.coalesce(F.col(hash_col) <= cutoff.select("cutoff").scalar(), F.lit(False))


def global_rank(df: DataFrame, order, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add the 1-based rank over the whole table.

    Rows are range-partitioned once and pinned; each partition ranks its own rows and adds
    the number of rows in the partitions before it. ``order`` should end in a unique column,
    so that equal values spread over partitions.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = pin(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    sizes = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(
        W.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy("_pid").orderBy(*order))
    return (parts.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (local + F.col("_before")).cast("long")).drop("_pid", "_before"))


def top_n(df: DataFrame, n: int, order) -> DataFrame:
    """First ``n`` rows in an order: Spark keeps n per task and merges (a heap, not a full sort)."""
    return df.orderBy(*order).limit(n)
