"""Writers and the incremental feature table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin
from .readers import only_missing


def write_splits(df: DataFrame, path: str, by=("split",), fmt: str = "json", rows_per_file: int = 1_000_000) -> None:
    """One folder per split. Tasks write what they hold; a large split is many files, never one task."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).format(fmt).save(path)


def write_manifest(spark: SparkSession, path: str, train_split: str) -> None:
    """Note what was trained on; the audit reads it."""
    held_out = "val" not in train_split.split("+")
    spark.createDataFrame([(train_split, held_out)], "train_split string, val_is_held_out boolean") \
        .coalesce(1).write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, group: str | None = None, series: str | None = None,
                 value: str | None = None) -> DataFrame:
    """Nested JSON beside a pivoted table; the table is returned as well."""
    df.write.mode("overwrite").json(path + "/detail")
    table = df.groupBy(group).pivot(series).agg(F.first(value, True)) if series else df
    table.write.mode("overwrite").json(path + "/table")
    return table


def materialize_missing(keys: DataFrame, path: str, key: str, schema: str,
                        compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(features of the wanted keys, one row with hits and computed); the cache is the Parquet folder ``path``.

    Only keys that the cache does not have are computed; they are appended to it, so that another run computes nothing.
    """
    spark = keys.sparkSession

    def cached() -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            only_missing(e)
            return spark.createDataFrame([], schema)

    wanted = pin(keys.select(key).distinct())
    before = cached()
    hits = before.join(wanted, key, "left_semi").count()
    missing = keys.dropDuplicates([key]).join(before.select(key), key, "left_anti")
    fresh = pin(compute(missing).select(*before.columns))       # reads the cache as it was
    computed = fresh.count()
    if computed:
        fresh.write.mode("append").parquet(path)
    return cached().join(wanted, key, "left_semi"), spark.createDataFrame([(hits, computed)], "hits long, computed long")


def require_cached(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Features of the keys from the cache alone; a key without one is an error when the row is read."""
    have = cache.withColumn("_in_cache", F.lit(True))
    d = keys.join(have, key, "left")
    fail = F.raise_error(F.concat(F.lit("not in the cache: "), F.col(key).cast("string")))
    return d.withColumn("_in_cache", F.when(F.col("_in_cache"), True).otherwise(fail)).filter("_in_cache").drop("_in_cache")
