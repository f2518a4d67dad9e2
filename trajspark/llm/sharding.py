"""Sharding by histogram sort: shards of near equal bytes, in key order, with gapless slots.

A row's key is 64 bits: 40 of a hash of the text, so that equal texts stand side by side, and 24 of a hash of
the id, so that even a text that fills many shards can be cut. The driver keeps a sorted list of probes. Each
round counts the rows and bytes between probes exactly (partial counts in the tasks, one row per
probe at the end) and splits the ranges that hold a cut and are heavier than the tolerance, or that hold too
many rows for one task. When all cuts are good, rows are exchanged once, by range. Rows of a single key that are still too
many (equal text and id) are numbered, by counts per partition, and cut by number.

A null text has no bytes, a null id hashes like an empty one; rows of one key are ordered by id and text
checksum and equal rows among themselves at random; other columns stay as they are (one named
like a result is replaced). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import pin
from .registry import query, table

SHARDS = 24
TOLERANCE = 0.0005          # of a shard's bytes, by which a cut may miss
RANGES = 1_000              # a range ordered in one task holds at most about this part of all rows
SPLIT = 32
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def row_key(text: Column, doc_id: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 24) - 1))
    return F.shiftleft(F.shiftright(F.xxhash64(text), 24), 24).bitwiseOR(low)


def counts_between(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bytes of (key, size) below the first probe, between probes, and from the last one on."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(probes, b.column(0).to_numpy(zero_copy_only=False), "right")
            rows += np.bincount(at, minlength=len(rows))
            size += np.bincount(at, b.column(1).to_numpy(zero_copy_only=False), len(rows)).astype(np.int64)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(rows[some]), pa.array(size[some])], ["at", "n", "size"])

    rows, size = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    got = keys.mapInArrow(count, "at long, n long, size long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()
    for r in got:
        rows[r["at"]], size[r["at"]] = r["n"], r["size"]
    return rows, size


def find_cuts(keys: DataFrame, shards: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """(probes, number of the row at which each shard begins, rows of the ranges, heavy single keys with the number of their first row)."""
    probes = np.array(sorted({LOW + (k << 64) // 256 for k in range(1, 256)}), np.int64)
    while True:
        rows, size = counts_between(keys, probes)
        ends = np.cumsum(size)
        total = int(ends[-1])
        edges = [LOW, *map(int, probes), HIGH + 1]
        goals = [total * k / shards for k in range(1, shards)]
        held = {int(np.searchsorted(ends, g, "left")) for g in goals} if total else set()
        heavy = [k for k in range(len(rows)) if rows[k] > 1 and ((k in held and size[k] > tolerance * total / shards) or rows[k] > max(64, rows.sum() / RANGES))]
        split = [k for k in heavy if edges[k + 1] - edges[k] > 1]
        if not split:
            cuts, first = [], np.cumsum(rows) - rows
            for g in goals:
                k = min(int(np.searchsorted(ends, g, "left")), len(ends) - 1)
                before = int(ends[k - 1]) if k else 0
                part = (g - before) / max(1, int(size[k]))
                cuts.append(int(first[k]) + (round(part * int(rows[k])) if k in heavy else 0 if part <= 0.5 else int(rows[k])))
            return probes, np.maximum.accumulate(np.array([0, *cuts], np.int64)), rows, {edges[k]: int(first[k]) for k in heavy}
        new = {edges[k] + (edges[k + 1] - edges[k]) * j // SPLIT for k in split for j in range(1, SPLIT)}
        probes = np.array(sorted({*map(int, probes), *new} - {LOW}), np.int64)


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text",
                    size: Column | None = None) -> DataFrame:
    """``docs`` with shard (from 0) and slot (gapless from 0 within the shard); shards hold near equal sums of ``size``."""
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long") if size is None else size
    key = row_key(F.col(text_col), F.col(id_col))
    probes, begins, rows, heavy = find_cuts(pin(docs.select(key.alias("key"), size.alias("size"))), shards, tolerance)
    before = np.cumsum(rows) - rows
    shard_of = np.searchsorted(begins, before, "right") - 1
    start = before - begins[shard_of]

    @F.pandas_udf("struct<at:int,shard:int,start:long>")
    def place(keys: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(probes, keys.to_numpy(), "right")
        return pd.DataFrame({"at": at.astype("int32"), "shard": shard_of[at].astype("int32"), "start": start[at]})

    mark = "shard_place_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    checksum = F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    inside = W.partitionBy(mark + "p.at").orderBy(mark + "k", F.col(id_col), mark + "c")
    keyed = docs.withColumns({mark + "k": key, mark + "c": checksum})
    alone = F.col(mark + "k").isin(list(heavy))
    placed = ((keyed.filter(~alone) if heavy else keyed).withColumn(mark + "p", place(F.col(mark + "k")))
              .withColumn("slot", F.col(mark + "p.start") + F.row_number().over(inside) - 1)
              .withColumn("shard", F.col(mark + "p.shard")).drop(mark + "k", mark + "c", mark + "p"))
    return placed.unionByName(numbered(keyed.filter(alone).drop(mark + "c"), mark, begins, heavy).select(*placed.columns)) if heavy else placed


def numbered(rows: DataFrame, mark: str, begins: np.ndarray, heavy: dict[int, int]) -> DataFrame:
    """Shard and slot of the rows of heavy keys from their number; pinned, so that a row keeps its partition and place."""
    k, task, nth = mark + "k", mark + "t", mark + "n"
    rows = pin(rows.withColumns({task: F.spark_partition_id(), nth: F.monotonically_increasing_id()}))
    at, first = dict(heavy), []
    for r in rows.groupBy(k, task).count().orderBy(k, task).collect():
        first.append((r[k], r[task], at[r[k]]))
        at[r[k]] += r["count"]
    offsets = rows.sparkSession.createDataFrame(first, f"{k} long, {task} int, {mark}o long")

    @F.pandas_udf("struct<shard:int,slot:long>")
    def place(number: pd.Series) -> pd.DataFrame:
        shard = np.searchsorted(begins, number.to_numpy(), "right") - 1
        return pd.DataFrame({"shard": shard.astype("int32"), "slot": number.to_numpy() - begins[shard]})

    number = F.col(mark + "o") + F.row_number().over(W.partitionBy(k, task).orderBy(nth)) - 1
    return rows.join(F.broadcast(offsets), [k, task]).withColumn(mark + "g", number).withColumn(mark + "p", place(F.col(mark + "g"))) \
        .withColumns({"shard": F.col(mark + "p.shard"), "slot": F.col(mark + "p.slot")})


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; every task writes the ranges that it holds."""
    sharded.write.partitionBy("shard").parquet(path)


@query("op8_shards_by_histogram")
def op8(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("digest"))
    return shard_documents(docs, text_col="digest", size=F.col("size")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
