"""Audit of how filters act on one another, by wide packed counters.

Every document fails some of the filters A to E, which is one of 32 masks. A mask stands for one big integer whose fields hold the
outcome of all 600 steps (5 steps of 120 orders): whether the step removes the document, and whether its filter fails it
but an earlier one has removed it; further fields hold the same removals of documents labelled good and
toxic. Adding up the integers of all documents of a part counts all steps at once. Fields are as
wide as the number of rows needs, so no sum runs into the next field. Tasks add up what they read,
sums meet by (part, salt) and then by part, and are unpacked there.

Texts pass Python once, for A to D. E, being equal to a text of a smaller id, is settled without joining the texts back: first every
row counts as failing E, then the rows of the least id of each text move from the mask with E to the one without.

A null text is the empty text, and all of them are equal. A null part (source) is the empty string. Rows without an id have no smaller id and are none: they
pass E. Repeated rows are counted one by one; rows of one id and text are not copies of each other. Repeated label rows of an
id count as one that is good, or toxic, if any is. Other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .arrow import text_udf
from .registry import query, table

FILTERS = "ABCDE"
LAST = 1 << 4                       # the bit of E
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
MARKS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
SALTS = 16
PARTS_HELD = 500                    # sums of a task at a time


def text_mask(text: str | None) -> int:
    """Bits of the filters A to D that fail a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()             # of bytes: exactly the six white space characters
    few = len(words) < 50
    dull = 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 5 * len(text)
    return few | dull << 1 | loud << 2 | (MARKS.search(raw) is not None) << 3


def outcomes(mask: int) -> tuple[np.ndarray, np.ndarray]:
    """(removed, redundant) of a document with this mask at every step of every order."""
    removed, redundant = np.zeros(STEPS, bool), np.zeros(STEPS, bool)
    for o, order in enumerate(ORDERS):
        out = False
        for s, f in enumerate(order):
            fails = bool(mask >> FILTERS.index(f) & 1)
            removed[o * len(FILTERS) + s] = fails and not out
            redundant[o * len(FILTERS) + s] = fails and out
            out |= fails
    return removed, redundant


def packed(fields: np.ndarray, width: int) -> int:
    return sum(1 << int(k) * width for k in np.flatnonzero(fields))


def counters(width: int) -> Callable[[int, bool, bool], int]:
    """The big integer of (mask, good, toxic): 600 fields each of removed, redundant, good and toxic removed, then the total and five of failing one filter only."""
    kept: dict = {}

    def of(mask: int, good: bool, toxic: bool) -> int:
        if (mask, good, toxic) not in kept:
            removed, redundant = outcomes(mask)
            only = np.array([True, *(mask == 1 << k for k in range(len(FILTERS)))])
            kept[mask, good, toxic] = packed(np.concatenate([removed, redundant, removed & good, removed & toxic, only]), width)
        return kept[mask, good, toxic]
    return of


def unpack(total: int, width: int) -> np.ndarray:
    field = (1 << width) - 1
    return np.array([total >> k * width & field for k in range(4 * STEPS + 1 + len(FILTERS))], np.int64)


def as_bytes(total: int) -> bytes:
    return total.to_bytes(total.bit_length() // 8 + 1, "little", signed=True)


def from_bytes(raw: bytes) -> int:
    return int.from_bytes(raw, "little", signed=True)


def report(part: str, total: int, width: int) -> pd.DataFrame:
    """600 rows of a part."""
    fields = unpack(total, width)
    removed, redundant, good, toxic = (fields[k * STEPS:(k + 1) * STEPS] for k in range(4))
    by_order = removed.reshape(-1, len(FILTERS))
    kept = fields[4 * STEPS] - by_order.cumsum(axis=1)
    place = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    shapley = np.array([by_order[place == k].sum() for k in range(len(FILTERS))])
    at = place.ravel()
    return pd.DataFrame({"part": part, "filter_order": np.repeat(ORDERS, len(FILTERS)), "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)),
                         "kept": kept.ravel(), "removed": removed, "redundant": redundant, "unique_fails": fields[4 * STEPS + 1:][at],
                         "good_lost": good, "toxic_lost": toxic, "shapley": shapley[at]})


REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
          "toxic_lost long, shapley long")


def masked_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask, d1, d2, good, toxic) of every document; mask without E."""
    mask = text_udf("int", pa.int32(), lambda: lambda texts: [text_mask(t) for t in texts])
    text = F.coalesce(text_col, F.lit(""))
    with_id = F.col(id_col).isNotNull()
    named = lambda d: d.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask(F.col(text_col)).alias("mask"),
                               F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"))
    flag = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False))).alias("good" if name == "quality" else name)
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(flag("quality"), flag("toxic"))
    labelled = named(docs.filter(with_id)).join(known, F.col("id") == F.col("label_id"), "left").drop("label_id")
    # rows without an id would all meet in one task of the join
    rest = named(docs.filter(~with_id)).withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return labelled.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}).unionByName(rest)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """600 rows per part: what each step of each order of the filters keeps, removes and loses."""
    rows = pin(masked_rows(docs, labels, id_col, text_col, part_col))
    width = max(1, rows.count().bit_length())
    kind = ["part", "mask", "good", "toxic"]
    # all rows with an id fail E at first; those of a text's least id are taken back
    all_rows = rows.select("part", F.when(F.col("id").isNull(), F.col("mask")).otherwise(F.col("mask").bitwiseOR(LAST)).alias("mask"), "good", "toxic", F.lit(1).cast("long").alias("n"))
    alike = rows.filter(F.col("id").isNotNull()).groupBy("d1", "d2", "id", *kind).agg(F.count(F.lit(1)).alias("n"))
    alike = alike.groupBy("d1", "d2", "id").agg(F.sort_array(F.collect_list(F.struct(*kind, "n"))).alias("rows"))       # few: rows of one id and text
    first = alike.groupBy("d1", "d2").agg(F.min(F.struct("id", "rows")).alias("first")).select(F.explode("first.rows").alias("r")).select("r.*")
    back = first.select("part", F.explode(F.array(F.struct(F.col("mask").bitwiseOR(LAST).alias("mask"), (-F.col("n")).alias("n")),
                                                  F.struct("mask", "n"))).alias("move"), "good", "toxic")
    counted = all_rows.unionByName(back.select("part", "move.mask", "good", "toxic", "move.n"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = counters(width), {}

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([as_bytes(x) for x in held.values()], pa.binary())], ["part", "total"])

        for b in batches:
            seen = pa.Table.from_batches([b]).group_by(kind).aggregate([("n", "sum")]).to_pylist()
            for r in seen:
                held[r["part"]] = held.get(r["part"], 0) + r["n_sum"] * of(r["mask"], r["good"], r["toxic"])
            if len(held) > PARTS_HELD:
                yield done()
                held = {}
        yield done()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of parts: one sum is held at a time."""
        part, total = None, 0
        for b in batches:
            for p, raw in zip(b.column("part").to_pylist(), b.column("total").to_pylist(), strict=True):
                if p != part:
                    if part is not None:
                        yield pa.RecordBatch.from_pydict({"part": [part], "total": [as_bytes(total)]})
                    part, total = p, 0
                total += from_bytes(raw)
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "total": [as_bytes(total)]})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, raw in zip(b["part"], b["total"], strict=True):
                yield report(p, from_bytes(raw), width)

    sums = counted.mapInArrow(add_up, "part string, total binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for by in (["part", "salt"], ["part"]):
        sums = sums.withColumn("salt", F.pmod(F.xxhash64("total"), F.lit(SALTS))).repartition(n, *by).sortWithinPartitions("part").select("part", "total").mapInArrow(merge, "part string, total binary")
    return sums.mapInPandas(spread, REPORT)


SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
flags AS (
  SELECT doc_id, part, (len(words) < 50) AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM docs),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
kinds AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM flags LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step] AS f, 1 << (ascii(filter_order[step]) - 65) AS bit,
         coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))), 0)::INT AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counts AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, f,
         CAST(sum(n) FILTER (mask & (bit | earlier) = 0) AS BIGINT) AS kept,
         CAST(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0) AS BIGINT) AS removed,
         CAST(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0) AS BIGINT) AS redundant,
         CAST(sum(n) FILTER (mask = bit) AS BIGINT) AS unique_fails,
         CAST(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0 AND good = 1) AS BIGINT) AS good_lost,
         CAST(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0 AND toxic = 1) AS BIGINT) AS toxic_lost
  FROM kinds, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
       coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM counts
"""


@query("op13_filter_audit", SQL)
def op13(spark, sf_dir):
    return audit_filters(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels"))
