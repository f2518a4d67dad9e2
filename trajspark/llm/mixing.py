"""Mixing sources to target weights by hash-random order and exact cuts.

Every document gets a random key (md5 of its id, with a seed), which orders the documents of its
source. Keys are uniform, so equal ranges of them are equal shares of a source: their sums and the
running sums over them are small, and only one range is ever ordered in a task. A source's budget of
words is cut off exactly: ``div(budget, size of the source)`` whole epochs, then documents in order
until the rest is spent, the last one in part.

Null and empty texts have no words and are not taken; a null source is a source of its own, after all
others; rows of one id are ordered by size, and equal rows among themselves at random, which no
sum can tell; other columns stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import query, table

WEIGHTS = (5, 2, 1)         # repeating, over the sources by code point, null last
SHARE = 1.5                 # words of the mix as a share of all words
EPOCHS = 2                  # a source is never taken more often
RANGE_ROWS = 256            # rows of a source ordered together, about; the square root of its rows if that is more
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target, budget) from one row (source, n_docs, source_size) per source.

    Sources stop at ``epochs`` times their size and the rest is shared anew by weight until none is
    above: this is one level for all, ``target = least(epochs * size, level * weight)``. In order of
    size by weight, a source is full if the level that its forerunners leave reaches it.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = W.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    level = lambda cap, weight: (F.lit(share) * F.col("all_words") - cap) / weight
    return (sizes
            .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
            .withColumn("cap", F.col("source_size") * epochs)
            .withColumn("all_words", F.sum("source_size").over(every))
            .withColumn("all_weight", F.sum("weight").over(every))
            .withColumn("full", F.col("cap") / F.col("weight") <= level(F.coalesce(F.sum("cap").over(before), F.lit(0)),
                                                                        F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
            .withColumn("full_cap", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)))
            .withColumn("open_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every))
            .withColumn("target", F.when(F.col("full"), F.col("cap").cast("double"))
                        .otherwise(level(F.col("full_cap"), F.col("open_weight")) * F.col("weight")))
            .select("source", "n_docs", "source_size", "target", F.floor("target").cast("long").alias("budget")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = "mix", prefix: str = "",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with the columns size, source_size, target and taken (each with ``prefix``) on every row."""
    tag = uuid.uuid4().hex[:8]
    named = lambda n: f"{n}_{tag}"
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")).cast("binary"))
    sized = docs.withColumns({named("size"): count_words(F.col(text_col)), named("key"): key})
    sizes = sized.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(named("size")).alias("source_size"))
    targets = source_targets(sizes, weights, share, epochs)
    targets = targets.select(F.col("source").alias(named("source")), *[F.col(c).alias(named(c)) for c in ("n_docs", "source_size", "target", "budget")])
    # leading bits of the key; as many ranges as the source needs
    spot = F.conv(F.substring(named("key"), 1, 12), 16, 10).cast("long")
    ranges = F.ceil(F.col(named("n_docs")) / F.greatest(F.lit(float(RANGE_ROWS)), F.sqrt(named("n_docs"))))
    placed = (sized.join(targets, F.col(source_col).eqNullSafe(F.col(named("source"))), "left").drop(named("source"))
              .withColumn(named("range"), F.floor(spot * ranges / F.lit(float(1 << 48))).cast("long")))
    sums = (placed.groupBy(F.col(source_col).alias(named("s")), F.col(named("range")).alias(named("r"))).agg(F.sum(named("size")).alias(named("sum")))
            .withColumn(named("start"), F.coalesce(F.sum(named("sum")).over(
                W.partitionBy(named("s")).orderBy(named("r")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
            .drop(named("sum")))
    inside = W.partitionBy(source_col, named("range")).orderBy(named("key"), named("size")).rowsBetween(W.unboundedPreceding, -1)
    size, source_size, budget = (F.col(named(c)) for c in ("size", "source_size", "budget"))
    left = F.when(source_size > 0, budget - F.expr(f"{named('budget')} div greatest({named('source_size')}, 1)") * source_size).otherwise(0)
    whole = F.when(source_size > 0, F.expr(f"{named('budget')} div greatest({named('source_size')}, 1)")).otherwise(0)
    out = (placed.join(sums, F.col(source_col).eqNullSafe(F.col(named("s"))) & (F.col(named("range")) == F.col(named("r"))), "left")
           .withColumn(named("before"), F.col(named("start")) + F.coalesce(F.sum(named("size")).over(inside), F.lit(0)))
           .withColumn(named("taken"), whole * size + F.greatest(F.lit(0), F.least(size, left - F.col(named("before"))))))
    keep = [c for c in docs.columns if c not in {prefix + n for n in ("size", "source_size", "target", "taken")}]
    return out.select(*keep, *[F.col(named(n)).alias(prefix + n) for n in ("size", "source_size", "target", "taken")])


SQL = """
WITH sized AS (
  SELECT doc_id, source, md5('mix|' || CAST(doc_id AS VARCHAR)) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight FROM sized GROUP BY source),
ordered AS (
  SELECT *, 2 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS all_words, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
         CAST(coalesce(sum(2 * source_size) OVER w, 0) AS BIGINT) AS cap_before, CAST(coalesce(sum(weight) OVER w, 0) AS BIGINT) AS weight_before
  FROM sources WINDOW w AS (ORDER BY 2 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (
  SELECT *, cap / weight <= (1.5::DOUBLE * all_words - cap_before) / (all_weight - weight_before) AS is_full FROM ordered),
levels AS (
  SELECT *, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE
    (1.5::DOUBLE * all_words - CAST(coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS BIGINT)) / CAST(sum(weight) FILTER (NOT is_full) OVER () AS BIGINT) * weight END AS target FROM filled),
budgets AS (SELECT source, source_size, target, CAST(floor(target) AS BIGINT) AS budget FROM levels),
running AS (
  SELECT doc_id, source, size, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM sized)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS taken
FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
"""


@query("op5_mix_sources", SQL)
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
