"""Removal of lines that many documents share, over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends and in lower case (A to Z only), known by two 64-bit hashes.
``LineRuns`` is what is known of the lines seen so far: runs of (hash, number of documents, greatest id), each a table
bucketed and sorted by the hash, one row per hash. A batch of documents folds its own lines to such rows, merges them against the runs in
an anti join (runs are not moved: they lie in the join's buckets), which leaves out what a run already
settles (a line found often enough, in a greater id), and adds the rest as a run of its own. ``fanout`` runs of a level are
compacted into one of the next, so there are few runs and each row is rewritten once a level. Batches may come in any order; in
descending order of ids the most is settled early.

A key of ``min_chars`` code points or more in ``min_docs`` documents or more loses all its lines but those in the greatest id that holds it.

A null or empty text is one empty line. Rows of one id are one document, and each keeps the lines that the id keeps. Rows
without an id are no document: they count for nothing and lose every line that is found often enough. Ties cannot
occur, ids being ordered. Texts of any length stay one row; their lines are rows. Other columns are left out; an
empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .registry import query, table

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 8
FANOUT = 3
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """Without white space at both ends, A to Z in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    # lower() maps all letters, which is the same only where there is nothing beyond ASCII
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_digest(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2")]


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, d1, d2, place, h1, h2) of every line whose key is long enough; d1 and d2 tell texts apart."""
    lines = docs.select(F.col(id_col).alias("id"), *text_digest(F.col(text_col)), F.posexplode(split_lines(F.col(text_col))).alias("place", "line"))
    keyed = lines.select("id", "d1", "d2", "place", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select("id", "d1", "d2", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """Levelled sorted runs of (h1, h2, docs, top)."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, max(2, fanout)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[DataFrame, str]]] = []         # the run as a bucketed table, and its folder

    def runs(self) -> list[tuple[DataFrame, str]]:
        return [r for level in self.levels for r in level]

    def fold(self, runs: list[tuple[DataFrame, str]]) -> DataFrame:
        """One row per hash. Read as plain files: Spark takes a union of bucketed tables for bucketed, but does not read it so."""
        # what a batch left out as settled is missing in the sums, which then are large enough without it
        rows = self.spark.read.schema(runs[0][0].schema).parquet(*[path for _, path in runs])
        return rows.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def _write(self, rows: DataFrame) -> tuple[DataFrame, str]:
        name = f"line_run_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, name)
        (rows.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", path).saveAsTable(name))
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")            # the catalog's entry only: the files lie in a folder of their own
        return run, path

    def _place(self, rows: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(self._write(rows))
        if len(self.levels[level]) == self.fanout:
            merged = self.fold(self.levels[level])
            self.levels[level] = []
            self._place(merged, level + 1)

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of lines (id, h1, h2); no id may be in two batches."""
        own = (lines.filter(F.col("id").isNotNull()).select("h1", "h2", "id").distinct()
               .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("top")))
        for run, _ in self.runs():
            run = run.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("docs").alias("known"), F.col("top").alias("beyond"))
            settled = (F.col("known") >= self.min_docs) & (F.col("beyond") > F.col("top"))
            own = own.join(run, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & settled, "left_anti")
        self._place(own, 0)

    def frequent(self) -> DataFrame:
        """(h1, h2, top) of every line found in enough documents; after the last batch."""
        return self.fold(self.runs()).filter(F.col("docs") >= self.min_docs).select("h1", "h2", "top")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(id, n_lines, n_dropped, kept) of every row of ``docs``: the lines before, those dropped, and the text that is left.

    The documents go through ``LineRuns`` in ``batches`` of descending ids; ids must have an order that percentiles know (numbers, dates).
    """
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx(id_col, [(b + 1) / batches for b in range(batches - 1)], 1_000)).first()[0] if batches > 1 else None
    batch = sum([(F.coalesce(F.col("id") <= F.lit(c), F.lit(False))).cast("int") for c in sorted(set(cuts or []))], F.lit(0))
    # a file holds one batch; dealt by what is different in every line
    share = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // batches)
    path = scratch_path(spark, "lines")
    (lines_of(docs, id_col, text_col, min_chars).withColumn("batch", batch)
     .repartition(share * batches, "batch", F.pmod(F.xxhash64("id", "d1", "place"), F.lit(share))).write.partitionBy("batch").parquet(path))
    lines = spark.read.schema(f"id {docs.schema[id_col].dataType.simpleString()}, d1 long, d2 long, place int, h1 long, h2 long, batch int").parquet(path)
    known = LineRuns(spark, min_docs, fanout)
    for b in range(len(set(cuts or [])) + 1):
        known.add(lines.filter(F.col("batch") == b))
    # written, so that both sides of the join are plain exchanges and Spark can split a line that very many documents hold
    found = scratch_path(spark, "frequent")
    known.frequent().write.parquet(found)
    gone = (lines.join(spark.read.parquet(found), ["h1", "h2"]).filter(F.coalesce(F.col("id") < F.col("top"), F.lit(True)))
            .select("id", "d1", "d2", "place").groupBy("id", "d1", "d2").agg(F.collect_set("place").alias("gone"))
            .select(F.col("id").alias("gone_id"), F.col("d1").alias("g1"), F.col("d2").alias("g2"), "gone"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *text_digest(F.col(text_col)))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("d1") == F.col("g1")) & (F.col("d2") == F.col("g2"))
    split = split_lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size("line") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(left, lambda k: F.get(F.col("line"), k)), "\n"))
    return (rows.join(gone, same, "left").withColumn("line", split)
            .select(F.col("id").alias(id_col), F.size("line").cast("long").alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept")))


SQL = r"""
WITH lines AS (
  SELECT row, doc_id, unnest(range(len(l))) AS place, unnest(l) AS line
  FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT row, doc_id, place, line, top IS NOT NULL AND (doc_id IS NULL OR doc_id < top) AS gone FROM keyed LEFT JOIN frequent USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id
"""


@query("op11_line_runs", SQL)
def op11(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
