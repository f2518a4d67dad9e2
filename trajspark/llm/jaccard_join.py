"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents are sets of five-word shingles (64-bit hashes; words are what stands between white space); equal sets are one class. MinHash
signatures in bands of four bring together what may be similar: at the threshold a pair is missed with probability below 1e-7. What a
bucket holds is only linked to its least member, so that no bucket is expanded; the connected parts of
these links are the units of comparison. Inside of a unit, signatures are compared in steps of 32
values: a pair is dropped as soon as ``P(J >= threshold | matches so far)``, from a uniform prior, falls below ``TOLERANCE``. The
rest is verified exactly on the sets. Units larger than ``BLOCK`` are cut into blocks and every pair of blocks is a
task of its own. It returns counts of links and a forest of them per member, not the pairs, so a group of
many near copies makes few rows, and no link between them is lost.

A text of fewer than five words is one shingle; texts without words (null, empty) are equal to each other. A null id stays null; the class
id is the least id of its documents that is not null. Repeated rows are documents like others. Only the id
and the text are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .graph import components
from .hashing import mix, parts, pieces, shingles, words
from .registry import query, table

WIDTH = 5
THRESHOLD = (4, 5)          # 0.8
BANDS, ROWS = 32, 4
STEP = 32
TOLERANCE = 1e-6
BLOCK = 512
CHUNK = 1 << 15             # shingles hashed at a time
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of each text's shingles; all ones without any."""
    out = np.full((len(counts), len(FACTORS)), 0xFFFFFFFF, np.uint32)
    ends = np.cumsum(counts)
    k = 0
    while k < len(counts):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + CHUNK, "right")))
        some = np.arange(k, stop)[counts[k:stop] > 0]
        if len(some):
            first = (ends[some] - counts[some])
            piece, starts = values[first[0]:ends[some[-1]]], first - first[0]
            for j, f in enumerate(FACTORS):
                out[some, j] = np.minimum.reduceat(((piece * f) >> np.uint64(32)).astype(np.uint32), starts)
        k = stop
    return out


def set_keys(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """128 bits that name the set of each text's shingles."""
    out = []
    for v in parts(values, counts):
        v = np.unique(v)
        out.append(np.array([v.sum(dtype=np.uint64), mix(v + np.uint64(11)).sum(dtype=np.uint64)]).tobytes())
    return out


def needed(n: int, threshold: tuple[int, int] = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest matches of ``n`` with which a pair may still reach the threshold."""
    t = threshold[0] / threshold[1]
    # a uniform prior and m matches of n leave a beta law; its tail above t is a binomial one
    tail = np.cumsum([comb(n + 1, k) * t ** k * (1 - t) ** (n + 1 - k) for k in range(n + 1)])
    return int(np.searchsorted(tail, tolerance, "left"))


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, set, signature) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("digest"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, signs = [], []
            for raw in pieces(b.column("text").to_pylist()):
                values, counts = shingles(*words(raw), WIDTH)
                sets += set_keys(values, counts)
                signs += [s.tobytes() for s in signatures(values, counts)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("digest"), pa.array(sets, pa.binary()), pa.array(signs, pa.binary())], ["id", "digest", "set", "signature"])

    return rows.mapInArrow(work, f"id {docs.schema[id_col].dataType.simpleString()}, digest long, set binary, signature binary")


def compare(group: pd.DataFrame, threshold: tuple[int, int], tolerance: float) -> list[tuple[int, int, int]]:
    """(member, representative of its links, documents linked) for the members of one pair of blocks that have links."""
    group = group.drop_duplicates("member")
    left, right = group.block.to_numpy() == group.low.iloc[0], group.block.to_numpy() == group.high.iloc[0]
    inside = group.low.iloc[0] == group.high.iloc[0]
    n = len(group)
    if n < 2:
        return []
    sign = np.frombuffer(b"".join(group.signature), np.uint32).reshape(n, -1)
    sets = [np.unique(v) for raw in pieces(group.text.tolist()) for v in parts(*shingles(*words(raw), WIDTH))]
    size = np.array([len(s) for s in sets])
    names = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    ends = np.cumsum(size)
    sets = [names[e - s:e] for e, s in zip(ends, size, strict=True)]
    steps = [(k, needed(k, threshold, tolerance)) for k in range(STEP, sign.shape[1] + 1, STEP)]
    weight, links, top = group["size"].to_numpy(), np.zeros(n, np.int64), np.arange(n)
    mark = np.zeros(int(names.max()) + 1 if len(names) else 1, bool)

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for i in np.flatnonzero(left):
        others = np.arange(i + 1, n) if inside else np.flatnonzero(right)
        matches = np.zeros(len(others), np.int32)
        for k, least in steps:
            matches += (sign[others, k - STEP:k] == sign[i, k - STEP:k]).sum(axis=1)
            keep = matches >= least
            others, matches = others[keep], matches[keep]
            if not len(others):
                break
        if not len(others):
            continue
        mark[sets[i]] = True
        common = np.array([np.count_nonzero(mark[sets[j]]) for j in others])
        mark[sets[i]] = False
        linked = others[common * threshold[1] >= (size[i] + size[others] - common) * threshold[0]]
        links[i] += weight[linked].sum()
        links[linked] += weight[i]
        for j in linked:
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    member = group.member.to_numpy()
    return [(int(member[i]), int(member[find(i)]), int(links[i])) for i in np.flatnonzero(links)]


def link_units(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold, tolerance, block: int) -> DataFrame:
    """(member, peer, links) of the classes that have links, one row for each pair of blocks."""
    bands = classes.select("member", F.explode(F.array(*[
        F.xxhash64(F.lit(b), F.substring("signature", 1 + 4 * ROWS * b, 4 * ROWS)) for b in range(BANDS)])).alias("band"))
    hubs = bands.groupBy("band").agg(F.min("member").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "hub")
    stars = components(bands.join(hubs, "band").select(F.col("member").alias("a"), F.col("hub").alias("b")))
    units = stars.select("node", "root").union(stars.select("root", "root").distinct())
    # every node of a star is in it once; blocks by a hash of the node
    blocks = units.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = (classes.join(units.join(blocks, "root"), F.col("member") == F.col("node"))
            .select("member", "size", "signature", "id", "digest", "root", "blocks"))
    texts = docs.select(F.col(id_col).alias("i"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("d"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = (rows.join(texts, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))).drop("i", "d", "id", "digest")
            .withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "member", "size", "signature", "text")
            .repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "member"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            key = b[["root", "low", "high"]].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(b)]
            out = []
            for s, e in zip(cuts, cuts[1:], strict=False):
                if held and (held[-1][["root", "low", "high"]].iloc[0].to_numpy() != key[s]).any():
                    out += compare(pd.concat(held), threshold, tolerance)
                    held = []
                held.append(b.iloc[s:e])
            yield pd.DataFrame(out, columns=["member", "peer", "links"]).astype("int64")
        if held:
            yield pd.DataFrame(compare(pd.concat(held), threshold, tolerance), columns=["member", "peer", "links"]).astype("int64")

    return rows.mapInPandas(work, "member long, peer long, links long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD,
                 tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(id, digest, class_id, n_links, keeps) of every row.

    ``n_links`` counts the other documents at the threshold or above, ``class_id`` is the least id that links lead to, and
    ``keeps`` marks the (id, digest) that stands for the class.
    """
    rows = pin(sketch(docs, id_col, text_col))
    classes = pin(rows.groupBy("set").agg(F.min(F.struct("id", "digest")).alias("rep"), F.min("id").alias("least"), F.count(F.lit(1)).alias("size"),
                                          F.first("signature").alias("signature"))
                  .select(F.monotonically_increasing_id().alias("member"), "set", "rep.id", "rep.digest", "least", "size", "signature"))
    found = pin(link_units(classes, docs, id_col, text_col, threshold, tolerance, block))
    links = found.groupBy("member").agg(F.sum("links").alias("links"))
    stars = components(found.select(F.col("member").alias("a"), F.col("peer").alias("b")))
    named = (classes.drop("signature").join(links, "member", "left").join(stars, F.col("member") == F.col("node"), "left")
             .withColumn("root", F.coalesce("root", "member")))
    heads = named.groupBy("root").agg(F.min("least").alias("class_id"), F.min(F.struct("id", "digest")).alias("head"))
    named = named.join(heads, "root").select("set", "class_id", "head", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return (rows.select("id", "digest", "set").join(named, "set")
            .select(F.col("id").alias(id_col), "digest", "class_id", "n_links", F.col("head").eqNullSafe(F.struct("id", "digest")).alias("keeps")))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one document of each class: that of the least id (of equal ids, the least digest)."""
    keys = jaccard_join(docs, id_col, text_col, **kw).filter("keeps").groupBy(id_col, "digest").count()
    keys = pin(keys.select(F.col(id_col).alias("keep_id_"), F.col("digest").alias("keep_digest_"), F.col("count").alias("keep_n_")))
    kept = docs.join(keys, F.col(id_col).eqNullSafe(F.col("keep_id_")) & (F.xxhash64(F.coalesce(text_col, F.lit(""))) == F.col("keep_digest_")))
    once = kept.filter("keep_n_ = 1").select(*docs.columns)
    if keys.filter("keep_n_ > 1").isEmpty():
        return once
    return once.unionByName(kept.filter("keep_n_ > 1").dropDuplicates(["keep_id_", "keep_digest_"]).select(*docs.columns))


@query("op1_ngram_jaccard_join")
def op1(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")
