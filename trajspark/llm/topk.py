"""Exact top-k search by inner product with M-trees.

With one more coordinate, ``sqrt(m - |x|^2)``, all vectors of a block have the length ``sqrt(m)``, and the inner product with a query
falls as the distance grows: search by product is search in a metric space. Vectors are dealt into blocks by a hash of their id; a
task builds an M-tree of a block (pages of routing entries with centre, covering radius and distance
to the parent; leaves with vectors and their distances to the parent) and searches it best first for each query of a query block. Entries
whose stored distances already rule them out by the triangle inequality are skipped without computing a
distance. Bounds have a slack above rounding. Scores are exact: products of doubles where the lengths prove that every sum stays below 2^53,
whole numbers of any size for what the bounds leave over otherwise; blocks are merged by these, and a score beyond 64 bits is null in its rank.
Equal vectors of a block are one entry, with its smallest ids (repeated ones up to ``k`` times) until ``k`` remain without any one
of them: all that ties can need, whichever id asks.

Vectors that are null, or hold null or non-finite components (also: whose multiple by ``scale`` is no finite double), and rows without an id take no part; neither do empty
ones, and vectors of another length than the query's are not its candidates. Rows with a query's id are
its own, never its candidates; if a query's id is repeated, its smallest vector asks. Repeated candidate rows are
listed repeatedly. Other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import query, table

K = 5
PAGE = 256
BLOCK_VECTORS = 8_192
BLOCK_QUERIES = 2_048
SLACK = 1e-3
ROUNDING = 1e-6         # slack as a share of the lengths
EXACT = 2.0 ** 53       # integers below are doubles
LONG = (1 << 63) - 1


def sortable(score: int) -> bytes:
    """Bytes that are in order as the whole numbers are."""
    n = (abs(score).bit_length() + 7) // 8
    up = bytes([128 | n >> 8, n & 255]) + abs(score).to_bytes(n, "big")
    return up if score >= 0 else bytes(255 - b for b in up)


def product(a: np.ndarray, b: np.ndarray) -> int:
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


@dataclass
class Node:
    """A page: centres (of children, or the vectors of a leaf), distances to the page's own centre, and for routing entries radii and pages."""

    points: np.ndarray
    to_parent: np.ndarray
    radii: np.ndarray
    below: list | None
    rows: np.ndarray


def enough(ids: np.ndarray, k: int) -> np.ndarray:
    """Of ascending ids, each ``k`` times at most, the least prefix with ``k`` rows beside those of any one id."""
    nth = np.arange(len(ids)) - np.searchsorted(ids, ids)
    ids, nth = ids[nth < k], nth[nth < k]
    beside = np.arange(1, len(ids) + 1) - np.maximum.accumulate(nth + 1)
    return ids[:int(np.searchsorted(beside, k)) + 1]


def distances(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - q) ** 2).sum(axis=1), 0))


def build(points: np.ndarray, rows: np.ndarray, centre: np.ndarray) -> Node:
    own = points[rows]
    if len(rows) <= PAGE:
        return Node(own, distances(own, centre), np.zeros(len(rows)), None, rows)
    n = min(16, -(-len(rows) // (PAGE // 2)))
    pivots = own[np.linspace(0, len(rows) - 1, n).astype(int)]
    near = (((own ** 2).sum(axis=1)[:, None] - 2 * own @ pivots.T) + (pivots ** 2).sum(axis=1)[None, :]).argmin(axis=1)
    if np.bincount(near, minlength=n).max() > 0.9 * len(rows):       # nothing to tell them apart: cut evenly
        near = np.arange(len(rows)) * n // len(rows)
    some = [k for k in range(n) if (near == k).any()]
    parts = [rows[near == k] for k in some]
    centres = pivots[some]
    return Node(centres, distances(centres, centre), np.array([distances(points[p], c).max() for p, c in zip(parts, centres, strict=True)]),
                [build(points, p, c) for p, c in zip(parts, centres, strict=True)], rows[:0])


class MTree:
    """Over the distinct vectors of a block; ``ids`` are the ids of each that can count, ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        distinct, of = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, of.ravel()))
        cut = np.searchsorted(of.ravel()[order], np.arange(len(distinct) + 1))
        self.ids = [enough(ids[order[a:b]], k) if b - a > k else ids[order[a:b]] for a, b in zip(cut, cut[1:], strict=False)]
        self.least, self.greatest = np.array([i[0] for i in self.ids]), np.array([i[-1] for i in self.ids])
        self.vectors = distinct.astype(np.float64)
        with np.errstate(over="ignore"):
            square = (self.vectors ** 2).sum(axis=1)
        self.most = float(square.max())
        self.computed = 0
        if not np.isfinite(self.most):          # too long for distances in doubles: one page, told apart by whole numbers only
            self.root = None
            return
        self.points = np.hstack([self.vectors, np.sqrt(np.maximum(self.most - square, 0))[:, None]])
        self.root_centre = self.points.mean(axis=0)
        self.root = build(self.points, np.arange(len(distinct)), self.root_centre)

    def search(self, query_id: int, vector: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the ``k`` best; higher scores first, then smaller ids."""
        q = np.append(vector.astype(np.float64), 0.0)
        with np.errstate(over="ignore"):
            length = float(q @ q)
        best: list[tuple[int, int]] = []            # (score, -id), a heap with the worst on top
        size = float(np.sqrt(length) * np.sqrt(self.most))
        sure = size < EXACT                         # then every partial sum is an exact double
        margin = 0.0 if sure else 4 * len(q) * np.finfo(float).eps * size + 1

        def enter(row: int, score: int) -> None:
            for i in self.ids[row]:
                if i == query_id:
                    continue
                entry = (score, -int(i))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                else:
                    break

        if self.root is None or not np.isfinite(length):
            for row, v in enumerate(self.vectors):
                self.computed += 1
                enter(row, product(v, q[:-1]))
            return [(s, -i) for s, i in sorted(best, key=lambda e: (-e[0], -e[1]))]

        def reach() -> float:
            """Beyond this distance no vector can enter."""
            if len(best) < k:
                return np.inf
            return float(np.sqrt(max(length + self.most - 2 * float(best[0][0]), 0.0))) + SLACK + ROUNDING * float(np.sqrt(length + self.most))

        queue, n = [(0.0, 0, self.root, float(distances(self.root_centre[None], q)[0]))], 0
        while queue:
            bound, _, node, at = heapq.heappop(queue)
            r = reach()
            if bound > r:
                break
            open_ = np.flatnonzero(np.abs(at - node.to_parent) - node.radii <= r)
            if node.below is None:
                at_rows = node.rows[open_]
                open_ = open_[(self.least[at_rows] != query_id) | (self.greatest[at_rows] != query_id)]      # not what is the query's alone
                self.computed += len(open_)
                scores = self.vectors[node.rows[open_]] @ q[:-1]
                if len(best) == k:
                    few = scores >= best[0][0] - margin
                    open_, scores = open_[few], scores[few]
                if len(scores) > 2 * k:                     # no more than k + 1 rows of a page and their ties can enter
                    few = scores >= np.partition(scores, -k - 1)[-k - 1] - 2 * margin
                    open_, scores = open_[few], scores[few]
                for row, s in zip(node.rows[open_], scores, strict=True):
                    enter(row, int(s) if sure else product(self.vectors[row], q[:-1]))
            else:
                self.computed += len(open_)
                d = np.sqrt(np.maximum(length + self.most - 2 * (node.points[open_] @ q), 0))       # centres are points: one length for all
                for e, x in zip(open_, d, strict=True):
                    low = max(float(x) - node.radii[e], 0.0)
                    if low <= r:
                        n += 1
                        heapq.heappush(queue, (low, n, node.below[e], float(x)))
        return [(s, -i) for s, i in sorted(best, key=lambda e: (-e[0], -e[1]))]


def top_k(vectors: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for every id divisible by ``every``, the ``k`` other rows of the highest integer product."""
    x = F.col(vector_col)
    off = lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double") * scale) == float("inf"))
    usable = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, off)
    rows = vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), x.alias("v"))
    n = rows.count()
    blocks, asking = -(-n // BLOCK_VECTORS) or 1, -(-n // (every * BLOCK_QUERIES)) or 1
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda m: F.pmod(F.xxhash64("id", F.lit(m)), F.lit(m)).cast("int")
    stored = rows.select(F.lit(False).alias("asks"), "id", "dim", "v", block(blocks).alias("block"), each(asking).alias("turn"))
    queries = (rows.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q"))
               .select(F.lit(True).alias("asks"), "id", "q.dim", "q.v", block(asking).alias("turn"), each(blocks).alias("block")))

    def search(got: pd.DataFrame) -> pd.DataFrame:
        asks = got["asks"].to_numpy(bool)
        stored, queries = got[~asks], got[asks]
        out = []
        if len(stored) and len(queries):
            whole = lambda of: np.floor(np.stack(of.to_list()).astype(np.float64) * scale)
            tree = MTree(stored["id"].to_numpy(), whole(stored["v"]), k)
            for i, v in zip(queries["id"], whole(queries["v"]), strict=True):
                out += [(i, j, s if abs(s) <= LONG else None, sortable(s)) for s, j in tree.search(i, v, k)]
        ids, others, scores, places = zip(*out, strict=True) if out else ((), (), (), ())
        return pd.DataFrame({"query_id": np.array(ids, np.int64), "vec_id": np.array(others, np.int64), "score": pd.array(scores, "Int64"), "place": pd.Series(places, dtype=object)})

    found = stored.unionByName(queries).groupBy("dim", "block", "turn").applyInPandas(search, "query_id long, vec_id long, score long, place binary")
    best = W.partitionBy("query_id").orderBy(F.desc("place"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: CAST(p[1] AS HUGEINT) * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op10_mtree_top_k", SQL)
def op10(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))
