"""k-means over integer vectors with Orchard's search for the nearest centroid.

Every centroid has a list of the others in order of distance. The search for a vector starts at some centroid and walks its list;
whenever it finds a closer one it goes on with that one's list from the start. Centroids already measured are marked and not measured again. It stops
where the list's next entry is strictly more than twice as far from the current centroid as the vector is: by the
triangle inequality nothing behind it is as near. Equally near ones lie within that bound, so the smaller number wins every tie. Vectors
of a batch walk side by side in numpy.

Each round is one pass: tasks add up components per cluster, Spark adds these sums, and k rows come back to become the next
centroids (exact floors). The vectors are pinned once, with their cluster of the first round, which is where later searches
start. Arithmetic is exact: 64-bit integers where the components prove that squares fit, whole numbers of any size otherwise; sums travel
in limbs of 40 bits.

Kept are vectors of ``dim`` components, none null or non-finite; rows without an id are kept too, but become a first centroid only when
ids run out. Repeated rows count one by one (as first centroids, too), rows of one id in order of their vectors. With fewer kept vectors than ``k`` there are
fewer centroids, with none no rows. A distance, or a sum of them, beyond 64 bits is null. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .registry import query, table

K = 8
ROUNDS = 10
DIM = 64
SCALE = 1024
SEED = "3"
LIMB = 40
SAFE = 1 << 27          # of components: 64 squares of their differences fit 63 bits with room to spare
LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): int64 where all are small enough to be squared, else Python integers. ``scale`` is a power of two."""
    if x.size == 0 or np.abs(x).max() < SAFE / scale:
        return np.floor(x * scale).astype(np.int64)
    whole = [int(v) * scale if abs(v) >= 2.0 ** 53 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(x.shape)


class Orchard:
    """Nearest of a few centroids (rows of integers)."""

    def __init__(self, centroids: list[list[int]]):
        self.big = max((abs(v) for c in centroids for v in c), default=0) >= SAFE
        self.centroids = np.array(centroids, dtype=object if self.big else np.int64).reshape(len(centroids), -1)
        n = len(centroids)
        apart = [[sum((a - b) ** 2 for a, b in zip(c, d, strict=True)) for d in centroids] for c in centroids]
        order = [sorted(range(n), key=lambda j: (j != i, apart[i][j], j)) for i in range(n)]            # itself first
        self.lists = np.array(order, np.int64).reshape(n, n)
        far = max((x for row in apart for x in row), default=0)
        self.gaps = np.array([[apart[i][j] for j in order[i]] for i in range(n)], dtype=object if far > LONG // 8 else np.int64).reshape(n, n)
        self.computed = 0

    def _measure(self, vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
        self.computed += len(to)
        apart = vectors - self.centroids[to]
        return (apart * apart).sum(axis=1)

    def search(self, vectors: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of every vector; ``start``: where its search begins."""
        if vectors.dtype == object or self.big:
            vectors = vectors.astype(object)
        n, k = len(vectors), len(self.lists)
        now, place = start.astype(np.int64).copy(), np.ones(n, np.int64)
        best = self._measure(vectors, now)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), now] = True
        open_ = np.flatnonzero(place < k)
        while len(open_):
            at, nth = now[open_], place[open_]
            gap, near = self.gaps[at, nth], best[open_]
            if gap.dtype != object and near.dtype != object and near.max(initial=0) > LONG // 8:
                near = near.astype(object)
            within = np.asarray(gap <= 4 * near, bool)          # squared: strictly beyond twice the distance ends the walk
            open_, at, nth = open_[within], at[within], nth[within]
            other = self.lists[at, nth]
            place[open_] += 1
            fresh = ~seen[open_, other]
            rows, other = open_[fresh], other[fresh]
            seen[rows, other] = True
            d = self._measure(vectors[rows], other)
            closer = np.asarray((d < best[rows]) | ((d == best[rows]) & (other < now[rows])), bool)
            rows, other = rows[closer], other[closer]
            now[rows], best[rows], place[rows] = other, d[closer], 1
            open_ = open_[place[open_] < k]
        return now, best


def limbs(total: int) -> list[int]:
    """Parts of LIMB bits, least first, each with the number's sign."""
    out, left = [], abs(total)
    while left:
        out.append(left & ((1 << LIMB) - 1))
        left >>= LIMB
    return [v if total > 0 else -v for v in out]


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def first_centroids(rows: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The integer vectors of the k least hashes of ids."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    least = rows.select(hashed.alias("hash"), "x").orderBy(F.col("hash").asc_nulls_last(), "x").limit(k).collect()
    return [[int(v) for v in integers(np.array(r["x"], np.float64), scale)] for r in least]


def moved(rows: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The centroids after one round: floors of the means, empty ones as they were."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for b in batches:
            v = integers(_vectors(b.column("x")), scale)
            near, _ = search.search(v, b.column("home").to_numpy())
            out = []
            for c in np.unique(near).tolist():
                own = v[near == c]
                out.append((c, -1, 0, len(own)))
                out += [(c, j, level, part) for j, total in enumerate(own.sum(axis=0).tolist()) for level, part in enumerate(limbs(total))]
            yield pa.RecordBatch.from_arrays([pa.array(list(z), t) for z, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
                                             if out else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())], ["cluster", "place", "level", "part"])

    sums = rows.select("x", "home").mapInArrow(add_up, "cluster int, place int, level int, part long")
    found = sums.groupBy("cluster", "place", "level").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect()      # clusters x components x limbs
    count: dict = {}
    total: dict = {}
    for r in found:
        if r["place"] < 0:
            count[r["cluster"]] = int(r["part"])
        else:
            at = total.setdefault(r["cluster"], [0] * len(centroids[0]))
            at[r["place"]] += int(r["part"]) << LIMB * r["level"]
    zero = [0] * (len(centroids[0]) if centroids else 0)
    return [[v // count[c] for v in total.get(c, zero)] if c in count else old for c, old in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED,
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance) of every kept vector, the final centroids)."""
    spark, x = vectors.sparkSession, F.col(vector_col)
    good = x.isNotNull() & (F.size(x) == dim) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).alias("id"), x.cast("array<double>").alias("x"))
    id_type = rows.schema["id"].dataType.simpleString()
    centroids = first_centroids(rows, k, seed, scale)
    if not centroids:
        return spark.createDataFrame([], f"id {id_type}, cluster int, distance long"), centroids

    def assigned(d: DataFrame, schema: str, with_vectors: bool) -> DataFrame:
        fixed = centroids

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Orchard(fixed)
            for b in batches:
                start = b.column("home").to_numpy()
                near, far = search.search(integers(_vectors(b.column("x")), scale), start)
                near = pa.array(near.astype(np.int32))
                if with_vectors:
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), near], ["id", "x", "home"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column("id"), near, pa.array([v if v <= LONG else None for v in far.tolist()], pa.int64())], ["id", "cluster", "distance"])
        return d.mapInArrow(assign, schema)

    rows = pin(assigned(rows.withColumn("home", F.lit(0)), f"id {id_type}, x array<double>, home int", True))
    for _ in range(rounds):
        centroids = moved(rows, centroids, scale)
    return assigned(rows, f"id {id_type}, cluster int, distance long", False), centroids


def clusters_report(vectors: DataFrame, **options) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    found, centroids = cluster(vectors, **options)
    found = pin(found)
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = found.groupBy("cluster").agg(total.alias("cluster_sum")).collect()            # one row per centroid
    spark = vectors.sparkSession
    fits = lambda v: v if v is not None and v <= LONG else None
    whole = fits(sum(int(r["cluster_sum"]) for r in sums)) if all(r["cluster_sum"] is not None for r in sums) else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    facts = [(r["cluster"], fits(None if r["cluster_sum"] is None else int(r["cluster_sum"])), whole, digest(r["cluster"])) for r in sums]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (found.join(F.broadcast(facts), "cluster")
            .select(F.col("id").alias(options.get("id_col", "vec_id")), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def twin_sql(k: int = K, rounds: int = ROUNDS) -> str:
    """The rounds unrolled: c0 has the first centroids, c1 those after a round, and so on."""
    steps = ["""vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INT) AS c, v FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM vectors) ORDER BY h, v LIMIT {k})"""]
    near = "SELECT row, min(struct_pack(d := list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c)) AS m FROM vectors x, c{0} y GROUP BY row"
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({near.format(r)}),
s{r} AS (SELECT a{r}.m.c AS c, unnest(range(64)) AS j, unnest(v) AS x FROM a{r} JOIN vectors USING (row)),
m{r} AS (SELECT c, j, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM s{r} GROUP BY c, j),
n{r} AS (SELECT c, list((t - ((t % n) + n) % n) // n ORDER BY j) AS v FROM m{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(n{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN n{r} USING (c))""")
    steps.append(f"last_ AS MATERIALIZED ({near.format(rounds)})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(m.c AS INT) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM last_ JOIN vectors USING (row) JOIN c{rounds} f ON f.c = last_.m.c"""


@query("op12_orchard_clusters", twin_sql())
def op12(spark, sf_dir):
    return clusters_report(table(spark, sf_dir, "embeddings"))
