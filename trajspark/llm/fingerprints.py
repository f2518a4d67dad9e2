"""Document fingerprints that subtract: invertible Bloom lookup sketches of paragraphs.

A text is cut into lines and a long line into stretches of whole words (at most ``STRETCH`` characters); the hash of a stretch, with the number of
its occurrence, is a key. A sketch has cells of (count, sum of keys, sum of checks); each key falls into three of them. The
difference of two sketches holds only the keys that differ, and peeling reads them off: a cell with
one key left names it, and taking it away lays others open. If peeling stops early, both texts are sketched
again with twice the cells. Likeness is Jaccard over the keys: ``(a + b - d) / (a + b + d)`` with ``d`` recovered keys.

Null is the empty text, which has no keys; two empty texts are alike (1). Equal texts have equal fingerprints.
Documents follow each other by ascending id (equal ids by text), after the last comes the first; documents
without an id stand alone and are followed by themselves. Other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import ROWS
from .hashing import mix
from .registry import query, table

STRETCH = 120
PARAGRAPH = re.compile(r"[^\n]{1,%d}(?=\s|$)|[^\n]{1,%d}" % (STRETCH, STRETCH))
CELLS = 24                  # of a fingerprint; three parts
ROWS_AT_ONCE = 512
CHARS_AT_ONCE = 1 << 21     # a text more at most
RANGE_ROWS = 400            # documents ordered together, about, until there are MAX_RANGES ranges
MAX_RANGES = 4_000
SALT = np.uint64(0x2545F4914F6CDD1D)


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of all paragraphs; the second occurrence of a paragraph in a text has a key of its own."""
    found = [[xxhash.xxh3_64_intdigest(p) for p in PARAGRAPH.findall(t)] for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    h = np.fromiter((k for f in found for k in f), np.uint64, len(row))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    place = np.arange(len(h))
    nth = place - np.maximum.accumulate(np.where(fresh, place, 0)) if len(h) else place
    return row, mix(h + nth.astype(np.uint64) * SALT)


class Sketches:
    """Sketches of many sets at a time; ``sign`` -1 takes keys away."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count, self.keys, self.checks = np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)

    def places(self, row: np.ndarray, key: np.ndarray) -> np.ndarray:
        third = self.cells // 3
        return np.concatenate([row * self.cells + j * third + (mix(key ^ np.uint64(int(SALT) * (self.cells + j) % (1 << 64))) % np.uint64(third)).astype(np.int64) for j in range(3)])

    def add(self, row: np.ndarray, key: np.ndarray, sign: np.ndarray | int = 1) -> None:
        at = self.places(row, key)
        sign = np.broadcast_to(np.asarray(sign, np.int64), key.shape)
        factor = sign.astype(np.uint64)                 # -1 wraps round, as sums do
        np.add.at(self.count, at, np.tile(sign, 3))
        np.add.at(self.keys, at, np.tile(key * factor, 3))
        np.add.at(self.checks, at, np.tile(self.check(key) * factor, 3))

    @staticmethod
    def check(key: np.ndarray) -> np.ndarray:
        return mix(key + SALT) >> np.uint64(32)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, sign) of all keys read off, and whether each row came out empty."""
        out = []
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            factor = self.count[at].astype(np.uint64)
            key = self.keys[at] * factor
            right = self.checks[at] * factor == self.check(key)
            at, key = at[right], key[right]
            if not len(at):
                break
            sign, row = self.count[at], at // self.cells
            order = np.lexsort((key, row))
            row, key, sign = row[order], key[order], sign[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            out.append((row[first], key[first], sign[first]))
            self.add(row[first], key[first], -sign[first])
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        row, key, sign = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return row, key, sign, ~left.reshape(self.n, self.cells).any(axis=1)

    def text(self, sizes: np.ndarray) -> list[str]:
        """Each sketch in hexadecimal: the number of keys, then count, keys, checks of every cell."""
        cell = np.zeros(self.n * self.cells, [("count", ">i4"), ("keys", ">u8"), ("checks", ">u4")])
        cell["count"], cell["keys"], cell["checks"] = self.count, self.keys, (self.checks & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        width = cell.itemsize * self.cells
        raw = cell.tobytes()
        return [f"{int(k):08x}" + raw[i * width:(i + 1) * width].hex() for i, k in enumerate(sizes)]


def likeness(n: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Jaccard of the key sets ``a`` and ``b`` (row, key) of each of ``n`` rows, from peeled differences."""
    na, nb = np.bincount(a[0], minlength=n), np.bincount(b[0], minlength=n)
    differ, open_rows, cells = np.zeros(n, np.int64), np.arange(n), CELLS
    while len(open_rows):
        place = np.full(n, -1)
        place[open_rows] = np.arange(len(open_rows))
        s = Sketches(len(open_rows), cells)
        for (row, key), sign in ((a, 1), (b, -1)):
            mine = place[row] >= 0
            s.add(place[row[mine]], key[mine], sign)
        row, _, _, empty = s.peel()
        found = np.bincount(row, minlength=len(open_rows))
        differ[open_rows[empty]] = found[empty]
        open_rows, cells = open_rows[~empty], cells * 2
    return np.where(na + nb > 0, (na + nb - differ) / np.maximum(na + nb + differ, 1), 1.0)


def compare(texts: list[str], following: list[str]) -> pd.DataFrame:
    n = len(texts)
    edited = []
    for t, f in zip(texts, following, strict=True):
        q = len(t) // 4
        edited.append(t[:len(t) - q] + f[:q])
    row, key = keys_of(texts + edited + following)
    own, edit, nxt = ((row[m] - k * n, key[m]) for k in range(3) for m in [(row >= k * n) & (row < (k + 1) * n)])
    prints = []
    for r, k in (own, edit):
        s = Sketches(n, CELLS)
        s.add(r, k)
        prints.append(s.text(np.bincount(r, minlength=n)))
    return pd.DataFrame({"n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                         "fingerprint": prints[0], "edited_fingerprint": prints[1],
                         "near_edited": likeness(n, own, edit), "near_next": likeness(n, own, nxt)})


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how near the fingerprints are."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = rows.filter("id is not null").count()
    k = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    starts = rows.agg(F.min("id").alias("low"), F.percentile_approx("id", [i / k for i in range(1, k)] or [0.5], 20 * MAX_RANGES).alias("starts")).first()
    bounds = sorted({starts["low"], *(starts["starts"] or [])}) if n else []

    # ranges start at ids that exist; the rows of such an id also close the range before theirs
    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series) -> pd.Series:
        out = []
        for at, x in zip(np.searchsorted(bounds, ids.fillna(bounds[0]).to_numpy(), "right") - 1 if bounds else [0] * len(ids), ids, strict=True):
            out.append([-1] if pd.isna(x) else [int(at), (int(at) - 1) % len(bounds)] if x == bounds[at] else [int(at)])
        return pd.Series(out)

    placed = (rows.select("id", "text", F.posexplode(ranges("id")).alias("closing", "range"))
              .withColumn("range", F.when(F.col("range") < 0, -1 - F.pmod(F.xxhash64("text"), F.lit(997))).otherwise(F.col("range")).cast("int"))
              .repartition("range").sortWithinPartitions("range", "closing", "id", "text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, following, kind = [], [], [], None
        held, chars = None, 0

        def done():
            out = compare(texts, following)
            arrays = [pa.array(ids, kind), *[pa.array(out[c]) for c in out.columns]]
            ids.clear(), texts.clear(), following.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["id", *out.columns])

        for b in batches:
            kind = b.schema.field("id").type
            for k in range(0, b.num_rows, ROWS):
                rows = b.slice(k, ROWS).to_pydict()
                for i, text, closing, at in zip(rows["id"], rows["text"], rows["closing"], rows["range"], strict=True):
                    if held and held[2] == at:
                        ids.append(held[0]), texts.append(held[1]), following.append(text)
                        chars += len(held[1])
                    held = None
                    if at < 0:
                        ids.append(None), texts.append(text), following.append(text)
                        chars += len(text)
                    elif not closing:
                        held = i, text, at
                    if len(ids) >= ROWS_AT_ONCE or chars >= CHARS_AT_ONCE:
                        yield done()
                        chars = 0
        if ids:
            yield done()

    return placed.mapInArrow(work, f"id {id_type}, {RESULT}").withColumnRenamed("id", id_col)


@query("op9_paragraph_sketches")
def op9(spark, sf_dir):
    return fingerprint_versions(table(spark, sf_dir, "documents").select("doc_id", "text"))
