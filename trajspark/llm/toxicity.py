"""Toxicity by non-negative positive-unlabelled learning.

The classifier is a logistic model in numpy over hashed words and word beginnings. It learns from
confirmed toxic documents and from unlabelled text: the risk of the negatives is that of all
unlabelled text less what the positives among it (``prior``) would cause, and where that difference turns negative
the step goes the other way. The prior comes from the labelled rows. Both samples are
bounded (``SAMPLE`` documents each, in order of a hash of doc_id); what is counted or scored covers all rows.
Every fourth fold (crc32 of doc_id) is held out of learning altogether.

Only features that tell the two samples apart take part, each once a document, however long; a last step on the
sample maps the sum of their weights to a probability.

A null text is empty; empty texts get the score of no evidence at all. Rows are scored one by one:
ties, repeated rows and other columns do not matter. Labels of no use (null, or repeated: the
highest counts) are skipped; without positives (empty tables) the score is the prior, 0 at worst.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import text_udf
from .hashing import pieces, words
from .registry import query, table

BITS = 18
BEGINNINGS = (4, 6)         # bytes
APART = 4.0                 # standard errors
SAMPLE = 3_000
HELD_OUT = 2
THRESHOLD = 0.3
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.1, 1e-4


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers with repeats, words per text) in pieces; each word gives one feature for itself and one for each beginning."""
    for raw in pieces((t or "").lower() for t in texts):
        whole, counts = words(raw)
        kinds = [whole, *[words(raw, k)[0] + np.uint64(k) for k in BEGINNINGS]]
        yield np.stack([(h * np.uint64(2 * k + 3)) >> np.uint64(64 - BITS) for k, h in enumerate(kinds)], axis=1).astype(np.int64), counts


def present(at: np.ndarray, counts: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for every feature that a text has, each once."""
    text = np.repeat(np.arange(len(counts)), counts)[:, None]
    both = (text << BITS) | at
    both = np.unique(both if wanted is None else both[wanted[at]])
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        out, wanted = [], self.weights != 0
        for at, counts in features(texts):
            text, feature = present(at, counts, wanted)
            out.append(np.bincount(text, self.weights[feature], len(counts)))
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(texts) + self.shift, -40, 40)))


def table_of(texts: list[str | None]) -> list[np.ndarray]:
    """The features of each text."""
    rows: list[np.ndarray] = []
    for at, counts in features(texts):
        text, feature = present(at, counts)
        rows += np.split(feature.astype(np.int32), np.searchsorted(text, np.arange(1, len(counts))))
    return rows


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """The features whose share of documents differs by ``APART`` standard errors or more between the two."""
    np_, nu = len(positive), len(unlabelled)
    p, u = (np.bincount(np.concatenate(rows), minlength=1 << BITS) for rows in (positive, unlabelled))
    share = (p + u) / (np_ + nu)
    gap = p / np_ - u / nu
    return np.flatnonzero(np.abs(gap) > APART * np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / np_ + 1 / nu)))


def learn(positive: list[str], unlabelled: list[str], prior: float, seed: int = 7) -> np.ndarray:
    """Weights by stochastic gradients of the non-negative risk, with the step size of each feature falling as it is used."""
    p, u = table_of(positive), table_of(unlabelled)
    chosen = telling(p, u)
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    p, u = ([place[r][place[r] >= 0] for r in rows] for rows in (p, u))
    n = len(chosen)
    w, used, bias = np.zeros(n), np.full(n, 1e-3), np.log(prior / (1 - prior))
    rng = np.random.default_rng(seed)

    def slopes(rows, ids: np.ndarray, label: int):
        row = np.repeat(np.arange(len(ids)), [len(rows[i]) for i in ids])
        col = np.concatenate([rows[i] for i in ids])
        z = bias + np.bincount(row, w[col], len(ids))
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        d = (s - label) / len(ids)
        return np.logaddexp(0, z if not label else -z).mean(), np.bincount(col, d[row], n), d.sum()

    for _ in range(EPOCHS if n else 0):
        us = rng.permutation(len(u))
        for k in range(0, len(us), BATCH):
            ub, pb = us[k:k + BATCH], rng.integers(0, len(p), BATCH)
            _, gp, bp = slopes(p, pb, 1)
            lu, gu, bu = slopes(u, ub, 0)
            ln, gn, bn = slopes(p, pb, 0)
            if lu - prior * ln >= 0:
                grad, slope = prior * gp + gu - prior * gn, prior * bp + bu - prior * bn
            else:                                               # the negatives' risk may not fall below nothing
                grad, slope = prior * gn - gu, prior * bn - bu
            grad += DECAY * w
            used += grad * grad
            w -= RATE * grad / np.sqrt(used)
            bias -= RATE * slope
    out = np.zeros(1 << BITS)
    out[chosen] = w
    return out


def calibrate(model: Model, texts: list[str], y: np.ndarray) -> Model:
    """Slope and shift of the evidence by logistic regression (Newton steps, a little ridge)."""
    e = model.evidence(texts)
    scale = e.std() or 1.0
    x, t = np.stack([e / scale, np.ones(len(e))], axis=1), np.zeros(2)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        t -= np.linalg.solve((x.T * (q * (1 - q))) @ x + np.diag([1e-2, 1e-4]), x.T @ (q - y) + np.diag([1e-2, 1e-4]) @ t)
    return Model(model.weights, float(t[0] / scale), float(t[1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", held_out: int | None = HELD_OUT) -> Model:
    """A model from at most ``sample`` positive, unlabelled and labelled clean documents each, none of the held-out fold."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    free = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    if held_out is not None:
        known, free = (d.filter(fold(F.col("id")) != held_out) for d in (known, free))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(n.values())
    if not n.get(1) or total == n[1]:
        return Model(np.zeros(1 << BITS), 0.0, -20.0 if not n.get(1) else 0.0)
    prior = n[1] / total
    place = (F.xxhash64("id") - F.lit(-(1 << 63)).cast("decimal(20,0)")).cast("double") / float(1 << 64)
    rows = free.count()
    picked = known.filter(place < F.when(F.col("label") == 1, sample / n[1]).otherwise(sample / max(1, total - n[1])))
    # ids first: at most about 3 * sample of them, so the texts need no shuffle
    rest = free.filter(place >= 1 - sample / max(1, rows)).select("id").join(known.filter("label = 1"), "id", "left_anti").select("id", F.lit(2).alias("kind"))
    wanted = picked.select("id", F.col("label").cast("int").alias("kind")).unionByName(rest)
    got = (free.filter(F.col("text") != "").join(F.broadcast(wanted), "id").select("kind", "id", "text")
           .dropDuplicates(["kind", "id"]).toPandas().sort_values(["kind", "id"]))
    texts = {k: got.text[got.kind == k].tolist() for k in (0, 1, 2)}
    if not texts[1] or not texts[2]:
        return Model(np.zeros(1 << BITS), 0.0, -20.0)
    # the unlabelled side holds toxic text at its own share: what is known of it is only the prior
    mixed = texts[2] + texts[1][:int(prior / (1 - prior) * len(texts[2]))]
    model = Model(learn(texts[1], mixed, prior))
    clean, toxic = texts[0], texts[1][:max(1, int(prior / (1 - prior) * len(texts[0])))]
    return calibrate(model, clean + toxic, np.array([0.0] * len(clean) + [1.0] * len(toxic)))


def toxicity(text: Column, model: Model) -> Column:
    return text_udf("double", pa.float64(), lambda: model.score)(text)


def score_documents(docs: DataFrame, labels: DataFrame, out: str = "score", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with the column ``out``: how likely a toxic label is."""
    return docs.withColumn(out, toxicity(F.col(text_col), train(docs, labels, text_col=text_col, **kw)))


@query("op3_toxicity_nnpu")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
