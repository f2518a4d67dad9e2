"""Line dedup, centroid clustering and the filter audit against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_samples import prose
from pyspark.sql import functions as F

from trajspark.llm import centroids, filter_audit, line_dedup

SPACE = " \t\n\x0b\x0c\r"
LOWER = {ord(c): c.lower() for c in line_dedup.UPPER}


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    held = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None:
                held[key(line)].add(i)
    gone = lambda i, k: len(k) >= min_chars and len(held[k]) >= min_docs and (i is None or i < max(held[k]))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not gone(i, key(x))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def crowd():
    r = random.Random(4)
    pool = [prose(k, 9).replace("\n", " ") for k in range(12)] + ["ÄÖÜ Straße " * 6, "İstanbul ISTANBUL çok uzun bir satır burada duruyor"]
    rows = []
    for k in range(60):
        lines = [r.choice(["", "  ", "\t"]) + (x.upper() if r.random() < .2 else x) + r.choice(["", " \r", "\x0b"]) for x in r.choices(pool, k=r.randint(0, 9))]
        rows.append((r.choice([k, k, k // 2, None]), "\n".join(lines)))
    return rows + rows[:7] + [(100, None), (101, ""), (102, "\n\n")]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2)])
def test_lines_equal_brute_force(spark, batches, fanout):
    rows = crowd()
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), batches=batches, fanout=fanout).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)


def test_lines_of_odd_rows(edge, edge_rows, empty):
    got = line_dedup.dedup_lines(edge, min_docs=2, batches=3).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines([(r[0], r[1]) for r in edge_rows], min_docs=2)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_runs_in_any_order(spark):
    """Batches in two orders give the same lines; runs are compacted, and what is settled is left out."""
    rows = [(k, "\n".join(prose(s, 14).replace("\n", " ") for s in (k % 3, 50 + k % 7, 100 + k))) for k in range(90)]
    lines = line_dedup.lines_of(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("batch", F.floor(F.col("id") / 10)).cache()
    found = {}
    for name, order in {"down": range(8, -1, -1), "mixed": [4, 0, 8, 2, 6, 1, 7, 3, 5]}.items():
        runs = line_dedup.LineRuns(spark, min_docs=5, fanout=3)
        sizes = []
        for b in order:
            runs.add(lines.filter(F.col("batch") == b))
            sizes.append([len(level) for level in runs.levels])
        assert sizes[:3] == [[1], [2], [0, 1]] and sizes[-1] == [0, 0, 1]
        found[name] = sorted(map(tuple, runs.frequent().collect()))
    assert found["down"] == found["mixed"] and len(found["down"]) == 10
    runs = line_dedup.LineRuns(spark, min_docs=2, fanout=9)
    for b in (8, 7, 6):
        runs.add(lines.filter(F.col("batch") == b))
    assert runs.runs()[2][0].count() < lines.filter("batch = 6").select("h1", "h2").distinct().count()


def test_runs_are_not_moved(spark):
    """The anti join takes a run as it lies: one exchange less than two plain sides would need."""
    lines = line_dedup.lines_of(spark.createDataFrame([(k, prose(k % 4, 30)) for k in range(40)], "doc_id long, text string"))
    runs = line_dedup.LineRuns(spark)
    runs.add(lines)
    run = runs.runs()[0][0]
    own = lines.groupBy("h1", "h2").agg(F.max("id").alias("top")).hint("merge")
    plan = own.join(run.hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def brute_clusters(rows, k=8, rounds=10, dim=64, scale=1024):
    kept = [(i, [math.floor(v * scale) for v in x]) for i, x in rows
            if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    raw = [x for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, hashlib.sha256(f"3:{kept[j][0]}".encode()).hexdigest(), raw[j]))[:k]
    centres = [kept[j][1] for j in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centres = [[sum(col) // len(own[n]) for col in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centres)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    fits = lambda v: v if v <= centroids.LONG else None
    total = collections.Counter()
    for _, c, d in last:
        total[c] += d
    odd = any(d > centroids.LONG for _, _, d in last)
    return sorted(((i, c, fits(d), None if any(e > centroids.LONG for _, x, e in last if x == c) else fits(total[c]), None if odd else fits(sum(total.values())),
                    hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in last), key=str)


def report(spark, rows, kind="array<double>", **options):
    d = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, cluster int, x string, home int") if rows and len(rows[0]) == 5 else \
        spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    return sorted(map(tuple, centroids.clusters_report(d.repartition(3), **options).collect()), key=str)


def test_clusters_equal_brute_force(spark):
    r = np.random.default_rng(1)
    mid = r.normal(size=(5, 64))
    rows = [(k, (mid[k % 5] + r.normal(size=64) * .3).tolist()) for k in range(150)]
    rows += [(200, None), (201, [1.0] * 63), (202, [float("nan")] * 64), (203, [1.0] * 63 + [None]), (204, [float("inf")] * 64), (None, [0.25] * 64)]
    rows += [rows[3], rows[3], (3, rows[4][1])]
    assert report(spark, rows) == brute_clusters(rows)
    clash = [(i, x, 7, "x", 9) for i, x in rows]
    assert report(spark, clash) == brute_clusters(rows)


def test_few_equal_and_no_vectors(spark):
    rows = [(k, [float(k % 2)] * 64) for k in range(12)]           # ties everywhere, clusters that stay empty
    assert report(spark, rows) == brute_clusters(rows)
    rows = [(5, [0.1] * 64), (6, [-0.1] * 64)]
    assert report(spark, rows) == brute_clusters(rows)
    assert report(spark, []) == []


def test_large_components(spark):
    rows = [(k, [(-1.0) ** j * 10.0 ** (k % 9) for j in range(64)]) for k in range(40)] + [(99, [3e38] * 64), (98, [1e300] * 64)]
    assert report(spark, rows) == brute_clusters(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-40, 40), min_size=2, max_size=2), min_size=1, max_size=9), st.integers(0, 1 << 30))
def test_orchard_search(points, seed):
    r = np.random.default_rng(seed)
    v = r.integers(-45, 45, size=(50, 2))
    search = centroids.Orchard(points)
    near, far = search.search(v, r.integers(0, len(points), size=50))
    d = ((v[:, None, :] - np.array(points)[None]) ** 2).sum(axis=2)
    assert near.tolist() == d.argmin(axis=1).tolist() and far.tolist() == d.min(axis=1).tolist()


def test_orchard_measures_less():
    r = np.random.default_rng(0)
    mid = r.integers(-10_000, 10_000, size=(64, 8))
    v = mid[r.integers(0, 64, size=2_000)] + r.integers(-300, 300, size=(2_000, 8))
    search = centroids.Orchard(mid.tolist())
    home, _ = search.search(v, np.zeros(2_000, np.int64))
    search.computed = 0
    again, _ = search.search(v + 1, home)
    assert (again == home).all() and search.computed < 2_000 * 64 / 10


def brute_audit(rows, labels):
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    parts = collections.defaultdict(list)
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)}
        parts[source or ""].append((i, fails))
    out = []
    for part, docs in parts.items():
        steps = {}
        for order in permutations("ABCDE"):
            left = docs
            for n, f in enumerate(order):
                gone = [i for i, x in left if x[f]]
                redundant = sum(x[f] for _, x in docs) - len(gone)
                left = [(i, x) for i, x in left if not x[f]]
                only = sum(x[f] and sum(x.values()) == 1 for _, x in docs)
                steps["".join(order), n + 1] = [len(left), len(gone), redundant, only, sum(i in good for i in gone), sum(i in toxic for i in gone)]
        for (order, n), facts in steps.items():
            shapley = sum(v[1] for (o, m), v in steps.items() if o[m - 1] == order[n - 1])
            out.append((part, order, n, *facts, shapley))
    return sorted(out)


def audit(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "p", 3) for i, t, s in rows], "doc_id long, text string, source string, part string, mask int").repartition(4)
    out = filter_audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == [c.split()[0] for c in filter_audit.REPORT.split(", ")]
    return sorted(map(tuple, out.collect()))


def test_audit_equals_brute_force(spark):
    r = random.Random(2)
    texts = [prose(k, r.choice([10, 49, 50, 60, 300])) + r.choice(["", " 5% off", " A|B", " LOUD" * 30]) for k in range(14)] + [None, "", " \t", "Ä" * 90, "AB\x00\x1c" * 9]
    rows = [(k, r.choice(texts), r.choice(["a", "b", "b", None, ""])) for k in range(70)]
    rows += rows[:4] + [(3, texts[0], "a"), (3, texts[0], "b"), (None, texts[0], "a"), (None, texts[0], None), (None, None, None), (500, "lone" * 30_000, "c")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(60)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (900, 1, 1)]
    assert audit(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_of_no_rows_and_no_labels(spark):
    assert audit(spark, [], []) == []
    rows = [(1, "x", "s"), (2, "x", "s")]
    assert audit(spark, rows, []) == brute_audit(rows, [])


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS_HELD", 3)
    rows = [(k, prose(k % 9, 55), f"s{k % 20}") for k in range(120)]
    assert audit(spark, rows, [(k, 1, k % 2) for k in range(120)]) == brute_audit(rows, [(k, 1, k % 2) for k in range(120)])


def test_fields_do_not_run_over():
    of, n = filter_audit.counters(7), 127
    total = sum(of(mask % 32, True, mask % 3 == 0) for mask in range(n))
    fields = filter_audit.unpack(total, 7)
    removed = sum(filter_audit.outcomes(mask % 32)[0].astype(int) for mask in range(n))
    assert (fields[:600] == removed).all() and (fields[1200:1800] == removed).all() and fields[2400] == n
    assert filter_audit.from_bytes(filter_audit.as_bytes(-total)) == -total
