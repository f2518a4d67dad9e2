"""Ordered rules against plain Python, on plain windows and on cut-up hot groups."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark import fixed_values as V
from trajspark.operators import sessions as W
from trajspark.operators.ordered import OrderedRows
from trajspark.operators.ranking import global_rank
from trajspark.operators.selection import filter_detections, length_batches, seeded_sample, spread_sample

rnd = random.Random(11)
# one run holds a third of all rows, one run id is null
ROWS = [(rnd.choice(["a", "a", "b", "c", None, "d"]), i, rnd.choice(["x", "x", "y"]), rnd.random() > 0.4,
         rnd.choice([None, True, False]), rnd.choice(V.SITUATIONS + (V.RETRY,) * 4), round(rnd.random(), 3)) for i in range(400)]
SCHEMA = "run string, n long, type string, ok boolean, changed boolean, situation string, value double"
HOT = [None, 25]        # None: plain windows only; 25: every group is cut into pieces


@pytest.fixture(scope="module")
def steps(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


def by_run():
    groups = {}
    for r in ROWS:
        groups.setdefault(r[0], []).append(r)
    return groups


def table(df, *cols):
    return {r["n"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("hot", HOT)
def test_running_and_previous(steps, hot):
    o = OrderedRows(steps, "run", "n", hot).position("pos").running({"s": ("sum", F.col("value")), "hi": ("max", F.col("value"))})
    o = o.running({"low": ("min", F.col("value"))}, before=True).previous("prev", F.col("n"), 3)
    got = table(o.df(), "pos", "s", "hi", "low", "prev")
    for rows in by_run().values():
        for i, r in enumerate(rows):
            vals = [x[6] for x in rows[:i + 1]]
            pos, s, hi, low, prev = got[r[1]]
            assert pos == i + 1 and s == pytest.approx(sum(vals)) and hi == max(vals)
            assert low == (min(vals[:-1]) if i else None) and prev == [x[1] for x in rows[max(0, i - 3):i]]
    assert len(got) == len(ROWS)


@pytest.mark.parametrize("hot", HOT)
def test_stuck(steps, hot):
    got = table(W.is_stuck(steps, "run", "n", F.col("type"), hot_rows=hot), "stuck")
    for rows in by_run().values():
        for i, r in enumerate(rows):
            tail = rows[max(0, i - 2):i + 1]
            marks = [t[4] for t in tail]
            want = len(tail) == 3 and len({t[2] for t in tail}) == 1 and (all(m is None for m in marks) or not any(marks))
            assert got[r[1]] == (want,)


@pytest.mark.parametrize("hot", HOT)
def test_failures_stalls_and_progress(steps, hot):
    fails = table(W.failure_runs(steps, "run", "n", F.col("ok"), hot_rows=hot), "fail_run", "aborts", "retried")
    up = W.escalate_stalls(steps, "run", "n", hot_rows=hot)
    eff = table(up, "effective")
    prog = table(W.subtask_progress(up, "run", "n", hot_rows=hot), "subtask_index", "replans")
    for rows in by_run().values():
        f = stalls = index = replans = 0
        for r in rows:
            f = 0 if r[3] else f + 1
            assert fails[r[1]] == (f, f > 2, 0 < f <= 2)
            s = r[5]
            stalls = stalls + 1 if s == V.RETRY else 0
            if stalls == 3:
                s, stalls = V.REFORMULATE, 0
            assert eff[r[1]] == (s,)
            if s == V.SUCCESS:
                index += 1
            elif s == V.REFORMULATE and replans < 2:
                replans, index = replans + 1, 0
            assert prog[r[1]] == (index, replans)


@pytest.mark.parametrize("hot", HOT)
def test_moving_mean_and_running_best(steps, hot):
    mean = table(W.moving_mean(steps, "run", "n", "value", 4, hot_rows=hot), "smoothed")
    best = table(W.running_best(steps, "run", "n", "value", hot_rows=hot), "is_best")
    for rows in by_run().values():
        low = float("inf")
        for i, r in enumerate(rows):
            assert mean[r[1]][0] == pytest.approx(np.mean([x[6] for x in rows[max(0, i - 3):i + 1]]))
            assert best[r[1]] == (r[6] < low,)
            low = min(low, r[6])


@pytest.mark.parametrize("hot", HOT)
def test_run_outcome(spark, hot):
    def run(name, *rows):
        return [(name, i, t, ok, ch) for i, (t, ok, ch) in enumerate(rows)]
    click, bad = ("click", True, False), ("wait", False, None)
    rows = (run("done", click, ("finished", True, None), click) + run("help", ("call_user", True, None)) + run("abort", bad, bad, bad, click)
            + run("recovers", bad, bad, ("type", True, True), bad) + run("stuck", click, click, click, click)
            + run("moves", *[("click", True, True)] * 5) + run("limit", *[("click", True, True)] * 16) + run("failed_help", ("call_user", False, None)))
    d = spark.createDataFrame(rows, "run string, n long, type string, ok boolean, changed boolean")
    out = {r.run: (r.outcome, r.end_step, r.success) for r in W.run_outcome(d, "run", "n", F.col("type"), hot_rows=hot).collect()}
    assert out == {"done": ("finished", 2, True), "help": ("call_user", 1, False), "abort": ("abort", 3, False), "recovers": (None, None, None),
                   "stuck": ("stuck", 3, False), "moves": (None, None, None), "limit": ("step_limit", 15, False), "failed_help": (None, None, None)}


def test_run_outcome_looks_at_sizes_once(steps, monkeypatch):
    cuts, cut = [], OrderedRows._cut
    monkeypatch.setattr(OrderedRows, "_cut", lambda self, *a: cuts.append(1) or cut(self, *a))
    W.run_outcome(steps, "run", "n", F.col("type"), hot_rows=25)
    assert len(cuts) == 1


@pytest.mark.parametrize("hot", HOT)
def test_history_groups(spark, hot):
    rows = [("s1", "a", 1, "t"), ("s1", "a", 2, ""), ("s1", "a", 3, "t"), ("s1", "b", 4, "t"), ("s2", "c", 1, "t")] + [("s3", "z", i, "t") for i in range(60)]
    d = spark.createDataFrame(rows, "session_id string, image string, step_index int, thought string").withColumn("line", F.col("step_index").cast("string"))
    h = W.with_history(d, line=F.col("line"), hot_rows=hot)
    got = {(r.session_id, r.step_index): (r.position, [(x.n, x.line) for x in r.history]) for r in h.collect()}
    assert ("s1", 2) not in got                                        # no thought, no sample, no history
    assert got[("s1", 4)] == (3, [(1, "1"), (2, "3")]) and got[("s2", 1)] == (1, [])
    assert got[("s3", 59)] == (60, [(n, str(n - 1)) for n in range(55, 60)])
    per = {(r.session_id, r.step_index): r.position for r in W.with_history(d, per_image=True, line=F.col("line"), hot_rows=hot).collect()}
    assert per[("s1", 3)] == 2 and per[("s1", 4)] == 1


def anchors(rows, thr):
    out, anchor, vec = {}, None, None
    for i, v in rows:
        if vec is None or np.abs(np.array(vec) - np.array(v)).mean() >= thr:
            anchor, vec = i, v
        out[i] = anchor
    return out


@pytest.mark.parametrize("piece", [10_000, 7])
def test_anchor_reuse_pieces_agree_with_one_fold(spark, piece):
    r = random.Random(3)
    rows = {"s": [(i, [r.random() * 0.2 + i * 0.01, r.random() * 0.2]) for i in range(60)], "t": [(i, [r.random(), r.random()]) for i in range(5)],
            "u": [(i, [0.5, 0.5]) for i in range(40)], None: [(i, [r.random(), i * 0.02]) for i in range(30)]}
    d = spark.createDataFrame([(s, i, v) for s, x in rows.items() for i, v in x], "session string, frame long, vec array<double>")
    got = {(x.session, x.frame): x.anchor for x in W.anchor_reuse(d, "session", "frame", threshold=0.15, piece_rows=piece).collect()}
    assert got == {(s, i): a for s, x in rows.items() for i, a in anchors(x, 0.15).items()}


def test_cut_offs_refine_twice(spark):
    """The n-th smallest hash, with buckets inside buckets."""
    from trajspark.operators import ranking as K
    d = spark.range(20_000).select((F.col("id") % 3).alias("c"), F.md5(F.col("id").cast("string")).alias("h"))
    rows = [(r.c, r.h) for r in d.collect()]
    for n in (1, 17, 6_000):
        got = {r.c: r.cutoff for r in K.hash_cutoffs(d, "h", lambda t: F.least(t, F.lit(n)), by=("c",)).collect()}
        assert got == {c: sorted(h for k, h in rows if k == c)[n - 1] for c in range(3)}
    assert K.hash_cutoffs(d, "h", lambda t: F.floor(t / 2)).first().cutoff == sorted(h for _, h in rows)[9_999]


def test_lookup_join_takes_left_and_inner_only(spark):
    from trajspark.operators.matching import lookup_join
    with pytest.raises(ValueError):
        lookup_join(spark.range(3), spark.range(3), "id", how="full")


def test_frame_changed(spark):
    d = spark.createDataFrame([("s", 1, [0.0, 0.0]), ("s", 2, [1.0, 1.0]), ("s", 3, [4.0, 4.0]), ("s", 4, None)], "s string, n int, vec array<double>")
    assert [r.changed for r in W.frame_changed(d, "s", "n").orderBy("n").collect()] == [True, False, True, True]


@pytest.mark.parametrize("hot", HOT)
def test_detections_are_renumbered_without_gaps(spark, hot):
    d = spark.createDataFrame([("a", i, 0.1 if i % 3 == 0 else 0.9) for i in range(90)], "screen_id string, id int, confidence double")
    got = [r.new_id for r in filter_detections(d, hot_rows=hot).orderBy("id").collect()]
    assert got == list(range(60))


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_ranks_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        d = spark.range(0, 300, 1, 7).select(F.col("id"), (F.col("id") % 4).alias("len"))
        got = [r.id for r in global_rank(d, ["len", "id"]).orderBy("rank").collect()]
        assert got == sorted(range(300), key=lambda i: (i % 4, i))
        assert sorted(r.id for r in spread_sample(d, 7, ["id"]).collect()) == [int(i * (300 / 7)) for i in range(7)]
        assert len({r.id for r in seeded_sample(d, "id", 50, 1).collect()}) == 50
        assert spread_sample(d, 1000, ["id"]).count() == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_spread_covers_the_range(spark):
    got = sorted(r.id for r in spread_sample(spark.range(334), 40, ["id"]).collect())
    assert len(got) == 40 and got[0] == 0 and got[-1] > 320


def test_length_batches_hold_neighbours_in_length(spark):
    d = spark.range(100).withColumn("len", (F.col("id") * 7) % 50)
    rows = length_batches(d, 8, 42, F.col("len"), "id").collect()
    lens = {}
    for r in rows:
        lens.setdefault(r.batch, []).append(r.len)
    assert sorted(map(len, lens.values())) == [4] + [8] * 12 and all(max(a) - min(a) <= 4 for a in lens.values())


def scans(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("FileScan")


def test_cut_offs_read_their_input_once_per_level(spark, tmp_path):
    from trajspark.operators import splits as U
    path = str(tmp_path / "rows")
    spark.range(3_000).select(F.col("id"), (F.col("id") % 300).alias("g"), (F.col("id") % 3).cast("string").alias("type")).write.parquet(path)
    d = spark.read.parquet(path)
    assert scans(U.balance_to_reference(d, d.filter("id % 5 = 0"), "type", "id")) <= 4
    assert scans(U.split_by_group(d, "g", 0.1, 3)) <= 2
    assert scans(U.split_rows(d, "id")) <= 3 and scans(seeded_sample(d, "id", 40, 1)) <= 3


def test_cut_offs_with_null_classes_and_hashes(spark):
    from trajspark.operators import ranking as K
    d = spark.createDataFrame([(c, None if i % 7 == 0 else i) for c in ("a", None) for i in range(200)], "c string, i int").withColumn("h", F.md5(F.col("i").cast("string")))
    rows = [(r.c, r.h) for r in d.collect() if r.h is not None]
    got = {r.c: r.cutoff for r in K.hash_cutoffs(d, "h", lambda t: F.floor(t / 2), by=("c",)).collect()}
    assert got == {c: sorted(h for k, h in rows if k == c)[len(rows) // 4 - 1] for c in ("a", None)}
    assert K.hash_cutoffs(d, "h", lambda t: F.lit(0)).count() == 0 and K.hash_cutoffs(d.filter("c = 'z'"), "h", lambda t: t).count() == 0


def test_spread_of_equal_keys_and_nulls(spark):
    d = spark.createDataFrame([(None, i) for i in range(10)] + [(1, i) for i in range(10)] + [(2, i) for i in range(10)], "k int, v int")
    got = [r.k for r in spread_sample(d, 6, ["k"]).collect()]
    assert sorted(got, key=lambda k: k or 0) == [None, None, 1, 1, 2, 2]
    assert spread_sample(d, 40, ["k"]).count() == 30 and spread_sample(d.filter("v < 0"), 3, ["k"]).count() == 0
