"""The stream gives what the batch operators give, in however many micro-batches."""

from __future__ import annotations

import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajspark import fixed_values as V
from trajspark.operators import sessions as W
from trajspark.sources.committed import CommittedTable
from trajspark.sources.readers import read_event_log
from trajspark.streaming import live as L


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    """A log in five files; the last line of each is cut off."""
    r, folder = random.Random(9), tmp_path_factory.mktemp("log")
    n = 0
    for part in range(5):
        lines = []
        for _ in range(40):
            n += 1
            lines.append(json.dumps({"t": n / 10, "event": "step", "n": n, "run_id": r.choice("aab"), "ok": r.random() > .4, "changed": r.choice([None, True, False, False]),
                                     "elapsed": 1.5, "situation": r.choice(V.SITUATIONS + (V.RETRY,) * 4), "action": {"type": r.choice(["click", "click", "wait"])}}))
        (folder / f"{part}.jsonl").write_text("\n".join(lines) + '\n\n{"t": 1, "ev')
    (folder / "9.jsonl").write_text(json.dumps({"t": 1e6, "event": "tick"}))
    return str(folder)


def steps(d):
    return d.filter("event = 'step'")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def drained(stream, tmp_path, mode="append"):
    return L.drain(stream, str(tmp_path / "out"), str(tmp_path / "ck"), mode)


# one file per micro-batch: files are taken in order of their time stamp, so state has to carry over
@pytest.mark.parametrize("files", [1, 100])
def test_alerts_equal_batch(spark, log, tmp_path, files):
    import os
    for i in (0, 1, 2, 3, 4, 9):
        os.utime(f"{log}/{i}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))
    batch = steps(read_event_log(spark, log))
    ev = L.stream_events(spark, log, max_files=files)
    assert rows(drained(L.stream_stuck(ev, F.col("action.type")), tmp_path / "1"), "run_id", "n", "stuck") == \
        rows(W.is_stuck(batch, "run_id", "n", F.col("action.type")), "run_id", "n", "stuck")
    assert rows(drained(L.stream_failures(ev), tmp_path / "2"), "run_id", "n", "fail_run", "aborts") == \
        rows(W.failure_runs(batch, "run_id", "n", F.col("ok")), "run_id", "n", "fail_run", "aborts")
    assert rows(drained(L.stream_stalls(ev), tmp_path / "3"), "run_id", "n", "effective") == \
        rows(W.escalate_stalls(batch, "run_id", "n"), "run_id", "n", "effective")


def put(folder, name, lines, age):
    import os
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(x) for x in lines))
    os.utime(folder / name, (1_700_000_000 + age, 1_700_000_000 + age))


def event(run, n, t, **more):
    return {"t": t, "event": "step", "n": n, "run_id": run, "ok": n % 5 == 0, "changed": False, "situation": V.RETRY, "action": {"type": "click" if n % 7 else "wait"}, **more}


@pytest.mark.parametrize("per_batch", [1, 3, 100])
def test_shuffled_late_and_repeated_rows(spark, tmp_path, per_batch):
    """Rows up to a minute late, in any order over six files, some twice, give what the batch operators give."""
    r = random.Random(per_batch)
    log = [event(run, n, 1000 + 2.0 * n) for n in range(1, 241) for run in [r.choice("abc")]]
    arrived = sorted(log + log[::9], key=lambda e: e["t"] + r.random() * 50)
    for k in range(6):
        put(tmp_path / "in", f"{k}.json", arrived[k * len(arrived) // 6:(k + 1) * len(arrived) // 6], k)
    put(tmp_path / "in", "9.json", [{"t": 1e6, "event": "tick"}], 9)
    ev = L.stream_events(spark, str(tmp_path / "in"), max_files=per_batch)
    (tmp_path / "all").mkdir()
    (tmp_path / "all" / "log.json").write_text("\n".join(map(json.dumps, log)))
    batch = read_event_log(spark, str(tmp_path / "all"))
    assert rows(drained(L.stream_stuck(ev, F.col("action.type")), tmp_path / "1"), "run_id", "n", "stuck") == \
        rows(W.is_stuck(batch, "run_id", "n", F.col("action.type")), "run_id", "n", "stuck")
    assert rows(drained(L.stream_failures(ev), tmp_path / "2"), "run_id", "n", "fail_run", "aborts") == \
        rows(W.failure_runs(batch, "run_id", "n", F.col("ok")), "run_id", "n", "fail_run", "aborts")


def test_ended_and_abandoned_runs(spark, tmp_path):
    """State ends with finish and with a long silence, whichever batch the rows come in; a row against the order of n has no verdict."""
    bad = {"ok": False}
    put(tmp_path / "in", "0.json", [event("a", n, 100.0 + n, **bad) for n in (2, 1, 3)] + [event("b", 1, 100.0, **bad), event("c", 1, 100.0, **bad)], 0)
    put(tmp_path / "in", "1.json", [event("a", 5, 105.0, event="finish", **bad), event("a", 4, 104.0, **bad), event("a", 6, 106.0, **bad), event("b", 2, 150.0, **bad)], 1)
    put(tmp_path / "in", "2.json", [event("b", 3, 5000.0, **bad), event("c", 5, 170.0, **bad)], 2)
    put(tmp_path / "in", "3.json", [event("c", 3, 6000.0, **bad), event("b", 4, 6010.0, **bad)], 3)
    put(tmp_path / "in", "9.json", [{"t": 1e6, "event": "tick"}], 9)
    want = {("a", 1): 1, ("a", 2): 2, ("a", 3): 3, ("a", 4): 4, ("a", 5): 5, ("a", 6): 1, ("b", 1): 1, ("b", 2): 2, ("b", 3): 1, ("b", 4): 2, ("c", 1): 1, ("c", 5): 2, ("c", 3): 1}
    for k, files in enumerate((1, 100)):
        got = drained(L.stream_failures(L.stream_events(spark, str(tmp_path / "in"), max_files=files), ttl="1800 seconds"), tmp_path / f"o{k}")
        assert {(r["run_id"], r["n"]): r["fail_run"] for r in got.collect()} == want
    got = drained(L.stream_failures(L.stream_events(spark, str(tmp_path / "in"), max_files=1), ttl="2 days"), tmp_path / "late")
    late = {(r["run_id"], r["n"]): r["fail_run"] for r in got.collect()}
    assert late["c", 3] is None and late["b", 4] == 4


def test_starting_a_stream_leaves_the_session_as_it_was(spark, log, tmp_path):
    before = spark.conf.get(L.PROVIDER)
    drained(L.stream_stalls(L.stream_events(spark, log)), tmp_path)
    assert spark.conf.get(L.PROVIDER) == before


def test_a_stream_has_no_more_partitions_than_it_can_use(spark):
    """Every partition opens its state store in every batch."""
    before = spark.conf.get(L.PARTITIONS, None)
    most = max(L.STATE_PARTITIONS, 2 * spark.sparkContext.defaultParallelism)
    try:
        for asked in (5000, 4):
            spark.conf.set(L.PARTITIONS, str(asked))
            with L.stateful(spark):
                assert int(spark.conf.get(L.PARTITIONS)) == min(asked, most)
            assert int(spark.conf.get(L.PARTITIONS)) == asked
    finally:
        spark.conf.unset(L.PARTITIONS) if before is None else spark.conf.set(L.PARTITIONS, before)


def test_running_summary_and_beats(spark, log, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "COMPACT_EVERY", 3)
    batch = steps(read_event_log(spark, log))
    names = ("run_id", "n_steps", "changed_steps", "errors", "wall_time")
    want = batch.groupBy("run_id").agg(F.count("*").alias("n_steps"), F.count_if("changed").alias("changed_steps"), F.count_if(~F.col("ok")).alias("errors"), F.sum("elapsed").alias("wall_time"))
    for k in range(2):          # a second start finds nothing new
        ev = steps(L.stream_events(spark, log, max_files=1))
        L.write_run_summary(ev, str(tmp_path / "sum"), str(tmp_path / "ck")).awaitTermination()
        assert rows(L.read_run_summary(spark, str(tmp_path / "sum")), *names) == rows(want, *names)
    table = CommittedTable(spark, str(tmp_path / "sum"), L.SUMMARY)
    assert len(table.folders()) < 3
    assert table.clean() > 0 and rows(L.read_run_summary(spark, str(tmp_path / "sum")), *names) == rows(want, *names)
    beats = L.stream_stale_workers(ev.select(F.col("run_id").alias("worker"), F.col("t").alias("beat")))
    assert {r.worker: r.last_beat for r in drained(beats, tmp_path / "b", "complete").collect()}.keys() == {"a", "b"}


def test_silence_in_a_log(spark, tmp_path):
    """Pauses of over 30 s are told once, at the end too, whatever the batches."""
    times = {"a": [100, 120, 150, 181, 200], "b": [100, 500, 505]}
    arrived = sorted(((t, w) for w, some in times.items() for t in some), key=lambda x: x[0] + 40 * (x[0] % 3))
    for k, (t, w) in enumerate(arrived):
        put(tmp_path / "in", f"{k}.json", [{"t": float(t), "run_id": w, "event": "beat"}], k)
    put(tmp_path / "in", "z.json", [{"t": 9000.0, "event": "tick"}], 99)
    for k, files in enumerate((1, 100)):
        ev = L.stream_events(spark, str(tmp_path / "in"), max_files=files)
        beats = ev.select(F.col("run_id").alias("worker"), F.timestamp_seconds("t").alias("beat"))
        got = drained(L.stream_silent_workers(beats, clock="event", delay="100 seconds"), tmp_path / f"o{k}")
        assert rows(got.select("worker", F.unix_seconds("last_beat").alias("l"), F.unix_seconds("gone_at").alias("g")), "worker", "l", "g") == \
            [("a", 150, 180), ("a", 200, 230), ("b", 100, 130), ("b", 505, 535)]


def test_a_silent_worker_speaks_up_by_the_clock(spark, tmp_path):
    """Two beats, then nothing more: the row comes without another beat; a later beat arms the timer again."""
    (tmp_path / "in").mkdir()
    beat = lambda name, workers: (tmp_path / "in" / name).write_text("\n".join(json.dumps({"t": time.time(), "run_id": w, "event": "beat"}) for w in workers))
    beats = L.stream_events(spark, str(tmp_path / "in")).select(F.col("run_id").alias("worker"), F.timestamp_seconds("t").alias("beat"))
    with L.stateful(spark):
        q = (L.stream_silent_workers(beats, timeout="4 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start())
    try:
        def told(n):
            end = time.time() + 90
            while time.time() < end:
                assert q.exception() is None, q.exception()
                try:
                    got = spark.read.schema(L.GONE).parquet(str(tmp_path / "out")).collect()
                except Exception:
                    got = []
                if len(got) >= n:
                    return sorted(r["worker"] for r in got)
                time.sleep(1)
            return None
        beat("1.json", "ab")
        assert told(2) == ["a", "b"]
        beat("2.json", "a")
        assert told(3) == ["a", "a", "b"]
    finally:
        q.stop()


SCHEMA = "run_id string, n int, ok boolean, at timestamp"


def copied(log, folder):
    folder.mkdir()
    for i in (0, 1):
        text = open(f"{log}/{i}.jsonl").read()
        (folder / f"{i}.jsonl").write_text(text)
        (folder / f"again{i}.jsonl").write_text(text)


def events(spark, folder, **options):
    ev = L.stream_events(spark, str(folder), **options).withColumn("at", F.timestamp_seconds("t"))
    return steps(ev).select("run_id", "n", "ok", "at")


def test_events_arrive_once(spark, log, tmp_path):
    copied(log, tmp_path / "in")
    for _ in range(2):          # a second start finds nothing new
        L.write_events(events(spark, tmp_path / "in", max_files=1), str(tmp_path / "table"), str(tmp_path / "ck"), time="at").awaitTermination()
    d = L.read_events(spark, str(tmp_path / "table"), SCHEMA)
    assert d.count() == 80 and d.select("run_id", "n").distinct().count() == 80


def test_crash_between_files_and_commit(spark, log, tmp_path, monkeypatch):
    """What a failed attempt wrote is not seen; the batch run again is; a batch run again after its commit does nothing."""
    copied(log, tmp_path / "in")
    whole, left = CommittedTable._commit, [2]

    def fail(self, entry):
        left[0] -= 1
        if left[0] == 0:
            raise RuntimeError("power cut")
        whole(self, entry)

    monkeypatch.setattr(CommittedTable, "_commit", fail)
    q = L.write_events(events(spark, tmp_path / "in", max_files=1), str(tmp_path / "table"), str(tmp_path / "ck"), time="at")
    with pytest.raises(Exception, match="power cut"):
        q.awaitTermination()
    kept = L.read_events(spark, str(tmp_path / "table"), SCHEMA).count()
    assert 0 < kept < 80
    table = CommittedTable(spark, str(tmp_path / "table"), L.read_events(spark, str(tmp_path / "table"), SCHEMA).schema)
    L.write_events(events(spark, tmp_path / "in", max_files=1), str(tmp_path / "table"), str(tmp_path / "ck"), time="at").awaitTermination()
    d = L.read_events(spark, str(tmp_path / "table"), SCHEMA)
    assert d.count() == 80 and d.select("run_id", "n").distinct().count() == 80
    name = sorted(table.names)[0]
    table.append(d.withColumn("_slot", F.lit("t0")), name)
    table = CommittedTable(spark, str(tmp_path / "table"), d.schema)
    assert table.clean() >= 1 and table.clean() == 0 and table.read().count() == 80


def test_a_batch_opens_what_its_times_need(spark, tmp_path, monkeypatch):
    """Twelve hours of log, one file an hour: every batch opens the slots around its own hour only."""
    for h in range(12):
        put(tmp_path / "in", f"{h:02}.json", [event("a", 100 * h + k, 1e6 + 3600.0 * h + k) for k in range(30)] + [event("a", 100 * (h - 1) + k, 1e6 + 3600.0 * (h - 1) + k) for k in range(5) if h], h)
    opened, read = [], CommittedTable.read
    monkeypatch.setattr(CommittedTable, "read", lambda self, slots=None: (opened.append(len(self.paths(slots))), read(self, slots))[1])
    L.write_events(events(spark, tmp_path / "in", max_files=1), str(tmp_path / "table"), str(tmp_path / "ck"), time="at").awaitTermination()
    assert len(opened) == 12 and max(opened) <= 4
    assert L.read_events(spark, str(tmp_path / "table"), SCHEMA).count() == 360


def test_late_first_deliveries_arrive(spark, tmp_path):
    """Days out of order over several batches, with repeats and without a time."""
    import os
    (tmp_path / "in").mkdir()
    days = [5, 9, 1, 5, 0, 1, 9]
    for i, day in enumerate(days):
        lines = [json.dumps({"t": day * 86_400.0 + k, "event": "step", "n": day * 100 + k, "run_id": "a", "ok": True}) for k in range(20)]
        lines.append(json.dumps({"event": "step", "n": 5_000 + day, "run_id": None, "ok": True}))
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(lines))
        os.utime(tmp_path / "in" / f"{i}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))
    for _ in range(2):
        L.write_events(events(spark, tmp_path / "in", max_files=1), str(tmp_path / "table"), str(tmp_path / "ck"), time="at").awaitTermination()
    d = L.read_events(spark, str(tmp_path / "table"), SCHEMA)
    want = sorted([day * 100 + k for day in set(days) for k in range(20)] + [5_000 + day for day in set(days)])
    assert sorted(r["n"] for r in d.select("n").collect()) == want


def test_a_batch_run_again_adds_nothing(spark, log, tmp_path):
    for k in range(2):          # another checkpoint: all batches run again over the same table
        L.write_events(events(spark, log, max_files=2), str(tmp_path / "table"), str(tmp_path / f"ck{k}"), time="at").awaitTermination()
    d = L.read_events(spark, str(tmp_path / "table"), SCHEMA)
    assert d.count() == 200 and d.select("run_id", "n").distinct().count() == 200


def test_silence_in_a_log_is_a_session_window(spark, log):
    """Replayed pauses need no state in Python, so a worker costs no calls between processes; a pause of just the timeout is none, to the microsecond."""
    beats = L.stream_events(spark, log).select(F.col("run_id").alias("worker"), F.timestamp_seconds("t").alias("beat"))
    plan = L.stream_silent_workers(beats, clock="event")._jdf.queryExecution().logical().toString()
    assert "session_window" in plan and "TransformWithState" not in plan
    d = spark.createDataFrame([("a", 0), ("a", 30_000_000), ("a", 60_000_001)], "worker string, us long").select("worker", F.timestamp_micros("us").alias("event_time"))
    assert rows(L._pauses(d, "30 seconds", "1 minute").select(F.unix_micros("last_beat").alias("l"), F.unix_micros("gone_at").alias("g")), "l", "g") == \
        [(30_000_000, 60_000_000), (60_000_001, 90_000_001)]


ALERTS = {"failures": (L.stream_failures, lambda b: W.failure_runs(b, "run_id", "n", F.col("ok")), ("fail_run", "aborts")),
          "stalls": (L.stream_stalls, lambda b: W.escalate_stalls(b, "run_id", "n"), ("effective",)),
          "stuck": (lambda ev, **how: L.stream_stuck(ev, F.col("action.type"), **how), lambda b: W.is_stuck(b, "run_id", "n", F.col("action.type")), ("stuck",))}


@pytest.mark.parametrize("by_time", [False, True])
@pytest.mark.parametrize("name", list(ALERTS))
def test_state_of_many_runs_is_a_bounded_number_of_groups(spark, tmp_path, name, by_time):
    """A call and a state row for each run and batch took 1.6 ms a row; null is a run like others."""
    alert, rule, names = ALERTS[name]
    r = random.Random(5)
    log = [event(r.choice([None, *map(str, range(1500))]), n, 1000 + n / 10, ok=r.random() > .6, changed=r.choice([None, True, False]),
                 situation=r.choice(V.SITUATIONS + (V.RETRY,) * 4)) for n in range(1, 6001)]
    for k in range(3):
        put(tmp_path / "in", f"{k}.json", log[k * 2000:(k + 1) * 2000], k)
    put(tmp_path / "in", "9.json", [{"t": 1e6, "event": "tick"}], 9)
    stream = alert(L.stream_events(spark, str(tmp_path / "in"), max_files=1), by_time=by_time)
    with L.stateful(spark):
        q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start())
    q.awaitTermination()
    assert 0 < max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators) <= L.BUCKETS
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).fillna("-", ["run_id"])
    want = rule(steps(read_event_log(spark, str(tmp_path / "in")))).fillna("-", ["run_id"])
    assert rows(got, "run_id", "n", *names) == rows(want, "run_id", "n", *names)


class Kept:
    """What a rule sees of the state store."""

    exists, get, mark, timeout = False, None, 0, None

    def getCurrentWatermarkMs(self):
        return self.mark

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutTimestamp(self, at):
        assert at >= self.mark
        self.timeout = at


@pytest.mark.parametrize("ttl", [None, 3_000_000])
def test_a_bucket_in_pieces_and_its_timeouts(monkeypatch, ttl):
    """A long run is taken in pieces; a timeout is set for the next row or the first run to end, and nothing is left of what is over."""
    r = random.Random(2)
    at = sorted(r.randrange(60_000) for _ in range(400))
    log = pd.DataFrame({"run_id": [r.choice(["a", "a", "a", "b", None]) for _ in at], "n": range(400), "at": [1000 * t + 1 for t in at], "ended": [r.random() < .01 for _ in at],
                        "ok": [r.choice([True, False, None]) for _ in at], "bucket": 0}).astype({"ok": object})
    seen = []
    for piece, sizes in ((1 << 16, [400]), (7, [400]), (3, [90, 0, 200, 110])):
        monkeypatch.setattr(L, "PIECE", piece)
        rules, kept, out, start = L.FailureBudget(2, ttl, True), Kept(), [], 0
        for size in sizes:
            kept.mark, kept.timeout = (int(log["at"][start - 1]) // 1000 if start else 0), None
            out += list(rules.take(iter([log[start:start + size]]), kept))
            start += size
        while kept.timeout is not None:
            kept.mark, kept.timeout = kept.timeout + 1, None
            out += list(rules.take(iter([log[:0]]), kept))
        assert kept.exists == (ttl is None) and all(len(o) <= piece for o in out)
        seen.append(sorted(pd.concat(out).values.tolist(), key=lambda x: x[1]))
    assert len(seen[0]) == 400 and seen[0] == seen[1] == seen[2]
    fails, last = {}, {}
    for run, n, t, ended, ok in log[["run_id", "n", "at", "ended", "ok"]].values.tolist():
        if ttl is not None and t > last.get(run, t) + ttl:
            fails.pop(run)
        fails[run] = 0 if ok else fails.get(run, 0) + 1
        assert seen[0][n] == [run, n, fails[run], fails[run] > 2]
        last[run] = t
        if ended:
            fails.pop(run), last.pop(run)
