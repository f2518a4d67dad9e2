"""Live event log as a stream: tolerant source, per-run alerts, running summaries, sink."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed_values as V
from ..sources.committed import CommittedTable
from ..sources.readers import EVENT_SCHEMA, decode_lines

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"
STATE_PARTITIONS = 32
NONE = -(1 << 63)           # in place of a null that would turn a column of long integers into floats
BUCKETS = 256               # of runs, for the state of alerts; another number needs a new checkpoint
PIECE = 1 << 16             # rows of a bucket that are Python objects at once
NEVER = (1 << 63) - 1
TIMELESS_SLOTS = 64         # of the sink, for rows without a time
COMPACT_EVERY = 20          # batches of the run summary


@contextmanager
def stateful(spark: SparkSession):
    """Start queries with state or timers inside of this: a query takes the state store and the number of partitions that are set when it starts.

    A partition opens its store in every batch, which takes as long as thousands of rows, so there are at most ``STATE_PARTITIONS``, or two for each core.
    """
    parts = min(int(spark.conf.get(PARTITIONS)), max(STATE_PARTITIONS, 2 * spark.sparkContext.defaultParallelism))
    settings = {PROVIDER: ROCKSDB, PARTITIONS: str(parts)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _millis(length: str) -> int:
    return int(pd.Timedelta(length).total_seconds() * 1000)


def _micros(length: str | None) -> int | None:
    return None if length is None else _millis(length) * 1000


def _up(micros: int) -> int:
    """The first whole millisecond that is not before: timers and watermarks have no finer one."""
    return -(-micros // 1000)


def stream_events(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA, max_files: int = 1000) -> DataFrame:
    """JSON lines appended to a folder; blank and half-written lines are skipped.

    ``max_files`` bounds a micro-batch.
    """
    return decode_lines(spark.readStream.option("maxFilesPerTrigger", max_files).text(folder), schema)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _records(table) -> Iterator[tuple]:
    """Rows as plain values; text and truth values may be null, numbers not."""
    return zip(*[c.to_numpy(zero_copy_only=False).tolist() for c in table.columns], strict=True)


class _Ordered:
    """Rows wait in a buffer until the watermark has passed their time, then take effect in order of ``n``, or of their times and then ``n``.

    A row that the watermark has passed before it came is dropped by Spark (and counted in its metrics). In order of ``n``, one whose ``n`` is not above
    what has taken effect, because times run against ``n``, gets a null verdict, and a second row of the same ``n`` is a repeat and gets none; in
    order of time, a second row of the same time and ``n`` is. State ends with the ``finish`` row, or when a run was silent for ``ttl``, if there is one:
    rows after that start anew, and a timeout frees what is kept. So the result depends on the rows alone, not on the batches they came in.

    The state of a whole bucket of runs is kept as two Arrow tables, the rows that wait and a row per live run: a call for every run and a message
    for every row would take some hundred times as long as the rules.
    """

    fields: dict = {}       # of a row, beside run_id, n, at and ended
    memory: dict = {}       # of a run, beside run_id, last, last_at and lives
    empty: tuple = ()
    names: tuple = ()

    def __init__(self, limit: int, ttl: int | None, by_time: bool = False):
        self.limit, self.ttl, self.by_time = limit, ttl, by_time

    def row_schema(self) -> pa.Schema:
        return pa.schema({"run_id": pa.string(), "n": pa.int64(), "at": pa.int64(), "ended": pa.bool_(), **self.fields})

    def run_schema(self) -> pa.Schema:
        return pa.schema({"run_id": pa.string(), "last": pa.int64(), "last_at": pa.int64(), "lives": pa.int64(), **self.memory})

    def arrived(self, batches: Iterator[pd.DataFrame]) -> Iterator[pa.Table]:
        schema = self.row_schema()
        for batch in batches:
            told = (batch["n"] != NONE) & (batch["at"] != NONE)         # others only move the watermark
            yield pa.Table.from_pandas(batch if told.all() else batch[told], schema=schema, preserve_index=False, nthreads=1)

    def verdicts(self, ready: pa.Table, runs: dict) -> Iterator[pd.DataFrame]:
        """The verdicts on rows that take effect now; ``runs`` is brought up to date."""
        order = ["run_id", "at", "n"] if self.by_time else ["run_id", "n", "at"]
        new, none = (None, None, NEVER, self.empty), tuple(None for _ in self.names)
        for piece in ready.sort_by([(c, "ascending") for c in order]).combine_chunks().to_batches(max_chunksize=PIECE):
            out, of = [], False                                         # False: of no run, while None is one
            for run, n, at, ended, *values in _records(piece):
                if run != of:
                    if of is not False:
                        runs[of] = last, last_at, lives, state
                    of, (last, last_at, lives, state) = run, runs.get(run, new)
                if at > lives:
                    last, state = None, self.empty
                if last is not None and ((at, n) <= (last_at, last) if self.by_time else n <= last):
                    if n < last:
                        out.append((run, n, *none))
                    continue
                state, verdict = self.step(state, *values)
                out.append((run, n, *verdict))
                last, last_at, lives = n, at, NEVER if self.ttl is None else at + self.ttl
                if ended:
                    last, last_at, lives, state = new
            runs[of] = last, last_at, lives, state
            if out:
                yield pd.DataFrame(out, columns=["run_id", "n", *self.names], dtype=object)

    def take(self, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """One micro-batch of a bucket, or its timeout."""
        mark = state.getCurrentWatermarkMs() * 1000
        waiting, kept = state.get if state.exists else (None, None)
        rows = pa.concat_tables([*([] if waiting is None else [_unpacked(waiting)]), *self.arrived(batches)])
        now = pc.less_equal(rows["at"], mark)
        ready, rest = rows.filter(now), rows.filter(pc.invert(now))
        runs = {} if kept is None else {r: (last, last_at, lives, tuple(s)) for r, last, last_at, lives, *s in _records(_unpacked(kept))}
        if len(ready):
            yield from self.verdicts(ready, runs)
        live = [(r, last, last_at, lives, *s) for r, (last, last_at, lives, s) in runs.items() if last is not None and lives > mark]
        if not live and not len(rest):                                  # nothing is kept of runs that are over
            if state.exists:
                state.remove()
            return
        if live:
            schema = self.run_schema()
            kept = _packed(pa.table([pa.array(c, f.type) for c, f in zip(zip(*live, strict=True), schema, strict=True)], schema=schema))
        state.update((_packed(rest) if len(rest) else None, kept if live else None))
        due = min(pc.min(rest["at"]).as_py() if len(rest) else NEVER, min((r[3] for r in live), default=NEVER))
        if due < NEVER:
            state.setTimeoutTimestamp(_up(due) - 1)                     # it comes when the watermark is above


class StuckAlert(_Ordered):
    """Length of the current repetition, and steps since the screen was last seen to move."""

    fields = {"signature": pa.string(), "changed": pa.bool_()}
    memory = {"sig": pa.string(), "same": pa.int64(), "unmoved": pa.int64()}
    empty = (None, 0, 0)
    names = ("stuck",)

    def step(self, state, signature, changed):
        sig, same, unmoved = state
        same = same + 1 if signature == sig else 1
        unmoved = 0 if changed else unmoved + 1
        return (signature, same, unmoved), (same >= self.limit and unmoved >= self.limit,)


class FailureBudget(_Ordered):
    """Failures in a row; above the limit the run aborts."""

    fields = {"ok": pa.bool_()}
    memory = {"fails": pa.int64()}
    empty = (0,)
    names = ("fail_run", "aborts")

    def step(self, state, ok):
        fails = 0 if ok else state[0] + 1
        return (fails,), (fails, fails > self.limit)


class StallEscalation(_Ordered):
    """Every ``limit``-th retry verdict in a row becomes a re-plan."""

    fields = {"situation": pa.string()}
    memory = {"stalls": pa.int64()}
    empty = (0,)
    names = ("effective",)

    def step(self, state, situation):
        stalls = state[0] + 1 if situation == V.RETRY else 0
        up = stalls >= self.limit
        return (0 if up else stalls,), (V.REFORMULATE if up else situation,)


def _per_run(events: DataFrame, rules: _Ordered, columns, out: str, run: str, time: Column | None, delay: str) -> DataFrame:
    ended = F.coalesce(F.col("event") == "finish", F.lit(False)) if "event" in events.columns else F.lit(False)
    d = events.select(F.col(run).cast("string").alias("run_id"), F.coalesce(F.col("n").cast("long"), F.lit(NONE)).alias("n"), ended.alias("ended"), *columns,
                      (F.timestamp_seconds("t") if time is None else time).alias("event_time"))
    d = d.withColumn("at", F.coalesce(F.unix_micros("event_time"), F.lit(NONE))).withWatermark("event_time", delay)

    def take(key, batches, state):
        return rules.take(batches, state)

    return d.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(
        take, f"run_id string, n bigint, {out}", "waiting binary, runs binary", "append", GroupStateTimeout.EventTimeTimeout)


def stream_stuck(events: DataFrame, signature, limit: int = V.REPEAT_LIMIT, run: str = "run_id", time: Column | None = None,
                 delay: str = "1 minute", ttl: str | None = "1 day", by_time: bool = False) -> DataFrame:
    """Per step: is the run stuck? Same rule as the batch operator ``is_stuck``.

    ``time`` (default: the seconds in ``t``) is after 1970 and must not fall as ``n`` grows, unless ``by_time``: then rows take effect in order of (time, n).
    Rows may come ``delay`` late in any order, and a run that was silent for ``ttl`` is over (None: only its ``finish`` row ends it). Start it inside ``stateful``.
    """
    return _per_run(events, StuckAlert(limit, _micros(ttl), by_time), [signature.alias("signature"), F.col("changed")], "stuck boolean", run, time, delay)


def stream_failures(events: DataFrame, limit: int = V.RETRY_LIMIT, run: str = "run_id", time: Column | None = None,
                    delay: str = "1 minute", ttl: str | None = "1 day", by_time: bool = False) -> DataFrame:
    """Per step: failures in a row and whether the run is over the budget. Times as in ``stream_stuck``."""
    return _per_run(events, FailureBudget(limit, _micros(ttl), by_time), [F.col("ok")], "fail_run bigint, aborts boolean", run, time, delay)


def stream_stalls(events: DataFrame, limit: int = V.STALL_LIMIT, run: str = "run_id", time: Column | None = None,
                  delay: str = "1 minute", ttl: str | None = "1 day", by_time: bool = False) -> DataFrame:
    """Per verdict: what it counts as after escalation. Times as in ``stream_stuck``."""
    return _per_run(events, StallEscalation(limit, _micros(ttl), by_time), [F.col("situation")], "effective string", run, time, delay)


def _totals(events: DataFrame, run: str) -> DataFrame:
    ok, changed = F.coalesce(F.col("ok"), F.lit(True)), F.col("changed")
    return events.groupBy(F.col(run).cast("string").alias("run_id")).agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if(changed).alias("changed_steps"),
        F.count_if(changed == F.lit(False)).alias("unchanged_steps"), F.count_if(~ok).alias("errors"),
        F.sum("elapsed").alias("wall_time"))


COUNTS = ("n_steps", "changed_steps", "unchanged_steps", "errors")
SUMMARY = T.StructType([T.StructField("run_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("wall_time", T.DoubleType())])


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in SUMMARY.names[1:]])


def _writer(checkpoint: str) -> str:
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def write_run_summary(events: DataFrame, path: str, checkpoint: str, run: str = "run_id", available_now: bool = True) -> StreamingQuery:
    """Running totals per run. A batch adds one row for each run it has rows of, so its cost is that of its own rows, and nothing is kept in state.

    Batches are committed by number: one that is run again counts once. Every ``COMPACT_EVERY`` batches the rows of a run become one.
    """
    table = CommittedTable(events.sparkSession, path, SUMMARY)
    writer = _writer(checkpoint)

    def save(batch: DataFrame, number: int) -> None:
        table.append(_totals(batch, run).select(*SUMMARY.names, F.lit("all").alias("_slot")), f"{writer}-{number}")
        some = table.folders()
        if len(some) >= COMPACT_EVERY:
            table.replace(_merged(table.read()).select(*SUMMARY.names, F.lit("all").alias("_slot")), f"{writer}-{number}-merged", some)

    w = events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()


def read_run_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row per run, of what is committed now."""
    return _merged(CommittedTable(spark, path, SUMMARY).read())


def stream_stale_workers(beats: DataFrame, worker: str = "worker", ts: str = "beat") -> DataFrame:
    """Latest beat per worker, kept up to date; compare with the clock when it is read."""
    return beats.groupBy(worker).agg(F.max(ts).alias("last_beat"))


GONE = "worker string, last_beat timestamp, gone_at timestamp"


class _Silence(StatefulProcessor):
    """Remembers the last beat; a timer speaks up when none follows within ``timeout``, and the next beat arms it again."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def gone(self, key, last: int, at: int) -> tuple:
        return key[0], pd.Timestamp(last, unit="ms"), pd.Timestamp(at, unit="ms")

    def frame(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["worker", "last_beat", "gone_at"])

    def close(self) -> None:
        pass


class WallClockSilence(_Silence):
    """By the clock: a worker is gone when its last beat is older than ``timeout``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        beats = [int(b["at"].max()) for b in rows if key[0] is not None and (b["at"] != NONE).any()]
        before = self.memory.get()[0] if self.memory.exists() else None
        if beats and (before is None or max(beats) > before):
            if before is not None:
                self.handle.deleteTimer(before + self.timeout)
            self.memory.update((max(beats),))
            self.handle.registerTimer(max(beats) + self.timeout)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.memory.exists():
            last = self.memory.get()[0]
            self.memory.clear()
            yield self.frame([self.gone(key, last, timerValues.getCurrentProcessingTimeInMs())])


def _pauses(d: DataFrame, timeout: str, delay: str) -> DataFrame:
    """By the times of the beats themselves: beats without a pause longer than ``timeout`` are one session, told once the watermark has passed its end."""
    heard = F.when(F.col("worker").isNotNull(), F.col("event_time"))       # beats without a worker only move the watermark
    s = d.withWatermark("event_time", delay).groupBy("worker", F.session_window("event_time", f"{_micros(timeout)} microseconds"))
    s = s.agg(F.max(heard).alias("last_beat"))                              # sessions that just touch are one
    return s.filter("last_beat is not null").select("worker", "last_beat", (F.col("last_beat") + F.expr(f"interval {_micros(timeout)} microseconds")).alias("gone_at"))


def stream_silent_workers(beats: DataFrame, worker: str = "worker", ts: str = "beat", timeout: str = f"{V.HEARTBEAT_MAX_AGE} seconds",
                          clock: str = "processing", delay: str = "1 minute") -> DataFrame:
    """(worker, last_beat, gone_at): one row whenever a worker has not been heard for ``timeout``, without a new beat being needed.

    ``clock``: "processing" compares beats with the clock, for live use; "event" with the watermark of the beats (``delay`` behind the latest), for a log
    that is replayed. ``ts`` is a timestamp. A beat after that counts as a new start. Start it inside ``stateful``.
    """
    d = beats.select(F.col(worker).cast("string").alias("worker"), F.col(ts).alias("event_time"))
    if clock == "event":
        return _pauses(d, timeout, delay)
    return d.withColumn("at", F.coalesce(F.unix_millis("event_time"), F.lit(NONE))).groupBy("worker").transformWithStateInPandas(
        statefulProcessor=WallClockSilence(_millis(timeout)), outputStructType=T._parse_datatype_string(GONE), outputMode="Append", timeMode="ProcessingTime")


def write_events(stream: DataFrame, path: str, checkpoint: str, run: str = "run_id", n: str = "n",
                 *, time: str, delay: str = "1 hour", available_now: bool = True) -> StreamingQuery:
    """Append every event exactly once, however late it comes: each micro-batch adds the (run, n) that the table does not hold.

    The table is a ``CommittedTable`` in slots of ``delay``. A batch opens the slots from its first to its last ``time`` and one to each side
    (repeats of an event may differ by ``delay`` in ``time``), so its cost does not grow with the table. Rows without a time have
    slots of their own, by a hash of (run, n). A batch counts when its commit is there: what a crash before it left is not seen, and a
    batch that is run again after it does nothing. One query at a time may write to ``path``; ``read_events`` reads it.
    """
    table, writer, width = CommittedTable(stream.sparkSession, path, stream.schema), _writer(checkpoint), _millis(delay)
    at = F.floor(F.unix_millis(time) / F.lit(width)).cast("long")
    timeless = F.concat(F.lit("n"), F.pmod(F.xxhash64(run, n), F.lit(TIMELESS_SLOTS)).cast("string"))
    slot = F.coalesce(F.concat(F.lit("t"), at.cast("string")), timeless)

    def save(batch: DataFrame, number: int) -> None:
        name = f"{writer}-{number}"
        if table.has(name):
            return
        batch = batch.persist()
        try:
            spots = batch.select(slot.alias("s")).distinct().collect()       # as many as the batch spans times ``delay``
            near = {s["s"] for s in spots} | {f"t{int(s['s'][1:]) + k}" for s in spots if s["s"][0] == "t" for k in (-1, 1)}
            known = table.read(near).select(F.col(run).alias("known_run_"), F.col(n).alias("known_n_"))
            same = F.col(run).eqNullSafe(F.col("known_run_")) & F.col(n).eqNullSafe(F.col("known_n_"))
            table.append(batch.dropDuplicates([run, n]).join(known, same, "left_anti").withColumn("_slot", slot), name)
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """The committed events of ``write_events``."""
    return CommittedTable(spark, path, T._parse_datatype_string(schema) if isinstance(schema, str) else schema).read()


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a query over what is there now and read its result back."""
    spark = stream.sparkSession
    if mode == "append":
        with stateful(spark):
            q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
                 .outputMode("append").trigger(availableNow=True).start())
    else:
        def save(df: DataFrame, _epoch: int) -> None:
            df.write.mode("overwrite").parquet(path)
        q = (stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
             .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
