"""Sequence rules over the steps of a session: history, stuck, failures, stalls, progress, outcome."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.actions import describe_for_history, history_status
from ..functions.strings import is_blank
from ..session import pin
from .ordered import HOT_ROWS, SEG, OrderedRows


def with_history(steps: DataFrame, session="session_id", order="step_index", per_image: bool = False,
                 n: int = V.HISTORY_SHOWN, line: Column | None = None, status: Column | None = None,
                 thought: str | None = "thought", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``position`` and ``history``: the last ``n`` earlier steps, numbered from the session's start.

    Steps with a blank thought are left out first, so they neither get nor make history.
    """
    kept = steps.filter(~is_blank(thought)) if thought else steps
    keys = [session] if isinstance(session, str) else list(session)
    if per_image:
        keys = keys + ["image"]
    line = line if line is not None else describe_for_history("action")
    status = status if status is not None else history_status(F.lit(True), F.lit(True), F.lit(""))
    o = OrderedRows(kept, keys, order, hot_rows).position("position")
    o = o.map(lambda d: d.withColumn("_line", line).withColumn("_status", status))
    payload = F.struct(F.col("position").alias("n"), F.col("_line").alias("line"), F.col("_status").alias("status"))
    return o.previous("history", payload, n).df().drop("_line", "_status")


def _stuck(o: OrderedRows, signature: Column, changed: str, limit: int) -> OrderedRows:
    o = o.map(lambda d: d.withColumn("_sig", signature))
    o = o.previous("_prev", F.struct(F.col("_sig").alias("s"), F.col(changed).alias("c")), limit - 1)
    prev = F.col("_prev")
    same = F.forall(prev, lambda p: p["s"].eqNullSafe(F.col("_sig")))
    unknown = F.forall(prev, lambda p: p["c"].isNull()) & F.col(changed).isNull()
    moved = F.exists(prev, lambda p: F.coalesce(p["c"], F.lit(False))) | F.coalesce(F.col(changed), F.lit(False))
    stuck = (F.size(prev) == limit - 1) & same & (unknown | ~moved)
    return o.map(lambda d: d.withColumn("stuck", stuck).drop("_prev", "_sig"))


def is_stuck(steps: DataFrame, run, order, signature: Column, changed: str = "changed",
             limit: int = V.REPEAT_LIMIT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``stuck``: the last ``limit`` steps have one signature and none changed the screen.

    If nothing is known about changes, the repeated action alone decides.
    """
    return _stuck(OrderedRows(steps, run, order, hot_rows), signature, changed, limit).df()


def _failures(o: OrderedRows, ok: Column, limit: int) -> OrderedRows:
    """``o`` has its positions in ``_pos``."""
    o = o.map(lambda d: d.withColumn("_ok", ok))
    o = o.running({"_last_ok": ("max", F.when(F.col("_ok"), F.col("_pos")))})
    n = F.col("_pos") - F.coalesce("_last_ok", F.lit(0))
    return o.map(lambda d: d.withColumn("fail_run", n).withColumn("aborts", n > limit)
                 .withColumn("retried", (n > 0) & (n <= limit)).drop("_ok", "_last_ok"))


def failure_runs(steps: DataFrame, run, order, ok: Column, limit: int = V.RETRY_LIMIT,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``fail_run`` (failures in a row, 0 after a success), ``aborts`` and ``retried``."""
    return _failures(OrderedRows(steps, run, order, hot_rows).position("_pos"), ok, limit).df().drop("_pos")


def escalate_stalls(verdicts: DataFrame, run, order, situation: str = "situation",
                    limit: int = V.STALL_LIMIT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``effective``: every ``limit``-th retry verdict in a row becomes a re-plan."""
    is_retry = F.col(situation) == V.RETRY
    o = OrderedRows(verdicts, run, order, hot_rows).position("_pos")
    o = o.running({"_other": ("max", F.when(~F.coalesce(is_retry, F.lit(False)), F.col("_pos")))})
    n = F.col("_pos") - F.coalesce("_other", F.lit(0))
    up = is_retry & (n > 0) & (n % limit == 0)
    return (o.df().withColumn("effective", F.when(up, F.lit(V.REFORMULATE)).otherwise(F.col(situation)))
            .drop("_pos", "_other"))


def subtask_progress(verdicts: DataFrame, run, order, situation: str = "effective",
                     max_replans: int = V.MAX_REPLANS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``subtask_index`` after each verdict: successes since the last re-plan that counted."""
    win, replan = F.col(situation) == V.SUCCESS, F.col(situation) == V.REFORMULATE
    o = OrderedRows(verdicts, run, order, hot_rows).running({
        "_wins": ("sum", F.coalesce(win, F.lit(False)).cast("int")),
        "_plans": ("sum", F.coalesce(replan, F.lit(False)).cast("int"))})
    o = o.running({"_base": ("max", F.when(replan & (F.col("_plans") <= max_replans), F.col("_wins")))})
    return (o.df().withColumn("subtask_index", (F.col("_wins") - F.coalesce("_base", F.lit(0))).cast("long"))
            .withColumn("replans", F.least("_plans", F.lit(max_replans)).cast("long"))
            .drop("_wins", "_plans", "_base"))


def mean_abs_diff(a, b) -> Column:
    """Mean absolute difference of two equally long number arrays."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.try_divide(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x), F.size(d))


def frame_changed(frames: DataFrame, session, order, vec: str = "vec", threshold: float = V.DIFF_THRESHOLD,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``changed`` against the frame before; without one to compare it counts as changed."""
    o = OrderedRows(frames, session, order, hot_rows).previous("_prev", F.col(vec), 1)
    diff = mean_abs_diff(F.try_element_at("_prev", F.lit(1)), F.col(vec))
    return o.df().withColumn("changed", F.coalesce(diff >= threshold, F.lit(True))).drop("_prev")


def anchor_reuse(frames: DataFrame, session: str, order: str, vec: str = "vec",
                 threshold: float = V.DIFF_THRESHOLD, piece_rows: int = 50_000) -> DataFrame:
    """Add ``anchor`` (order value of the frame whose result is used) and ``reused``.

    A frame is compared with the last *recomputed* frame, so the rule is a fold over the
    session. Long sessions are cut into pieces that fold side by side; a piece starts from
    the anchor its predecessor ended with, and pieces are folded again until those starting
    anchors no longer change (two recomputations at one frame make both folds agree).
    """
    cut = OrderedRows(frames.select(session, order, vec), session, order, piece_rows)
    fields = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    out_schema = f"{session} {fields[session]}, {order} {fields[order]}, anchor {fields[order]}"
    kept = [session, order, "anchor"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        anchor_vec, anchor_id = pdf["_start_vec"].iloc[0], pdf["_start"].iloc[0]
        anchor_vec = None if anchor_vec is None else np.asarray(anchor_vec, dtype="float64")
        ids = []
        for key, v in zip(pdf[order], pdf[vec]):
            v = None if v is None else np.asarray(v, dtype="float64")
            if anchor_vec is None or v is None or np.abs(anchor_vec - v).mean() >= threshold:
                anchor_vec, anchor_id = v, key
            ids.append(anchor_id)
        return pdf.assign(anchor=ids)[[c for c in (*kept, SEG) if c in pdf or c == "anchor"]]

    def run(rows: DataFrame, keys) -> DataFrame:
        return rows.groupBy(*keys).applyInPandas(fold, out_schema + (f", {SEG} int" if SEG in keys else ""))

    results = []
    for d, hot in cut._parts:
        empty = d.withColumn("_start", F.lit(None).cast(fields[order])).withColumn(
            "_start_vec", F.lit(None).cast(d.schema[vec].dataType))
        if not hot:
            results.append(run(empty, [session]))
            continue
        starts, rows = None, empty
        while True:
            folded = pin(run(rows, [session, SEG]))
            ends = folded.groupBy(session, SEG).agg(F.max_by("anchor", order).alias("_end"))
            nxt = ends.select(session, SEG, F.lag("_end").over(W.partitionBy(session).orderBy(SEG)).alias("_start"))
            nxt = pin(nxt.filter("_start is not null").select(F.col(session).alias("_s"), F.col(SEG).alias("_g"), "_start"))
            # one row per piece; only whether any start has moved comes to the driver
            if starts is not None and nxt.exceptAll(starts).isEmpty():
                break
            starts = nxt
            begin = nxt.join(d.select(F.col(session).alias("_s2"), F.col(order).alias("_o"), F.col(vec).alias("_start_vec")),
                             F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_start") == F.col("_o")))
            rows = d.join(begin.select("_s", "_g", "_start", "_start_vec"),
                          d[session].eqNullSafe(F.col("_s")) & (d[SEG] == F.col("_g")), "left").drop("_s", "_g")
        results.append(folded.drop(SEG))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.withColumn("reused", F.col("anchor") != F.col(order))


def moving_mean(log: DataFrame, by, order, value: str = "loss", k: int = 10, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``smoothed``: mean of the last ``k`` values including the own one."""
    o = OrderedRows(log, by, order, hot_rows).previous("_prev", F.col(value), k - 1)
    total = F.aggregate("_prev", F.col(value).cast("double"), lambda acc, x: acc + x)
    return o.df().withColumn("smoothed", total / (F.size("_prev") + 1)).drop("_prev")


def running_best(log: DataFrame, by, order, value: str = "val_loss", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``best_before`` and ``is_best``: strictly below everything earlier."""
    o = OrderedRows(log, by, order, hot_rows).running({"best_before": ("min", F.col(value))}, before=True)
    return o.df().withColumn("is_best", F.coalesce(F.col(value) < F.col("best_before"), F.col(value).isNotNull()))


def run_outcome(steps: DataFrame, run: str, order, signature: Column, max_steps: int = V.MAX_STEPS,
                retry_limit: int = V.RETRY_LIMIT, repeat_limit: int = V.REPEAT_LIMIT,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """First thing that ends each run, the step it happened at, and success (null: still open).

    Needs type, ok and changed. A failed step can only abort; an ok step can finish, ask for
    help or be stuck; the step limit is looked at last.
    """
    # one cut of the rows, so one look at the sizes, serves the three rules
    o = _stuck(OrderedRows(steps, run, order, hot_rows), signature, "changed", repeat_limit)
    d = _failures(o.position("_pos"), F.col("ok"), retry_limit).df().withColumnRenamed("_pos", "_place")
    ok = F.col("ok")
    why = (F.when(ok & (F.col("type") == "finished"), "finished").when(ok & (F.col("type") == "call_user"), "call_user")
           .when(~ok & F.col("aborts"), "abort").when(ok & F.col("stuck"), "stuck")
           .when(F.col("_place") >= max_steps, "step_limit"))
    first = F.min(F.when(why.isNotNull(), F.struct(F.col("_place").alias("n"), why.alias("why"))))
    out = d.groupBy(run).agg(first.alias("e"), F.count(F.lit(1)).alias("logged_steps"))
    return out.select(run, F.col("e.n").alias("end_step"), F.col("e.why").alias("outcome"),
                      F.when(F.col("e.why").isNotNull(), F.col("e.why") == "finished").alias("success"), "logged_steps")
