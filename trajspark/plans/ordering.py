"""Driver-table queries for ordered rules, ranks, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import box
from ..operators import selection as S
from ..operators import sessions as W
from ..operators import splits as U
from . import tables as D
from .registry import query, with_


def r(c, name=None):
    return F.round(c, 6).alias(name or c)


# --- history ----------------------------------------------------------------------

def history_sql(part: str) -> str:
    return with_(D.TURNS_SQL) + f""", kept AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY step_index) AS position FROM turns WHERE thought <> '')
SELECT session_id, step_index, position, coalesce((SELECT string_agg('  第' || b.position || '步 ' || b.line || ' → 成功', chr(10) ORDER BY b.position)
   FROM kept b WHERE {' AND '.join(f'b.{k.strip()} = a.{k.strip()}' for k in part.split(','))} AND b.position BETWEEN a.position - 5 AND a.position - 1), '  （这是第一步）') AS history FROM kept a"""


def _history(s, sf, per_image):
    from ..functions.actions import render_history
    h = W.with_history(D.turns(s, sf), "session_id", "step_index", per_image=per_image)
    return h.select("session_id", "step_index", "position", render_history("history").alias("history"))


@query("with_history_w1", history_sql("session_id"))
def _(s, sf):
    return _history(s, sf, False)


@query("with_history_per_image_w1", history_sql("session_id, image"))
def _(s, sf):
    return _history(s, sf, True)


# --- sequence rules over events ---------------------------------------------------

STUCK_SQL = D.STEPS_SQL + """,
tail AS (SELECT *, list(type) OVER w AS sigs, list(coalesce(CAST(changed AS INT), 2)) OVER w AS marks FROM steps
  WINDOW w AS (PARTITION BY run ORDER BY ts, n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
stuck AS (SELECT * EXCLUDE (sigs, marks), len(sigs) = 3 AND len(list_distinct(sigs)) = 1 AND
  (list_min(marks) = 2 OR NOT list_contains(marks, 1)) AS stuck FROM tail)"""


@query("is_stuck_w2", with_(STUCK_SQL) + "SELECT run, n, stuck FROM stuck")
def _(s, sf):
    return W.is_stuck(D.steps(s, sf), "run", ["ts", "n"], F.col("type")).select("run", "n", "stuck")


FAIL_SQL = D.STEPS_SQL + """,
isl AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY run ORDER BY ts, n) AS g FROM steps),
fails AS (SELECT *, CASE WHEN ok THEN 0 ELSE count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY run, g ORDER BY ts, n) END AS fail_run FROM isl)"""


@query("failure_runs_w3", with_(FAIL_SQL) + "SELECT run, n, fail_run, fail_run > 2 AS aborts, fail_run BETWEEN 1 AND 2 AS retried FROM fails")
def _(s, sf):
    return W.failure_runs(D.steps(s, sf), "run", ["ts", "n"], F.col("ok")).select("run", "n", "fail_run", "aborts", "retried")


VERDICT_SQL = D.STEPS_SQL + """,
v AS (SELECT run, ts, n, CASE WHEN k % 10 < 6 THEN 'need_retry' WHEN k % 10 < 9 THEN 'sub_task_success' ELSE 'need_reformulate' END AS situation FROM steps),
vi AS (SELECT *, sum(CAST(situation <> 'need_retry' AS INT)) OVER (PARTITION BY run ORDER BY ts, n) AS g FROM v),
vr AS (SELECT *, CASE WHEN situation = 'need_retry' THEN count(*) FILTER (WHERE situation = 'need_retry') OVER (PARTITION BY run, g ORDER BY ts, n) ELSE 0 END AS c FROM vi),
eff AS (SELECT run, ts, n, situation, CASE WHEN c > 0 AND c % 3 = 0 THEN 'need_reformulate' ELSE situation END AS effective FROM vr)"""


def verdicts(s, sf):
    k = F.col("k") % 10
    return D.steps(s, sf).select("run", "ts", "n", F.when(k < 6, "need_retry").when(k < 9, "sub_task_success")
                                 .otherwise("need_reformulate").alias("situation"))


@query("escalate_stalls_w4", with_(VERDICT_SQL) + "SELECT run, n, effective FROM eff")
def _(s, sf):
    return W.escalate_stalls(verdicts(s, sf), "run", ["ts", "n"]).select("run", "n", "effective")


@query("subtask_progress_w5", with_(VERDICT_SQL) + """, c AS (SELECT *, sum(CAST(effective = 'sub_task_success' AS INT)) OVER w AS wins,
  sum(CAST(effective = 'need_reformulate' AS INT)) OVER w AS plans FROM eff WINDOW w AS (PARTITION BY run ORDER BY ts, n)),
b AS (SELECT *, max(CASE WHEN effective = 'need_reformulate' AND plans <= 2 THEN wins END) OVER (PARTITION BY run ORDER BY ts, n) AS base FROM c)
SELECT run, n, CAST(wins - coalesce(base, 0) AS BIGINT) AS subtask_index, CAST(least(plans, 2) AS BIGINT) AS replans FROM b""")
def _(s, sf):
    v = W.escalate_stalls(verdicts(s, sf), "run", ["ts", "n"])
    return W.subtask_progress(v, "run", ["ts", "n"]).select("run", "n", "subtask_index", "replans")


@query("run_outcome_w11", with_(STUCK_SQL) + """, isl AS (SELECT *, CASE WHEN n % 97 = 0 THEN 'finished' WHEN n % 89 = 0 THEN 'call_user' ELSE type END AS kind,
   sum(CAST(ok AS INT)) OVER (PARTITION BY run ORDER BY ts, n) AS g, row_number() OVER (PARTITION BY run ORDER BY ts, n) AS pos FROM stuck),
fr AS (SELECT *, CASE WHEN ok THEN 0 ELSE count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY run, g ORDER BY ts, n) END AS fail_run FROM isl),
why AS (SELECT *, CASE WHEN ok AND kind = 'finished' THEN 'finished' WHEN ok AND kind = 'call_user' THEN 'call_user'
   WHEN NOT ok AND fail_run > 2 THEN 'abort' WHEN ok AND stuck THEN 'stuck' WHEN pos >= 40 THEN 'step_limit' END AS w FROM fr)
SELECT run, min(pos) FILTER (WHERE w IS NOT NULL) AS end_step, arg_min(w, pos) FILTER (WHERE w IS NOT NULL) AS outcome,
  arg_min(w, pos) FILTER (WHERE w IS NOT NULL) = 'finished' AS success, count(*) AS logged_steps FROM why GROUP BY run""")
def _(s, sf):
    st = D.steps(s, sf).withColumn("_sig", F.col("type"))
    st = st.withColumn("sig", F.col("_sig")).drop("_sig").withColumn(
        "type", F.when(F.col("n") % 97 == 0, "finished").when(F.col("n") % 89 == 0, "call_user").otherwise(F.col("type")))
    return W.run_outcome(st, "run", ["ts", "n"], F.col("sig"), max_steps=40)


# --- frames and logs --------------------------------------------------------------

def frames(s, sf):
    return D.table(s, sf, "embeddings").select(F.col("label").alias("session"), F.col("vec_id").alias("frame"), F.col("embedding").alias("vec"))


@query("frame_changed_w6", """WITH p AS (SELECT label, vec_id, embedding AS v, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM embeddings)
SELECT label AS session, vec_id AS frame, coalesce(list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(CAST(v[i] AS DOUBLE) - CAST(u[i] AS DOUBLE)))) / len(v) >= 0.14, true) AS changed FROM p""")
def _(s, sf):
    return W.frame_changed(frames(s, sf), "session", "frame", threshold=0.14).select("session", "frame", "changed")


@query("anchor_reuse_w7", """WITH RECURSIVE f AS (SELECT label, vec_id, embedding AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
w AS (SELECT label, i, vec_id, vec_id AS anchor, v AS a FROM f WHERE i = 1
  UNION ALL SELECT f.label, f.i, f.vec_id,
    CASE WHEN list_sum(list_transform(range(1, len(f.v) + 1), lambda j: abs(CAST(f.v[j] AS DOUBLE) - CAST(w.a[j] AS DOUBLE)))) / len(f.v) >= 0.14 THEN f.vec_id ELSE w.anchor END,
    CASE WHEN list_sum(list_transform(range(1, len(f.v) + 1), lambda j: abs(CAST(f.v[j] AS DOUBLE) - CAST(w.a[j] AS DOUBLE)))) / len(f.v) >= 0.14 THEN f.v ELSE w.a END
  FROM w JOIN f ON f.label = w.label AND f.i = w.i + 1)
SELECT label AS session, vec_id AS frame, anchor, anchor <> vec_id AS reused FROM w""")
def _(s, sf):
    return W.anchor_reuse(frames(s, sf), "session", "frame", threshold=0.14)


@query("moving_mean_w8", """SELECT user_id AS run, event_id AS step, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM events""")
def _(s, sf):
    log = D.table(s, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "ts", F.col("value").alias("loss"))
    return W.moving_mean(log, "run", ["ts", "step"]).select("run", "step", r("smoothed"))


@query("running_best_w10", """SELECT run, step, best_before, coalesce(value < best_before, true) AS is_best FROM (SELECT user_id AS run, event_id AS step, value,
 min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events)""")
def _(s, sf):
    log = D.table(s, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "ts", F.col("value").alias("val_loss"))
    return W.running_best(log, "run", ["ts", "step"]).select("run", "step", "best_before", "is_best")


# --- samples ----------------------------------------------------------------------

@query("spread_sample_t2", """WITH rk AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM rk WHERE r IN (SELECT CAST(floor(i * (n::DOUBLE / 40)) AS BIGINT) FROM range(40) t(i), (SELECT count(*) AS n FROM orders))""")
def _(s, sf):
    return S.spread_sample(D.table(s, sf, "orders").select("o_orderkey", "o_orderdate"), 40, ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("grid_sample_t3", with_(D.boxes_sql()) + """, c AS (SELECT *, least(2, CAST(floor((x1 + x2) / 2 * 3) AS INT)) AS gx, least(2, CAST(floor((y1 + y2) / 2 * 3) AS INT)) AS gy FROM boxes),
rk AS (SELECT *, row_number() OVER (PARTITION BY screen_id, gx, gy ORDER BY box_id) AS rn FROM c)
SELECT screen_id, box_id FROM (SELECT *, row_number() OVER (PARTITION BY screen_id ORDER BY rn, gx, gy) AS p FROM rk) WHERE p <= 12""")
def _(s, sf):
    return S.grid_sample(D.boxes(s, sf), 12, "bbox", "box_id", by=("screen_id",)).select("screen_id", "box_id")


@query("grid_sample_global_t3", with_(D.boxes_sql()) + """, c AS (SELECT *, least(2, CAST(floor((x1 + x2) / 2 * 3) AS INT)) AS gx, least(2, CAST(floor((y1 + y2) / 2 * 3) AS INT)) AS gy FROM boxes),
rk AS (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY box_id) AS rn FROM c)
SELECT box_id FROM rk ORDER BY rn, gx, gy LIMIT 25""")
def _(s, sf):
    return S.grid_sample(D.boxes(s, sf), 25, "bbox", "box_id").select("box_id")


@query("seeded_order_t4", "SELECT doc_id, md5('42:' || doc_id) AS shuffle_key FROM documents")
def _(s, sf):
    return S.seeded_order(D.table(s, sf, "documents").select("doc_id"), "doc_id", 42)


@query("seeded_sample_t10", "SELECT doc_id, n_chars FROM documents ORDER BY md5('7:' || doc_id) LIMIT 150")
def _(s, sf):
    return S.seeded_sample(D.table(s, sf, "documents").select("doc_id", "n_chars"), "doc_id", 150, 7)


@query("length_batches_t5", """SELECT doc_id, batch_rank, (batch_rank - 1) // 16 AS batch, md5('42:' || ((batch_rank - 1) // 16)) AS batch_order
 FROM (SELECT doc_id, row_number() OVER (ORDER BY length(lang) + length(text), doc_id) AS batch_rank FROM documents)""")
def _(s, sf):
    d = D.table(s, sf, "documents").select("doc_id", (F.length("lang") + F.length("text")).alias("len"))
    return S.length_batches(d, 16, 42, F.col("len"), "doc_id").select("doc_id", "batch_rank", "batch", "batch_order")


QUOTA_SQL = D.ELEMENTS_SQL + """,
k AS (SELECT *, trim(text) <> '' AS named FROM elements WHERE trim(text) <> '' OR source = 'cv'),
c AS (SELECT *, row_number() OVER (PARTITION BY screen_id, named ORDER BY id) AS rn, count(*) FILTER (WHERE named) OVER (PARTITION BY screen_id) AS a,
        count(*) FILTER (WHERE NOT named) OVER (PARTITION BY screen_id) AS b FROM k),
q AS (SELECT *, least(least(greatest(2, 4 - a), 4), b) AS keep FROM c),
shown AS (SELECT screen_id, id, CAST(CASE WHEN named THEN rn ELSE least(a, 4 - keep) + rn END AS INT) AS shown, x1, y1, x2, y2
   FROM q WHERE CASE WHEN named THEN rn <= least(a, 4 - keep) ELSE rn <= keep END)"""


@query("select_with_quota_t6", with_(QUOTA_SQL) + "SELECT screen_id, id, shown FROM shown")
def _(s, sf):
    return S.select_with_quota(D.elements(s, sf), limit=4, reserved=3).select("screen_id", "id", "shown")


@query("two_stage_topk_t7", """WITH b AS (SELECT p_type, p_partkey, p_size / 1000.0 AS w, (p_partkey % 37 + 1) / 1000.0 AS h FROM part),
t AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY CAST(w AS DOUBLE) * CAST(h AS DOUBLE) DESC, p_partkey) AS rn FROM b)
SELECT p_type, p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY abs(greatest(CAST(w AS DOUBLE), CAST(h AS DOUBLE)) - 0.025), rn) - 1 AS INT) AS id FROM t WHERE rn <= 80""")
def _(s, sf):
    d = D.table(s, sf, "part").withColumn("bbox", box(F.lit(0.0), F.lit(0.0), F.col("p_size") / 1000.0, (F.col("p_partkey") % 37 + 1) / 1000.0))
    return S.two_stage_topk(d, "bbox", "p_partkey", by=("p_type",)).select("p_type", "p_partkey", "id")


# --- splits -----------------------------------------------------------------------

GROUP_SPLIT = """ids AS (SELECT conv_id, row_number() OVER (ORDER BY md5('42:' || conv_id)) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)),
m AS (SELECT conv_id, CASE WHEN rk <= greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM ids)"""


@query("split_by_group_u3", with_(GROUP_SPLIT) + "SELECT conv_id, turn, split FROM conversations JOIN m USING (conv_id)")
def _(s, sf):
    return U.split_by_group(D.table(s, sf, "conversations"), "conv_id").select("conv_id", "turn", "split")


@query("apply_split_j1", with_(GROUP_SPLIT) + "SELECT conv_id, role, count(*) AS n, split FROM conversations JOIN m USING (conv_id) GROUP BY ALL")
def _(s, sf):
    c = D.table(s, sf, "conversations")
    m = U.split_map(U.split_by_group(c.select("conv_id"), "conv_id"), "conv_id")
    plans = c.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    return U.apply_split(plans, m, "conv_id").select("conv_id", "role", "n", "split")


@query("assert_disjoint_j2", with_(GROUP_SPLIT) + "SELECT split, count(DISTINCT conv_id) AS sessions FROM conversations JOIN m USING (conv_id) GROUP BY split")
def _(s, sf):
    d = U.split_by_group(D.table(s, sf, "conversations").select("conv_id"), "conv_id")
    U.assert_disjoint(d.filter("split = 'train'"), d.filter("split = 'val'"), "conv_id")
    return d.groupBy("split").agg(F.count_distinct("conv_id").alias("sessions"))


def rows_sql(n: str) -> str:
    return f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id)) <= {n} THEN 'val' ELSE 'train' END AS split FROM documents"""


@query("split_rows_u4", rows_sql("CAST(floor((SELECT count(*) FROM documents) * 0.15) AS BIGINT)"))
def _(s, sf):
    return U.split_rows(D.table(s, sf, "documents").select("doc_id"), "doc_id", ratio=0.15)


@query("split_rows_tenth_u4", rows_sql("greatest(1, (SELECT count(*) FROM documents) // 10)"))
def _(s, sf):
    return U.split_rows(D.table(s, sf, "documents").select("doc_id"), "doc_id", at_least_one=True)


@query("respect_holdout_u5", """SELECT part, count(*) AS n FROM (SELECT CASE WHEN doc_id % 6 = 0 THEN 'held_out' ELSE 'pool' END AS part FROM documents) GROUP BY part""")
def _(s, sf):
    d = D.table(s, sf, "documents").select("doc_id").withColumn("split", F.when(F.col("doc_id") % 6 == 0, "test").otherwise("train"))
    pool, held = U.respect_holdout(d)
    return pool.withColumn("part", F.lit("pool")).unionByName(held.withColumn("part", F.lit("held_out"))).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"))


BALANCE = """skewed AS (SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 4 <> 0 OR event_type = 'signup' AND event_id % 50 <> 0 THEN 'rest' ELSE event_type END AS event_type FROM events),
have AS (SELECT event_type AS c, count(*) AS h FROM skewed GROUP BY 1),
ref AS (SELECT CASE WHEN event_type = 'signup' AND event_id % 10 <> 0 THEN 'rest' ELSE event_type END AS c, count(*) AS r FROM events GROUP BY 1),
k AS (SELECT min(h / (r::DOUBLE / (SELECT sum(r) FROM ref))) AS k FROM have JOIN ref USING (c) WHERE r::DOUBLE / (SELECT sum(r) FROM ref) >= 0.1),
quota AS (SELECT c, h, CAST(least(h, round_even((SELECT k FROM k) * (coalesce(r, 0)::DOUBLE / (SELECT sum(r) FROM ref)), 0)) AS BIGINT) AS q FROM have LEFT JOIN ref USING (c))"""


def balance_inputs(s, sf):
    e = D.table(s, sf, "events").select("event_id", "event_type")
    t, i = F.col("event_type"), F.col("event_id")
    # all rows take part; a class of its own takes up what makes the others scarce
    have = e.withColumn("event_type", F.when(((t == "click") & (i % 4 != 0)) | ((t == "signup") & (i % 50 != 0)), "rest").otherwise(t))
    return have, e.withColumn("event_type", F.when((t == "signup") & (i % 10 != 0), "rest").otherwise(t))


@query("balance_quotas_u6", with_(BALANCE) + "SELECT c AS event_type, h AS have, q AS quota FROM quota")
def _(s, sf):
    have, ref = balance_inputs(s, sf)
    return U.balance_quotas(have.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
                            ref.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "event_type")


@query("balance_to_reference_u6", with_(BALANCE) + """, rk AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id)) AS rn
  FROM skewed)
SELECT event_id, event_type FROM rk JOIN quota ON c = event_type WHERE rn <= q""")
def _(s, sf):
    have, ref = balance_inputs(s, sf)
    return U.balance_to_reference(have, ref, "event_type", "event_id").select("event_id", "event_type")


@query("dedupe_samples_u2", with_(D.SAMPLES_SQL) + """SELECT ord, split FROM (SELECT ord, split, row_number() OVER (PARTITION BY split, prompt, response ORDER BY ord) AS rn FROM samples) WHERE rn = 1""")
def _(s, sf):
    return U.dedupe_samples(D.samples(s, sf), within=("split",)).select("ord", "split")


@query("overlap_u7", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(s, sf):
    return U.overlap(D.table(s, sf, "documents"), D.table(s, sf, "labels"), "doc_id")


@query("difference_u7", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(s, sf):
    return U.difference(D.table(s, sf, "documents"), D.table(s, sf, "labels"), "doc_id")


@query("union_samples_u1", """SELECT part, kind, count(*) AS n, count(turn) AS with_turn FROM (
  SELECT 0 AS part, 'action' AS kind, NULL AS turn FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 1, 'plan', turn FROM conversations) GROUP BY ALL""")
def _(s, sf):
    a = D.samples(s, sf).filter("kind = 'action'").select("kind", "ord", "prompt")
    p = D.table(s, sf, "conversations").select(F.lit("plan").alias("kind"), F.col("text").alias("prompt"), "turn")
    return U.union_samples(a, p).groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("turn").alias("with_turn"))


@query("array_distinct_u8", "SELECT doc_id, list_aggregate(list_transform(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: x), 'string_agg', ' ') AS words FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE n_chars >= 0)")
def _(s, sf):
    return D.table(s, sf, "documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


