"""Trajectory tables derived from the driver tables, in Spark and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.actions import action
from ..functions.geometry import box, point
from ..operators.matching import build_cases
from ..operators.ordered import OrderedRows
from ..operators.runs import facts_from_steps


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def number_in(props="props"):
    return F.get_json_object(props, "$.k").cast("int")


def micros(ts: str):
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


# --- events: one user is one run, one event one step ------------------------------

TYPE_OF = {"click": "click", "view": "scroll", "signup": "type", "purchase": "hotkey", "error": "wait"}


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """run, n, type, action, ok, changed, elapsed, error, k."""
    return steps_of(table(spark, sf, "events"))


def steps_of(events: DataFrame) -> DataFrame:
    e = events.withColumn("k", number_in())
    kind = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in TYPE_OF.items()])
    e = e.withColumn("type", kind)
    x = F.expr("cast(round(value * 100) as bigint) div 100") / 1000.0
    keyboard = F.col("type").isin("type", "hotkey")
    text = F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(
        F.when(F.col("k") % 2 == 0, " T").otherwise("t"), (F.col("k") % 3).cast("string"), F.lit(" ")))
    act = action(F.col("type"), F.when(F.col("type").isin("click", "scroll"), point(x, F.lit(0.5))),
                 None, F.when(keyboard, text),
                 F.when(F.col("type") == "scroll", F.when(F.col("k") % 2 == 0, "up").otherwise("down")))
    changed = F.when(F.col("k") % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.col("k") % 3 == 2)
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("n"), "ts", "type", act.alias("action"),
                    (F.col("event_type") != "error").alias("ok"), changed.alias("changed"),
                    F.col("value").alias("elapsed"), F.concat(F.lit("e"), F.col("k").cast("string")).alias("error"), "k")


STEPS_SQL = """steps AS (
  SELECT user_id AS run, event_id AS n, ts, type, k, event_type <> 'error' AS ok, value AS elapsed,
         'e' || k AS error,
         CASE WHEN k % 3 = 0 THEN NULL ELSE k % 3 = 2 END AS changed,
         CASE WHEN type IN ('click','scroll') THEN CAST(CAST(round(value * 100) AS BIGINT) // 100 AS DOUBLE) / 1000 END AS x,
         CASE WHEN type IN ('type','hotkey') THEN CASE WHEN k % 4 = 0 THEN '' ELSE
           (CASE WHEN k % 2 = 0 THEN ' T' ELSE 't' END) || CAST(k % 3 AS VARCHAR) || ' ' END END AS text,
         CASE WHEN type = 'scroll' THEN CASE WHEN k % 2 = 0 THEN 'up' ELSE 'down' END END AS direction
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
          CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'scroll' WHEN 'signup' THEN 'type'
               WHEN 'purchase' THEN 'hotkey' ELSE 'wait' END AS type FROM events))"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Truth is a step's action, the prediction is the action before it in the same run."""
    st = steps(spark, sf)
    before = OrderedRows(st.select("run", "ts", "n", "action"), "run", ["ts", "n"]).previous("_p", F.col("action"), 1).df()
    preds = before.filter(F.size("_p") > 0).select(F.col("n").alias("i"), F.try_element_at("_p", F.lit(1)).alias("pred_action"))
    truth = st.select(F.col("n").alias("i"), "run", "elapsed", "action",
                      F.concat(F.lit("cfg"), (F.col("k") % 5).cast("string")).alias("config"),
                      F.concat(F.lit("app"), (F.col("k") % 7).cast("string")).alias("app"))
    return build_cases(truth, preds, keep=("run", "elapsed", "config", "app")).drop("dist_raw")


CASES_SQL = STEPS_SQL + """,
cases AS (
  SELECT i, run, elapsed, config, app, gt, coalesce(p, '解析失败') AS pred,
         CASE WHEN gt IN ('click','scroll') AND p IN ('click','scroll') THEN round(abs(x - px), 3) END AS dist,
         gt_text, CASE WHEN p IS NOT NULL THEN ptext END AS pred_text
  FROM (SELECT n AS i, run, elapsed, 'cfg' || (k % 5) AS config, 'app' || (k % 7) AS app, type AS gt, x, text AS gt_text,
          lag(type) OVER w AS p, lag(x) OVER w AS px, lag(text) OVER w AS ptext
        FROM steps WINDOW w AS (PARTITION BY run ORDER BY ts, n))),
flags AS (
  SELECT *, gt = pred AS type_ok,
         (gt = pred) AND (gt NOT IN ('type','hotkey') OR coalesce(trim(gt_text), '') = ''
            OR lower(trim(coalesce(pred_text, ''))) = lower(trim(gt_text))) AS op_ok,
         dist IS NULL OR dist <= 0.10 AS near10, dist IS NULL OR dist <= 0.14 AS near14 FROM cases)"""


# --- orders and lineitem: one order is one run, one line one step -----------------

def runs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    level = (F.when(F.col("o_orderpriority") == "1-URGENT", "T1").when(F.col("o_orderpriority") == "2-HIGH", "T2")
             .when(F.col("o_orderpriority") == "3-MEDIUM", "T3"))
    return o.select(F.col("o_orderkey").alias("run"), F.concat(F.lit("task"), (F.col("o_custkey") % 40).cast("string"))
                    .alias("task"), level.alias("level"),
                    F.concat(F.lit("cfg"), (F.col("o_orderkey") % 3).cast("string")).alias("config"),
                    (F.col("o_orderstatus") == "F").alias("passed"), (F.col("o_orderkey") % 3).alias("retries"))


def run_steps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run"), (F.col("l_returnflag") != "R").alias("ok"),
        F.col("l_quantity").alias("elapsed"),
        F.expr("l_linenumber * 100000000000L + l_partkey * 100000 + l_suppkey").alias("ord"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts_from_steps(runs(spark, sf), run_steps(spark, sf), "run")


FACTS_SQL = """facts AS (
  SELECT run, task, level, config, passed, retries, coalesce(n_steps, 0) AS n_steps,
         coalesce(error_steps, 0) AS error_steps, wall_time, n_steps IS NOT NULL AS ran
  FROM (SELECT o_orderkey AS run, 'task' || (o_custkey % 40) AS task,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'T1' WHEN '2-HIGH' THEN 'T2' WHEN '3-MEDIUM' THEN 'T3' END AS level,
          'cfg' || (o_orderkey % 3) AS config, o_orderstatus = 'F' AS passed, o_orderkey % 3 AS retries FROM orders)
  LEFT JOIN (SELECT l_orderkey AS run, count(*) AS n_steps, count(*) FILTER (WHERE l_returnflag = 'R') AS error_steps,
               sum(l_quantity) AS wall_time FROM lineitem GROUP BY 1) USING (run))"""


def elements(spark: SparkSession, sf: str) -> DataFrame:
    """One order is one screen, one line one element."""
    l = table(spark, sf, "lineitem")
    x1, y1 = (F.col("l_partkey") % 900) / 1000.0, (F.col("l_suppkey") % 90) / 100.0
    return l.select(
        F.col("l_orderkey").alias("screen_id"),
        F.expr("l_linenumber * 100000000000L + l_partkey * 100000 + l_suppkey").alias("id"),
        box(x1, y1, x1 + F.col("l_quantity") / 500, y1 + F.col("l_linenumber") / 100).alias("bbox"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("text"),
        F.when(F.col("l_linestatus") == "O", "cv").otherwise("ocr").alias("source"),
        (F.col("l_discount") * 10).alias("confidence"))


ELEMENTS_SQL = """elements AS (
  SELECT l_orderkey AS screen_id, l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey AS id,
         CAST(l_partkey % 900 AS DOUBLE) / 1000 AS x1, CAST(l_suppkey % 90 AS DOUBLE) / 100 AS y1,
         CAST(l_partkey % 900 AS DOUBLE) / 1000 + l_quantity / 500 AS x2,
         CAST(l_suppkey % 90 AS DOUBLE) / 100 + CAST(l_linenumber AS DOUBLE) / 100 AS y2,
         CASE WHEN l_returnflag = 'N' THEN '' ELSE 'part ' || l_partkey END AS text,
         CASE WHEN l_linestatus = 'O' THEN 'cv' ELSE 'ocr' END AS source, l_discount * 10 AS confidence
  FROM lineitem)"""


# --- embeddings: points and boxes, one label is one screen ------------------------

def unit(i: int):
    """Component ``i`` (from 0) moved into the unit interval."""
    return (F.get("embedding", F.lit(i)).cast("double") + 1) / 2


def unit_sql(i: int) -> str:
    return f"((CAST(embedding[{i + 1}] AS DOUBLE) + 1) / 2)"


def unit_box(i: int):
    a, b, c, d = (unit(i + j) for j in range(4))
    return box(F.least(a, b), F.least(c, d), F.greatest(a, b), F.greatest(c, d))


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("screen_id"), F.col("vec_id").alias("point_id"), point(unit(0), unit(1)).alias("point"))


def boxes(spark: SparkSession, sf: str, at: int = 2) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("screen_id"), F.col("vec_id").alias("box_id"), F.col("vec_id").alias("ord"),
        unit_box(at).alias("bbox"),
        F.when(F.col("vec_id") % 7 == 0, " ").otherwise(F.concat(F.lit("b"), F.col("vec_id").cast("string"))).alias("text"))


def boxes_sql(at: int = 2, name: str = "boxes") -> str:
    a, b, c, d = (unit_sql(at + j) for j in range(4))
    return f"""{name} AS (
  SELECT label AS screen_id, vec_id AS box_id, vec_id AS ord, least({a},{b}) AS x1, least({c},{d}) AS y1,
         greatest({a},{b}) AS x2, greatest({c},{d}) AS y2,
         CASE WHEN vec_id % 7 = 0 THEN ' ' ELSE 'b' || vec_id END AS text FROM embeddings)"""


POINTS_SQL = f"points AS (SELECT label AS screen_id, vec_id AS point_id, {unit_sql(0)} AS x, {unit_sql(1)} AS y FROM embeddings)"


# --- documents: samples; conversations: sessions ----------------------------------

def samples(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"),
        F.when(F.col("doc_id") % 3 == 0, "action").when(F.col("doc_id") % 3 == 1, "plan").otherwise("grounding").alias("kind"),
        F.col("lang").alias("prompt"), F.col("text").alias("response"), F.col("source").alias("image"), "n_chars")


SAMPLES_SQL = """samples AS (
  SELECT doc_id AS ord, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split,
         CASE doc_id % 3 WHEN 0 THEN 'action' WHEN 1 THEN 'plan' ELSE 'grounding' END AS kind,
         lang AS prompt, text AS response, source AS image, n_chars FROM documents)"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as session steps; a system turn has no thought."""
    c = table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "user", "click").when(F.col("role") == "assistant", "type").otherwise("wait")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("step_index"), "role", "text",
                    F.when(F.col("role") == "system", "").otherwise(F.col("text")).alias("thought"),
                    F.when(F.col("turn") % 3 == 0, "a").otherwise("b").alias("image"),
                    action(kind, F.when(kind == "click", point((F.length("text") % 100) / 100.0, F.lit(0.25))),
                           None, F.when(kind == "type", F.lit("ok"))).alias("action"))


TURNS_SQL = """turns AS (
  SELECT conv_id AS session_id, turn AS step_index, role, text, CASE WHEN role = 'system' THEN '' ELSE text END AS thought,
         CASE WHEN turn % 3 = 0 THEN 'a' ELSE 'b' END AS image,
         CASE role WHEN 'user' THEN printf('click (%.2f, 0.25)', CAST(length(text) % 100 AS DOUBLE) / 100)
                   WHEN 'assistant' THEN 'type ''ok''' ELSE 'wait' END AS line FROM conversations)"""
