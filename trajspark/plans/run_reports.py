"""Driver-table queries for run records, counts and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import wilson
from ..operators import counts as C
from ..operators import runs as R
from ..operators import selection as S
from . import tables as D
from .registry import query, with_


def r(c, name=None):
    return F.round(c, 6).alias(name or c)


SUMMARY = """count(*) AS runs, count(*) FILTER (WHERE passed) AS passed, round(avg(CAST(passed AS DOUBLE)), 6) AS success_rate,
  round(greatest(0, (avg(CAST(passed AS DOUBLE)) + 1.96*1.96/(2*count(*)) - 1.96 * sqrt(avg(CAST(passed AS DOUBLE)) * (1 - avg(CAST(passed AS DOUBLE))) / count(*)
    + 1.96*1.96/(4.0*count(*)*count(*)))) / (1 + 1.96*1.96/count(*))), 6) AS ci_low,
  round(least(1, (avg(CAST(passed AS DOUBLE)) + 1.96*1.96/(2*count(*)) + 1.96 * sqrt(avg(CAST(passed AS DOUBLE)) * (1 - avg(CAST(passed AS DOUBLE))) / count(*)
    + 1.96*1.96/(4.0*count(*)*count(*)))) / (1 + 1.96*1.96/count(*))), 6) AS ci_high,
  round(avg(wall_time) FILTER (WHERE ran), 6) AS avg_wall_time, round(avg(wall_time) FILTER (WHERE ran AND passed), 6) AS avg_wall_time_passed,
  round(avg(n_steps) FILTER (WHERE ran), 6) AS avg_steps, CAST(sum(n_steps) FILTER (WHERE ran) AS BIGINT) AS steps,
  CAST(sum(error_steps) FILTER (WHERE ran) AS BIGINT) AS error_steps,
  round(CAST(sum(error_steps) FILTER (WHERE ran) AS DOUBLE) / sum(n_steps) FILTER (WHERE ran), 6) AS error_rate,
  CAST(coalesce(sum(retries) FILTER (WHERE ran), 0) AS BIGINT) AS retries, count(*) FILTER (WHERE NOT ran) AS aborted"""


def summary_cols():
    return ["runs", "passed", r("success_rate"), r("ci_low"), r("ci_high"), r("avg_wall_time"), r("avg_wall_time_passed"),
            r("avg_steps"), "steps", "error_steps", r("error_rate"), "retries", "aborted"]


@query("run_summary_a19_a20", with_(D.FACTS_SQL) + f"SELECT {SUMMARY} FROM facts")
def _(s, sf):
    return R.summarize_runs(D.facts(s, sf)).select(*summary_cols())


@query("run_summary_by_config_a19", with_(D.FACTS_SQL) + f"SELECT config, {SUMMARY} FROM facts GROUP BY config")
def _(s, sf):
    return R.summarize_runs(D.facts(s, sf), ("config",)).select("config", *summary_cols())


@query("run_summary_by_level_a21", with_(D.FACTS_SQL) + f"""SELECT level, CAST(substr(level, 2) AS INT) AS level_order, {SUMMARY}
FROM facts WHERE level IS NOT NULL GROUP BY level""")
def _(s, sf):
    return R.summarize_by_level(D.facts(s, sf)).select("level", "level_order", *summary_cols())


@query("run_summary_by_task_a21", with_(D.FACTS_SQL) + """SELECT task, arg_min(coalesce(level, 'none'), run) AS level, count(*) AS runs, count(*) FILTER (WHERE passed) AS passed
 FROM facts GROUP BY task""")
def _(s, sf):
    return R.summarize_by_task(D.facts(s, sf).withColumn("level", F.coalesce("level", F.lit("none"))))


@query("wilson_a20", """SELECT c_mktsegment, k, n, round(greatest(0, (k::DOUBLE/n + 1.96*1.96/(2*n) - 1.96*sqrt(k::DOUBLE/n*(1-k::DOUBLE/n)/n + 1.96*1.96/(4.0*n*n))) / (1 + 1.96*1.96/n)), 6) AS low,
  round(least(1, (k::DOUBLE/n + 1.96*1.96/(2*n) + 1.96*sqrt(k::DOUBLE/n*(1-k::DOUBLE/n)/n + 1.96*1.96/(4.0*n*n))) / (1 + 1.96*1.96/n)), 6) AS high
 FROM (SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 0) AS k, count(*) AS n FROM customer GROUP BY 1)""")
def _(s, sf):
    g = D.table(s, sf, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") < 0).alias("k"),
                                                              F.count(F.lit(1)).alias("n"))
    w = wilson("k", "n")
    return g.select("c_mktsegment", "k", "n", r(w["low"], "low"), r(w["high"], "high"))


@query("compare_configs_j13", with_(D.FACTS_SQL) + """, c AS (SELECT task, config, count(*) FILTER (WHERE passed) || '/' || count(*) AS cell FROM facts GROUP BY ALL)
SELECT task, max(cell) FILTER (WHERE config = 'cfg0') AS cfg0, max(cell) FILTER (WHERE config = 'cfg1') AS cfg1,
 max(cell) FILTER (WHERE config = 'cfg2') AS cfg2 FROM c GROUP BY task""")
def _(s, sf):
    return R.compare_configs(D.facts(s, sf), ["cfg0", "cfg1", "cfg2"])


@query("level_rates_a24", with_(D.FACTS_SQL) + """SELECT config, round(avg(CAST(passed AS DOUBLE)) FILTER (WHERE level = 'T1'), 6) AS "T1",
 round(avg(CAST(passed AS DOUBLE)) FILTER (WHERE level = 'T2'), 6) AS "T2", round(avg(CAST(passed AS DOUBLE)) FILTER (WHERE level = 'T3'), 6) AS "T3" FROM facts GROUP BY config""")
def _(s, sf):
    return R.level_rates(D.facts(s, sf)).select("config", r("T1"), r("T2"), r("T3"))


@query("series_table_a24", """SELECT p_type, round(avg(p_retailprice) FILTER (WHERE p_brand = 'Brand#1'), 6) AS "Brand#1",
 round(avg(p_retailprice) FILTER (WHERE p_brand = 'Brand#2'), 6) AS "Brand#2" FROM part GROUP BY p_type""")
def _(s, sf):
    t = C.series_table(D.table(s, sf, "part"), "p_type", "p_brand", F.round(F.avg("p_retailprice"), 6), ["Brand#1", "Brand#2"])
    return t.select("p_type", "`Brand#1`", "`Brand#2`")


@query("dataset_totals_a31", with_(D.FACTS_SQL) + """SELECT count(*) AS runs, round(avg(n_steps), 6) AS avg_steps,
 round(avg(coalesce(wall_time, 0)), 6) AS avg_wall_time, CAST(sum(retries) AS BIGINT) AS retries FROM facts""")
def _(s, sf):
    return R.dataset_totals(D.facts(s, sf)).select("runs", r("avg_steps"), r("avg_wall_time"), "retries")


@query("run_finish_summary_a25", with_(D.STEPS_SQL) + """SELECT run, count(*) AS n_steps, count(*) FILTER (WHERE changed) AS changed_steps,
 count(*) FILTER (WHERE changed = false) AS unchanged_steps, count(*) FILTER (WHERE NOT ok) AS retries, round(sum(elapsed), 2) AS wall_time FROM steps GROUP BY run""")
def _(s, sf):
    return R.run_finish_summary(D.steps(s, sf), "run")


@query("resolve_first_s10", """SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn
 FROM part WHERE p_size > 25) WHERE rn = 1""")
def _(s, sf):
    return R.resolve_first(D.table(s, sf, "part"), "p_brand", "p_partkey", F.col("p_size") > 25).select("p_brand", "p_partkey", "p_size")


@query("outstanding_jobs_j10", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
 WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""")
def _(s, sf):
    jobs = D.table(s, sf, "orders").select("o_orderkey", "o_orderdate")
    l = D.table(s, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    out = R.outstanding(jobs, l.filter("l_linestatus = 'O'"), l.filter("l_linestatus = 'F'"), "o_orderkey", "o_orderdate")
    return out.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("failed_receipts_j11", """SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 5 = 4 OR o_orderkey % 7 <> 0""")
def _(s, sf):
    o = D.table(s, sf, "orders")
    receipts = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 4, F.col("o_orderkey") % 7).alias("exit_code"),
                        F.when(F.col("o_orderstatus") == "P", "lost").otherwise("").alias("error"))
    return R.failed_receipts(receipts).select("id")


@query("stale_workers_r6", """SELECT user_id AS worker, round(max(epoch(ts)), 3) AS last_beat, round(2505000.0 + 1704067200 + 81000 - max(epoch(ts)), 3) AS age,
  2505000.0 + 1704067200 + 81000 - max(epoch(ts)) <= 30000.0 AS alive FROM events GROUP BY user_id""")
def _(s, sf):
    beats = D.table(s, sf, "events").select(F.col("user_id").alias("worker"),
                                            (D.micros("ts") / 1e6).alias("beat"))
    now = F.lit(2505000.0 + 1704067200 + 81000)
    w = R.stale_workers(beats, now, 30000.0)
    return w.select("worker", F.round("last_beat", 3).alias("last_beat"), F.round("age", 3).alias("age"), "alive")


@query("diff_snapshots_j9", """WITH b AS (SELECT s_suppkey AS id, s_nationkey AS nation, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_name END AS name FROM supplier WHERE s_suppkey % 4 <> 0),
a AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS nation, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_name END AS name FROM supplier)
SELECT id, 'added' AS change, NULL AS old, NULL AS new FROM a WHERE id NOT IN (SELECT id FROM b)
UNION ALL SELECT a.id, 'changed:nation', CAST(b.nation AS VARCHAR), CAST(a.nation AS VARCHAR) FROM a JOIN b USING (id) WHERE a.nation IS DISTINCT FROM b.nation
UNION ALL SELECT a.id, 'changed:name', b.name, a.name FROM a JOIN b USING (id) WHERE a.name IS DISTINCT FROM b.name""")
def _(s, sf):
    t = D.table(s, sf, "supplier")
    k = F.col("s_suppkey")
    before = t.filter(k % 4 != 0).select(k.alias("id"), F.col("s_nationkey").alias("nation"), F.when(k % 9 != 0, F.col("s_name")).alias("name"))
    after = t.select(k.alias("id"), F.when(k % 10 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")).alias("nation"),
                     F.when(k % 6 != 0, F.col("s_name")).alias("name"))
    return R.diff_snapshots(before, after, ["id"], ["nation", "name"])


@query("acceptance_rules_f7", """SELECT s_suppkey, task, CASE task WHEN 'rich' THEN s_acctbal > 5000 WHEN 'named' THEN contains(s_name, '7') END AS passed
 FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'rich' WHEN 1 THEN 'named' ELSE 'none' END AS task FROM supplier)""")
def _(s, sf):
    k = F.col("s_suppkey") % 3
    t = D.table(s, sf, "supplier").withColumn("task", F.when(k == 0, "rich").when(k == 1, "named").otherwise("none"))
    return R.acceptance(t, {"rich": "s_acctbal > 5000", "named": "contains(s_name, '7')"}).select("s_suppkey", "task", "passed")


TRAJ = """placed AS (SELECT l_orderkey AS run, l_quantity AS elapsed, l_returnflag <> 'R' AS ok,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey) AS pos FROM lineitem)"""


@query("assemble_trajectories_s17", with_(TRAJ) + """SELECT o_orderkey AS run, coalesce(part, 0) AS part, greatest(1, CAST(ceil(coalesce(n_steps, 0) / 4) AS INT)) AS n_parts, coalesce(n_steps, 0) AS n_steps, wall_time, steps FROM orders
 LEFT JOIN (SELECT run, count(*) AS n_steps, round(sum(elapsed), 3) AS wall_time FROM placed GROUP BY run) t ON t.run = o_orderkey
 LEFT JOIN (SELECT run, CAST((pos - 1) // 4 AS INT) AS part, string_agg(CAST(CAST(elapsed AS INT) AS VARCHAR) || CASE WHEN ok THEN '+' ELSE '-' END, ',' ORDER BY pos) AS steps
   FROM placed GROUP BY ALL) d ON d.run = o_orderkey""")
def _(s, sf):
    step = F.struct(F.concat(F.col("elapsed").cast("int").cast("string"), F.when(F.col("ok"), "+").otherwise("-")).alias("v"))
    docs = R.assemble_trajectories(D.runs(s, sf).select("run"), D.run_steps(s, sf), "run", "ord", step, chunk=4)
    return docs.select("run", "part", "n_parts", "n_steps", "wall_time", F.array_join(F.transform("steps", lambda x: x["v"]), ",").alias("steps"))


# --- counts -----------------------------------------------------------------------

@query("value_counts_a1", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def _(s, sf):
    return C.value_counts(D.table(s, sf, "documents"), "lang", "source")


@query("array_value_counts_a2", """SELECT item, count(*) AS n FROM (SELECT unnest(string_split(url, '/')) AS item FROM pages) GROUP BY item""")
def _(s, sf):
    return C.array_value_counts(D.table(s, sf, "pages").select(F.split("url", "/").alias("parts")), "parts")


@query("length_summary_a4", """SELECT role, count(*) AS n, min(length(text)) AS min_len, max(length(text)) AS max_len, round(avg(length(text)), 6) AS avg_len,
 count(DISTINCT conv_id) AS entities FROM conversations GROUP BY role""")
def _(s, sf):
    return C.length_summary(D.table(s, sf, "conversations"), F.length("text"), "conv_id", ("role",)).select(
        "role", "n", "min_len", "max_len", r("avg_len"), "entities")


@query("dataset_profile_a32", with_(D.TURNS_SQL) + """SELECT image AS split, count(*) AS n, count(*) FILTER (WHERE thought <> '') AS with_thought,
  round(avg(CAST(thought <> '' AS DOUBLE)), 6) AS thought_share FROM turns GROUP BY image""")
def _(s, sf):
    t = D.turns(s, sf).withColumnRenamed("image", "split")
    return C.dataset_profile(t).select("split", "n", "with_thought", r("thought_share"))


@query("head_t1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def _(s, sf):
    return S.head(D.table(s, sf, "orders"), 100, "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("exact_median_by_group_x8", """SELECT l_returnflag, count(*) AS n_values, round(list_sort(list(l_extendedprice))[CAST(count(*) // 2 + 1 AS BIGINT)], 6) AS median_upper,
 round(median(l_extendedprice), 6) AS median_mid FROM lineitem GROUP BY l_returnflag""")
def _(s, sf):
    return C.medians(D.table(s, sf, "lineitem"), "l_extendedprice", ("l_returnflag",)).select(
        "l_returnflag", "n_values", r("median_upper"), r("median_mid"))
