"""Driver-table queries for scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import box, point
from ..functions.strings import char_f1
from ..operators import counts as C
from ..operators import matching as J
from ..operators import metrics as M
from ..operators.ordered import OrderedRows
from . import tables as D
from .registry import query, with_

R6 = 6


def r(c, name=None):
    return F.round(c, R6).alias(name or c)


CLS_SQL = D.CASES_SQL + """,
cls AS (SELECT c AS cls, sum(g) AS gt, sum(p) AS pred, sum(h) AS hit FROM (
    SELECT gt AS c, 1 AS g, 0 AS p, 0 AS h FROM flags UNION ALL
    SELECT pred, 0, 1, CAST(op_ok AS INT) FROM flags WHERE pred <> '解析失败') GROUP BY 1),
pr AS (SELECT *, CASE WHEN pred > 0 THEN CAST(hit AS DOUBLE) / pred ELSE 0 END AS precision,
              CASE WHEN gt > 0 THEN CAST(hit AS DOUBLE) / gt ELSE 0 END AS recall FROM cls),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""


@query("build_cases_j7", with_(D.CASES_SQL) + "SELECT i, gt, pred, dist, gt_text, pred_text FROM cases")
def _(s, sf):
    return D.cases(s, sf).select("i", "gt", "pred", "dist", "gt_text", "pred_text")


@query("op_f1_a7", with_(CLS_SQL) + """SELECT cls, CAST(gt AS BIGINT) AS gt, CAST(pred AS BIGINT) AS pred,
  CAST(hit AS BIGINT) AS hit, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f""")
def _(s, sf):
    return M.op_f1(D.cases(s, sf)).select("cls", "gt", "pred", "hit", r("precision"), r("recall"), r("f1"))


@query("op_f1_summary_a8", with_(CLS_SQL) + """SELECT round(avg(f1) FILTER (WHERE gt > 0), 6) AS macro_f1,
  round((SELECT avg(CAST(op_ok AS DOUBLE)) FROM flags), 6) AS micro_f1 FROM f""")
def _(s, sf):
    return M.op_f1_summary(D.cases(s, sf)).select(r("macro_f1"), r("micro_f1"))


@query("step_success_a9", with_(D.CASES_SQL) + """
SELECT 0.1::DOUBLE AS threshold, count(*) FILTER (WHERE op_ok AND near10) AS ok, count(*) AS n,
       round(avg(CAST(op_ok AND near10 AS DOUBLE)), 6) AS rate FROM flags
UNION ALL SELECT 0.14::DOUBLE, count(*) FILTER (WHERE op_ok AND near14), count(*),
       round(avg(CAST(op_ok AND near14 AS DOUBLE)), 6) FROM flags""")
def _(s, sf):
    return M.step_success(D.cases(s, sf)).select("threshold", "ok", "n", r("rate"))


ACC = """count(*) AS n, round(avg(CAST(type_ok AS DOUBLE)), 6) AS type_accuracy,
  round(avg(CAST({joint} AND near10 AS DOUBLE)), 6) AS joint_accuracy,
  count(*) FILTER (WHERE pred = '解析失败') AS parse_failures,
  round(avg(CAST(pred = '解析失败' AS DOUBLE)), 6) AS unexecutable_rate,
  count(*) FILTER (WHERE gt IN ('type','hotkey') AND pred <> '解析失败') AS keyboard_total,
  round(count(*) FILTER (WHERE gt IN ('type','hotkey') AND pred IN ('type','hotkey'))::DOUBLE
    / count(*) FILTER (WHERE gt IN ('type','hotkey') AND pred <> '解析失败'), 6) AS keyboard_recall"""

def acc_cols():
    return ["n", r("type_accuracy"), r("joint_accuracy"), "parse_failures", r("unexecutable_rate"),
            "keyboard_total", r("keyboard_recall")]


@query("accuracy_summary_a10_a12", with_(D.CASES_SQL) + "SELECT " + ACC.format(joint="type_ok") + " FROM flags")
def _(s, sf):
    return M.accuracy_summary(D.cases(s, sf)).select(*acc_cols())


@query("accuracy_summary_strict_a10", with_(D.CASES_SQL) + "SELECT " + ACC.format(joint="op_ok") + " FROM flags")
def _(s, sf):
    return M.accuracy_summary(D.cases(s, sf), require_text=True).select(*acc_cols())


DIST = """count(dist) AS pairs, round(avg(dist), 6) AS mean_dist,
  round(avg(CAST(dist <= 0.05 AS DOUBLE)), 6) AS hit_0_05, round(avg(CAST(dist <= 0.1 AS DOUBLE)), 6) AS hit_0_1,
  round(list_sort(list(dist))[CAST(count(dist) // 2 + 1 AS BIGINT)], 6) AS median_upper, round(median(dist), 6) AS median_mid"""


def dist_cols():
    return ["pairs", r("mean_dist"), r("hit_0_05"), r("hit_0_1"), r("median_upper"), r("median_mid")]


@query("distance_summary_a11", with_(D.CASES_SQL) + f"SELECT {DIST} FROM cases WHERE dist IS NOT NULL")
def _(s, sf):
    return M.distance_summary(D.cases(s, sf)).select(*dist_cols())


@query("distance_by_config_a11", with_(D.CASES_SQL) + f"SELECT config, {DIST} FROM cases WHERE dist IS NOT NULL GROUP BY config")
def _(s, sf):
    return M.distance_summary(D.cases(s, sf), ("config",)).select("config", *dist_cols())


@query("confusion_top_a6_t8", with_(D.CASES_SQL) + "SELECT gt, pred, count(*) AS n FROM cases GROUP BY ALL ORDER BY n DESC, gt, pred LIMIT 15")
def _(s, sf):
    return M.confusion(D.cases(s, sf), top=15)


@query("confusion_map_a6", with_(D.CASES_SQL) + """SELECT config, string_agg(gt || '->' || pred || '=' || n, ';' ORDER BY gt || '->' || pred) AS confusion
FROM (SELECT config, gt, pred, count(*) AS n FROM cases GROUP BY ALL) GROUP BY config""")
def _(s, sf):
    m = M.confusion_map(D.cases(s, sf), ("config",))
    pairs = F.array_sort(F.map_entries("confusion"))
    return m.select("config", F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("confusion"))


@query("confusion_matrix_a6", with_(D.CASES_SQL) + """SELECT gt, nullif(count(*) FILTER (WHERE pred='click'), 0) AS click,
 nullif(count(*) FILTER (WHERE pred='type'), 0) AS type, nullif(count(*) FILTER (WHERE pred='解析失败'), 0) AS failed FROM cases GROUP BY gt""")
def _(s, sf):
    return M.confusion_matrix(D.cases(s, sf), ["click", "type", "解析失败"]).withColumnRenamed("解析失败", "failed")


@query("session_success_a17", with_(D.CASES_SQL) + """SELECT count(*) AS sessions, count(*) FILTER (WHERE done) AS sessions_done,
 round(avg(CAST(done AS DOUBLE)), 6) AS session_success FROM (SELECT run // 1 AS g, i // 2 AS h, bool_and(op_ok AND near10) AS done FROM flags GROUP BY ALL)""")
def _(s, sf):
    c = D.cases(s, sf).withColumn("session", F.struct("run", F.expr("i div 2")))
    return M.session_success(c, "session").select("sessions", "sessions_done", r("session_success"))


@query("by_category_a18", with_(D.CASES_SQL) + """SELECT app, count(*) AS n, round(avg(CAST(type_ok AS DOUBLE)), 6) AS type_accuracy,
 round(avg(CAST(op_ok AND near10 AS DOUBLE)), 6) AS joint_accuracy, round(avg(CAST(op_ok AS DOUBLE)), 6) AS micro_f1 FROM flags GROUP BY app""")
def _(s, sf):
    return M.by_category(D.cases(s, sf), "app").select("app", "n", r("type_accuracy"), r("joint_accuracy"), r("micro_f1"))


@query("label_category_a18_j6", """WITH c AS (SELECT doc_id AS i, lang AS app, quality AS gt,
   CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS pred FROM documents JOIN labels USING (doc_id))
 SELECT app, count(*) AS n, round(avg(CAST(gt = pred AS DOUBLE)), 6) AS type_accuracy FROM c GROUP BY app""")
def _(s, sf):
    lab = D.table(s, sf, "labels").select(F.col("doc_id").alias("i"), F.col("quality").cast("string").alias("gt"))
    docs = D.table(s, sf, "documents").select(F.col("doc_id").alias("i"), F.col("lang").alias("app"),
                                              F.when(F.col("n_chars") >= 1000, "1").otherwise("0").alias("pred"))
    c = J.attach_test_rows(lab, docs)
    none = F.lit(None).cast("string")
    c = c.withColumns({"dist": F.lit(None).cast("double"), "gt_text": none, "pred_text": none})
    return M.by_category(c, "app").select("app", "n", r("type_accuracy"))


CFG_SQL = D.CASES_SQL + """,
cls AS (SELECT config, c AS cls, sum(g) AS gt, sum(p) AS pred, sum(h) AS hit FROM (
    SELECT config, gt AS c, 1 AS g, 0 AS p, 0 AS h FROM flags UNION ALL
    SELECT config, pred, 0, 1, CAST(op_ok AS INT) FROM flags WHERE pred <> '解析失败') GROUP BY ALL),
f AS (SELECT config, cls, gt, CASE WHEN hit > 0 THEN 2.0 * (CAST(hit AS DOUBLE) / pred) * (CAST(hit AS DOUBLE) / gt)
        / (CAST(hit AS DOUBLE) / pred + CAST(hit AS DOUBLE) / gt) ELSE 0 END AS f1 FROM cls)"""


@query("f1_matrix_a22", with_(CFG_SQL) + """SELECT config, cls, round(f1, 6) AS f1, CAST(gt AS BIGINT) AS support, gt < 15 AS thin
 FROM f WHERE gt > 0""")
def _(s, sf):
    return M.f1_matrix(D.cases(s, sf), "config").select("config", "cls", r("f1"), "support", "thin")


@query("leaderboard_a23", with_(CFG_SQL) + """SELECT config, n, round(step_sr_010, 6) AS step_sr_010, round(step_sr_014, 6) AS step_sr_014,
  round(unexecutable, 6) AS unexecutable, text_compared, round(macro, 6) AS macro_f1, round(micro, 6) AS micro_f1
FROM (SELECT config, count(*) AS n, avg(CAST(op_ok AND near10 AS DOUBLE)) AS step_sr_010, avg(CAST(op_ok AND near14 AS DOUBLE)) AS step_sr_014,
        avg(CAST(pred = '解析失败' AS DOUBLE)) AS unexecutable, bool_or(pred_text IS NOT NULL) AS text_compared,
        avg(CAST(op_ok AS DOUBLE)) AS micro FROM flags GROUP BY config)
JOIN (SELECT config, avg(f1) FILTER (WHERE gt > 0) AS macro FROM f GROUP BY config) USING (config)""")
def _(s, sf):
    return M.leaderboard(D.cases(s, sf), "config").select("config", "n", r("step_sr_010"), r("step_sr_014"),
                                                          r("unexecutable"), "text_compared", r("macro_f1"), r("micro_f1"))


@query("compare_variants_a29_a30", with_(D.CASES_SQL) + "SELECT app, " + ACC.format(joint="type_ok") + """,
  count(dist) AS pointed_pairs, round(median(dist), 6) AS median_distance, round(avg(elapsed), 6) AS sec_per_sample FROM flags GROUP BY app""")
def _(s, sf):
    return M.compare_variants(D.cases(s, sf), "app", "elapsed").select(
        "app", *acc_cols(), "pointed_pairs", r("median_distance"), r("sec_per_sample"))


@query("best_step_a26", """SELECT user_id AS run, arg_min(event_id, (value, event_id)) AS best_step, min(value) AS best_val_loss
 FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def _(s, sf):
    e = D.table(s, sf, "events")
    log = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"),
                   F.when(F.col("event_type") != "error", F.col("value")).alias("val_loss"))
    return M.best_step(log, ("run",))


# --- grounding: points against boxes ----------------------------------------------

HIT_SQL = f"""truth AS (SELECT vec_id, label, vec_id % 3 AS platform, {D.unit_sql(0)} AS px, {D.unit_sql(1)} AS py,
  least({D.unit_sql(2)}, {D.unit_sql(3)}) - 0.1 AS x1, greatest({D.unit_sql(2)}, {D.unit_sql(3)}) + 0.1 AS x2,
  least({D.unit_sql(4)}, {D.unit_sql(5)}) - 0.1 AS y1, greatest({D.unit_sql(4)}, {D.unit_sql(5)}) + 0.1 AS y2 FROM embeddings),
hits AS (SELECT *, CASE WHEN vec_id % 11 = 0 THEN false ELSE px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 END AS hit FROM truth)"""


def hits(s, sf):
    e = D.table(s, sf, "embeddings")
    wide = [F.least(D.unit(2), D.unit(3)) - 0.1, F.least(D.unit(4), D.unit(5)) - 0.1,
            F.greatest(D.unit(2), D.unit(3)) + 0.1, F.greatest(D.unit(4), D.unit(5)) + 0.1]
    truth = e.select(F.col("vec_id").alias("index"), "label", (F.col("vec_id") % 3).alias("platform"), box(*wide).alias("bbox"))
    pred = e.filter("vec_id % 11 <> 0").select(F.col("vec_id").alias("index"), point(D.unit(0), D.unit(1)).alias("pred_point"))
    return J.hit_test(truth, pred)


@query("hit_test_j4", with_(HIT_SQL) + "SELECT vec_id AS index, hit FROM hits")
def _(s, sf):
    return hits(s, sf).select("index", "hit")


@query("hit_rates_a13", with_(HIT_SQL) + """SELECT 'all' AS dimension, 'all' AS value, count(*) FILTER (WHERE hit) AS hit, count(*) AS total,
  round(avg(CAST(hit AS DOUBLE)), 6) AS rate FROM hits
UNION ALL SELECT 'label', CAST(label AS VARCHAR), count(*) FILTER (WHERE hit), count(*), round(avg(CAST(hit AS DOUBLE)), 6) FROM hits GROUP BY label
UNION ALL SELECT 'platform', CAST(platform AS VARCHAR), count(*) FILTER (WHERE hit), count(*), round(avg(CAST(hit AS DOUBLE)), 6) FROM hits GROUP BY platform""")
def _(s, sf):
    return C.rate_table(hits(s, sf), F.col("hit"), ("platform", "label")).select("dimension", "value", "hit", "total", r("rate"))


@query("failure_sample_t9", with_(HIT_SQL) + "SELECT vec_id AS index, label FROM hits WHERE NOT hit ORDER BY vec_id LIMIT 20")
def _(s, sf):
    from ..operators.selection import failure_sample
    return failure_sample(hits(s, sf), 20, "hit", "index").select("index", "label")


PROBE_SQL = f"""p AS (SELECT vec_id, 'prompt' || (vec_id % 3) AS prompt, 1280 AS w, 720 AS h, 924 AS rw, 504 AS rh,
  {D.unit_sql(0)} * 1100 AS cx1, {D.unit_sql(1)} * 700 AS cy1, {D.unit_sql(0)} * 1100 + 20 AS cx2, {D.unit_sql(1)} * 700 + 30 AS cy2,
  least({D.unit_sql(2)}, {D.unit_sql(3)}) - 0.1 AS x1, greatest({D.unit_sql(2)}, {D.unit_sql(3)}) + 0.1 AS x2,
  least({D.unit_sql(4)}, {D.unit_sql(5)}) - 0.1 AS y1, greatest({D.unit_sql(4)}, {D.unit_sql(5)}) + 0.1 AS y2
  FROM embeddings WHERE vec_id % 13 <> 0),
sp AS (SELECT *, (cx1 + cx2) / 2 / dx AS ux, (cy1 + cy2) / 2 / dy AS uy FROM (
  SELECT *, 'pixel' AS space, rw AS dx, rh AS dy FROM p UNION ALL SELECT *, 'rel1000', 1000, 1000 FROM p
  UNION ALL SELECT *, 'original', w, h FROM p)),
probe AS (SELECT prompt, space, count(*) AS parsed, count(*) FILTER (WHERE ux BETWEEN x1 AND x2 AND uy BETWEEN y1 AND y2) AS hits,
  count(*) FILTER (WHERE cx2 > rw OR cy2 > rh) AS beyond_size, count(*) FILTER (WHERE greatest(cx1, cx2, cy1, cy2) > 1000) AS beyond_1000
  FROM sp GROUP BY ALL)"""


def probe(s, sf):
    e = D.table(s, sf, "embeddings")
    cx, cy = D.unit(0) * 1100, D.unit(1) * 700
    wide = [F.least(D.unit(2), D.unit(3)) - 0.1, F.least(D.unit(4), D.unit(5)) - 0.1,
            F.greatest(D.unit(2), D.unit(3)) + 0.1, F.greatest(D.unit(4), D.unit(5)) + 0.1]
    preds = e.select(F.concat(F.lit("prompt"), (F.col("vec_id") % 3).cast("string")).alias("prompt"),
                     F.when(F.col("vec_id") % 13 != 0, box(cx, cy, cx + 20, cy + 30)).alias("box"), box(*wide).alias("bbox"),
                     F.lit(1280).alias("w"), F.lit(720).alias("h"), F.lit(924).alias("rw"), F.lit(504).alias("rh"))
    return J.probe_spaces(preds)


@query("probe_spaces_a27", with_(PROBE_SQL) + "SELECT * FROM probe")
def _(s, sf):
    return probe(s, sf)


@query("best_space_a27", with_(PROBE_SQL) + """SELECT prompt, space, hits FROM (SELECT *, row_number() OVER
  (PARTITION BY prompt ORDER BY hits DESC, space) AS rn FROM probe) WHERE rn = 1""")
def _(s, sf):
    return J.best_space(probe(s, sf))


# --- plans ------------------------------------------------------------------------

PAIR_SQL = """pairs AS (SELECT a.conv_id, a.turn, replace(a.text, ' ', '') AS x, replace(b.text, ' ', '') AS y
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
cx AS (SELECT conv_id, turn, ch, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(x, '')) AS ch FROM pairs) WHERE ch <> '' GROUP BY ALL),
cy AS (SELECT conv_id, turn, ch, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(y, '')) AS ch FROM pairs) WHERE ch <> '' GROUP BY ALL),
common AS (SELECT conv_id, turn, sum(least(cx.n, cy.n)) AS c FROM cx JOIN cy USING (conv_id, turn, ch) GROUP BY ALL)"""


@query("char_f1_a15", with_(PAIR_SQL) + """SELECT conv_id, turn, round(CASE WHEN coalesce(c, 0) = 0 THEN 0 ELSE
  2 * (CAST(c AS DOUBLE) / length(y)) * (CAST(c AS DOUBLE) / length(x)) / (CAST(c AS DOUBLE) / length(y) + CAST(c AS DOUBLE) / length(x)) END, 6) AS f1
FROM pairs LEFT JOIN common USING (conv_id, turn)""")
def _(s, sf):
    c = D.table(s, sf, "conversations")
    o = OrderedRows(c, "conv_id", "turn").previous("_p", F.struct("turn", "text"), 1).df()
    p = F.try_element_at("_p", F.lit(1))
    return o.filter(F.size("_p") > 0).select("conv_id", p["turn"].alias("turn"), r(char_f1(p["text"], "text"), "f1"))


PLAN_SQL = """plan AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, '.'), lambda t: trim(t, E' \\n')), lambda t: t <> '')[:8] AS ref FROM conversations),
both_ AS (SELECT a.conv_id, a.turn, a.ref, coalesce(b.ref, []) AS got FROM plan a LEFT JOIN plan b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1),
r AS (SELECT conv_id, turn, unnest(ref) AS t, unnest(range(len(ref))) AS i FROM both_),
g AS (SELECT conv_id, turn, unnest(got) AS t, unnest(range(len(got))) AS j FROM both_),
rc AS (SELECT conv_id, turn, i, ch, count(*) AS n FROM (SELECT conv_id, turn, i, unnest(string_split(replace(t, ' ', ''), '')) AS ch FROM r) WHERE ch <> '' GROUP BY ALL),
gc AS (SELECT conv_id, turn, j, ch, count(*) AS n FROM (SELECT conv_id, turn, j, unnest(string_split(replace(t, ' ', ''), '')) AS ch FROM g) WHERE ch <> '' GROUP BY ALL),
pc AS (SELECT conv_id, turn, i, j, sum(least(rc.n, gc.n)) AS c FROM rc JOIN gc USING (conv_id, turn, ch) GROUP BY ALL),
sc AS (SELECT pc.conv_id, pc.turn, pc.i, max(2 * (CAST(c AS DOUBLE) / length(replace(g.t, ' ', ''))) * (CAST(c AS DOUBLE) / length(replace(r.t, ' ', '')))
   / (CAST(c AS DOUBLE) / length(replace(g.t, ' ', '')) + CAST(c AS DOUBLE) / length(replace(r.t, ' ', '')))) AS best
   FROM pc JOIN r USING (conv_id, turn, i) JOIN g USING (conv_id, turn, j) GROUP BY ALL),
cov AS (SELECT b.conv_id, b.turn, len(b.got) - len(b.ref) AS surplus, len(b.got) = 0 AS empty,
   CASE WHEN len(b.ref) = 0 THEN 0 ELSE coalesce((SELECT sum(best) FROM sc WHERE sc.conv_id = b.conv_id AND sc.turn = b.turn), 0) / len(b.ref) END AS coverage FROM both_ b)"""


def plans(s, sf):
    c = D.table(s, sf, "conversations")
    items = F.filter(F.transform(F.split("text", r"\."), lambda t: F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")), lambda t: t != "")
    c = c.select("conv_id", "turn", F.slice(items, 1, 8).alias("ref"))
    o = OrderedRows(c, "conv_id", "turn").previous("_p", F.struct("turn", "ref"), 1).df()
    p = F.try_element_at("_p", F.lit(1))
    got = F.when(p["turn"] == F.col("turn") - 1, p["ref"])
    d = o.withColumn("got", F.coalesce(got, F.array().cast("array<string>"))).drop("_p")
    return (d.withColumn("coverage", J.plan_coverage("ref", "got")).withColumn("surplus", F.size("got") - F.size("ref"))
            .withColumn("empty", F.size("got") == 0))


@query("best_match_j8", with_(PLAN_SQL) + "SELECT conv_id, turn, round(coverage, 6) AS coverage FROM cov")
def _(s, sf):
    return plans(s, sf).select("conv_id", "turn", r("coverage"))


@query("plan_quality_a16", with_(PLAN_SQL) + """SELECT count(*) AS n, round(avg(coverage), 6) AS coverage_mean, round(median(coverage), 6) AS coverage_median,
  round(avg(surplus), 6) AS surplus_mean, count(*) FILTER (WHERE surplus > 0) AS too_long, count(*) FILTER (WHERE empty) AS empty FROM cov""")
def _(s, sf):
    return M.plan_quality(plans(s, sf)).select("n", r("coverage_mean"), r("coverage_median"), r("surplus_mean"), "too_long", "empty")
