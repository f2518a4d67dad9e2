"""Driver-table queries for sample building and the audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.actions import action
from ..functions.geometry import point
from ..operators import audit as AU
from ..operators import samples as SM
from ..operators import sessions as W
from ..operators.matching import locate_points
from ..operators.normalize import web_steps
from ..operators.selection import screen_lists
from ..session import scratch_path
from ..sources.readers import read_manifest
from ..sources.sinks import write_manifest
from . import tables as D
from .registry import query, with_


# --- audit ------------------------------------------------------------------------

def audited(s, sf):
    """Documents as samples; the answer of each is good or broken by its number."""
    d = D.table(s, sf, "documents")
    i, text = F.col("doc_id"), F.col("text")
    m = i % 7
    kind = F.when(i % 3 == 0, "action").when(i % 3 == 1, "plan").otherwise("grounding")

    thought = F.when(m == 6, " ").otherwise(text)
    typ = F.when(m == 4, "fly").when(m == 5, "scroll").otherwise("click")
    pt = F.when(m.isin(2, 5, 6), F.array(F.lit(0.5), F.lit(0.25)))
    target = F.when(m == 0, "x").when(m == 1, " ").when(m == 2, "y")
    element = F.when(m == 3, (i % 4).cast("int"))
    action_json = F.to_json(F.struct(thought.alias("thought"), F.struct(
        typ.alias("type"), pt.alias("point"), element.alias("element"), target.alias("target")).alias("action")))
    plan_json = F.when(m == 0, "[]").when(m == 1, F.to_json(F.array(F.lit("a"), F.lit("a")))).otherwise(
        F.to_json(F.array(F.lit("a"), text)))
    box_json = (F.when(m == 0, '{"point":[0.5,1.5]}').when(m == 1, '{"point":[0.5,1.0]}')
                .when(m == 2, '{"bbox_2d":[10,10,5,20]}').when(m == 3, '{"bbox_2d":[10,10,1200,20]}')
                .otherwise('{"bbox_2d":[10,10,900,20]}'))
    prompt = F.when(i % 50 == 0, "  ").otherwise(F.concat("lang", F.lit("\n  [1] one\n[2] two (9)")))
    return d.select(F.when(i % 5 == 0, "val").otherwise("train").alias("split"), kind.alias("kind"),
                    F.concat("source", F.lit("/"), (i % 40).cast("string")).alias("image"), prompt.alias("prompt"),
                    F.when(kind == "action", action_json).when(kind == "plan", plan_json).otherwise(box_json).alias("response"),
                    F.lit(1000).alias("width"), F.lit(800).alias("height"), i.alias("ord"))


AUDITED_SQL = r"""a AS (SELECT doc_id AS ord, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split,
  CASE doc_id % 3 WHEN 0 THEN 'action' WHEN 1 THEN 'plan' ELSE 'grounding' END AS kind, source || '/' || (doc_id % 40) AS image,
  doc_id % 50 = 0 AS no_prompt, lang, doc_id % 7 AS m, doc_id % 4 AS e, text FROM documents),
b AS (SELECT *, CASE WHEN no_prompt THEN '' ELSE lang END AS pkey,
  CASE kind WHEN 'action' THEN CASE WHEN m = 6 THEN 'blank' ELSE text END || '|' || m || CASE WHEN m = 3 THEN '|' || e ELSE '' END
    WHEN 'plan' THEN CASE WHEN m IN (0, 1) THEN CAST(m AS VARCHAR) ELSE 'p' || text END ELSE 'g' || CASE WHEN m >= 4 THEN 4 ELSE m END END AS rkey FROM a)"""

ROWS_SQL = r"""SELECT 'blank_field' AS "check", split, count(*) FILTER (WHERE no_prompt) AS n FROM b GROUP BY split
UNION ALL SELECT 'bad_target', split, count(*) FILTER (WHERE kind = 'action' AND m IN (1, 2)) FROM b GROUP BY split
UNION ALL SELECT 'element_not_shown', split, count(*) FILTER (WHERE kind = 'action' AND m = 3 AND (e NOT IN (1, 2) OR no_prompt)) FROM b GROUP BY split
UNION ALL SELECT 'bad_action', split, count(*) FILTER (WHERE kind = 'action' AND m IN (4, 5)) FROM b GROUP BY split
UNION ALL SELECT 'coordinate_in_thought', split, count(*) FILTER (WHERE kind = 'action' AND m <> 6 AND regexp_matches(text, '\d\.\d{3,}')) FROM b GROUP BY split
UNION ALL SELECT 'blank_thought', split, count(*) FILTER (WHERE kind = 'action' AND (m = 6 OR trim(text) = '')) FROM b GROUP BY split
UNION ALL SELECT 'bad_box', split, count(*) FILTER (WHERE kind = 'grounding' AND m IN (0, 2, 3)) FROM b GROUP BY split
UNION ALL SELECT 'bad_plan', split, count(*) FILTER (WHERE kind = 'plan' AND (m IN (0, 1) OR text = 'a')) FROM b GROUP BY split"""


@query("audit_rows_q18_q23_q28", with_(AUDITED_SQL) + ROWS_SQL)
def _(s, sf):
    return AU.row_checks(audited(s, sf))


@query("audit_duplicates_q19", with_(AUDITED_SQL) + "SELECT split, CAST(sum(c - 1) AS BIGINT) AS n FROM (SELECT split, pkey, rkey, count(*) AS c FROM b GROUP BY ALL) GROUP BY split")
def _(s, sf):
    return AU.duplicate_excess(audited(s, sf)).select("split", "n")


@query("audit_contradictions_q20", with_(AUDITED_SQL) + "SELECT split, count(*) FILTER (WHERE c > 1) AS n FROM (SELECT split, image, pkey, count(DISTINCT rkey) AS c FROM b GROUP BY ALL) GROUP BY split")
def _(s, sf):
    return AU.contradictions(audited(s, sf)).select("split", "n")


@query("audit_kind_counts_q29", with_(AUDITED_SQL) + "SELECT split, kind, count(*) AS n FROM b GROUP BY ALL")
def _(s, sf):
    return AU.kind_counts(audited(s, sf))


FULL_SQL = with_(AUDITED_SQL) + ROWS_SQL + r"""
UNION ALL SELECT 'duplicate', split, CAST(sum(c - 1) AS BIGINT) FROM (SELECT split, pkey, rkey, count(*) AS c FROM b GROUP BY ALL) GROUP BY split
UNION ALL SELECT 'contradiction', split, count(*) FILTER (WHERE c > 1) FROM (SELECT split, image, pkey, count(DISTINCT rkey) AS c FROM b GROUP BY ALL) GROUP BY split
UNION ALL SELECT 'shared_image', 'train+val', {shared} FROM (SELECT DISTINCT image FROM b WHERE split = 'train' INTERSECT SELECT DISTINCT image FROM b WHERE split = 'val')
UNION ALL SELECT 'test_leak', 'test', count(*) FROM (SELECT DISTINCT image FROM b INTERSECT SELECT DISTINCT 'src' || quality || '/' || (doc_id % 40) FROM labels)
UNION ALL SELECT 'shared_text', 'train+val', count(*) FROM (SELECT DISTINCT pkey, rkey FROM b WHERE split = 'train' INTERSECT SELECT DISTINCT pkey, rkey FROM b WHERE split = 'val')"""


def test_images(s, sf):
    return D.table(s, sf, "labels").select(F.concat(F.lit("src"), F.col("quality").cast("string"), F.lit("/"), (F.col("doc_id") % 40).cast("string")).alias("image"))


@query("audit_full_q18_q28", FULL_SQL.replace("{shared}", "count(*)"))
def _(s, sf):
    return AU.audit(audited(s, sf), test_images(s, sf), text_overlap=True)


@query("audit_val_not_held_out_q21", FULL_SQL.replace("{shared}", "0 * count(*)"))
def _(s, sf):
    # what the audit is told comes from the manifest that the build left
    path = scratch_path(s, "notes")
    write_manifest(s, path, "train+val")
    held_out = read_manifest(s, path)["val_is_held_out"]
    return AU.audit(audited(s, sf), test_images(s, sf), val_is_held_out=held_out, text_overlap=True)


# --- samples ----------------------------------------------------------------------

def located_steps(s, sf):
    """Embedding rows as clicks of a session, with the named box around each point."""
    e = D.table(s, sf, "embeddings")
    i = F.col("vec_id")
    kind = F.when(i % 5 == 0, "type").when(i % 5 == 1, "drag").when(i % 5 == 2, "scroll").otherwise("click")
    p = point(D.unit(0), D.unit(1))
    st = e.select(F.col("label").alias("session_id"), i.alias("step_index"), F.col("label").alias("screen_id"), i.alias("point_id"),
                  F.concat(F.lit("why "), i.cast("string")).alias("thought"), F.lit("do it").alias("instruction"),
                  action(kind, F.when(kind != "type", p), F.when(kind == "drag", p), F.when(kind == "type", F.lit("hello")),
                         F.when(kind == "scroll", F.lit("down"))).alias("action"), p.alias("point"))
    names = locate_points(st.select("screen_id", "point_id", "point"), D.boxes(s, sf), pad=0.01).select("point_id", "box_text")
    return W.with_history(st.join(names, "point_id"), "session_id", "step_index")


@query("target_samples_p32_x11", with_(D.POINTS_SQL, D.boxes_sql()) + """, m AS (SELECT point_id, text AS box_text, row_number() OVER (PARTITION BY point_id ORDER BY (x2 - x1) * (y2 - y1), ord) AS rn
 FROM points p JOIN boxes b ON p.screen_id = b.screen_id AND p.x BETWEEN b.x1 - 0.01 AND b.x2 + 0.01 AND p.y BETWEEN b.y1 - 0.01 AND b.y2 + 0.01 AND trim(b.text) <> ''),
st AS (SELECT vec_id, label, CASE vec_id % 5 WHEN 0 THEN 'type' WHEN 1 THEN 'drag' WHEN 2 THEN 'scroll' ELSE 'click' END AS kind, box_text,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) AS position FROM embeddings LEFT JOIN (SELECT * FROM m WHERE rn = 1) ON point_id = vec_id)
SELECT vec_id AS step_index, position, CAST(least(position - 1, 5) AS INT) AS n_history, CASE WHEN kind IN ('click', 'scroll') AND box_text IS NULL THEN 'unnamed' WHEN kind = 'drag' THEN 'only_coordinates' END AS reject_reason,
  CASE WHEN kind IN ('click', 'scroll') AND box_text IS NULL OR kind = 'drag' THEN NULL WHEN kind = 'type' THEN '{"thought":"why ' || vec_id || '","action":{"type":"type","text":"hello"}}'
   WHEN kind = 'scroll' THEN '{"thought":"why ' || vec_id || '","action":{"type":"scroll","direction":"down","target":"' || box_text || '"}}'
   ELSE '{"thought":"why ' || vec_id || '","action":{"type":"click","target":"' || box_text || '"}}' END AS response FROM st""")
def _(s, sf):
    d = SM.to_target_samples(located_steps(s, sf))
    return d.select("step_index", "position", F.size("history").alias("n_history"), "reject_reason",
                    F.when(F.col("reject_reason").isNull(), F.col("response")).alias("response"))


def element_steps(s, sf):
    """Each order is a screen with its lines as elements, and one click on it."""
    per = screen_lists(D.elements(s, sf))
    o = D.table(s, sf, "orders").select(F.col("o_orderkey").alias("screen_id"), point((F.col("o_custkey") % 100) / 100.0, (F.col("o_orderkey") % 70) / 100.0).alias("p"))
    seen = D.elements(s, sf).select("screen_id").distinct()
    none = F.array().cast(per.schema["elements"].dataType)
    d = o.join(seen, "screen_id", "left_semi").join(per, "screen_id", "left").withColumn("elements", F.coalesce("elements", none))
    return d.select("screen_id", "elements", F.lit("do it").alias("instruction"), F.lit("why").alias("thought"),
                    F.array().cast("array<struct<n:bigint,line:string,status:string>>").alias("history"), action(F.lit("click"), F.col("p")).alias("action"))


@query("element_samples_p33", with_(D.ELEMENTS_SQL) + """, o AS (SELECT o_orderkey AS screen_id, CAST(o_custkey % 100 AS DOUBLE) / 100 AS px, CAST(o_orderkey % 70 AS DOUBLE) / 100 AS py FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
k AS (SELECT *, trim(text) <> '' AS named FROM elements WHERE trim(text) <> '' OR source = 'cv'),
c AS (SELECT *, row_number() OVER (PARTITION BY screen_id, named ORDER BY id) AS rn, count(*) FILTER (WHERE named) OVER (PARTITION BY screen_id) AS a,
        count(*) FILTER (WHERE NOT named) OVER (PARTITION BY screen_id) AS b FROM k),
q AS (SELECT *, least(least(greatest(2, 4 - a), 4), b) AS keep FROM c),
shown AS (SELECT * FROM q WHERE CASE WHEN named THEN rn <= least(a, 4 - keep) ELSE rn <= keep END),
hit AS (SELECT o.screen_id, arg_min(id, ((x2 - x1) * (y2 - y1), NOT named, rn)) AS id FROM o JOIN shown s ON s.screen_id = o.screen_id AND px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 AND trim(text) <> '' GROUP BY 1)
SELECT o.screen_id, 4 AS elements_shown, CASE WHEN id IS NOT NULL THEN '{"thought":"why","action":{"type":"click","element":' || id || '}}'
  ELSE '{"thought":"why","action":{"type":"click","point":[' || px || ',' || py || ']}}' END AS response FROM o LEFT JOIN hit USING (screen_id)""")
def _(s, sf):
    d = SM.to_element_samples(element_steps(s, sf), limits=(4, 2, 0), budget=10_000)
    return d.select("screen_id", "elements_shown", "response")


BUDGET_SQL = with_(D.ELEMENTS_SQL) + """, o AS (SELECT o_orderkey AS screen_id, length('{"thought":"why","action":{"type":"click","point":[' || CAST(o_custkey % 100 AS DOUBLE) / 100 || ',' || CAST(o_orderkey % 70 AS DOUBLE) / 100 || ']}}') AS plain
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
k AS (SELECT *, trim(text) <> '' AS named, length('  [' || id || '] ' || CASE WHEN trim(text) = '' THEN '（图标，未识别出文字）' ELSE text END || printf('  (位置 %.2f, %.2f)', (x1 + x2) / 2, (y1 + y2) / 2)) AS len
  FROM elements WHERE trim(text) <> '' OR source = 'cv'),
c AS (SELECT *, row_number() OVER (PARTITION BY screen_id, named ORDER BY id) AS rn, count(*) FILTER (WHERE named) OVER (PARTITION BY screen_id) AS a,
        count(*) FILTER (WHERE NOT named) OVER (PARTITION BY screen_id) AS b FROM k),
t AS (SELECT screen_id, lim, sum(len) + count(*) - 1 AS listing FROM (SELECT *, least(least(greatest(least(16, lim // 2), lim - a), lim), b) AS keep FROM c, (VALUES (60), (45), (30), (20), (12), (6), (0)) v(lim))
  WHERE CASE WHEN named THEN rn <= least(a, lim - keep) ELSE rn <= keep END GROUP BY ALL),
fit AS (SELECT o.screen_id, v.lim FROM o JOIN (VALUES (60), (45), (30), (20), (12), (6), (0)) v(lim) ON true LEFT JOIN t ON t.screen_id = o.screen_id AND t.lim = v.lim
  WHERE ceil((length('Task: do it') + 2 + length('Done so far:') + 1 + length('  （这是第一步）') + 2 + length('Elements on screen:') + 1 + coalesce(listing, length('  （没有识别到文字元素）')) + 1) / 4.0) + ceil(plain / 4.0) <= 110)
SELECT screen_id, CAST(coalesce(max(lim), 0) AS INT) AS elements_shown FROM o LEFT JOIN fit USING (screen_id) GROUP BY screen_id"""


@query("element_samples_budget_p33_q8", BUDGET_SQL)
def _(s, sf):
    return SM.to_element_samples(element_steps(s, sf), budget=110).select("screen_id", "elements_shown")


@query("plan_samples_p34", """WITH w AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x, E' \\n')), lambda x: x <> '') AS w FROM conversations WHERE turn % 2 = 0)
SELECT conv_id, turn, CAST(to_json(list_filter(w, lambda x, i: list_position(w, x) = i)[:8]) AS VARCHAR) AS response FROM w WHERE len(w) > 0""")
def _(s, sf):
    c = D.table(s, sf, "conversations").withColumn("subtasks", F.when(F.col("turn") % 2 == 0, F.split("text", " ")).otherwise(
        F.array(F.lit(" "), F.lit("")))).withColumn("instruction", F.col("text"))
    return SM.plan_samples(c).select("conv_id", "turn", "response")


CAND_SQL = f"""g AS (SELECT vec_id, round({D.unit_sql(0)} * 1500, 2) AS bx, round({D.unit_sql(1)} * 5700, 2) AS by_, CASE WHEN vec_id % 9 = 0 THEN 1 ELSE round(abs({D.unit_sql(2)} - {D.unit_sql(3)}) * 400, 2) + 2 END AS bw,
  round(abs({D.unit_sql(4)} - {D.unit_sql(5)}) * 300, 2) + 2 AS bh, 780 AS w, 3000 AS h FROM embeddings),
win AS (SELECT *, CAST(trunc(least(greatest(bx + bw / 2 - 640, 0), greatest(w - 1280, 0))) AS INT) AS x0, CAST(trunc(least(greatest(by_ + bh / 2 - 360, 0), greatest(h - 720, 0))) AS INT) AS y0 FROM g),
rj AS (SELECT *, CASE WHEN vec_id % 13 = 0 OR vec_id % 17 = 0 THEN '缺候选元素或截图' WHEN vec_id % 11 = 0 THEN 'bbox 解析失败' WHEN bw <= 1 OR bh <= 1 THEN '目标框太小'
  WHEN vec_id % 7 = 0 THEN '没有元素描述' WHEN NOT (bx >= 0 AND bx < w AND by_ >= 0 AND by_ < h) THEN '目标框在图外'
  WHEN NOT (bx - x0 >= 0 AND bx - x0 < least(x0 + 1280, w) - x0 AND by_ - y0 >= 0 AND by_ - y0 < least(y0 + 720, h) - y0) THEN '裁剪后目标不在窗口内' END AS reject_reason FROM win)"""


# an element without a text is still named by its label
NAMED_REASON = """CASE WHEN reject_reason = '没有元素描述' AND vec_id % 14 <> 1 THEN CASE WHEN NOT (bx >= 0 AND bx < w AND by_ >= 0 AND by_ < h) THEN '目标框在图外'
  WHEN NOT (bx - x0 >= 0 AND bx - x0 < least(x0 + 1280, w) - x0 AND by_ - y0 >= 0 AND by_ - y0 < least(y0 + 720, h) - y0) THEN '裁剪后目标不在窗口内' END ELSE reject_reason END"""


def candidates(s, sf):
    e = D.table(s, sf, "embeddings")
    i = F.col("vec_id")
    nums = [F.round(D.unit(0) * 1500, 2), F.round(D.unit(1) * 5700, 2),
            F.when(i % 9 == 0, 1.0).otherwise(F.round(F.abs(D.unit(2) - D.unit(3)) * 400, 2) + 2),
            F.round(F.abs(D.unit(4) - D.unit(5)) * 300, 2) + 2]
    rect = F.when(i % 11 == 0, "1,2,x,4").otherwise(F.concat_ws(",", *[n.cast("string") for n in nums]))
    attrs = F.to_json(F.struct(rect.alias("bounding_box_rect"), F.when(i % 14 == 1, F.lit("")).otherwise(F.lit("label")).alias("title")))
    cand = F.to_json(F.struct(F.lit("div").alias("tag"), attrs.alias("attributes")))
    return e.select("vec_id", F.when(i % 13 != 0, F.array(cand)).otherwise(F.array().cast("array<string>")).alias("pos_candidates"),
                    F.when(i % 7 == 0, "[div]   -> CLICK").otherwise(F.concat(F.lit("[div]  item "), i.cast("string"), F.lit(" -> TYPE: x"))).alias("target_action_reprs"),
                    (i % 17 != 0).alias("has_image"), F.lit(780).alias("width"), F.lit(3000).alias("height"))


@query("grounding_cascade_q4", with_(CAND_SQL) + f"SELECT vec_id, {NAMED_REASON} AS reject_reason FROM rj")
def _(s, sf):
    return SM.grounding_cascade(candidates(s, sf), F.col("has_image")).select("vec_id", "reject_reason")


@query("grounding_reasons_q4", with_(CAND_SQL) + f""", d AS (SELECT *, {NAMED_REASON} AS r2 FROM rj)
SELECT coalesce(r2, 'kept') AS reason, count(*) AS n FROM d GROUP BY 1""")
def _(s, sf):
    d = SM.grounding_cascade(candidates(s, sf), F.col("has_image"))
    return d.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("grounding_samples_p9_p10", with_(CAND_SQL) + f""", b AS (SELECT *, least(x0 + 1280, w) - x0 AS cw, least(y0 + 720, h) - y0 AS ch FROM rj WHERE ({NAMED_REASON}) IS NULL)
""" + """SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'label' ELSE 'item ' || vec_id END AS prompt, '{"bbox_2d":[' || CAST(round_even(least(greatest(bx - x0, 0), cw) * (924.0::DOUBLE / cw), 0) AS INT) || ',' || CAST(round_even(least(greatest(by_ - y0, 0), ch) * (504.0::DOUBLE / ch), 0) AS INT)
 || ',' || CAST(round_even(least(greatest(bx - x0 + bw, 0), cw) * (924.0::DOUBLE / cw), 0) AS INT) || ',' || CAST(round_even(least(greatest(by_ - y0 + bh, 0), ch) * (504.0::DOUBLE / ch), 0) AS INT) || ']}' AS response FROM b""")
def _(s, sf):
    d = SM.grounding_cascade(candidates(s, sf), F.col("has_image")).withColumn("rw", F.lit(924)).withColumn("rh", F.lit(504))
    return SM.grounding_samples(d, resized=("rw", "rh")).select("vec_id", "prompt", "response")


@query("grounding_bad_boxes_q27", """SELECT label, count(*) FILTER (WHERE NOT (x1 >= 0 AND x1 < x2 AND x2 <= 960)) AS n FROM (SELECT label, trunc(((CAST(embedding[1] AS DOUBLE) + 1) / 2) * 1200 - 100) AS x1, trunc(((CAST(embedding[2] AS DOUBLE) + 1) / 2) * 1200) AS x2 FROM embeddings) GROUP BY label""")
def _(s, sf):
    e = D.table(s, sf, "embeddings")
    b = F.array((D.unit(0) * 1200 - 100).cast("int"), F.lit(1), (D.unit(1) * 1200).cast("int"), F.lit(5))
    d = e.select(F.col("label").cast("string").alias("split"), F.lit("grounding").alias("kind"), F.lit("p").alias("prompt"),
                 F.to_json(F.struct(b.alias("bbox_2d"))).alias("response"), F.lit(960).alias("width"), F.lit(100).alias("height"), F.lit("i").alias("image"))
    return AU.flag_samples(d).groupBy(F.col("split").cast("int").alias("label")).agg(F.count_if("bad_box").alias("n"))


@query("web_steps_s4_p20", "SELECT page_id AS annotation_id, CASE WHEN page_id % 2 = 0 THEN 'CLICK' ELSE '' END AS operation, 'v' || page_id AS value, url AS website, CAST(page_id % 10 AS INT) AS step_index FROM pages")
def _(s, sf):
    p = D.table(s, sf, "pages")
    i = F.col("page_id")
    op = F.concat(F.lit('{"op":"'), F.when(i % 2 == 0, "CLICK").otherwise(""), F.lit('","value":"v'), i.cast("string"), F.lit('"}'))
    nul = F.lit(None).cast("string")
    d = p.select(i.alias("annotation_id"), i.alias("action_uid"), op.alias("operation"), F.col("url").alias("website"), nul.alias("domain"), nul.alias("subdomain"),
                 nul.alias("confirmed_task"), F.array("url").alias("action_reprs"), (i % 10).cast("int").alias("target_action_index"), nul.alias("target_action_reprs"))
    return web_steps(d).select("annotation_id", "operation", "value", "website", "step_index")



# --- end to end -------------------------------------------------------------------

def prepared(s, sf):
    """Events as session documents (one user is one session), prepared as a whole."""
    from ..plans.jobs import prepare_sessions
    from .records import raw_events
    e = raw_events(s, sf).withColumn("file_name", F.concat(F.lpad(F.expr("event_id div 50").cast("string"), 9, "0"), F.when(
        F.expr("event_id div 50") % 9 == 0, "_neg_plan.json").otherwise(".json")))
    docs = e.groupBy("user_id", "file_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "raw"))), lambda x: x["raw"]).alias("actions"))
    u = F.col("user_id")
    none = F.lit(None).cast("string")
    docs = docs.select(
        F.when(u % 5 == 0, "test").otherwise("train").alias("split"), u.cast("string").alias("session_id"), "file_name", "actions",
        F.concat(F.lit("img"), (u % 40).cast("string")).alias("image"), F.lit(1024).alias("width"), F.lit(768).alias("height"),
        F.lit("task").alias("task_prompt"), none.alias("task_prompt_en"), none.alias("task_prompt_zh"), none.alias("send_prompt"),
        none.alias("send_prompt_zh"), F.concat(F.lit("because "), "file_name", F.lit(" ```json```")).alias("LLM_response_editer"))
    return prepare_sessions(docs)


PREP_SQL = r"""raw AS (SELECT event_id, user_id, event_type AS t, k, value * 4 / 1024 AS px, k * 10.0::DOUBLE / 768 AS py, (event_id // 50) % 9 = 0 AS negative
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
ok AS (SELECT * FROM raw WHERE CASE WHEN t = 'click' THEN k % 7 <> 6 AND k % 11 <> 10 AND px BETWEEN 0 AND 1 AND py BETWEEN 0 AND 1 WHEN t = 'view' THEN true
   WHEN t = 'signup' THEN k % 10 <> 0 WHEN t = 'purchase' THEN k % 6 IN (1, 2, 5) ELSE k % 3 = 0 END),
ids AS (SELECT u, row_number() OVER (ORDER BY md5('42:' || u)) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT user_id AS u FROM ok WHERE user_id % 5 <> 0)),
m AS (SELECT u, CASE WHEN rk <= greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM ids)"""


@query("prepare_sessions_end_to_end", with_(PREP_SQL) + """SELECT coalesce(split, 'test') AS split, count(*) AS steps, count(DISTINCT user_id) AS sessions, count(*) FILTER (WHERE NOT negative) AS with_thought
FROM ok LEFT JOIN m ON u = user_id GROUP BY 1""")
def _(s, sf):
    return prepared(s, sf).steps.groupBy("split").agg(F.count(F.lit(1)).alias("steps"), F.count_distinct("session_id").alias("sessions"),
                                                     F.count_if(F.col("thought") != "").alias("with_thought"))


@query("build_corpus_end_to_end", with_(PREP_SQL) + """, k AS (SELECT ok.*, m.split FROM ok JOIN m ON u = user_id WHERE NOT negative),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM k)
SELECT split, CASE WHEN t IN ('click', 'view') THEN 'pointed' ELSE 'plain' END AS form, count(*) AS n FROM h WHERE t NOT IN ('click', 'view') OR (t = 'view') OR (px <= 0.5 AND py <= 0.8) GROUP BY ALL""")
def _(s, sf):
    from ..functions.geometry import box
    from ..plans.jobs import build_corpus
    p = prepared(s, sf)
    img = D.table(s, sf, "events").select(F.concat(F.lit("img"), (F.col("user_id") % 40).cast("string")).alias("image")).distinct()
    boxes = img.select("image", F.lit(1).alias("box_id"), F.lit(1).alias("ord"), box(F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(0.8)).alias("bbox"), F.lit("left").alias("text"))
    steps = p.steps.withColumn("instruction", F.concat("instruction", F.lit(" "), "session_id", F.lit(" "), "file_name", F.lit(" "), F.col("action_index").cast("string")))
    c = build_corpus(steps, boxes)
    form = F.when(F.col("response").contains('"target"'), "pointed").otherwise("plain")
    return c.groupBy("split", form.alias("form")).agg(F.count(F.lit(1)).alias("n"))
