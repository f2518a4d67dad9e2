"""Driver-table queries for normalisation, text helpers, quality rules and output conformance."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import actions as A
from ..functions import strings as T
from ..functions.geometry import point
from ..functions.udfs import approx_tokens
from ..operators import conformance as O
from ..operators import counts as C
from ..operators import metrics as M
from ..operators import normalize as N
from ..operators import quality as Q
from ..operators.samples import render_prompts
from ..operators.selection import screen_lists, select_array_with_quota
from . import tables as D
from .registry import query, with_


def r(c, name=None):
    return F.round(c, 6).alias(name or c)


# --- raw actions ------------------------------------------------------------------

RAW_SQL = """raw AS (SELECT event_id, user_id, event_type AS t, k, value * 4 / 1024 AS px, k * 10.0::DOUBLE / 768 AS py,
  event_id // 10 AS doc, row_number() OVER (PARTITION BY event_id // 10 ORDER BY event_id) - 1 AS action_index FROM
  (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
norm AS (SELECT *, CASE
    WHEN t = 'click' AND k % 7 = 6 THEN 'mouse:move' WHEN t = 'click' AND k % 11 = 10 THEN 'mouse:缺坐标'
    WHEN t = 'click' AND NOT (px BETWEEN 0 AND 1 AND py BETWEEN 0 AND 1) THEN 'mouse:坐标越界'
    WHEN t = 'signup' AND k % 10 = 0 THEN 'keyboard:缺文本'
    WHEN t = 'purchase' AND k % 6 IN (0, 3) THEN 'keyboard:缺键名' WHEN t = 'purchase' AND k % 6 = 4 THEN 'keyboard:键名无法解析 ''Foo_Bar'''
    WHEN t = 'error' AND k % 3 = 1 THEN '其他:PlanAction' WHEN t = 'error' AND k % 3 = 2 THEN '其他:EvaluateSubTaskAction' END AS reject_reason,
  CASE WHEN t = 'click' THEN CASE WHEN k % 7 = 5 THEN 'left_double' WHEN k % 5 = 0 THEN 'right_single' ELSE 'click' END
    WHEN t = 'view' THEN 'scroll' WHEN t = 'signup' THEN 'type' WHEN t = 'purchase' THEN 'hotkey' ELSE 'wait' END AS kind,
  CASE WHEN t = 'view' THEN 0.5 WHEN t = 'click' THEN px END AS x,
  CASE WHEN t = 'signup' THEN 'v' || k WHEN t = 'purchase' THEN CASE k % 6 WHEN 1 THEN 'Control_L+s' WHEN 2 THEN 'Return' ELSE 'Alt_L+F4' END END AS text,
  CASE WHEN t = 'view' THEN CASE WHEN k % 2 = 0 THEN 'up' ELSE 'down' END END AS direction FROM raw)"""


def raw_events(s, sf):
    e = D.table(s, sf, "events").withColumn("k", D.number_in())
    t, k = F.col("event_type"), F.col("k")
    mouse, board = t.isin("click", "view"), t.isin("signup", "purchase")
    kind = (F.when(mouse, "MouseAction").when(board, "KeyboardAction").when(k % 3 == 0, "WaitAction")
            .when(k % 3 == 1, "PlanAction").otherwise("EvaluateSubTaskAction"))
    keys = F.coalesce(*[F.when(k % 6 == i, v) for i, v in (
        (1, '["Control_L","s"]'), (2, "Return"), (3, "[]"), (4, "Foo_Bar"), (5, '["Alt_L", "F4"]'))])
    raw = F.struct(
        kind.alias("action_type"),
        F.when(t == "click", F.when(k % 7 == 6, "move").when(k % 7 == 5, "double_click").otherwise("click"))
        .when(t == "view", F.when(k % 2 == 0, "scroll_up").otherwise("scroll_down")).alias("mouse_action_type"),
        F.when(k % 5 == 0, "right").otherwise("left").alias("mouse_button"),
        F.when(k % 11 != 10, F.struct((F.col("value") * 4).alias("width"), (k * 10.0).alias("height"))).alias("mouse_position"),
        F.when(t == "signup", "text").when(t == "purchase", "press").alias("keyboard_action_type"),
        F.when(k % 10 != 0, F.concat(F.lit("v"), k.cast("string"))).alias("keyboard_text"), keys.alias("keyboard_key"),
        F.concat(F.lit(" step "), k.cast("string"), F.lit(" ")).alias("element"),
        F.when(k % 4 == 0, "need_retry").when(k % 4 == 1, " sub_task_success ").otherwise("unsure").alias("situation"),
        F.concat(F.lit("a"), k.cast("string")).alias("advice"))
    return e.select("event_id", "user_id", "event_type", raw.alias("raw"), F.lit(1024).alias("width"), F.lit(768).alias("height"))


def documents_of_actions(s, sf, size: int = 10):
    """``size`` consecutive events make one session document."""
    e = raw_events(s, sf).withColumn("doc", F.expr(f"event_id div {int(size)}"))
    docs = e.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "raw"))), lambda x: x["raw"]).alias("actions"))
    docs = docs.withColumn("width", F.lit(1024)).withColumn("height", F.lit(768)).withColumn(
        "file_name", F.when(F.col("doc") % 9 == 0, F.concat(F.col("doc"), F.lit("_neg_plan.json"))).otherwise(F.concat(F.col("doc"), F.lit(".json"))))
    return N.mark_negative(docs, "file_name")


def action_cols(a="action"):
    # twelve digits: shares of 1024 pixels end after ten, so no engine has a tie to break
    return [F.col(a)["type"].alias("kind"), F.round(F.col(a)["point"]["x"], 12).alias("x"), F.col(a)["text"].alias("text"), F.col(a)["direction"].alias("direction")]


ACTION_OUT = """CASE WHEN reject_reason IS NULL THEN kind END AS kind, CASE WHEN reject_reason IS NULL THEN round(x, 12) END AS x,
  CASE WHEN reject_reason IS NULL THEN text END AS text, CASE WHEN reject_reason IS NULL THEN direction END AS direction, reject_reason"""


@query("normalize_actions_p1", with_(RAW_SQL) + f"SELECT event_id, {ACTION_OUT} FROM norm")
def _(s, sf):
    return N.normalize_actions(raw_events(s, sf)).select("event_id", *action_cols(), "reject_reason")


@query("explode_actions_p2", with_(RAW_SQL) + f"SELECT doc, CAST(action_index AS INT) AS action_index, {ACTION_OUT} FROM norm")
def _(s, sf):
    d = N.explode_actions(documents_of_actions(s, sf), ["doc"])
    return d.select("doc", "action_index", *action_cols(), "reject_reason")


@query("stage_counts_p2", with_(RAW_SQL) + """SELECT action_type, count(*) AS n FROM (SELECT CASE WHEN t IN ('click','view') THEN 'MouseAction'
  WHEN t IN ('signup','purchase') THEN 'KeyboardAction' WHEN k % 3 = 0 THEN 'WaitAction' WHEN k % 3 = 1 THEN 'PlanAction' ELSE 'EvaluateSubTaskAction' END AS action_type FROM raw) GROUP BY 1""")
def _(s, sf):
    return N.stage_counts(N.explode_actions(documents_of_actions(s, sf), ["doc"]))


@query("extract_plans_p3_x27", with_(RAW_SQL) + "SELECT doc, string_agg('step ' || k, '|' ORDER BY action_index) AS subtasks FROM raw WHERE t = 'error' AND k % 3 = 1 AND doc % 9 <> 0 GROUP BY doc")
def _(s, sf):
    return N.extract_plans(documents_of_actions(s, sf), ["doc"]).select("doc", F.array_join("subtasks", "|").alias("subtasks"))


@query("extract_reflections_p4_x27", with_(RAW_SQL) + """SELECT doc, CAST(action_index AS INT) AS action_index, CASE WHEN k % 4 = 0 THEN 'need_retry' ELSE 'sub_task_success' END AS situation, 'a' || k AS advice
 FROM raw WHERE t = 'error' AND k % 3 = 2 AND k % 4 IN (0, 1) AND doc % 9 <> 0""")
def _(s, sf):
    d = N.explode_actions(documents_of_actions(s, sf), ["doc", "negative"])
    return N.extract_reflections(d).select("doc", "action_index", "situation", "advice")


@query("reject_report_a5", with_(RAW_SQL) + "SELECT 'u' || user_id % 5 AS source, reject_reason, count(*) AS n FROM norm WHERE reject_reason IS NOT NULL GROUP BY ALL")
def _(s, sf):
    d = N.normalize_actions(raw_events(s, sf)).withColumn("source", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")))
    return C.reject_report(d)


# --- actions ----------------------------------------------------------------------

@query("canonical_type_p15", """SELECT event_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'left_double' WHEN 'signup' THEN 'type' WHEN 'purchase' THEN 'hotkey' ELSE 'error' END AS type FROM events""")
def _(s, sf):
    t = F.col("event_type")
    alias = F.when(t == "click", "tap").when(t == "view", "double_click").when(t == "signup", "input").when(t == "purchase", "press").otherwise(t)
    return D.table(s, sf, "events").select("event_id", A.canonical_type(alias).alias("type"))


def odd_actions(s, sf):
    st = D.steps(s, sf)
    a, k = F.col("action"), F.col("k")
    return st.select("n", A.action(
        F.when(k % 13 == 0, "fly").otherwise(a["type"]),
        F.when(k % 5 == 0, None).when((k % 7 == 0) & a["point"].isNotNull(), point(a["point"]["x"] + 1, a["point"]["y"])).otherwise(a["point"]), None,
        F.when(k % 6 != 0, a["text"]), F.when(k % 11 == 0, "diagonal").when(k % 3 != 0, a["direction"])).alias("action"))


@query("validate_actions_p16_q24", with_(D.STEPS_SQL) + """, o AS (SELECT n, k, CASE WHEN k % 13 = 0 THEN 'fly' ELSE type END AS type,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN x + 1 ELSE x END AS x, CASE WHEN k % 6 <> 0 THEN text END AS text,
  CASE WHEN k % 11 = 0 THEN 'diagonal' WHEN k % 3 <> 0 THEN direction END AS direction FROM steps)
SELECT n, concat_ws(',', CASE WHEN type = 'fly' THEN 'unknown_type' END, CASE WHEN type IN ('click','scroll') AND x IS NULL THEN 'missing:point' END,
  CASE WHEN type IN ('type','hotkey') AND text IS NULL THEN 'missing:text' END, CASE WHEN type = 'scroll' AND direction IS NULL THEN 'missing:direction' END,
  CASE WHEN x NOT BETWEEN 0 AND 1 THEN 'range:point' END, CASE WHEN type = 'scroll' AND direction = 'diagonal' THEN 'direction' END) AS violations FROM o""")
def _(s, sf):
    return odd_actions(s, sf).select("n", F.array_join(A.action_violations("action"), ",").alias("violations"))


# spelling -> keys ("?" in front: rejected because of these names)
COMBOS = (("Ctrl+S", "ctrl+s"), ("Control_L + w", "ctrl+w"), ("Alt_F4", "alt+f4"), ("Shift_L+Tab", "shift+tab"),
          ("print_screen", "printscreen"), ("cmd+Return", "win+enter"), ("Super_R+l", "win+l"), ("pgdn", "pagedown"),
          ("Foo+x", "?foo"), ("ctrl+alt+del", "ctrl+alt+delete"), ("Next", "pagedown"), ("a_zz", "?zz"))


@query("normalize_hotkeys_p17", f"""SELECT event_id, CASE WHEN want LIKE '?%' THEN NULL ELSE want END AS keys, CASE WHEN want LIKE '?%' THEN substr(want, 2) ELSE '' END AS unknown
FROM (SELECT event_id, [{', '.join(f"'{w}'" for _, w in COMBOS)}][CAST(json_extract_string(props, '$.k') AS INT) % 12 + 1] AS want FROM events)""")
def _(s, sf):
    combo = F.get(F.array(*[F.lit(c) for c, _ in COMBOS]), D.number_in() % 12)
    d = D.table(s, sf, "events").select("event_id", A.normalize_hotkey(combo).alias("h"))
    return d.select("event_id", F.when(F.size("h.unknown") == 0, F.array_join("h.keys", "+")).alias("keys"),
                    F.array_join("h.unknown", "+").alias("unknown"))


JSON_SQL = """'{"type":"' || type || '"' || CASE WHEN x IS NOT NULL THEN ',"point":[' || x || ',0.5]' ELSE '' END || CASE WHEN text IS NOT NULL THEN ',"text":"' || text || '"' ELSE '' END
  || CASE WHEN direction IS NOT NULL THEN ',"direction":"' || direction || '"' ELSE '' END || '}'"""


@query("action_to_json_p18", with_(D.STEPS_SQL) + f"SELECT n, {JSON_SQL} AS json FROM steps")
def _(s, sf):
    return D.steps(s, sf).select("n", A.action_to_json("action").alias("json"))


@query("action_from_json_p19", with_(D.STEPS_SQL) + "SELECT n, type AS kind, round(x, 12) AS x, text, direction FROM steps")
def _(s, sf):
    j = F.regexp_replace(A.action_to_json("action"), r"\}$", ',"junk":{"a":1}}')
    return D.steps(s, sf).select("n", A.action_from_json(j).alias("action")).select("n", *action_cols())


@query("describe_action_p28", with_(D.STEPS_SQL) + """SELECT n,
  CASE WHEN x IS NOT NULL THEN type || printf(' (%.2f, 0.50)', x) WHEN text <> '' THEN type || ' ''' || text || '''' ELSE type END AS history,
  CASE WHEN type = 'click' THEN printf('click (%.3f, 0.500)', x) WHEN type = 'scroll' THEN printf('scroll (%.3f, 0.500) ', x) || direction
       WHEN type IN ('type','hotkey') THEN type || ' ''' || text || '''' ELSE type END AS log FROM steps""")
def _(s, sf):
    return D.steps(s, sf).select("n", A.describe_for_history("action").alias("history"), A.describe_for_log("action").alias("log"))


@query("step_status_p29_x21", with_(D.STEPS_SQL) + """SELECT n, CASE WHEN NOT ok THEN '失败：' || error WHEN changed = false THEN '界面无变化' WHEN changed THEN '界面已变化' ELSE 'ok' END AS log,
  CASE WHEN NOT ok THEN '失败：' || error WHEN changed = false THEN '执行了，但界面没有变化，很可能没点中' ELSE '成功' END AS history FROM steps""")
def _(s, sf):
    return D.steps(s, sf).select("n", A.step_status("ok", "changed", "error").alias("log"), A.history_status("ok", "changed", "error").alias("history"))


@query("render_elements_p27", with_(D.ELEMENTS_SQL) + """, lines AS (SELECT screen_id, id, trim(text) = '' AS unnamed, '  [' || id || '] ' || CASE WHEN trim(text) = '' THEN '（图标，未识别出文字）' ELSE text END
  || printf('  (位置 %.2f, %.2f)', (x1 + x2) / 2, (y1 + y2) / 2) AS line FROM elements WHERE trim(text) <> '' OR source = 'cv')
SELECT o_orderkey AS screen_id, coalesce(string_agg(line, chr(10) ORDER BY unnamed, id), '  （没有识别到文字元素）') AS listing FROM orders LEFT JOIN lines ON screen_id = o_orderkey GROUP BY 1""")
def _(s, sf):
    per = screen_lists(D.elements(s, sf))
    o = D.table(s, sf, "orders").select(F.col("o_orderkey").alias("screen_id"))
    return o.join(per, "screen_id", "left").select("screen_id", A.render_elements(select_array_with_quota("elements", 60)).alias("listing"))


@query("render_prompts_p30", """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Do ' || text || '!' || chr(10) || turn ELSE 'Plan {x}: ' || turn || ' ' || text END AS prompt FROM conversations""")
def _(s, sf):
    c = D.table(s, sf, "conversations").withColumn("variant", F.when(F.col("role") == "user", "base").otherwise("plan"))
    return render_prompts(c, {"instruction": "text", "turn": "turn"}, templates={
        "base": "Do {instruction}!\n{turn}", "plan": "Plan {{x}}: {turn} {instruction}"}).select("conv_id", "turn", "prompt")


@query("clean_plan_p34_u8", """WITH w AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x, E' \\n')), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[:8], '|') AS plan FROM w""")
def _(s, sf):
    return D.table(s, sf, "conversations").select("conv_id", "turn", F.array_join(A.clean_plan(F.split("text", " ")), "|").alias("plan"))


@query("repair_keyboard_target_p35", with_(D.STEPS_SQL) + """SELECT n, CASE WHEN type IN ('type','hotkey') AND trim(text) = '' AND k % 8 <> 0 THEN 'target ' || k ELSE text END AS text FROM steps""")
def _(s, sf):
    target = F.when(F.col("k") % 8 == 0, " ").otherwise(F.concat(F.lit(" target "), F.col("k").cast("string"), F.lit(" ")))
    return D.steps(s, sf).select("n", A.repair_keyboard_target(F.col("action.type"), F.col("action.text"), target).alias("text"))


@query("acting_instruction_p36", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE text || chr(10) || '当前子任务：' || role END AS instruction FROM conversations""")
def _(s, sf):
    sub = F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role"))
    return D.table(s, sf, "conversations").select("conv_id", "turn", T.acting_instruction("text", sub).alias("instruction"))


@query("select_array_with_quota_t6", with_(D.ELEMENTS_SQL) + """, k AS (SELECT *, trim(text) <> '' AS named FROM elements WHERE trim(text) <> '' OR source = 'cv'),
c AS (SELECT *, row_number() OVER (PARTITION BY screen_id, named ORDER BY id) AS rn, count(*) FILTER (WHERE named) OVER (PARTITION BY screen_id) AS a,
        count(*) FILTER (WHERE NOT named) OVER (PARTITION BY screen_id) AS b FROM k),
q AS (SELECT *, least(least(greatest(2, 5 - a), 5), b) AS keep FROM c)
SELECT screen_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY NOT named, rn) AS ids FROM q WHERE CASE WHEN named THEN rn <= least(a, 5 - keep) ELSE rn <= keep END GROUP BY screen_id""")
def _(s, sf):
    per = screen_lists(D.elements(s, sf), limit=5, name="e")
    ids = F.transform(select_array_with_quota("e", 5, 16), lambda x: x["id"].cast("string"))
    return per.select("screen_id", F.array_join(ids, ",").alias("ids")).filter("ids <> ''")


# --- texts ------------------------------------------------------------------------

@query("parse_operation_p20", """SELECT event_id, CASE k % 6 WHEN 0 THEN 'CLICK' WHEN 1 THEN 'TYPE' WHEN 5 THEN 'HOVER' ELSE '' END AS op, CASE k % 6 WHEN 0 THEN 'v' || k WHEN 5 THEN event_type ELSE '' END AS value
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def _(s, sf):
    k = D.number_in()
    op = (F.when(k % 6 == 0, F.concat(F.lit('{"original_op":"CLICK","op":"X","value":"v'), k.cast("string"), F.lit('"}')))
          .when(k % 6 == 1, '{"op":"TYPE","value":null}').when(k % 6 == 2, "{bad").when(k % 6 == 3, "")
          .when(k % 6 == 5, F.concat(F.lit('{"original_op":"","op":"HOVER","value":"'), F.col("event_type"), F.lit('"}'))))
    return D.table(s, sf, "events").select("event_id", T.parse_operation(op).alias("o")).select("event_id", "o.op", "o.value")


TITLE = r"(?s)<title>(.*?)</title>"


@query("describe_target_p21", r"""WITH p AS (SELECT page_id, url, trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')) AS title FROM pages)
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN CASE WHEN page_id % 8 = 0 THEN trim(url) ELSE '' END ELSE trim(split_part(title, ' -> ', 1)) END AS label FROM p""")
def _(s, sf):
    title = F.when(F.col("page_id") % 4 != 0, F.regexp_extract("html", TITLE, 1)).otherwise("")
    rep = F.concat(F.lit("[heading]  "), title, F.lit(" -> CLICK"))
    alt = F.when(F.col("page_id") % 8 == 0, F.col("url"))
    return D.table(s, sf, "pages").select("page_id", T.describe_target(rep, F.lit(None).cast("string"), F.lit(""), alt).alias("label"))


@query("extract_subtask_p22", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role || ' ' || turn WHEN 1 THEN 'second ' || turn ELSE '' END AS subtask FROM conversations")
def _(s, sf):
    t = F.col("turn") % 3
    zh = F.when(t == 0, F.concat("text", F.lit("\n现在的子任务是“"), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("”。"), "text")).otherwise(F.col("text"))
    en = F.when(t != 2, F.concat("text", F.lit("\n现在的子任务是 second "), F.col("turn").cast("string"), F.lit("\n"), "text"))
    return D.table(s, sf, "conversations").select("conv_id", "turn", T.extract_subtask(zh, en).alias("subtask"))


@query("prose_before_code_p23", """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN trim(text, E' \\n\\t') WHEN 1 THEN trim(text, E' \\n\\t') WHEN 2 THEN '' ELSE trim(text, E' \\n\\t') || ' (x)' END AS prose FROM conversations""")
def _(s, sf):
    t = F.col("turn") % 4
    edited = (F.when(t == 0, F.concat("text", F.lit("，因此，下一步操作应该是：\n```json\n[1, 2]\n```")))
              .when(t == 1, F.concat("text", F.lit(" 下一步的操作应该是: [1, 2]"))).when(t == 2, F.col("text"))
              .otherwise(F.concat("text", F.lit(" (x) ```[]``` rest"))))
    return D.table(s, sf, "conversations").select("conv_id", "turn", T.prose_before_code(edited).alias("prose"))


@query("first_nonempty_p24_x2", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN text ELSE '' END AS instruction FROM conversations")
def _(s, sf):
    t = F.col("turn") % 3
    return D.table(s, sf, "conversations").select("conv_id", "turn", T.first_nonempty(
        F.when(t == 0, F.col("role")).when(t == 1, ""), F.when(t != 2, F.col("text"))).alias("instruction"))


@query("safe_name_p31", r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(substr(url, 1, 20), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' .'), ''), 'unnamed') AS name,
 substr(regexp_replace(url, '[^\w.-]', '_', 'g'), 1, 32) AS stem FROM pages""")
def _(s, sf):
    return D.table(s, sf, "pages").select("page_id", T.safe_name("url").alias("name"), T.safe_stem("url").alias("stem"))


@query("strip_reasoning_q16", """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN trim(text, E' \\n') WHEN 1 THEN '' ELSE 'ok' END AS answer FROM conversations""")
def _(s, sf):
    t = F.col("turn") % 3
    raw = (F.when(t == 0, F.concat(F.lit("<think>a</think> b <think>"), "text", F.lit("</think>"), "text"))
           .when(t == 1, F.concat(F.lit("<think>\n"), "text")).otherwise(F.concat(F.lit("ok <think>"), "text")))
    return D.table(s, sf, "conversations").select("conv_id", "turn", T.strip_reasoning(raw).alias("answer"))


@query("classify_by_rules_p26", "SELECT doc_id, CASE " + " ".join(
    f"WHEN {' OR '.join(f'''contains(lower(text), '{w}')''' for w in words)} THEN '{name}'" for name, words in V.APP_RULES)
    + f" ELSE '{V.DEFAULT_APP}' END AS app FROM documents")
def _(s, sf):
    return D.table(s, sf, "documents").select("doc_id", N.classify_by_rules("text").alias("app"))


@query("classify_custom_rules_p26", """SELECT doc_id, CASE WHEN contains(lower(text), ' the ') OR contains(lower(text), ' and ') THEN 'a' WHEN contains(lower(text), ' der ') OR contains(lower(text), ' le ') THEN 'b' ELSE 'c' END AS app FROM documents""")
def _(s, sf):
    return D.table(s, sf, "documents").select("doc_id", N.classify_by_rules("text", (("a", (" the ", " and ")), ("b", (" der ", " le "))), "c").alias("app"))


@query("to_grounding_p14", """SELECT 'parts' AS source, p_partkey AS index, p_name AS instruction, round(CAST(p_size AS DOUBLE) / 100 + 0.05, 6) AS x, 'desktop' AS platform,
 CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS element_type FROM part""")
def _(s, sf):
    from ..functions.geometry import box
    d = D.table(s, sf, "part").select(F.col("p_partkey").alias("index"), F.col("p_name").alias("instruction"),
                                      box(F.col("p_size") / 100.0, F.lit(0.0), F.col("p_size") / 100.0 + 0.1, F.lit(0.2)).alias("bbox"),
                                      F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise("").alias("data_type"), F.col("p_brand").alias("type"))
    return N.to_grounding(d, "parts").select("source", "index", "instruction", r("point.x", "x"), "platform", "element_type")


@query("steps_to_tasks_a3", """SELECT conv_id, arg_min(role, turn) AS role, len(arg_min(string_split(text, '. '), turn)) AS n_steps, array_to_string(arg_min(string_split(text, '. '), turn), '|') AS steps FROM conversations GROUP BY conv_id""")
def _(s, sf):
    c = D.table(s, sf, "conversations").withColumn("all_steps", F.split("text", r"\. "))
    return N.steps_to_tasks(c, "conv_id", "turn", ["role"]).select("conv_id", "role", F.col("n_steps").cast("long").alias("n_steps"), F.array_join("steps", "|").alias("steps"))


# --- quality rules ----------------------------------------------------------------

@query("require_assets_q1", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND n_chars <> 0")
def _(s, sf):
    return N.require_assets(D.table(s, sf, "documents").select("doc_id", "n_chars"), D.table(s, sf, "labels"), "doc_id", "n_chars").select("doc_id")


@query("mark_negative_q2", "SELECT page_id, contains(url, 'page=2') OR contains(url, '#top') AS negative FROM pages")
def _(s, sf):
    return N.mark_negative(D.table(s, sf, "pages"), "url", ("page=2", "#top")).select("page_id", "negative")


@query("only_platforms_q3", "SELECT doc_id FROM documents WHERE lang IN ('de', 'fr')")
def _(s, sf):
    return N.only_platforms(D.table(s, sf, "documents"), ("de", "fr"), "lang").select("doc_id")


@query("reject_cascade_q4", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars > 20000 THEN 'long' WHEN contains(text, '@') THEN 'address' WHEN lang <> 'en' THEN 'language' ELSE 'kept' END AS reason FROM documents) GROUP BY reason""")
def _(s, sf):
    d = Q.reject_cascade(D.table(s, sf, "documents"), [
        ("short", F.col("n_chars") < 200), ("long", F.col("n_chars") > 20000), ("address", F.col("text").contains("@")), ("language", F.col("lang") != "en")])
    return d.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("only_kinds_q6", with_(D.SAMPLES_SQL) + "SELECT ord, kind FROM samples WHERE kind IN ('plan', 'action')")
def _(s, sf):
    return Q.only_kinds(D.samples(s, sf), ("plan", "action")).select("ord", "kind")


TOK = "CAST(ceil((length(lang) + length(text)) / 4.0) AS BIGINT) + least(1280, (n_chars * 600) // 784)"


@query("length_filter_q7_f1", f"SELECT doc_id, {TOK} AS tokens FROM documents WHERE {TOK} <= 2048")
def _(s, sf):
    d = D.table(s, sf, "documents")
    tokens = Q.estimate_tokens("lang", "text", "n_chars", F.lit(600), 1280)
    return Q.length_filter(d.withColumn("tokens", tokens), F.col("tokens"), 2048)[0].select("doc_id", "tokens")


@query("length_dropped_q7", f"SELECT count(*) FILTER (WHERE {TOK} > 2048) AS dropped FROM documents")
def _(s, sf):
    return Q.length_filter(D.table(s, sf, "documents"), Q.estimate_tokens("lang", "text", "n_chars", F.lit(600), 1280), 2048)[1]


@query("fit_limit_q8", """SELECT doc_id, CAST(CASE """ + " ".join(f"WHEN ceil(length(text) / 4.0) + {k} * 20 <= 1360 THEN {k}" for k in V.ELEMENT_STEPS) + """ ELSE 0 END AS INT) AS elements_shown FROM documents""")
def _(s, sf):
    return D.table(s, sf, "documents").select("doc_id", Q.fit_limit(lambda k: approx_tokens("text") + k * 20).alias("elements_shown"))


@query("screen_content_q9", r"""WITH t AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN text || '; RM -rf /' WHEN 1 THEN 'x' || chr(10) || ' shutdown -s ' || text WHEN 2 THEN 'ok shutdown ' || text ELSE text END AS typed FROM documents),
sg AS (SELECT doc_id, trim(unnest(regexp_split_to_array(lower(typed), '[\n\r;&|]+')), E' \t\n\r') AS seg FROM t),
hits AS (SELECT doc_id, min(CASE WHEN regexp_matches(seg, '^format\s+[a-z]:') THEN 1 WHEN regexp_matches(seg, '^rm\s+-[rf]{1,2}\b') THEN 2 WHEN regexp_matches(seg, '^del\s+/[fsq]\b') THEN 3
  WHEN regexp_matches(seg, '^rd\s+/s\b') THEN 4 WHEN regexp_matches(seg, '^shutdown\b') THEN 5 WHEN regexp_matches(seg, '^diskpart\b') THEN 6 WHEN regexp_matches(seg, '^mkfs\b') THEN 7 END) AS h FROM sg GROUP BY doc_id)
SELECT doc_id, h IS NOT NULL AS blocked FROM documents LEFT JOIN hits USING (doc_id)""")
def _(s, sf):
    m = F.col("doc_id") % 7
    typed = (F.when(m == 0, F.concat("text", F.lit("; RM -rf /"))).when(m == 1, F.concat(F.lit("x\n shutdown -s "), "text"))
             .when(m == 2, F.concat(F.lit("ok shutdown "), "text")).otherwise(F.col("text")))
    d = D.table(s, sf, "documents").select("doc_id", F.lit("type").alias("type"), typed.alias("text"))
    return Q.screen_content(d).select("doc_id", F.col("blocked").isNotNull().alias("blocked"))


@query("screen_hotkeys_q9", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) % 12 IN (6, 9) AS blocked FROM events""")
def _(s, sf):
    combo = F.get(F.array(*[F.lit(c) for c, _ in COMBOS]), D.number_in() % 12)
    d = D.table(s, sf, "events").select("event_id", F.lit("hotkey").alias("type"), combo.alias("text"))
    return Q.screen_content(d).select("event_id", F.col("blocked").isNotNull().alias("blocked"))


@query("length_compliance_q11", """SELECT lang, count(*) AS n, count(*) FILTER (WHERE length(text) > 5000) AS over, round(avg(CAST(length(text) > 5000 AS DOUBLE)), 6) AS over_share,
 avg(CAST(length(text) > 5000 AS DOUBLE)) <= 0.01 AS complies FROM documents GROUP BY lang""")
def _(s, sf):
    return Q.length_compliance(D.table(s, sf, "documents"), F.length("text"), 5000, ("lang",)).select("lang", "n", "over", r("over_share"), "complies")


# --- model outputs ----------------------------------------------------------------

OUT_SQL = D.STEPS_SQL + """,
outs AS (SELECT n, run, type, x, text, direction, k, k % 9 AS m FROM steps),
parsed AS (SELECT *, CASE WHEN m = 0 THEN 'unparseable' WHEN m = 1 THEN 'unparseable' WHEN m = 2 THEN 'type_missing' WHEN m = 3 THEN 'unknown_type' WHEN m = 4 AND x IS NOT NULL THEN 'range:point' END AS reject_reason FROM outs)"""


def raw_outputs(s, sf):
    """Model answers around a step's action: prose, fences, broken and odd JSON."""
    m, a = F.col("k") % 9, F.col("action")
    js = A.action_to_json("action")
    body = (F.when(m == 2, F.regexp_replace(js, '"type":"[a-z]+",?', "")).when(m == 3, F.regexp_replace(js, '"type":"[a-z]+"', '"type":"fly"'))
            .when(m == 4, F.regexp_replace(js, r'"point":\[', '"point":[3')).otherwise(js))
    whole = F.concat(F.lit('{"thought": "点 {here}", "action": '), body, F.lit("}"))
    text = (F.when(m == 0, F.lit("no idea {at all")).when(m == 1, '{"action": "click"}')
            .when(m == 5, F.concat(F.lit("I think {this} is it:\n```json\n"), whole, F.lit("\n```")))
            .when(m == 6, F.concat(F.lit("<think>{}</think>"), whole)).otherwise(F.concat(whole, F.lit(" done"))))
    return D.steps(s, sf).select("n", "run", a["type"].alias("gt"), text.alias("raw"))


@query("parse_outputs_q12_f4", with_(OUT_SQL) + """SELECT n, CASE WHEN m = 6 THEN 'unparseable' ELSE reject_reason END AS reject_reason,
  CASE WHEN reject_reason IS NULL AND m <> 6 THEN type END AS kind, CASE WHEN reject_reason IS NULL AND m <> 6 THEN round(x, 12) END AS x,
  CASE WHEN reject_reason IS NULL AND m <> 6 THEN text END AS text, CASE WHEN reject_reason IS NULL AND m <> 6 THEN direction END AS direction FROM parsed""")
def _(s, sf):
    return O.parse_outputs(raw_outputs(s, sf)).select("n", "reject_reason", *action_cols("parsed"))


@query("output_reasons_q12", with_(OUT_SQL) + """SELECT coalesce(CASE WHEN m = 6 THEN 'unparseable' ELSE reject_reason END, 'accepted') AS reason, count(*) AS n FROM parsed GROUP BY 1""")
def _(s, sf):
    return O.reason_counts(O.parse_outputs(raw_outputs(s, sf)))


@query("output_profile_a28", with_(OUT_SQL) + """SELECT count(*) AS n, count(*) FILTER (WHERE m = 5) AS fenced, count(*) FILTER (WHERE m = 6) AS reasoning, count(*) FILTER (WHERE m NOT IN (0, 1)) AS thought_cjk,
 count(*) FILTER (WHERE m <> 0) AS parses, count(*) FILTER (WHERE m NOT IN (0, 1, 6)) AS has_action, count(*) FILTER (WHERE m NOT IN (0, 1, 2, 3, 6)) AS type_right FROM outs""")
def _(s, sf):
    d = O.read_outputs(raw_outputs(s, sf)).withColumn("tokens", approx_tokens("raw")).withColumn("pred", F.col("out.type"))
    return M.output_profile(d).select("n", "fenced", "reasoning", "thought_cjk", "parses", "has_action", "type_right")


@query("parse_plans_q13", """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'open it|close ' || turn WHEN 1 THEN role || '|b' WHEN 2 THEN 'wrapped' WHEN 3 THEN '' ELSE '1|2|3|4|5|6|7|8' END AS subtasks FROM conversations""")
def _(s, sf):
    t, txt = F.col("turn") % 5, F.col("text")
    raw = (F.when(t == 0, F.concat(txt, F.lit(' ["open it", "close '), F.col("turn").cast("string"), F.lit('", " "] '), txt))
           .when(t == 1, F.concat(txt, F.lit('[{"action": "'), "role", F.lit('"}, {"zzz": "b"}, {}]')))
           .when(t == 2, F.concat(txt, F.lit('{"plan": ["wrapped"]}'))).when(t == 3, F.concat(txt, F.lit("[not json] ["), txt))
           .otherwise("[1,2,3,4,5,6,7,8,9,10]"))
    return O.parse_plans(D.table(s, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))).select("conv_id", "turn", F.array_join("subtasks", "|").alias("subtasks"))


@query("parse_reflections_q14", """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'need_reformulate' WHEN 1 THEN 'sub_task_success' ELSE 'need_retry' END AS situation, CASE turn % 4 WHEN 0 THEN role ELSE '' END AS advice FROM conversations""")
def _(s, sf):
    t, txt = F.col("turn") % 4, F.col("text")
    raw = (F.when(t == 0, F.concat(txt, F.lit('{"situation": " need_reformulate", "advice": "'), "role", F.lit('"}')))
           .when(t == 1, F.concat(txt, F.lit(" sub_task_success "), txt)).when(t == 2, F.concat(F.lit('{"situation": "maybe"} '), txt)).otherwise(txt))
    return O.parse_reflections(D.table(s, sf, "conversations").select("conv_id", "turn", "role", raw.alias("raw"))).select("conv_id", "turn", "situation", "advice")


@query("parse_boxes_q15", """WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % 6 AS m FROM events)
SELECT event_id, CASE m WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN k + 0.5 WHEN 3 THEN -k END::DOUBLE AS x1, CASE m WHEN 0 THEN k + 9 WHEN 1 THEN 40 WHEN 2 THEN 4 WHEN 3 THEN 1000 END::DOUBLE AS y2 FROM k""")
def _(s, sf):
    k = D.number_in().cast("string")
    m = F.col("event_id") % 6
    raw = (F.when(m == 0, F.concat(F.lit('{"bbox_2d": ['), k, F.lit(", 2, 3, "), (D.number_in() + 9).cast("string"), F.lit("]}")))
           .when(m == 1, F.concat(F.lit("<|box_start|>("), k, F.lit(",20),(30, 40)<|box_end|>")))
           .when(m == 2, F.concat(F.lit("box [ "), k, F.lit(".5 , 2, 3,4 ]"))).when(m == 3, F.concat(F.lit('"bbox_2d":[-'), k, F.lit(",0,1,1e3]")))
           .when(m == 4, F.concat(F.lit("[1, 2, "), k, F.lit("]"))).otherwise(k))
    return D.table(s, sf, "events").select("event_id", O.parse_box(raw).alias("b")).select("event_id", "b.x1", "b.y2")


@query("parse_points_q15", """WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % 4 AS m FROM events)
SELECT event_id, CASE WHEN m IN (0, 1) THEN round(k / 100.0, 6) END::DOUBLE AS x, CASE m WHEN 0 THEN 0.25 WHEN 1 THEN 1 END::DOUBLE AS y FROM k""")
def _(s, sf):
    k = (D.number_in() / 100.0).cast("string")
    m = F.col("event_id") % 4
    raw = (F.when(m == 0, F.concat(F.lit('{"point": ['), k, F.lit(", 0.25]}"))).when(m == 1, F.concat(F.lit("at ["), k, F.lit(", 1 ]")))
           .when(m == 2, F.concat(F.lit('{"point": [512, '), k, F.lit("]}"))).otherwise(F.concat(F.lit('"point": ['), k, F.lit(", 0.1, 0.2]"))))
    return D.table(s, sf, "events").select("event_id", O.parse_point(raw).alias("p")).select("event_id", "p.x", "p.y")
