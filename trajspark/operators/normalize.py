"""Raw session documents and web datasets to normalised records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import geometry as G
from ..functions.actions import action, canonical_type, literal_map, normalize_hotkey, quoted
from ..functions.strings import (describe_target, extract_subtask, first_nonempty, nonempty, parse_operation,
                                 prose_before_code, strip)
from .counts import value_counts

RAW_ACTION = ("struct<action_type:string,mouse_action_type:string,mouse_button:string,"
              "mouse_position:struct<width:double,height:double>,keyboard_action_type:string,"
              "keyboard_text:string,keyboard_key:string,element:string,situation:string,advice:string>")
DOCUMENT_SCHEMA = ("session_id string, video_width int, video_height int, saved_image_name string, "
                   "LLM_response_editer string, task_prompt string, task_prompt_en string, task_prompt_zh string, "
                   f"send_prompt string, send_prompt_zh string, actions array<{RAW_ACTION}>, _corrupt_record string")


def key_combo(key) -> Column:
    """Key names joined by plus; the source holds one name or a JSON list of names."""
    k = F.col(key) if isinstance(key, str) else key
    names = F.when(k.startswith("["), F.from_json(k, "array<string>")).otherwise(F.array(k))
    return F.array_join(F.filter(names, lambda x: nonempty(x).isNotNull()), "+")


def _reason_and_action(raw, w, h, known_keys) -> tuple[Column, Column]:
    """Why a raw action is rejected (null: it is not), and the action that it is if it is not."""
    r = F.col(raw) if isinstance(raw, str) else raw
    kind, mouse, board = r["action_type"], r["mouse_action_type"], r["keyboard_action_type"]
    is_mouse, is_key = kind == "MouseAction", kind == "KeyboardAction"
    known_mouse = mouse.isin(*V.MOUSE_ACTIONS)
    scroll = mouse.isin("scroll_up", "scroll_down")
    pos = r["mouse_position"]
    spot = G.to_unit(pos["width"], pos["height"], w, h)
    combo = key_combo(r["keyboard_key"])
    bad_key = F.size(normalize_hotkey(combo, known_keys)["unknown"]) > 0
    why = (F.when(r.isNull(), F.lit(V.REASON_NOT_OBJECT))
           .when(kind == "WaitAction", None)
           .when(is_mouse & ~F.coalesce(known_mouse, F.lit(False)), F.concat(F.lit("mouse:"), F.coalesce(mouse, F.lit("None"))))
           .when(is_mouse & scroll, None)
           .when(is_mouse & pos.isNull(), V.REASON_NO_POSITION)
           .when(is_mouse & spot.isNull(), V.REASON_OUT_OF_BOUNDS)
           .when(is_mouse, None)
           .when(is_key & (board == "text") & r["keyboard_text"].isNull(), V.REASON_NO_TEXT)
           .when(is_key & (board == "text"), None)
           .when(is_key & (board == "press") & (F.coalesce(combo, F.lit("")) == ""), V.REASON_NO_KEY)
           .when(is_key & (board == "press") & bad_key, F.concat(F.lit(V.REASON_BAD_KEY + " "), quoted(combo)))
           .when(is_key & (board == "press"), None)
           .when(is_key, F.concat(F.lit("keyboard:"), F.coalesce(board, F.lit("None"))))
           .otherwise(F.concat(F.lit(V.REASON_OTHER + ":"), F.coalesce(kind, F.lit("None")))))
    mapped = F.try_element_at(literal_map(V.MOUSE_ACTIONS), mouse)
    mouse_type = F.when((mapped == "click") & (r["mouse_button"] == "right"), "right_single").otherwise(mapped)
    type_ = (F.when(kind == "WaitAction", F.lit("wait")).when(is_mouse, mouse_type)
             .when(board == "text", F.lit("type")).otherwise(F.lit("hotkey")))
    centre = G.point(F.lit(V.SCROLL_POINT[0]), F.lit(V.SCROLL_POINT[1]))
    act = action(type_, point=F.when(is_mouse & scroll, centre).when(is_mouse, spot),
                 text=F.when(is_key & (board == "text"), r["keyboard_text"]).when(is_key, combo),
                 direction=F.when(is_mouse & scroll, F.when(mouse == "scroll_up", "up").otherwise("down")))
    return why, act


def normalize_action(raw, w, h, known_keys=V.KNOWN_KEYS) -> Column:
    """``struct(action, reject_reason)`` of one raw action; exactly one of the two is set."""
    why, act = _reason_and_action(raw, w, h, known_keys)
    return F.struct(F.when(why.isNull(), act).alias("action"), why.alias("reject_reason"))


def normalize_actions(df: DataFrame, raw: str = "raw", w: str = "width", h: str = "height",
                      known_keys=V.KNOWN_KEYS) -> DataFrame:
    """Add ``action`` and ``reject_reason``."""
    why, act = _reason_and_action(raw, w, h, known_keys)
    # the reason is a column first and the action reads it: fields of one struct would each spell the keys again
    d = df.withColumn("_why", why)
    return d.withColumn("action", F.when(F.col("_why").isNull(), act)).withColumn("reject_reason", F.col("_why")).drop("_why")


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNull())


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNotNull())


def mark_negative(df: DataFrame, file_name, markers=V.NEGATIVE_MARKERS, name: str = "negative") -> DataFrame:
    """Flag deliberate negatives by their file name. They still give actions, but no plan, verdict or thought."""
    f = F.col(file_name) if isinstance(file_name, str) else file_name
    flag = F.lit(False)
    for m in markers:
        flag = flag | f.contains(m)
    return df.withColumn(name, F.coalesce(flag, F.lit(False)))


def document_facts(docs: DataFrame) -> DataFrame:
    """Instruction in both languages, sub-task and thought of each document (needs ``negative``)."""
    return (docs.withColumn("instruction", first_nonempty("task_prompt_en", "task_prompt"))
            .withColumn("instruction_zh", first_nonempty("task_prompt_zh", "task_prompt"))
            .withColumn("subtask", extract_subtask("send_prompt_zh", "send_prompt"))
            .withColumn("thought", F.when(F.col("negative"), F.lit("")).otherwise(
                prose_before_code("LLM_response_editer"))))


def explode_actions(docs: DataFrame, keep, w: str = "width", h: str = "height", known_keys=V.KNOWN_KEYS) -> DataFrame:
    """One row per raw action with its place, the action or the reason it was rejected.

    Documents without actions give no row.
    """
    rows = docs.select(*keep, w, h, F.posexplode("actions").alias("action_index", "raw")) if w not in keep else \
        docs.select(*keep, F.posexplode("actions").alias("action_index", "raw"))
    return normalize_actions(rows, "raw", w, h, known_keys)


def stage_counts(exploded: DataFrame) -> DataFrame:
    """How many raw actions of each kind there are, non-actions included."""
    return value_counts(exploded.filter(F.col("raw").isNotNull())
                        .select(F.col("raw.action_type").alias("action_type")), "action_type")


def extract_plans(docs: DataFrame, keep) -> DataFrame:
    """The plan items of a document as one ordered list; documents without one give no row."""
    items = F.transform(F.filter("actions", lambda a: a["action_type"] == "PlanAction"),
                        lambda a: strip(F.coalesce(a["element"], F.lit(""))))
    d = docs.withColumn("subtasks", F.filter(items, lambda s: s != ""))
    return d.filter((F.size("subtasks") > 0) & ~F.col("negative")).select(*keep, "subtasks")


def extract_reflections(exploded: DataFrame, situations=V.SITUATIONS) -> DataFrame:
    """Verdict rows with one of the allowed situations (needs ``negative``)."""
    s = strip(F.coalesce(F.col("raw.situation"), F.lit("")))
    ok = (F.col("raw.action_type") == "EvaluateSubTaskAction") & s.isin(*situations) & ~F.col("negative")
    return exploded.filter(ok).withColumn("situation", s).withColumn(
        "advice", strip(F.coalesce(F.col("raw.advice"), F.lit(""))))


def require_assets(df: DataFrame, inventory: DataFrame, key: str, *positive: str) -> DataFrame:
    """Rows whose file is in the inventory and whose given numbers are set."""
    d = df
    for c in positive:
        d = d.filter(F.coalesce(F.col(c), F.lit(0)) != 0)
    return d.join(inventory.select(key).distinct(), key, "left_semi")


def to_grounding(df: DataFrame, source: str, index="index", platform: str | None = "data_source",
                 element_type=("data_type", "type")) -> DataFrame:
    """One record form for grounding sources: bbox struct, point or the box's centre."""
    cols = set(df.columns)
    kinds = [c for c in element_type if c in cols]
    p = F.col("point") if "point" in cols else F.lit(None).cast("struct<x:double,y:double>")
    return df.select(
        F.lit(source).alias("source"), F.col(index).alias("index"), "instruction", "bbox",
        F.coalesce(p, G.box_center("bbox")).alias("point"),
        (F.col(platform) if platform in cols else F.lit("desktop")).alias("platform"),
        first_nonempty(*kinds).alias("element_type") if kinds else F.lit("").alias("element_type"))


def only_platforms(df: DataFrame, platforms=V.DESKTOP_PLATFORMS, column: str = "platform") -> DataFrame:
    return df.filter(F.col(column).isin(*platforms))


def web_steps(df: DataFrame) -> DataFrame:
    """Step rows of the web dataset: operation parsed, missing texts empty."""
    op = parse_operation("operation")
    texts = [first_nonempty(c).alias(n) for c, n in (
        ("confirmed_task", "task"), ("target_action_reprs", "target"), ("website", "website"),
        ("domain", "domain"), ("subdomain", "subdomain"))]
    return df.select("annotation_id", "action_uid", F.col("target_action_index").alias("step_index"),
                     op["op"].alias("operation"), op["value"].alias("value"), *texts,
                     F.coalesce("action_reprs", F.array().cast("array<string>")).alias("all_steps"))


def steps_to_tasks(steps: DataFrame, key: str, order: str, attributes, all_steps: str = "all_steps") -> DataFrame:
    """One row per task with the attributes and the step list of its first row."""
    first = F.min_by(F.struct(*attributes, F.col(all_steps).alias("steps")), F.col(order))
    return steps.groupBy(key).agg(first.alias("t")).select(
        key, *[f"t.{a}" for a in attributes], "t.steps", F.coalesce(F.size("t.steps"), F.lit(0)).alias("n_steps"))


def flatten_specs(specs: DataFrame) -> DataFrame:
    """Task specifications in flat form; missing parts become empty."""
    def empty(t):
        return F.array().cast(t)

    return specs.select(
        "task_id", F.coalesce("intent", F.lit("")).alias("instruction"),
        F.coalesce("intent_template", F.lit("")).alias("template"),
        F.col("intent_template_id").alias("template_id"),
        F.coalesce("instantiation_dict", F.create_map().cast("map<string,string>")).alias("params"),
        F.coalesce("sites", empty("array<string>")).alias("sites"),
        F.coalesce("require_login", F.lit(False)).alias("requires_login"),
        F.coalesce(F.col("eval.eval_types"), empty("array<string>")).alias("check_types"))


def classify_by_rules(text, rules=V.APP_RULES, default: str = V.DEFAULT_APP) -> Column:
    """Name of the first rule of which a word occurs in the text."""
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    out = None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


