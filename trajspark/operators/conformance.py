"""Model outputs to actions, plans, verdicts, boxes and points, or a reason why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.actions import action, action_violations, canonical_type, repair_keyboard_target
from ..functions.geometry import auto_unit, point
from ..functions.strings import is_blank, let, strip
from ..functions.udfs import first_json_object, json_arrays
from .matching import resolve_element_ids

OUTPUT = ("struct<thought:string,action:struct<type:string,point:array<double>,point2:array<double>,"
          "text:string,direction:string,element:string,target:string>>")


def _pair(p: Column) -> Column:
    return F.when(F.size(p) == 2, F.struct(p[0].alias("x"), p[1].alias("y")))


def malformed_point(json: Column, path: str) -> Column:
    """Whether a JSON text has something at ``path`` that is no list of two numbers."""
    number = r"-?\d[\d.eE+-]*"
    return F.coalesce(~F.get_json_object(json, path).rlike(rf"^\[\s*{number}\s*,\s*{number}\s*\]$"), F.lit(False))


def _read_outputs(df: DataFrame, raw: str) -> DataFrame:
    d = df.withColumn("_json", first_json_object(F.col(raw)))
    d = d.withColumn("_o", F.from_json("_json", OUTPUT))
    body = F.get_json_object("_json", "$.action")
    has = F.coalesce(strip(body).startswith("{"), F.lit(False))
    return (d.withColumn("has_json", F.col("_json").isNotNull()).withColumn("has_action", has)
            .withColumn("out_thought", F.coalesce(F.col("_o.thought"), F.lit("")))
            .withColumn("out", F.when(has, F.col("_o.action"))).drop("_o"))


def read_outputs(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add has_json, has_action, thought and the loose action fields of the first JSON object."""
    return _read_outputs(df, raw).drop("_json")


def parse_outputs(df: DataFrame, raw: str = "raw", elements: DataFrame | None = None, screen: str = "screen_id",
                  model_w: Column | None = None, model_h: Column | None = None,
                  repair_target: bool = False) -> DataFrame:
    """Add ``parsed`` (action struct) and ``reject_reason``; exactly one of the two is set.

    An element id is looked up on its screen; coordinates above 1 are divided by the model's
    size; with ``repair_target`` keyboard actions may carry their text in ``target``.
    """
    d = _read_outputs(df, raw).withColumn("element", F.col("out.element"))
    w = model_w if model_w is not None else F.lit(None).cast("double")
    h = model_h if model_h is not None else F.lit(None).cast("double")
    asked = F.col("element").isNotNull()
    if elements is not None:
        d = resolve_element_ids(d, elements, screen).withColumnRenamed("point", "element_point")
    else:
        d = d.withColumn("element_point", F.lit(None).cast("struct<x:double,y:double>")).withColumn(
            "reject_reason", F.lit("element_unknown"))
    d = d.withColumn("reject_reason", F.when(asked, F.col("reject_reason")))
    o = F.col("out")
    text = repair_keyboard_target(o["type"], o["text"], o["target"]) if repair_target else o["text"]
    # the centre of an element takes the place of whatever point came with it
    bad_shape = (~asked & malformed_point(F.col("_json"), "$.action.point")) | malformed_point(F.col("_json"), "$.action.point2")
    spot = F.coalesce(F.col("element_point"), _pair(o["point"]))
    act = action(canonical_type(o["type"]), auto_unit(spot, w, h), auto_unit(_pair(o["point2"]), w, h),
                 text, o["direction"], F.col("out_thought"))
    d = d.withColumn("_act", act)
    faults = action_violations("_act")
    why = (F.when(~F.col("has_action"), "unparseable").when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
           .when(o["type"].isNull(), "type_missing").when(F.coalesce(bad_shape, F.lit(False)), "bad_point")
           .when(F.size(faults) > 0, F.try_element_at(faults, F.lit(1))))
    return (d.withColumn("reject_reason", why)
            .withColumn("parsed", F.when(F.col("reject_reason").isNull(), F.col("_act")))
            .drop("_act", "_json", "element", "element_id", "element_point"))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _text_of(v: Column) -> Column:
    """The stripped text of a variant that is a string, else an empty one."""
    return F.when(_kind(v) == "STRING", F.coalesce(strip(F.try_variant_get(v, "$", "string")), F.lit(""))).otherwise("")


def plan_item(v: Column, keys=V.SUBTASK_KEYS) -> Column:
    """What a list member says: a text, a number, or one text of an object, by the names that are known or as its only one."""
    members = F.map_filter(F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: _text_of(x)), lambda _, t: t != "")
    named = F.coalesce(*[F.try_element_at(members, F.lit(k)) for k in keys])
    only = F.when(F.size(members) == 1, F.try_element_at(F.map_values(members), F.lit(1)))
    kind = _kind(v)
    return (F.when(kind == "STRING", _text_of(v)).when(kind == "BIGINT", F.try_variant_get(v, "$", "string"))
            .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
            .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.try_variant_get(v, "$", "double").cast("string"))
            .when(kind.startswith("OBJECT"), F.coalesce(named, only, F.lit(""))).otherwise(""))


def plan_list(raw, limit: int = V.MAX_SUBTASKS) -> Column:
    """The items of the first list of a text that has any, at most ``limit``; without one an empty array."""
    def items(json: Column) -> Column:
        members = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
        return F.slice(F.filter(F.transform(members, lambda v: plan_item(v)), lambda t: t != ""), 1, limit)

    lists = F.transform(json_arrays(F.col(raw) if isinstance(raw, str) else raw), items)
    return F.coalesce(F.try_element_at(F.filter(lists, lambda x: F.size(x) > 0), F.lit(1)), F.array().cast("array<string>"))


def parse_plans(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``subtasks``: the items of the first usable list, empty if there is none."""
    return df.withColumn("subtasks", plan_list(raw))


def parse_reflections(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``situation`` and ``advice``: from JSON, else a bare word, else retry."""
    j = F.from_json(first_json_object(F.col(raw)), "struct<situation:string,advice:string>")
    d = df.withColumn("_j", j)
    named = strip(F.col("_j.situation"))
    known = F.coalesce(named.isin(*V.SITUATIONS), F.lit(False))
    word = None
    for s in V.SITUATIONS:
        hit = F.col(raw).contains(s)
        word = F.when(hit, s) if word is None else word.when(hit, s)
    return (d.withColumn("situation", F.when(known, named).otherwise(word.otherwise(V.RETRY)))
            .withColumn("advice", F.when(known, F.coalesce(F.col("_j.advice"), F.lit(""))).otherwise("")).drop("_j"))


def _numbers(text: Column) -> Column:
    """All numbers behind the key, if there is one."""
    text = F.regexp_replace(text, r'^"\w+"', "")
    return F.transform(F.regexp_extract_all(text, F.lit(V.NUMBER_FORMAT), 0), lambda s: s.cast("double"))


def _first_match(text: Column, *patterns: str) -> Column:
    """What the first pattern that is found at all matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns])


def parse_box(raw) -> Column:
    """A box in one of its three spellings as ``struct(x1,y1,x2,y2)``, else null."""
    t = F.col(raw) if isinstance(raw, str) else raw
    body = _first_match(t, *V.BOX_FORMATS)
    return let({"n": _numbers(body)}, lambda v: F.when(F.size(v["n"]) >= 4, F.struct(
        *[v["n"][i].alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))])))


def parse_point(raw) -> Column:
    """A point given as two shares of the screen, else null."""
    t = F.col(raw) if isinstance(raw, str) else raw
    body = _first_match(t, *V.POINT_FORMATS)
    return let({"n": _numbers(body)}, lambda v: F.when(
        (F.size(v["n"]) == 2) & F.forall(v["n"], lambda x: x.between(0, 1)), point(v["n"][0], v["n"][1])))


def reason_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


def named_target(out: str = "out") -> Column:
    """The control an answer names, null if it names none."""
    t = F.col(out)["target"]
    return F.when(~is_blank(t), strip(t))
