"""Audit of a built corpus: one row per (check, split, n), zero rows included.

Checks that look at one row are a single aggregate over a single scan; only duplicates,
contradictions and overlaps shuffle, and they shuffle digests instead of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.actions import action, action_violations
from ..functions.strings import is_blank, text_key
from ..session import pin
from .conformance import malformed_point
from .splits import overlap

RESPONSE = ("struct<thought:string,action:struct<type:string,point:array<double>,point2:array<double>,"
            "text:string,direction:string,element:string,target:string>,point:array<double>,bbox_2d:array<double>>")


def shown_ids(prompt) -> Column:
    """Ids of the element list printed in a prompt."""
    return F.regexp_extract_all(F.col(prompt) if isinstance(prompt, str) else prompt, F.lit(r"(?m)^\s*\[(\d+)\]"), 1)


def _pair(p: Column) -> Column:
    # anything but two numbers becomes a point outside of the unit square, hence a violation
    return F.when(F.size(p) == 2, F.struct(p[0].alias("x"), p[1].alias("y"))).when(
        p.isNotNull(), F.struct(F.lit(-1.0).alias("x"), F.lit(-1.0).alias("y")))


def flag_samples(samples: DataFrame) -> DataFrame:
    """One boolean column per row-level check."""
    d = samples.withColumn("_r", F.from_json("response", RESPONSE))
    a = F.col("_r.action")
    keys = F.coalesce(F.json_object_keys(F.get_json_object("response", "$.action")), F.array().cast("array<string>"))
    is_action, is_box, is_plan = (F.col("kind") == k for k in ("action", "grounding", "plan"))
    has_target, has_element = F.array_contains(keys, "target"), F.array_contains(keys, "element")
    bad_target = is_blank(a["target"]) | F.arrays_overlap(keys, F.array(F.lit("point"), F.lit("element")))
    text = F.col("response")
    beyond = F.struct(F.lit(-1.0).alias("x"), F.lit(-1.0).alias("y"))
    points = [F.when(malformed_point(text, f"$.action.{p}"), beyond).otherwise(_pair(a[p])) for p in ("point", "point2")]
    act = action(a["type"], *points, a["text"], a["direction"])
    thought = F.coalesce(F.col("_r.thought"), F.lit(""))
    pt = F.col("_r.point")
    bb = [F.get("_r.bbox_2d", F.lit(i)) for i in range(4)]          # null where a number is missing
    point_bad = F.exists(pt, lambda v: ~v.between(0, 1))
    box_ok = ((bb[0] >= 0) & (bb[0] < bb[2]) & (bb[2] <= F.col("width"))
              & (bb[1] >= 0) & (bb[1] < bb[3]) & (bb[3] <= F.col("height")))
    plan = F.from_json("response", "array<string>")
    return d.select(
        "split", "kind", (is_blank("prompt") | is_blank("response")).alias("blank_field"),
        (is_action & has_target & bad_target).alias("bad_target"),
        (is_action & ~has_target & has_element
         & ~F.array_contains(shown_ids("prompt"), F.coalesce(a["element"], F.lit("")))).alias("element_not_shown"),
        (is_action & ~has_target & ~has_element & (F.size(action_violations(act)) > 0)).alias("bad_action"),
        (is_action & thought.rlike(r"\d\.\d{3,}")).alias("coordinate_in_thought"),
        (is_action & is_blank(thought)).alias("blank_thought"),
        (is_box & F.when(pt.isNotNull(), point_bad).otherwise(~F.coalesce(box_ok, F.lit(False)))).alias("bad_box"),
        (is_plan & ((F.coalesce(F.size(plan), F.lit(0)) == 0)
                    | (F.size(F.array_distinct(plan)) != F.size(plan)))).alias("bad_plan"))


ROW_CHECKS = ("blank_field", "bad_target", "element_not_shown", "bad_action", "coordinate_in_thought",
              "blank_thought", "bad_box", "bad_plan")


def row_checks(samples: DataFrame) -> DataFrame:
    g = flag_samples(samples).groupBy("split").agg(*[F.count_if(c).alias(c) for c in ROW_CHECKS])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in ROW_CHECKS]))
    return g.select("split", rows.alias("r")).select("r.check", "split", "r.n")


def duplicate_excess(samples: DataFrame, keys=("prompt", "response"), by=("split",)) -> DataFrame:
    """Rows that repeat an earlier (prompt, response) of their split."""
    return _excess(samples.select(*by, text_key(*keys).alias("_same")), by)


def _excess(digests: DataFrame, by=("split",)) -> DataFrame:
    g = digests.groupBy(*by, "_same").agg(F.count(F.lit(1)).alias("c"))
    return g.groupBy(*by).agg(F.sum(F.col("c") - 1).alias("n"))


def contradictions(samples: DataFrame, keys=("image", "prompt"), by=("split",)) -> DataFrame:
    """Inputs with more than one response: a group is mixed when two hashes of it differ.

    Only two pairs of longs are kept per group, so a group with very many rows stays small.
    """
    return _mixed(samples.select(*by, text_key(*keys).alias("_input"), *_response_hashes()), by)


def _response_hashes() -> list[Column]:
    return [F.xxhash64("response").alias("_h"), F.xxhash64(F.reverse("response")).alias("_g")]


def _mixed(digests: DataFrame, by=("split",)) -> DataFrame:
    per = digests.groupBy(*by, "_input").agg(((F.min("_h") != F.max("_h")) | (F.min("_g") != F.max("_g"))).alias("mixed"))
    return per.groupBy(*by).agg(F.count_if("mixed").alias("n"))


def kind_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split", "kind").agg(F.count(F.lit(1)).alias("n"))


def audit(samples: DataFrame, test: DataFrame | None = None, val_is_held_out: bool = True,
          text_overlap: bool = False) -> DataFrame:
    """All checks. samples: split (train/val), kind, image, prompt, response, width, height.

    The image overlap of train and val is no problem when the manifest says that val was
    trained on; it is not looked for then. ``text_overlap`` additionally looks for equal samples on both sides.
    Texts are read twice: for the row checks, and for a narrow table of digests that all other checks share.
    """
    def rows(d, check):
        return d.select(F.lit(check).alias("check"), "split", F.col("n").cast("long").alias("n"))

    def total(d, check, split):
        return d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(check).alias("check"), F.lit(split).alias("split"), "n")

    digests = pin(samples.select("split", "image", text_key("prompt", "response").alias("_same"), text_key("image", "prompt").alias("_input"),
                                 *_response_hashes()))
    train, val = (digests.filter(F.col("split") == s) for s in ("train", "val"))
    out = row_checks(samples)
    out = out.unionByName(rows(_excess(digests), "duplicate"))
    out = out.unionByName(rows(_mixed(digests), "contradiction"))
    if val_is_held_out:
        out = out.unionByName(total(overlap(train, val, "image"), "shared_image", "train+val"))
    else:
        out = out.unionByName(samples.sparkSession.createDataFrame([("shared_image", "train+val", 0)], out.schema))
    if test is not None:
        out = out.unionByName(total(overlap(digests, test, "image"), "test_leak", "test"))
    if text_overlap:
        out = out.unionByName(total(overlap(train, val, "_same"), "shared_text", "train+val"))
    return out
