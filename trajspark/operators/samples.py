"""Fine-tuning samples from steps, plans and grounding candidates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import geometry as G
from ..functions.actions import clean_plan, element_line, join_lines, render_history
from ..functions.stats import round_exact
from ..functions.strings import describe_target, is_blank, strip
from ..functions.udfs import approx_tokens, fit_rendered
from .quality import fit_limit, reject_cascade
from .selection import named_of, other_of, quota_split, take_with_quota


def fill_template(template: str, values: dict) -> Column:
    """A template with ``{placeholders}`` as one concat; values are never scanned for placeholders."""
    parts = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field:
            v = values[field]
            parts.append((F.col(v) if isinstance(v, str) else v).cast("string"))
    return F.concat(*parts)


def render_prompts(df: DataFrame, values: dict, variant: str = "variant", templates: dict = V.PROMPT_TEMPLATES,
                   name: str = "prompt") -> DataFrame:
    """Add the prompt of the row's template variant; an unknown variant is an error."""
    out = None
    for key, tpl in templates.items():
        body = fill_template(tpl, values)
        out = F.when(F.col(variant) == key, body) if out is None else out.when(F.col(variant) == key, body)
    unknown = F.raise_error(F.concat(F.lit("no prompt variant "), F.coalesce(F.col(variant), F.lit("null"))))
    return df.withColumn(name, out.otherwise(unknown))


def containing_element(elements, point, pad: float = 0.0) -> Column:
    """Smallest named element of an array around a point (first on ties), null if there is none."""
    e = F.col(elements) if isinstance(elements, str) else elements
    p = F.col(point) if isinstance(point, str) else point
    ranked = F.transform(e, lambda x, i: F.struct(
        G.box_area(x["bbox"]).alias("area"), i.alias("i"), x["id"].alias("id"), x["text"].alias("text"),
        (G.contains(x["bbox"], p, pad) & ~is_blank(x["text"])).alias("hit")))
    best = F.array_min(F.filter(ranked, lambda r: r["hit"]))
    return F.when(p.isNotNull(), best)


def response_json(thought, a, point=None, element=None, target=None) -> Column:
    """``{"thought", "action"}`` with only the fields that are set."""
    a = F.col(a) if isinstance(a, str) else a

    def pair(p):
        return F.when(p.isNotNull(), F.array(round_exact(p["x"], 4), round_exact(p["y"], 4)))

    body = [a["type"].alias("type"), pair(a["point"] if point is None else point).alias("point"),
            pair(a["point2"]).alias("point2"), a["text"].alias("text"), a["direction"].alias("direction")]
    if element is not None:
        body.append(element.alias("element"))
    if target is not None:
        body.append(target.alias("target"))
    return F.to_json(F.struct((F.col(thought) if isinstance(thought, str) else thought).alias("thought"),
                              F.struct(*body).alias("action")))


NO_POINT = "struct<x:double,y:double>"


def list_surroundings(template: str, values: dict, slot: str = "elements") -> list[Column]:
    """The texts before, between and after the places of the list in a filled template; null values make them null."""
    texts, now = [], []
    for text, field, _, _ in Formatter().parse(template):
        now.append(F.lit(text))
        if field == slot:
            texts, now = [*texts, F.concat(*now)], []
        elif field:
            v = values[field]
            now.append((F.col(v) if isinstance(v, str) else v).cast("string"))
    return [*texts, F.concat(F.lit(""), *now)]


def quota_split_number(named: int, other: int, limit: int) -> tuple[int, int]:
    """``quota_split`` of plain numbers."""
    kept = min(max(min(V.RESERVED_FOR_UNNAMED, limit // 2), limit - named), limit, other)
    return min(named, limit - kept), kept


def first_lengths(lengths: str, n: Column) -> Column:
    """Sum over the first ``n`` of an array."""
    return F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0), lambda total, x: total + x)


def fit_by_length(df: DataFrame, around: list[Column], cost: Callable[[Column], Column], limits, budget: int) -> DataFrame:
    """Add ``elements_shown`` from the lengths of the lines of ``_named`` and ``_other`` alone; limits after the first that fits cost nothing."""
    fixed_part = reduce(lambda a, b: a + b, [F.length(t) for t in around])
    d = df.withColumn("_base", fixed_part).withColumn("_answer", cost(F.coalesce(F.length("_plain"), F.lit(0))))
    for name, lined in (("_lens", "_named"), ("_more", "_other")):
        d = d.withColumn(name, F.coalesce(F.transform(lined, lambda e: F.length(e["line"])), F.array().cast("array<int>")))

    def cost_at(k):
        first, kept = quota_split(F.size("_lens"), F.size("_more"), k)
        listing = F.when(first + kept > 0, first_lengths("_lens", first) + first_lengths("_more", kept) + first + kept - 1).otherwise(
            F.lit(len(V.ELEMENTS_EMPTY)))
        return cost(F.coalesce(F.col("_base") + listing * (len(around) - 1), F.lit(0))) + F.col("_answer")

    return d.withColumn("elements_shown", fit_limit(cost_at, limits, budget)).drop("_lens", "_more", "_base", "_answer")


def to_element_samples(steps: DataFrame, template: str = V.PROMPT_TEMPLATES["base"], count=approx_tokens,
                       limits=V.ELEMENT_STEPS, budget: int = V.TOKEN_BUDGET, source: str = "sessions",
                       listed: int = V.MAX_ELEMENTS) -> DataFrame:
    """One-stage samples: the prompt lists as many elements as fit, the answer uses the id of a
    *listed* element around the point and keeps the rounded point otherwise.

    steps: instruction, thought, action, history, elements (array), image and what else is to stay.
    ``listed`` is the limit that the arrays were pruned for (``screen_lists``); larger limits need longer arrays.
    A counter that says what a text of some length costs (``of_length``) is asked with sums of line lengths and no prompt is
    built to find the limit; one of ``token_counter`` gets all limits of a batch in one call; any other is called per limit.
    """
    if max(limits) > listed:
        raise ValueError(f"limits up to {max(limits)} need arrays pruned for that many, not {listed}")

    def prompt_of(lines):
        return fill_template(template, {"instruction": "instruction", "history": "_history", "elements": join_lines(lines)})

    # every element is rendered once; the limits to try only cut the list of lines
    d = steps.withColumn("_plain", response_json("thought", "action")).withColumn("_history", render_history("history"))
    # (columns of their own: parts of one struct would be computed again at every use)
    d = d.withColumn("_lined", F.transform("elements", lambda e: F.struct(
        e["id"].alias("id"), e["bbox"].alias("bbox"), e["text"].alias("text"), e["source"].alias("source"),
        element_line(e).alias("line"))))
    d = d.withColumn("_named", named_of("_lined")).withColumn("_other", other_of("_lined"))

    def shown_at(k):
        return take_with_quota(F.col("_named"), F.col("_other"), k)

    around = list_surroundings(template, {"instruction": "instruction", "history": "_history"})
    if hasattr(count, "of_length"):
        d = fit_by_length(d, around, count.of_length, limits, budget)
    elif hasattr(count, "each"):
        fitted = fit_rendered(count.each, quota_split_number, limits, budget, V.ELEMENTS_EMPTY)
        d = d.withColumn("elements_shown", fitted(F.array(*around), F.col("_named.line"), F.col("_other.line"), F.col("_plain")))
    else:
        d = d.withColumn("elements_shown", fit_limit(
            lambda k: count(prompt_of(F.transform(shown_at(k), lambda e: e["line"]))) + count(F.col("_plain")), limits, budget))
    d = d.withColumn("_shown", shown_at(F.col("elements_shown")))
    d = d.withColumn("_hit", containing_element("_shown", F.struct(
        round_exact(F.col("action.point.x"), 4).alias("x"), round_exact(F.col("action.point.y"), 4).alias("y"))))
    d = d.withColumn("_hit", F.when(F.col("action.point").isNotNull(), F.col("_hit")))
    by_id = response_json("thought", "action", point=F.lit(None).cast(NO_POINT), element=F.col("_hit.id"))
    return (d.withColumn("prompt", prompt_of(F.transform("_shown", lambda e: e["line"])))
            .withColumn("response", F.when(F.col("_hit").isNotNull(), by_id).otherwise(F.col("_plain")))
            .withColumn("kind", F.lit("action")).withColumn("source", F.lit(source))
            .drop("_plain", "_history", "_lined", "_named", "_other", "_shown", "_hit"))


def target_decision(action_col: str = "action", box_text: str = "box_text") -> Column:
    """Why a step gives no two-stage sample: no point, no nameable element, or a drag."""
    a = F.col(action_col)
    needs = a["type"].isin(*V.POINTED_TYPES)
    return (F.when(needs & a["point"].isNull(), "no_point").when(needs & is_blank(box_text), "unnamed")
            .when(~needs & a["point"].isNotNull(), "only_coordinates"))


def to_target_samples(steps: DataFrame, template: str = V.PROMPT_TEMPLATES["target"], box_text: str = "box_text",
                      source: str = "sessions") -> DataFrame:
    """Two-stage samples with ``reject_reason``: a point becomes the name of the element around it.

    ``box_text`` comes from ``locate_points``; rejected steps were part of the history before.
    """
    a = F.col("action")
    needs = a["type"].isin(*V.POINTED_TYPES)
    none = F.lit(None).cast(NO_POINT)
    stripped = F.struct(a["type"].alias("type"), none.alias("point"), none.alias("point2"),
                        a["text"].alias("text"), a["direction"].alias("direction"))
    named = response_json("thought", stripped, target=strip(box_text))
    prompt = fill_template(template, {"instruction": "instruction", "history": render_history("history"),
                                      "elements": F.lit("")})
    return (steps.withColumn("reject_reason", target_decision("action", box_text)).withColumn("prompt", prompt)
            .withColumn("response", F.when(needs, named).otherwise(response_json("thought", "action")))
            .withColumn("kind", F.lit("action")).withColumn("source", F.lit(source))
            .withColumn("elements_shown", F.lit(0)))


def plan_samples(plans: DataFrame, template: str = V.PROMPT_TEMPLATES["plan"], limit: int = V.MAX_SUBTASKS,
                 source: str = "sessions") -> DataFrame:
    """Plan samples; a plan that is empty after cleaning gives none."""
    d = plans.withColumn("_steps", clean_plan("subtasks", limit)).filter(F.size("_steps") > 0)
    prompt = fill_template(template, {"instruction": "instruction", "elements": F.lit(V.ELEMENTS_EMPTY),
                                      "max_subtasks": F.lit(limit)})
    return (d.withColumn("prompt", prompt).withColumn("response", F.to_json("_steps"))
            .withColumn("kind", F.lit("plan")).withColumn("source", F.lit(source)).drop("_steps"))


def parse_candidate(candidates) -> Column:
    """``struct(bx,by,bw,bh,label)`` from the first candidate, JSON inside JSON; null if unreadable."""
    c = F.col(candidates) if isinstance(candidates, str) else candidates
    attrs = F.get_json_object(F.get(c, F.lit(0)), "$.attributes")
    nums = F.transform(F.split(F.get_json_object(attrs, "$.bounding_box_rect"), ","), lambda s: s.try_cast("double"))
    ok = (F.size(nums) >= 4) & F.forall(nums, lambda v: v.isNotNull())
    def text(k):
        return F.get_json_object(attrs, f"$.{k}").alias(k)
    return F.when(ok, F.struct(*[F.get(nums, F.lit(i)).alias(n) for i, n in enumerate(("bx", "by", "bw", "bh"))],
                               text("aria_label"), text("title"), text("alt")))


def grounding_cascade(df: DataFrame, has_image: Column) -> DataFrame:
    """Add target box, description, window and the first reason to drop the row.

    Needs pos_candidates, target_action_reprs and the page size (width, height). Cheap tests
    come first; nothing here opens an image.
    """
    r = V.GROUNDING_REASONS
    d = df.withColumn("_c", parse_candidate("pos_candidates"))
    d = d.withColumn("description", describe_target("target_action_reprs", "_c.aria_label", "_c.title", "_c.alt"))
    c = F.col("_c")
    d = d.withColumn("window", G.crop_window(c["bx"], c["by"], c["bw"], c["bh"], "width", "height"))
    d = d.withColumn("target_box", G.translate_box(c["bx"], c["by"], c["bw"], c["bh"], "window"))
    return reject_cascade(d, [
        (r[0], (F.coalesce(F.size("pos_candidates"), F.lit(0)) == 0) | ~F.coalesce(has_image, F.lit(False))),
        (r[1], c.isNull()),
        (r[2], (c["bw"] <= V.MIN_BOX_SIDE) | (c["bh"] <= V.MIN_BOX_SIDE)),
        (r[3], F.col("description") == ""),
        (r[4], ~((c["bx"] >= 0) & (c["bx"] < F.col("width")) & (c["by"] >= 0) & (c["by"] < F.col("height")))),
        (r[5], F.col("target_box").isNull())]).drop("_c")


def grounding_samples(df: DataFrame, norm_coords: bool = False, resized: tuple[str, str] | None = None,
                      source: str = "web") -> DataFrame:
    """Samples from accepted rows of ``grounding_cascade``: a unit point, or whole pixels in the
    resized image (columns named by ``resized``; the window's own size without it)."""
    win, b = F.col("window"), F.col("target_box")
    cw, ch = win["x1"] - win["x0"], win["y1"] - win["y0"]
    if norm_coords:
        body = F.struct(F.array(round_exact((b["x1"] + b["x2"]) / 2 / cw, 4),
                                round_exact((b["y1"] + b["y2"]) / 2 / ch, 4)).alias("point"))
    else:
        t = G.rescale_box(b, cw, ch, *(resized or (cw, ch)))
        body = F.struct(F.array(*[F.bround(t[k]).cast("int") for k in ("x1", "y1", "x2", "y2")]).alias("bbox_2d"))
    return (df.filter(F.col("reject_reason").isNull()).withColumn("prompt", F.col("description"))
            .withColumn("response", F.to_json(body)).withColumn("kind", F.lit("grounding"))
            .withColumn("source", F.lit(source)))
