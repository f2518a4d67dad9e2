from __future__ import annotations

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajspark import fixed_values as V
from trajspark.functions.actions import action
from trajspark.functions.geometry import box, point
from trajspark.functions.udfs import approx_tokens, fit_rendered, token_counter
from trajspark.operators import audit as AU
from trajspark.operators import conformance as O
from trajspark.operators import quality as Q
from trajspark.operators import samples as SM
from trajspark.operators import selection as S
from trajspark.operators import splits as U


# --- splits and balance -----------------------------------------------------------

def test_group_split_is_disjoint_and_whole(spark):
    d = spark.range(400).select((F.col("id") % 37).alias("g"), "id")
    out = U.split_by_group(d, "g", 0.1, 3)
    sides = {}
    for r in out.collect():
        sides.setdefault(r.g, set()).add(r.split)
    assert out.count() == 400 and all(len(s) == 1 for s in sides.values())
    assert sum(s == {"val"} for s in sides.values()) == 3
    U.assert_disjoint(out.filter("split = 'val'"), out.filter("split = 'train'"), "g")
    with pytest.raises(ValueError):
        U.assert_disjoint(out, out, "g")


@pytest.mark.parametrize("n, kw, want", [(5, {"ratio": .1}, 0), (105, {"ratio": .1}, 10), (5, {"at_least_one": True}, 1), (25, {"at_least_one": True}, 2)])
def test_row_split_sizes(spark, n, kw, want):
    out = U.split_rows(spark.range(n), "id", **kw)
    assert out.count() == n and out.filter("split = 'val'").count() == want


def test_one_group_still_goes_to_val(spark):
    assert {r.split for r in U.split_by_group(spark.range(5).withColumn("g", F.lit(1)), "g").collect()} == {"val"}


def counted(spark, counts):
    rows = [(t, i) for t, n in counts.items() for i in range(n)]
    return spark.createDataFrame([(t, f"{t}{i}") for t, i in rows], "type string, key string")


@pytest.mark.parametrize("ref, have, check", [
    ({"click": 400, "hotkey": 200, "type": 200, "wait": 200}, {"click": 100, "hotkey": 200, "type": 200, "wait": 200},
     lambda n: abs(n["click"] / sum(n.values()) - .4) <= .03),
    ({"click": 400, "hotkey": 200, "type": 200, "left_double": 80}, {"click": 100, "hotkey": 200, "type": 200, "left_double": 2},
     lambda n: sum(n.values()) > 200 and n["click"] == 100 and n["left_double"] == 2),
    ({"a": 1, "b": 99}, {"a": 5, "zzz": 4}, lambda n: n == {"a": 5}), ({"x": 1}, {"a": 5}, lambda n: n == {"a": 5})])
def test_balance(spark, ref, have, check):
    samples = counted(spark, have)
    out = U.balance_to_reference(samples, counted(spark, ref), "type", "key")
    n = {r.type: r["count"] for r in out.groupBy("type").count().collect()}
    assert check(n) and all(n[t] <= have[t] for t in n)
    assert out.join(samples, ["type", "key"], "left_anti").count() == 0 and out.distinct().count() == out.count()


def test_dedupe_keeps_the_first_and_is_stable(spark):
    d = spark.createDataFrame([("train", "p", "r", "i1", 2), ("train", "p", "r", "i2", 1), ("val", "p", "r", "i3", 3), ("train", "pr", "", "i4", 4)],
                              "split string, prompt string, response string, image string, ord int")
    once = U.dedupe_samples(d, within=("split",))
    assert sorted(r.ord for r in once.collect()) == [1, 3, 4]
    assert sorted(r.ord for r in U.dedupe_samples(once, within=("split",)).collect()) == [1, 3, 4]


# --- selection --------------------------------------------------------------------

def holds_quota(shown, elements, limit, reserved):
    """Named ones first, both kinds in their own order from the front; unnamed ones never crowd out more than was set aside."""
    named = [e[0] for e in elements if e[1].strip()]
    other = [e[0] for e in elements if not e[1].strip() and e[2] == "cv"]
    n = sum(i in named for i in shown)
    m = len(shown) - n
    assert shown == named[:n] + other[:m]
    assert len(shown) == min(limit, n + len(other)) or n == len(named)
    if len(named) + len(other) <= limit:
        assert (n, m) == (len(named), len(other))
    elif n < len(named):
        assert m == min(len(other), reserved, limit // 2) and n + m == limit
    return True


@pytest.mark.parametrize("limit, reserved", [(6, 4), (1, 16), (20, 16), (10, 2)])
def test_quota_in_rows_and_arrays(spark, limit, reserved):
    r = random.Random(limit)
    screens = {s: [(i, r.choice(["", " ", "t", "u", "v"]), r.choice(["cv", "ocr"])) for i in range(n)] for s, n in enumerate((0, 3, 9, 30))}
    d = spark.createDataFrame([(s, *e) for s, v in screens.items() for e in v], "screen_id int, id int, text string, source string")
    got = {}
    for x in S.select_with_quota(d, limit=limit, reserved=reserved).orderBy("screen_id", "shown").collect():
        got.setdefault(x.screen_id, []).append(x.id)
    a = d.groupBy("screen_id").agg(F.sort_array(F.collect_list(F.struct("id", "text", "source"))).alias("e"))
    arr = {x.screen_id: [y.id for y in x.s] for x in a.select("screen_id", S.select_array_with_quota("e", limit, reserved).alias("s")).collect()}
    for s, v in screens.items():
        assert got.get(s, []) == arr.get(s, []) and holds_quota(arr.get(s, []), v, limit, reserved)


def test_grid_sample_goes_round_the_cells(spark):
    d = spark.createDataFrame([(i, .1 if i < 20 else .9) for i in range(22)], "id int, x double").withColumn(
        "bbox", box("x", F.lit(.5), "x", F.lit(.5)))
    assert sorted(r.id for r in S.grid_sample(d, 4, "bbox", "id").collect()) == [0, 1, 20, 21]
    assert S.grid_sample(d, 100, "bbox", "id").count() == 22


# --- quality ----------------------------------------------------------------------

@pytest.mark.parametrize("text, hit", [("rm -rf /", True), ("echo ok; rm -rf /", True), ("echo ok && shutdown -s", True), ("note: rm -rf is bad", False),
                                       ("line\nformat c:", True), ("formatting", False), ("del /f x", True), ("del x", False), ("a | mkfs.ext4", True)])
def test_destructive_texts(value, text, hit):
    assert (value(Q.blocked_pattern(F.lit(text))) is not None) == hit


@pytest.mark.parametrize("combo, hit", [("ctrl+alt+del", True), ("Alt+Control+Delete", True), ("winleft+l", True), ("win+r", False), ("alt+f4", False)])
def test_forbidden_hotkeys(value, combo, hit):
    assert value(Q.blocked_hotkey(F.lit(combo))) == hit


def test_budget_takes_the_largest_that_fits(spark):
    d = spark.createDataFrame([(100,), (1300,), (5000,)], "t int").select(Q.fit_limit(lambda k: F.col("t") + k * 4).alias("k"))
    assert [r.k for r in d.collect()] == [60, 12, 0]


def test_compliance(spark):
    d = spark.range(200).select((F.col("id") < 3).cast("int").alias("long"))
    r = Q.length_compliance(d, F.col("long"), 0).first()
    assert r.over == 3 and not r.complies


# --- answers ----------------------------------------------------------------------

def test_parse_outputs(spark):
    el = spark.createDataFrame([("s", 14)], "screen_id string, id int").withColumn("bbox", box(F.lit(.2), F.lit(.2), F.lit(.4), F.lit(.4)))
    raws = {
        '{"thought": "t", "action": {"type": "click", "element": 14.0}}': ("click", (.3, .3), None),
        '{"action": {"type": "click", "element": 1.9}}': (None, None, "element_not_integer"),
        '{"action": {"type": "click", "element": true}}': (None, None, "element_not_integer"),
        '{"action": {"type": "click", "element": 99}}': (None, None, "element_unknown"),
        '{"action": {"type": "left_click", "point": [899, 84]}}': ("click", (.899, .168), None),
        '{"action": {"type": "click", "point": [0.5]}}': (None, None, "bad_point"),
        '{"action": {"point": [0.5, 0.5]}}': (None, None, "type_missing"), '{"action": "click"}': (None, None, "unparseable"),
        "call me": (None, None, "unparseable"), 'so {x} ```json\n{"action": {"type": "wait"}}```': ("wait", None, None),
        '{"action": {"type": "hotkey", "target": " Tab "}}': ("hotkey", None, None),
        '{"action": {"type": "scroll", "point": [0.1, 0.1]}}': (None, None, "missing:direction")}
    d = spark.createDataFrame([("s", r) for r in raws], "screen_id string, raw string")
    out = O.parse_outputs(d, elements=el, model_w=F.lit(1000), model_h=F.lit(500), repair_target=True).collect()
    assert len(out) == len(raws)
    for r in out:
        kind, pt, why = raws[r.raw]
        assert r.reject_reason == why and (r.parsed.type if r.parsed else None) == kind
        if pt:
            assert tuple(r.parsed.point) == pytest.approx(pt)
        if kind == "hotkey":
            assert r.parsed.text == "Tab"


@pytest.mark.parametrize("raw, want", [('{"situation": "need_retry", "advice": "again"}', ("need_retry", "again")), ("I say sub_task_success!", (V.SUCCESS, "")),
                                       ("no idea", (V.RETRY, "")), ('{"situation": "odd"} need_reformulate', (V.REFORMULATE, ""))])
def test_reflections(spark, raw, want):
    r = O.parse_reflections(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (r.situation, r.advice) == want


@pytest.mark.parametrize("raw, want", [('{"bbox_2d": [1, 2.5, 3, 4]}', (1, 2.5, 3, 4)), ("<|box_start|>(1,2),(3, 4)<|box_end|>", (1, 2, 3, 4)), ("[1, 2, 3, 4]", (1, 2, 3, 4)),
                                       ('"bbox_2d": [1e3, -2, 3, 4]', (1000, -2, 3, 4)), ('"bbox_2d": [1, 2]', None), ("none", None)])
def test_boxes(value, raw, want):
    got = value(O.parse_box(F.lit(raw)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("raw, want", [('{"point": [0.5, 1]}', (.5, 1)), ("[0.1,0.2]", (.1, .2)), ('{"point": [512, 3]}', None), ('{"point": [0.1, 0.2, 0.3]}', None), ("x", None)])
def test_points(value, raw, want):
    got = value(O.parse_point(F.lit(raw)))
    assert (tuple(got) if got else None) == want


# --- samples ----------------------------------------------------------------------

def test_templates(spark):
    d = spark.createDataFrame([("base", "see {history}"), ("plan", "b")], "variant string, instruction string")
    out = SM.render_prompts(d, {"instruction": "instruction", "history": F.lit("H")}, templates={"base": "{instruction}|{history}", "plan": "{{{instruction}}}"})
    assert [r.prompt for r in out.collect()] == ["see {history}|H", "{b}"]
    with pytest.raises(Exception, match="no prompt variant"):
        SM.render_prompts(d, {"instruction": "instruction"}, templates={"base": "{instruction}"}).collect()


def test_element_samples_use_listed_ids_only(spark):
    els = F.array(*[F.struct(F.lit(i).alias("id"), box(F.lit(x), F.lit(0.), F.lit(x + .3), F.lit(.3)).alias("bbox"), F.lit(t).alias("text"), F.lit("ocr").alias("source"))
                    for i, x, t in ((3, 0., "save"), (4, .5, "open"))])
    d = spark.createDataFrame([(.1,), (.6,), (.9,)], "x double").select(
        els.alias("elements"), F.lit("do").alias("instruction"), F.lit("why").alias("thought"), F.array().cast("array<struct<n:int,line:string,status:string>>").alias("history"),
        action(F.lit("click"), point("x", F.lit(.123456))).alias("action"))
    full = [json.loads(r.response)["action"] for r in SM.to_element_samples(d).collect()]
    assert full == [{"type": "click", "element": 3}, {"type": "click", "element": 4}, {"type": "click", "point": [.9, .1235]}]
    short = SM.to_element_samples(d, limits=(1,)).collect()
    assert json.loads(short[1].response)["action"] == {"type": "click", "point": [.6, .1235]} and "[4]" not in short[1].prompt


def test_budget_is_the_same_by_lengths_by_texts_in_one_call_and_per_limit(spark):
    rng = random.Random(4)
    schema = "n int, instruction string, thought string, elements array<struct<id:int,bbox:struct<x1:double,y1:double,x2:double,y2:double>,text:string,source:string>>"
    rows = []
    for n in range(120):
        els = [(i, (.1, .1, .2, .2), rng.choice(["", " ", None, "ok", "a longer label", "字" * 30]), rng.choice(["cv", "ocr"])) for i in range(rng.randint(0, 30))]
        rows.append((n, None if n % 17 == 0 else "do " * rng.randint(0, 20), None if n % 13 == 0 else "why" * rng.randint(0, 9), None if n % 11 == 0 else els))
    d = spark.createDataFrame(rows, schema).withColumn("history", F.array().cast("array<struct<n:int,line:string,status:string>>")).withColumn(
        "action", action(F.lit("click"), point(F.lit(.15), F.lit(.15))))
    limits = (20, 12, 6, 3, 1, 0)
    twice = "{{elements}} {instruction}|{history}|{elements}|{elements}"
    for template in (V.PROMPT_TEMPLATES["base"], twice, "{instruction} without a list"):
        def run(count):
            return {r.n: (r.elements_shown, r.prompt) for r in SM.to_element_samples(d, template, count, limits, 110).collect()}

        by_length, in_one_call, per_limit = run(approx_tokens), run(token_counter(lambda s: -(-len(s) // 4))), run(lambda c: approx_tokens(c))
        assert by_length == in_one_call == per_limit
        assert "list" in template or len({k for k, _ in by_length.values()}) >= 3


def test_one_call_counts_no_list_twice(spark):
    asked = []

    def count(text):
        asked.append(text)
        return len(text)

    fit = fit_rendered(count, SM.quota_split_number, (60, 45, 30, 2, 0), 20, "none").func
    assert fit(*[pd.Series([v]) for v in (["<", ">"], ["aaaa"] * 3, ["bb"], "answer")]).tolist() == [2]
    assert asked == ["answer", "<aaaa\naaaa\naaaa\nbb>", "<aaaa\nbb>"]


def test_target_samples(spark):
    rows = [("click", .1, "Save "), ("click", .1, None), ("drag", .1, "x"), ("type", None, None), ("click", None, "x")]
    d = spark.createDataFrame(rows, "t string, x double, box_text string").select(
        "box_text", F.lit("do").alias("instruction"), F.lit("why").alias("thought"), F.array().cast("array<struct<n:int,line:string,status:string>>").alias("history"),
        action(F.col("t"), F.when(F.col("x").isNotNull(), point("x", "x")), text=F.when(F.col("t") == "type", "hi")).alias("action"))
    out = SM.to_target_samples(d).collect()
    assert [r.reject_reason for r in out] == [None, "unnamed", "only_coordinates", None, "no_point"]
    assert json.loads(out[0].response)["action"] == {"type": "click", "target": "Save"} and json.loads(out[3].response)["action"] == {"type": "type", "text": "hi"}


def test_plan_samples(spark):
    d = spark.createDataFrame([([" a ", "a", "", "b"],), ([" "],), ([str(i) for i in range(12)],)], "subtasks array<string>").withColumn("instruction", F.lit("x"))
    assert [json.loads(r.response) for r in SM.plan_samples(d).collect()] == [["a", "b"], [str(i) for i in range(8)]]


def test_grounding(spark):
    def cand(rect, **kw):
        return [json.dumps({"attributes": json.dumps({"bounding_box_rect": rect, **kw})})]
    rows = [(cand("600,1000,100,40"), "[a]  Go -> CLICK", True), ([], "[a]  Go -> CLICK", True), (cand("600,1000,100,40"), "[a]  Go -> CLICK", False),
            (["{bad"], "x", True), (cand("1,2,3"), "x", True), (cand("1,2,1,9"), "x", True), (cand("1,2,9,9"), "[a]   -> CLICK", True),
            (cand("1,2,9,9", aria_label="lab"), "[a]   -> CLICK", True), (cand("5000,2,9,9"), "x", True)]
    d = spark.createDataFrame(rows, "pos_candidates array<string>, target_action_reprs string, img boolean").withColumn("width", F.lit(1280)).withColumn("height", F.lit(5429))
    c = SM.grounding_cascade(d, F.col("img"))
    r = V.GROUNDING_REASONS
    assert [x.reject_reason for x in c.collect()] == [None, r[0], r[0], r[1], r[1], r[2], r[3], None, r[4]]
    first = SM.grounding_samples(c).first()
    assert first.prompt == "Go" and json.loads(first.response) == {"bbox_2d": [600, 340, 700, 380]}
    assert json.loads(SM.grounding_samples(c, norm_coords=True).first().response) == {"point": [.5078, .5]}


# --- audit ------------------------------------------------------------------------

def test_audit_finds_each_fault_once(spark):
    def s(kind, response, prompt="[1] a", image="i", split="train"):
        return (split, kind, image, prompt, response if isinstance(response, str) else json.dumps(response, ensure_ascii=False), 100, 100)

    def act(thought="why", **a):
        return {"thought": thought, "action": a}
    good = act(type="click", point=[.1, .2])
    rows = [s("action", good), s("action", act(type="click", element=1), image="j"), s("action", act(type="click", element=2), image="k"), s("action", act(type="click", target=""), image="l"),
            s("action", act(type="click", target="t", point=[.1, .1]), image="m"), s("action", act(type="fly"), image="n"), s("action", act(type="click", point=[1.5, 0]), image="o"),
            s("action", act("at 0.123", type="wait"), image="p"), s("action", act(" ", type="wait"), image="q"), s("plan", "[]", image="r"), s("plan", '["a", "a"]', image="s"), s("plan", '["a"]', image="t"),
            s("grounding", '{"bbox_2d": [1, 1, 200, 2]}', image="u"), s("grounding", '{"bbox_2d": [1, 1, 2, 2]}', image="v"), s("grounding", '{"point": [0.5, 1.2]}', image="w"),
            s("plan", '["b"]', image="t"), s("action", good, image="x"), s("action", " ", image="y"), s("action", good, image="i", split="val", prompt="other")]
    d = spark.createDataFrame(rows, "split string, kind string, image string, prompt string, response string, width int, height int")
    test = spark.createDataFrame([("x",), ("zz",)], "image string")
    got = {(r.check, r.split): r.n for r in AU.audit(d, test).collect() if r.n}
    assert got == {("blank_field", "train"): 1, ("bad_target", "train"): 2, ("element_not_shown", "train"): 1, ("bad_action", "train"): 3, ("coordinate_in_thought", "train"): 1,
                   ("blank_thought", "train"): 2, ("bad_box", "train"): 2, ("bad_plan", "train"): 2, ("duplicate", "train"): 1, ("contradiction", "train"): 1,
                   ("shared_image", "train+val"): 1, ("test_leak", "test"): 1}
    assert not any(r.n for r in AU.audit(d, test, val_is_held_out=False).filter("check = 'shared_image'").collect())
