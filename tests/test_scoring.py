from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trajspark import fixed_values as V
from trajspark.functions.geometry import box, point
from trajspark.operators import counts as C
from trajspark.operators import matching as J
from trajspark.operators import metrics as M
from trajspark.operators import runs as R

CASES = "i int, gt string, pred string, dist double, gt_text string, pred_text string"


@pytest.fixture
def cases(spark):
    def make(*rows):
        return spark.createDataFrame([(i, *r, *[None] * (5 - len(r))) for i, r in enumerate(rows)], CASES)
    return make


def summary(df):
    r = M.op_f1_summary(df).first()
    return r.macro_f1, r.micro_f1


def rate(df, t):
    return M.step_success(df, [t]).first().rate


def test_micro_is_accuracy_without_text(cases):
    assert summary(cases(("click", "click", .02), ("click", "type"), ("scroll", "scroll", .01)))[1] == pytest.approx(2 / 3)


def test_macro_gives_small_classes_weight(cases):
    d = cases(*[("click", "click", .01)] * 9, ("scroll", "click", .01))
    macro, micro = summary(d)
    assert micro == pytest.approx(0.9) and macro < 0.6
    assert {r.cls: r.f1 for r in M.op_f1(d).collect()}["scroll"] == 0


def test_keyboard_needs_the_text(cases):
    good, bad = cases(("type", "type", None, "你好", " 你好 ")), cases(("type", "type", None, "你好", "再见"))
    assert summary(good)[1] == 1 and rate(good, .1) == 1 and summary(bad)[1] == 0 and rate(bad, .1) == 0
    assert summary(cases(("hotkey", "hotkey")))[1] == 1
    assert summary(cases(("hotkey", "hotkey", None, "Ctrl+S", "ctrl+s")))[1] == 1


def test_thresholds_and_failures(cases):
    assert rate(cases(("click", "click", .12)), .10) == 0 and rate(cases(("click", "click", .12)), .14) == 1
    d = cases(("click", "click", .01), ("click", V.PARSE_FAILED))
    assert summary(d)[1] == .5 and rate(d, .14) == .5
    assert V.PARSE_FAILED not in {r.cls for r in M.op_f1(d).collect()}
    a = M.accuracy_summary(d).first()
    assert a.unexecutable_rate == .5 and a.keyboard_recall is None


def test_empty_input_gives_nulls(cases):
    d = cases(("click", "click")).filter("false")
    assert summary(d) == (None, None) and rate(d, .1) is None


def test_predicted_only_class_has_a_row_but_no_weight(cases):
    d = cases(("click", "click"), ("click", "wait"))
    per = {r.cls: r.gt for r in M.op_f1(d).collect()}
    assert per == {"click": 2, "wait": 0} and summary(d)[0] == pytest.approx(2 / 3)


def test_keyboard_recall_leaves_failures_out(cases):
    a = M.accuracy_summary(cases(("type", V.PARSE_FAILED), ("type", "hotkey"), ("hotkey", "click"))).first()
    assert a.keyboard_total == 2 and a.keyboard_recall == .5


def test_joint_with_and_without_text(cases):
    d = cases(("type", "type", None, "a", "b"))
    assert M.accuracy_summary(d).first().joint_accuracy == 1 and M.accuracy_summary(d, require_text=True).first().joint_accuracy == 0


def test_medians_of_even_counts(spark):
    d = spark.createDataFrame([(1.,), (2.,), (3.,), (10.,)], "v double")
    m = C.medians(d, "v").first()
    assert m.median_upper == 3 and m.median_mid == 2.5


def test_by_category_and_sessions(spark, cases):
    c = cases(("click", "click", .05), ("click", "click", .30), ("type", "click"))
    apps = spark.createDataFrame([(0, "web"), (1, "web"), (2, "game")], "i int, app string")
    got = {r.app: (r.n, r.type_accuracy, r.joint_accuracy) for r in M.by_category(J.attach_test_rows(c, apps), "app").collect()}
    assert got == {"web": (2, 1.0, .5), "game": (1, 0, 0)}
    c = cases(("click", "click", .05), ("click", "click", .05), ("click", "click", .3), ("type", V.PARSE_FAILED))
    s = spark.createDataFrame([(0, "s1"), (1, "s1"), (2, "s2"), (3, "s3")], "i int, session string")
    r = M.session_success(J.attach_test_rows(c, s), "session").first()
    assert (r.sessions, r.sessions_done) == (3, 1) and r.session_success == pytest.approx(1 / 3)


def test_build_cases_marks_missing_answers(spark):
    from trajspark.functions.actions import action
    t = spark.range(3).select(F.col("id").alias("i"), action(F.lit("click"), point(F.lit(.1), F.lit(.1))).alias("action"))
    p = spark.range(2).select(F.col("id").alias("i"), action(F.when(F.col("id") == 0, "click").otherwise("type"), point(F.lit(.4), F.lit(.5))).alias("pred_action"))
    got = {r.i: (r.pred, r.dist) for r in J.build_cases(t, p).collect()}
    assert got == {0: ("click", .5), 1: ("type", None), 2: (V.PARSE_FAILED, None)}


def test_best_step_prefers_the_earliest(spark):
    d = spark.createDataFrame([(10, 1.5), (20, 1.1), (30, 1.1), (40, None)], "step int, val_loss double")
    assert tuple(M.best_step(d).first()) == (20, 1.1)


# --- runs -------------------------------------------------------------------------

RECORDS = [("a", "T1", 1, True, 8.0, 0, [True, True]), ("b", "T2", 1, False, 20.0, 1, [False, True, False]), ("c", "T3", 1, False, 0.0, None, None)]


@pytest.fixture
def records(spark):
    rows = [(t, lv, n, p, 0, w, [], rt, None, None if st is None else ([(x,) for x in st],)) for t, lv, n, p, w, rt, st in RECORDS]
    return spark.createDataFrame([(rows,)], f"records array<{R.RECORD_SCHEMA}>").withColumn("config", F.lit("x")).withColumn("live", F.lit(True))


def test_summary_counts_aborted_runs_in_the_rate_only(records):
    s = R.summarize_runs(R.run_facts(R.explode_records(R.valid_run_logs(records)))).first()
    assert (s.runs, s.passed, s.aborted, s.steps, s.error_steps, s.retries) == (3, 1, 1, 5, 2, 1)
    assert s.success_rate == pytest.approx(1 / 3) and s.error_rate == .4 and s.avg_wall_time == 14 and s.avg_wall_time_passed == 8


def test_levels_and_gating(records):
    f = R.run_facts(R.explode_records(records)).filter("level <> 'T2'")
    assert [r.level for r in R.summarize_by_level(f).collect()] == ["T1", "T3"]
    assert R.valid_run_logs(records.withColumn("live", F.lit(False))).count() == 0
    assert R.valid_run_logs(records.withColumn("records", F.expr("filter(records, x -> false)"))).count() == 0


def test_compare_configs_leaves_gaps(spark):
    d = spark.createDataFrame([("t", "a", True), ("t", "a", False), ("u", "b", True)], "task string, config string, passed boolean")
    assert {r.task: (r.a, r.b) for r in R.compare_configs(d).collect()} == {"t": ("1/2", None), "u": (None, "1/1")}


def test_labels(spark):
    d = spark.createDataFrame([("tasks_live_q_suite.json",)], "f string").select(R.config_label(F.col("f")).alias("c"))
    assert d.first().c == "live_q_suite" and d.select(R.legend_label(F.col("c"), {"q": "Base"}).alias("l")).first().l == "Base"


def test_worker_age_and_receipts(spark):
    d = spark.createDataFrame([("a", 100.0), ("a", 160.0), ("b", 120.0), ("c", None)], "worker string, beat double")
    assert {r.worker: r.alive for r in R.stale_workers(d, F.lit(185.0)).collect()} == {"a": True, "b": False, "c": False}
    r = spark.createDataFrame([(1, 0, None), (2, 1, None), (3, None, None), (4, 0, "x")], "id int, exit_code int, error string")
    assert sorted(x.id for x in R.failed_receipts(r).collect()) == [2, 3, 4]


def test_long_runs_become_several_documents(spark):
    runs = spark.createDataFrame([("a",), ("b",)], "run string")
    steps = spark.createDataFrame([("a", i, 0.5) for i in range(25)], "run string, n int, elapsed double")
    for hot in (None, 6):
        docs = R.assemble_trajectories(runs, steps, "run", "n", F.struct("n"), chunk=10, hot_rows=hot).orderBy("run", "part").collect()
        assert [(d.run, d.part, d.n_steps, d.wall_time, [s.n for s in d.steps] if d.steps else None) for d in docs] == [
            ("a", 0, 25, 12.5, list(range(10))), ("a", 1, 25, 12.5, list(range(10, 20))), ("a", 2, 25, 12.5, list(range(20, 25))), ("b", 0, 0, None, None)]


# --- boxes ------------------------------------------------------------------------

def iou(a, b):
    ix, iy = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - ix * iy
    return ix * iy / u if u > 0 else 0


@pytest.mark.parametrize("fold_rows", [2000, 5])
def test_merge_boxes_against_brute_force(spark, fold_rows):
    import random
    r = random.Random(2)

    def some(n):
        out = []
        for i in range(n):
            x, y = r.random() * .8, r.random() * .8
            out.append((x, y, x + r.choice([.05, .1, .4]), y + r.choice([.05, .1, .3])))
        return out + out[:5] + [(.5, .5, .5, .6)] * 2          # copies and flat boxes
    data = {s: (some(15), some(70)) for s in ("p", "q")}
    schema = "screen_id string, ord int, b array<double>, text string, source string"

    def frame(k):
        d = spark.createDataFrame([(s, i, list(b), f"{k}{i}", "x") for s, v in data.items() for i, b in enumerate(v[k])], schema)
        return d.withColumn("bbox", box(*[F.col("b")[i] for i in range(4)])).drop("b")
    got = {}
    for row in J.merge_boxes(frame(0), frame(1), fold_rows=fold_rows).orderBy("screen_id", "id").collect():
        got.setdefault(row.screen_id, []).append((row.id, tuple(row.bbox)))
    for s, (prim, cand) in data.items():
        kept = list(prim)
        for b in cand:
            if not any(iou(b, o) > .3 for o in kept):
                kept.append(b)
        assert got[s] == list(enumerate(kept))


def test_locate_points_against_brute_force(spark):
    import random
    r = random.Random(4)
    boxes = [(s, i, *sorted([r.random(), r.random()]), *sorted([r.random(), r.random()]), r.choice(["", " ", "n", "m"])) for s in "ab" for i in range(60)]
    boxes += [("a", 100, .2, .3, .2, .3, "twin"), ("a", 101, .2, .3, .2, .3, "later twin"), ("a", 102, 0., 1., 0., 1., "whole")]
    pts = [(r.choice("ab"), i, round(r.random(), 2), round(r.random(), 2)) for i in range(150)] + [("a", 900 + i, .5, .5) for i in range(80)] + [("a", 999, .205, .31), ("c", 1000, .5, .5)]
    b = spark.createDataFrame(boxes, "screen_id string, box_id int, x1 double, x2 double, y1 double, y2 double, text string")
    b = b.select("screen_id", "box_id", F.col("box_id").alias("ord"), box("x1", "y1", "x2", "y2").alias("bbox"), "text")
    p = spark.createDataFrame(pts, "screen_id string, point_id int, x double, y double").select("screen_id", "point_id", point("x", "y").alias("point"))
    for pad in (0.0, 0.01):
        got = {x.point_id: x.box_id for x in J.locate_points(p, b, pad=pad).collect()}
        for s, i, x, y in pts:
            hit = [q for q in boxes if q[0] == s and q[2] - pad <= x <= q[3] + pad and q[4] - pad <= y <= q[5] + pad and q[6].strip()]
            assert got[i] == (min(hit, key=lambda q: ((q[3] - q[2]) * (q[5] - q[4]), q[1]))[1] if hit else None)


def test_covered_hit_and_ids(spark):
    t = spark.createDataFrame([("s", 1), ("s", 2), ("u", 3)], "screen_id string, truth_id int").withColumn(
        "bbox", F.when(F.col("truth_id") == 2, box(F.lit(.8), F.lit(.8), F.lit(.9), F.lit(.9))).otherwise(box(F.lit(0.), F.lit(0.), F.lit(.5), F.lit(.5))))
    e = spark.createDataFrame([("s", 7)], "screen_id string, id int").withColumn("bbox", box(F.lit(.4), F.lit(.4), F.lit(.6), F.lit(.6)))
    assert {r.truth_id: r.covered for r in J.covered(t, e).collect()} == {1: True, 2: False, 3: False}
    c = spark.createDataFrame([("s", v) for v in ("7", "7.0", " 7 ", "1.9", "true", "8", None)], "screen_id string, element string")
    got = {r.element: (r.element_id, r.reject_reason) for r in J.resolve_element_ids(c, e).collect()}
    assert got == {"7": (7, None), "7.0": (7, None), " 7 ": (7, None), "1.9": (None, "element_not_integer"), "true": (None, "element_not_integer"),
                   "8": (8, "element_unknown"), None: (None, "element_not_integer")}


def test_lookup_join_with_hot_keys_equals_broadcast(spark):
    rows = spark.range(500).withColumn("k", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7))
    t = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    a, b, c = (sorted(map(tuple, J.lookup_join(rows, t, "k", max_rows=m, hot_rows=h).select("id", "k", "v").collect()), key=str)
               for m, h in ((100, 100), (0, 100), (0, 10_000)))
    assert a == b == c and len(a) == 500


def test_plan_coverage(spark):
    d = spark.createDataFrame([(["打开记事本", "输入"], ["打开 记事本"]), ([], ["a"]), (["a"], [])], "ref array<string>, got array<string>")
    assert [r.c for r in d.select(J.plan_coverage("ref", "got").alias("c")).collect()] == [.5, 0, 0]
