from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from trajspark.functions.udfs import predict, token_counter
from trajspark.operators import normalize as N
from trajspark.operators import quality as Q
from trajspark.operators import runs as R
from trajspark.plans.jobs import audit_corpus, build_corpus, prepare_sessions, score_predictions, summarise_logs, write_corpus
from trajspark.sources import readers as IN
from trajspark.sources import sinks as OUT


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_event_log_tolerates_what_a_killed_process_leaves(spark, tmp_path):
    put(tmp_path / "run.jsonl", '{"t": 1, "event": "start"}\n\n   \n{"t": 2.5, "event": "step", "n": 1, "changed": null, "action": {"type": "click", "point": [0.1, 0.2]}}\n{"t": 3, "eve')
    rows = IN.read_event_log(spark, str(tmp_path / "run.jsonl")).orderBy("t").collect()
    assert [(r.t, r.event) for r in rows] == [(1.0, "start"), (2.5, "step")] and rows[1].changed is None and rows[1].action.point == [.1, .2]
    assert IN.read_event_log(spark, str(tmp_path / "missing.jsonl")).count() == 0


def test_strict_lines_fail(spark, tmp_path):
    put(tmp_path / "a.jsonl", '{"i": 2}\n{"i": 1}\n')
    assert [r.i for r in IN.read_jsonl(spark, str(tmp_path / "a.jsonl"), "i int", limit=1, order="i").collect()] == [1]
    put(tmp_path / "b.jsonl", '{"i": 2}\n{"i": \n')
    with pytest.raises(Exception):
        IN.read_jsonl(spark, str(tmp_path / "b.jsonl"), "i int").collect()


def test_task_specs(spark, tmp_path):
    put(tmp_path / "specs.json", json.dumps([
        {"task_id": 1, "intent": "x", "intent_template": "t", "intent_template_id": 9, "instantiation_dict": {"a": 1, "b": "z"}, "sites": ["s"], "require_login": True, "eval": {"eval_types": ["m"]}},
        {"task_id": 2, "eval": None}, {}]))
    rows = N.flatten_specs(IN.read_task_specs(spark, str(tmp_path / "specs.json"))).orderBy("task_id").collect()
    assert rows[1].params == {"a": "1", "b": "z"} and rows[1].check_types == ["m"] and rows[1].requires_login
    for r in (rows[0], rows[2]):        # the one without an id sorts first
        assert (r.instruction, r.params, r.sites, r.check_types, r.requires_login) == ("", {}, [], [], False)


def test_run_logs(spark, tmp_path):
    rec = {"task": "a", "level": "T1", "run": 1, "passed": True, "wall_time": 8.0, "retries": 0, "trajectory": {"steps": [{"ok": True}, {}]}}
    put(tmp_path / "tasks_one_suite.json", json.dumps({"live": True, "records": [rec, {"task": "b", "level": "T2", "run": 1, "passed": False, "wall_time": 0.0}]}))
    put(tmp_path / "tasks_two_suite.json", json.dumps({"live": False, "records": [rec]}))
    put(tmp_path / "tasks_three_suite.json", json.dumps({"live": True, "records": []}))
    put(tmp_path / "tasks_four_suite.json", "{broken")
    put(tmp_path / "other.json", "{}")
    logs = IN.read_run_logs(spark, str(tmp_path))
    assert logs.count() == 4 and [r.config for r in R.valid_run_logs(logs).collect()] == ["one_suite"]
    s = summarise_logs(logs)["overall"].collect()
    assert [(r.config, r.runs, r.passed, r.steps, r.error_steps, r.aborted) for r in s] == [("one_suite", 2, 1, 2, 0, 1)]


def test_a_run_log_file_may_hold_several_documents(spark, tmp_path):
    doc = {"live": True, "records": [{"task": "a", "run": 1, "passed": True}]}
    put(tmp_path / "tasks_one_suite.json", json.dumps([doc, {"live": False, "records": []}, doc]))
    put(tmp_path / "tasks_two_suite.json", json.dumps(doc))
    logs = IN.read_run_logs(spark, str(tmp_path))
    assert sorted((r.config, r.live, len(r.records)) for r in logs.collect()) == [("one_suite", False, 0), ("one_suite", True, 1), ("one_suite", True, 1), ("two_suite", True, 1)]


def test_shards(spark, tmp_path):
    for i in range(3):
        spark.range(i, i + 1).write.parquet(str(tmp_path / f"train-0000{i}.parquet"))
    assert sorted(r.id for r in IN.read_shards(spark, str(tmp_path), "train", 2).collect()) == [0, 1]
    with pytest.raises(FileNotFoundError):
        IN.read_shards(spark, str(tmp_path), "val")


def test_manifest(spark, tmp_path):
    assert IN.read_manifest(spark, str(tmp_path / "none"))["val_is_held_out"] is True
    OUT.write_manifest(spark, str(tmp_path / "m"), "train+val")
    assert IN.read_manifest(spark, str(tmp_path / "m")) == {"train_split": "train+val", "val_is_held_out": False}


def test_cache(spark, tmp_path):
    keys, cache = spark.range(6).withColumnRenamed("id", "k"), spark.range(2).select(F.col("id").alias("k"), F.lit(-1).cast("long").alias("f"))
    seen = []

    def compute(missing):
        seen.append(missing.count())
        return missing.withColumn("f", F.col("k") * 2)
    path = str(tmp_path / "features")
    cache.unionByName(spark.createDataFrame([(99, 0)], "k long, f long")).write.parquet(path)
    for twice in ((2, 4), (6, 0)):      # the second run finds everything
        out, counts = OUT.materialize_missing(keys.unionByName(keys), path, "k", "k long, f long", compute)
        assert {r.k: r.f for r in out.collect()} == {0: -1, 1: -1, 2: 4, 3: 6, 4: 8, 5: 10} and tuple(counts.first()) == twice
    assert seen == [4, 0]
    fresh, counts = OUT.materialize_missing(keys, str(tmp_path / "none"), "k", "k long, f long", compute)
    assert fresh.count() == 6 and tuple(counts.first()) == (0, 6)
    assert OUT.require_cached(keys.filter("k < 2"), cache, "k").count() == 2
    with pytest.raises(Exception, match="not in the cache"):
        OUT.require_cached(keys, cache, "k").collect()


def test_hooks(spark):
    d = spark.createDataFrame([("a b c",), ("a",)], "text string")
    words = token_counter(lambda t: len(t.split()))
    assert Q.length_filter(d, words(F.col("text")), 2)[0].count() == 1
    assert sorted(r.p for r in predict(d, lambda: "!", lambda m, pdf: pdf["text"] + m, "p").collect()) == ["a b c!", "a!"]


def session_tree(root):
    def doc(split, session, name, actions, **kw):
        body = {"session_id": session, "video_width": 1000, "video_height": 500, "saved_image_name": name + ".png", "task_prompt": "task", "task_prompt_zh": "任务",
                "LLM_response_editer": "因为。```json```", "send_prompt_zh": "现在的子任务是“打开”。", "actions": actions, **kw}
        put(root / split / session / f"{name}.json", json.dumps(body, ensure_ascii=False))

    def click(x, y):
        return {"action_type": "MouseAction", "mouse_action_type": "click", "mouse_button": "left", "mouse_position": {"width": x, "height": y}}
    plan = [{"action_type": "PlanAction", "element": " one "}, {"action_type": "PlanAction", "element": "two"}]
    for i in range(12):
        doc("train", f"s{i:02d}", "0001", plan + [click(100, 50)])
        doc("train", f"s{i:02d}", "0002", [click(900, 450), click(1500, 1), {"action_type": "EvaluateSubTaskAction", "situation": "need_retry", "advice": "x"}])
        doc("train", f"s{i:02d}", "0003_neg_plan", plan + [click(100, 50)])
    doc("train", "s00", "0004", [click(1, 1)], video_width=None)
    put(root / "train" / "s00" / "0005.json", '{"session_id": "s0')
    doc("test", "t", "0001", plan + [{"action_type": "KeyboardAction", "keyboard_action_type": "press", "keyboard_key": ["Control_L", "s"]},
                                     {"action_type": "KeyboardAction", "keyboard_action_type": "press", "keyboard_key": "Return"}])


def test_sessions_to_audited_corpus(spark, tmp_path):
    session_tree(tmp_path / "raw")
    p = prepare_sessions(IN.read_sessions(spark, str(tmp_path / "raw")))
    by = {r.split: r.n for r in p.steps.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert by == {"train": 33, "val": 3, "test": 2}
    assert {(r.split, r.reject_reason): r.n for r in p.rejects.collect()} == {
        ("train", "mouse:坐标越界"): 12, ("train", "其他:PlanAction"): 48, ("test", "其他:PlanAction"): 2, ("train", "其他:EvaluateSubTaskAction"): 12,
        ("train", "缺截图或分辨率"): 1, ("train", "unreadable"): 1}
    assert {r.action_type: r.n for r in p.stages.collect()} == {"MouseAction": 48, "PlanAction": 50, "EvaluateSubTaskAction": 12, "KeyboardAction": 2}
    assert p.plans.count() == 12 and p.reflections.count() == 12 and p.plans.first().subtasks == ["one", "two"]
    assert {r.text for r in p.steps.filter("split = 'test'").select("action.text").collect()} == {"Control_L+s", "Return"}
    r = p.steps.filter("session_id = 's01'").orderBy("file_name").collect()
    assert [x.thought for x in r] == ["因为。", "因为。", ""] and r[0].subtask == "打开" and tuple(r[0].action.point) == (.1, .1)
    # boxes: the first image's point is named, the second's is not
    from trajspark.functions.geometry import box
    boxes = p.steps.select("image").distinct().withColumn("box_id", F.lit(1)).withColumn("ord", F.lit(1)).withColumn(
        "bbox", box(F.lit(0.), F.lit(0.), F.lit(.2), F.lit(.2))).withColumn("text", F.lit("菜单"))
    steps = p.steps.withColumn("instruction", F.concat("instruction", F.lit(" "), "session_id"))
    c = build_corpus(steps, boxes, p.plans.withColumn("instruction", F.col("session_id")))
    assert {(r.split, r.kind): r.n for r in c.groupBy("split", "kind").agg(F.count("*").alias("n")).collect()} == {
        ("train", "action"): 11, ("val", "action"): 1, ("train", "plan"): 11, ("val", "plan"): 1}
    write_corpus(c, str(tmp_path / "out"))
    back = IN.read_split_expr(spark, str(tmp_path / "out" / "samples"), "train+val", c.select("split", "kind", "image", "prompt", "response", "width", "height").schema)
    assert back.count() == 24
    assert not any(r.n for r in audit_corpus(back, p.steps.filter("split = 'test'")).collect())


def test_root_names_are_not_patterns(spark, tmp_path):
    session_tree(tmp_path / "raw+v1.0" / "raw")
    docs = IN.read_sessions(spark, str(tmp_path / "raw+v1.0" / "raw"))
    assert {r.split for r in docs.select("split").distinct().collect()} == {"train", "test"}
    put(tmp_path / "twice" / "test" / "twice" / "b.json", '{"video_width": 5, "video_height": 5}')
    assert [r.split for r in IN.read_sessions(spark, str(tmp_path / "twice")).collect()] == ["test"]


def test_inventory_drops_rows_without_a_file(spark, tmp_path):
    session_tree(tmp_path / "raw")
    docs = IN.read_sessions(spark, str(tmp_path / "raw"))
    have = docs.filter("session_id in ('s01', 's02', 't')").select("image")
    assert prepare_sessions(docs, have).steps.select("session_id").distinct().count() == 3


def test_score_predictions(spark):
    from trajspark.functions.actions import action
    from trajspark.functions.geometry import point
    t = spark.range(4).select(F.col("id").alias("i"), action(F.lit("click"), point(F.lit(.1), F.lit(.1))).alias("action"))
    p = spark.range(3).select(F.col("id").alias("i"), action(F.lit("click"), point(F.lit(.1), F.lit(.15))).alias("pred_action"), F.lit("m").alias("config"))
    out = score_predictions(t, p)
    assert out["op_f1_summary"].first().micro_f1 == .75 and out["step_success"].first().rate == .75 and out["distance"].first().pairs == 3


def test_log_lines_are_parsed_once(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"t": 1, "event": "step", "n": 1}\n \n\t\n{"t": 2, "ev\nnull\n[]\n')
    log = IN.read_event_log(spark, str(tmp_path / "log.jsonl"))
    assert log._jdf.queryExecution().executedPlan().toString().count("from_json") == 1
    assert [(r.t, r.n) for r in log.collect()] == [(1.0, 1)]
