"""Driver-table queries for sources and sinks.

Each writes what Spark derives from the driver tables to a fresh place in the shared folder
and reads it back through the reader under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.udfs import predict
from ..operators import counts as C
from ..operators import normalize as N
from ..operators import runs as R
from ..session import pin, scratch_path
from ..sources import readers as IN
from ..sources import sinks as OUT
from . import tables as D
from .records import RAW_SQL, documents_of_actions
from .registry import query, with_


def r(c, name=None):
    return F.round(c, 6).alias(name or c)


# --- session documents ------------------------------------------------------------

def written_sessions(s, sf):
    """JSON files in folders below train/ and test/: unreadable documents one by one, the others of ten numbers as an array."""
    root = scratch_path(s, "sessions")
    docs = documents_of_actions(s, sf, 100)
    split = F.when(F.col("doc") % 5 == 0, "test").otherwise("train")
    body = F.to_json(F.struct(
        F.when(F.col("doc") % 4 != 0, F.concat(F.lit("s"), F.expr("doc div 4").cast("string"))).alias("session_id"),
        F.lit(1024).alias("video_width"), F.lit(768).alias("video_height"), F.concat(F.col("doc").cast("string"), F.lit(".png")).alias("saved_image_name"),
        F.lit("task").alias("task_prompt"), "actions"))
    broken = F.col("doc") % 50 == 7
    text = F.when(broken, F.lit('{"session_id": "broken')).otherwise(body)
    # one record per file; the partition folder is the session. The driver moves and lists folders, so there are fewer of them than files
    files = (docs.select(split.alias("part"), F.concat(F.lit("d"), F.expr("doc div 100").cast("string")).alias("name"), F.expr("doc div 10").alias("tens"),
                         F.when(broken, F.col("doc")).alias("alone"), text.alias("value"))
             .groupBy("part", "name", "tens", "alone").agg(F.collect_list("value").alias("v")))
    whole = F.when(F.size("v") == 1, F.get("v", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("v", ","), F.lit("]")))
    (files.select("part", "name", whole.alias("value")).repartition(64, "part", "name").write.option("maxRecordsPerFile", 1).partitionBy("part", "name").text(root))
    return root


@query("read_sessions_s1", """SELECT split, count(*) AS documents, count(*) FILTER (WHERE broken) AS unreadable, count(*) FILTER (WHERE NOT broken AND own) AS own_session, CAST(sum(CASE WHEN broken THEN 0 ELSE n END) AS BIGINT) AS actions FROM (
  SELECT CASE WHEN doc % 5 = 0 THEN 'part=test' ELSE 'part=train' END AS split, doc % 50 = 7 AS broken, doc % 4 <> 0 AS own, n FROM (SELECT event_id // 100 AS doc, count(*) AS n FROM events GROUP BY 1)) GROUP BY split""")
def _(s, sf):
    root = written_sessions(s, sf)
    d = read_text_documents(s, root)
    bad = F.col("_corrupt_record").isNotNull()
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("documents"), F.count_if(bad).alias("unreadable"),
                                  F.count_if(~bad & F.col("session_id").startswith("s")).alias("own_session"),
                                  F.sum(F.when(bad, 0).otherwise(F.size("actions"))).cast("long").alias("actions"))


def read_text_documents(s, root):
    # the text sink names its files *.txt, hence the pattern
    return IN.read_sessions(s, root, pattern="*.txt")


@query("prepare_sessions_s1_p2_q1", with_(RAW_SQL) + """SELECT 'part=' || CASE WHEN event_id // 100 % 5 = 0 THEN 'test' ELSE 'train' END AS split, reject_reason, count(*) AS n FROM norm WHERE event_id // 100 % 50 <> 7 GROUP BY ALL""")
def _(s, sf):
    d = read_text_documents(s, written_sessions(s, sf)).filter("_corrupt_record is null")
    e = N.explode_actions(d, ["split", "session_id"])
    return e.groupBy("split", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


# --- JSON lines -------------------------------------------------------------------

@query("read_jsonl_s2", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(s, sf):
    path = scratch_path(s, "lines")
    D.table(s, sf, "events").select("event_id", "event_type", D.number_in().alias("k")).write.json(path)
    return IN.read_jsonl(s, path, "event_id long, event_type string, k int")


@query("read_jsonl_first_s2", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 500")
def _(s, sf):
    path = scratch_path(s, "lines")
    D.table(s, sf, "events").select("event_id", "event_type").write.json(path)
    return IN.read_jsonl(s, path, "event_id long, event_type string", limit=500, order="event_id")


def log_lines(s, sf):
    """Steps as log lines; every 97th is cut in half, every 101st is followed by a blank one."""
    st = D.steps(s, sf)
    js = F.to_json(F.struct((F.col("n") / 10.0).alias("t"), F.lit("step").alias("event"), F.col("n").cast("int").alias("n"), "ok", "error", "changed",
                            "elapsed", F.col("run").cast("string").alias("run_id"), F.when(F.col("k") % 10 < 6, "need_retry").otherwise("sub_task_success").alias("situation"),
                            F.struct("type").alias("action")))
    line = F.when(F.col("n") % 97 == 0, F.substring(js, 1, 40)).otherwise(js)
    return st.select(F.explode(F.when(F.col("n") % 101 == 0, F.array(line, F.lit("   "))).otherwise(F.array(line))).alias("value"))


@query("read_event_log_s3", with_(D.STEPS_SQL) + "SELECT CAST(run AS VARCHAR) AS run_id, CAST(n AS INT) AS n, ok, changed, round(elapsed, 6) AS elapsed FROM steps WHERE n % 97 <> 0")
def _(s, sf):
    path = scratch_path(s, "log")
    log_lines(s, sf).write.text(path)
    return IN.read_event_log(s, path).select("run_id", "n", "ok", "changed", r("elapsed"))


# --- columnar reads ---------------------------------------------------------------

@query("read_columns_s4", "SELECT page_id, url FROM pages")
def _(s, sf):
    return IN.read_web_steps(s, f"{sf}/pages.parquet", columns=("page_id", "url"))


@query("read_shards_s5", "SELECT lang, count(*) AS n FROM documents WHERE doc_id % 4 IN (0, 1) GROUP BY lang")
def _(s, sf):
    root = scratch_path(s, "shards")
    d = D.table(s, sf, "documents").select("doc_id", "lang")
    for i in range(4):
        d.filter(F.col("doc_id") % 4 == i).write.parquet(f"{root}/train-{i:05d}.parquet")
    d.write.parquet(f"{root}/test-00000.parquet")
    shards = IN.read_shards(s, root, "train", 2, ["lang"])
    return shards.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("read_task_specs_s6_p25", """SELECT CAST(c_custkey AS INT) AS task_id, c_name AS instruction, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS template,
 CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS param, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END AS n_sites, c_custkey % 5 = 0 AS requires_login,
 CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'string_match,url' END AS checks FROM customer""")
def _(s, sf):
    return spec_table(s, sf).select("task_id", "instruction", "template", F.coalesce(F.try_element_at("params", F.lit("n")), F.lit("")).alias("param"),
                                    F.size("sites").alias("n_sites"), "requires_login", F.array_join("check_types", ",").alias("checks"))


def spec_table(s, sf):
    """Task specifications with missing parts, written as JSON and flattened again."""
    path = scratch_path(s, "specs")
    i = F.col("c_custkey")
    c = D.table(s, sf, "customer").select(
        i.cast("int").alias("task_id"), F.col("c_name").alias("intent"), F.when(i % 3 != 0, F.col("c_mktsegment")).alias("intent_template"),
        F.col("c_nationkey").alias("intent_template_id"), F.when(i % 2 == 0, F.struct(F.col("c_nationkey").alias("n"))).alias("instantiation_dict"),
        F.when(i % 4 != 0, F.array("c_mktsegment")).alias("sites"), F.when(i % 5 == 0, True).alias("require_login"),
        F.when(i % 7 != 0, F.struct(F.array(F.lit("string_match"), F.lit("url")).alias("eval_types"))).alias("eval"))
    # files hold one array of specifications each
    files = c.groupBy(F.expr("task_id div 1000").alias("file")).agg(F.to_json(F.collect_list(F.struct(*c.columns))).alias("value"))
    files.write.partitionBy("file").text(path)
    return N.flatten_specs(IN.read_task_specs(s, path).drop("file"))


@query("spec_counts_a2", """SELECT item, count(*) AS n FROM (SELECT c_mktsegment AS item FROM customer WHERE c_custkey % 4 <> 0) GROUP BY item""")
def _(s, sf):
    return C.array_value_counts(spec_table(s, sf), "sites")


@query("read_metadata_s7", "SELECT vec_id, label FROM embeddings")
def _(s, sf):
    return IN.read_metadata(s, f"{sf}/embeddings.parquet", drop=("embedding",))


# --- run logs ---------------------------------------------------------------------

def written_logs(s, sf):
    """Log documents per configuration, below the name a run would give it."""
    root = scratch_path(s, "logs")
    f = D.facts(s, sf)
    rec = F.struct("task", "level", F.col("run").cast("int").alias("run"), "passed", F.col("n_steps").cast("int").alias("steps"),
                   F.coalesce("wall_time", F.lit(0.0)).alias("wall_time"), F.col("retries").cast("int").alias("retries"),
                   F.when(F.col("ran"), F.struct(F.transform(F.sequence(F.lit(1), F.col("n_steps").cast("int")), lambda i: F.struct(
                       (i > F.col("error_steps")).alias("ok"))).alias("steps"))).alias("trajectory"))
    # a log document holds the records of one batch of runs: a thousand run numbers at most
    logs = f.groupBy("config", "task", F.expr("run div 1000").alias("batch")).agg(F.collect_list(rec).alias("records")).withColumn("live", F.col("task") != "task3")
    logs = logs.withColumn("records", F.when(F.col("task") == "task5", F.array().cast(logs.schema["records"].dataType)).otherwise(F.col("records")))
    # a file holds the documents of ten batches as one array, so there are files by the number of runs, not of documents
    files = pin(logs.groupBy("config", F.expr("batch div 10").alias("file")).agg(F.collect_list(F.struct("task", "records", "live")).alias("docs"))
                .select("config", F.to_json("docs").alias("value")))
    for config in ("cfg0", "cfg1", "cfg2"):
        (files.filter(F.col("config") == config).select("value").write.option("maxRecordsPerFile", 1)
         .text(f"{root}/tasks_live_{config}_suite.json"))
    return root


@query("run_logs_s8_s9_u9_j13", with_(D.FACTS_SQL) + """SELECT config, count(*) AS runs, count(*) FILTER (WHERE passed) AS passed, CAST(sum(n_steps) AS BIGINT) AS steps, CAST(sum(error_steps) AS BIGINT) AS error_steps,
 count(*) FILTER (WHERE NOT ran) AS aborted FROM facts WHERE task NOT IN ('task3', 'task5') GROUP BY config""")
def _(s, sf):
    logs = IN.read_run_logs(s, written_logs(s, sf)).withColumn("config", R.legend_label(F.col("config")))
    recs = R.explode_records(R.valid_run_logs(logs))
    return R.summarize_runs(R.run_facts(recs), ("config",)).select("config", "runs", "passed", "steps", "error_steps", "aborted")


@query("log_labels_s8", """SELECT DISTINCT 'live_cfg' || o_orderkey % 3 || '_suite' AS config, CASE o_orderkey % 3 WHEN 0 THEN 'base' ELSE 'cfg' || o_orderkey % 3 END AS legend FROM orders""")
def _(s, sf):
    names = D.runs(s, sf).select(F.concat(F.lit("tasks_live_"), "config", F.lit("_suite.json")).alias("log")).distinct()
    c = R.config_label(F.col("log"))
    return names.select(c.alias("config"), R.legend_label(c, {"cfg0": "base"}).alias("legend"))


# --- sinks ------------------------------------------------------------------------

@query("write_splits_s11_s18", """SELECT split, count(*) AS n, CAST(sum(turn) AS BIGINT) AS turns FROM (SELECT turn, CASE turn % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM conversations) WHERE split <> 'test' GROUP BY split""")
def _(s, sf):
    path = scratch_path(s, "splits")
    t = F.col("turn") % 3
    c = D.table(s, sf, "conversations").withColumn("split", F.when(t == 0, "train").when(t == 1, "val").otherwise("test"))
    OUT.write_splits(c, path)
    d = IN.read_split_expr(s, path, "train+val", "conv_id long, turn long, role string, text string, split string")
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("turn").alias("turns"))


@query("manifest_s12", "SELECT role, count(*) AS n, false AS val_is_held_out FROM conversations GROUP BY role")
def _(s, sf):
    path = scratch_path(s, "manifest")
    OUT.write_manifest(s, path, "train+val")
    m = IN.read_manifest(s, path)
    return D.table(s, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "val_is_held_out", F.lit(m["val_is_held_out"]))


@query("materialize_missing_s14_f3", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE length(text) END AS feature FROM documents")
def _(s, sf):
    return materialized(s, sf)[0]


def materialized(s, sf):
    d = D.table(s, sf, "documents").select("doc_id", "text")
    cache = d.filter("doc_id % 3 = 0").select("doc_id", F.lit(-1).cast("long").alias("feature"))

    def featurize(missing):
        return predict(missing, lambda: len, lambda model, pdf: pdf["text"].map(model), "feature", "bigint").select("doc_id", "feature")

    path = scratch_path(s, "features")
    cache.write.parquet(path)
    first = OUT.materialize_missing(d, path, "doc_id", "doc_id long, feature long", featurize)
    again = OUT.materialize_missing(d, path, "doc_id", "doc_id long, feature long", featurize)
    return again[0], first[1].withColumn("computed_again", again[1].select("computed").scalar())


@query("materialize_counts_s14", "SELECT count(*) FILTER (WHERE doc_id % 3 = 0) AS hits, count(*) FILTER (WHERE doc_id % 3 <> 0) AS computed, CAST(0 AS BIGINT) AS computed_again FROM documents")
def _(s, sf):
    return materialized(s, sf)[1]


@query("require_cached_s15", "SELECT doc_id, quality FROM labels")
def _(s, sf):
    lab = D.table(s, sf, "labels")
    return OUT.require_cached(lab.select("doc_id"), lab.select("doc_id", "quality"), "doc_id").select("doc_id", "quality")


@query("write_report_s16", with_(D.FACTS_SQL) + """SELECT task, max(n) FILTER (WHERE config = 'cfg0') AS cfg0, max(n) FILTER (WHERE config = 'cfg1') AS cfg1, max(n) FILTER (WHERE config = 'cfg2') AS cfg2
 FROM (SELECT task, config, count(*) FILTER (WHERE passed) AS n FROM facts GROUP BY ALL) GROUP BY task""")
def _(s, sf):
    t = R.summarize_by_task(D.facts(s, sf), ("config",)).select("config", "task", "passed")
    return OUT.write_report(t, scratch_path(s, "report"), "task", "config", "passed")


@query("predict_f2", with_(D.STEPS_SQL) + "SELECT n, upper(type) AS pred FROM steps")
def _(s, sf):
    d = D.steps(s, sf).select("n", "type")
    return predict(d, lambda: str.upper, lambda model, pdf: pdf["type"].map(model), "pred").select("n", "pred")


@query("file_inventory_q1", "SELECT CAST(count(DISTINCT lang) AS BIGINT) AS folders FROM documents")
def _(s, sf):
    path = scratch_path(s, "assets")
    D.table(s, sf, "documents").select("doc_id", "lang").write.partitionBy("lang").parquet(path)
    inv = IN.file_inventory(s, path, "*.parquet")
    return inv.select(F.regexp_extract("image", "lang=([a-z]+)", 1).alias("lang")).agg(F.count_distinct("lang").alias("folders"))
