"""Run records: gating, summaries, comparisons, trajectory documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.actions import ACTION_SCHEMA
from ..functions.stats import ratio, share, wilson
from ..functions.strings import nonempty
from .ordered import HOT_ROWS, OrderedRows

TRAJECTORY_SCHEMA = (f"struct<task_id:string,success:boolean,wall_time:double,retries:int,"
                     f"steps:array<struct<action:{ACTION_SCHEMA},ok:boolean,error:string,changed:boolean,elapsed:double>>>")
RECORD_SCHEMA = ("struct<task:string,level:string,run:int,passed:boolean,steps:int,wall_time:double,"
                 f"actions:array<string>,retries:int,error:string,trajectory:struct<steps:array<struct<ok:boolean>>>>")
RUN_LOG_SCHEMA = (f"live boolean, model string, adapter string, resolution string, plan boolean, "
                  f"inject_failures double, retry_limit int, records array<{RECORD_SCHEMA}>")


def valid_run_logs(logs: DataFrame) -> DataFrame:
    """Readable, live logs with at least one record."""
    ok = F.coalesce(F.col("live"), F.lit(False)) & (F.coalesce(F.size("records"), F.lit(0)) > 0)
    if "_corrupt_record" in logs.columns:
        ok = ok & F.col("_corrupt_record").isNull()
    return logs.filter(ok)


def explode_records(logs: DataFrame, keep=("config",)) -> DataFrame:
    return logs.select(*keep, F.explode("records").alias("r")).select(*keep, "r.*")


def run_facts(records: DataFrame) -> DataFrame:
    """Per record: did it run, how many steps, how many failed (a missing ``ok`` counts as fine)."""
    steps = F.col("trajectory.steps")
    return (records.withColumn("ran", F.col("trajectory").isNotNull())
            .withColumn("n_steps", F.coalesce(F.size(steps), F.lit(0)))
            .withColumn("error_steps", F.coalesce(F.size(F.filter(
                steps, lambda s: ~F.coalesce(s["ok"], F.lit(True)))), F.lit(0))))


def facts_from_steps(runs: DataFrame, steps: DataFrame, run_key: str, ok: str = "ok", elapsed: str = "elapsed") -> DataFrame:
    """The same from a flat step table: steps are pre-aggregated per run before the join."""
    per = steps.groupBy(run_key).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.count_if(~F.coalesce(F.col(ok), F.lit(True))).alias("error_steps"),
        F.sum(elapsed).alias("wall_time"))
    return (runs.join(per, run_key, "left")
            .withColumn("ran", F.col("n_steps").isNotNull())
            .withColumn("n_steps", F.coalesce("n_steps", F.lit(0)))
            .withColumn("error_steps", F.coalesce("error_steps", F.lit(0))))


def summarize_runs(facts: DataFrame, by=()) -> DataFrame:
    """Success rate with its interval over all records; times and steps over those that ran."""
    ran, passed = F.col("ran"), F.coalesce(F.col("passed"), F.lit(False))
    s = facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(passed).alias("passed"),
        F.avg(F.when(ran, F.col("wall_time"))).alias("avg_wall_time"),
        F.avg(F.when(ran & passed, F.col("wall_time"))).alias("avg_wall_time_passed"),
        F.avg(F.when(ran, F.col("n_steps"))).alias("avg_steps"),
        F.coalesce(F.sum(F.when(ran, F.col("n_steps"))), F.lit(0)).cast("long").alias("steps"),
        F.coalesce(F.sum(F.when(ran, F.col("error_steps"))), F.lit(0)).cast("long").alias("error_steps"),
        F.coalesce(F.sum(F.when(ran, F.col("retries"))), F.lit(0)).cast("long").alias("retries"),
        F.count_if(~ran).alias("aborted"))
    ci = wilson("passed", "runs")
    return s.select(*by, "runs", "passed", ratio("passed", "runs").alias("success_rate"),
                    ci["low"].alias("ci_low"), ci["high"].alias("ci_high"),
                    "avg_wall_time", "avg_wall_time_passed", "avg_steps", "steps", "error_steps",
                    ratio("error_steps", "steps").alias("error_rate"), "retries", "aborted")


def summarize_by_level(facts: DataFrame, levels=V.LEVELS, by=()) -> DataFrame:
    """Per difficulty level in its fixed order; levels without records do not appear."""
    order = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col("level"))
    s = summarize_runs(facts.filter(F.col("level").isin(*levels)), (*by, "level"))
    return s.withColumn("level_order", order.cast("int")).orderBy(*by, "level_order")


def summarize_by_task(facts: DataFrame, by=()) -> DataFrame:
    """Runs and passes per task with the level of its first run."""
    first = F.min(F.struct("run", "level"))
    return facts.groupBy(*by, "task").agg(
        first["level"].alias("level"), F.count(F.lit(1)).alias("runs"),
        F.count_if(F.coalesce(F.col("passed"), F.lit(False))).alias("passed"))


def compare_configs(facts: DataFrame, configs=None) -> DataFrame:
    """One row per task, one ``passed/runs`` cell per configuration, null where it was not run."""
    n = F.count(F.lit(1))
    cell = F.when(n > 0, F.concat(F.count_if(F.coalesce(F.col("passed"), F.lit(False))).cast("string"), F.lit("/"),
                                  n.cast("string")))
    return facts.groupBy("task").pivot("config", list(configs) if configs else None).agg(cell)


def level_rates(facts: DataFrame, levels=V.LEVELS) -> DataFrame:
    """Chart series: pass rate per configuration and level (dry runs are not left out here)."""
    return facts.groupBy("config").pivot("level", list(levels)).agg(share(F.col("passed")))


def dataset_totals(facts: DataFrame) -> DataFrame:
    """Mean steps and wall time over all records, sum of retries."""
    return facts.agg(F.count(F.lit(1)).alias("runs"), F.avg("n_steps").alias("avg_steps"),
                     F.avg(F.coalesce("wall_time", F.lit(0.0))).alias("avg_wall_time"),
                     F.coalesce(F.sum("retries"), F.lit(0)).cast("long").alias("retries"))


def resolve_first(df: DataFrame, label, priority: str, usable: Column | None = None) -> DataFrame:
    """First usable candidate per label in priority order (pruned per task before the shuffle)."""
    d = df.filter(usable) if usable is not None else df
    labels = [label] if isinstance(label, str) else list(label)
    w = W.partitionBy(*labels).orderBy(priority)
    return d.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def run_finish_summary(steps: DataFrame, run: str, retries: Column | None = None) -> DataFrame:
    """What the log's closing event holds: steps, changed and unchanged steps, retries, wall time."""
    changed = F.col("changed")
    return steps.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if(changed).alias("changed_steps"),
        F.count_if(changed == F.lit(False)).alias("unchanged_steps"),
        F.count_if(retries if retries is not None else ~F.col("ok")).alias("retries"),
        F.round(F.sum("elapsed"), 2).alias("wall_time"))


def assemble_trajectories(runs: DataFrame, steps: DataFrame, run: str, order, step: Column,
                          chunk: int = 10_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Nested documents from runs and steps.

    Every run is ``n_parts`` documents (at least one) of at most ``chunk`` steps each, numbered by
    ``part``, so no group is ever collected whole. Totals are those of the whole run.
    """
    placed = OrderedRows(steps, run, order, hot_rows).position("_pos").df()
    totals = placed.groupBy(run).agg(F.count(F.lit(1)).alias("n_steps"),
                                     F.round(F.sum("elapsed"), 3).alias("wall_time"))
    docs = (placed.withColumn("part", F.expr(f"cast((_pos - 1) div {int(chunk)} as int)"))
            .groupBy(run, "part")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_pos"), step.alias("s"))),
                              lambda a, b: (a["_pos"] - b["_pos"]).cast("int")).alias("_steps"))
            .withColumn("steps", F.transform("_steps", lambda x: x["s"])).drop("_steps"))
    return (runs.join(totals, run, "left").join(docs, run, "left")
            .withColumn("n_steps", F.coalesce("n_steps", F.lit(0).cast("long")))
            .withColumn("part", F.coalesce("part", F.lit(0)))
            .withColumn("n_parts", F.greatest(F.lit(1), F.ceil(F.col("n_steps") / chunk).cast("int"))))


def config_label(file_name) -> Column:
    """Configuration name from a log file name: fixed prefix and suffix removed."""
    stem = F.regexp_replace(file_name, r"\.json$", "")
    return F.regexp_replace(stem, f"^{V.RUN_LOG_PREFIX}", "")


def legend_label(config, names: dict | None = None) -> Column:
    """Legend form: channel prefixes and the suite suffix removed, then a name table."""
    from ..functions.actions import literal_map
    c = F.regexp_replace(config, f"{V.RUN_LOG_SUFFIX}$", "")
    for ch in V.RUN_LOG_CHANNELS:
        c = F.regexp_replace(c, f"^{ch}", "")
    return F.coalesce(F.try_element_at(literal_map(names), c), c) if names else c


def outstanding(jobs: DataFrame, running: DataFrame, done: DataFrame, key: str, order: str) -> DataFrame:
    """Submitted jobs that neither run nor are finished, oldest first."""
    return (jobs.join(running.select(key), key, "left_anti").join(done.select(key), key, "left_anti")
            .orderBy(order, key))


def failed_receipts(receipts: DataFrame) -> DataFrame:
    """Receipts with an error text or any exit code but 0 (none counts as failed)."""
    return receipts.filter(nonempty("error").isNotNull() | ~F.coalesce(F.col("exit_code") == 0, F.lit(False)))


def stale_workers(beats: DataFrame, now: Column, max_age: float = V.HEARTBEAT_MAX_AGE,
                  worker: str = "worker", ts: str = "beat") -> DataFrame:
    """Last beat and age per worker; alive if at most ``max_age`` seconds old, no beat = dead."""
    last = beats.groupBy(worker).agg(F.max(ts).alias("last_beat"))
    age = now - F.col("last_beat")
    return last.select(worker, "last_beat", age.alias("age"),
                       F.coalesce(age <= max_age, F.lit(False)).alias("alive"))


def diff_snapshots(before: DataFrame, after: DataFrame, keys, values=()) -> DataFrame:
    """Entities that were added, and scalars that changed; a missing value equals a missing value."""
    keys = list(keys)
    added = after.join(before.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.lit("added").alias("change"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    out = added
    if values:
        b = before.select(*keys, *[F.col(v).alias("_b_" + v) for v in values])
        # one join; every value that differs becomes a row of its own
        changes = F.array_compact(F.array(*[F.when(~F.col(v).eqNullSafe(F.col("_b_" + v)), F.struct(
            F.lit("changed:" + v).alias("change"), F.col("_b_" + v).cast("string").alias("old"), F.col(v).cast("string").alias("new"))) for v in values]))
        out = out.unionByName(after.join(b, keys).select(*keys, F.explode(changes).alias("_c")).select(*keys, "_c.*"))
    return out


def acceptance(tasks: DataFrame, rules: dict, task: str = "task") -> DataFrame:
    """Apply each task's acceptance rule (a SQL predicate over before/after columns)."""
    verdict = F.lit(None).cast("boolean")
    for name, rule in rules.items():
        verdict = F.when(F.col(task) == name, F.coalesce(F.expr(rule), F.lit(False))).otherwise(verdict)
    return tasks.withColumn("passed", verdict)
