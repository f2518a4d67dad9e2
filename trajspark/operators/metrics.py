"""Scoring of per-step predictions.

Input is a ``cases`` table: i, gt, pred, dist (nullable), gt_text, pred_text. All tables take
``by`` columns (configuration, category ...), so many configurations cost one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.stats import f1, ratio, share
from ..functions.strings import strip
from ..session import pin
from .counts import counted_values, medians, medians_of, value_counts


def text_ok(gt_text="gt_text", pred_text="pred_text") -> Column:
    """Trimmed, case-blind equality; without a true text anything passes."""
    want = F.lower(strip(F.coalesce(F.col(gt_text), F.lit(""))))
    return (want == "") | (F.lower(strip(F.coalesce(F.col(pred_text), F.lit("")))) == want)


def type_ok() -> Column:
    return F.col("gt") == F.col("pred")


def op_ok(keyboard=V.KEYBOARD_TYPES) -> Column:
    """Type right, and for keyboard actions the text as well."""
    return type_ok() & (~F.col("gt").isin(*keyboard) | text_ok())


def near(threshold) -> Column:
    return F.col("dist").isNull() | (F.col("dist") <= threshold)


def step_ok(threshold=V.JOINT_DISTANCE, keyboard=V.KEYBOARD_TYPES, require_text: bool = True) -> Column:
    return (op_ok(keyboard) if require_text else type_ok()) & near(threshold)


def case_cube(cases: DataFrame, by=(), keyboard=V.KEYBOARD_TYPES, thresholds=V.STEP_THRESHOLDS) -> DataFrame:
    """Cases counted per (by, gt, pred): n, op_ok and the steps done right at each threshold.

    A few rows per group, from which the per-class and overall metrics follow; the cases are
    read and shuffled once.
    """
    return cases.groupBy(*by, "gt", "pred").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(op_ok(keyboard)).alias("op_ok"),
        F.count("pred_text").alias("with_text"),
        *[F.count_if(step_ok(t, keyboard)).alias(f"step_ok_{j}") for j, t in enumerate(thresholds)])


def op_f1(cases: DataFrame, by=(), keyboard=V.KEYBOARD_TYPES, failed: str = V.PARSE_FAILED) -> DataFrame:
    """Per class: precision, recall, F1 and counts. A failed row counts against its true class only."""
    return op_f1_of(case_cube(cases, by, keyboard, ()), by, failed)


def op_f1_of(cube: DataFrame, by=(), failed: str = V.PARSE_FAILED, carry=()) -> DataFrame:
    """The same from a cube; ``carry`` columns of the cube are summed up with the true class."""
    def part(cls, gt, pred, hit, own):
        none = F.lit(0).cast("long")
        return F.struct(F.col(cls).alias("cls"), *[(F.col(v) if v else none).alias(k) for k, v in (
            ("gt", gt), ("pred", pred), ("hit", hit))], *[(F.col(c) if own else none).alias(c) for c in carry])

    entry = F.explode(F.array(part("gt", "n", None, None, True), part("pred", None, "n", "op_ok", False)))
    c = (cube.select(*by, entry.alias("e")).filter(F.col("e.cls") != failed)
         .groupBy(*by, F.col("e.cls").alias("cls"))
         .agg(*[F.sum(f"e.{k}").alias(k) for k in ("gt", "pred", "hit", *carry)]))
    c = (c.withColumn("precision", F.coalesce(ratio("hit", "pred"), F.lit(0.0)))
         .withColumn("recall", F.coalesce(ratio("hit", "gt"), F.lit(0.0))))
    return c.select(*by, "cls", "gt", "pred", "hit", "precision", "recall", f1("precision", "recall").alias("f1"), *carry)


def f1_summary(per_class: DataFrame, by=()) -> DataFrame:
    """Macro F1 over classes with support and micro F1; null on empty input."""
    return per_class.groupBy(*by).agg(
        F.avg(F.when(F.col("gt") > 0, F.col("f1"))).alias("macro_f1"),
        F.try_divide(F.sum("hit").cast("double"), F.sum("gt").cast("double")).alias("micro_f1"))


def op_f1_summary(cases: DataFrame, by=(), keyboard=V.KEYBOARD_TYPES) -> DataFrame:
    return f1_summary(op_f1(cases, by, keyboard), by)


def step_success(cases: DataFrame, thresholds=V.STEP_THRESHOLDS, by=(), keyboard=V.KEYBOARD_TYPES) -> DataFrame:
    """Share of steps done right at each distance threshold, one scan for all of them."""
    sums = [F.count_if(step_ok(t, keyboard)).alias(f"_ok{j}") for j, t in enumerate(thresholds)]
    g = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_ok{j}").alias("ok"))
                               for j, t in enumerate(thresholds)]))
    return g.select(*by, "n", rows.alias("r")).select(
        *by, "r.threshold", "r.ok", "n", ratio("r.ok", "n").alias("rate"))


def accuracy_summary(cases: DataFrame, by=(), keyboard=V.KEYBOARD_TYPES, threshold=V.JOINT_DISTANCE,
                     require_text: bool = False, failed: str = V.PARSE_FAILED, extra=()) -> DataFrame:
    """Type accuracy, joint accuracy, keyboard recall (failures not in its base), failure rate."""
    is_kb = F.col("gt").isin(*keyboard) & (F.col("pred") != failed)
    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        share(type_ok()).alias("type_accuracy"),
        share(step_ok(threshold, keyboard, require_text)).alias("joint_accuracy"),
        F.count_if(F.col("pred") == failed).alias("parse_failures"),
        share(F.col("pred") == failed).alias("unexecutable_rate"),
        F.count_if(is_kb).alias("keyboard_total"),
        F.try_divide(F.count_if(is_kb & F.col("pred").isin(*keyboard)).cast("double"),
                     F.count_if(is_kb).cast("double")).alias("keyboard_recall"), *extra)


def distance_summary(cases: DataFrame, by=(), thresholds=V.HIT_THRESHOLDS) -> DataFrame:
    """Pairs, mean, both medians and the share within each threshold (``hit_0_05`` ...).

    Distances have three digits, so everything is taken from counts per distinct distance.
    """
    c = counted_values(cases, "dist", by)
    n = F.sum("_n")
    hits = [F.try_divide(F.sum(F.when(F.col("_v") <= t, F.col("_n")).otherwise(0)).cast("double"), n.cast("double"))
            .alias("hit_" + str(t).replace(".", "_")) for t in thresholds]
    base = c.groupBy(*by).agg(n.alias("pairs"), F.try_divide(F.sum(F.col("_v") * F.col("_n")), n).alias("mean_dist"), *hits)
    m = medians_of(c, by).drop("n_values")
    if by:
        return base.join(m, list(by))
    return base.withColumn("_j", F.lit(0)).join(m.withColumn("_j", F.lit(0)), "_j").drop("_j")


def confusion(cases: DataFrame, by=(), top: int | None = None) -> DataFrame:
    """Pairs of true and predicted type, most common first; failures are a predicted value."""
    return value_counts(cases, *by, "gt", "pred", limit=top)


def confusion_map(cases: DataFrame, by=()) -> DataFrame:
    """The same as one map ``gt->pred`` per group (as many entries as pairs of types)."""
    g = cases.groupBy(*by, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(
        F.concat("gt", F.lit("->"), "pred"), "n")))).alias("confusion"))


def confusion_matrix(cases: DataFrame, types=None) -> DataFrame:
    return cases.groupBy("gt").pivot("pred", list(types) if types else None).agg(F.count(F.lit(1)))


def by_category(cases: DataFrame, category: str, keyboard=V.KEYBOARD_TYPES) -> DataFrame:
    """Loose (type only) and strict (text, distance) rates per category."""
    return cases.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"), share(type_ok()).alias("type_accuracy"),
        share(step_ok(V.JOINT_DISTANCE, keyboard)).alias("joint_accuracy"),
        share(op_ok(keyboard)).alias("micro_f1"))


def session_success(cases: DataFrame, session: str, keyboard=V.KEYBOARD_TYPES) -> DataFrame:
    """A session is done when all of its steps are right: counts and rate."""
    per = cases.groupBy(session).agg(F.bool_and(F.coalesce(step_ok(V.JOINT_DISTANCE, keyboard), F.lit(False)))
                                     .alias("done"))
    return per.agg(F.count(F.lit(1)).alias("sessions"), F.count_if("done").alias("sessions_done"),
                   share(F.col("done")).alias("session_success"))


def f1_matrix(cases: DataFrame, config: str, keyboard=V.KEYBOARD_TYPES, thin: int = V.THIN_SUPPORT) -> DataFrame:
    """F1 per configuration and supported class, with the class support and a flag for thin classes."""
    m = op_f1(cases, (config,), keyboard).filter(F.col("gt") > 0)
    return m.select(config, "cls", "f1", F.col("gt").alias("support"), (F.col("gt") < thin).alias("thin"))


def leaderboard(cases: DataFrame, config: str, keyboard=V.KEYBOARD_TYPES) -> DataFrame:
    """All configurations with their headline metrics, best step success first.

    One scan: cases to cube, cube to classes, classes to configurations.
    """
    cube = case_cube(cases, (config,), keyboard).withColumn(
        "failed", F.when(F.col("pred") == V.PARSE_FAILED, F.col("n")).otherwise(F.lit(0).cast("long")))
    per = op_f1_of(cube, (config,), carry=("step_ok_0", "step_ok_1", "failed", "with_text"))
    n = F.sum("gt")
    return per.groupBy(config).agg(
        n.alias("n"), F.avg(F.when(F.col("gt") > 0, F.col("f1"))).alias("macro_f1"),
        F.try_divide(F.sum("hit"), n).alias("micro_f1"), F.try_divide(F.sum("step_ok_0"), n).alias("step_sr_010"),
        F.try_divide(F.sum("step_ok_1"), n).alias("step_sr_014"), F.try_divide(F.sum("failed"), n).alias("unexecutable"),
        (F.sum("with_text") > 0).alias("text_compared")).orderBy(F.desc("step_sr_010"), config)


def compare_variants(cases: DataFrame, variant: str, latency: str | None = None,
                     keyboard=V.KEYBOARD_TYPES) -> DataFrame:
    """One row per prompt variant: accuracies, recall, median distance, failures, latency."""
    extra = [F.avg(latency).alias("sec_per_sample")] if latency else []
    a = accuracy_summary(cases, (variant,), keyboard, extra=extra)
    m = medians(cases, "dist", (variant,)).select(
        variant, F.col("n_values").alias("pointed_pairs"), F.col("median_mid").alias("median_distance"))
    return a.join(m, variant, "left")


def best_step(log: DataFrame, by=()) -> DataFrame:
    """The step with the lowest validation loss, the earliest on ties."""
    d = log.filter(F.col("val_loss").isNotNull())
    best = F.min(F.struct("val_loss", "step"))
    return d.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.step").alias("best_step"),
                                                      F.col("b.val_loss").alias("best_val_loss"))


def output_profile(outputs: DataFrame, by=(), at_cap: int = 250) -> DataFrame:
    """Format statistics of model outputs.

    Needs raw, tokens, gt and the parsed columns has_json, has_action, pred of ``parse_outputs``.
    """
    raw = F.col("raw")
    cjk = raw.rlike("\"thought\"\\s*:\\s*\"[^\"]*[一-鿿]")
    # flags per output are pinned, so the parsing behind them runs once
    flags = {"fenced": raw.contains("```"), "reasoning": raw.contains("<think>") | raw.contains("</think>"),
             "at_cap": F.col("tokens") >= at_cap, "thought_cjk": cjk, "parses": F.col("has_json"),
             "has_action": F.col("has_action"), "type_right": F.col("pred") == F.col("gt")}
    d = pin(outputs.select(*by, "tokens", *[c.alias(k) for k, c in flags.items()]))
    base = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(k).alias(k) for k in flags],
                              F.max("tokens").cast("long").alias("max_tokens"))
    m = medians(d, "tokens", by).select(*by, F.col("median_upper").cast("long").alias("median_tokens"))
    if by:
        return base.join(m, list(by))
    return base.withColumn("_j", F.lit(0)).join(m.withColumn("_j", F.lit(0)), "_j").drop("_j")


def plan_quality(plans: DataFrame, by=()) -> DataFrame:
    """Coverage (mean, median), surplus steps, over-long and empty plans. Needs coverage, surplus, empty.

    Three numbers per plan are pinned, so the text comparison behind them runs once.
    """
    plans = pin(plans.select(*by, "coverage", "surplus", "empty"))
    base = plans.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("coverage").alias("coverage_mean"), F.avg("surplus").alias("surplus_mean"),
        F.count_if(F.col("surplus") > 0).alias("too_long"), F.count_if("empty").alias("empty"))
    m = medians(plans, "coverage", by).select(*by, F.col("median_mid").alias("coverage_median"))
    if by:
        return base.join(m, list(by))
    return base.withColumn("_j", F.lit(0)).join(m.withColumn("_j", F.lit(0)), "_j").drop("_j")
