"""The three end-to-end jobs: build and audit a corpus, score predictions, summarise runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import audit as AU
from ..operators import counts as C
from ..operators import matching as J
from ..operators import metrics as M
from ..operators import normalize as N
from ..operators import runs as R
from ..operators import samples as SM
from ..operators import sessions as W
from ..operators import splits as U
from ..session import pin
from ..sources import sinks as OUT


@dataclass
class Prepared:
    """Normalised tables of one raw dataset."""

    steps: DataFrame        # accepted actions with split (train, val, test)
    plans: DataFrame        # plans of the training part with split
    reflections: DataFrame  # verdicts of the training part with split
    rejects: DataFrame      # counts per source part and reason
    stages: DataFrame       # counts per raw action kind


def prepare_sessions(docs: DataFrame, inventory: DataFrame | None = None, val_ratio: float = 0.1, seed: int = 42,
                     check_leak: bool = True) -> Prepared:
    """Session documents (see ``read_sessions``) to steps, plans and verdicts.

    Unreadable documents and those without image or resolution are counted and left out. The
    test part stays whole; the rest is split by session.
    """
    bad = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in docs.columns else F.lit(False)
    usable = ~bad & (F.coalesce("width", F.lit(0)) > 0) & (F.coalesce("height", F.lit(0)) > 0)
    good = docs.filter(usable)
    dropped = docs.filter(~usable).select("split", F.when(bad, "unreadable").otherwise(V.REASON_NO_ASSET).alias("reject_reason"))
    if inventory is not None:
        kept = N.require_assets(good, inventory, "image")
        lost = good.join(inventory.select("image").distinct(), "image", "left_anti")
        dropped = dropped.unionByName(lost.select("split", F.lit(V.REASON_NO_ASSET).alias("reject_reason")))
        good = kept
    facts = N.document_facts(N.mark_negative(good, "file_name"))
    keep = ["split", "session_id", "file_name", "image", "width", "height", "instruction", "instruction_zh",
            "subtask", "thought", "negative"]
    # five tables and the leak check come from this one, so it is written once
    exploded = pin(N.explode_actions(facts, keep))
    rejects = C.reject_report(N.rejected(exploded).select("split", "reject_reason").unionByName(dropped), "split")
    pool, held_out = U.respect_holdout(N.accepted(exploded))
    if check_leak:
        U.assert_disjoint(pool, held_out, "session_id")
    pool = U.split_by_group(pool.drop("split"), "session_id", val_ratio, seed)
    mapping = U.split_map(pool.select("session_id", "split"), "session_id")
    steps = pool.unionByName(held_out.select(*pool.columns))
    train = facts.filter(F.col("split") == "train").drop("split")
    plans = U.apply_split(N.extract_plans(train, [k for k in keep if k != "split"]), mapping, "session_id")
    verdicts = N.extract_reflections(exploded.filter(F.col("split") == "train").drop("split"))
    return Prepared(steps, plans, U.apply_split(verdicts, mapping, "session_id"), rejects, N.stage_counts(exploded))


def sample_order(*cols: str) -> Column:
    """One text that sorts like the columns and is as unique as they are.

    Digits are padded to 20 places; longer ones follow after those, by length. A null is its own text.
    """
    def part(c: str) -> Column:
        t = F.col(c).cast("string")
        n = F.length(t)
        return (F.when(t.isNull(), F.lit("")).when(~t.rlike(r"^\d+$"), t).when(n <= 20, F.lpad(t, 20, "0"))
                .otherwise(F.concat(F.lit("9~"), F.lpad(n.cast("string"), 10, "0"), t)))
    return F.concat_ws("|", *map(part, cols))


def build_corpus(steps: DataFrame, boxes: DataFrame, plans: DataFrame | None = None, grounding: DataFrame | None = None,
                 order=("file_name", "action_index"), train_split: str = "train", pad: float = 0.0, balance: bool = False,
                 seed: int = 42) -> DataFrame:
    """Two-stage action samples, plans and grounding samples as one de-duplicated corpus.

    boxes: image, box_id, ord, bbox, text. ``train_split`` may name several parts ("train+val").
    """
    wanted = train_split.split("+")
    hist = W.with_history(steps.filter(F.col("split").isin(*wanted, "val")), "session_id", list(order))
    hist = pin(hist.withColumn("ord", sample_order("session_id", *order)).withColumn("point", F.col("action.point")))
    named = J.locate_points(hist, boxes, "image", pad)
    d = SM.to_target_samples(named).filter(F.col("reject_reason").isNull())
    train, val = d.filter(F.col("split").isin(*wanted)).withColumn("split", F.lit("train")), d.filter("split = 'val'")
    if balance:
        ref = steps.filter(F.col("split").isin(*wanted)).select(F.col("action.type").alias("type"))
        train = U.balance_to_reference(train.withColumn("type", F.col("action.type")), ref, "type", "ord", seed).drop("type")
    cols = ["split", "kind", "source", "image", "width", "height", "prompt", "response", "elements_shown", "ord"]
    parts = [train.unionByName(val).select(*cols)]
    if plans is not None:
        p = SM.plan_samples(plans.filter(F.col("split").isin(*wanted, "val"))).withColumn(
            "split", F.when(F.col("split").isin(*wanted), "train").otherwise("val"))
        parts.append(p.withColumn("ord", sample_order("session_id", "file_name")).select(*[c for c in cols if c != "elements_shown"]))
    if grounding is not None:
        g = U.split_rows(grounding.withColumn("ord", sample_order("ord")), "ord", at_least_one=True, seed=seed)
        parts.append(g.select(*[c for c in cols if c != "elements_shown"]))
    return U.dedupe_samples(U.union_samples(*parts), order=("part", "ord"), within=("split",))


def write_corpus(corpus: DataFrame, path: str, train_split: str = "train") -> None:
    """Samples per split and the manifest beside them."""
    OUT.write_splits(corpus, path + "/samples")
    OUT.write_manifest(corpus.sparkSession, path + "/notes", train_split)


def audit_corpus(corpus: DataFrame, test: DataFrame | None = None, train_split: str = "train") -> DataFrame:
    return AU.audit(corpus, test, val_is_held_out="val" not in train_split.split("+"))


def score_predictions(truth: DataFrame, preds: DataFrame, config: str | None = None) -> dict[str, DataFrame]:
    """All tables of an action evaluation from truth (i, action) and predictions (i, pred_action)."""
    cases = J.build_cases(truth, preds)
    by = (config,) if config else ()
    if config:
        cases = cases.join(preds.select("i", config), "i", "left")
    per_class = M.op_f1(cases, by)
    return {"cases": cases, "op_f1": per_class, "op_f1_summary": M.f1_summary(per_class, by),
            "step_success": M.step_success(cases, by=by), "accuracy": M.accuracy_summary(cases, by),
            "distance": M.distance_summary(cases, by), "confusion": M.confusion(cases, by)}


def summarise_logs(logs: DataFrame) -> dict[str, DataFrame]:
    """Overall, per level, per task and configuration against configuration."""
    facts = R.run_facts(R.explode_records(R.valid_run_logs(logs)))
    return {"overall": R.summarize_runs(facts, ("config",)), "by_level": R.summarize_by_level(facts, by=("config",)),
            "by_task": R.summarize_by_task(facts, ("config",)), "compare": R.compare_configs(facts)}
