"""Row-level quality rules: cascades, screens, length and budget rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.actions import normalize_hotkey
from ..functions.stats import share
from ..functions.strings import let, strip
from ..functions.udfs import approx_tokens


def reject_cascade(df: DataFrame, rules, name: str = "reject_reason") -> DataFrame:
    """Add the first reason whose condition holds; null conditions do not hold."""
    out = None
    for reason, cond in rules:
        c = F.coalesce(cond, F.lit(False))
        out = F.when(c, F.lit(reason)) if out is None else out.when(c, F.lit(reason))
    return df.withColumn(name, out)


def only_kinds(df: DataFrame, kinds, column: str = "kind") -> DataFrame:
    return df.filter(F.col(column).isin(*kinds))


def estimate_tokens(prompt, response, width, height, max_blocks: int, factor: int = 28,
                    count: Callable[[Column], Column] = approx_tokens) -> Column:
    """Text tokens plus image blocks, the blocks capped at the model's maximum."""
    def c(v):
        return F.col(v) if isinstance(v, str) else v

    blocks = F.floor(c(width).cast("double") * c(height) / (factor * factor)).cast("long")
    return count(F.concat(c(prompt), c(response))) + F.least(F.lit(max_blocks), blocks)


def flag_too_long(df: DataFrame, tokens: Column, max_len: int) -> DataFrame:
    return df.withColumn("too_long", tokens > max_len)


def length_filter(df: DataFrame, tokens: Column, max_len: int) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, one row with how many do not)."""
    flagged = flag_too_long(df, tokens, max_len)
    return (flagged.filter(~F.col("too_long")).drop("too_long"),
            flagged.agg(F.count_if("too_long").alias("dropped")))


def fit_limit(tokens_at: Callable[[int], Column], steps=V.ELEMENT_STEPS, budget: int = V.TOKEN_BUDGET) -> Column:
    """Largest element limit whose prompt and response fit; the last one if none does."""
    return F.coalesce(*[F.when(tokens_at(k) <= budget, F.lit(k)) for k in steps], F.lit(steps[-1]))


def command_segments(text) -> Column:
    """A text cut where a new shell command may start; blank pieces dropped, lower case."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.filter(F.transform(F.split(t, r"[\n\r;&|]+"), strip), lambda s: s != "")


def _starts_with(pattern: str) -> Callable[[Column], Column]:
    return lambda s: s.rlike(pattern)


def blocked_pattern(text, patterns=V.BLOCKED_TEXT) -> Column:
    """First destructive pattern that some segment of the text starts with, else null."""
    def first_hit(v):
        out = None
        for p in patterns:
            hit = F.exists(v["segments"], _starts_with(p))
            out = F.when(hit, F.lit(p)) if out is None else out.when(hit, F.lit(p))
        return out

    return let({"segments": command_segments(text)}, first_hit)


def blocked_hotkey(combo, blocked=V.BLOCKED_HOTKEYS, known=V.KNOWN_KEYS) -> Column:
    """True if the keys, in whatever order and spelling, are a forbidden set."""
    keys = F.array_sort(F.array_distinct(normalize_hotkey(combo, known)["keys"]))
    hit = F.lit(False)
    for b in blocked:
        hit = hit | (keys == F.array(*[F.lit(k) for k in sorted(set(b.split("+")))]))
    return hit


def screen_content(df: DataFrame, type_: str = "type", text: str = "text") -> DataFrame:
    """Add ``blocked``: why a typed text or a hotkey must not be executed, else null."""
    t = F.col(type_)
    return df.withColumn("blocked", F.when(t == "type", blocked_pattern(text))
                         .when((t == "hotkey") & blocked_hotkey(text), F.lit("hotkey")))


def length_compliance(df: DataFrame, length: Column, cap: int, by=()) -> DataFrame:
    """Share of responses above a cap, and whether it is at most one in a hundred."""
    over = share(length > cap)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(length > cap).alias("over"),
                               over.alias("over_share"), (over <= 0.01).alias("complies"))
