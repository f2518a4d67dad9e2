"""String column helpers. All are native expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# fixed value: every character that counts as white space at the end of a text
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
               + "\u2028\u2029\u202f\u205f\u3000")


def strip(c) -> Column:
    """Remove white space of any script from both ends (``trim`` alone only knows the blank)."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def is_blank(c) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def nonempty(c) -> Column:
    """Null for the empty string."""
    return F.nullif(col(c), F.lit(""))


def first_nonempty(*cols) -> Column:
    """First column that is neither null nor empty, else the empty string."""
    return F.coalesce(*[nonempty(c) for c in cols], F.lit(""))


def extract_subtask(*prompts) -> Column:
    """The sub-task named in the first prompt that mentions one; empty if none does."""
    return F.coalesce(*[nonempty(strip(F.regexp_extract(F.coalesce(col(p), F.lit("")), V.SUBTASK_PATTERN, 1)))
                        for p in prompts], F.lit(""))


def prose_before_code(c) -> Column:
    """Text in front of the first code fence (or, without a fence, the first bracket)."""
    text = F.coalesce(col(c), F.lit(""))
    fence = F.instr(text, "```")
    bracket = F.instr(text, "[")
    cut = F.when(fence > 0, fence).otherwise(bracket)
    prose = strip(F.when(cut > 1, F.substring(text, F.lit(1), cut - 1)).otherwise(F.lit("")))
    return strip(F.regexp_replace(prose, V.LEAD_IN_PATTERN, ""))


def strip_reasoning(c) -> Column:
    """What follows the last closing marker; an unclosed section is dropped to the end."""
    after = F.substring_index(col(c), "</think>", -1)
    return strip(F.regexp_replace(after, r"(?s)<think>.*", ""))


def safe_name(c, limit: int = 20, default: str = "unnamed") -> Column:
    """A legal file name from the first ``limit`` characters (the cap is the feature here)."""
    head = F.substring(col(c), 1, limit)
    clean = F.regexp_replace(head, r"[<>:\"/\\|?*\x00-\x1f]", "_")
    return F.coalesce(nonempty(F.regexp_replace(clean, r"^[ .]+|[ .]+$", "")), F.lit(default))


def safe_stem(c, limit: int = 32) -> Column:
    """A task id as file stem: everything but word characters, dot and dash becomes ``_``."""
    return F.substring(F.regexp_replace(col(c), r"(?U)[^\w.-]", "_"), 1, limit)


def describe_target(rep, *fallbacks) -> Column:
    """``[tag]  text -> OP`` gives ``text``; blank text falls back to the other columns in turn."""
    s = strip(F.coalesce(col(rep), F.lit("")))
    rest = F.regexp_replace(s, r"^\[[^\]]*\]", "")
    label = strip(F.substring_index(rest, " -> ", 1))
    return F.coalesce(nonempty(label), nonempty(strip(first_nonempty(*fallbacks))) if fallbacks else F.lit(None),
                      F.lit(""))


def parse_operation(c) -> Column:
    """``struct(op, value)`` from a JSON string; bad JSON gives two empty strings."""
    raw = col(c)
    return F.struct(
        F.coalesce(nonempty(F.get_json_object(raw, "$.original_op")),
                   nonempty(F.get_json_object(raw, "$.op")), F.lit("")).alias("op"),
        F.coalesce(nonempty(F.get_json_object(raw, "$.value")), F.lit("")).alias("value"))


def let(values: dict, body) -> Column:
    """``body`` of a struct of values that are computed once per row, not once per use."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def char_f1(a, b) -> Column:
    """F1 of two strings seen as bags of characters, blanks ignored.

    How often a character occurs is the length lost when it is removed, so shared characters
    are counted per distinct character and not per pair of positions.
    """
    def score(v):
        def times(s, n, ch):
            return n - F.length(F.replace(s, ch, F.lit("")))

        common = F.aggregate(v["chars"], F.lit(0), lambda acc, ch: acc + F.least(
            times(v["x"], v["lx"], ch), times(v["y"], v["ly"], ch)))
        return let({"c": common, "lx": v["lx"], "ly": v["ly"]}, lambda t: _f1(t["c"], t["lx"], t["ly"]))

    x, y = F.replace(col(a), F.lit(" ")), F.replace(col(b), F.lit(" "))
    chars = F.filter(F.array_distinct(F.split(x, "")), lambda ch: ch != "")
    return F.coalesce(let({"x": x, "y": y, "lx": F.length(x), "ly": F.length(y), "chars": chars}, score), F.lit(0.0))


def _f1(common: Column, n_a: Column, n_b: Column) -> Column:
    p, r = F.try_divide(common, n_b), F.try_divide(common, n_a)
    return F.when(common > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def char_bag(c) -> Column:
    """A text as an array of numbers, one per character: code and how often it was seen so far.

    Two bags share exactly the characters (with repetition) that the texts share, so a text
    that takes part in many comparisons is taken apart only once.
    """
    def numbered(v):
        def copies(ch):
            times = v["n"] - F.length(F.replace(v["x"], ch, F.lit("")))
            return F.transform(F.sequence(F.lit(1), times), lambda k: F.ascii(ch).cast("long") * F.lit(1 << 32) + k)
        return F.flatten(F.transform(v["chars"], copies))

    x = F.replace(col(c), F.lit(" "))
    chars = F.filter(F.array_distinct(F.split(x, "")), lambda ch: ch != "")
    return let({"x": x, "n": F.length(x), "chars": chars}, numbered)


def bag_f1(a, b) -> Column:
    """F1 of two character bags; equals ``char_f1`` of their texts."""
    return let({"c": F.size(F.array_intersect(a, b)), "a": F.size(a), "b": F.size(b)},
               lambda v: _f1(v["c"], v["a"], v["b"]))


def text_key(*cols) -> Column:
    """A fixed-size stand-in for long texts in grouping and joining keys.

    Lengths are part of the digest, so ("ab","c") and ("a","bc") differ; shuffles then carry
    64 characters per row and not the texts.
    """
    parts = []
    for c in cols:
        t = F.coalesce(col(c).cast("string"), F.lit("\u0000"))
        parts += [F.length(t).cast("string"), t]
    return F.sha2(F.concat_ws(":", *parts), 256)


def acting_instruction(task, subtask) -> Column:
    """The task, followed by the current sub-task if there is one."""
    return F.when(nonempty(subtask).isNull(), col(task)).otherwise(
        F.concat(col(task), F.lit(V.SUBTASK_SUFFIX), col(subtask)))
