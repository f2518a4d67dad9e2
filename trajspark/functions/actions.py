"""Action columns: struct(type, point, point2, text, direction, thought)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .geometry import in_unit
from .stats import fixed
from .strings import col, is_blank, let, nonempty, strip

ACTION_SCHEMA = ("struct<type:string,point:struct<x:double,y:double>,point2:struct<x:double,y:double>,"
                 "text:string,direction:string,thought:string>")
ACTION_JSON_SCHEMA = ("struct<type:string,point:array<double>,point2:array<double>,"
                      "text:string,direction:string,thought:string>")


def literal_map(pairs: dict) -> Column:
    """A constant map; built from one text, which keeps plans with big tables quick to build."""
    text = "\u0002".join(f"{k}\u0001{v}" for k, v in pairs.items())
    return F.str_to_map(F.lit(text), F.lit("\u0002"), F.lit("\u0001"))


def literal_set(values) -> Column:
    """A constant array of strings, built the same way."""
    return F.split(F.lit("\u0002".join(values)), "\u0002")


def canonical_type(c, aliases: dict | None = None) -> Column:
    """Replace an alias by the canonical action type; other values stay."""
    c = col(c)
    return F.coalesce(F.try_element_at(literal_map(aliases or V.ACTION_ALIASES), c), c)


def action(type_, point=None, point2=None, text=None, direction=None, thought=None) -> Column:
    def part(v, t):
        return (F.lit(None) if v is None else v).cast(t)

    pt = "struct<x:double,y:double>"
    return F.struct(part(type_, "string").alias("type"), part(point, pt).alias("point"),
                    part(point2, pt).alias("point2"), part(text, "string").alias("text"),
                    part(direction, "string").alias("direction"), part(thought, "string").alias("thought"))


def action_violations(a, aliases: dict | None = None) -> Column:
    """Array of everything wrong with an action; empty means valid."""
    a = col(a)
    kind = canonical_type(a["type"], aliases)
    known = F.coalesce(kind.isin(*V.ACTION_TYPES), F.lit(False))

    def needs(field):
        types = [t for t, req in V.REQUIRED_FIELDS.items() if field in req]
        return F.when(kind.isin(*types) & a[field].isNull(), F.lit(f"missing:{field}"))

    def range_check(field):
        return F.when(a[field].isNotNull() & ~F.coalesce(in_unit(a[field]), F.lit(False)),
                      F.lit(f"range:{field}"))

    checks = [F.when(~known, F.lit("unknown_type"))]
    checks += [needs(f) for f in ("point", "point2", "text", "direction")]
    checks += [range_check(f) for f in ("point", "point2")]
    checks.append(F.when((kind == "scroll") & a["direction"].isNotNull()
                         & ~a["direction"].isin(*V.SCROLL_DIRECTIONS), F.lit("direction")))
    return F.array_compact(F.array(*checks))


def action_to_json(a) -> Column:
    """Sparse JSON: nulls and an empty thought are left out, an empty text stays."""
    a = col(a)

    def pair(p):
        return F.when(p.isNotNull(), F.array(p["x"], p["y"]))

    return F.to_json(F.struct(a["type"].alias("type"), pair(a["point"]).alias("point"),
                              pair(a["point2"]).alias("point2"), a["text"].alias("text"),
                              a["direction"].alias("direction"), nonempty(a["thought"]).alias("thought")))


def action_from_json(c) -> Column:
    """Read an action back; unknown keys are ignored, aliases resolved."""
    def pair(p):
        return F.when(F.size(p) == 2, F.struct(F.try_element_at(p, F.lit(1)).alias("x"),
                                               F.try_element_at(p, F.lit(2)).alias("y")))

    def read(v):
        j = v["j"]
        return F.when(j.isNotNull(), action(canonical_type(j["type"]), pair(j["point"]), pair(j["point2"]), j["text"],
                                            j["direction"], F.coalesce(j["thought"], F.lit(""))))

    return let({"j": F.from_json(col(c), ACTION_JSON_SCHEMA)}, read)


# control, format, private, unassigned and separator characters, all but the plain space
UNPRINTED = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]"


def _shown(letter: Column) -> Column:
    """A letter, or its number in hexadecimal if it cannot be printed."""
    code = F.lower(F.hex(F.ascii(letter)))
    n = F.length(code)
    number = (F.when(n <= 2, F.concat(F.lit("\\x"), F.lpad(code, 2, "0"))).when(n <= 4, F.concat(F.lit("\\u"), F.lpad(code, 4, "0")))
              .otherwise(F.concat(F.lit("\\U"), F.lpad(code, 8, "0"))))
    return F.when(letter.rlike(UNPRINTED), number).otherwise(letter)


def quoted(c) -> Column:
    """Text in single quotes the way a repr shows it: double quotes if it holds a single one."""
    t = col(c)
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        t = F.replace(t, F.lit(raw), F.lit(shown))
    t = F.when(t.rlike(UNPRINTED), F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), _shown), "")).otherwise(t)
    single = t.contains("'")
    double = t.contains('"')
    return (F.when(single & ~double, F.concat(F.lit('"'), t, F.lit('"')))
            .when(single, F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'")))
            .otherwise(F.concat(F.lit("'"), t, F.lit("'"))))


def describe_for_history(a) -> Column:
    """Pointed actions with two digits, keyboard actions with their text, else the type."""
    a = col(a)
    return (F.when(a["point"].isNotNull(),
                   F.concat(a["type"], F.lit(" ("), fixed(a["point"]["x"], 2), F.lit(", "),
                            fixed(a["point"]["y"], 2), F.lit(")")))
            .when(nonempty(a["text"]).isNotNull(), F.concat(a["type"], F.lit(" "), quoted(a["text"])))
            .otherwise(a["type"]))


def describe_for_log(a) -> Column:
    """The log form: three digits, drag with both ends, scroll with its direction."""
    a = col(a)

    def pos(p):
        return F.when(p.isNotNull(), F.concat(F.lit("("), fixed(p["x"], 3), F.lit(", "), fixed(p["y"], 3),
                                              F.lit(")"))).otherwise(F.lit(""))

    kind = a["type"]
    return (F.when(kind.isin("click", "left_double", "right_single"), F.concat(kind, F.lit(" "), pos(a["point"])))
            .when(kind == "drag", F.concat(F.lit("drag "), pos(a["point"]), F.lit(" -> "), pos(a["point2"])))
            .when(kind == "scroll", F.concat(F.lit("scroll "), pos(a["point"]), F.lit(" "), a["direction"]))
            .when(kind.isin(*V.KEYBOARD_TYPES), F.concat(kind, F.lit(" "), quoted(a["text"])))
            .otherwise(kind))


def step_status(ok, changed, error) -> Column:
    """Outcome shown in the live log; ``changed`` has three values."""
    return (F.when(~col(ok), F.concat(F.lit(V.STATUS_FAILED), F.coalesce(col(error), F.lit(""))))
            .when(col(changed) == F.lit(False), F.lit(V.STATUS_UNCHANGED))
            .when(col(changed) == F.lit(True), F.lit(V.STATUS_CHANGED))
            .otherwise(F.lit(V.STATUS_OK)))


def history_status(ok, changed, error) -> Column:
    """Outcome shown in a prompt's history."""
    return (F.when(~col(ok), F.concat(F.lit(V.HISTORY_FAILED), F.coalesce(col(error), F.lit(""))))
            .when(col(changed) == F.lit(False), F.lit(V.HISTORY_UNCHANGED))
            .otherwise(F.lit(V.HISTORY_OK)))


def element_line(e: Column) -> Column:
    """Id, label (or a stand-in) and centre of one element."""
    return F.format_string(
        V.ELEMENT_FORMAT, e["id"].cast("string"),
        F.when(is_blank(e["text"]), F.lit(V.ELEMENT_UNNAMED)).otherwise(e["text"]),
        fixed((e["bbox"]["x1"] + e["bbox"]["x2"]) / 2, 2), fixed((e["bbox"]["y1"] + e["bbox"]["y2"]) / 2, 2))


def join_lines(lines) -> Column:
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(F.lit(V.ELEMENTS_EMPTY))


def render_elements(elements) -> Column:
    """One line per element; a stand-in for an empty list."""
    return let({"lines": F.transform(col(elements), element_line)}, lambda v: join_lines(v["lines"]))


def render_history(history) -> Column:
    """One line per step of an array of struct(n, line, status)."""
    lines = F.transform(col(history), lambda s: F.format_string(V.HISTORY_FORMAT, s["n"], s["line"], s["status"]))
    return F.when(F.size(col(history)) > 0, F.array_join(lines, "\n")).otherwise(F.lit(V.HISTORY_EMPTY))


def repair_keyboard_target(type_, text, target) -> Column:
    """A keyboard action that put its content into ``target`` takes it as text."""
    kind = canonical_type(type_)
    misplaced = kind.isin(*V.KEYBOARD_TYPES) & ~is_blank(target) & is_blank(text)
    return F.when(misplaced, strip(target)).otherwise(col(text))


def clean_plan(subtasks, limit: int = V.MAX_SUBTASKS) -> Column:
    """Trimmed, non-blank, first occurrences only, at most ``limit`` (the format's own maximum)."""
    trimmed = F.transform(col(subtasks), lambda s: strip(s))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda s: s != "")), 1, limit)


def normalize_hotkey(c, known=V.KNOWN_KEYS, aliases: dict | None = None) -> Column:
    """``struct(keys, unknown)`` of a key combination in any of its spellings.

    ``known`` empty or None switches the check (and the splitting at underscores) off.
    """
    text = F.lower(F.replace(col(c), F.lit(" "), F.lit("")))
    for name, canon in V.X11_MODIFIERS.items():
        text = F.regexp_replace(text, f"{name}_[lr]", canon)
    table = literal_map(aliases or V.KEY_ALIASES)

    def alias(k):
        return F.coalesce(F.try_element_at(table, k), k)

    tokens = F.filter(F.split(text, r"\+"), lambda t: t != "")
    if not known:
        keys = F.transform(tokens, alias)
        return F.struct(keys.alias("keys"), F.array().cast("array<string>").alias("unknown"))

    names = literal_set(known)

    def expand(t):
        def choose(v):
            k, joined = v["k"], v["joined"]
            split = F.transform(F.filter(F.split(k, "_"), lambda p: p != ""), alias)
            return (F.when(~k.contains("_") | F.array_contains(names, k), F.array(k))
                    .when(F.array_contains(names, joined), F.array(joined)).otherwise(split))
        return let({"k": alias(t), "joined": alias(F.replace(alias(t), F.lit("_"), F.lit("")))}, choose)

    return let({"keys": F.flatten(F.transform(tokens, expand))}, lambda v: F.struct(
        v["keys"].alias("keys"), F.filter(v["keys"], lambda k: ~F.array_contains(names, k)).alias("unknown")))
