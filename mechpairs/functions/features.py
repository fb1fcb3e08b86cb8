"""Features parsed from prose and actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Action rules in order, route words, unit factors.
ACTIONS = (("inhibit", "inh"), ("induc", "ind"), ("substrate", "sub"), ("metabol", "sub"))
RENAL, HEPATIC = r"\b(renal|urin|kidney)", r"\b(hepat|bil(e|iary)|fec(es|al)|liver)"


def action_flag(action: Column) -> Column:
    """inh, ind or sub from the words of a protein action; else null."""
    a, out = F.lower(F.coalesce(action, F.lit(""))), F.lit(None).cast("string")
    for word, flag in reversed(ACTIONS):
        out = F.when(F.contains(a, F.lit(word)), flag).otherwise(out)
    return out


def half_life_hours(text: Column) -> Column:
    """The first number with a unit, in hours; null without one."""
    rx = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(min|hour|hr|h\b|day|d\b)"
    n, unit = F.nullif(F.regexp_extract(text, rx, 1), F.lit("")).cast("double"), F.lower(F.regexp_extract(text, rx, 2))
    return F.when(unit == "min", n / 60).when(unit.isin("day", "d"), n * 24).otherwise(n)


def elimination_route(text: Column) -> Column:
    """renal, hepatic, mixed or null by the words of a text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    r, h = t.rlike(RENAL), t.rlike(HEPATIC)
    return F.when(r & h, "mixed").when(r, "renal").when(h, "hepatic")


def literature_ids(text: Column) -> Column:
    """Reference marks such as A123 or L4567, distinct and in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b[ALFT]\d{2,6}\b"), F.lit(0)))


def best_json(text: Column) -> Column:
    """The JSON object of a model's answer: the whole text, a fenced block, or from the
    first brace to the last; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    greedy = F.regexp_extract(text, r"(?s)(\{.*\})", 1)

    def ok(t: Column) -> Column:
        return F.when(F.try_parse_json(t).isNotNull() & F.startswith(F.trim(t), F.lit("{")), F.trim(t))

    return F.coalesce(ok(text), ok(fenced), ok(greedy))


def direction_tag(subject: Column, a: Column, b: Column, bidirectional: Column, order: Column | None = None, fallback: str | None = "bidirectional") -> Column:
    """Which side acts on which, seen in the presented order (``ab`` where none is given);
    ``fallback`` (a tag, or None) where the subject is neither side."""
    turned = F.lit(False) if order is None else F.coalesce(order == "ba", F.lit(False))
    known = F.when(subject == a, F.when(turned, "b_to_a").otherwise("a_to_b")).when(subject == b, F.when(turned, "a_to_b").otherwise("b_to_a"))
    return F.when(F.coalesce(bidirectional, F.lit(False)), "bidirectional").otherwise(F.coalesce(known, F.lit(fallback).cast("string")))
