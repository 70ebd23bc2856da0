"""What is known of rule expressions before they run, and counts of conditional rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.schema import checked_expression

#: Words that are no field.
KEYWORDS = {"and", "or", "not", "in", "is", "null", "like", "rlike", "between", "case", "when", "then", "else", "end", "true", "false", "cast", "as", "distinct"}
_NAME = re.compile(r"(?:[A-Za-z_]\w*\.)?([A-Za-z_]\w*)\b(?!\s*\()")
_TEXT = re.compile(r"'(?:[^']|'')*'")
_KINDS = (
    ("Boolean", re.compile(r"<|>|!=|=|\b(and|or|not|in|is|like|rlike|between|true|false)\b", re.I)),
    ("Date", re.compile(r"\b(current_date|current_timestamp|to_date|to_timestamp|date_add|date_sub)\s*\(", re.I)),
    ("String", re.compile(r"'|\b(upper|lower|trim|concat|substring|replace)\s*\(|\|\|", re.I)),
    ("Numeric", re.compile(r"[-+*/%]|\b(abs|round|sqrt|power|length|count|sum|avg|min|max)\s*\(|^\s*\d", re.I)),
)


def fields(text: str, known: list[str] | None = None) -> list[str]:
    """The fields that an expression names, in order of the alphabet, without their tables' names. ValueError for one that is
    not known."""
    bare = _TEXT.sub("''", checked_expression(text))
    found = sorted({m[1].lower() for m in _NAME.finditer(bare)} - KEYWORDS)
    if known is not None and (lost := [f for f in found if f not in {k.lower() for k in known}]):
        raise ValueError(f"no such field: {', '.join(lost)}")
    return found


def kind(text: str) -> str:
    """Boolean, Date, String, Numeric, or Mixed where nothing tells."""
    return next((name for name, sign in _KINDS if sign.search(text)), "Mixed")


def statistics(df: DataFrame, rules: list[tuple[str, int, str, str, list[str]]]) -> DataFrame:
    """rule_id, ran, met and violations of conditional rules (id, priority, condition, validation, rules that must have
    run), all in one pass over the rows. An unknown condition is not met, an unknown validation does not hold."""
    ran: list[tuple[str, str, str]] = []
    idle: list[str] = []
    for rule_id, _, condition, validation, needs in sorted(rules, key=lambda r: (r[1], r[0])):
        if set(needs) <= {r[0] for r in ran}:
            ran.append((rule_id, checked_expression(condition), checked_expression(validation)))
        else:
            idle.append(rule_id)
    holds = lambda text: F.coalesce(F.expr(text), F.lit(False))
    each = [F.struct(F.lit(i).alias("rule_id"), F.lit(True).alias("ran"), F.count(F.when(holds(a), 1)).alias("met"), F.count(F.when(holds(a) & ~holds(b), 1)).alias("violations")) for i, a, b in ran]
    none = F.lit(None).cast("long")
    each += [F.struct(F.lit(i).alias("rule_id"), F.lit(False).alias("ran"), none.alias("met"), none.alias("violations")) for i in idle]
    return df.agg(F.array(*each).alias("r")).select(F.explode("r").alias("r")).select("r.*")
