"""Filters on attribute values; what null does is said by each."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_in(c: str, values: list[str]) -> Column:
    """Case-insensitive; null is not in a list."""
    return F.coalesce(F.lower(F.trim(c)).isin([v.strip().lower() for v in values]), F.lit(False))


def value_not_in(c: str, values: list[str], null_passes: bool = True) -> Column:
    return F.when(F.col(c).isNull(), F.lit(null_passes)).otherwise(~value_in(c, values))


def equals(c: str, value: str) -> Column:
    return F.coalesce(F.lower(c) == value.lower(), F.lit(False))


def differs(c: str, value: str) -> Column:
    return F.coalesce(F.lower(c) != value.lower(), F.lit(False))


def not_changed(df: DataFrame, column: str = "change", excluded: tuple[str, ...] = ("OFJ008",)) -> DataFrame:
    """Rows without an excluded change code; all rows where the column is absent."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*excluded)) if column.lower() in map(str.lower, df.columns) else df


_CLAUSE = re.compile(r"^\s*(\w+)\s+(NOT\s+IN|IN)\s*\((.*)\)\s*$|^\s*(\w+)\s*(=|<>|!=|<=|>=|<|>)\s*('?)(.*?)\6\s*$", re.I | re.S)
_QUOTED = re.compile(r"'[^']*'")
_MASK = "\x00"


def clauses(text: str) -> list[str]:
    """The clauses that AND joins; an AND within quotes joins nothing."""
    held: list[str] = []
    bare = _QUOTED.sub(lambda m: held.append(m[0]) or _MASK, text.strip())
    back = iter(held)
    return [re.sub(_MASK, lambda m: next(back), part) for part in re.split(r"\s+AND\s+", bare, flags=re.I)]


def items(text: str) -> list[str]:
    """The items of a list, quoted or not, between commas or bars; those within quotes are kept whole."""
    return [(m[1] if m[1] is not None else m[2]).strip() for m in re.finditer(r"\s*(?:'([^']*)'|\"?([^,|'\"]+)\"?)\s*(?:[,|]|$)", text)]


def number(c: str) -> Column:
    """A value as a number, blanks and thousands separators allowed; null where it is none."""
    return F.regexp_replace(F.trim(F.col(c).cast("string")), ",", "").try_cast("double")


def parsed(df: DataFrame, text: str, null_passes: bool = True) -> Column:
    """A filter text of clauses joined by AND. Items may be unquoted and split by | or ,; a clause on a field that the
    table lacks drops the whole filter. ValueError for what is no clause, and for an order with what is no number."""
    out = F.lit(True)
    known = {c.lower(): c for c in df.columns}
    orders = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
    for clause in clauses(text):
        m = _CLAUSE.match(clause)
        if not m:
            raise ValueError(f"not a filter clause: {clause}")
        field = known.get((m[1] or m[4]).lower())
        if field is None:
            return F.lit(True)
        if m[2]:
            out &= value_not_in(field, items(m[3]), null_passes) if m[2].upper().startswith("NOT") else value_in(field, items(m[3]))
        elif m[5] == "=":
            out &= equals(field, m[7].strip())
        elif m[5] in ("<>", "!="):
            out &= differs(field, m[7].strip())
        else:
            out &= F.coalesce(orders[m[5]](number(field), float(m[7].replace(",", ""))), F.lit(False))
    return out


def normalised(text: str) -> str:
    """A filter text as SQL: list items and values of an equation in quotes, unless they are numbers."""

    def value(v: str) -> str:
        try:
            float(v)
            return v
        except ValueError:
            return "'" + v + "'"

    out = []
    for clause in clauses(text):
        m = _CLAUSE.match(clause)
        if not m:
            raise ValueError(f"not a filter clause: {clause}")
        if m[2]:
            out.append(f"{m[1]} {' '.join(m[2].upper().split())} ({', '.join(f'{chr(39)}{v}{chr(39)}' for v in items(m[3]))})")
        else:
            out.append(f"{m[4]} {m[5]} {value(m[7].strip())}")
    return " AND ".join(out)


def options(text: str) -> tuple[list[str], dict[str, list[str]]]:
    """Fields and options of a rule's field text: `a|b|c;name=value;other=x,y`."""
    first, *rest = [part.strip() for part in (text or "").split(";")]
    given = {}
    for part in rest:
        name, sign, value = part.partition("=")
        if sign and name.strip():
            given[name.strip().lower()] = [v.strip() for v in value.split(",") if v.strip()]
    return [f.strip() for f in first.split("|") if f.strip()], given
