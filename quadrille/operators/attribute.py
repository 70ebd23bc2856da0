"""Attribute checks: each is a condition on a row that says when a value violates its rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.filters import not_changed, value_in

CHECKS: dict[str, Callable[..., Column]] = {}


def check_type(name: str):
    def add(f):
        CHECKS[name.lower()] = f
        return f

    return add


def number(c: str) -> Column:
    """A value as a number, thousands separators allowed; null where it is none."""
    return F.regexp_replace(F.trim(F.col(c).cast("string")), ",", "").try_cast("double")


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def multiple(c: str, base: float) -> Column:
    v = number(c)
    return F.coalesce(F.abs(v - F.rint(v / base) * base) < 1e-9, F.lit(False))


@check_type("CodeList")
def code_list(c: str, codes: list[str]) -> Column:
    return ~F.lower(F.coalesce(c, F.lit(""))).isin([x.lower() for x in codes])


@check_type("Range")
def in_range(c: str, low: float | None, high: float | None) -> Column:
    v = number(c)
    off = v.isNull()
    if low is not None:
        off |= F.coalesce(v < low, F.lit(True))
    if high is not None:
        off |= F.coalesce(v > high, F.lit(True))
    return off


@check_type("Regex")
def matches(c: str, pattern: str) -> Column:
    return ~blank(c) & ~F.col(c).rlike(pattern)


@check_type("RegexNot")
def matches_not(c: str, pattern: str) -> Column:
    return ~blank(c) & F.col(c).rlike(pattern)


@check_type("NotNull")
def not_null(c: str) -> Column:
    return blank(c)


@check_type("NotJamoOnly")
def no_jamo(c: str) -> Column:
    return F.coalesce(F.col(c).rlike("[ㄱ-ㅎㅏ-ㅣ]"), F.lit(False))


@check_type("KoreanTypo")
def no_typo(c: str) -> Column:
    return F.coalesce(F.col(c).rlike("[ㄱ-ㅎㅏ-ㅣ?？]"), F.lit(False))


@check_type("NotZero")
def not_zero(c: str) -> Column:
    return F.coalesce(F.abs(number(c)) <= 1e-12, F.lit(True))


@check_type("MultipleOf")
def multiple_of(c: str, base: float) -> Column:
    return ~multiple(c, base)


@check_type("NumericEquals")
def forbidden_number(c: str, target: float) -> Column:
    return F.coalesce(F.abs(number(c) - target) < 0.01, F.lit(False))


@check_type("IfMultipleOfThenCodeIn")
def if_multiple_then_code(code: str, c: str, base: float, codes: list[str]) -> Column:
    return multiple(c, base) & ~value_in(code, codes)


@check_type("IfNotMultipleOfThenCodeIn")
def if_not_multiple_then_code(code: str, c: str, base: float, codes: list[str]) -> Column:
    return ~multiple(c, base) & ~value_in(code, codes)


@check_type("IfCodeThenNotIn")
def code_not_in(code: str, codes: list[str]) -> Column:
    return value_in(code, codes)


@check_type("IfCodeThenMultipleOf")
def if_code_then_multiple(code: str, codes: list[str], c: str, base: float) -> Column:
    return value_in(code, codes) & ~multiple(c, base)


@check_type("IfCodeThenNumericEquals")
def if_code_then_equals(code: str, codes: list[str], c: str, target: float) -> Column:
    return value_in(code, codes) & F.coalesce(F.abs(number(c) - target) > 1e-9, F.lit(True))


@check_type("IfCodeThenBetweenExclusive")
def if_code_then_between(code: str, codes: list[str], c: str, low: float, high: float) -> Column:
    v = number(c)
    return value_in(code, codes) & ~F.coalesce((v > low) & (v < high), F.lit(False))


@check_type("IfCodeThenGreaterThanOrEqual")
def if_code_then_gte(code: str, codes: list[str], c: str, target: float) -> Column:
    return value_in(code, codes) & F.coalesce(number(c) < target, F.lit(True))


@check_type("IfCodeThenNull")
def if_code_then_null(code: str, codes: list[str], c: str) -> Column:
    return value_in(code, codes) & ~blank(c)


def if_code_then_not_null_all(df: DataFrame, code: str, codes: list[str], fields: list[str]) -> DataFrame:
    """A row for each blank field of a row that has one of the codes."""
    blanks = F.filter(F.array(*[F.when(blank(c), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    return df.filter(value_in(code, codes)).select("fid", F.explode(blanks).alias("field_name"))


def _height(c: str) -> Column:
    return F.when(F.abs(c) >= 1e-6, F.col(c))


def _too_low(top: str, under: str, floor: str) -> Column:
    t, u, f = _height(top), _height(under), _height(floor)
    share = F.try_divide(u - f, t - f) * 100 - 100
    return F.coalesce((f < u) & (t - u <= -2) & ((F.abs(t - f) < 1e-6) | (F.abs(share) >= 20)), F.lit(False))


def base_above_max(change: str = "change") -> Column:
    """The base is above the highest point by at least 2, and by 20 % of the height."""
    return F.coalesce(F.col(change) != "OFJ008", F.lit(True)) & _too_low("highest", "base", "lowest")


def max_above_facility(change: str = "change") -> Column:
    return F.coalesce(F.col(change) != "OFJ008", F.lit(True)) & _too_low("facility", "highest", "lowest") & ~base_above_max(change)


def lowest_above_base() -> Column:
    return F.coalesce((F.col("kind") == "OBF001") & (F.col("change").isNull() | (F.col("change") != "OFJ008")) & (F.col("lowest") > 0) & (F.col("base") > 0) & (F.col("lowest") > F.col("base")), F.lit(False))


def violations(df: DataFrame, condition: Column, rule_id: str, field: str) -> DataFrame:
    """The rows that violate a rule, as errors."""
    return df.filter(condition).select(F.lit(rule_id).alias("rule_id"), F.col("fid").alias("feature_id"), F.lit(field).alias("field_name"), F.col(field).cast("string").alias("actual_value"))


def run_rules(layers: dict[str, DataFrame], rules: list[tuple[str, str, str, str, tuple]]) -> DataFrame:
    """Errors of rules (rule_id, layer or *, field, check type, parameters) over layers. An unknown type passes. With
    *, every layer that has the field is checked without changed rows; rules that name several fields pass there."""
    simple = {"codelist", "range", "regex", "regexnot", "notnull", "notjamoonly", "koreantypo", "notzero", "multipleof"}
    out = None
    for rule_id, layer, field, kind, parameters in rules:
        names = [n for n, df in layers.items() if (layer == "*" or n.lower() == layer.lower()) and field.lower() in map(str.lower, df.columns)]
        if kind.lower() not in CHECKS or layer == "*" and kind.lower() not in simple:
            continue
        for name in names:
            df = not_changed(layers[name]) if layer == "*" else layers[name]
            found = violations(df, CHECKS[kind.lower()](field, *parameters), rule_id, field).withColumn("table_id", F.lit(name))
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no rule applies to these layers")
    return out
