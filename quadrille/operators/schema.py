"""Tables, columns, keys and conditional rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLASSES = {T.StringType: "TEXT", T.ByteType: "INTEGER", T.ShortType: "INTEGER", T.IntegerType: "INTEGER", T.LongType: "INTEGER", T.FloatType: "REAL", T.DoubleType: "REAL", T.DecimalType: "REAL", T.DateType: "DATE", T.TimestampType: "DATE"}


def snapshot(spark: SparkSession, layers: dict[str, DataFrame]) -> DataFrame:
    """tab, col, actual (class of type) and nullable of every column; read from the schemas alone."""
    rows = [(n, f.name, _CLASSES.get(type(f.dataType), "TEXT"), f.nullable) for n, df in layers.items() for f in df.schema]
    return spark.createDataFrame(rows, "tab string, col string, actual string, nullable boolean")


def layer_catalog(layers: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in layers.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def _named(declared: DataFrame) -> DataFrame:
    return declared.select(F.explode(F.array(F.lower("table_id"), F.lower("table_name"))).alias("_name")).distinct()


def missing_tables(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Declared tables that the file has under neither id nor name."""
    have = actual.select(F.lower("name").alias("_name"))
    return declared.join(have, F.lower("table_id") == F.col("_name"), "left_anti").join(have, F.lower("table_name") == F.col("_name"), "left_anti")


def undefined_tables(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """The file's tables that are not declared, without those whose name begins with ORG_."""
    return actual.filter(~F.col("name").startswith("ORG_")).join(_named(declared), F.lower("name") == F.col("_name"), "left_anti")


def matched(declared: DataFrame, actual: DataFrame, how: str = "inner") -> DataFrame:
    return declared.join(actual, F.lower("table_id") == F.lower("name"), how)


def compatible(declared: DataFrame, actual: DataFrame) -> DataFrame:
    single = lambda c: F.regexp_replace(c, "^MULTI", "")
    return matched(declared, actual, "left").select("table_id", F.when(F.col("name").isNull(), "N").otherwise("Y").alias("found"), F.coalesce(single("geometry_type") == single("actual_type"), F.lit(False)).alias("same_type"))


def _same_column():
    return (F.col("table_id") == F.col("tab")) & (F.lower("field") == F.lower("col"))


def missing_columns(declared: DataFrame, actual: DataFrame) -> DataFrame:
    return declared.join(actual, _same_column(), "left_anti")


def undefined_columns(declared: DataFrame, actual: DataFrame) -> DataFrame:
    return actual.filter(~F.lower("col").isin("shape_area", "shape_length")).join(declared, _same_column(), "left_anti")


def matched_columns(declared: DataFrame, actual: DataFrame) -> DataFrame:
    return declared.join(actual, _same_column())


def text_lengths(layers: dict[str, DataFrame]) -> DataFrame:
    """tab, col and actual_length of each text column: its declared length (metadata `length`), else its longest value's.
    One aggregate over each layer that needs it; a column without values has length 0."""
    out = None
    for name, df in layers.items():
        fields = [f for f in df.schema if isinstance(f.dataType, T.StringType)]
        if not fields:
            continue
        known = [F.struct(F.lit(f.name).alias("col"), (F.max(F.lit(int(f.metadata["length"]))) if "length" in f.metadata else F.coalesce(F.max(F.length(f.name)), F.lit(0))).alias("actual_length")) for f in fields]
        one = df.agg(F.array(*known).alias("_all")).select(F.lit(name).alias("tab"), F.inline("_all"))
        out = one if out is None else out.unionByName(one)
    return out


def length_mismatches(declared: DataFrame, lengths: DataFrame, slack: int = 2) -> DataFrame:
    """Declared text columns whose actual length, where there is one, is more than slack off."""
    return declared.join(lengths, _same_column()).filter((F.col("actual_length") > 0) & (F.abs(F.col("length") - F.col("actual_length")) > slack))


def nullable_columns(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Columns declared as never null that the layer allows to be null."""
    return matched_columns(declared, actual).filter((F.upper("nn") == "Y") & F.col("nullable"))


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """Every row whose key other rows have too, with n, their number. Keys are counted before the rows are joined."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return df.join(counts, key)


def orphans(child: DataFrame, field: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows with a value that no parent has."""
    return child.filter(F.col(field).isNotNull() & (F.col(field).cast("string") != "")).join(parent.select(F.col(key).alias("_key")), F.col(field) == F.col("_key"), "left_anti")


def value_counts(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(F.lower(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))


#: Words that an expression may not have.
FORBIDDEN = ("DROP", "DELETE", "INSERT", "UPDATE", "CREATE", "ALTER")


def checked_expression(text: str) -> str:
    """The text, where brackets and quotes are in balance and nothing but an expression is in it; else ValueError."""
    bare = re.sub(r"'[^']*'", "''", text)
    if bare.count("'") % 2 or bare.rstrip().endswith(";") or any(re.search(rf"\b{w}\b", bare, re.I) for w in FORBIDDEN):
        raise ValueError(f"not an expression: {text}")
    depth = 0
    for c in bare:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            break
    if depth:
        raise ValueError(f"brackets do not match: {text}")
    return text


def conditional(df: DataFrame, condition: str, validation: str) -> DataFrame:
    """Rows for which the condition holds and the validation does not; an unknown validation does not hold."""
    return df.filter(F.expr(checked_expression(condition)) & ~F.coalesce(F.expr(checked_expression(validation)), F.lit(False)))


def conditional_rules(df: DataFrame, rules: list[tuple[str, int, str, str, list[str]]]) -> DataFrame:
    """rule_id and fid of the violations of rules (id, priority, condition, validation, rules that must have run)."""
    ran: set[str] = set()
    out = df.select(F.lit("").alias("rule_id"), "fid").limit(0)
    for rule_id, _, condition, validation, needs in sorted(rules, key=lambda r: (r[1], r[0])):
        if set(needs) <= ran:
            out = out.unionByName(conditional(df, condition, validation).select(F.lit(rule_id).alias("rule_id"), "fid"))
            ran.add(rule_id)
    return out


def first_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_nth = 1").drop("_nth")
