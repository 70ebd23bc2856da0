"""Queries of scans, filters, and attribute and schema checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrille.functions import filters
from quadrille.operators import attribute as at
from quadrille.operators import schema
from quadrille.plans.registry import query
from quadrille.sources import layers as L

BLD = L.with_layers("bld")
NUM = "TRY_CAST(replace(trim(height), ',', '') AS DOUBLE)"
MULT = "coalesce(abs({n} - round_even({n} / 25, 0) * 25) < 1e-9, false)".format(n=NUM)
CODES = "coalesce(lower(trim(code)) IN ('bdk001'), false)"


def _check(name, condition, sql_condition, field):
    def run(spark, sf_dir):
        return at.violations(L.buildings(spark, sf_dir), condition(), name, field)

    query(f"{BLD} SELECT '{name}' AS rule_id, fid AS feature_id, '{field}' AS field_name, CAST({field} AS VARCHAR) AS actual_value FROM bld WHERE {sql_condition}", name)(run)


_check("attr_codelist", lambda: at.code_list("code", ["BDK001", "BDK002"]), "lower(coalesce(code, '')) NOT IN ('bdk001', 'bdk002')", "code")
_check("attr_range", lambda: at.in_range("height", 20, 200), f"coalesce({NUM} < 20 OR {NUM} > 200, true)", "height")
_check("attr_regex", lambda: at.matches("name", "^[a-z ]+$"), "name IS NOT NULL AND trim(name) <> '' AND NOT regexp_matches(name, '^[a-z ]+$')", "name")
_check("attr_regex_not", lambda: at.matches_not("name", "이름|1"), "name IS NOT NULL AND trim(name) <> '' AND regexp_matches(name, '이름|1')", "name")
_check("attr_not_null", lambda: at.not_null("name"), "name IS NULL OR trim(name) = ''", "name")
_check("attr_not_jamo_only", lambda: at.no_jamo("name"), "coalesce(regexp_matches(name, '[ㄱ-ㅎㅏ-ㅣ]'), false)", "name")
_check("attr_korean_typo", lambda: at.no_typo("name"), "coalesce(regexp_matches(name, '[ㄱ-ㅎㅏ-ㅣ?？]'), false)", "name")
_check("attr_not_zero", lambda: at.not_zero("height"), f"coalesce(abs({NUM}) <= 1e-12, true)", "height")
_check("attr_multiple_of", lambda: at.multiple_of("height", 25), f"NOT {MULT}", "height")
_check("attr_numeric_equals", lambda: at.forbidden_number("height", 100), f"coalesce(abs({NUM} - 100) < 0.01, false)", "height")
_check("attr_if_multiple_then_code_in", lambda: at.if_multiple_then_code("code", "height", 25, ["BDK001"]), f"{MULT} AND NOT {CODES}", "code")
_check("attr_if_not_multiple_then_code_in", lambda: at.if_not_multiple_then_code("code", "height", 25, ["BDK001"]), f"NOT {MULT} AND NOT {CODES}", "code")
_check("attr_if_code_then_not_in", lambda: at.code_not_in("code", ["BDK001"]), CODES, "code")
_check("attr_if_code_then_multiple_of", lambda: at.if_code_then_multiple("code", ["BDK001"], "height", 25), f"{CODES} AND NOT {MULT}", "height")
_check("attr_if_code_then_numeric_equals", lambda: at.if_code_then_equals("code", ["BDK001"], "height", 50), f"{CODES} AND coalesce(abs({NUM} - 50) > 1e-9, true)", "height")
_check("attr_if_code_then_between_exclusive", lambda: at.if_code_then_between("code", ["BDK001"], "height", 50, 150), f"{CODES} AND NOT coalesce({NUM} > 50 AND {NUM} < 150, false)", "height")
_check("attr_if_code_then_gte", lambda: at.if_code_then_gte("code", ["BDK001"], "height", 100), f"{CODES} AND coalesce({NUM} < 100, true)", "height")
_check("attr_if_code_then_null", lambda: at.if_code_then_null("code", ["BDK001"], "height"), f"{CODES} AND height IS NOT NULL AND trim(height) <> ''", "height")

_H = {c: f"CASE WHEN abs({c}) >= 1e-6 THEN {c} END" for c in ("lowest", "base", "highest", "facility")}


def _low(top, under):
    t, u, f = _H[top], _H[under], _H["lowest"]
    return f"coalesce(({f}) < ({u}) AND ({t}) - ({u}) <= -2 AND (abs(({t}) - ({f})) < 1e-6 OR abs((({u}) - ({f})) / nullif(({t}) - ({f}), 0) * 100 - 100) >= 20), false)"


_SAME = "coalesce(change <> 'OFJ008', true)"
_check("bld_base_vs_max", at.base_above_max, f"{_SAME} AND {_low('highest', 'base')}", "base")
_check("bld_max_vs_facility", at.max_above_facility, f"{_SAME} AND {_low('facility', 'highest')} AND NOT ({_SAME} AND {_low('highest', 'base')})", "highest")
_check("bld_lowest_vs_base", at.lowest_above_base, f"kind = 'OBF001' AND {_SAME} AND lowest > 0 AND base > 0 AND lowest > base", "lowest")


@query(f"{BLD} SELECT fid, field_name FROM (SELECT fid, code, unnest([CASE WHEN height IS NULL OR trim(height) = '' THEN 'height' END, CASE WHEN name IS NULL OR trim(name) = '' THEN 'name' END]) AS field_name FROM bld) WHERE field_name IS NOT NULL AND {CODES}")
def attr_if_code_then_not_null_all(spark, sf_dir):
    return at.if_code_then_not_null_all(L.buildings(spark, sf_dir), "code", ["BDK001"], ["height", "name"])


@query(f"{BLD} SELECT 'W1' AS rule_id, fid AS feature_id, 'name' AS field_name, name AS actual_value, 'tn_buld' AS table_id FROM bld WHERE (change IS NULL OR change <> 'OFJ008') AND (name IS NULL OR trim(name) = '')")
def attr_wildcard(spark, sf_dir):
    b = L.buildings(spark, sf_dir)
    return at.run_rules({"tn_buld": b, "other": b.drop("name")}, [("W1", "*", "name", "NotNull", ()), ("W2", "*", "code", "IfCodeThenNull", (["BDK001"], "height")), ("W3", "tn_buld", "name", "Unheard", ())])


# --- filters and scans ---


def _filter(name, condition, sql):
    query(f"{BLD} SELECT fid, code FROM bld WHERE {sql}", name)(lambda spark, sf_dir: (b := L.buildings(spark, sf_dir)).filter(condition(b)).select("fid", "code"))


_filter("filter_in", lambda b: filters.parsed(b, "code IN (BDK001|bdk003)"), "lower(trim(code)) IN ('bdk001', 'bdk003')")
_filter("filter_not_in", lambda b: filters.parsed(b, "code NOT IN ('BDK001')"), "code IS NULL OR lower(trim(code)) NOT IN ('bdk001')")
_filter("filter_not_in_null_fails", lambda b: filters.parsed(b, "code NOT IN ('BDK001')", null_passes=False), "lower(trim(code)) NOT IN ('bdk001')")
_filter("filter_eq", lambda b: filters.parsed(b, "code = 'BDK002'"), "lower(code) = 'bdk002'")
_filter("filter_ne", lambda b: filters.parsed(b, "code <> BDK002"), "lower(code) <> 'bdk002'")
_filter("filter_compare", lambda b: filters.parsed(b, "height >= 100 AND code = BDK001"), f"{NUM} >= 100 AND lower(code) = 'bdk001'")
_filter("filter_field_remap", lambda b: filters.parsed(b, "CODE = BDK001 AND missing = 1"), "true")


@query(f"{BLD} SELECT fid, change FROM bld WHERE change IS NULL OR change <> 'OFJ008'")
def object_change_filter(spark, sf_dir):
    return filters.not_changed(L.buildings(spark, sf_dir)).select("fid", "change")


@query(f"{BLD} SELECT count(*) AS skipped FROM bld WHERE change = 'OFJ008'")
def geom_skip_count(spark, sf_dir):
    return L.buildings(spark, sf_dir).filter("change = 'OFJ008'").agg(F.count(F.lit(1)).alias("skipped"))


@query("SELECT p_partkey, p_name, p_brand FROM part")
def scan_layer(spark, sf_dir):
    return L.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")


@query("SELECT * FROM supplier")
def scan_features(spark, sf_dir):
    return L.read(spark, sf_dir, "supplier")


@query("SELECT p_brand FROM part")
def field_values(spark, sf_dir):
    return L.read(spark, sf_dir, "part").select("p_brand")


@query("SELECT count(*) AS n FROM lineitem")
def record_count(spark, sf_dir):
    return L.read(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM part WHERE p_partkey = 17")
def lookup_by_id(spark, sf_dir):
    return L.read(spark, sf_dir, "part").filter("p_partkey = 17")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#11'")
def attr_eq_scan(spark, sf_dir):
    return L.read(spark, sf_dir, "part").filter("p_brand = 'Brand#11'").select("p_partkey", "p_brand")


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def ids_for_value(spark, sf_dir):
    return L.read(spark, sf_dir, "customer").filter(F.lower("c_mktsegment") == "building").select("c_custkey")


@query(L.with_layers("boxes_a") + "SELECT fid FROM boxes_a WHERE x2 >= 100 AND x1 <= 300 AND y2 >= 50 AND y1 <= 90")
def bbox_scan(spark, sf_dir):
    return L.boxes_a(spark, sf_dir).filter("x2 >= 100 AND x1 <= 300 AND y2 >= 50 AND y1 <= 90").select("fid")


@query("SELECT 'part' AS layer, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'region', count(*) FROM region")
def layer_catalog(spark, sf_dir):
    return schema.layer_catalog({n: L.read(spark, sf_dir, n) for n in ("part", "supplier", "region")})


_SCHEMA_ROWS = "SELECT table_name AS tab, column_name AS col, CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'INTEGER' WHEN data_type IN ('DOUBLE', 'FLOAT') OR data_type LIKE 'DECIMAL%' THEN 'REAL' WHEN data_type = 'DATE' OR data_type LIKE 'TIMESTAMP%' THEN 'DATE' ELSE 'TEXT' END AS actual, true AS nullable FROM duckdb_columns() WHERE table_name IN ('part', 'supplier')"


@query(_SCHEMA_ROWS)
def table_schema(spark, sf_dir):
    return schema.snapshot(spark, {n: L.read(spark, sf_dir, n) for n in ("part", "supplier")})


# --- tables and columns ---

_DECLARED = [("part", "Part", "EPSG:5186", "MULTIPOLYGON"), ("supplier", "Supplier", "EPSG:4326", "POINT"), ("gone", "Gone", "EPSG:5186", "LINESTRING"), ("region", "Region", "EPSG:5186", "POLYGON")]
_ACTUAL = [("PART", "EPSG:5186", "POLYGON"), ("supplier", "EPSG:5186", "LINESTRING"), ("region", "EPSG:5186", "POLYGON"), ("ORG_old", "EPSG:5186", "POINT"), ("extra", "EPSG:5186", "POINT")]
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
TABLES = f"WITH d AS (SELECT * FROM (VALUES {_values(_DECLARED)}) t(table_id, table_name, crs, geometry_type)), a AS (SELECT * FROM (VALUES {_values(_ACTUAL)}) t(name, actual_crs, actual_type)) "


def _tables(spark):
    return spark.createDataFrame(_DECLARED, "table_id string, table_name string, crs string, geometry_type string"), spark.createDataFrame(_ACTUAL, "name string, actual_crs string, actual_type string")


@query(TABLES + "SELECT table_id FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE lower(name) IN (lower(table_id), lower(table_name)))")
def table_missing(spark, sf_dir):
    return schema.missing_tables(*_tables(spark)).select("table_id")


@query(TABLES + "SELECT name FROM a WHERE name NOT LIKE 'ORG_%' AND NOT EXISTS (SELECT 1 FROM d WHERE lower(name) IN (lower(table_id), lower(table_name)))")
def table_undefined(spark, sf_dir):
    return schema.undefined_tables(*_tables(spark)).select("name")


@query(TABLES + "SELECT table_id, crs, actual_crs FROM d JOIN a ON lower(name) = lower(table_id) WHERE crs <> actual_crs")
def table_crs(spark, sf_dir):
    return schema.matched(*_tables(spark)).filter("crs <> actual_crs").select("table_id", "crs", "actual_crs")


@query(TABLES + "SELECT table_id, geometry_type, actual_type FROM d JOIN a ON lower(name) = lower(table_id) WHERE geometry_type <> actual_type")
def table_geom_type(spark, sf_dir):
    return schema.matched(*_tables(spark)).filter("geometry_type <> actual_type").select("table_id", "geometry_type", "actual_type")


@query(TABLES + "SELECT table_id, CASE WHEN name IS NULL THEN 'N' ELSE 'Y' END AS found, coalesce(regexp_replace(geometry_type, '^MULTI', '') = regexp_replace(actual_type, '^MULTI', ''), false) AS same_type FROM d LEFT JOIN a ON lower(name) = lower(table_id)")
def table_geom_type_compat(spark, sf_dir):
    return schema.compatible(*_tables(spark))


_COLS = [("part", "p_partkey", "INTEGER", 8, "UK", "Y"), ("part", "P_NAME", "TEXT", 40, "", "Y"), ("part", "p_colour", "TEXT", 10, "", "N"), ("part", "p_size", "TEXT", 0, "", "N"), ("supplier", "s_name", "INTEGER", 25, "Y", "Y")]
COLUMNS = f"WITH d AS (SELECT * FROM (VALUES {', '.join(repr(c) for c in _COLS)}) t(table_id, field, type, length, uk, nn)), a AS (SELECT * FROM (VALUES ('part', 'p_partkey', 'INTEGER'), ('part', 'p_name', 'TEXT'), ('part', 'p_brand', 'TEXT'), ('part', 'p_type', 'TEXT'), ('part', 'p_size', 'INTEGER'), ('part', 'p_retailprice', 'REAL'), ('supplier', 's_suppkey', 'INTEGER'), ('supplier', 's_name', 'TEXT'), ('supplier', 's_nationkey', 'INTEGER'), ('supplier', 's_acctbal', 'REAL')) t(tab, col, actual)) "


def _columns(spark, sf_dir):
    return spark.createDataFrame(_COLS, "table_id string, field string, type string, length int, uk string, nn string"), schema.snapshot(spark, {n: L.read(spark, sf_dir, n) for n in ("part", "supplier")})


@query(COLUMNS + "SELECT table_id, field FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE tab = table_id AND lower(col) = lower(field))")
def column_missing(spark, sf_dir):
    return schema.missing_columns(*_columns(spark, sf_dir)).select("table_id", "field")


@query(COLUMNS + "SELECT tab, col FROM a WHERE NOT EXISTS (SELECT 1 FROM d WHERE tab = table_id AND lower(col) = lower(field))")
def column_undefined(spark, sf_dir):
    return schema.undefined_columns(*_columns(spark, sf_dir)).select("tab", "col")


@query(COLUMNS + "SELECT table_id, field, type, actual FROM d JOIN a ON tab = table_id AND lower(col) = lower(field) WHERE type <> actual")
def column_type(spark, sf_dir):
    return schema.matched_columns(*_columns(spark, sf_dir)).filter("type <> actual").select("table_id", "field", "type", "actual")


@query(COLUMNS + ", n AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS col, coalesce(max(length({c})), 0) AS actual_length FROM {t}" for t, c in (("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("supplier", "s_name"))) + ") SELECT table_id, field, length, actual_length FROM d JOIN n ON tab = table_id AND lower(col) = lower(field) WHERE actual_length > 0 AND abs(length - actual_length) > 2")
def column_length(spark, sf_dir):
    lengths = schema.text_lengths({n: L.read(spark, sf_dir, n) for n in ("part", "supplier")})
    return schema.length_mismatches(_columns(spark, sf_dir)[0], lengths).select("table_id", "field", "length", "actual_length")


@query(COLUMNS + "SELECT table_id, field FROM d JOIN a ON tab = table_id AND lower(col) = lower(field) WHERE nn = 'Y'")
def column_nullability(spark, sf_dir):
    """Every column of a Parquet file may be null."""
    return schema.nullable_columns(*_columns(spark, sf_dir)).select("table_id", "field")


@query(f"{BLD} SELECT fid FROM bld WHERE code IS NULL OR code = ''")
def not_null(spark, sf_dir):
    return L.buildings(spark, sf_dir).filter("code IS NULL OR code = ''").select("fid")


@query("SELECT l_orderkey, l_linenumber, n FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
def unique_key(spark, sf_dir):
    return schema.repeated(L.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "n")


@query("SELECT sum(n - 1) AS surplus, count(*) AS repeated, sum(n) AS members FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1")
def unique_key_summary(spark, sf_dir):
    g = L.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return g.agg(F.sum(F.col("n") - 1).alias("surplus"), F.count(F.lit(1)).alias("repeated"), F.sum("n").alias("members"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def foreign_key(spark, sf_dir):
    parents = L.read(spark, sf_dir, "customer").filter("c_nationkey < 20")
    return schema.orphans(L.read(spark, sf_dir, "orders"), "o_custkey", parents, "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS orphans, count(DISTINCT o_custkey) AS orphan_values FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def foreign_key_summary(spark, sf_dir):
    return foreign_key(spark, sf_dir).agg(F.count(F.lit(1)).alias("orphans"), F.count_distinct("o_custkey").alias("orphan_values"))


@query("SELECT lower(p_brand) AS value, count(*) AS n FROM part GROUP BY 1")
def value_counts(spark, sf_dir):
    return schema.value_counts(L.read(spark, sf_dir, "part"), "p_brand")


@query("SELECT lower(p_name) AS value, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_values(spark, sf_dir):
    return schema.value_counts(L.read(spark, sf_dir, "part"), "p_name").filter("n > 1")


@query("SELECT lower(p_name) AS value, min(p_partkey) AS fid FROM part GROUP BY 1")
def distinct_by(spark, sf_dir):
    first = Window.partitionBy(F.lower("p_name")).orderBy("p_partkey")
    return L.read(spark, sf_dir, "part").withColumn("nth", F.row_number().over(first)).filter("nth = 1").select(F.lower("p_name").alias("value"), F.col("p_partkey").alias("fid"))


# --- expressions and conditional rules ---


@query(f"{BLD} SELECT fid FROM bld WHERE kind = 'OBF001' AND NOT coalesce(base > lowest AND change = 'OFJ001', false)")
def cond_rule(spark, sf_dir):
    return schema.conditional(L.buildings(spark, sf_dir), "kind = 'OBF001'", "base > lowest AND change = 'OFJ001'").select("fid")


@query(f"{BLD} SELECT 'R1' AS rule_id, fid FROM bld WHERE kind = 'OBF002' AND NOT coalesce(base >= 5, false) UNION ALL SELECT 'R3', fid FROM bld WHERE kind = 'OBF001' AND NOT coalesce(highest >= 5, false)")
def cond_rules_ordered(spark, sf_dir):
    rules = [("R3", 2, "kind = 'OBF001'", "highest >= 5", []), ("R1", 1, "kind = 'OBF002'", "base >= 5", []), ("R2", 3, "true", "false", ["R9"])]
    return schema.conditional_rules(L.buildings(spark, sf_dir), rules)


@query(f"{BLD} SELECT fid, coalesce(base * 2 > highest + 3, false) AS holds FROM bld")
def expr_eval(spark, sf_dir):
    return L.buildings(spark, sf_dir).select("fid", F.coalesce(F.expr(schema.checked_expression("base * 2 > highest + 3")), F.lit(False)).alias("holds"))


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT (o_totalprice > c_acctbal)")
def expr_multi_table(spark, sf_dir):
    return L.read(spark, sf_dir, "orders").join(L.read(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).filter(~F.expr(schema.checked_expression("o_totalprice > c_acctbal"))).select("o_orderkey")
