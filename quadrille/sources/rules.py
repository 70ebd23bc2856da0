"""Rule tables in CSV files: tables, geometry checks, attributes, relations and criteria; what is wrong with them, and what
holds where nothing is said.

Files may begin with a byte order mark. A rule whose id begins with # is a comment. What is wrong comes as rows, so that
one bad rule takes no other with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
# fixed values: headers of the files, with the name that each column has here and its type
HEADERS = {
    "table": (("TableId", "table_id", "string"), ("TableName", "table_name", "string"), ("GeometryType", "geometry_type", "string"), ("CRS", "crs", "string")),
    "schema": (("TableId", "table_id", "string"), ("FieldName", "field", "string"), ("FieldAlias", "alias", "string"), ("DataType", "type", "string"), ("Length", "length", "string"), ("UK", "uk", "string"), ("FK", "fk", "string"), ("NN", "nn", "string"), ("RefTable", "ref_table", "string"), ("RefColumn", "ref_column", "string")),
    "attribute": (("RuleId", "rule_id", "string"), ("Enabled", "enabled", "string"), ("TableId", "table_id", "string"), ("TableName", "table_name", "string"), ("FieldName", "field", "string"), ("CheckType", "check_type", "string"), ("Parameters", "parameters", "string"), ("Note", "note", "string")),
    "relation": (("RuleId", "rule_id", "string"), ("Enabled", "enabled", "string"), ("CaseType", "case_type", "string"), ("MainTableId", "main_table", "string"), ("MainTableName", "main_name", "string"), ("RelatedTableId", "related_table", "string"), ("RelatedTableName", "related_name", "string"), ("FieldFilter", "field_filter", "string"), ("Tolerance", "tolerance", "double"), ("Note", "note", "string")),
}
GEOMETRY = (("TableId", "table_id"), ("TableName", "table_name"), ("GeometryType", "geometry_type"))
GEOMETRY_CHECKS = {
    "객체중복": "duplicate", "객체간겹침": "overlap", "자체꼬임": "self_intersection", "슬리버": "sliver", "짧은객체": "short_line", "작은면적객체": "small_area", "홀 폴리곤 오류": "polygon_in_polygon",
    "최소정점개수": "min_points", "스파이크": "spike", "자기중첩": "self_overlap", "언더슛": "undershoot", "오버슛": "overshoot",
}
#: Criteria by their name in the file: the name here, and what holds where the file says nothing.
CRITERIA = {
    "겹침허용면적": ("overlap_area", 0.001), "최소선길이": ("min_line_length", 0.01), "최소폴리곤면적": ("min_polygon_area", 1.0), "슬리버면적": ("sliver_area", 2.0), "슬리버형태지수": ("sliver_shape_index", 0.1),
    "슬리버신장률": ("sliver_elongation", 10.0), "스파이크각도임계값": ("spike_angle", 10.0), "링폐합오차": ("ring_closure", 1e-8), "네트워크탐색거리": ("network_distance", 0.1), "중복검사허용오차": ("duplicate_tolerance", 0.001),
    "선면포함관계허용오차": ("line_in_polygon", 0.001), "면면포함관계허용오차": ("polygon_in_polygon", 0.001), "선연결성탐색거리": ("connection_distance", 1.0), "중심선각도임계값": ("centerline_angle", 30.0),
    "등고선꺽임기본값": ("contour_bend", 90.0), "도로중심선꺽임기본값": ("road_bend", 6.0), "선형끝점기본값": ("line_end", 0.3),
}
_PLAIN = {"enabled": "Y", "nn": "N"}


def _file(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with all columns as text, and the number of each row; blank values are null."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.toDF(*[n.lstrip("﻿").strip() for n in df.columns])


def missing_headers(spark: SparkSession, path: str, kind: str) -> list[str]:
    """Headers of a kind of table that the file lacks, whatever their case."""
    wanted = [h for h, _ in GEOMETRY] + list(GEOMETRY_CHECKS) if kind == "geometry" else [h for h, *_ in HEADERS[kind]]
    have = {n.lower() for n in _file(spark, path).columns}
    return [h for h in wanted if h.lower() not in have]


def _named(df: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    known = {n.lower(): n for n in df.columns}
    own = []
    for head, name, kind in columns:
        text = F.nullif(F.trim(c(f"`{known[head.lower()]}`")), F.lit("")) if head.lower() in known else F.lit(None).cast("string")
        own += [(text if kind == "string" else text.try_cast(kind)).alias(name)]
        if kind != "string":
            own += [(text.isNotNull() & text.try_cast(kind).isNull()).alias(f"_bad_{name}")]
    return df.select(*own)


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table, schema, attribute or relation file as it stands, columns by their names here; a header that is missing is a
    column of nulls. Rules that are not marked are enabled, fields that are not marked may be null."""
    df = _named(_file(spark, path), list(HEADERS[kind]))
    return df.withColumns({k: F.upper(F.coalesce(k, F.lit(v))) for k, v in _PLAIN.items() if k in df.columns})


def active(rules: DataFrame) -> DataFrame:
    """The rules that count: enabled, with an id that is no comment."""
    key = "rule_id" if "rule_id" in rules.columns else "table_id"
    on = c("enabled") == "Y" if "enabled" in rules.columns else F.lit(True)
    return rules.filter(on & c(key).isNotNull() & ~F.startswith(c(key), F.lit("#"))).drop(*[n for n in rules.columns if n.startswith("_bad_")])


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """table_id, table_name, geometry_type, check: a row for each check that a geometry file asks for with Y."""
    df = _file(spark, path)
    known = {n.lower(): n for n in df.columns}
    asked = [F.struct(F.lit(name).alias("check"), (F.upper(F.trim(c(f"`{known[head.lower()]}`"))) == "Y").alias("on")) for head, name in GEOMETRY_CHECKS.items() if head.lower() in known]
    tables = df.select(*[F.trim(c(f"`{known[h.lower()]}`")).alias(n) for h, n in GEOMETRY], F.explode(F.array(*asked)).alias("a"))
    return tables.filter(c("a.on") & ~F.startswith("table_id", F.lit("#"))).select("table_id", "table_name", "geometry_type", "a.check")


def read_criteria(spark: SparkSession, path: str | None) -> dict[str, float]:
    """Criteria by name: those of a file (name, value), and the plain ones for all others. Values that are no numbers
    count as not said; of several rows of a name the last counts. The file has a row for each criterion."""
    out = dict(CRITERIA.values())
    if path:
        df = _file(spark, path)
        name, value = df.columns[:2]
        for r in df.select(c(f"`{name}`").alias("name"), c(f"`{value}`").try_cast("double").alias("value")).filter("value IS NOT NULL").collect():
            if r["name"] in CRITERIA:
                out[CRITERIA[r["name"]][0]] = r["value"]
    return out


_KINDS = ("POINT", "MULTIPOINT", "LINESTRING", "MULTILINESTRING", "POLYGON", "MULTIPOLYGON", "NONE")


def problems(rules: DataFrame, kind: str, known: tuple[str, ...] = ()) -> DataFrame:
    """rule, problem: what is wrong with the rows of a file (read): a field that must be there is not, an id comes twice, a
    value is none of those allowed. known: check types or case types, in any case. Comments are not looked at."""
    key = "rule_id" if "rule_id" in rules.columns else "table_id"
    rows = rules.filter(c(key).isNull() | ~F.startswith(c(key), F.lit("#")))
    blank = lambda name: (c(name).isNull(), f"{name} is missing")
    kinds = [k.lower() for k in known]
    checks: list[tuple[Column, str]] = {
        "table": [blank("table_id"), blank("table_name"), (~F.upper("geometry_type").isin(*_KINDS), "geometry_type is unknown"), (~c("crs").rlike(r"^EPSG:\d+$"), "crs is no EPSG:number")],
        "schema": [blank("table_id"), blank("field"), blank("type"), (~c("nn").isin("Y", "N"), "nn is neither Y nor N")],
        "attribute": [blank("rule_id"), blank("table_id"), blank("field"), blank("check_type"), (~c("enabled").isin("Y", "N"), "enabled is neither Y nor N"), (~F.lower("check_type").isin(*kinds), "check_type is unknown")],
        "relation": [blank("rule_id"), blank("case_type"), blank("main_table"), blank("related_table"), (~c("enabled").isin("Y", "N"), "enabled is neither Y nor N"), (~F.lower("case_type").isin(*kinds), "case_type is unknown"), (c("tolerance") < 0, "tolerance is negative")],
    }[kind]
    if "_bad_tolerance" in rules.columns:
        checks.append((c("_bad_tolerance"), "tolerance is no number"))
    found = F.filter(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.lit(text)) for wrong, text in checks]), lambda x: x.isNotNull())
    own = rows.select(c(key).alias("rule"), F.explode(found).alias("problem"))
    if key != "rule_id":
        return own
    twice = rows.filter(c(key).isNotNull()).groupBy(c(key).alias("rule")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rule", F.lit("rule_id comes more than once").alias("problem"))
    return own.unionByName(twice)


def write(rules: DataFrame, path: str, kind: str) -> None:
    """A table, schema, attribute or relation file with its headers, in one part: rule tables are small."""
    rules.select(*[c(name).alias(head) for head, name, _ in HEADERS[kind]]).coalesce(1).write.csv(path, header=True)
