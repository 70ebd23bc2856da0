"""Queries of aggregations, ranks, pages and searches over stored errors.

The stored errors of these queries are the driver's events: type as code, user as run, value as measure.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrille.plans.registry import query
from quadrille.sources import layers as L

RANK = {"error": 0, "click": 1, "view": 2}
RANK_SQL = "CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END"


def errors(spark, sf_dir):
    return L.read(spark, sf_dir, "events")


def rank(c="event_type"):
    out = F.lit(3)
    for value, n in reversed(RANK.items()):
        out = F.when(F.col(c) == value, n).otherwise(out)
    return out


def _count(name, column, key):
    query(f"SELECT {key} AS key, count(*) AS n FROM events GROUP BY 1", name)(lambda spark, sf_dir: errors(spark, sf_dir).groupBy(column().alias("key")).agg(F.count(F.lit(1)).alias("n")))


_count("agg_errors_by_type", lambda: F.col("event_type"), "event_type")
_count("agg_errors_by_run", lambda: F.col("user_id"), "user_id")
_count("agg_errors_by_table", lambda: F.col("user_id") % 7, "user_id % 7")
_count("agg_errors_by_geomtype", lambda: F.when(F.col("value") > 50, "POINT").otherwise("NONE"), "CASE WHEN value > 50 THEN 'POINT' ELSE 'NONE' END")
_count("agg_errors_by_severity", lambda: rank(), RANK_SQL)
_count("agg_errors_by_status", lambda: F.col("event_id") % 4, "event_id % 4")
_count("agg_daily_trend", lambda: F.to_date("ts"), "CAST(ts AS DATE)")


@query("SELECT min(ts) AS first, max(ts) AS last FROM events")
def agg_error_span(spark, sf_dir):
    return errors(spark, sf_dir).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT user_id AS run_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM events GROUP BY 1")
def agg_runs(spark, sf_dir):
    return errors(spark, sf_dir).groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("started"), "run_id")


@query(f"SELECT event_type AS code, user_id % 7 AS tab, {RANK_SQL} AS severity, count(*) AS n FROM events GROUP BY 1, 2, 3")
def agg_code_table_severity(spark, sf_dir):
    return errors(spark, sf_dir).groupBy(F.col("event_type").alias("code"), (F.col("user_id") % 7).alias("tab"), rank().alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 1000) AS passed, round(sum(o_totalprice), 2) AS amount FROM orders")
def agg_validation_stats(spark, sf_dir):
    c = lambda x: F.count(F.when(F.expr(x), 1))
    return L.read(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("total"), c("o_orderstatus = 'F'").alias("failed"), c("o_orderstatus = 'O' AND o_totalprice > 1000").alias("passed"), F.round(F.sum("o_totalprice"), 2).alias("amount"))


@query("SELECT event_type AS format, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, format LIMIT 1")
def agg_most_common_format(spark, sf_dir):
    return errors(spark, sf_dir).groupBy(F.col("event_type").alias("format")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "format").limit(1)


@query("SELECT user_id % 5 AS stage, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1")
def agg_stage_failures(spark, sf_dir):
    return errors(spark, sf_dir).filter("event_type = 'error'").groupBy((F.col("user_id") % 5).alias("stage")).agg(F.count(F.lit(1)).alias("failures"))


@query("SELECT user_id % 5 AS stage, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, round((count(*) - count(*) FILTER (event_type = 'error')) * 100.0 / count(*), 4) AS success FROM events GROUP BY ROLLUP (user_id % 5)")
def agg_stage_rollup(spark, sf_dir):
    bad = F.count(F.when(F.col("event_type") == "error", 1))
    e = errors(spark, sf_dir).withColumn("stage", F.col("user_id") % 5)
    return e.rollup("stage").agg(F.count(F.lit(1)).alias("total"), bad.alias("failed"), F.round((F.count(F.lit(1)) - bad) * 100.0 / F.count(F.lit(1)), 4).alias("success"))


@query("SELECT user_id % 7 AS tab, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def agg_geometry_table_report(spark, sf_dir):
    return errors(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("tab")).agg(*[F.count(F.when(F.col("event_type") == k, 1)).alias(k) for k in ("error", "click", "view")])


@query("SELECT CASE WHEN event_type IN ('error', 'click') THEN 'geometry' ELSE 'other' END AS class, event_type AS code, count(*) AS n FROM events GROUP BY 1, 2")
def agg_classify_matrix(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("error", "click"), "geometry").otherwise("other")
    return errors(spark, sf_dir).groupBy(kind.alias("class"), F.col("event_type").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id % 5 AS stage, round(avg(value), 6) AS mean, count(*) AS n, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM events GROUP BY 1")
def agg_stage_perf(spark, sf_dir):
    return errors(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("stage")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("sd"))


@query("SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5")
def agg_frequent_events(spark, sf_dir):
    return errors(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).orderBy(F.desc("n"), "user_id").limit(5)


query("SELECT user_id % 7 AS tab, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, tab LIMIT 5", "topk_tables")(lambda spark, sf_dir: errors(spark, sf_dir).filter("event_type = 'error'").groupBy((F.col("user_id") % 7).alias("tab")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tab").limit(5))


@query("SELECT user_id % 10 AS batch, round(avg(value), 6) AS efficiency, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 2 ORDER BY efficiency DESC, batch LIMIT 1")
def agg_batch_efficiency(spark, sf_dir):
    return errors(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("batch")).agg(F.round(F.avg("value"), 6).alias("efficiency"), F.count(F.lit(1)).alias("n")).filter("n >= 2").orderBy(F.desc("efficiency"), "batch").limit(1)


@query("SELECT count(DISTINCT user_id) AS operations, count(*) AS n, round(avg(value), 6) AS mean, count(*) FILTER (ts >= TIMESTAMP '2024-01-29 00:00:00') AS recent FROM events")
def agg_distinct_ops(spark, sf_dir):
    return errors(spark, sf_dir).agg(F.count_distinct("user_id").alias("operations"), F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count(F.when(F.expr("ts >= TIMESTAMP '2024-01-29 00:00:00'"), 1)).alias("recent"))


@query(f"SELECT event_id, {RANK_SQL} AS severity FROM events WHERE regexp_matches(lower(props), '7') AND event_type IN ('error', 'click') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' AND value BETWEEN 10 AND 90")
def error_multi_filter(spark, sf_dir):
    keep = F.lower("props").rlike("7") & F.col("event_type").isin("error", "click") & F.expr("ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'") & F.col("value").between(10, 90)
    return errors(spark, sf_dir).filter(keep).select("event_id", rank().alias("severity"))


query("SELECT event_id FROM events WHERE event_type IN ('error', 'signup')", "errors_by_severity")(lambda spark, sf_dir: errors(spark, sf_dir).filter(F.col("event_type").isin("error", "signup")).select("event_id"))
query("SELECT event_id FROM events WHERE user_id = 7", "run_filter")(lambda spark, sf_dir: errors(spark, sf_dir).filter("user_id = 7").select("event_id"))
query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'", "retention_delete")(lambda spark, sf_dir: errors(spark, sf_dir).filter("ts >= TIMESTAMP '2024-01-10'").select("event_id"))
query("SELECT event_id, CASE WHEN event_id % 97 = 3 THEN 'FIXED' ELSE event_type END AS status FROM events", "qc_bulk_update")(lambda spark, sf_dir: errors(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 97 == 3, "FIXED").otherwise(F.col("event_type")).alias("status")))
query(L.with_layers("pts") + "SELECT fid FROM pts WHERE x BETWEEN 100 AND 200 AND y BETWEEN 10 AND 90", "errors_in_bounds")(lambda spark, sf_dir: L.pts(spark, sf_dir).filter("x BETWEEN 100 AND 200 AND y BETWEEN 10 AND 90").select("fid"))
query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority LIKE '%URGENT%'", "result_search")(lambda spark, sf_dir: L.read(spark, sf_dir, "orders").filter(F.col("o_orderpriority").contains("URGENT") & F.expr("o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 90000")).select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey"))
query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50", "history_search")(lambda spark, sf_dir: L.read(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey"))
query("SELECT o_orderkey FROM orders WHERE o_custkey = 37 AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1", "result_cache_lookup")(lambda spark, sf_dir: L.read(spark, sf_dir, "orders").filter("o_custkey = 37 AND o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey"))
query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 20", "recent_n")(lambda spark, sf_dir: errors(spark, sf_dir).orderBy(F.desc("ts"), "event_id").limit(20).select("event_id"))
query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 25 OFFSET 50", "page_errors")(lambda spark, sf_dir: errors(spark, sf_dir).orderBy("ts", "event_id").offset(50).limit(25).select("event_id"))
query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, (SELECT (count(*) + 19) // 20 FROM orders) AS pages FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40", "page_results")(lambda spark, sf_dir: (o := L.read(spark, sf_dir, "orders")).orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey").join(F.broadcast(o.agg(F.count(F.lit(1)).alias("total"), F.expr("(count(1) + 19) div 20").alias("pages")))))
query(f"SELECT event_id, {RANK_SQL} AS severity FROM events", "severity_sort")(lambda spark, sf_dir: errors(spark, sf_dir).select("event_id", rank().alias("severity")).orderBy("severity", "event_id"))
query(f"SELECT event_id, {RANK_SQL} AS severity FROM (SELECT * FROM events ORDER BY event_id LIMIT 500)", "sort_priority")(lambda spark, sf_dir: errors(spark, sf_dir).orderBy("event_id").limit(500).select("event_id", rank().alias("severity")).orderBy("severity", "event_id"))
query("SELECT event_id, 'error' AS source FROM events WHERE event_type = 'error' UNION ALL SELECT o_orderkey, 'warning' FROM orders WHERE o_orderstatus = 'P'", "set_union_errors")(lambda spark, sf_dir: errors(spark, sf_dir).filter("event_type = 'error'").select("event_id", F.lit("error").alias("source")).unionByName(L.read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("event_id"), F.lit("warning").alias("source"))))
query("SELECT DISTINCT user_id FROM events EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 90", "set_except")(lambda spark, sf_dir: (e := errors(spark, sf_dir)).select("user_id").subtract(e.filter("event_type = 'error' AND value > 90").select("user_id")))
query("SELECT event_id FROM events WHERE event_id % 3 <> 0", "set_invert_selection")(lambda spark, sf_dir: (e := errors(spark, sf_dir)).join(e.filter("event_id % 3 = 0").select(F.col("event_id").alias("_id")), F.col("event_id") == F.col("_id"), "left_anti").select("event_id"))
query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#22')", "config_row_select")(lambda spark, sf_dir: L.read(spark, sf_dir, "part").join(spark.createDataFrame([("Brand#11",), ("Brand#22",)], "_brand string"), F.col("p_brand") == F.col("_brand"), "left_semi").select("p_partkey"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events")
def win_dup_rank(spark, sf_dir):
    return errors(spark, sf_dir).select("event_id", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("nth"))


@query("SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS median FROM events")
def win_rolling_median(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-19, 0)
    return errors(spark, sf_dir).select("event_id", F.round(F.percentile("value", 0.5).over(w), 6).alias("median"))


_ORDERED = "SELECT user_id, value, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_ALPHA = "CASE WHEN {k} < 5 OR {k} < 0.2 * {n} THEN 0.2 WHEN {k} < 0.7 * {n} THEN 0.1 ELSE 0.05 END"


@query(f"WITH RECURSIVE o AS ({_ORDERED}), s AS (SELECT user_id, k, n, value AS smoothed FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.n, {_ALPHA.format(k='o.k', n='o.n')} * o.value + (1 - {_ALPHA.format(k='o.k', n='o.n')}) * s.smoothed FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1) SELECT user_id, round(smoothed, 6) AS smoothed FROM s WHERE k = n")
def win_ewma(spark, sf_dir):
    """Smoothed values of each run in time order: s = a x + (1 - a) s, with a of 0.2 at first, then 0.1 and 0.05 as the run
    goes on. Each value's weight is its own a times what later ones leave over, so sums over a window do, and no run's
    history lies in one row."""
    run = Window.partitionBy("user_id")
    ordered = errors(spark, sf_dir).select("user_id", "value", F.row_number().over(run.orderBy("ts", "event_id")).alias("k"), F.count(F.lit(1)).over(run).alias("n"))
    alpha = F.when(F.col("k") == 1, 1.0).when((F.col("k") < 5) | (F.col("k") < 0.2 * F.col("n")), 0.2).when(F.col("k") < 0.7 * F.col("n"), 0.1).otherwise(0.05)
    later = F.coalesce(F.sum(F.log(1 - F.col("a"))).over(run.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = ordered.withColumn("a", alpha).withColumn("weight", F.col("a") * F.exp(later))
    return left.groupBy("user_id").agg(F.round(F.sum(F.col("weight") * F.col("value")), 6).alias("smoothed"))


@query("SELECT user_id, round(greatest(0.1, least(1.0, CASE WHEN count(*) >= 5 THEN 0.6 ELSE 0.3 END + CASE WHEN stddev_pop(value) / avg(value) < 0.35 THEN 0.2 ELSE 0 END)), 6) AS confidence FROM events GROUP BY 1")
def eta_confidence(spark, sf_dir):
    score = F.when(F.count(F.lit(1)) >= 5, 0.6).otherwise(0.3) + F.when(F.stddev_pop("value") / F.avg("value") < 0.35, 0.2).otherwise(0.0)
    return errors(spark, sf_dir).groupBy("user_id").agg(F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), score)), 6).alias("confidence"))


@query("SELECT user_id, round((1000 - count(*)) / nullif(avg(value), 0), 6) AS remaining FROM events GROUP BY 1")
def eta_remaining(spark, sf_dir):
    return errors(spark, sf_dir).groupBy("user_id").agg(F.round(F.try_divide(1000 - F.count(F.lit(1)), F.avg("value")), 6).alias("remaining"))
