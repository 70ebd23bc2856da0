"""A table in versions against a dictionary."""

import datetime
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quadrille.sources import store

SCHEMA = StructType([StructField("id", LongType()), StructField("part", StringType()), StructField("status", StringType()), StructField("n", IntegerType())])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_as_a_dictionary(spark, tmp_path):
    t = store.Store.create(spark, str(tmp_path / "t"), SCHEMA, ["id", "part"], buckets=4)
    assert t.read().count() == 0
    rng, plain, seen = random.Random(3), {}, [[]]
    for k in range(6):
        keys = [(rng.randrange(30), rng.choice("ab")) for _ in range(12)]
        if k % 3 < 2:
            new = [(*key, f"s{k}", n) for n, key in enumerate(keys)]
            t.upsert(spark.createDataFrame(new, SCHEMA), f"t{k}", order="n")
            plain |= {r[:2]: r for r in new}
        else:
            t.delete(spark.createDataFrame(keys, "id long, part string"), f"t{k}")
            plain = {key: r for key, r in plain.items() if key not in keys}
        seen.append(sorted(plain.values()))
    assert [rows(t.read(v)) for v in t.versions()] == seen
    again = store.Store.open(spark, str(tmp_path / "t"))
    assert again.upsert(spark.createDataFrame([(1, "a", "other", 1)], SCHEMA), "t5") == 6 and rows(again.read()) == seen[-1]
    with pytest.raises(ValueError):
        store.Store.create(spark, str(tmp_path / "t"), SCHEMA, ["id"])
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([(None, "a", "x", 1)], SCHEMA), "null")


def test_update_by_ids(spark, tmp_path):
    t = store.Store.create(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=3)
    t.upsert(spark.createDataFrame([(k, "a", "open", k) for k in range(20)], SCHEMA), "first")
    ids = spark.createDataFrame([(3, "kim"), (7, None), (99, "x"), (3, "kim")], "id long, who string")
    t.update(ids, "second", status=F.lit("fixed"), part=F.coalesce(F.col("with.who"), F.col("part")))
    assert {r[0]: r[1:] for r in rows(t.read())} == {k: ({3: "kim"}.get(k, "a"), "fixed" if k in (3, 7) else "open", k) for k in range(20)}


def test_changes_side_by_side(spark, tmp_path):
    """All of several changes at once are there afterwards, and each version has whole changes."""
    t = store.Store.create(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=2)
    change = lambda k: t.upsert(spark.createDataFrame([(i, f"p{k}", "x", k) for i in range(k * 10, k * 10 + 10)], SCHEMA), f"c{k}")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(change, range(4)))
    assert t.read().count() == 40 and len(t.versions()) == 5
    assert [t.read(v).count() for v in t.versions()] == [0, 10, 20, 30, 40]


def test_runs(spark, tmp_path):
    runs = store.Store.create(spark, str(tmp_path / "runs"), store.RUNS, ["run_id"], buckets=2)
    at = datetime.datetime(2024, 1, 2, 3)
    errors = spark.createDataFrame([("r1", "Warning"), ("r1", "Error"), ("r1", None), ("r2", "Error")], "run_id string, severity string")
    for _ in range(2):
        store.open_run(runs, "r1", at)
        store.open_run(runs, "r3", at)
        store.close_run(runs, "r1", at, errors, summary="done")
        store.close_run(runs, "none", at, errors)
    found = {r["run_id"]: (r["status"], r["total_errors"], r["total_warnings"], r["summary"]) for r in runs.read().collect()}
    assert found == {"r1": ("Completed", 2, 1, "done"), "r3": ("Running", 0, 0, None)}
