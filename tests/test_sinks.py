"""Sinks and alerts over streams of files against plain replays."""

import datetime
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quadrille.streaming import alerts, sinks


def made(n, seed=1):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(pick("r1", "r2", None), pick("C1", "C2", None), pick("Error", "Warning", "Critical", None), "t", pick("T1", "T2"), str(k), "m", pick(None, " ", "POINT (1 2)"), pick(0.0, 5.0, None), pick(0.0, None)) for k in range(n)]


def expected(rows):
    n = Counter((r[0], r[1], r[2], r[4]) for r in rows)
    return {k: (v, 0 if k[2] == "Warning" else v, v if k[2] == "Warning" else 0) for k, v in n.items()}


def totals(spark, path):
    return {tuple(r)[:4]: tuple(r)[4:] for r in sinks.statistics(spark, path).collect()}


def test_batches_count_once(spark, tmp_path):
    path, rows = str(tmp_path / "out"), made(60)
    assert sinks.read_errors(spark, path).count() == 0 and totals(spark, path) == {}
    for n in (0, 1, 1, 2, 0):
        sinks.write_batch(spark.createDataFrame(rows[n * 20 : n * 20 + 20], sinks.ERRORS), n, path)
    assert totals(spark, path) == expected(rows)
    back = Counter(tuple(r)[:10] for r in sinks.read_errors(spark, path).collect())
    assert back == Counter(rows)
    placed = lambda r: bool(r[8] or r[9] or (r[7] or "").strip())
    found = sinks.read_errors(spark, path, "r1", True)
    assert Counter(r["feature_id"] for r in found.collect()) == Counter(r[5] for r in rows if r[0] == "r1" and placed(r))
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
    # a batch whose counts are not there yet is not seen
    sinks.write_batch(spark.createDataFrame(rows[:5], sinks.ERRORS), 7, path)
    (tmp_path / "out/statistics/batch=7/_SUCCESS").unlink()
    assert totals(spark, path) == expected(rows) and sinks.read_errors(spark, path).count() == 60


def test_stream_to_folder(spark, tmp_path):
    rows = made(50, 2)
    spark.createDataFrame(rows, sinks.ERRORS).repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sinks.ERRORS).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for _ in range(2):
        sinks.write_errors(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert totals(spark, str(tmp_path / "out")) == expected(rows)


def test_json_both_ways(spark, tmp_path):
    rows = made(20, 3)
    sinks.write_json(spark.createDataFrame(rows, sinks.ERRORS), str(tmp_path / "a"))
    good, bad = sinks.read_json(spark, str(tmp_path / "a"))
    assert Counter(tuple(r) for r in good.collect()) == Counter(rows) and bad.count() == 0
    (tmp_path / "b.json").write_text("\n".join([json.dumps({"RUN_ID": "r", "Code": "x", "X": 1.5, "other": 3}), "", "  ", "{broken", "[1]", json.dumps({"x": "no number"})]))
    good, bad = sinks.read_json(spark, str(tmp_path / "b.json"))
    assert sorted((r["run_id"] or "", r["code"] or "", r["x"] or 0) for r in good.collect()) == [("", "", 0), ("r", "x", 1.5)]
    assert sorted(r["value"] for r in bad.collect()) == ["[1]", "{broken"]


def replay(events, quiet):
    """Told after each pause longer than quiet: all that is known, newest first."""
    out, known, last = [], {}, None
    tell = lambda: out.extend((last + quiet, n, k, *known[k][:2], known[k][2]) for n, k in enumerate(sorted(known, key=lambda k: (-known[k][2], k)), 1))
    for at, key, removed, severity, message in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3], e[4])):
        if last is not None and at > last + quiet:
            tell()
        last = at
        if removed:
            known.pop(key, None)
        else:
            known[key] = (severity, message, at)
    tell()
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_debounce(spark, tmp_path, seed):
    """Late and repeated alerts, in files that come one after the other."""
    rng, base = random.Random(seed), datetime.datetime(2024, 5, 1)
    events, at = {"a": [], None: []}, 0
    for k in range(60):
        at += rng.choice([50, 120, 900, 4000]) * 1000
        events[rng.choice(["a", None])].append((at, rng.choice("xyz"), rng.random() < 0.15, rng.choice(["low", "high"]), f"m{k}"))
    rows = [(ch, e[1], e[3], e[4], base + datetime.timedelta(microseconds=e[0]), e[2]) for ch, es in events.items() for e in es]
    rows.sort(key=lambda r: r[4] + datetime.timedelta(seconds=rng.uniform(0, 3)))  # up to three seconds out of order
    end = base + datetime.timedelta(microseconds=at)
    rows += [("end", "e", "low", "end", end + datetime.timedelta(seconds=60), False), ("end", None, "low", "no key", end, False)]
    schema = "channel string, key string, severity string, message string, at timestamp, removed boolean"
    for n in range(0, len(rows), 13):
        spark.createDataFrame(rows[n : n + 13], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n:04d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    alerts.debounced(stream, datetime.timedelta(milliseconds=350)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(240)
    found = spark.read.parquet(str(tmp_path / "out")).filter("channel IS NULL OR channel <> 'end'")
    micro = lambda t: round((t - base) / datetime.timedelta(microseconds=1))
    got = Counter((r["channel"], micro(r["told_at"]), r["nth"], r["key"], r["severity"], r["message"], micro(r["at"])) for r in found.collect())
    assert got == Counter((ch, *x) for ch, es in events.items() if es for x in replay(es, 350_000))
