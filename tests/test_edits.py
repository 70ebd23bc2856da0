"""Batches of edits against single edits in their order."""

import random

import pytest
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from quadrille.sources import edits, store

VERTEX = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
SCHEMA = StructType([StructField("fid", LongType()), StructField("name", StringType()), StructField("path", ArrayType(VERTEX))])
EDIT = StructType([StructField("seq", LongType()), StructField("op", StringType()), *SCHEMA])


def single(layer, batch):
    """One edit after the other."""
    wrong = []
    for seq, op, fid, name, path in sorted(batch):
        if op == "create" and fid not in layer:
            layer[fid] = (name, path)
        elif op == "set" and fid in layer:
            layer[fid] = tuple(n if n is not None else o for n, o in zip((name, path), layer[fid]))
        elif op == "delete" and fid in layer:
            del layer[fid]
        else:
            wrong.append((fid, seq, op, edits.EXISTS if op == "create" else edits.GONE if op in ("set", "delete") else edits.UNKNOWN))
    return wrong


def test_batches_as_single_edits(spark, tmp_path):
    t = store.Store.create(spark, str(tmp_path / "layer"), SCHEMA, ["fid"], buckets=4)
    rng, layer, seq = random.Random(5), {}, 0
    read = lambda: {r["fid"]: (r["name"], None if r["path"] is None else [tuple(v) for v in r["path"]]) for r in t.read().collect()}
    for n in range(4):
        batch = []
        for _ in range(40):
            seq += 1
            path = [(float(rng.randrange(9)), 1.0)] * 2 if rng.random() < 0.6 else None
            batch.append((seq, rng.choice(["create", "create", "set", "delete", "move"] if n else ["create", "set"]), rng.randrange(25), rng.choice(["a", "b", None]), path))
        before = dict(layer)
        expected = single(layer, batch)
        rng.shuffle(batch)
        frame = spark.createDataFrame(batch, EDIT)
        for _ in range(2):  # the second time changes nothing
            found = edits.apply(t, frame, f"batch {n}")
            assert sorted((r["fid"], r["seq"], r["op"], r["reason"]) for r in found.collect()) == sorted(expected)
            assert read() == layer
        assert {r["fid"]: r["name"] for r in t.read(n).collect()} == {k: v[0] for k, v in before.items()}
    with pytest.raises(ValueError):
        edits.apply(t, spark.createDataFrame([(1, "set", None, "a", None)], EDIT), "none")
