"""The Merkle manifest against a plain one."""

import pytest
from pyspark.sql import functions as F

from quadrille.llm import merkle, queries
from tests.llm import plain
from tests.llm.test_operators import ODD, same

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def as_query(docs, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: docs)
    return queries.op12_manifest(docs.sparkSession, "")


def made(n, langs):
    return [(k * 7 % n if k % 11 else None, f"s{k % 3}" if k % 5 else None, langs[k % len(langs)], k if k % 4 else None, ODD[k % len(ODD)][1] if k % 2 else f"t{k}") for k in range(n)]


@pytest.mark.parametrize("rows", [[], made(1, ["en"]), made(3, [None]), made(60, ["en", None, "", "zz", "é", "日本"]), made(2600, ["en", "en", "en", "en", "de"])], ids=["none", "one", "null lang", "langs", "two bands"])
def test_manifest(spark, monkeypatch, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("tree", "pos", "digest", "own", "size", "level")})
    same(as_query(docs, monkeypatch), COLUMNS, plain.op12(rows))


def test_small_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same(as_query(docs, monkeypatch), COLUMNS, plain.op12([tuple(r) for r in docs.select(FIELDS).collect()]))


def test_repeated_rows_and_root(spark):
    rows = [(1, "s", "en", 2, "a")] * 3 + [(1, "s", "en", 2, "b"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    made = merkle.manifest(docs)
    assert made.root() == plain.op12(rows)[0][3] and merkle.manifest(docs.repartition(3)).root() == made.root()
    assert merkle.manifest(docs.limit(0)).root() is None
    proofs = made.proofs()
    assert proofs.filter(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 5
    assert merkle.manifest(docs.filter("text <> 'b'")).root() != made.root()
