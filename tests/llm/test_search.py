"""Block-max search against a plain ranking of all documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import search
from tests.llm import plain
from tests.llm.test_operators import ODD, docs, odd, pairs, same, small  # noqa: F401

COLUMNS = ["item_id", "rank", "doc_id", "score"]
ITEMS = [(1, "the same text"), (2, None), (3, ""), (4, "!!"), (5, "twice twice TWICE long"), (5, "one two"), (None, "lead and trail"), (6, "nowhere"), (7, "é 北京 zero"), (1, "the same text")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").select("*", *(F.lit("x").alias(c) for c in ("query", "term", "doc_id", "score")))


def test_ranks(docs, items):  # noqa: F811
    clashing = docs.select("*", *(F.lit("x").alias(c) for c in ("query", "rank", "times")))
    same(search.rank_documents(clashing, items), COLUMNS, plain.op11(pairs(docs), ITEMS))


def test_ranks_of_benchmark(spark, small):  # noqa: F811
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    same(search.rank_documents(small, bench, 7), COLUMNS, plain.op11(pairs(small), [tuple(r) for r in bench.select("item_id", "text").collect()], 7))


def test_no_queries(spark, odd, items):  # noqa: F811
    assert search.rank_documents(odd, items.limit(0)).count() == 0
    assert search.rank_documents(odd, items.filter("text = 'nowhere'")).count() == 0


@pytest.mark.parametrize("chunk,block_docs,block_terms", [(1 << 20, 64, 1 << 16), (200, 3, 4), (1, 1, 1)])
def test_chunks_blocks_and_ties(spark, monkeypatch, chunk, block_docs, block_terms):
    """Many equal scores, blocks and chunks of any size, queries in several blocks."""
    for name, value in (("CHUNK_POSTINGS", chunk), ("BLOCK_DOCS", block_docs)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(2)
    words = [f"w{int(x)}" for x in rng.zipf(1.4, 4000) % 60]
    rows = [(int(rng.integers(0, 400)), " ".join(words[i : i + int(rng.integers(1, 30))])) for i in rng.integers(0, 3900, 300)]
    asked = [(k, " ".join(words[i : i + 4])) for k, i in enumerate(rng.integers(0, 3900, 25).tolist())]
    # in this process, so that the sizes above hold
    index = list(search._indexed(None)(iter([_table(rows)])))
    n_docs, total = len(rows), sum(len(t.split()) for _, t in rows)
    found = search.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    assert (found.n_docs, found.n_terms) == (n_docs, total)
    assert {r["term"]: r["df"] for r in found.frequencies().collect()} == {k: v for k, v in _df(rows).items()}
    queries = found.blocks.sparkSession.createDataFrame([(k, [int(x) for x in search.counted(t)[1]], [int(x) for x in search.counted(t)[2]]) for k, t in asked], "query long, terms array<long>, times array<long>").checkpoint()
    paths = search._query_blocks(queries, found.frequencies(), n_docs, block_terms)
    assert sum(map(len, paths)) >= (1 if block_terms > 100 else 2)
    got = [tuple(r.values()) for b in search._searched(paths, 5, n_docs, total)(iter(index)) for r in b.to_pylist()]
    best = {}
    for q, d, s in got:
        best.setdefault(q, []).append((-s, d))
    assert {(q, rank, d, -s) for q, x in best.items() for rank, (s, d) in enumerate(sorted(x)[:5], 1)} == set(plain.op11(rows, asked, 5))


def test_blocks_are_pruned():
    """Blocks whose bound falls below the threshold are not scored."""
    rows = [(k, "rare " * (1 + k % 3) if k < 20 else f"common filler{k} filler{k + 1}") for k in range(2000)]
    index = [{n: np.array(v) for n, v in r.items()} for b in search._indexed(None)(iter([_table(rows)])) for r in b.to_pylist()]
    terms = np.sort(np.concatenate([search.counted(w)[1] for w in ("rare", "common")]))
    queries = search._Queries(np.array([1]), np.array([0, 2]), np.array([0, 1]), np.array([1, 1]), terms, search.weights(2000, np.array([_df(rows)[int(t)] for t in terms])))
    scores, ids, done = search._Chunk(index, queries, 2000, 6000).best(0, 10, 1, np.zeros(2, np.int64))
    assert len(ids) == 10 and max(ids) < 20 and done < len(index) == 32


def test_filter_lets_all_wanted_terms_through(spark):
    hashes = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 5000)
    bits = search._read_filter(search.term_filter(spark.createDataFrame([(int(x),) for x in hashes], "term long")))
    assert search._let_through(bits, hashes).all()
    assert search._let_through(bits, np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 5000)).mean() < 0.01


def _table(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})


def _df(rows):
    out = {}
    for _, t in rows:
        for h in search.counted(t)[1].tolist():
            out[h] = out.get(h, 0) + 1
    return out
