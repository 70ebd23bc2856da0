"""Ranked lexical search by block-max pruning.

An index is a table of blocks: ranges of consecutive documents with their forward index (terms and how often they
occur, document by document) and, for each term of the block, the greatest count and the least length of a document
that has it. A weight grows with the count and falls with the length, so these two bound it, whatever the statistics of
the whole corpus are. A search goes over the index once. In each task, a query's blocks are sorted by their bound
and scored from the forward index until the bound falls below the query's threshold, the k-th best score so far.

Terms are compared by their XXH64; two of 10**8 different terms share one with a chance of 3 in 10**4.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import shared_dir, small_batches, staged, store

BLOCK_DOCS, BLOCK_POSTINGS = 64, 1 << 15
CHUNK_POSTINGS = 1 << 20  # blocks that a task holds at once
FILTER_BITS = 26
_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_FOLD = bytes.maketrans(_SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz")
_INDEX = "doc_ids array<long>, lengths array<long>, counts array<int>, terms array<long>, times array<int>, block_terms array<long>, most array<int>, least array<long>"
_NAMES = ["doc_ids", "lengths", "counts", "terms", "times", "block_terms", "most", "least"]


def terms_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and whatever is not ASCII, A-Z in lower case; of null none."""
    return (text or "").encode().translate(_FOLD).split()  # no other white space is left


def counted(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """How many terms a text has, the hashes of its distinct terms and how often they occur."""
    words = terms_of(text)
    c = Counter(words)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in c), np.uint64, len(c))
    return len(words), hashes.view(np.int64), np.fromiter(c.values(), np.int64, len(c))


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N+2)/(2df+1))), in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impact(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times // (1000 * times + 12 * m)


def _length(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    return 75 + (25 * n * n_docs) // max(1, total)


# --- the index -------------------------------------------------------------------------------------------------


def _block(docs: list[tuple]) -> list:
    """docs: doc_id, length, hashes, times."""
    counts = np.array([len(d[2]) for d in docs], np.int32)
    terms, times = np.concatenate([d[2] for d in docs]), np.concatenate([d[3] for d in docs])
    lengths = np.repeat(np.array([d[1] for d in docs], np.int64), counts)
    block_terms, at = np.unique(terms, return_inverse=True)
    most, least = np.zeros(len(block_terms), np.int64), np.full(len(block_terms), np.iinfo(np.int64).max)
    np.maximum.at(most, at, times)
    np.minimum.at(least, at, lengths)
    return [[d[0] for d in docs], [d[1] for d in docs], counts, terms, times.astype(np.int32), block_terms, most.astype(np.int32), least]


def _indexed(wanted: str | None):
    """Texts to blocks; with the path of a filter, only terms that it lets through."""

    def run(batches):
        bits = _read_filter(wanted) if wanted else None
        held, size = [], 0
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, hashes, times = counted(text)
                if not n:
                    continue
                if bits is not None:
                    own = _let_through(bits, hashes)
                    hashes, times = hashes[own], times[own]
                held.append((doc_id, n, hashes, times))
                size += len(hashes)
                if len(held) == BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    out.append(_block(held))
                    held, size = [], 0
            if out:
                yield _batch(out)
        if held:
            yield _batch([_block(held)])

    return run


def _batch(blocks: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([b[k] for b in blocks], pa.list_(kind)) for k, kind in enumerate(kinds)], names=_NAMES)


def _let_through(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _read_filter(path: str) -> np.ndarray:
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    there, place = store(path)
    for f in pq.ParquetDataset(place, filesystem=there).files:
        words = pq.read_table(f, filesystem=there)
        bits[words.column("byte").to_numpy()] = words.column("bits").to_numpy()
    return bits


def term_filter(terms: DataFrame) -> str:
    """The path of a table of a fixed number of bits, one set for each term (hash): which terms a text may need."""
    spark = terms.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/terms-{uuid.uuid4().hex}"
    spread = terms.selectExpr(f"shiftrightunsigned(term, {64 - FILTER_BITS}) AS at").selectExpr("cast(at div 8 as int) AS byte", "shiftleft(1, cast(at % 8 as int)) AS bit")
    spread.groupBy("byte").agg(F.bit_or("bit").cast("int").alias("bits")).coalesce(8).write.parquet(path)
    return path


@dataclass
class Index:
    """Blocks (staged), the number of documents with a term, and of all their terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int

    def frequencies(self) -> DataFrame:
        """term, df: in how many documents each indexed term occurs."""
        return self.blocks.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def build_index(docs: DataFrame, wanted: str | None = None) -> Index:
    """The index of whole texts (doc_id, text), written to the shared folder; wanted: a filter of the terms that it needs
    (term_filter), else of all. Texts without a term (null, empty) are in no block; repeated rows are documents each."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = staged(own.mapInArrow(_indexed(wanted), _INDEX), "index")
    lengths = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    n_docs, n_terms = blocks.agg(F.sum(F.size("lengths").cast("long")), F.sum(lengths)).first()
    return Index(blocks, n_docs or 0, n_terms or 0)


# --- the search ------------------------------------------------------------------------------------------------


def _queried(batches):
    """Queries' texts to their terms."""
    for batch in batches:
        found = [counted(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.int64()))], names=["query", "terms", "times"])


def _write_queries(folder: str, n_docs: int):
    """Queries' rows, with weights from df, to files of the shared folder, one a task and block."""

    def run(batches):
        for batch in batches:
            at = batch.column("block").to_numpy()
            for block in np.unique(at).tolist():
                path = f"{folder}/{block}-{uuid.uuid4().hex}.parquet"
                there, place = store(path)
                there.create_dir(place.rpartition("/")[0], recursive=True)
                own = batch.filter(pa.array(at == block))
                rows = pa.table({"query": own.column("query"), "term": own.column("term"), "times": own.column("times"), "weight": weights(n_docs, own.column("df").to_numpy())})
                pq.write_table(rows, place, filesystem=there)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([path])], names=["block", "path"])

    return run


@dataclass
class _Queries:
    """A block of queries: their terms as places in the sorted distinct terms."""

    ids: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    times: np.ndarray
    terms: np.ndarray
    weight: np.ndarray

    @classmethod
    def read(cls, paths: list[str]) -> _Queries:
        parts = []
        for path in paths:
            there, place = store(path)
            parts.append(pq.read_table(place, filesystem=there))
        rows = pa.concat_tables(parts).sort_by("query")
        query, term, times, weight = (rows.column(c).to_numpy() for c in ("query", "term", "times", "weight"))
        terms, first, places = np.unique(term, return_index=True, return_inverse=True)
        ids, starts = np.unique(query, return_index=True)
        return cls(ids, np.append(starts, len(query)), places, times, terms, weight[first])

    def among(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of terms the queries have, and their places."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        ours = self.terms[at] == terms
        return ours, at[ours]


class _Chunk:
    """Blocks side by side, seen by one block of queries."""

    def __init__(self, blocks: list[dict], queries: _Queries, n_docs: int, total: int):
        self.ids = [b["doc_ids"] for b in blocks]
        self.queries = queries
        self.bounds = np.zeros((len(queries.terms), len(blocks)), np.int64)
        self.postings = []
        for k, b in enumerate(blocks):
            ours, at = queries.among(b["block_terms"])
            self.bounds[at, k] = queries.weight[at] * impact(b["most"][ours].astype(np.int64), _length(b["least"][ours], n_docs, total))
            ours, at = queries.among(b["terms"])
            m = np.repeat(_length(b["lengths"], n_docs, total), b["counts"])[ours]
            upto = np.concatenate([[0], np.cumsum(ours)])[np.concatenate([[0], np.cumsum(b["counts"])])]
            self.postings.append((at, queries.weight[at] * impact(b["times"][ours].astype(np.int64), m), upto))

    def best(self, q: int, k: int, threshold: int, asked: np.ndarray) -> tuple[np.ndarray, list, int]:
        """Scores and ids of the k best documents of query q that reach the threshold (at least 1), and how many blocks
        were scored. asked: a row of zeros, a place for each term."""
        own = slice(self.queries.starts[q], self.queries.starts[q + 1])
        places, times = self.queries.places[own], self.queries.times[own]
        bound = times @ self.bounds[places]
        asked[places] = times
        scores, ids, done = np.zeros(0, np.int64), [], 0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] < threshold:
                break
            done += 1
            at, weight, upto = self.postings[b]
            sums = np.concatenate([[0], np.cumsum(asked[at] * weight)])[upto]
            got = sums[1:] - sums[:-1]
            new = np.flatnonzero(got >= threshold)
            if not len(new):
                continue
            scores = np.concatenate([scores, got[new]])
            ids += [self.ids[b][i] for i in new.tolist()]
            if len(scores) >= k:
                order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))[:k]
                scores, ids = scores[order], [ids[i] for i in order]
                threshold = max(threshold, int(scores[-1]))
        asked[places] = 0
        return scores, ids, done


def _searched(blocks_of: list[list[str]], k: int, n_docs: int, total: int):
    def of(blocks: list[dict], thresholds: dict):
        for paths in blocks_of:
            queries = _Queries.read(paths)
            chunk, asked = _Chunk(blocks, queries, n_docs, total), np.zeros(len(queries.terms), np.int64)
            out = ([], [], [])
            for q, query in enumerate(queries.ids.tolist()):
                scores, ids, _ = chunk.best(q, k, thresholds.get(query, 1), asked)
                if len(ids) == k:
                    thresholds[query] = max(thresholds.get(query, 1), int(scores[-1]))
                out[0].extend([query] * len(ids))
                out[1].extend(ids)
                out[2].extend(scores.tolist())
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query", "doc_id", "score"])

    def run(batches):
        held, size, thresholds = [], 0, {}
        for batch in batches:
            columns = {n: batch.column(n) for n in _NAMES}
            for i in range(batch.num_rows):
                block = {n: c[i].values.to_numpy(zero_copy_only=False) for n, c in columns.items() if n != "doc_ids"} | {"doc_ids": columns["doc_ids"][i].as_py()}
                held.append(block)
                size += len(block["terms"])
                if size >= CHUNK_POSTINGS:
                    yield from of(held, thresholds)
                    held, size = [], 0
        if held:
            yield from of(held, thresholds)

    return run


def _query_blocks(asked: DataFrame, df: DataFrame, n_docs: int, block_terms: int) -> list[list[str]]:
    """Queries (query, terms, times) with their terms' weights, in files of about block_terms terms; the paths of each block."""
    spark = asked.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/queries-{uuid.uuid4().hex}"
    sizes = asked.select("query", F.shiftright("query", 33).alias("part"), F.size("terms").cast("long").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("before"))  # a row for each partition
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("query").rowsBetween(Window.unboundedPreceding, -1))
    numbered = sizes.join(F.broadcast(starts), F.col("part") == F.col("_part")).select(F.col("query").alias("_query"), F.floor((F.col("before") + F.coalesce(upto, F.lit(0))) / block_terms).alias("block"))
    terms = asked.select("query", F.explode(F.arrays_zip("terms", "times")).alias("t")).select("query", F.col("t.terms").alias("term"), F.col("t.times").alias("times"))
    known = df.select(F.col("term").alias("_term"), "df")
    rows = terms.join(known, F.col("term") == F.col("_term")).join(numbered, F.col("query") == F.col("_query")).select("block", "query", "term", "times", "df")
    files = staged(rows.repartition("block").sortWithinPartitions("block", "query").mapInArrow(_write_queries(folder, n_docs), "block long, path string"), "query-blocks")
    paths: dict[int, list[str]] = {}
    for r in files.collect():  # a path or a few for each block
        paths.setdefault(r["block"], []).append(r["path"])
    return [paths[b] for b in sorted(paths)]


def search(index: Index, asked: DataFrame, k: int = 20, block_terms: int = 1 << 16) -> DataFrame:
    """query, rank, doc_id, score: of each query the k documents of highest score above 0, equal scores by doc_id (nulls
    last). asked (staged): query, terms, times. Queries are read in blocks from the shared folder, against all blocks of
    the index; a task gives k rows a query and chunk at most."""
    small_batches(asked.sparkSession)
    paths = _query_blocks(asked, index.frequencies(), index.n_docs, block_terms)
    if paths:
        found = index.blocks.mapInArrow(_searched(paths, k, index.n_docs, index.n_terms), "query long, doc_id long, score long")
    else:
        found = asked.sparkSession.createDataFrame([], "query long, doc_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of queries (item_id, text) its k best documents (doc_id, text).

    Terms are runs of digits, letters and whatever is not ASCII, A-Z in lower case; a score sums the weights of the
    item's terms, repeats included, in 64-bit numbers. Null and empty texts have no terms: such a document is never found
    and counts nowhere, such an item has no row, nor has one whose terms occur in no document or in all of them. Rows
    that repeat an item_id are queries each; rows that repeat a doc_id are documents each; nulls of either are ids like
    others, a null doc_id behind its equals. Other columns are left out; empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    items = staged(queries.select(F.monotonically_increasing_id().alias("query"), "item_id", F.col("text").cast("string").alias("text")), "items")
    asked = staged(items.select("query", "text").mapInArrow(_queried, "query long, terms array<long>, times array<long>"), "asked")
    index = build_index(docs, term_filter(asked.select(F.explode("terms").alias("term"))))
    found = search(index, asked, k)
    return found.join(items.select(F.col("query").alias("of"), "item_id"), F.col("query") == F.col("of")).select("item_id", "rank", "doc_id", "score")

