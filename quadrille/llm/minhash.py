"""MinHash near-duplicates by circulant signatures, with exact Jaccard checks.

Two permutations of the 64-bit numbers make a whole signature. The first one scatters the hashes of a set's shingles;
coordinate k is then the least value that the second one gives them when they are shifted by k around the circle of
all 64-bit numbers. Bands of consecutive coordinates are cells. Sets that share a cell are chained to its first set;
what such chains join are loose groups, and within each loose group whole sets are compared exactly, so links follow
from full sets alone and a signature only decides what is compared.

A pair of similarity s shares no band with a chance of (1 - s**rows)**bands (`missed`): one in 8e9 for 0.85 with 48 bands
of 6 rows, one in 8e6 for 0.8 with 40 of 5. That chance has no exact way behind it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import beside, facts_of, join_counted, small_batches, staged, texts
from quadrille.llm.components import components, fitted, kept

ROWS = 6  # coordinates of a band
_SCATTER, _TURN, _LAST, _MIX = np.random.default_rng(13).integers(1 << 62, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
_PART = 256  # shingles whose coordinates are reckoned at once


def missed(similarity: float, bands: int, rows: int = ROWS) -> float:
    """The chance that a pair of that similarity shares no band."""
    return (1 - similarity**rows) ** bands


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included. Fewer than `shingle` words: one shingle; no word: none."""
    words = (text or "").encode().lower().split()  # white space here is \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    h, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return np.array([h(joined, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    return np.array([h(joined[i:j], seed) for i, j in zip((ends - size).tolist(), ends[shingle - 1 :].tolist())], np.uint64)


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """The least values of a set under the second permutation, shifted by 0 to size - 1 behind the first one."""
    scattered = hashes * _SCATTER
    scattered = (scattered ^ (scattered >> np.uint64(31))) * _TURN  # a product, so a shift before it is a sum behind it
    shifts = (np.arange(size, dtype=np.uint64) * _TURN)[:, None]
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(scattered), _PART):
        at = scattered[None, k : k + _PART] + shifts
        at ^= at >> np.uint64(32)
        at *= _LAST
        np.minimum(least, at.min(axis=1), out=least)
    return least


def cells_of(hashes: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """A number for each band of the set's signature; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    out = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
    for row in signature(hashes, bands * rows).reshape(bands, rows).T:
        out = (out ^ (row >> np.uint64(29)) ^ row) * _MIX
    return out.view(np.int64)


def digest_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def similar_forest(ids: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that join exactly what pairs of at least that similarity (a fraction) join: a member and its group's first one.

    Sets are ordered from their rarest shingle on. Two sets of that similarity share one of the first
    size - ceil(similarity * size) + 1 of each, so only sets that do are compared.
    """
    part, whole = similarity
    size = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(size)])
    _, flat, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    owner = np.repeat(np.arange(len(sets)), size)
    flat = rank[flat]
    flat = flat[np.lexsort((flat, owner))]
    head = size + (-part * size) // whole + 1
    heads = np.arange(len(flat)) - starts[owner] < head[owner]
    order = np.argsort(flat[heads], kind="stable")
    posted, at = owner[heads][order], np.searchsorted(flat[heads][order], np.arange(len(times) + 1))

    def spans(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())

    mark, left, out = np.zeros(len(times), bool), np.ones(len(sets), bool), []
    n_left = len(sets)
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        n_left -= 1
        edge = [first]
        while edge and n_left:
            x = edge.pop()
            own = flat[starts[x] : starts[x + 1]]
            tokens = own[: head[x]]
            near = np.unique(posted[spans(at[tokens], at[tokens + 1] - at[tokens])])
            near = near[left[near] & (whole * np.minimum(size[near], size[x]) >= part * np.maximum(size[near], size[x]))]
            if not len(near):
                continue
            mark[own] = True
            shared = np.add.reduceat(mark[flat[spans(starts[near], size[near])]], np.concatenate([[0], np.cumsum(size[near])[:-1]]), dtype=np.int64)
            mark[own] = False
            near = near[whole * shared >= part * (size[near] + size[x] - shared)]
            out += [(int(ids[y]), int(ids[first])) for y in near]
            edge += near.tolist()
            left[near] = False
            n_left -= len(near)
    return out


def _sketched(words: int, bands: int):
    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
            columns = [pa.array([len(h) for h in sets], pa.int64()), pa.array([digest_of(h) for h in sets], pa.binary()), pa.array([cells_of(h, bands) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *columns], names=["row", "doc_id", "n", "same", "cells"])

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            sets = pa.array([np.unique(shingle_hashes(t, words)).view(np.int64) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "grp", "blocks")] + [sets], names=["row", "grp", "blocks", "shingles"])

    return run


def _sets_beside(words: int, path: str):
    """_sets of the rows (row, text) that have facts (grp, blocks) in path."""

    def met(batches):
        known = facts_of(path)
        for batch in batches:
            has, facts = known(batch.column("row").to_numpy())
            if facts is not None and len(facts):
                own = batch.filter(pa.array(has))
                columns = [own.column("row"), *(facts.column(c).combine_chunks() for c in ("grp", "blocks")), own.column("text")]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "grp", "blocks", "text"])

    return lambda batches: _sets(words)(met(batches))


def _verified(similarity: tuple[int, int]):
    def of(held):
        pairs = similar_forest(np.array([r[0] for r in held]), [r[1] for r in held], similarity)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        at, held = None, []
        for batch in batches:
            sets = batch.column("shingles")
            for k, (cell, row) in enumerate(zip(batch.column("cell").to_pylist(), batch.column("row").to_pylist())):
                if cell != at and len(held) > 1:
                    yield of(held)
                if cell != at:
                    at, held = cell, []
                held.append((row, sets[k].values.to_numpy(zero_copy_only=False)))
        if len(held) > 1:
            yield of(held)

    return run


def similar_links(rows: DataFrame, sets: DataFrame, words: int, similarity: tuple[int, int], block_shingles: int = 1_000_000, in_place: bool = False, n_sets: int | None = None) -> DataFrame:
    """a, b: links of rows whose components are those of all pairs with at least that similarity (a fraction).

    rows (row, text) has the texts. sets (checkpointed) has one row for each set of shingles that occurs, not empty: row
    (of one of its texts), its size n and its cells; so however many texts share a set, one of them stands for all.
    Loose groups that hold more than block_shingles shingles are cut into blocks, and each pair of blocks meets in a
    task of its own; only members of loose groups move their shingles. in_place: rows come from a staged table whose numbers
    ascend, and its tasks read the groups that lie beside it, so no text is shuffled. n_sets: how many sets there are,
    where that is known; small tables are then kept in as few parts as they fill.
    """
    cells = sets.select("row", F.explode("cells").alias("cell"))
    shared, totals = kept(cells.groupBy(F.col("cell").alias("of")).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), n_sets)
    chained = join_counted(cells, shared, "cell", totals=totals).filter("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    members = fitted(components(chained, n_sets).join(sets.select("row", "n"), F.col("node") == F.col("row")).select("row", "n", F.col("root").alias("grp")), n_sets).checkpoint()
    sizes, totals = kept(members.groupBy(F.col("grp").alias("of")).agg(F.count(F.lit(1)).alias("_n"), F.ceil(F.sum(F.col("n") + 50) / block_shingles).cast("int").alias("blocks")), n_sets)
    dealt = join_counted(members, sizes, "grp", totals=totals).select(F.col("row").alias("member"), "grp", "blocks")
    kinds = "row long, grp long, blocks int, shingles array<long>"
    if in_place:
        path = beside(dealt.select(F.col("member").alias("row"), "grp", "blocks"), "loose-groups")
        whole = rows.select("row", "text").mapInArrow(_sets_beside(words, path), kinds)
    else:
        whole = rows.join(dealt, F.col("row") == F.col("member")).select("row", "grp", "blocks", "text").mapInArrow(_sets(words), kinds)
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    pair = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j).cast("long") * F.col("blocks") + F.greatest(own, j) + 1))
    met = whole.select("row", "shingles", "grp", F.explode(pair).alias("pair")).select(F.xxhash64("grp", "pair").alias("cell"), "row", "shingles")
    return met.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verified(similarity), "a long, b long")


def near_groups(docs: DataFrame, words: int = 3, similarity: tuple[int, int] = (85, 100), bands: int = 48, block_shingles: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id, kept.

    A document's set has the distinct shingles of `words` words (runs of anything but space and \\x09-\\x0D, A-Z in lower
    case); of fewer words the whole sequence is the only shingle. Documents are linked where the sets' intersection is
    at least that part (a fraction) of their union, and component_id is the smallest doc_id that links reach, itself
    included. Null, empty and blank texts have an empty set and are linked with nothing. Rows are judged each by its own
    text: repeated rows give a row each, and rows of one doc_id may have different components. A null doc_id is never a
    component's id unless all its rows have none; kept is true where doc_id and component_id are the same, nulls
    included. Other columns are left out; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    numbered = staged(texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "minhash-texts")
    sketches = staged(numbered.mapInArrow(_sketched(words, bands), "row long, doc_id long, n long, same binary, cells array<long>"), "minhash")
    sets = sketches.filter("n > 0").groupBy("same").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("_n"), F.first("n").alias("n"), F.first("cells").alias("cells")).checkpoint()
    roots = components(similar_links(numbered.select("row", "text"), sets, words, similarity, block_shingles))
    rooted = sets.select("same", "row", "least", F.col("_n").alias("times")).join(roots, F.col("row") == F.col("node"), "left").select("same", "least", "times", F.coalesce("root", "row").alias("root")).checkpoint()
    named, totals = kept(rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_n")))
    known, totals = kept(join_counted(rooted, named, "root", totals=totals).select(F.col("same").alias("of"), F.col("times").alias("_n"), "component_id", F.lit(True).alias("found")))
    told = join_counted(sketches.select("doc_id", "n", "same"), known, "same", "left", totals=totals)  # large groups of copies are dealt over all tasks
    own = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id"))
    return told.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
