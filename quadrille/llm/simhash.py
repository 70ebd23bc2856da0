"""SimHash near-duplicates, found through a segment-popcount embedding.

A fingerprint's bits are cut into segments of two; the counts of set bits in them are a point on a small grid. The
Manhattan distance of two points is at most the Hamming distance of their fingerprints, so fingerprints within r
bits have points within r, and in one half of the segments points within r/2 (rounded down). There each side steps
r/4 or so: both visit the grid cells within half that distance of their points, and two such points share a cell.
Rows of a cell meet by an equi-join's shuffle and their fingerprints are compared exactly. A cell gives the links
of a spanning forest, not all pairs, so groups of many near copies stay in proportion to their rows.

The grid serves a few bits only. Texts of a similarity (Jaccard, sets of shingles of five words) of 0.8 lie about ten
bits apart, and further where they repeat shingles differently often, so the pipeline's stage finds those through
min-hash bands (see minhash): fingerprints have no part in that.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quadrille.llm.common import beside, facts_of, join_counted, shared_dir, small_batches, staged, texts
from quadrille.llm.components import components, fitted, kept
from quadrille.llm.minhash import cells_of, digest_of, shingle_hashes, similar_links

SEGMENTS = 16  # of two bits, in each half
_POW = 3 ** np.arange(SEGMENTS, dtype=np.int64)
_HALF = 3**SEGMENTS
_SHORT = 24


def majority(hashes: np.ndarray) -> int:
    """Bit i is set where over half of the hashes have it; of none: 0."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Bit i is set where over half of the shingles' XXH64 have it. No word: 0. Fewer than `shingle` words: one shingle."""
    return majority(shingle_hashes(text, shingle, seed))


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def _sketches(shingle: int, words: int, bands: int, band_rows: int):
    """fp: of shingles of `shingle` words; n, same, cells: size, digest and bands of the set of shingles of `words` words."""

    def run(batches):
        for batch in batches:
            own = batch.column("text").to_pylist()
            prints = np.array([fingerprint(t, shingle) for t in own], np.uint64).view(np.int64)
            sets = [np.unique(shingle_hashes(t, words)) for t in own]
            columns = [pa.array([len(h) for h in sets], pa.int64()), pa.array([digest_of(h) for h in sets], pa.binary()), pa.array([cells_of(h, bands, band_rows) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(prints), *columns], names=["row", "fp", "n", "same", "cells"])

    return run


def _without(path: str):
    """Rows that have no facts in path, with all their columns."""

    def run(batches):
        known = facts_of(path)
        for batch in batches:
            has, _ = known(batch.column("row").to_numpy())
            yield batch.filter(pa.array(~has)) if has.any() else batch

    return run


def points(fps: np.ndarray) -> np.ndarray:
    """Counts of set bits by segment, one row a fingerprint."""
    two = np.arange(2 * SEGMENTS, dtype=np.uint64) * np.uint64(2)
    return (np.bitwise_count((fps[:, None] >> two) & np.uint64(3))).astype(np.int64)


def _ball(radius: int) -> list[tuple[tuple[int, int], ...]]:
    """The moves of a point: which segments change by how much, radius in all."""
    found = [()]
    if radius >= 1:
        found += [((k, d),) for k in range(SEGMENTS) for d in ((1, -1) if radius == 1 else (1, -1, 2, -2))]
    if radius >= 2:
        found += [((i, a), (j, b)) for i in range(SEGMENTS) for j in range(i + 1, SEGMENTS) for a, b in product((1, -1), (1, -1))]
    return found


def _cells(bits: int):
    moves = _ball(-(-(bits // 2) // 2))

    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k in range(0, len(fps), 20_000):
                part = fps[k : k + 20_000]
                at = points(part)
                for half in (0, 1):
                    own = at[:, half * SEGMENTS : (half + 1) * SEGMENTS]
                    code = own @ _POW + half * _HALF
                    cells, who = [], []
                    for move in moves:
                        ok = np.ones(len(part), bool)
                        to = code
                        for seg, by in move:
                            ok &= (own[:, seg] + by >= 0) & (own[:, seg] + by <= 2)
                            to = to + by * _POW[seg]
                        cells.append(to[ok])
                        who.append(part[ok])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(who).view(np.int64))], names=["cell", "fp"])

    return run


def forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly the fingerprints that distances of at most `bits` join: a member and its group's first one."""
    left = np.unique(fps)
    a, b = [], []
    while len(left) > 1:
        first, left = left[0], left[1:]
        edge = np.array([first], np.uint64)
        while len(edge) and len(left):
            near = np.zeros(len(left), bool)
            for k in range(0, len(edge), 64):
                near |= (np.bitwise_count(edge[k : k + 64, None] ^ left[None, :]) <= bits).any(axis=0)
            edge, left = left[near], left[~near]
            a.append(edge)
            b.append(np.full(len(edge), first, np.uint64))
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(bits: int):
    """Rows sorted by cell to links. Short runs of a cell are compared by shifting the rows against themselves."""

    def of(cell: np.ndarray, fp: np.ndarray):
        bounds = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        sizes = np.diff(np.concatenate([bounds, [len(cell)]]))
        a, b = [], []
        for at, n in zip(bounds[sizes > _SHORT].tolist(), sizes[sizes > _SHORT].tolist()):
            x, y = forest(fp[at : at + n], bits)
            a.append(x)
            b.append(y)
        short = np.repeat(sizes <= _SHORT, sizes)
        cell, fp = cell[short], fp[short]
        for d in range(1, _SHORT):
            same = cell[d:] == cell[:-d] if d < len(cell) else np.zeros(0, bool)
            if not same.any():
                break
            near = same & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= bits)
            a.append(fp[d:][near])
            b.append(fp[:-d][near])
        if not a:
            return None
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x.copy().view(np.int64)) for x in pairs], names=["a", "b"])

    def run(batches):
        held_cell, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            held_cell = np.concatenate([held_cell, batch.column("cell").to_numpy(zero_copy_only=False)])
            held_fp = np.concatenate([held_fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(held_cell) < 200_000 or held_cell[0] == held_cell[-1]:
                continue
            cut = int(np.searchsorted(held_cell, held_cell[-1]))  # the last cell may go on
            if (out := of(held_cell[:cut], held_fp[:cut])) is not None:
                yield out
            held_cell, held_fp = held_cell[cut:], held_fp[cut:]
        if len(held_cell) and (out := of(held_cell, held_fp)) is not None:
            yield out

    return run


def links(prints: DataFrame, bits: int = 4, cell_rows: int = 20_000) -> DataFrame:
    """a, b: links whose components are those of all pairs of fingerprints (fp, distinct) within `bits` bits.

    Cells of more than cell_rows fingerprints are cut into blocks, and each pair of blocks meets in a task of its
    own, so no task holds more than two blocks.
    """
    if not 0 <= bits <= 8:
        raise ValueError("the grid serves distances of 0 to 8 bits")
    prints.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50_000)
    # few bytes make many cells, so rows are dealt by their number first, not by the bytes that a scan or checkpoint holds
    dealt = prints.select("fp").repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    return cell_links(dealt.mapInArrow(_cells(bits), "cell long, fp long"), bits, cell_rows)


def cell_links(cells: DataFrame, bits: int, cell_rows: int = 20_000) -> DataFrame:
    """a, b: links whose components are those of all pairs of one cell (cell, fp) within `bits` bits."""
    full = cells.groupBy("cell").count().filter(F.col("count") > cell_rows).select(F.col("cell").alias("of"), F.ceil(F.col("count") / cell_rows).cast("int").alias("n")).checkpoint()
    if not full.isEmpty():
        # block i of a full cell goes to every pair of blocks that has i; the pair is part of the cell's number
        own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        dealt = cells.join(full, F.col("cell") == F.col("of"), "left").select("cell", "fp", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.least(own, j).cast("long") * F.col("n") + F.greatest(own, j) + 1))).alias("pair"))
        cells = dealt.select(F.xxhash64("cell", "pair").alias("cell"), "fp")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(bits), "a long, b long")


def near_groups(docs: DataFrame, shingle: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint as a signed number), component_id (the smallest doc_id that
    links of at most `bits` differing bits reach, itself included).

    Words are runs of anything but space and \\x09-\\x0D, A-Z in lower case. A null or empty text has fingerprint 0
    and is linked like any other. Repeated rows give a row each. A null doc_id is never a component's id unless all
    its documents have none. Other columns are left out; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return grouped(staged(texts(docs).mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long"), "simhash"), bits)


def grouped(prints: DataFrame, bits: int) -> DataFrame:
    """prints (doc_id, fp; staged) with component_id, the smallest doc_id that links of at most `bits` bits reach."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).checkpoint()
    roots = components(links(distinct, bits))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rows", "least", F.coalesce("root", "fp").alias("root")).checkpoint()
    named, totals = kept(rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_n")))
    named, totals = kept(join_counted(rooted, named, "root", totals=totals).select(F.col("fp").alias("of"), F.col("rows").alias("_n"), "component_id"))
    return join_counted(prints, named, "fp", totals=totals).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 4, bits: int = 4, words: int = 5, similarity: tuple[int, int] = (4, 5), bands: int = 40, band_rows: int = 5) -> DataFrame:
    """docs with one row of each group of near copies, that with the smallest doc_id; columns as they are, whatever their names.

    Near copies are texts whose fingerprints (shingles of `shingle` words) differ in at most `bits` bits, or whose sets
    of shingles of `words` words have a similarity (Jaccard) of at least `similarity`, a fraction; a pair at that bound is
    not compared once in eight million (minhash.missed), one of 0.9 once in 10^15. Each row is judged by
    its own text, also where rows share a doc_id. Rows without a doc_id are grouped like others, but count among
    themselves: of a group's rows without a doc_id one stays, beside the one of the smallest doc_id. Of equal ids any one
    stays. Rows without words (null, empty, white space) stay; an empty table gives no rows. docs is staged once with a
    number for each row, and is not shuffled: tasks that pass over it read what is known of their rows (common.beside).
    Links and groups are kept in as many parts as they fill, each table by a job of its own.
    """
    small_batches(docs.sparkSession)
    numbered = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("own")), "rows")
    worded = numbered.filter(F.col("own.text").rlike(r"[^\x20\x09-\x0D]")).select("row", F.col("own.text").cast("string").alias("text"))
    seen = Observation()
    sketches = worded.mapInArrow(_sketches(shingle, words, bands, band_rows), "row long, fp long, n long, same binary, cells array<long>")
    sketches = staged(sketches.observe(seen, F.count(F.lit(1)).alias("rows")), "sketches")
    n = seen.get["rows"] or 0
    sets, set_totals = kept(sketches.groupBy(F.col("same").alias("of")).agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("_n"), F.first("n").alias("n"), F.first("cells").alias("cells")), n)
    prints, print_totals = kept(sketches.groupBy(F.col("fp").alias("of")).agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("_n")), n)

    def to_least(facts: DataFrame, key: str, totals: tuple) -> DataFrame:
        """Links of rows to the least one of their key."""
        shared = facts.filter("_n > 1").select("of", "_n", "least")
        led = join_counted(sketches.select(F.col("row").alias("a"), key), shared, key, totals=totals).select("a", F.col("least").alias("b"))
        return fitted(led.filter("a <> b"), n).checkpoint()

    same_print, equal = to_least(prints, "fp", print_totals), to_least(sets, "same", set_totals)
    # links of fingerprints as links of rows: many of them may lead to one, so that side's links are counted
    found = fitted(links(prints.select(F.col("of").alias("fp")), bits), n).checkpoint()
    hubs, hub_totals = kept(found.groupBy(F.col("b").alias("of")).agg(F.count(F.lit(1)).alias("_n")).join(prints.select("of", "least"), "of"), n)
    near = join_counted(found, hubs, "b", totals=hub_totals).select("a", F.col("least").alias("first")).join(prints, F.col("a") == F.col("of")).select(F.col("least").alias("a"), F.col("first").alias("b"))
    near = fitted(near, n).checkpoint()
    similar = similar_links(worded, sets.select(F.col("least").alias("row"), "n", "cells"), words, similarity, in_place=True, n_sets=n)
    groups = components(near.unionByName(same_print).unionByName(equal).unionByName(similar), n)
    ids = numbered.select(F.col("row").alias("member"), F.col("own.doc_id").alias("id"))
    members = fitted(groups.join(ids, F.col("node") == F.col("member")).select("member", "root", "id"), n).checkpoint()
    stay = members.groupBy("root", F.col("id").isNull()).agg(F.min(F.struct("id", "member"))["member"].alias("stays"))
    gone = beside(members.join(stay, F.col("member") == F.col("stays"), "left_anti").select(F.col("member").alias("row")), "near-copies")
    small_batches(docs.sparkSession)  # links took larger ones
    return numbered.mapInArrow(_without(gone), numbered.schema).select("own.*")
