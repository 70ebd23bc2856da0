"""Benchmark decontamination with an FM-index for each training shard.

A shard is a batch of documents. A window can only occur within a run of words that all occur in the benchmark, so
the shard's text is those runs, one after the other, each behind a separator of its own. Over it an FM-index is
built (suffix order, its preceding words in a wavelet matrix, every eighth suffix position); all windows are
searched in it backwards at once, their occurrences are located by walking to a sampled position, and the spans
of words that they cover are merged for each document.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadrille.llm.common import PASSES, read_json, shared_dir, small_batches, staged, texts, write_json

#: Bytes of words: digits, small letters (A-Z come lower-cased) and whatever is not ASCII.
_SPACE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_SPACE).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Bits:
    """A bit for each place, packed, with a count of ones before each 64: bits[k] is the number of ones before place k."""

    def __init__(self, bit: np.ndarray):
        packed = np.packbits(bit.astype(bool), bitorder="little")
        self.words = np.zeros(len(bit) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)[:-1]]).astype(np.uint32)

    def __getitem__(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & below)


class Wavelet:
    """Ranks and symbols of a sequence of numbers, level by level from the highest bit; many queries at once."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(bits - 1, -1, -1):
            bit = (seq >> shift) & 1
            self.levels.append((shift, Bits(bit), len(seq) - int(bit.sum())))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start = np.zeros_like(upto)
        for shift, ones, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            start = np.where(one, zeros + ones[start], start - ones[start])
            upto = np.where(one, zeros + ones[upto], upto - ones[upto])
        return upto - start

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol, start = np.zeros_like(place), np.zeros_like(place)
        for shift, ones, zeros in self.levels:
            one = ones[place + 1] - ones[place] == 1
            symbol = symbol | np.where(one, 1 << shift, 0)
            start = np.where(one, zeros + ones[start], start - ones[start])
            place = np.where(one, zeros + ones[place], place - ones[place])
        return symbol, place - start


class FMIndex:
    """Over numbers of 1 or more with 0 as separators; the last number is a separator. Each separator sorts apart, by place."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        n = len(text)
        text = text.astype(np.int64)
        ends = text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        h = 1
        while True:
            after = np.concatenate([rank[h:], np.zeros(min(h, n), np.int64)])[:n]
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            h *= 2
        self.n, self.order = n, order
        bwt = text[order - 1]
        self.bits = max(1, int(text.max()).bit_length())
        self.tree = Wavelet(bwt, self.bits)
        counts = np.bincount(text, minlength=(1 << self.bits) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        behind_end = np.concatenate([[True], ends[:-1]])
        self.sampled = (order % sample == 0) | behind_end[order]
        self.nth = np.concatenate([[0], np.cumsum(self.sampled)])
        self.places = order[self.sampled]
        del self.order

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (lo, hi) of the suffixes that begin with each pattern; patterns of one length, a row each."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            ok = (c > 0) & (c < 1 << self.bits)
            hi[alive[~ok]] = lo[alive[~ok]]
            alive, c = alive[ok], c[ok]
            lo[alive] = self.first[c] + self.tree.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.tree.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        hit = np.zeros(len(patterns), bool)
        hit[alive] = True
        return np.where(hit, lo, 0), np.where(hit, hi, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row's suffix."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[rows])
        while len(todo):
            symbol, rank = self.tree.at(rows[todo])
            rows[todo] = self.first[symbol] + rank
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.places[self.nth[rows]] + steps


class Phrases:
    """The windows of a block of benchmark items, by their length, as numbers of words; which items have each."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.number: dict[bytes, int] = {}
        by: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            for w in windows_of(words_of(text), size):
                by.setdefault(w, set()).add(item_id)
                for x in w:
                    self.number.setdefault(x, len(self.number) + 1)
        self.by_length: dict[int, tuple[np.ndarray, list[tuple[str, ...]]]] = {}
        for length in sorted({len(w) for w in by}):
            own = [w for w in by if len(w) == length]
            self.by_length[length] = (np.array([[self.number[x] for x in w] for w in own], np.int64), [tuple(by[w]) for w in own])

    def find(self, shard: list[np.ndarray]) -> list[tuple[np.ndarray, set[str]]]:
        """Per document of a shard (its words as numbers, 0: not in the benchmark): which words are hit; the items."""
        sizes = np.array([len(d) for d in shard], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        every = np.concatenate([*shard, np.zeros(0, np.int32)])
        edge = np.zeros(len(every) + 1, np.int64)
        items: list[set[str]] = [set() for _ in shard]
        if self.by_length and len(every):
            shortest = min(self.by_length)
            # runs of the benchmark's words within a document
            known = every > 0
            first = known & np.concatenate([[True], ~known[:-1]])
            inner = starts[1:-1][starts[1:-1] < len(every)]
            first[inner] |= known[inner]
            begin = np.flatnonzero(first)
            stop = np.flatnonzero(known & np.concatenate([~known[1:] | first[1:], [True]])) + 1
            long = stop - begin >= shortest
            begin, stop = begin[long], stop[long]
            if len(begin):
                span = stop - begin + 1
                at = np.repeat(begin - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
                text = np.where(np.isin(np.arange(len(at)), np.cumsum(span) - 1), 0, every[np.minimum(at, len(every) - 1)])
                index = FMIndex(text)
                for length, (patterns, owners) in self.by_length.items():
                    lo, hi = index.search(patterns)
                    found = np.flatnonzero(hi > lo)
                    if not len(found):
                        continue
                    times = (hi - lo)[found]
                    rows = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                    place = at[index.locate(rows)]
                    np.add.at(edge, place, 1)
                    np.add.at(edge, place + length, -1)
                    doc = np.searchsorted(starts, place, side="right") - 1
                    for d, p in np.unique(np.stack([doc, np.repeat(found, times)]), axis=1).T.tolist():
                        items[d].update(owners[p])
        hit = np.cumsum(edge[:-1]) > 0
        return [(hit[starts[k] : starts[k + 1]], items[k]) for k in range(len(shard))]


_SCHEMA = "doc_id long, text string, n_words long, spans array<struct<first:int,last:int>>, items array<string>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"first": a, "last": b} for a, b in zip(np.flatnonzero(step == 1).tolist(), (np.flatnonzero(step == -1) - 1).tolist())]


def _write_items(folder: str):
    """The items of each block, one block after the other, to a file of their own; a row for each file."""

    def run(batches):
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("block", "item_id", "text"))))
        for block, items in groupby(rows, key=lambda r: r[0]):
            path = f"{folder}/{uuid.uuid4().hex}.items"
            write_json(path, [r[1:] for r in items])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([path])], names=["block", "path"])

    return run


@lru_cache(maxsize=1)
def _phrases(path: str, size: int) -> Phrases:
    return Phrases([tuple(x) for x in read_json(path)], size)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words alone, where there is nothing to find."""
    for batch in batches:
        n_words = [len(words_of(t)) for t in batch.column("text").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("n_words"), "n_words", pa.array(n_words, pa.int64()))


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> list[str]:
    """The benchmark in files of about block_bytes of text (or one longer text) in the shared folder; their paths.

    Items are numbered by bytes before them, from totals of partitions; no text comes to the driver, only a path for
    each block. An empty benchmark has no block.
    """
    spark = benchmark.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/benchmark-{uuid.uuid4().hex}"
    items = staged(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id()), "benchmark")
    sized = items.select("row", F.shiftright("row", 33).alias("part"), (F.octet_length("text") + 8).cast("long").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy("part").agg(F.sum("size").alias("bytes")).select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("before"))  # a row for each partition
    upto = F.sum("size").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    numbered = sized.withColumn("upto", upto).join(F.broadcast(starts), "part").select(F.col("row").alias("of"), F.expr(f"(before + upto) div {block_bytes}").alias("block"))
    dealt = items.join(numbered, F.col("row") == F.col("of")).select("block", "item_id", "text")
    files = staged(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_write_items(folder), "block long, path string"), "benchmark-blocks")
    return [r["path"] for r in files.orderBy("block", "path").collect()]


def _scan(path: str, size: int, last: bool, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrases(path, size)
        for whole in batches:
            at = 0
            while at < whole.num_rows:  # a shard has one document or shard_bytes
                bytes_upto = np.cumsum([len(t or "") for t in whole.column("text").slice(at).to_pylist()])
                n = max(1, int(np.searchsorted(bytes_upto, shard_bytes)))
                batch = whole.slice(at, n)
                at += n
                number, shard = phrases.number.get, []
                for text in batch.column("text").to_pylist():
                    words = words_of(text)
                    shard.append(np.fromiter(map(number, words, repeat(0)), np.int32, len(words)))
                before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
                n_words, spans, items = [], [], []
                for own, (hit, found), (old_spans, old_items) in zip(shard, phrases.find(shard), before):
                    for s in old_spans or ():
                        hit[s["first"] : s["last"] + 1] = True
                    n_words.append(len(own))
                    spans.append(_spans(hit))
                    items.append(sorted(found.union(old_items or ())))
                text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text")
                columns = [batch.column("doc_id"), text, *(pa.array(x, t) for x, t in zip((n_words, spans, items), _ARROW.types[2:]))]
                carried = [n for n in batch.schema.names if n not in _ARROW.names]
                yield pa.RecordBatch.from_arrays(columns + [batch.column(n) for n in carried], names=_ARROW.names + carried)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = 8 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, spans (words that lie in an occurrence of a window: first and last,
    merged, from 0) and items (ids, as sorted strings, of the items that have an occurring window).

    Words are runs of digits, letters and whatever is not ASCII, A-Z in lower case. A window is `size` consecutive
    words of an item; an item of fewer words, but not none, is one window. A null text has no words; a null item_id
    counts as the id ''. Repeated rows give a row each, equal windows of several items count for each of them, other
    columns are left out, and an empty table gives no rows. The benchmark is cut into blocks of block_bytes, one pass
    over the documents each; a task reads its block from the shared folder, so neither the driver nor a broadcast
    holds any of it, and it may be of any size.
    """
    return _scanned(texts(docs), benchmark, size, block_bytes, shard_bytes).drop("text")


def _scanned(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = 8 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """contamination of docs (doc_id, text), beside whatever other columns docs carries; text is null."""
    small_batches(docs.sparkSession)
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"), *carried)
    schema = StructType([*StructType.fromDDL(_SCHEMA), *(docs.schema[c] for c in carried)])
    blocks = benchmark_blocks(benchmark, block_bytes)
    if not blocks:
        return out.mapInArrow(_counted, schema)
    for k, path in enumerate(blocks):
        out = out.mapInArrow(_scan(path, size, k == len(blocks) - 1, shard_bytes), schema)
        if k % PASSES == PASSES - 1 and k < len(blocks) - 1:
            out = staged(out, "scanned")
    return out


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated: hit words are at least one in `share`."""
    return found.select("doc_id", "n_words", _n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", _over(F.col("n_hit"), share))


def _n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def _over(n_hit: Column, share: int) -> Column:
    return (n_hit > 0) & (n_hit * share >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """docs without the contaminated rows; columns as they are, whatever their names. A verdict is that of the row's own
    text: rows of one doc_id, and rows without one, stay or go each by itself, repeated rows alike. Null and empty texts
    stay; an empty table gives no rows, and an empty benchmark takes none."""
    own = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))
    found = _scanned(own, benchmark, size)
    return found.withColumn("n_hit", _n_hit()).filter(~_over(F.col("n_hit"), share)).select("row.*")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
