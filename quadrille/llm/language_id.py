"""Language identification by rank-order profiles of character n-grams.

Each language's profile is its most frequent n-grams of one to three characters, in order. A document is given
the language whose profile is least out of place: the sum, over the document's own most frequent n-grams, of how
far each one's rank is from its rank in the profile, and the profile's length for one that it lacks.
"""

from __future__ import annotations

import uuid
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import PASSES, read_json, shared_dir, small_batches, staged, texts, write_json

N_GRAMS = 3
_SHIFT = 21  # bits of a code point


def letters(text: str | None) -> np.ndarray:
    """Code points in lower case, each run of others than letters as one space, with a space at either end; empty without letters."""
    s = (text or "").lower()
    codes = np.frombuffer(s.encode("utf-32-le", "replace"), "<u4")
    if not len(codes):
        return codes
    if int(codes.max()) < 256:
        keep = _LATIN[codes]
    else:
        keep = np.fromiter(map(str.isalpha, s), bool, len(s)) if len(s) == len(codes) else np.zeros(len(codes), bool)
    if not keep.any():
        return codes[:0]
    out = np.concatenate([[32], np.where(keep, codes, 32), [32]])
    space = out == 32
    return out[~(space & np.concatenate([[False], space[:-1]]))].astype(np.int64)


_LATIN = np.array([chr(k).isalpha() for k in range(256)])


def grams(codes: np.ndarray) -> np.ndarray:
    """The n-grams as numbers, without those of spaces alone."""
    found = [codes[codes != 32]]
    for n in range(2, N_GRAMS + 1):
        if len(codes) >= n:
            g = codes[: len(codes) - n + 1].copy()
            for k in range(1, n):
                g = (g << _SHIFT) | codes[k : len(codes) - n + 1 + k]
            found.append(g)
    return np.concatenate(found)


def ranked(values: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent values first; of equal counts the smallest."""
    if len(values) > 4 * top:  # the rest cannot be among the first
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values, -counts))][:top]


def _count(batches):
    total: dict[str, dict[int, int]] = {}
    held = 0
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            by.setdefault(lang, []).append(grams(letters(text)))
        for lang, parts in by.items():
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            own = total.setdefault(lang, {})
            before = len(own)
            for v, c in zip(values.tolist(), counts.tolist()):
                own[v] = own.get(v, 0) + c
            held += len(own) - before
            if held > 1_000_000:
                for of, n in total.items():
                    yield _counted(of, n)
                total, held = {}, 0
    for lang, own in total.items():
        yield _counted(lang, own)


def _counted(lang: str, own: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])


def profile_table(labelled: DataFrame, top: int = 400) -> DataFrame:
    """lang, rank (from 0), gram: the top n-grams of every language over all rows of labelled (text, lang); rows of null
    lang are left out. A language whose texts have no letter has no profile. Counted and ranked in Spark."""
    small_batches(labelled.sparkSession)
    known = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null")
    counts = known.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", first - 1).filter(F.col("rank") < top).select("lang", "rank", "gram")


def _write_profiles(folder: str):
    def run(batches):
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("block", "lang", "gram"))))
        for block, own in groupby(rows, key=lambda r: r[0]):
            path = f"{folder}/{uuid.uuid4().hex}.profiles"
            write_json(path, {lang: [r[2] for r in grams_of] for lang, grams_of in groupby(own, key=lambda r: r[1])})
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([path])], names=["block", "path"])

    return run


def fit_profiles(labelled: DataFrame, top: int = 400, block_languages: int = 256) -> list[str]:
    """profile_table in files of about block_languages profiles each, in the shared folder; their paths. However many
    languages there are, no profile comes to the driver. Without a labelled letter there is no file."""
    spark = labelled.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/profiles-{uuid.uuid4().hex}"
    known = staged(profile_table(labelled, top), "profiles")
    blocks = -(-known.filter("rank = 0").count() // block_languages)
    dealt = known.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(max(1, blocks))).cast("long"))
    files = staged(dealt.repartition("block").sortWithinPartitions("block", "lang", "rank").mapInArrow(_write_profiles(folder), "block long, path string"), "profile-files")
    return [r["path"] for r in files.orderBy("block", "path").collect()]


@lru_cache(maxsize=1)
def _ranker(path: str, top: int) -> "Ranker":
    return Ranker({lang: np.array(own, np.int64) for lang, own in read_json(path).items()}, top)


class Ranker:
    def __init__(self, profiles: dict[str, np.ndarray], top: int):
        self.names, self.top = sorted(profiles), top
        self.known = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.rank = np.full((len(self.names), len(self.known) + 1), -1, np.int64)  # the last column: in no profile
        for k, name in enumerate(self.names):
            self.rank[k, np.searchsorted(self.known, profiles[name])] = np.arange(len(profiles[name]))

    def __call__(self, text: str | None) -> tuple[str, float, float, float]:
        """The nearest language, how far out of place it is, its nearness and that of all together."""
        codes = letters(text)
        if not len(codes) or not self.names:
            return "und", 0.0, 0.0, 0.0
        values, counts = np.unique(grams(codes), return_counts=True)
        own = ranked(values, counts, self.top)
        at = np.searchsorted(self.known, own)
        at[at == len(self.known)] = 0
        ranks = self.rank[:, np.where(self.known[at] == own, at, len(self.known))]
        off = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(off.argmin())  # of equal distances the first name
        near = 1 - off / max(1, self.top * len(own))
        return self.names[best], float(off[best]), float(near[best]), float(near.sum())


_FOUND = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang_pred", pa.string()), ("off", pa.float64()), ("near", pa.float64()), ("total", pa.float64())])


def _predict(path: str, top: int, last: bool):
    """One block of profiles: what it finds, beside what blocks before it found."""

    def run(batches):
        ranker = _ranker(path, top)
        for batch in batches:
            rows = []
            for text, *old in zip(*(batch.column(c).to_pylist() for c in ("text", "lang_pred", "off", "near", "total"))):
                name, off, near, total = ranker(text)
                if old[0] is not None and name != "und":
                    total += old[3]
                    if (old[1], old[0]) < (off, name):
                        name, off, near = old[:3]
                rows.append((None if last else text, name, off, near, total))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, _FOUND.types[1:]))], schema=_FOUND)

    return run


def predict(docs: DataFrame, profiles: list[str], top: int = 400) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1: the nearness to that profile as a share of all).

    Whole texts are read, once for each file of profiles. 'und' with score 0 where text is null or has no letter, or no
    profile is known. Of equal distances the first name wins. Repeated rows give a row each, other columns are left
    out, an empty table none.
    """
    small_batches(docs.sparkSession)
    none = F.lit(None).cast("double")
    out = texts(docs).select("doc_id", "text", F.lit(None).cast("string").alias("lang_pred"), none.alias("off"), none.alias("near"), none.alias("total"))
    for k, path in enumerate(profiles):
        out = out.mapInArrow(_predict(path, top, k == len(profiles) - 1), "doc_id long, text string, lang_pred string, off double, near double, total double")
        if k % PASSES == PASSES - 1 and k < len(profiles) - 1:
            out = staged(out, "predicted")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("near") / F.greatest(F.col("total"), F.lit(1e-9))))
    return out.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce(share, F.lit(0.0)).alias("score"))


def fold(doc_id: Column, folds: int) -> Column:
    """The remainder of crc32 of doc_id written as text."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
