"""Toxicity by weak supervision.

From a bounded sample of labelled rows a lexicon is mined: words and word beginnings that toxic documents have and
others hardly. Each entry is a voter, and patterns over the entries are further voters. A generative label model
estimates, by expectation and maximisation, how often each voter is right about the hidden label and how voters go together
beyond it (whose votes then count for less), and gives every sampled row a posterior. A linear classifier trained on
these posteriors scores all documents; the labels themselves choose the lexicon and the classes' shares only.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import small_batches, staged, texts
from quadrille.llm.language_id import fold

PREFIXES = (4, 5, 6)
_WORD = re.compile("[a-z\x80-\U0010ffff]+")
#: Scripts that write words without spaces: their words are read as pairs of characters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff]")


def words_of(text: str | None) -> list[str]:
    """Words in lower case: runs of letters and of whatever is not ASCII."""
    found = _WORD.findall((text or "").lower())
    if not any(map(_UNSPACED.search, found)):
        return found
    return [x for w in found for x in ([w[k : k + 2] for k in range(max(1, len(w) - 1))] if _UNSPACED.search(w) else [w])]


def features(words: set[str]) -> set[str]:
    """A word is '=word', a beginning of longer words '^begin'."""
    found = {"=" + w for w in words if len(w) >= 3 or _UNSPACED.search(w)}
    for k in PREFIXES:
        found.update(["^" + w[:k] for w in words if len(w) > k])
    return found


def _counts(batches, only: set[str] | None):
    total: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            own = features(set(words_of(text)))
            total.update(own if only is None else own & only)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["feature", "n"])


def mine_lexicon(sample: DataFrame, n_pos: int, n_neg: int, size: int = 200, candidates: int = 20_000, precision: float = 0.9, gain: float = 18.0) -> list[str]:
    """The lexicon of the bounded sample: at most `size` features, those that tell most about toxic = 1.

    A feature is read if 3 documents of toxic = 1 and one in 100 of them have it; of these the `candidates` most frequent
    (a bound on what comes to the driver; the sample's own bound, max_rows of fit, bounds the work). It must be right
    in `precision` of its documents and tell `gain` (twice the log likelihood ratio) at least. Counts are added up in Spark.
    """
    count = lambda df, only: df.select("text").mapInArrow(lambda b: _counts(b, only), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    pos = {r["feature"]: r["n"] for r in count(sample.filter("toxic = 1"), None).filter("n >= 3").orderBy(F.desc("n"), "feature").limit(candidates).collect()}
    neg = {r["feature"]: r["n"] for r in count(sample.filter("toxic = 0"), set(pos)).collect()}
    return chosen(pos, neg, n_pos, n_neg, size, precision, gain)


def chosen(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int, size: int, precision: float, gain: float) -> list[str]:
    """Features by what they tell; a beginning stays out where a shorter one is in, or where its words alone carry it."""
    share = n_pos / max(1, n_pos + n_neg)
    scored = []
    for feature, p in pos.items():
        q = neg.get(feature, 0)
        if p < 0.01 * n_pos or p < precision * (p + q):
            continue
        told = 2 * (p * np.log(p / ((p + q) * share)) + (q * np.log(q / ((p + q) * (1 - share))) if q else 0))
        if told > gain:
            scored.append((-told, len(feature), feature))
    kept: list[str] = []
    for _, _, feature in sorted(scored):
        begins = {"^" + feature[1:][:k] for k in PREFIXES if k < len(feature) - 1}
        if begins & set(kept):
            continue
        # a beginning must stand without the words that are entries themselves
        own = pos[feature] - max((pos[x] for x in kept if x[0] == "=" and feature[0] == "^" and x[1:].startswith(feature[1:])), default=0)
        if own >= precision * (own + neg.get(feature, 0)):
            kept.append(feature)
        if len(kept) == size:
            break
    return kept


@dataclass
class Lexicon:
    entries: list[str]

    def __post_init__(self):
        self.words = {x[1:]: k for k, x in enumerate(self.entries) if x[0] == "="}
        self.begins = {x[1:]: k for k, x in enumerate(self.entries) if x[0] == "^"}
        self.lengths = sorted({len(x) for x in self.begins})

    def hits(self, text: str | None) -> tuple[list[int], int]:
        """Which entries a text has; how many words."""
        words = words_of(text)
        own = set(words)
        found = {self.words[w] for w in own & self.words.keys()}
        for k in self.lengths:
            found.update(self.begins[b] for b in {w[:k] for w in own if len(w) > k} & self.begins.keys())
        return sorted(found), len(words)


def _hits(entries: list[str]):
    def run(batches):
        lexicon = Lexicon(entries)
        for batch in batches:
            found = [lexicon.hits(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([h for h, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "hits", "n_words"])

    return run


def votes(presence: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """1 (toxic), -1 (not) or 0 (no vote) of each entry and pattern for each document."""
    n = presence.sum(axis=1)
    patterns = np.stack([np.where(n >= 2, 1, 0), np.where(n >= 3, 1, 0), np.where(100 * n >= np.maximum(1, n_words), 1, 0), np.where(n == 0, -1, 0), np.where((n == 0) & (n_words >= 100), -1, 0)], axis=1)
    return np.concatenate([presence, patterns], axis=1).astype(np.int8)


def label_model(v: np.ndarray, share: float, rounds: int = 30) -> np.ndarray:
    """The posterior of label 1 for each row of votes.

    A voter's accuracies are how often it casts each vote on rows of either label, estimated in turn with the posteriors;
    they begin from one of 0.9 for rows that any voter calls toxic, and a vote is never counted against the label that
    it names. An abstention says nothing: the voters that vote for rows without any entry speak for it. Votes of one
    row that correlate beyond the label share their weight.
    """
    post = np.where((v == 1).any(axis=1), 0.9, np.where((v == -1).any(axis=1), 0.05, share))
    for k in range(rounds):
        if k % 10 == 0:
            alike = correlations(v, post)
            weight = [np.where(v == y, 1 / (1 + (v == y) @ alike), 0.0) for y in (1, -1)]
        odds = np.full(len(v), np.log(share / (1 - share)))
        for y, own in zip((1, -1), weight):
            toxic = (post @ (v == y) + 0.5) / (post.sum() + 1)
            other = ((1 - post) @ (v == y) + 0.5) / ((1 - post).sum() + 1)
            odds += own @ (y * np.maximum(0.0, y * np.log(toxic / other)))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post


def correlations(v: np.ndarray, post: np.ndarray) -> np.ndarray:
    """How far each two voters go together beyond what the label explains; 0 for a voter with itself."""
    x = v.astype(np.float64)
    cov = np.zeros((x.shape[1], x.shape[1]))
    for w in (post, 1 - post):
        z = x - (w @ x) / max(w.sum(), 1e-9)
        cov += (z * w[:, None]).T @ z
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = np.clip(cov / np.outer(sd, sd), 0, 1)
    np.fill_diagonal(corr, 0)
    return np.where(corr > 0.1, corr, 0)


def design(presence: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    n = presence.sum(axis=1)
    return np.concatenate([presence, np.stack([np.ones(len(n)), n > 0, np.log1p(n), np.minimum(5.0, 100 * n / np.maximum(1, n_words))], axis=1)], axis=1).astype(np.float64)


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels, by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass
class Model:
    entries: list[str]
    beta: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, folds: int = 5) -> Model | None:
    """Fits on at most max_rows labelled rows whose crc32(doc_id as text) mod `folds` is not 0, those whose hash of
    doc_id is smallest; of sampled rows of one label that share the least hash of their words of 8 or more letters
    (near copies mostly do) one is read. A doc_id with several labels counts as toxic if one says so; null doc_ids and
    labels are left out. None where the sample holds no toxic row or no other. Where no feature is right in 0.9 of
    its documents, 0.7 and then 0.5 will do; where none is either, every text has the sample's share of toxic rows."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(fold(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    known = F.broadcast(known)  # max_rows numbers at most
    # near copies mostly share the least hash of their long words: one of them speaks for all
    rows = texts(docs).join(known, "doc_id").withColumn("least", F.array_min(F.transform(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.length(w) >= 8), lambda w: F.xxhash64(w))))
    rows = rows.withColumn("least", F.coalesce("least", F.xxhash64("text")))
    first = Window.partitionBy("least", "toxic").orderBy("doc_id", "text")
    sample = staged(rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("doc_id", "text", "toxic"), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return None
    entries: list[str] = []
    for precision in (0.9, 0.7, 0.5):
        entries = entries or mine_lexicon(sample, n_pos, n_neg, precision=precision)
    if not entries:
        return Model([], np.array([np.log(n_pos / n_neg), 0, 0, 0]))
    rows = sample.select("doc_id", "text").mapInArrow(_hits(entries), "doc_id long, hits array<int>, n_words long").orderBy("doc_id").collect()
    presence = np.zeros((len(rows), len(entries)))
    for k, r in enumerate(rows):
        presence[k, r["hits"]] = 1
    n_words = np.array([r["n_words"] for r in rows])
    post = label_model(votes(presence, n_words), n_pos / (n_pos + n_neg))
    return Model(entries, fit_linear(design(presence, n_words), post))


def _scores(model: Model, lexicon: Lexicon, own: list[str | None]) -> np.ndarray:
    found = [lexicon.hits(t) for t in own]
    presence = np.zeros((len(found), len(model.entries)))
    for k, (h, _) in enumerate(found):
        presence[k, h] = 1
    odds = design(presence, np.array([n for _, n in found], np.int64)) @ model.beta
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _score(model: Model):
    def run(batches):
        lexicon = Lexicon(model.entries)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, lexicon, batch.column("text").to_pylist()))], names=["doc_id", "score"])

    return run


def _passed(model: Model, column: str):
    """Rows whose own text scores under 0.5, with all their columns."""

    def run(batches):
        lexicon = Lexicon(model.entries)
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, lexicon, batch.column(column).cast(pa.string()).to_pylist()) < 0.5))

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: toxic likelier), predicted (score >= 0.5).

    Whole texts are read; a null or empty text has no hits and so the lowest score. Without a model every score is
    0. Repeated rows give a row each, other columns are left out, an empty table gives none.
    """
    small_batches(docs.sparkSession)
    own = texts(docs)
    scored = own.mapInArrow(_score(model), "doc_id long, score double") if model else own.select("doc_id", F.lit(0.0).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects; columns as they are, whatever their names. A verdict is that of
    the row's own text: rows of one doc_id, and rows without one, stay or go each by itself, repeated rows alike. Null
    and empty texts have no hits and stay; an empty table gives no rows; without a model (no labels) every row stays."""
    model = fit(docs, labels)
    if not model:
        return docs
    small_batches(docs.sparkSession)
    column = next(c for c in docs.columns if c.lower() == "text")
    return docs.mapInArrow(_passed(model, column), docs.schema)
