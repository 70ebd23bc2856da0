"""Circulant MinHash: links against all pairs, signatures against what they estimate."""

import numpy as np
import pytest

from quadrille.llm import minhash
from tests.llm import plain
from tests.llm.test_operators import docs, odd, pairs, same, small  # noqa: F401

COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def test_groups(docs):  # noqa: F811
    same(minhash.near_groups(docs), COLUMNS, plain.op13(pairs(docs)))


def families(seed, n=25):
    """Texts with a few words changed, at and about the bound, chained and with repeated lines."""
    rng = np.random.default_rng(seed)
    out = []
    for f in range(n):
        words = [f"w{x}" for x in rng.integers(0, 900, rng.integers(1, 120))]
        for _ in range(rng.integers(1, 7)):
            words = [f"W{rng.integers(900)}" if rng.random() < rng.choice([0.0, 0.01, 0.03]) else w for w in words]
            out.append((int(rng.integers(0, 10_000)), " ".join(words) + " the same line again" * int(rng.integers(0, 3))))
    return out


@pytest.mark.parametrize("block_shingles", [1_000_000, 150])
def test_groups_of_changed_texts(spark, block_shingles):
    rows = families(5)
    found = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), block_shingles=block_shingles)
    same(found, COLUMNS, plain.op13(rows))


def test_other_shingles_and_bounds(spark):
    rows = families(6)
    found = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=5, similarity=(4, 5), bands=64)
    same(found, COLUMNS, plain.op13(rows, 5, 4, 5))


def test_signatures_estimate_similarity():
    """Coordinates agree as often as sets are similar, and bands as often as independent coordinates would."""
    rng = np.random.default_rng(7)
    for n in (7, 40, 600):
        agree, bands = [], []
        for _ in range(150):
            whole = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            a, b = whole[: n * 12 // 13], whole[n // 13 :]
            agree.append((minhash.signature(a, 288) == minhash.signature(b, 288)).mean())
            bands.append((minhash.cells_of(a, 48) == minhash.cells_of(b, 48)).mean())
        s = len(np.intersect1d(a, b)) / len(whole)
        assert abs(np.mean(agree) - s) < 0.01 and abs(np.mean(bands) - s**6) < 0.03
        assert np.std(agree) <= 1.3 * (s * (1 - s) / 288) ** 0.5
        assert min(bands) > 0


def test_chance_of_a_miss():
    assert minhash.missed(0.85, 48) < 2e-10 and minhash.missed(0.8, 40, 5) < 1.4e-7 and minhash.missed(0.9, 40, 5) < 1e-15
