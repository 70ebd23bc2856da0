"""Equal runs of a sorted order."""

import random
from collections import Counter

import pytest

from quadrille.operators import runs


@pytest.mark.parametrize("n,of", [(0, 3), (1, 3), (10, 3), (100, 7), (7, 10), (64, 64)])
def test_equal_runs(spark, n, of):
    rng = random.Random(n)
    rows = [(rng.choice([None, 1, 2, 3, 5]), k) for k in range(n)]
    found = sorted((r["place"], r["run"], r["v"], r["k"]) for r in runs.equal_runs(spark.createDataFrame(rows, "v int, k int"), ["v"], of).collect())
    assert [f[0] for f in found] == list(range(n)) and Counter(f[2:] for f in found) == Counter(rows)
    values = [-1 if f[2] is None else f[2] for f in found]
    assert values == sorted(values) and [f[1] for f in found] == sorted(f[1] for f in found)
    sizes = [Counter(f[1] for f in found).get(k, 0) for k in range(of)]
    assert max(sizes) - min(sizes) <= 1


def test_one_value_is_split(spark):
    found = runs.equal_runs(spark.range(1000).selectExpr("1 AS v", "id"), ["v"], 8).groupBy("run").count().collect()
    assert [r["count"] for r in found] == [125] * 8
