"""Greedy clusters against a plain scan."""

import math
import random
from collections import Counter

import pytest

from quadrille.operators import cluster

KIND = "nth long, x double, y double, type string, severity string"
RANK = {"CRIT": 4, "MAJOR": 3, "MINOR": 2, "INFO": 1}


def scan(rows, reach):
    taken, out = set(), {}
    for a in rows:
        if a[0] in taken:
            continue
        own = [a] + [b for b in rows if b[0] not in taken and b[0] != a[0] and math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) <= reach]
        taken |= {b[0] for b in own}
        kinds = Counter(b[3] for b in own)  # in the order of coming
        top = max(own, key=lambda b: (RANK.get(b[4], 0), -b[0]))
        out[a[0]] = (len(own), round(sum(b[1] for b in own) / len(own), 6), round(sum(b[2] for b in own) / len(own), 6), kinds.most_common(1)[0][0], top[4])
    return out


def made(seed, n=300):
    rng = random.Random(seed)
    spots = [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(n)]
    spots += [(7.0, 7.0)] * 60 + [(float(x), float(y)) for x in range(-20, 21, 10) for y in range(-20, 21, 10)] + [(200 + 9.9 * k, 0.0) for k in range(12)]
    rng.shuffle(spots)
    return [(k, x, y, rng.choice("abc"), rng.choice(["CRIT", "MAJOR", "MINOR", "INFO", None, "other"])) for k, (x, y) in enumerate(spots)]


@pytest.mark.parametrize("seed", [1, 2])
def test_as_the_scan(spark, seed):
    rows = made(seed)
    found = {r["cluster"]: (r["size"], round(r["x"], 6), round(r["y"], 6), r["type"], r["severity"]) for r in cluster.cluster_greedy(spark.createDataFrame(rows, KIND), 10.0).collect()}
    assert found == scan(rows, 10.0) and len(found) > 20


def test_odd_rows(spark):
    none = [(None, 1.0, 1.0, "a", "INFO"), (1, None, 2.0, "a", "INFO")]
    assert cluster.cluster_greedy(spark.createDataFrame(none, KIND), 5).count() == 0
    same = [(1, 1.0, 1.0, "a", "INFO")] * 3 + [(2, 1.0, 1.0, "b", "CRIT")]
    assert [tuple(r) for r in cluster.cluster_greedy(spark.createDataFrame(same, KIND), 5).collect()] == [(1, 4, 1.0, 1.0, "a", "CRIT")]
    with pytest.raises(ValueError):
        cluster.cluster_greedy(spark.createDataFrame([(1, 0.0, 0.0, "a", None), (1, 9.0, 9.0, "a", None)], KIND), 5)
