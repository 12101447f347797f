import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import heapmeans

SCHEMA = "vec_id long, embedding array<float>, cluster string, n int, block int"


def lloyd(rows, k=8, rounds=10, dim=64, scale=1024):
    """Every vector against every centroid in every round: (id, cluster, distance, inertia of the cluster, of all, digest)."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    near = lambda: [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in kept]
    for _ in range(rounds):
        own = near()
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, own, strict=True) if a == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else c[j]
    own = near()
    d = [far(v, c[a]) for (_, v), a in zip(kept, own, strict=True)]
    per = [sum(x for x, a in zip(d, own, strict=True) if a == j) for j in range(len(c))]
    return sorted(((i, a, x, per[a], sum(d), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, own, d, strict=True)), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in heapmeans.clusters(df, **options).collect()), key=repr)


def vectors(rng, n, dim, centres=5):
    base = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(centres)]
    return [[x + rng.gauss(0, 0.1) for x in rng.choice(base)] for _ in range(n)]


def test_equals_lloyd_with_odd_rows(spark):
    """Nulls, other lengths, infinities, repeated rows and ids, null ids, one vector a third of all, and small blocks."""
    rng = random.Random(1)
    v = vectors(rng, 90, 6)
    rows = list(enumerate(v)) + [(100 + i, v[3]) for i in range(50)] + [(7, v[7])] * 30 + [(7, v[8]), (None, v[9]), (None, v[9])]
    rows += [(200, None), (201, v[0][:5]), (202, [*v[0][:5], None]), (203, [*v[0][:5], float("nan")]), (204, [*v[0][:5], float("inf")]), (205, [])]
    assert run(spark, rows, k=4, dim=6, block_rows=16) == lloyd(rows, k=4, dim=6)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, -0.25])], [(1, [0.5, -0.25])] * 5, [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])]])
def test_few_rows(spark, rows):
    assert run(spark, rows, k=3, dim=2) == lloyd(rows, k=3, dim=2)


def test_ties_go_to_the_smaller_number(spark):
    """Points on a line, half way between centroids."""
    rows = [(i, [float(i % 9), 0.0]) for i in range(60)]
    assert run(spark, rows, k=5, dim=2, scale=2, block_rows=8) == lloyd(rows, k=5, dim=2, scale=2)


def test_heaps_spare_most_vectors(spark):
    """Four groups, of which the first rows are one each: after the first round hardly any vector is measured."""
    rng, log = random.Random(4), []
    base = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in base[i % 4]]) for i in range(600)]
    run(spark, rows, k=4, dim=8, order=F.format_string("%05d", F.col("vec_id")), log=log)
    assert log[0]["measured"] == 600 and len(log) > 1 and sum(x["measured"] for x in log[1:]) < 0.1 * 600 * (len(log) - 1)


def test_bounds_never_keep_a_wrong_cluster():
    """Blocks without Spark, with centroids that move at random: each assignment equals a whole scan."""
    rng = np.random.default_rng(2)
    x, weight = rng.integers(-50, 50, (300, 3)), rng.integers(1, 4, 300)
    c, heaps, offsets, sums = x[:5].copy(), None, np.zeros(5), np.zeros((5, 3), np.int64)
    spared = 0
    for _ in range(12):
        heaps, change, _, measured = heapmeans.advance(x, weight, heaps, c, offsets)
        heaps, sums, spared = heapmeans.unpacked(*heapmeans.packed(heaps)), sums + change, spared + 300 - measured
        near = np.square(x[:, None] - c[None]).sum(2).argmin(1)
        assert [sorted(r for _, r in h) for h in heaps] == [np.flatnonzero(near == j).tolist() for j in range(5)]
        assert (sums == [(x * weight[:, None])[near == j].sum(0) for j in range(5)]).all()
        moved = c + rng.integers(-3, 4, c.shape)
        drift = np.sqrt(np.square(moved - c).sum(1)) * (1 + heapmeans.SLACK)
        offsets = offsets + drift + np.array([max(np.delete(drift, a)) for a in range(5)])
        c = moved
    assert spared


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1e9, 0.0])], k=1, dim=2)
