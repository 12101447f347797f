import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, unit int, v string"


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90, scale=256):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or not all(x is not None and math.isfinite(x) for x in v):
            continue
        r = (label, [math.floor(scale * x) for x in v])
        kept[i] = min(kept[i], r) if i in kept else r
    out = []
    for a, (label, v) in kept.items():
        if a not in anchors:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for i, (other, w) in kept.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            near = [x for x in scored if not x[2] and -low * s <= -100 * x[0] <= -high * s]
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(near[:negatives], 1)]
    return sorted(out)


def run(spark, rows, anchors, **options):
    df = spark.createDataFrame([(i, v, label, 1, 2, "x") for i, v, label in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id").isin(list(anchors)), **options).collect())


def around(rng, centres, n, spread=0.15):
    return [[x + rng.gauss(0, spread) for x in rng.choice(centres)] for _ in range(n)]


def test_equals_brute_force_with_odd_rows(spark):
    """Two lengths, nulls, infinities, repeated ids, one vector a third of all (ties), a hot label, small pages and blocks."""
    rng = random.Random(2)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(6)]
    v = around(rng, centres, 200)
    rows = [(i, x, 1 if i % 3 == 0 else i % 5) for i, x in enumerate(v)] + [(300 + i, v[4], i % 4) for i in range(100)] + [(500 + i, x[:3], i % 2) for i, x in enumerate(v[:40])]
    rows += [(5, v[6], 0), (5, v[6], 0), (600, None, 1), (601, [], 1), (602, [*v[0][:5], None], 1), (603, [*v[0][:5], float("nan")], 1), (604, v[0], None), (None, v[0], 1), (605, [0.0] * 6, 1)]
    anchors = {i for i, _, _ in rows if i is not None and i % 10 == 0} | {605, 300}
    want = brute(rows, anchors)
    assert run(spark, rows, anchors, per_cell=8, sample=100, block=16, page_rows=64) == want and len(want) > 300


@pytest.mark.parametrize("rows", [[], [(0, None, 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.5], 2), (4, [2.0], 2)], [(0, [-1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 2)]])
def test_few_rows(spark, rows):
    assert run(spark, rows, {0}) == brute(rows, {0})


def test_large_components(spark):
    """Products beyond 2^53 are exact; components beyond the limit are an error."""
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-60000, 60000) for _ in range(40)], i % 3) for i in range(60)]
    assert run(spark, rows, {0, 10, 20}, per_cell=8) == brute(rows, {0, 10, 20})
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(0, [1e6], 1), (1, [1.0], 1)], {0})


def page_of(rng, n, dim, spread, per=20):
    """A page in which each pair of half centroids has its segments, rows lying close to them."""
    books = tuple(rng.normal(size=(8, dim // 2)) * 200 for _ in range(2))
    rows = []
    for a in range(8):
        for b in range(8):
            x = np.round(np.concatenate([np.tile(books[0][a], (per, 1)), np.tile(books[1][b], (per, 1))], 1) + rng.normal(size=(per, dim)) * spread).astype(np.int64)
            far = [float(np.sqrt(np.square(h - c).sum(1)).max()) + 1e-6 for h, c in ((x[:, : dim // 2], books[0][a]), (x[:, dim // 2 :], books[1][b]))]
            first = (a * 8 + b) * per
            rows.append({"a": a, "b": b, "ids": list(range(first, first + per)), "labels": [i % 4 for i in range(per)], "v": x.astype(np.int32).tobytes(), "ra": far[0], "rb": far[1]})
    return hardneg.Page(books, rows)


def test_the_heap_stops_early_and_loses_nothing():
    rng = np.random.default_rng(5)
    page = page_of(rng, 64, 16, 2.0)
    v, ids, labels = np.concatenate(page.v), np.concatenate(page.ids), np.concatenate(page.labels)
    q = v[::100]
    n = len(q)
    least, largest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    asked, log = hardneg.Asked(ids[::100], labels[::100], q, np.arange(n), np.full(n, least), np.full(n, largest), True, 5), []
    hardneg.search(page, asked, step=40, log=log)
    for u in range(n):
        s = v @ q[u]
        want = sorted((-int(s[i]), int(ids[i])) for i in range(len(v)) if labels[i] == asked.labels[u] and ids[i] != asked.ids[u])[:5]
        assert [(-int(a), int(b)) for a, b in zip(asked.score[asked.unit == u], asked.row[asked.unit == u], strict=True)] == want
    assert sum(log) < 0.2 * n * len(v)


def test_pairs_come_by_their_sum():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 9, 7).astype(float), rng.integers(0, 9, 5).astype(float)
    got = list(hardneg.sequence(a, b))
    assert [s for s, _, _ in got] == sorted((x + y for x in a for y in b), reverse=True) and len({(i, j) for _, i, j in got}) == 35
    assert all(s == a[i] + b[j] for s, i, j in got) and not list(hardneg.sequence(a[:0], b))
