from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from rollcall.llm import mih
from rollcall.llm.queries import op9_mih_neighbours


def hamming(a, b):
    return int(np.unpackbits(a ^ b).sum())


@pytest.mark.parametrize("substrings", [1, 4, 8, 16])
@pytest.mark.parametrize("radius", [0, 40, 77, 101, 120])
def test_every_code_within_the_radius_is_found_once(substrings, radius):
    """Over all cells that a query probes, each pair within the radius is met at exactly one substring."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24))
    coder = replace(mih.learn(x[:200]), radius=radius, substrings=substrings, prefix=3 if substrings > 1 else 0)
    codes, ids = coder.codes(x), np.arange(300)
    cells = coder.cells(coder.parts(codes))
    q = np.arange(0, 300, 50)
    found = []
    for j, most in enumerate(coder.allowed()):
        for cell in range(2**coder.prefix) if most >= 0 else ():
            rows = np.flatnonzero(cells[:, j] == cell)
            asks = q[np.isin(cells[q, j] ^ cell, mih.masks(coder.prefix, most))]
            if len(rows) and len(asks):
                a, b, _ = mih.search(coder, j, ids[rows], x[rows], codes[rows], ids[asks], x[asks], codes[asks], 1000)
                found += zip(a.tolist(), b.tolist(), strict=True)
    want = [(i, j) for i in q.tolist() for j in range(300) if i != j and hamming(codes[i], codes[j]) <= radius]
    assert sorted(found) == want


def test_short_substrings_where_neighbours_are_close():
    """Tight clusters: the plan probes few cells. Isotropic vectors, for which all cells would be probed: codes stay whole."""
    coder = mih.learn(np.random.default_rng(2).normal(size=(500, 64)))
    close, far = mih.planned(coder, 20, 10**8, 10**6, 4096), mih.planned(coder, 101, 50_000, 1000, 4096)
    assert close.substrings >= 8 and far.substrings == 1
    assert sum(len(mih.masks(close.prefix, a)) for a in close.allowed()) < 0.05 * close.substrings * 2**close.prefix


def test_rotation_beats_plain_signs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16)) * np.linspace(3, 0.1, 16)
    coder = mih.learn(x, bits=8)
    unit = x / mih.norms(x)[:, None] - coder.mean
    loss = lambda m: (np.square(np.sign(unit @ m) - unit @ m * np.sqrt(8)).sum(1)).mean()
    _, vec = np.linalg.eigh(np.cov(unit, rowvar=False))
    assert np.allclose(coder.rotation.T @ coder.rotation, np.eye(8)) and loss(coder.rotation) <= loss(vec[:, ::-1][:, :8])


def brute(rows, is_query, k=5):
    use = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v):
            use[i] = min(use.get(i, v), v)
    ids = np.array(sorted(use))
    x = np.array([use[i] for i in ids], np.float64)
    x /= mih.norms(x)[:, None]
    out = {}
    for n, i in enumerate(ids):
        if is_query(i):
            s = (x * x[n]).sum(1)
            s[n] = -np.inf
            order = np.lexsort((ids, -s))[:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order if np.isfinite(s[j])]
    return out


def recall(got, want):
    hits = total = 0
    for q, best in want.items():
        least = best[-1][1] if best else 0
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine) and q not in [m[1] for m in mine]
        hits += sum(m[2] >= least - 1e-12 for m in mine)
        total += len(best)
    return hits / max(total, 1)


def test_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(400 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(60)]  # ties
    rows += [(500, None), (550, [0.0] * 6), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (650, [float("nan")] + [1.0] * 5), (700, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (50, rows[50][1]), (750, [1e-200] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], "vec_id long, embedding array<double>, score int, id int, v int, code int, dim int").repartition(5)
    want = brute(rows, lambda i: i % 50 == 0)
    for few in (1024, 100):  # without an index, and with one in small cells
        got = mih.nearest(df, df["vec_id"] % 50 == 0, rows_per_cell=64, queries_per_cell=3, few=few).collect()
        assert {r.query_id for r in got} == set(want)
        assert recall(got, want) >= 0.95
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 400] == [401, 402, 403, 404, 405]
    few = df.filter("vec_id in (50, 51, 52)")
    assert sorted((r.query_id, r.rank) for r in mih.nearest(few, few["vec_id"] % 50 == 0).collect()) == [(50, 1), (50, 2)]
    assert mih.nearest(df.limit(0), df["vec_id"] % 50 == 0).count() == 0


def test_lengths_hot_vectors_and_lonely_queries(spark):
    """Vectors of each length are searched among their own; copies of one vector fill a cell; queries far from all rows get theirs."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(1500)]
    rows += [(2000 + i, [1.0] * 64) for i in range(700)]
    rows += [(3000 + i, rng.normal(size=3).tolist()) for i in range(60)] + [(4000, [1.0] * 2000), (4001, [1.0] * 1999 + [2.0]), (4050, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    want = {}
    for size in {len(v) for _, v in rows}:
        want |= brute([r for r in rows if len(r[1]) == size], lambda i: i % 50 == 0)
    got = mih.nearest(df, df["vec_id"] % 50 == 0, rows_per_cell=128, queries_per_cell=8).collect()
    want = {q: best for q, best in want.items() if best}
    assert {r.query_id for r in got} == set(want) and recall(got, want) >= 0.95
    # A radius that finds too little is made up for by comparing with all rows.
    exact = mih.nearest(df, df["vec_id"] % 50 == 0, reach=0.0, rows_per_cell=128).collect()
    assert {(r.query_id, r.rank) for r in exact} == {(r.query_id, r.rank) for r in got}


def test_clustered_vectors_probe_few_cells(spark, monkeypatch):
    """The index at work: neighbours that are close are found in under 5 % of the cells."""
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(1200, 1, 64)) + 0.1 * rng.normal(size=(1200, 50, 64))).reshape(-1, 64)
    x = x[rng.permutation(len(x))]
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 64), pa.int32()), pa.array(x.ravel()))
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": flat}))
    plans, plan = [], mih.planned
    monkeypatch.setattr(mih, "planned", lambda *a: plans.append(plan(*a)) or plans[-1])
    got = mih.nearest(df, df["vec_id"] % 50 == 0, rows_per_cell=64).collect()
    coder = plans[0]
    probed = sum(len(mih.masks(coder.prefix, a)) for a in coder.allowed() if a >= 0) / (coder.substrings * 2**coder.prefix)
    print("radius", coder.radius, "substrings", coder.substrings, "prefix", coder.prefix, "cells probed", probed)
    unit = x / mih.norms(x)[:, None]
    near = np.argsort(-(unit[::50] @ unit.T), axis=1)[:, :6]
    want = {(50 * q, int(i)) for q, row in enumerate(near) for i in [i for i in row if i != 50 * q][:5]}
    found = len(want & {(r.query_id, r.vec_id) for r in got}) / len(want)
    assert coder.substrings > 1 and probed < 0.05 and len(got) == len(want) and found >= 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got = op9_mih_neighbours(spark, f"/root/testdata/{sf}").collect()
    want = brute(rows, lambda i: i % 50 == 0)
    found = recall(got, want)
    print(sf, "recall", found)
    assert {r.query_id for r in got} == set(want) and found >= 0.95
    exact = {(q, i): s for q, best in want.items() for i, s in best}
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got if (r.query_id, r.vec_id) in exact)


def test_few_rows_are_reranked(spark):
    """At sf0.1 less than 5 % of the rows lie within the measured radius of a query."""
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    coder = mih.learn(x)
    codes = coder.codes(x)
    unit = x / mih.norms(x)[:, None]
    far, q = [], np.flatnonzero(ids % 50 == 0)
    for i in range(0, len(x), 10):
        s = unit @ unit[i]
        s[i] = -2
        far += [hamming(codes[i], codes[j]) for j in np.argsort(-s)[:5]]
    radius = int(np.quantile(far, 0.97, method="higher"))
    near = np.array([[hamming(codes[i], c) <= radius for c in codes] for i in q])
    print("share within the radius", near.mean())
    assert near.mean() < 0.05
