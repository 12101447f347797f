import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollcall.llm import puquality as pu
from rollcall.llm.queries import op7_pu_quality


@pytest.mark.parametrize("gap", [0.0, 6.0])
def test_risk_and_slopes(gap):
    rng = np.random.default_rng(2)
    fp, fu = rng.normal(size=7) + gap, rng.normal(size=9) - gap
    pos, neg, gp, gu = pu.nn_risk(fp, fu, 0.7)
    loss = lambda z: np.log(1 + np.exp(-z))
    assert np.isclose(pos, 0.7 * loss(fp).mean()) and np.isclose(neg, loss(-fu).mean() - 0.7 * loss(-fp).mean())
    assert (neg < 0) == (gap > 0)
    target = (lambda a, b: sum(pu.nn_risk(a, b, 0.7)[:2])) if neg >= 0 else (lambda a, b: -pu.nn_risk(a, b, 0.7)[1])
    for i in range(7):
        d = np.eye(7)[i] * 1e-6
        assert np.isclose(gp[i], (target(fp + d, fu) - target(fp - d, fu)) / 2e-6, atol=1e-6)
    for i in range(9):
        d = np.eye(9)[i] * 1e-6
        assert np.isclose(gu[i], (target(fp, fu + d) - target(fp, fu - d)) / 2e-6, atol=1e-6)


@pytest.mark.parametrize("prior", [0.3, 0.8])
def test_prior_and_training(prior):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(2000, 4)) + [3, 0, 0, 0]
    good = rng.random(3000) < prior
    u = rng.normal(size=(3000, 4)) + np.outer(np.where(good, 3, -3), [1, 0, 0, 0])
    m = pu.train(p[:1000], u[:1500], 0.5, steps=150)
    found = pu.estimate_prior(m.margin(p[1000:]), m.margin(u[1500:]))
    assert abs(found - prior) < 0.06
    m = pu.train(p, u, found)
    assert ((m.score(u) >= 0.5) == good).mean() > 0.98


def test_features_are_each_rows_own():
    texts = ["", "Hello world.", "a a a a", "ABC!! DEF!!\nabc | def", "é" * 50, "x" * 5000 + " y"]
    both = pu.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(pu.features(pa.array([t]))[0], both[i])
    assert both[2][3] == 0.75 and both[0][13] == 1


def test_rows(spark):
    rows = [(1, None, 5.0), (2, "", 5.0), (3, "Good plain words here. And more.", 5.0), (3, "Good plain words here. And more.", 5.0), (4, "#$% " * 5000, None), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = pu.predict(df, pu.learn(df, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[1] == by[2] and len(by[3]) == 1
    clash = pu.predict(df.withColumn("predicted", F.lit("p")), pu.learn(df, labels), carry=["score", "text", "predicted"])
    assert clash.columns == ["doc_id", "text", "score", "predicted"] and sorted(r.score for r in clash.collect()) == sorted(r.score for r in got)
    kept = pu.predict(df, pu.learn(df, labels), carry=["score"], names=("q", "p"))
    assert kept.columns == ["doc_id", "score", "q", "p"] and {r.score for r in kept.collect()} == {5.0, None}
    assert pu.predict(df.limit(0), pu.learn(df.limit(0), labels.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op7_pu_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r.score, r.predicted, quality[r.doc_id]) for r in got if r.held_out and r.doc_id in quality]
    assert len(held) > 500 and np.mean([p == q for _, p, q in held]) > 0.95
