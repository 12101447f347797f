import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollcall.llm import langcrf
from rollcall.llm.queries import op6_crf_language

EN = "the house is on the hill and the dog was in that garden with this other thing"
DE = "das haus ist auf dem berg und der hund war in jenem garten mit dieser anderen sache"


def brute(emit, trans, starts):
    """Marginals and expected transitions, by listing all labellings."""
    n, k = emit.shape
    p, pairs = np.zeros((n, k)), np.zeros((k, k))
    bounds = [*starts, n]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        total = 0.0
        q, r = np.zeros((b - a, k)), np.zeros((k, k))
        for y in itertools.product(range(k), repeat=b - a):
            w = math.exp(sum(emit[a + i, v] for i, v in enumerate(y)) + sum(trans[u, v] for u, v in itertools.pairwise(y)))
            total += w
            for i, v in enumerate(y):
                q[i, v] += w
            for u, v in itertools.pairwise(y):
                r[u, v] += w
        p[a:b], pairs = q / total, pairs + r / total
    return p, pairs


def test_forward_backward():
    rng = np.random.default_rng(1)
    emit, trans = rng.normal(size=(21, 3)) * 3, rng.normal(size=(3, 3))
    starts = np.array([0, 1, 8, 16])
    p, pairs = langcrf.marginals(emit, starts, trans, pairs=True)
    q, r = brute(emit, trans, starts)
    assert np.allclose(p, q) and np.allclose(pairs, r)
    long = np.tile(emit, (400, 1))
    at = (np.arange(400)[:, None] * 21 + starts).ravel()
    p, pairs = langcrf.marginals(long, at, trans, pairs=True)
    assert np.allclose(p, np.tile(q, (400, 1))) and np.allclose(pairs, 400 * r)


def test_words():
    at, words, off = langcrf.words_of(pa.array(["Ärger, 12x HE-he", "", "x" * 100, "语" * 40, "he"]))
    got = [[words[i] for i in at[a:b]] for a, b in zip(off[:-1], off[1:], strict=True)]
    assert got[0] == ["ärger", "x", "he", "he"] and got[1] == [] and got[4] == ["he"]
    assert "".join(got[2]) == "x" * 100 and "".join(got[3]) == "语" * 40


def test_features_do_not_depend_on_others():
    words = ["a", "abc", "haus", "größe"]
    own, bucket = langcrf.features_of(words)
    for i, w in enumerate(words):
        o, b = langcrf.features_of([w])
        assert sorted(b.tolist()) == sorted(bucket[own == i].tolist()) and not o.any()


@pytest.fixture(scope="module")
def model():
    return langcrf.train([EN * 3, DE * 3], ["en", "de"])


def test_code_switching(model):
    lab = langcrf.Labeller(model)
    share, p, words, at = lab.shares(pa.array(["the house is on das haus ist auf dem berg"]))
    found = [(words[i], model.langs[j]) for i, j in zip(at, p.argmax(1), strict=True)]
    assert [x for _, x in found] == ["en"] * 4 + ["de"] * 6


def test_rows(spark, model):
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 .. ", "a"), (4, EN, "a"), (4, EN, "a"), (5, DE * 500, "a"), (None, DE, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(langcrf.predict(df, model).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r.lang_pred) for r in got] == [(None, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")]
    assert all(0 <= r.score <= 1 for r in got) and got[1].score == 0
    clash = langcrf.predict(df.withColumn("lang_pred", F.lit(1)), model, carry=["score", "text", "lang_pred"])
    assert clash.columns == ["doc_id", "text", "lang_pred", "score"] and {r.lang_pred for r in clash.collect()} == {"en", "de", "und"}
    kept = langcrf.predict(df, model, carry=["score"], names=("l", "s"))
    assert kept.columns == ["doc_id", "score", "l", "s"] and {r.score for r in kept.collect()} == {"a", None}
    assert langcrf.predict(df.limit(0), model).count() == 0


def test_many_languages_ties_and_order():
    """Over 63 languages; a text without any hint has the first by name; halves weigh the same at either end of a text."""
    names = [f"l{i:02d}" for i in range(70)]
    texts = [" ".join(f"{chr(0x400 + i)}{chr(0x420 + i)}wort{i}x{j % 5}" for j in range(40)) for i in range(70)]
    model = langcrf.train(texts, names, steps=12)
    share, *_ = langcrf.Labeller(model).shares(pa.array(texts))
    assert [model.langs[i] for i in share.argmax(1)] == names
    two = langcrf.train([EN * 3, DE * 3], ["en", "de"])
    share, *_ = langcrf.Labeller(two).shares(pa.array([EN + " " + DE, DE + " " + EN]))
    assert abs(share[0] - share[1]).max() < 0.05
    flat = langcrf.Model(["a", "b"], np.zeros((1 << langcrf.BITS, 2)), {}, np.zeros((0, 2), bool), np.zeros((2, 2)), np.zeros(2), np.zeros((2, 2)))
    share, *_ = langcrf.Labeller(flat).shares(pa.array(["same words"]))
    assert share[0, 0] == share[0, 1] and share.argmax(1)[0] == 0


def test_long_runs_of_letters(model):
    share, _, words, at = langcrf.Labeller(model).shares(pa.array(["x" * 300_000 + " " + DE, "语言" * 5000]))
    assert len(words[at[0]]) == 300_000 and share.shape == (2, 2)


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    assert langcrf.predict(df, langcrf.learn(df)).collect()[0].lang_pred == "und"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_crf_language(spark, sf).collect()
    assert len(got) == len(lang)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert len(held) > 200 and np.mean(held) > 0.97
