"""The stages on small tables, each held against its own input."""

import sys
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from rollcall.llm import langcrf, puquality
from rollcall.llm.common import fold, saved

sys.path.insert(0, __file__.rpartition("/")[0])
from test_packing import check_ffd  # noqa: E402
from test_probminhash import brute  # noqa: E402


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**9, None, "en", "s", 0), (10**9 + 1, " 12 !! ", None, "s", 7)], docs.schema)
    docs = saved(docs.unionByName(extra))
    (_, language), (_, quality), (_, dedup), (_, pack) = corpus_pipeline.STAGES
    kept = saved(language(spark, docs, sf))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {10**9, 10**9 + 1} and len(ids) > 0.97 * docs.count()
    model = langcrf.learn(docs.filter(fold(F.col("doc_id"), 3) != 1), keys=F.col("doc_id"))
    assert ids == {r.doc_id for r in langcrf.predict(docs, model).collect() if r.lang_pred != "und"}

    good = saved(quality(spark, kept, sf))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.doc_id) for r in kept.filter(fold(F.col("doc_id"), 4) == 2).collect() if r.doc_id in labels]
    stay = {r.doc_id for r in good.collect()}
    assert sum((q == 1) == (i in stay) for q, i in held) >= 0.95 * len(held)
    pu = puquality.learn(kept, spark.read.parquet(f"{sf}/labels.parquet"), usable=fold(F.col("doc_id"), 4) != 2)
    assert stay == {r.doc_id for r in puquality.predict(kept, pu).collect() if r.predicted == 1}

    rows = [(r.doc_id, r.text) for r in good.collect()]
    once = saved(dedup(spark, good, sf))
    assert sorted(r.doc_id for r in once.collect()) == sorted(min(rows[i][0] for i in g) for g in brute(rows))
    check_ffd(pack(spark, once, sf).collect(), [(r.doc_id, r.text) for r in once.collect()])


def test_columns_with_clashing_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"score": F.lit("s"), "lang_pred": F.lit(1), "predicted": F.lit(2), "held_out": F.lit(3), "node": F.lit(4), "id": F.lit(5), "th": F.lit(6)})
    docs = saved(docs)
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = saved(stage(spark, docs, sf_dir))
        assert kept.columns == docs.columns and {(r.score, r.lang_pred, r.predicted, r.th) for r in kept.collect()} == {("s", 1, 2, 6)}
        docs = kept
    assert corpus_pipeline.STAGES[3][1](spark, docs, sf_dir).count() > 0


def test_mixed_languages_stay(spark, sf_dir):
    """A document whose sentences alternate between languages has none with half of its letters, and stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = [next(r.text for r in docs.filter(f"lang = '{lang}' and length(text) > 300").collect()) for lang in ("de", "en", "es", "fr")]
    mixed = " ".join(p[i * 60 : i * 60 + 60] for i in range(5) for p in parts)
    more = spark.createDataFrame([(10**9, mixed, None, "s", len(mixed))], docs.schema)
    assert corpus_pipeline.STAGES[0][1](spark, docs.unionByName(more), sf_dir).filter(f"doc_id = {10**9}").count() == 1


def test_run_and_empty(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    seqs = defaultdict(int)
    for r in got.collect():
        seqs[r.sequence_id] += r.length
    assert seqs and all(n <= 1024 and n & (n - 1) == 0 for n in seqs.values())
    assert max(Counter((r.doc_id, r.start) for r in got.collect()).values()) == 1
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf_dir))
        assert docs.count() == 0
