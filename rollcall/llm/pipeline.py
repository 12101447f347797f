"""From raw documents to packed sequences: language, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder
and reads it again for the next one. All but the last return the columns of ``docs``, whatever their names: what a stage predicts
has names of its own. Null ids and repeated rows are kept but where a stage says otherwise, texts are read whole, and
empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langcrf, packing, probminhash, puquality
from .common import bounded_batches, fold, saved

OWN = ("__rollcall_label", "__rollcall_score")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts for which the language operator finds no language go: null texts, and texts without a letter. Texts in several languages stay."""
    bounded_batches(spark)
    model = langcrf.learn(docs.filter(fold(F.col("doc_id"), 3) != 1), keys=F.col("doc_id"))
    found = langcrf.predict(docs, model, carry=docs.columns, names=OWN)
    return found.filter(F.col(OWN[0]) != "und").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts predicted to be of low quality (a score below 0.7) go, the empty ones that are so among them."""
    labels = bounded_batches(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = puquality.learn(docs, labels, usable=fold(F.col("doc_id"), 4) != 2)
    found = puquality.predict(docs, model, carry=docs.columns, names=(OWN[1], OWN[0]))
    return found.filter(F.col(OWN[0]) == 1).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near-copies stays, the one with the least id; of repeated rows one. Null and empty texts all stay."""
    bounded_batches(spark)
    return probminhash.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; the columns of :func:`packing.first_fit_decreasing`. Null texts count as empty."""
    bounded_batches(spark)
    return packing.first_fit_decreasing(docs)


STAGES = [("language_id", language), ("quality_classifier", quality), ("near_dedup", near_dedup), ("packing", pack)]

#: SQL can't express the learned stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
