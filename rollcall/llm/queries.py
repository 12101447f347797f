"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, flac, hardneg, heapmeans, langcrf, mih, mincut, packing, pipeline, probminhash, puquality, quotes, warczip
from .common import bounded_batches, fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digest(flac.to_flac(_table(spark, sf_dir, "documents")))


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(quotes.quoted(_table(spark, sf_dir, "conversations")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_decreasing(_table(spark, sf_dir, "documents"))


def op4_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(_table(spark, sf_dir, "documents")))


def op5_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.first_fit_decreasing(_table(spark, sf_dir, "documents"))


def op6_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    model = langcrf.learn(docs.filter(~held), keys=F.col("doc_id"))
    return langcrf.predict(docs.withColumn("held_out", held), model, carry=["held_out"])


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    model = puquality.learn(docs, _table(spark, sf_dir, "labels"), usable=~held)
    return puquality.predict(docs.withColumn("held_out", held), model, carry=["held_out"])


def op8_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return mincut.extract(pages, mincut.learn(pages, keys=F.col("page_id")), carry=["page_id", "url"])


def op9_mih_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_probminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op11_heap_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heapmeans.clusters(_table(spark, sf_dir, "embeddings"))


def op12_multi_index_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warczip.write_archives(warczip.records(_table(spark, sf_dir, "pages")))
    return warczip.pages(warczip.read_records(archives))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_flac_media": op1_flac_media,
    "op2_quote_links": op2_quote_links,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_tree_bpe": op4_tree_bpe,
    "op5_first_fit_packing": op5_first_fit_packing,
    "op6_crf_language": op6_crf_language,
    "op7_pu_quality": op7_pu_quality,
    "op8_mincut_html": op8_mincut_html,
    "op9_mih_neighbours": op9_mih_neighbours,
    "op10_probminhash_near_dedup": op10_probminhash_near_dedup,
    "op11_heap_centroids": op11_heap_centroids,
    "op12_multi_index_negatives": op12_multi_index_negatives,
    "op13_warc_zip": op13_warc_zip,
    "pipeline": pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op2_quote_links": quotes.SQL, "op11_heap_centroids": heapmeans.sql(), "op12_multi_index_negatives": hardneg.SQL, "op13_warc_zip": warczip.SQL}
