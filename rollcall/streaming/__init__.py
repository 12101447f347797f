"""Transcripts that arrive as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chat import messages


def stream_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of transcripts as their files arrive; parsing is narrow, so that no state is kept."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    return messages(files.select(F.col("_metadata.file_path").alias("chat_id"), F.lit(None).cast("string").alias("roster_id"), F.col("value").alias("text")))
