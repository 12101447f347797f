"""Transcripts from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .screen import CHAT_FILES, gate_files


def read_chats(spark: SparkSession, path: str, roster: Column | str | None = None, endings: tuple[str, ...] = CHAT_FILES, max_size: int | None = None) -> DataFrame:
    """(chat_id, roster_id, text): one transcript a file, named by its path. ``roster`` says which roster a chat belongs to (default: none)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
    files = gate_files(files, endings, max_size)
    name = F.lit(None).cast("string") if roster is None else F.lit(roster) if isinstance(roster, str) else roster
    return files.select(F.col("path").alias("chat_id"), name.alias("roster_id"), "text")


def read_chat_lines(spark: SparkSession, path: str, roster: Column | str | None = None, endings: tuple[str, ...] = CHAT_FILES, max_size: int | None = None) -> DataFrame:
    """(chat_id, roster_id, line_no, line): transcripts as lines, without their ``\\n``, so that many tasks read a file of any size.

    ``line_no`` orders a file's lines: where the task's share of the file begins, and the place therein. Blank lines are rows, empty files have none.
    """
    files = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("offset"), F.col("value").alias("line"))
    files = gate_files(files, endings, max_size)
    name = F.lit(None).cast("string") if roster is None else F.lit(roster) if isinstance(roster, str) else roster
    return files.select(F.col("path").alias("chat_id"), name.alias("roster_id"), F.struct("offset", F.monotonically_increasing_id().alias("nth")).alias("line_no"), "line")
