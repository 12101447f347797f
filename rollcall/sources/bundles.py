"""Many small text files in few: each line is one of a named file, behind the file's name. A folder holds as many files as tasks wrote, however many names there are.

A name's lines stand in order; of a large file they may lie in several of the folder's files, in the order of these. A line is ``name TAB line``, with the name as in URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .screen import CHAT_FILES, gate_files

# Fixed value: what parts a name from its line.
TAB = "\t"


def _write(rows: DataFrame, path: str) -> None:
    """Rows (name, text) where they are and in their order, a text as its lines."""
    name = F.url_encode(F.coalesce(F.col("name").cast("string"), F.lit("")))
    lines = rows.select(name.alias("name"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    lines.select(F.concat("name", F.lit(TAB), "line").alias("value")).write.text(path)


def write_texts(texts: DataFrame, path: str) -> None:
    """Texts (name, text), each as a file that ends in a line end. Nothing is shuffled."""
    _write(texts.select("name", "text"), path)


def write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """Rows (name, text, order columns) as files: the texts of a name below each other in this order, dealt by ranges, so that a file may hold any share of the rows."""
    _write(rows.repartitionByRange("name", *order).sortWithinPartitions("name", *order).select("name", "text"), path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, line_no, line): ``line_no`` orders a name's lines: the folder's file, where the task's share of it begins, and the place therein."""
    rows = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("offset"), F.split("value", TAB, 2).alias("v"))
    place = F.struct("file", "offset", F.monotonically_increasing_id().alias("nth"))
    return rows.select(F.url_decode(F.get("v", F.lit(0))).alias("name"), place.alias("line_no"), F.get("v", F.lit(1)).alias("line"))


def _roster(roster: Column | str | None) -> Column:
    return F.lit(None).cast("string") if roster is None else F.lit(roster) if isinstance(roster, str) else roster


def read_bundled_chats(spark: SparkSession, path: str, roster: Column | str | None = None, endings: tuple[str, ...] = CHAT_FILES, max_size: int | None = None) -> DataFrame:
    """(chat_id, roster_id, text): what :func:`rollcall.sources.chats.read_chats` gives of files, of a folder's names; ``roster`` may be made of ``path``, which is the name."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    files = read_lines(spark, path).groupBy(F.col("name").alias("path")).agg(text.alias("text")).withColumn("size", F.octet_length("text").cast("long"))
    return gate_files(files, endings, max_size).select(F.col("path").alias("chat_id"), _roster(roster).alias("roster_id"), "text")


def read_bundled_chat_lines(spark: SparkSession, path: str, roster: Column | str | None = None, endings: tuple[str, ...] = CHAT_FILES, max_size: int | None = None) -> DataFrame:
    """(chat_id, roster_id, line_no, line): the same by lines, as of :func:`rollcall.sources.chats.read_chat_lines`."""
    lines = read_lines(spark, path).withColumnRenamed("name", "path")
    if max_size is not None:
        sizes = lines.groupBy("path").agg(F.sum(F.octet_length("line") + 1).alias("size"))
        lines = lines.join(gate_files(sizes, endings, max_size).select("path"), "path", "left_semi")
    return gate_files(lines, endings).select(F.col("path").alias("chat_id"), _roster(roster).alias("roster_id"), "line_no", "line")
