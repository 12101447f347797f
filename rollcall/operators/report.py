"""Attendance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import split_name
from .match import NONE
from .ordering import numbered
from .roster import id_order, name_index


def participant_info(matches: DataFrame, roster: DataFrame) -> DataFrame:
    """(chat_id, first_seq, ord, id, surname, firstname, nickname, found, match_type, alternatives, auto_matched) of every match row.

    Found names take theirs from the roster; others from the real name, with id '?'.
    """
    names = name_index(roster).groupBy("roster_id", "id").agg(F.min_by("full_name", "pos").alias("index_name"))
    rows = matches.join(names, ["roster_id", "id"], "left")
    found = F.col("id").isNotNull()
    n = split_name(F.when(found, F.coalesce("db_name", "index_name")).otherwise(F.col("real_name")))
    kind = F.coalesce("match_type", F.lit("found"))
    by_first = found & F.contains(kind, F.lit("firstname")) & ~F.contains(kind, F.lit("surname"))
    tagged = F.col("real_name").isNotNull()
    return rows.select(
        "chat_id", "first_seq", "ord", F.coalesce("id", F.lit("?")).alias("id"),
        F.coalesce(n["surname"], F.when(~by_first, n["word"]), F.lit("")).alias("surname"), F.coalesce(n["firstname"], F.when(by_first, n["word"]), F.lit("")).alias("firstname"), F.col("name").alias("nickname"), found.alias("found"),
        F.when(found & tagged & (kind != "real-name-tag"), F.concat(kind, F.lit(" real-name-tag"))).when(found, kind).when(tagged, "real-name-tag").otherwise("not-found").alias("match_type"),
        F.when(found & (F.size("all_matches") > 1), F.slice("all_matches", F.lit(2), F.size("all_matches"))).otherwise(F.expr(NONE)).alias("alternatives"), F.coalesce("auto_matched", F.lit(False)).alias("auto_matched"),
    )


def report_order(by: str = "id", descending: bool = False) -> list[Column]:
    """R2: found ones first, then by id, surname, firstname or nickname, in Ukrainian order; ties by nickname, then appearance."""
    keys = id_order() if by == "id" else [F.collate(F.col(by), "uk")]
    return [F.desc("found"), *[k.desc() if descending else k.asc() for k in keys], F.collate(F.col("nickname"), "uk"), F.col("first_seq"), F.col("ord")]


def sort_report(report: DataFrame, by: str = "id", descending: bool = False) -> DataFrame:
    """R2: with ``place`` within the chat."""
    return numbered(report, ["chat_id"], report_order(by, descending), "place").withColumn("place", F.col("place").cast("int"))


def dedup_report(report: DataFrame, by: str = "id", descending: bool = False) -> DataFrame:
    """The first row of each person (by id, or nickname if not found) in R2's order."""
    key = F.when(F.col("found"), F.col("id")).otherwise(F.concat_ws("_", "id", "nickname"))
    w = Window.partitionBy("chat_id", "person").orderBy(*report_order(by, descending))
    return report.withColumn("person", key).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "person")


def counts(report: DataFrame) -> DataFrame:
    """(chat_id, parsed, unrecognised, unique_people)."""
    key = F.when(F.col("found"), F.col("id")).otherwise(F.concat_ws("_", "id", "nickname"))
    return report.groupBy("chat_id").agg(F.count("*").alias("parsed"), F.count_if(~F.col("found")).alias("unrecognised"), F.count_distinct(key).alias("unique_people"))


def match_flags(report: DataFrame) -> DataFrame:
    """What a match type says, as flags."""
    has = lambda *words: F.greatest(*[F.contains("match_type", F.lit(w)) for w in words]) if len(words) > 1 else F.contains("match_type", F.lit(words[0]))
    return report.withColumns({
        "is_translit": has("translit"), "is_split": has("split-name"), "is_reversed": has("reversed"), "is_variant": has("variant"), "is_auto": F.col("auto_matched") | has("auto-match"),
        "is_tag": has("real-name-tag"), "is_nickname": has("nickname"),
    })


def has_alternatives(report: DataFrame, alternatives: DataFrame) -> DataFrame:
    """With ``has_alternatives``: not found, but with candidates or recommendations (rows of M27)."""
    some = alternatives.select("chat_id", F.col("name").alias("nickname")).distinct().withColumn("some", F.lit(True))
    rows = report.join(some, ["chat_id", "nickname"], "left")
    return rows.withColumn("has_alternatives", ~F.col("found") & F.coalesce("some", F.lit(False))).drop("some")
