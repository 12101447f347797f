"""The attendance workload: transcripts and rosters to a report per meeting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assign, chat, match, recommend, report
from ..operators.dictionary import Variants
from ..sources.screen import screen_documents
from ..storage import settle


@dataclass
class Attendance:
    people: DataFrame
    aliases: DataFrame
    matches: DataFrame
    report: DataFrame
    rejected: DataFrame
    roster: DataFrame


def attendance(chats: DataFrame, roster: DataFrame, variants: Variants, keyword: str | None = None, overrides: DataFrame | None = None, mode: str = "auto") -> Attendance:
    """Screen, parse, match, assign and report; ``rejected`` are chats with unsafe text, ``roster`` is the roster as written: more than ten steps read it."""
    roster = settle(roster)
    safe, rejected = screen_documents(chats)
    rows = settle(chat.messages(safe))
    people, aliases = settle(chat.keyword_filter(chat.participants(rows), keyword)), settle(chat.aliases(rows))
    found, evidence = match.match_with_evidence(people, aliases, roster, variants, overrides, mode)
    found = settle(assign.auto_match(settle(found), roster, variants, evidence=evidence))
    return Attendance(people, aliases, found, report.participant_info(found, roster), rejected, roster)


def counts_per_chat(a: Attendance) -> DataFrame:
    return report.counts(a.report)


def review(a: Attendance, roster: DataFrame) -> DataFrame:
    """What is left to decide by hand: every open name with its alternatives, best first."""
    return recommend.merge_alternatives(a.matches.filter("id is null"), recommend.recommend(a.matches, roster))


def keep_nicknames(a: Attendance, roster: DataFrame) -> DataFrame:
    """Nicknames of manual assignments (roster_id, id, ord, nickname), so that the next run finds them by a plain join."""
    hand = a.matches.filter("match_type = 'manual-assignment'").groupBy("roster_id", "id", F.col("name").alias("nickname")).agg(F.min("first_seq").alias("ord"))
    return hand.select("roster_id", "id", "ord", "nickname")
