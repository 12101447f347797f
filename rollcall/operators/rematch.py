"""M28 by what changed: only the names are matched again that a changed roster row may have met, or may meet now.

Every decision on a name is made of pairs of the name with single people, and of counts of people with the same name or firstname. So a name that has nothing to do with
any person that left, came or changed, in the old or the new form, keeps its result. Such names are found by the keys that matching
itself uses, with the changed people in place of the roster. Automatic assignment depends on a whole meeting: it's made anew in the meetings of such names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import settle
from . import ambiguity
from .assign import auto_match
from .dictionary import Variants
from .match import match_with_evidence, rule_pairs
from .roster import name_index, nickname_index

KEY = ("roster_id", "name", "real_name")


def _either(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that only one of two tables of distinct rows has."""
    both = old.withColumn("side", F.lit(1)).unionByName(new.withColumn("side", F.lit(-1)))
    return both.groupBy(*old.columns).agg(F.sum("side").alias("side")).filter("side <> 0").drop("side")


def _nicks(roster: DataFrame) -> DataFrame:
    """(roster_id, nick, id, nick_name): what a nickname leads to."""
    first = name_index(roster).groupBy("roster_id", "id").agg(F.min_by("full_name", "pos").alias("nick_name"))
    return nickname_index(roster).join(first, ["roster_id", "id"], "left").select("roster_id", "nick", "id", "nick_name")


def changes(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roster_id, full_name) of people, and (roster_id, nick) of nicknames, that one of two states of rosters has and the other hasn't, or has for another id or place.

    A person whose ``pos`` is another counts as changed, as places decide between equals.
    """
    people = _either(name_index(before), name_index(after)).select("roster_id", "full_name").distinct()
    return settle(people), settle(_either(_nicks(before), _nicks(after)).select("roster_id", "nick").distinct())


def touched(keys: DataFrame, people: DataFrame, nicks: DataFrame, variants: Variants, mode: str = "auto") -> DataFrame:
    """The ``k`` of keys (roster_id, name, real_name, k, open) whose result the changed people and nicknames of :func:`changes` may alter; ``open`` names take part in automatic assignment."""
    shown = F.coalesce("real_name", "name")
    named = people.withColumnRenamed("full_name", "asked")
    by_name = keys.select("roster_id", "k", F.explode(F.array("name", "real_name")).alias("asked")).join(named, ["roster_id", "asked"], "left_semi").select("k")
    by_nick = keys.select("roster_id", "k", F.lower(shown).alias("nick")).join(nicks, ["roster_id", "nick"], "left_semi").select("k")
    # Changed people as a roster of their own; each has a place, so that rules see every one.
    none = F.lit(None).cast("string")
    changed = settle(people.select("roster_id", F.monotonically_increasing_id().alias("pos"), F.col("full_name").alias("id"), F.col("full_name").alias("surname"), none.alias("firstname")))
    by_rule = rule_pairs(keys.select("roster_id", "k", shown.alias("lookup")), changed, variants, mode).select("k")
    words = settle(keys.filter(ambiguity.is_one_word(F.col("name")) | F.col("open")).select("roster_id", "name", "k"))
    return by_name.unionByName(by_nick).unionByName(by_rule).unionByName(ambiguity.related(words, changed, variants)).distinct()


def _same_key(left: DataFrame, right: DataFrame) -> Column:
    return (left["roster_id"] == right["roster_id"]) & (left["name"] == right["name"]) & left["real_name"].eqNullSafe(right["real_name"])


def rematch_changes(
    matches: DataFrame, before: DataFrame, after: DataFrame, variants: Variants, overrides: DataFrame | None = None, mode: str = "auto", log: dict[str, int] | None = None
) -> DataFrame:
    """The match table (M22's result on ``before``) for rosters ``after``: equal to matching everything anew, at the price of the names that a change may reach.

    The same variants are asked for as before; overrides may be others, as names with one, or with a manual assignment so far, are always matched again. Alternatives that were
    selected (M26) stay unless their name is touched. Without changes the table comes back as it is. Rosters that only one state has are changed as a whole. Repeated
    rows of a roster are one person, null names and empty tables have no effect. ``log`` receives the numbers of names and of those that are matched again.
    """
    people, nicks = changes(before, after)
    matches = settle(matches)
    is_open = F.col("id").isNull() | F.col("auto_matched")
    by_hand = F.bool_or(F.col("match_type") == "manual-assignment").alias("by_hand")
    keys = settle(matches.groupBy(*KEY).agg(F.bool_or(is_open).alias("open"), by_hand).withColumn("k", F.monotonically_increasing_id()))
    asked = keys.join(people.select("roster_id").unionByName(nicks.select("roster_id")).distinct(), "roster_id", "left_semi")
    again = touched(asked, people, nicks, variants, mode).unionByName(keys.filter("by_hand").select("k"))
    if overrides is not None:
        again = again.unionByName(keys.join(overrides.select("name").distinct(), "name", "left_semi").select("k"))
    again = settle(keys.join(again.distinct(), "k", "left_semi").select(*KEY))
    if log is not None:
        log.update(names=keys.count(), again=again.count())
    if again.isEmpty():
        return matches
    mark = again.withColumn("again", F.lit(True))
    marked = settle(matches.join(mark, _same_key(matches, mark), "left").select(matches["*"], F.coalesce("again", F.lit(False)).alias("again")))
    meetings = marked.filter("again").select("chat_id").distinct()
    rows = settle(marked.join(meetings, "chat_id", "left_semi"))
    # What was assigned automatically is open again in these meetings.
    fresh, kept = rows.filter(F.col("again") | F.col("auto_matched")), rows.filter(~F.col("again") & ~F.col("auto_matched")).select(matches.columns)
    roster = after.join(rows.select("roster_id").distinct(), "roster_id", "left_semi")
    found, evidence = match_with_evidence(fresh.select("chat_id", "roster_id", "name", "first_seq", "ord"), fresh.filter("real_name is not null").select("chat_id", "name", "real_name"), roster, variants, overrides, mode)
    made = auto_match(settle(kept.unionByName(found.select(matches.columns))), roster, variants, evidence=evidence)
    return matches.join(meetings, "chat_id", "left_anti").select(matches.columns).unionByName(made.select(matches.columns))
