"""Recommendations for names without a match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import to_cyrillic, to_latin
from ..functions.text import likeness
from ..storage import settle, spread
from . import ambiguity
from .candidates import PIECES_FROM, alike_strings, by_size
from .match import distinct_keys
from .roster import name_index


def _spelled(rows: DataFrame, name: str, form: str) -> DataFrame:
    """(roster_id, name, form): a name in lower case as it is, in Latin and in Cyrillic script."""
    c = F.col(name)
    forms = F.array_distinct(F.array(F.lower(c), F.lower(to_latin(c)), F.lower(to_cyrillic(c))))
    return rows.select("roster_id", name).distinct().select("roster_id", name, F.explode(forms).alias(form)).filter(F.col(form) != "")


def _forms(rows: DataFrame, name: str, p: str) -> DataFrame:
    """Distinct names with their forms as columns; a form that the name has already is null."""
    c = F.col(name)
    return rows.select("roster_id", name, F.lower(c).alias(f"{p}0"), F.nullif(F.lower(to_latin(c)), F.lower(c)).alias(f"{p}1"), F.nullif(F.lower(to_cyrillic(c)), F.lower(c)).alias(f"{p}2")).distinct()


def _near_people(names: DataFrame, people: DataFrame) -> DataFrame:
    """(roster_id, name, db_name, similarity) of all names and people of a roster: for thresholds so low that letters rule out hardly any."""
    a, b = spread(_forms(names, "name", "a"), "roster_id", "name"), settle(_forms(people, "db_name", "b"))
    best = F.greatest(*[F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), likeness(x, y)) for x in ("a0", "a1", "a2") for y in ("b0", "b1", "b2")])
    return a.join(b, "roster_id").select("roster_id", "name", "db_name", best.alias("similarity"))


def best_matches(open_names: DataFrame, used: DataFrame, roster: DataFrame, limit: int = 3, at_least: float = 0.3, mode: str = "auto", few: int = 2000) -> DataFrame:
    """(chat_id, name, rank, id, db_name, similarity). Glued names give their splits; others the greatest similarity over both names as they are,
    in Latin and in Cyrillic script. ``used`` (chat_id, id) are left out. ``at_least`` is exclusive.

    Names of rosters of up to ``few`` strings are measured against all people, from 0.5 on against those with whom they share letters enough. For larger rosters the threshold falls in two steps:
    keys find all who are ``PIECES_FROM`` alike; the ``limit``-th best unused one of a name, in the meeting where that is least, is then the threshold for
    the name, and whoever can't reach it isn't looked at.
    """
    keys = distinct_keys(open_names.select("roster_id", "name").withColumn("real_name", F.lit(None).cast("string")))
    asked = settle(open_names.select("chat_id", "roster_id", "name").join(keys.select("roster_id", "name", "k"), ["roster_id", "name"]))
    glued = settle(keys.filter(ambiguity.is_one_word(F.col("name")) & (F.length("name") >= 6)))
    splits = None if glued.isEmpty() else settle(ambiguity.split_glued(glued, roster).filter("q >= 0.7").select("k", "pos", "id", "db_name", F.col("q").alias("similarity")))
    people = settle(name_index(roster).select("roster_id", "pos", "id", F.col("full_name").alias("db_name")))
    taken = settle(used.select("chat_id", "id").distinct())
    unused = lambda rows: rows.join(taken, ["chat_id", "id"], "left_anti")
    left = keys if splits is None else keys.join(splits.select("k").distinct(), "k", "left_anti")
    theirs = settle(_spelled(people, "db_name", "t"))
    t = theirs.select("roster_id", "t")

    def found(best: DataFrame) -> DataFrame:
        """(k, pos, id, db_name, similarity) of names and people."""
        rows = keys.select("roster_id", "name", "k").join(best.filter(F.col("similarity") > at_least), ["roster_id", "name"]).join(people, ["roster_id", "db_name"])
        return rows.select("k", "pos", "id", "db_name", "similarity")

    small, large = by_size(left, t, mode, few)
    rows = [] if splits is None else [splits]
    named = lambda forms, close: forms.join(close, ["roster_id", "s"]).join(theirs, ["roster_id", "t"]).groupBy("roster_id", "name", "db_name").agg(F.max("similarity").alias("similarity"))
    if small is not None and at_least < 0.5:
        rows.append(found(_near_people(small, people)))
    elif small is not None:
        forms = settle(_spelled(small, "name", "s"))
        rows.append(found(named(forms, alike_strings(forms.select("roster_id", "s"), t, at_least, "small"))))
    if large is not None:
        forms = settle(_spelled(large, "name", "s"))
        close = settle(found(named(forms, alike_strings(forms.select("roster_id", "s"), t, max(at_least, PIECES_FROM), "large"))))
        last = Window.partitionBy("chat_id", "k").orderBy(F.desc("similarity"), "pos")
        reached = unused(asked.join(close, "k")).withColumn("rank", F.row_number().over(last)).filter(F.col("rank") == limit).select("chat_id", "k", "similarity")
        least = asked.join(reached, ["chat_id", "k"], "left").groupBy("roster_id", "name").agg(F.min(F.coalesce("similarity", F.lit(at_least))).alias("least"))
        rows.append(found(named(forms, alike_strings(forms.join(least, ["roster_id", "name"]).select("roster_id", "s", "least"), t, at_least, "large"))))
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    w = Window.partitionBy("chat_id", "name").orderBy(F.desc("similarity"), "pos")
    return unused(asked.join(every, "k")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("chat_id", "name", "rank", "id", "db_name", "similarity")


def recommend(matches: DataFrame, roster: DataFrame) -> DataFrame:
    """(chat_id, name, rank, id, db_name, similarity) for names without an id: the candidates (from 50) of open choices, else people whose firstname
    the one-word name is (0.95, or 0.9 each of several), else the three best matches from 0.6.
    """
    left = matches.filter("id is null")
    open_ = left.filter("match_type in ('ambiguous-name', 'multiple-matches', 'split-name-match') and all_matches is not null")
    a = open_.select("chat_id", "name", F.posexplode("all_matches").alias("o", "m")).filter("m.quality >= 50")
    a = a.select("chat_id", "name", F.col("o").cast("long").alias("o"), F.col("m.id").alias("id"), F.col("m.db_name").alias("db_name"), (F.col("m.quality") / 100).alias("similarity"))
    rest = left.join(open_.select("chat_id", "name"), ["chat_id", "name"], "left_anti")
    first = name_index(roster).select("roster_id", "pos", "id", F.col("full_name").alias("db_name"), F.get(F.split(F.lower("full_name"), r"[\p{IsWhite_Space}]+"), F.lit(1)).alias("first"))
    count = first.groupBy("roster_id", "first").agg(F.count("*").alias("n"))
    one = rest.filter(~F.col("name").rlike(r"[\p{IsWhite_Space}]")).select("chat_id", "roster_id", "name", F.lower("name").alias("first"))
    b = one.join(first, ["roster_id", "first"]).join(count, ["roster_id", "first"]).select("chat_id", "name", F.col("pos").cast("long").alias("o"), "id", "db_name", F.when(F.col("n") == 1, 0.95).otherwise(0.9).alias("similarity"))
    last = rest.join(b.select("chat_id", "name").distinct(), ["chat_id", "name"], "left_anti")
    used = matches.filter("id is not null").select("chat_id", "id")
    c = best_matches(last, used, roster, at_least=0.6 - 1e-9).filter("similarity >= 0.6").select("chat_id", "name", F.col("rank").cast("long").alias("o"), "id", "db_name", "similarity")
    w = Window.partitionBy("chat_id", "name").orderBy("o", "id")
    return a.unionByName(b).unionByName(c).withColumn("rank", F.row_number().over(w)).select("chat_id", "name", "rank", "id", "db_name", "similarity")


def merge_alternatives(matches: DataFrame, recommendations: DataFrame) -> DataFrame:
    """(chat_id, name, rank, id, db_name, quality): a name's candidates and recommendations, each id once (candidates first), best first."""
    own = matches.filter("all_matches is not null").select("chat_id", "name", F.posexplode("all_matches").alias("o", "m"))
    own = own.select("chat_id", "name", F.lit(0).alias("s"), F.col("o").cast("long").alias("o"), F.col("m.id").alias("id"), F.col("m.db_name").alias("db_name"), F.col("m.quality").alias("quality"))
    rec = recommendations.select("chat_id", "name", F.lit(1).alias("s"), F.col("rank").cast("long").alias("o"), "id", "db_name", F.floor(F.col("similarity") * 100 + 0.5).cast("int").alias("quality"))
    once = own.unionByName(rec).withColumn("n", F.row_number().over(Window.partitionBy("chat_id", "name", "id").orderBy("s", "o"))).filter("n = 1")
    rank = F.row_number().over(Window.partitionBy("chat_id", "name").orderBy(F.desc("quality"), "s", "o"))
    return once.withColumn("rank", rank).select("chat_id", "name", "rank", "id", "db_name", "quality")
