"""Roster operations (D1-D13) on (roster_id, pos, id, surname, firstname, nicknames)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_int, similarity, trim
from ..sources.rosters import convert_legacy
from .ordering import dealt, numbered, sums

__all__ = ["convert_legacy"]


def full_name() -> Column:
    return F.concat_ws(" ", "surname", "firstname")


def name_index(roster: DataFrame) -> DataFrame:
    """(roster_id, full_name, id, pos); of people with the same name the last gives the id, the first the place."""
    rows = roster.withColumn("full_name", trim(full_name()))
    return rows.groupBy("roster_id", "full_name").agg(F.max_by("id", "pos").alias("id"), F.min("pos").alias("pos"))


def nickname_index(roster: DataFrame) -> DataFrame:
    """(roster_id, nick, id), nicknames in lower case; the last person with a nickname has it."""
    nicks = roster.select("roster_id", "id", "pos", F.posexplode("nicknames").alias("k", "n")).filter("n <> ''")
    return nicks.groupBy("roster_id", F.lower("n").alias("nick")).agg(F.max_by("id", F.struct("pos", "k")).alias("id"))


def lookup_id(requests: DataFrame, roster: DataFrame) -> DataFrame:
    """D3: requests (roster_id, id) with the first person of that id, or nulls."""
    first = roster.groupBy("roster_id", "id").agg(F.min_by(F.struct("pos", "surname", "firstname", "nicknames"), "pos").alias("p"))
    return requests.join(first, ["roster_id", "id"], "left").select(*[requests[c] for c in requests.columns], "p.*")


def lookup_nickname(requests: DataFrame, roster: DataFrame) -> DataFrame:
    """D3: requests (roster_id, nickname) with ``id``, without regard to case."""
    return requests.withColumn("nick", F.lower("nickname")).join(nickname_index(roster), ["roster_id", "nick"], "left").drop("nick")


def lookup_full_name(requests: DataFrame, roster: DataFrame) -> DataFrame:
    """D3: requests (roster_id, full_name) with ``id``; case counts."""
    return requests.join(name_index(roster).drop("pos"), ["roster_id", "full_name"], "left")


def filter_entries(roster: DataFrame, condition: Column) -> DataFrame:
    """Those that meet any condition."""
    return roster.filter(condition)


def matches_search(query: Column) -> Column:
    """The query (lower case) occurs in a name or nickname, or as it is in the id; blank queries fit all."""
    q = F.lower(query)
    hit = F.contains(F.lower("surname"), q) | F.contains(F.lower("firstname"), q) | F.exists("nicknames", lambda n: F.contains(F.lower(n), q)) | F.contains(F.col("id"), query)
    return (trim(query) == "") | hit


def search(roster: DataFrame, query: str) -> DataFrame:
    """People that a text occurs in."""
    return roster.filter(matches_search(F.lit(query)))


def search_many(queries: DataFrame, roster: DataFrame) -> DataFrame:
    """D5 for a table (roster_id, query): pairs of query and person."""
    return queries.join(roster, "roster_id").filter(matches_search(F.col("query")))


def ranked_search(queries: DataFrame, roster: DataFrame) -> DataFrame:
    """(roster_id, query, full_name, id, rank): names that hold the query, most similar first, then in roster order; a blank query gives roster order."""
    rows = queries.join(name_index(roster), "roster_id")
    blank = trim("query") == ""
    rows = rows.filter(blank | F.contains(F.lower("full_name"), F.lower("query")))
    score = F.when(blank, 0.0).otherwise(similarity("full_name", "query"))
    w = Window.partitionBy("roster_id", "query").orderBy(F.desc(score), "pos")
    return rows.select("roster_id", "query", "full_name", "id", F.row_number().over(w).alias("rank"))


def next_id(roster: DataFrame) -> DataFrame:
    """(roster_id, next_id): one above the greatest number among the ids."""
    return roster.groupBy("roster_id").agg((F.coalesce(F.max(F.coalesce(parse_int("id"), F.lit(0))), F.lit(0)) + 1).cast("string").alias("next_id"))


def add_entries(roster: DataFrame, new: DataFrame) -> DataFrame:
    """With new people (roster_id, ord, id or null, surname, firstname, nicknames) behind the others.

    Surname and firstname are required; blank nicknames go; missing ids count on from the greatest number.
    """
    rows = new.select("roster_id", "ord", "id", trim("surname").alias("surname"), trim("firstname").alias("firstname"), F.filter(F.transform(F.coalesce("nicknames", F.array().cast("array<string>")), trim), lambda x: x != "").alias("nicknames"))
    rows = rows.filter("surname <> '' and firstname <> ''")
    ends = roster.groupBy("roster_id").agg(F.max("pos").alias("end"))
    key = ["roster_id"], ["ord"]
    rows = sums(dealt(rows, *key), *key, nth=F.lit(1), missing=F.col("id").isNull().cast("int"))
    rows = rows.join(next_id(roster), "roster_id", "left").join(ends, "roster_id", "left")
    start = F.coalesce(F.col("next_id").cast("bigint"), F.lit(1))
    rows = rows.select(
        "roster_id", (F.coalesce("end", F.lit(-1)) + F.col("nth")).cast(dict(roster.dtypes)["pos"]).alias("pos"), F.coalesce("id", (start + F.col("missing") - 1).cast("string")).alias("id"), "surname", "firstname", "nicknames",
    )
    return roster.select("roster_id", "pos", "id", "surname", "firstname", "nicknames").unionByName(rows)


def _first_of_id(roster: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("roster_id", "id").orderBy("pos")) == 1


def update_entries(roster: DataFrame, updates: DataFrame) -> DataFrame:
    """Given fields (not null) of (roster_id, id, ord, surname, firstname, nicknames) replace those of the first person with the id; later updates win field by field."""
    fields = ("surname", "firstname", "nicknames")
    last = updates.groupBy("roster_id", "id").agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f"new_{f}") for f in fields])
    rows = roster.withColumn("is_first", _first_of_id(roster)).join(last, ["roster_id", "id"], "left")
    return rows.select("roster_id", "pos", "id", *[F.when(F.col("is_first"), F.coalesce(f"new_{f}", f)).otherwise(F.col(f)).alias(f) for f in fields])


def delete_entries(roster: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the first person of each id in (roster_id, id)."""
    gone = ids.select("roster_id", "id").distinct().withColumn("gone", F.lit(True))
    rows = roster.withColumn("is_first", _first_of_id(roster)).join(gone, ["roster_id", "id"], "left")
    return rows.filter(~(F.col("is_first") & F.coalesce("gone", F.lit(False)))).select(*roster.columns)


def attach_nicknames(roster: DataFrame, adds: DataFrame) -> DataFrame:
    """Nicknames of (roster_id, id, ord, nickname) added in order where new; of at most two, a third replaces the second."""
    ordered = adds.filter("nickname <> ''").groupBy("roster_id", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "nickname"))), lambda x: x["nickname"]).alias("adds"))
    rows = roster.withColumn("is_first", _first_of_id(roster)).join(ordered, ["roster_id", "id"], "left")
    start = F.coalesce("nicknames", F.array().cast("array<string>"))
    step = lambda acc, x: F.when(F.array_contains(acc, x), acc).when(F.size(acc) < 2, F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, 1, 1), F.array(x)))
    grown = F.aggregate(F.coalesce("adds", F.array().cast("array<string>")), start, step)
    return rows.select("roster_id", "pos", "id", "surname", "firstname", F.when(F.col("is_first"), grown).otherwise(F.col("nicknames")).alias("nicknames"))


def id_order(c: str = "id") -> list[Column]:
    """Ids in order: numbers first, by value, then the rest in Ukrainian order."""
    n = parse_int(c)
    return [n.isNull(), n, F.collate(F.col(c), "uk")]


def sort_roster(roster: DataFrame, by: str = "id", descending: bool = False) -> DataFrame:
    """With ``rank`` within each roster, by id, surname, firstname or (first) nickname, in Ukrainian order; ties by place."""
    key = F.coalesce(F.get("nicknames", F.lit(0)), F.lit("")) if by == "nickname" else F.col(by)
    keys = id_order() if by == "id" else [F.collate(key, "uk")]
    order = [k.desc() if descending else k.asc() for k in keys]
    return numbered(roster, ["roster_id"], [*order, "pos"], "rank").withColumn("rank", F.col("rank").cast("int"))
