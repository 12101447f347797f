"""Automatic one-to-one assignment of the names that matching left open.

Names choose in order of appearance, and every hit uses up an id of the meeting, so that a name's choice depends on earlier ones; but only on those that may
take an id among its own candidates. So the choice goes in rounds: in each, all names choose whose candidates no earlier open name can take, in all meetings at
once. Their ids are struck from the other names' candidates, and the next round begins. There are as many rounds as the longest chain of names that
wait for each other. Rows are spread by meeting and name or id, so that one large meeting is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle
from . import ambiguity
from .dictionary import Variants
from .match import MATCH, distinct_keys
from .roster import name_index

FIRSTNAME, SPLIT, POSSIBLE = "auto-match-single-name", "split-name-match", "auto-match"
#: The least quality of a single possible match that is taken.
SURE = 90


def candidates(matches: DataFrame, keys: DataFrame, splits: DataFrame, possible: DataFrame, roster: DataFrame) -> DataFrame:
    """(chat_id, name, place, kind, id, db_name, quality, part) of open names: the people whose firstname a one-word name is, a glued name's best split over
    0.85, and the possible matches of names that aren't an open choice. Ids that the meeting uses already are left out.

    Where a name has more people than the meeting has names, at least two stay unused whatever happens; their rows are left out, as that branch can't be taken.
    """
    place = F.struct("first_seq", "ord", "name").alias("place")
    sizes = matches.groupBy("chat_id").agg(F.count("*").alias("names"))
    open_ = matches.filter("id is null").select("chat_id", "roster_id", "name", place, "match_type").join(keys.select("roster_id", "name", "k"), ["roster_id", "name"]).join(sizes, "chat_id")
    one = open_.filter(~F.col("name").rlike(r"[\p{IsWhite_Space}]")).withColumn("first", F.lower("name"))
    people = name_index(roster).withColumn("first", F.get(F.split(F.lower("full_name"), r"[\p{IsWhite_Space}]+"), F.lit(1))).filter("first is not null")
    people = settle(people.select("roster_id", "first", "id", F.col("full_name").alias("db_name")))
    many = people.groupBy("roster_id", "first").agg(F.count("*").alias("n"))
    row = lambda df, kind, quality, part: df.select("chat_id", "name", "place", F.lit(kind).alias("kind"), "id", "db_name", quality.alias("quality"), part.alias("part"))
    firsts = row(one.join(many, ["roster_id", "first"]).filter(F.col("n") <= F.col("names") + 1).join(people, ["roster_id", "first"]), FIRSTNAME, F.lit(95), F.lit(""))
    top = splits.groupBy("k").agg(F.min(F.struct((-F.col("q")).alias("o"), "id", "db_name", "combined")).alias("top")).filter("-top.o > 0.85")
    glued = one.join(top.select("k", (-F.col("top.o")).alias("q"), "top.id", "top.db_name", "top.combined"), "k")
    glued = row(glued, SPLIT, F.floor(F.col("q") * 100 + 0.5).cast("int"), F.col("combined"))
    many = possible.groupBy("k").agg(F.count("*").alias("n"))
    any_ = open_.filter("match_type not in ('multiple-matches', 'ambiguous-name')").join(many, "k").filter(F.col("n") <= F.col("names") + 1)
    any_ = row(any_.join(possible.select("k", "id", "db_name", "quality", "part"), "k"), POSSIBLE, F.col("quality"), F.col("part"))
    taken = matches.filter("id is not null").select("chat_id", "id").distinct()
    return firsts.unionByName(glued).unionByName(any_).join(taken, ["chat_id", "id"], "left_anti")


def choose(rows: DataFrame, log: list[int] | None = None) -> DataFrame:
    """(chat_id, name, kind, id, db_name, quality, part): what each name of a table of :func:`candidates` takes when names choose one after the other by ``place``.

    A name takes the only unused person of its firstname; else its split, if that is unused; else its only unused possible match, if that is sure. ``log`` receives the
    number of candidates of each round.
    """
    spark, first, out = rows.sparkSession, F.col("first"), None
    is_ = lambda kind: F.col("kind") == kind
    takeable = (F.col("kind") != POSSIBLE) | (F.col("quality") >= SURE)
    value = F.struct("id", "db_name", "quality", "part")
    rows = settle(rows)
    while not rows.isEmpty():
        if log is not None:
            log.append(rows.count())
        # Who may take an id before this name does.
        takers = rows.filter(takeable).groupBy("chat_id", "id").agg(F.min("place").alias("first"))
        waits = F.coalesce(first < F.col("place"), F.lit(False))
        parts = {k: (F.count_if(is_(k)), F.min(F.when(is_(k), value)), F.bool_or(is_(k) & waits)) for k in (FIRSTNAME, SPLIT, POSSIBLE)}
        aggs = [c.alias(f"{name}{i}") for i, k in enumerate(parts) for name, c in zip(("n", "v", "w"), parts[k], strict=True)]
        names = rows.join(takers, ["chat_id", "id"], "left").groupBy("chat_id", "name").agg(F.any_value("place").alias("place"), F.count_if(takeable).alias("able"), *aggs)
        # A name without any that it may take needn't wait; possible matches don't matter to a name that has a split.
        ready = (F.col("able") == 0) | ~(F.col("w0") | F.col("w1") | (F.col("w2") & (F.col("n1") == 0)))
        hit = lambda kind, i: F.struct(F.lit(kind).alias("kind"), F.col(f"v{i}").alias("v"))
        taken = F.when(F.col("n0") == 1, hit(FIRSTNAME, 0)).when(F.col("n1") > 0, hit(SPLIT, 1)).when((F.col("n2") == 1) & (F.col("v2.quality") >= SURE), hit(POSSIBLE, 2))
        done = settle(names.filter(ready).select("chat_id", "name", "place", taken.alias("t")))
        hits = done.filter("t is not null").select("chat_id", "name", "place", "t.kind", "t.v.id", "t.v.db_name", "t.v.quality", "t.v.part")
        out = hits.drop("place") if out is None else out.unionByName(hits.drop("place"))
        # For names before the taker an id was still unused: a match that isn't sure, as they would have gone first otherwise.
        gone = hits.select("chat_id", "id", F.col("place").alias("by"))
        rows = rows.join(done.select("chat_id", "name"), ["chat_id", "name"], "left_anti").join(gone, ["chat_id", "id"], "left")
        rows = settle(rows.filter(F.coalesce(F.col("place") < F.col("by"), F.lit(True))).drop("by"))
    schema = "name string, kind string, id string, db_name string, quality int, part string"
    return out if out is not None else spark.createDataFrame([], f"chat_id {dict(rows.dtypes)['chat_id']}, {schema}")


def auto_match(matches: DataFrame, roster: DataFrame, variants: Variants, log: list[int] | None = None, evidence: ambiguity.Evidence | None = None) -> DataFrame:
    """The match table with more ids: in order of appearance, a one-word name takes the only unused person of that firstname, a glued
    name its best split over 85, any other the only unused possible match of 90 or more. Open choices (several matches, ambiguity) take part in the first two only.

    ``evidence`` is what matching has found out about one-word names of the same roster; only other names are looked up again.
    """
    keys = distinct_keys(matches.filter("id is null").select("roster_id", "name").withColumn("real_name", F.lit(None).cast("string")))
    found = evidence.extended(keys, roster, variants) if evidence else ambiguity.gather(keys, roster, variants)
    splits, possible = found.splits, found.possible
    hits = choose(candidates(matches, keys, splits, possible, roster), log)
    item = F.struct((-F.col("q")).alias("o"), "id", F.struct("id", "db_name", F.floor(F.col("q") * 100 + 0.5).cast("int").alias("quality"), F.col("combined").alias("match_type"), F.lit(False).alias("reversed")).alias("m"))
    all_splits = splits.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["m"]).alias("splits"))
    split = matches.select("chat_id", "roster_id", "name").join(hits.filter(F.col("kind") == SPLIT).select("chat_id", "name"), ["chat_id", "name"]).join(keys.select("roster_id", "name", "k"), ["roster_id", "name"]).join(all_splits, "k")
    own = F.array(F.struct(F.col("new_id").alias("id"), F.col("new_name").alias("db_name"), F.col("new_quality").alias("quality"), F.col("part").alias("match_type"), F.lit(False).alias("reversed")))
    hits = hits.select("chat_id", "name", F.col("id").alias("new_id"), F.col("kind").alias("new_type"), F.col("quality").alias("new_quality"), F.col("db_name").alias("new_name"), "part")
    hits = hits.join(split.select("chat_id", "name", "splits"), ["chat_id", "name"], "left")
    new_all = F.when(F.col("new_type") == SPLIT, F.col("splits")).when(F.col("new_type") == POSSIBLE, own).cast(MATCH)
    joined = matches.join(hits.withColumn("new_all", new_all), ["chat_id", "name"], "left")
    hit = F.col("new_id").isNotNull()
    new = {"id": F.col("new_id"), "match_type": F.col("new_type"), "quality": F.col("new_quality"), "db_name": F.col("new_name"), "all_matches": F.col("new_all"), "auto_matched": F.lit(True)}
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in matches.columns])
