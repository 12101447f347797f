"""Linking chat names to roster rows.

Order of decisions: manual assignment, ambiguity of one-word names, exact name, real name of a tag, nickname, then the rules, of
which the first that fits gives a pair's type and quality. Fuzzy work runs on distinct (roster, name, real name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import translit_match
from ..functions.text import similar
from ..storage import settle
from . import ambiguity
from .candidates import described, matching_pairs
from .dictionary import Variants, with_forms
from .roster import name_index, nickname_index

MATCH = "array<struct<id:string,db_name:string,quality:int,match_type:string,reversed:boolean>>"
NONE = f"cast(null as {MATCH})"


def lookups(people: DataFrame, aliases: DataFrame) -> DataFrame:
    """(chat_id, roster_id, name, first_seq, ord, real_name) of participants."""
    return people.join(aliases, ["chat_id", "name"], "left").select("chat_id", "roster_id", "name", "first_seq", "ord", "real_name")


def distinct_keys(looked: DataFrame) -> DataFrame:
    """The distinct (roster_id, name, real_name), numbered by ``k`` and written, so that numbers stay: the same person sits in many meetings."""
    return settle(looked.select("roster_id", "name", "real_name").distinct().withColumn("k", F.monotonically_increasing_id()))


def rules() -> Column:
    """The first rule that fits a pair of ``n`` (the name, with what the dictionary says of its parts) and ``d`` (the roster row), as a struct (match_type, quality, reversed), or null."""
    n, d = (lambda p: F.col(f"n.{p}")), (lambda p: F.col(f"d.{p}"))
    same = lambda a, b: F.lower(n(a)) == F.lower(d(b))
    fuzzy = lambda a, b: similar(n(a), d(b), 0.75)
    sounds = lambda a, b, t: translit_match(n(a), d(b), t, F.col(f"n_latin.{a}"), F.col(f"d_latin.{b}"))
    variant = lambda a, b: F.coalesce(F.array_contains(F.col(f"n_{a}.means"), F.lower(d(b))), F.lit(False))
    full = d("surname").isNotNull()
    two, one = n("surname").isNotNull() & full, n("word").isNotNull() & full
    table = [
        (two & same("surname", "surname") & same("firstname", "firstname"), "standard-order-exact", 98, False),
        (two & same("surname", "surname") & fuzzy("firstname", "firstname"), "surname-exact-firstname-fuzzy", 90, False),
        (two & sounds("surname", "surname", 0.75) & sounds("firstname", "firstname", 0.75), "standard-order-translit", 85, False),
        (two & same("surname", "surname") & variant("firstname", "firstname"), "standard-order-name-variant", 88, False),
        (two & same("rev_surname", "surname") & same("rev_firstname", "firstname"), "reversed-order-exact", 92, True),
        (two & same("rev_surname", "surname") & fuzzy("rev_firstname", "firstname"), "reversed-surname-exact-firstname-fuzzy", 85, True),
        (two & sounds("rev_surname", "surname", 0.75) & sounds("rev_firstname", "firstname", 0.75), "reversed-order-translit", 80, True),
        (two & same("rev_surname", "surname") & variant("rev_firstname", "firstname"), "reversed-order-name-variant", 82, True),
        (one & sounds("word", "surname", 0.75), "single-word-surname-match", 70, False),
        (one & sounds("word", "firstname", 0.75), "single-word-firstname-match", 65, False),
        (one & F.array_contains("forms", F.lower(d("firstname"))), "single-word-variant-match", 75, False),
        (sounds("full", "full", 0.70), "full-name-translit", 60, False),
    ]
    out = None
    for test, kind, quality, reversed_ in table:
        value = F.struct(F.lit(kind).alias("match_type"), F.lit(quality).alias("quality"), F.lit(reversed_).alias("reversed"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def asked_names(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct names (roster_id, lookup, k) that keys (roster_id, k, lookup) ask for, with a number of their own, and (k, q): the key and the number of its name.

    Many display names stand for one real name; rules look at that alone.
    """
    keys = keys.select("roster_id", "k", "lookup")
    names = settle(keys.select("roster_id", "lookup").filter("lookup is not null").distinct().withColumn("k", F.monotonically_increasing_id()))
    return names, keys.join(names.withColumnRenamed("k", "q"), ["roster_id", "lookup"]).select("k", "q")


def rule_pairs(keys: DataFrame, roster: DataFrame, variants: Variants, mode: str = "auto") -> DataFrame:
    """(roster_id, k, pos, id, db_name, match_type, quality, reversed) of all pairs with a rule; keys have (roster_id, k, lookup)."""
    names, of = asked_names(keys)
    pairs = settle(_rule_pairs(names, roster, variants, mode))
    return of.join(pairs.withColumnRenamed("k", "q"), "q").select(pairs.columns)


def best_by_rules(keys: DataFrame, roster: DataFrame, variants: Variants, mode: str = "auto") -> DataFrame:
    """What :func:`pick_best` gives of :func:`rule_pairs`, picked once a name that is asked for."""
    names, of = asked_names(keys)
    best = settle(pick_best(_rule_pairs(names, roster, variants, mode)))
    return of.join(best.withColumnRenamed("k", "q"), "q").select(best.columns)


def _rule_pairs(keys: DataFrame, roster: DataFrame, variants: Variants, mode: str) -> DataFrame:
    names = described(keys.select("roster_id", "k", "lookup"), F.col("lookup"), "n")
    names = with_forms(names, {"n_word": F.col("n.word")}, variants)
    names = with_forms(names, {"n_firstname": F.col("n.firstname"), "n_rev_firstname": F.col("n.rev_firstname")}, variants, False)
    names = settle(names.withColumn("forms", F.transform("n_word.possible", lambda x: F.lower(x))).drop("n_word"))
    people = settle(described(name_index(roster), F.col("full_name"), "d", ("word", "surname", "firstname", "full")))
    # Exploded, so that the rules are evaluated once and not again for each of their results.
    rule = F.explode(F.array(rules())).alias("r")
    found = matching_pairs(names, people, mode).select("roster_id", "k", "pos", "id", "full_name", rule).filter("r is not null")
    return found.select("roster_id", "k", "pos", "id", F.col("full_name").alias("db_name"), "r.match_type", "r.quality", "r.reversed")


def pick_best(pairs: DataFrame) -> DataFrame:
    """(k, id, match_type, quality, reversed, db_name, all_matches); two best within 5 points leave the choice open."""
    w = Window.partitionBy("k").orderBy(F.desc("quality"), "pos")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
    item = F.struct("rank", F.struct("id", "db_name", "quality", "match_type", "reversed").alias("m"))
    best = ranked.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["m"]).alias("all_matches"))
    first, second = F.get("all_matches", F.lit(0)), F.get("all_matches", F.lit(1))
    open_ = F.coalesce(first["quality"] - second["quality"] < 5, F.lit(False))
    return best.select(
        "k", F.when(~open_, first["id"]).alias("id"), F.when(open_, "multiple-matches").otherwise(first["match_type"]).alias("match_type"), F.when(open_, 0).otherwise(first["quality"]).alias("quality"),
        F.when(open_, False).otherwise(first["reversed"]).alias("reversed"), F.when(~open_, first["db_name"]).alias("db_name"), F.col("all_matches").cast(MATCH).alias("all_matches"),
    )


def one_word_names(keys: DataFrame, roster: DataFrame, variants: Variants) -> ambiguity.Evidence:
    """What splits and possible matches the distinct one-word names of keys have."""
    names = keys.filter(ambiguity.is_one_word(F.col("name"))).select("roster_id", "name").withColumn("real_name", F.lit(None).cast("string"))
    return ambiguity.gather(distinct_keys(names), roster, variants)


def resolve(keys: DataFrame, roster: DataFrame, variants: Variants, mode: str = "auto", evidence: ambiguity.Evidence | None = None) -> DataFrame:
    """M2-M18 for distinct keys (roster_id, name, real_name, k): (k, id, match_type, quality, reversed, db_name, all_matches)."""
    index = name_index(roster).select("roster_id", F.col("full_name").alias("db_name"), F.col("id"))
    evidence = evidence or one_word_names(keys, roster, variants)
    found = ambiguity.ambiguous(evidence.keys, roster, variants, evidence).join(evidence.keys.select("roster_id", "name", "k"), "k")
    ambiguous = keys.select("roster_id", "name", "k").join(found.drop("k"), ["roster_id", "name"])
    exact = index.select("roster_id", F.col("db_name").alias("name"), F.col("id").alias("exact_id"))
    tag = index.select("roster_id", F.col("db_name").alias("real_name"), F.col("id").alias("tag_id"))
    nick = nickname_index(roster).select("roster_id", "nick", F.col("id").alias("nick_id"))
    first_name = name_index(roster).groupBy("roster_id", F.col("id").alias("nick_id")).agg(F.min_by("full_name", "pos").alias("nick_name"))
    rows = keys.withColumn("nick", F.lower(F.coalesce("real_name", "name")))
    rows = rows.join(exact, ["roster_id", "name"], "left").join(tag, ["roster_id", "real_name"], "left").join(nick, ["roster_id", "nick"], "left").join(first_name, ["roster_id", "nick_id"], "left")
    rows = rows.join(ambiguous.select("k", F.col("all_matches").alias("possible")), "k", "left")
    kind = F.when(F.col("possible").isNotNull(), "ambiguous-name").when(F.col("exact_id").isNotNull(), "exact-match").when(F.col("tag_id").isNotNull(), "real-name-tag").when(F.col("nick_id").isNotNull(), "nickname-match")
    rows = settle(rows.withColumn("match_type", kind))
    early = rows.filter("match_type is not null").select(
        "k", F.when(F.col("match_type") == "exact-match", F.col("exact_id")).when(F.col("match_type") == "real-name-tag", F.col("tag_id")).when(F.col("match_type") == "nickname-match", F.col("nick_id")).alias("id"),
        "match_type", F.when(F.col("match_type") == "exact-match", 100).when(F.col("match_type") == "real-name-tag", 99).when(F.col("match_type") == "nickname-match", 97).otherwise(0).alias("quality"),
        F.lit(False).alias("reversed"), F.when(F.col("match_type") == "exact-match", F.col("name")).when(F.col("match_type") == "real-name-tag", F.col("real_name")).when(F.col("match_type") == "nickname-match", F.col("nick_name")).alias("db_name"),
        F.when(F.col("match_type") == "ambiguous-name", F.col("possible")).cast(MATCH).alias("all_matches"),
    )
    rest = rows.filter("match_type is null").select("roster_id", "k", F.coalesce("real_name", "name").alias("lookup"))
    best = best_by_rules(rest, roster, variants, mode)
    late = rest.select("k").join(best, "k", "left").select("k", "id", F.coalesce("match_type", F.lit("not-found")).alias("match_type"), F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("reversed", F.lit(False)).alias("reversed"), "db_name", "all_matches")
    return early.unionByName(late)


def manual(looked: DataFrame, overrides: DataFrame, roster: DataFrame) -> DataFrame:
    """M1: (chat_id, name, manual_id) from (chat_id or null for all, name, id or roster name); the id must exist in the chat's roster."""
    rows = looked.select("chat_id", "roster_id", "name").join(overrides.select(F.col("chat_id").alias("only"), "name", F.col("id").alias("given")), "name")
    rows = rows.filter("only is null or only = chat_id")
    ids = roster.select("roster_id", F.col("id").alias("given"), F.col("id").alias("by_id")).distinct()
    names = name_index(roster).select("roster_id", F.col("full_name").alias("given"), F.col("id").alias("by_name"))
    rows = rows.join(ids, ["roster_id", "given"], "left").join(names, ["roster_id", "given"], "left")
    rows = rows.withColumn("manual_id", F.coalesce("by_name", "by_id")).filter("manual_id is not null")
    return rows.groupBy("chat_id", "name").agg(F.max_by("manual_id", F.struct(F.col("only").isNotNull(), "manual_id")).alias("manual_id"))


def match_names(people: DataFrame, aliases: DataFrame, roster: DataFrame, variants: Variants, overrides: DataFrame | None = None, mode: str = "auto") -> DataFrame:
    """(chat_id, roster_id, name, first_seq, ord, real_name, id, match_type, quality, reversed, db_name, all_matches, auto_matched); unrecognised names have no id."""
    return match_with_evidence(people, aliases, roster, variants, overrides, mode)[0]


def match_with_evidence(
    people: DataFrame, aliases: DataFrame, roster: DataFrame, variants: Variants, overrides: DataFrame | None = None, mode: str = "auto"
) -> tuple[DataFrame, ambiguity.Evidence]:
    """The result of :func:`match_names`, and what was found out about one-word names, for automatic assignment."""
    looked = settle(lookups(people, aliases))
    keys = distinct_keys(looked)
    evidence = one_word_names(keys, roster, variants)
    found = settle(resolve(keys, roster, variants, mode, evidence))
    rows = looked.join(keys.select("roster_id", "name", F.col("real_name").alias("rn"), "k"), (looked["roster_id"] == keys["roster_id"]) & (looked["name"] == keys["name"]) & looked["real_name"].eqNullSafe(F.col("rn")), "left").select(looked["*"], "k")
    rows = rows.join(found, "k", "left").drop("k")
    if overrides is not None:
        rows = rows.join(manual(looked, overrides, roster), ["chat_id", "name"], "left")
        by_hand = F.col("manual_id").isNotNull()
        rows = rows.select(
            "chat_id", "roster_id", "name", "first_seq", "ord", "real_name", F.coalesce("manual_id", "id").alias("id"), F.when(by_hand, "manual-assignment").otherwise(F.col("match_type")).alias("match_type"),
            F.when(by_hand, 100).otherwise(F.col("quality")).alias("quality"), F.when(by_hand, False).otherwise(F.col("reversed")).alias("reversed"), F.when(~by_hand, F.col("db_name")).alias("db_name"), F.when(~by_hand, F.col("all_matches")).alias("all_matches"),
        )
    columns = ("chat_id", "roster_id", "name", "first_seq", "ord", "real_name", "id", "match_type", "quality", "reversed", "db_name", "all_matches")
    return rows.select(*columns, F.lit(False).alias("auto_matched")), evidence


def unrecognised(matches: DataFrame) -> DataFrame:
    """Names without an id."""
    return matches.filter("id is null")


def select_alternative(matches: DataFrame, choices: DataFrame) -> DataFrame:
    """(chat_id, name, k): the k-th (from 0) of a name's candidates becomes its match, its type ending in ``-selected``."""
    rows = matches.join(choices.select("chat_id", "name", F.col("k").alias("pick")), ["chat_id", "name"], "left")
    chosen = F.get("all_matches", F.col("pick"))
    has = chosen.isNotNull()
    changed = {"id": chosen["id"], "match_type": F.concat(F.coalesce(chosen["match_type"], F.lit("alternative")), F.lit("-selected")), "quality": chosen["quality"], "reversed": F.coalesce(chosen["reversed"], F.lit(False)), "db_name": chosen["db_name"]}
    return rows.select(*[F.when(has, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in matches.columns])


def rematch(matches: DataFrame, people: DataFrame, aliases: DataFrame, roster: DataFrame, changed: DataFrame, variants: Variants, overrides: DataFrame | None = None, mode: str = "auto") -> DataFrame:
    """Results of chats whose roster is among ``changed`` (roster_id) are made anew, automatic assignment included; the others stay."""
    from .assign import auto_match  # which needs this module

    ids = changed.select("roster_id").distinct()
    again, people_of = people.join(ids, "roster_id", "left_semi"), roster.join(ids, "roster_id", "left_semi")
    found, evidence = match_with_evidence(again, aliases, people_of, variants, overrides, mode)
    fresh = auto_match(settle(found), people_of, variants, evidence=evidence)
    return matches.join(ids, "roster_id", "left_anti").select(matches.columns).unionByName(fresh)
