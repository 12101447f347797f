"""Several roster rows for one name (M19-M21): glued names, possible matches, and whether a one-word name is ambiguous."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import ONE_WORD, in_order, lcs_length, letters_only, order_ratio, to_cyrillic
from ..functions.text import likeness, words
from ..storage import settle, spread
from .candidates import alike_strings
from .dictionary import Variants, with_forms
from .roster import name_index

LATIN = "[a-zA-Z]"


def is_one_word(c: Column) -> Column:
    return c.rlike(ONE_WORD)


def _people(roster: DataFrame) -> DataFrame:
    """Roster names with their lower-case words; ``first`` is the second word."""
    parts = words(F.lower("full_name"))
    return name_index(roster).select("roster_id", "pos", "id", F.col("full_name").alias("db_name"), F.lower("full_name").alias("db_lower"), parts.alias("parts"), F.get(parts, F.lit(1)).alias("first"))


def substrings(c: Column | str, most: Column) -> Column:
    """The distinct substrings of up to ``most`` characters."""
    x = F.col(c) if isinstance(c, str) else c
    n = F.length(x)
    of_size = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(x, i, size))
    sizes = F.least(n, most)
    return F.when(sizes > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), sizes), of_size)))).otherwise(F.array().cast("array<string>"))


def _suffixes(parts: DataFrame) -> DataFrame:
    """(roster_id, side, part, n, suffix, longer): every suffix of a part's letters, with the next longer one (null: it is the whole part); those of fewer than ``least`` letters are left out."""
    last = F.col("n") - F.greatest("least", F.lit(1)) + 1
    each = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.substring(F.col("p"), i, F.col("n")).alias("suffix"), F.when(i > 1, F.substring(F.col("p"), i - 1, F.col("n"))).alias("longer")))
    return parts.filter(last > 0).select("roster_id", "side", "part", "n", F.explode(each).alias("e")).select("roster_id", "side", "part", "n", "e.suffix", "e.longer")


def _within(forms: DataFrame, parts: DataFrame) -> DataFrame:
    """(roster_id, form, side, part, at, n, whole): where each distinct part of a roster's names (roster_id, side, part, least) begins in each form (roster_id, form,
    g): the place of its longest suffix that occurs, the part's length (letters only), and whether it occurs as it is.

    The form's substrings meet the suffixes of the parts by equality. Parts that leave the form at the same letter are one edge, so that
    the longest suffix is found once for all of them, and parts are only listed where they belong to the result.
    """
    parts = parts.withColumn("p", letters_only("part")).withColumn("n", F.length("p"))
    rows = _suffixes(parts).withColumn("edge", F.coalesce("longer", F.concat(F.lit("^"), "suffix")))
    most = parts.groupBy("roster_id").agg(F.max("n").alias("most"), F.max(F.when(F.col("n") == 0, F.length("part"))).alias("odd"))
    sized = forms.join(most, "roster_id")
    pieces = sized.select("roster_id", "form", "g", F.explode(substrings("g", F.col("most"))).alias("suffix"))
    edges = rows.select("roster_id", "side", "suffix", "longer", "edge").distinct()
    met = pieces.join(edges, ["roster_id", "suffix"]).filter(F.col("longer").isNull() | ~F.contains("g", F.coalesce("longer", "suffix")))
    met = met.select("roster_id", "form", "side", "edge", F.instr(F.col("g"), F.col("suffix")).alias("at"), F.col("longer").isNull().alias("full"))
    found = met.join(rows.select("roster_id", "side", "edge", "part", "n"), ["roster_id", "side", "edge"]).select("roster_id", "form", "side", "part", "at", "n", (F.col("full") & F.contains("form", F.col("part"))).alias("whole"))
    # Parts without any of these letters occur as they are or not at all.
    raw = sized.filter("odd is not null").select("roster_id", "form", F.explode(substrings("form", F.col("odd"))).alias("part"))
    whole = raw.join(parts.filter("n = 0").select("roster_id", "side", "part"), ["roster_id", "part"]).select("roster_id", "form", "side", "part", F.lit(None).cast("int").alias("at"), F.lit(0).alias("n"), F.lit(True).alias("whole"))
    return found.unionByName(whole)


def split_glued(keys: DataFrame, roster: DataFrame, min_suffix: int = 1) -> DataFrame:
    """(k, pos, id, db_name, q, combined) of names without spaces (from 6 letters) that a surname and firstname run together make; best row of each id, keys have (roster_id, k, name).

    Suffixes of one letter count, so that a name may have many rows: they are the result, and no others are made. ``min_suffix`` above 1 asks that as
    many last letters of the surname occur in the name, and loses only weaker pairs.
    """
    lower = F.lower("name")
    forms = F.when(F.col("name").rlike(LATIN), F.array_distinct(F.array(F.lower(to_cyrillic("name")), lower))).otherwise(F.array(lower))
    names = keys.filter(~F.contains("name", F.lit(" ")) & (F.length("name") >= 6)).select("roster_id", "k", F.posexplode(forms).alias("f", "form"))
    people = settle(_people(roster).filter(F.size("parts") >= 2).select("roster_id", "pos", "id", "db_name", F.get("parts", F.lit(0)).alias("surname"), F.array_join(F.slice("parts", F.lit(2), F.size("parts")), " ").alias("firstname")))
    every = settle(spread(names.select("roster_id", "form").distinct().withColumn("g", letters_only("form")), "roster_id", "form"))
    # Of surnames only suffixes from the last ``min_suffix`` characters on.
    tail = F.length(letters_only(F.substring(F.col("surname"), -min_suffix, min_suffix))) if min_suffix > 1 else F.lit(1)
    part = lambda c, least: F.struct(F.lit(c).alias("side"), F.col(c).alias("part"), least.alias("least"))
    parts = people.select("roster_id", F.inline(F.array(part("surname", tail), part("firstname", F.lit(1))))).distinct()
    found = settle(spread(_within(every, parts), "roster_id", "form", "side"))
    of = lambda c: found.filter(F.col("side") == c).select("roster_id", "form", F.col("part").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("at", "n", "whole")])
    surnames, firstnames = of("surname"), of("firstname")
    if min_suffix > 1:
        surnames = surnames.filter(F.contains("form", F.substring(F.col("surname"), -min_suffix, min_suffix)))
    pairs = surnames.join(people, ["roster_id", "surname"]).join(firstnames, ["roster_id", "form", "firstname"])
    inside = F.col("whole_surname") & F.col("whole_firstname")
    broken = in_order(F.col("at_surname"), F.col("n_surname"), F.col("at_firstname"), F.col("n_firstname"))
    glue = lambda *p: F.regexp_replace(F.concat(*p), r"[\p{IsWhite_Space}]+", "")
    ahead = F.when(inside, likeness("form", glue("surname", "firstname")))
    behind = F.when(inside, likeness("form", glue("firstname", "surname")))
    pairs = pairs.filter(inside | (broken["quality"] > 0.7)).withColumns({"ahead": ahead, "behind": behind, "broken": broken})
    rows = names.join(pairs, ["roster_id", "form"])
    item = lambda q, order, kind: F.struct(q.alias("q"), (-order).alias("o"), kind.alias("combined"))
    options = F.array(
        F.when(F.col("ahead") > 0.8, item(F.col("ahead"), F.col("f") * 3, F.lit("standard"))),
        F.when(F.col("behind") > 0.8, item(F.col("behind"), F.col("f") * 3 + 1, F.lit("reversed"))),
        F.when(F.col("broken.quality") > 0.7, item(F.col("broken.quality"), F.col("f") * 3 + 2, F.col("broken.type"))),
    )
    # The best option of each row, then of each id: both within one shuffle by (k, id).
    found = rows.withColumn("best", F.array_max(options)).filter("best is not null")
    best = F.max(F.struct(F.col("best.q").alias("q"), (-F.col("pos")).alias("p"), F.col("best.o").alias("o"), F.col("best.combined").alias("combined"), "db_name")).alias("best")
    return found.groupBy("k", "id").agg(best).select("k", (-F.col("best.p")).alias("pos"), "id", "best.db_name", F.col("best.q").alias("q"), "best.combined")


def spelled(keys: DataFrame, variants: Variants, with_possible: bool) -> DataFrame:
    """(roster_id, k, v): the forms of names that are looked up: with Latin letters the Cyrillic form and dictionary forms, else the dictionary form; and the name itself."""
    lower = F.lower("name")
    rows = with_forms(keys, {"d": lower}, variants, with_possible)
    known = F.when(F.col("d.form") != lower, F.array("d.form")).otherwise(F.array().cast("array<string>"))
    latin = F.concat(F.array(F.lower(to_cyrillic("name"))), known, F.col("d.possible"), F.array(lower))
    forms = F.array_distinct(F.when(F.col("name").rlike(LATIN), latin).otherwise(F.concat(F.array(lower), known)))
    return rows.select("roster_id", "k", F.explode(forms).alias("v"))


def meant(words: DataFrame, variants: Variants) -> DataFrame:
    """The rows of words (``v``), each with the words of which it is a variant (``p``)."""
    return with_forms(words, {"d": F.col("v")}, variants, False).withColumn("p", F.explode("d.means")).drop("d")


def _near_keys(c: str, asked: bool) -> Column:
    """Keys (length of a roster's word, first letter) of words that may have an order similarity over 0.85: the squared ratio of their lengths is above that, so that
    lengths are equal up to 12 letters; words of three letters may begin otherwise, but then only equal ones are so similar.
    """
    n = F.length(c)
    low = F.floor(n * F.lit(0.85**0.5) + F.lit(1e-9)).cast("int")
    high = F.ceil(n / F.lit(0.85**0.5) - F.lit(1e-9)).cast("int")
    sizes = F.sequence(F.greatest(low, F.lit(3)), F.greatest(high, F.lit(3))) if asked else F.array(n)
    keys = F.transform(sizes, lambda size: F.struct(size.alias("size"), F.substring(F.col(c), 1, 1).alias("letter")))
    return F.when(n >= 3, keys).otherwise(F.array().cast("array<struct<size:int,letter:string>>"))


def possible_matches(keys: DataFrame, roster: DataFrame, variants: Variants, splits: DataFrame | None = None) -> DataFrame:
    """(k, rank, id, db_name, quality, part): glued splits over 85 alone; else splits and exact names; else up to four similar ones."""
    splits = settle(split_glued(keys, roster)) if splits is None else splits
    one = keys.filter(is_one_word(F.col("name")) & (F.length("name") >= 6)).select("k")
    a = splits.join(one, "k", "left_semi").select("k", F.lit(1).alias("phase"), F.struct(-F.col("q"), F.col("pos").cast("long")).alias("o"), "id", "db_name", F.floor(F.col("q") * 100 + 0.5).cast("int").alias("quality"), F.concat(F.lit("split-name-"), F.col("combined")).alias("part"))
    top = a.groupBy("k").agg(F.max("quality").alias("top")).filter("top > 85").select("k")
    names = settle(spelled(keys.join(top, "k", "left_anti"), variants, True))
    people = _people(roster)
    # Exact names, and firstnames that only one person has.
    full = names.join(people.withColumn("v", F.col("db_lower")), ["roster_id", "v"]).select("k", F.lit(2).alias("phase"), F.struct(F.lit(0.0), F.col("pos").cast("long")).alias("o"), "id", "db_name", F.lit(100).alias("quality"), F.lit("full-name-exact").alias("part"))
    firsts = people.filter("first is not null").groupBy("roster_id", "first").agg(F.count("*").alias("n"), F.first("pos").alias("pos"), F.first("id").alias("id"), F.first("db_name").alias("db_name")).filter("n = 1")
    first = names.join(firsts.withColumnRenamed("first", "v"), ["roster_id", "v"]).select("k", F.lit(3).alias("phase"), F.struct(F.lit(0.0), F.col("pos").cast("long")).alias("o"), "id", "db_name", F.lit(95).alias("quality"), F.lit("firstname-exact").alias("part"))
    first = first.join(full.select("k", "db_name"), ["k", "db_name"], "left_anti").select(first.columns)
    exact = settle(a.unionByName(full).unionByName(first))
    # Variants and similar words, only for names without any of these; distinct words are compared.
    rest = settle(names.join(exact.select("k").distinct(), "k", "left_anti"))
    part = people.select("roster_id", "pos", "id", "db_name", F.posexplode("parts").alias("at", "p"))
    asked, parts = settle(rest.select("roster_id", "v").distinct()), settle(part.select("roster_id", "p").distinct())
    variant = meant(asked, variants).join(parts, ["roster_id", "p"]).select("roster_id", "v", "p", F.lit(True).alias("variant"), F.lit(None).cast("double").alias("s"))
    # The measure asks for much the same length, and of words from 4 letters for the same first letter: a key that loses none.
    near = asked.select("roster_id", "v", F.explode(_near_keys("v", True)).alias("near")).join(parts.select("roster_id", "p", F.explode(_near_keys("p", False)).alias("near")), ["roster_id", "near"])
    similar = near.withColumn("s", order_ratio(lcs_length("v", "p"), F.col("v"), F.col("p"))).filter("s > 0.85").join(variant.select("roster_id", "v", "p"), ["roster_id", "v", "p"], "left_anti")
    words_ = variant.unionByName(similar.select("roster_id", "v", "p", F.lit(False).alias("variant"), "s"))
    pairs = rest.join(words_, ["roster_id", "v"]).join(part, ["roster_id", "p"])
    where = F.when(F.col("at") == 0, "surname").otherwise("firstname")
    same = pairs.filter("variant").select("k", "pos", "id", "db_name", F.lit(90).alias("quality"), F.concat(where, F.lit("-variant")).alias("part"))
    close = pairs.filter("not variant").select("k", "pos", "id", "db_name", F.floor(F.col("s") * 90 + 0.5).cast("int").alias("quality"), F.concat(where, F.lit("-similar")).alias("part"))
    w = Window.partitionBy("k", "id").orderBy(F.desc("quality"), "pos")
    best = same.unionByName(close).withColumn("n", F.row_number().over(w)).filter("n = 1")
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("quality"), "pos"))).filter("n <= 4")
    late = best.select("k", F.lit(4).alias("phase"), F.struct(-F.col("quality").cast("double"), F.col("pos").cast("long")).alias("o"), "id", "db_name", "quality", "part")
    rank = F.row_number().over(Window.partitionBy("k").orderBy("phase", "o"))
    return exact.unionByName(late).withColumn("rank", rank).select("k", "rank", "id", "db_name", "quality", "part")


def as_matches(possible: DataFrame) -> DataFrame:
    """(k, all_matches) in rank order."""
    item = F.struct("rank", F.struct("id", "db_name", "quality", F.col("part").alias("match_type"), F.lit(False).alias("reversed")).alias("m"))
    return possible.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["m"]).alias("all_matches"))


@dataclass
class Evidence:
    """What is known of names (roster_id, name, k): glued splits (M21) and possible matches (M19), both by ``k``."""

    keys: DataFrame
    splits: DataFrame
    possible: DataFrame

    def extended(self, keys: DataFrame, roster: DataFrame, variants: Variants) -> Evidence:
        """For other keys of the same roster: names that are known aren't looked up again."""
        names = keys.select("roster_id", "name", "k")
        unknown = settle(names.join(self.keys, ["roster_id", "name"], "left_anti"))
        rest = None if unknown.isEmpty() else gather(unknown, roster, variants)
        known = names.join(self.keys.select("roster_id", "name", F.col("k").alias("old")), ["roster_id", "name"]).select("k", "old")
        again = lambda df: df.withColumnRenamed("k", "old").join(known, "old").select(df.columns)
        splits, possible = again(self.splits), again(self.possible)
        return Evidence(keys, splits, possible) if rest is None else Evidence(keys, splits.unionByName(rest.splits), possible.unionByName(rest.possible))


def gather(keys: DataFrame, roster: DataFrame, variants: Variants) -> Evidence:
    """Splits and possible matches of keys (roster_id, name, k), each computed once and written."""
    splits = settle(split_glued(keys, roster))
    return Evidence(keys, splits, settle(possible_matches(keys, roster, variants, splits)))


def ambiguous(keys: DataFrame, roster: DataFrame, variants: Variants, evidence: Evidence | None = None) -> DataFrame:
    """(k, all_matches) of one-word names that fit several rows; the candidates are those of M19.

    Firstnames are looked up by what a name may mean: itself, its dictionary form, and firstnames so close (0.95) that keys find them.
    """
    one = keys.filter(is_one_word(F.col("name")))
    evidence = evidence or gather(one, roster, variants)
    count = evidence.splits.groupBy("k").agg(F.count("*").alias("splits"), F.max("q").alias("q"))
    names = settle(spelled(one, variants, False))
    people = _people(roster).filter("first is not null")
    firsts = people.groupBy("roster_id", "first").agg(F.count_distinct(F.get("parts", F.lit(0))).alias("surnames"), F.count("*").alias("rows"))
    firsts = settle(firsts.filter((F.col("rows") > 1) & (F.col("surnames") > 1)).select("roster_id", "first"))
    same = meant(names, variants).withColumnRenamed("p", "first").join(firsts, ["roster_id", "first"], "left_semi").select("k")
    close = alike_strings(names.select("roster_id", F.col("v").alias("s")), firsts.select("roster_id", F.col("first").alias("t")), 0.95).filter("similarity > 0.95")
    close = names.join(close.select("roster_id", F.col("s").alias("v")), ["roster_id", "v"], "left_semi").select("k")
    shared = same.unionByName(close).distinct().withColumn("shared", F.lit(True))
    many = evidence.possible.groupBy("k").agg(F.count("*").alias("possible"))
    rows = one.select("k").join(count, "k", "left").join(shared, "k", "left").join(many, "k", "left")
    clear = (F.col("splits") == 1) & (F.col("q") > 0.9)
    yes = F.when(clear, False).when(F.col("splits") > 1, True).when(F.col("shared"), True).otherwise(F.coalesce(F.col("possible") > 1, F.lit(False)))
    rows = rows.filter(yes).select("k").join(as_matches(evidence.possible), "k", "left")
    return rows.select("k", F.coalesce("all_matches", F.expr("cast(array() as array<struct<id:string,db_name:string,quality:int,match_type:string,reversed:boolean>>)")).alias("all_matches"))


def related(keys: DataFrame, roster: DataFrame, variants: Variants) -> DataFrame:
    """The ``k`` of keys (roster_id, name, k) to which any person of the roster may matter in M19-M21: as a split, full name, firstname, variant or similar word."""
    splits = split_glued(keys, roster).select("k")
    names, people = settle(spelled(keys, variants, True)), _people(roster)
    part = settle(people.select("roster_id", F.explode(F.concat("parts", F.array("db_lower"))).alias("p")).distinct())
    asked = settle(names.select("roster_id", "v").distinct())
    # A word's meanings hold the word itself.
    same = meant(asked, variants).join(part, ["roster_id", "p"], "left_semi").select("roster_id", "v")
    near = asked.select("roster_id", "v", F.explode(_near_keys("v", True)).alias("near")).join(part.select("roster_id", "p", F.explode(_near_keys("p", False)).alias("near")), ["roster_id", "near"])
    near = near.filter(order_ratio(lcs_length("v", "p"), F.col("v"), F.col("p")) > 0.85).select("roster_id", "v")
    close = alike_strings(asked.withColumnRenamed("v", "s"), part.withColumnRenamed("p", "t"), 0.95).select("roster_id", F.col("s").alias("v"))
    found = names.join(same.unionByName(near).unionByName(close).distinct(), ["roster_id", "v"], "left_semi").select("k")
    return splits.unionByName(found).distinct()
