"""Pairs of chat names and roster rows that may match.

Strings are compared, not rows: the distinct parts of names with the distinct parts of their roster's people, in each script that the rules
look at. Which pairs of strings are alike then gives the pairs of rows. A roster of few strings is compared with all names that are asked
of it; for a large one keys find the same pairs: a string cut into one piece more than the edits allowed keeps a piece
unchanged, so that a similar string holds that piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import has_cyrillic, latin_variants, split_name
from ..functions.text import col, near_lengths
from ..storage import settle, spread

PARTS = ("word", "surname", "firstname", "rev_surname", "rev_firstname", "full")


def described(df: DataFrame, source: Column, prefix: str, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """With a struct of the name's parts, and one of their Latin spellings (for Cyrillic parts)."""
    n = split_name(source)
    df = df.withColumn(prefix, F.struct(*[(source if p == "full" else n[p]).alias(p) for p in parts]))
    return df.withColumn(f"{prefix}_latin", F.struct(*[latin_variants(F.coalesce(F.col(f"{prefix}.{p}"), F.lit(""))).alias(p) for p in parts]))


def edits_allowed(length: Column, threshold: float) -> Column:
    """Most edits between a roster string of that length and a string that is similar enough."""
    return F.floor(F.lit(1 - threshold) * F.floor(length / F.lit(threshold) + F.lit(1e-9)) + F.lit(1e-9)).cast("int")


def _edits(x: Column, y: Column, threshold: float) -> Column:
    """Most edits between two strings of these lengths that are similar enough."""
    return F.floor(F.lit(1 - threshold) * F.greatest(x, y) + F.lit(1e-9)).cast("int")


def segments(c: Column | str, threshold: float) -> Column:
    """The string's pieces as structs (size of the string, pieces, number, piece): one piece more than the edits allowed, which depends on how long the other string is."""
    x = col(c)
    n = F.length(x)
    start = lambda i, pieces: F.floor(i * n / pieces).cast("int")
    piece = lambda i, pieces: F.substring(x, start(i, pieces) + 1, start(i + 1, pieces) - start(i, pieces))
    cut = lambda pieces: F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.struct(n.alias("size"), pieces.alias("pieces"), i.alias("no"), piece(i, pieces).alias("piece")))
    least = F.floor(F.lit(1 - threshold) * n + F.lit(1e-9)).cast("int")
    return F.flatten(F.transform(F.sequence(least + 1, F.greatest(edits_allowed(n, threshold), least) + 1), cut))


def probes(c: Column | str, threshold: float) -> Column:
    """Every substring of the string that may be a piece of a similar one, as structs (size, pieces, number, piece).

    Of the pieces that a similar string keeps, one has as many edits before it, at most, as pieces before it, and as many behind it, at most, as pieces behind it; that bounds where
    it stands from either end.
    """
    x = col(c)
    n = F.length(x)
    low = F.greatest(F.lit(1), F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int"))
    high = F.greatest(low, F.floor(n / F.lit(threshold) + F.lit(1e-9)).cast("int"))

    def of_size(size: Column) -> Column:
        pieces = _edits(n, size, threshold) + 1
        start = lambda i: F.floor(i * size / pieces).cast("int")

        def of_piece(i: Column) -> Column:
            length = start(i + 1) - start(i)
            behind = pieces - 1 - i
            first = F.greatest(F.lit(0), start(i) - i, start(i) + n - size - behind)
            last = F.least(n - length, start(i) + i, start(i) + n - size + behind)
            places = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda p: F.struct(size.alias("size"), pieces.alias("pieces"), i.alias("no"), F.substring(x, p + 1, length).alias("piece")))

        return F.flatten(F.transform(F.sequence(F.lit(0), pieces - 1), of_piece))

    return F.array_distinct(F.flatten(F.transform(F.sequence(low, high), of_size)))


def bag(c: Column | str) -> Column:
    """The letters of a text as bits, in 21 classes: one bit for the first of a class, one for the second, one for all further ones. Rarer bits are the lower ones."""
    x = col(c)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def add(acc: Column, letter: Column) -> Column:
        first, second, more = (F.call_function("shiftleft", one, F.pmod(F.ascii(letter), F.lit(21)) + at) for at in (42, 21, 0))
        return acc.bitwiseOR(F.when(acc.bitwiseAND(first) == 0, first).when(acc.bitwiseAND(second) == 0, second).otherwise(more))

    return F.aggregate(F.filter(F.split(x, ""), lambda l: l != ""), zero, add)


def shared(x: Column, y: Column, bx: Column, by: Column) -> Column:
    """At most so many letters of one text are also in the other; an edit distance is at least what the longer one has besides."""
    return F.bit_count(bx.bitwiseAND(by)) + F.least(F.length(x) - F.bit_count(bx), F.length(y) - F.bit_count(by))


def may_be_alike(x: Column, y: Column, bx: Column, by: Column, threshold: float | Column) -> Column:
    """Whether lengths and letters allow a similarity of ``threshold``: some operations on numbers, and never wrong."""
    return near_lengths(x, y, threshold) & (shared(x, y, bx, by) >= F.lit(threshold) * F.greatest(F.length(x), F.length(y)) - F.lit(1e-9))


def alike(x: Column, y: Column, threshold: float) -> Column:
    """Whether two lower-case texts have a similarity of ``threshold``; edits are counted only as far as that allows."""
    longest = F.greatest(F.length(x), F.length(y))
    most = F.floor(F.lit(1 - threshold) * longest + F.lit(1e-9)).cast("int")
    edits = F.call_function("levenshtein", x, y, most)
    return near_lengths(x, y, threshold) & ((x == y) | ((edits >= 0) & (1 - edits / longest >= threshold)))


def rare_letters(x: Column, b: Column, threshold: float | Column) -> Column:
    """The bits of a text (:func:`bag`) of which a similar text has one: so many, rarest first, that the others are too few for ``threshold``."""
    held = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: b.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    besides = F.length(x) - F.bit_count(b)  # letters without a bit of their own
    need = F.greatest(F.ceil(F.lit(threshold) * F.length(x) - F.lit(1e-9)).cast("int") - besides, F.lit(1))
    return F.slice(held, F.lit(1), F.greatest(F.size(held) - need + 1, F.lit(1)))


#: From this similarity on pieces of strings are long enough to be selective; below rare letters are.
PIECES_FROM = 0.7


def _by_keys(left: DataFrame, right: DataFrame, on: list[str], threshold: float, least: Column) -> DataFrame:
    """Pairs of strings ``s`` (with bits ``bs``) and ``t`` (``bt``), equal in ``on``, with a common piece or a common rare letter; the same pair may come several times."""
    if threshold >= PIECES_FROM:
        probe = left.withColumn("piece", F.explode(probes("s", threshold)))
        return probe.join(right.withColumn("piece", F.explode(segments("t", threshold))), [*on, "piece"]).drop("piece")
    probe = left.withColumn("letter", F.explode(rare_letters(F.col("s"), F.col("bs"), least)))
    both = F.col("bs").bitwiseAND(F.col("bt"))
    met = probe.join(right.withColumn("letter", F.explode(rare_letters(F.col("t"), F.col("bt"), threshold))), [*on, "letter"])
    # Each pair once: at the rarest letter that both have.
    return met.filter(both.bitwiseAND(-both) == F.call_function("shiftleft", F.lit(1).cast("long"), F.col("letter"))).drop("letter")


def by_size(left: DataFrame, right: DataFrame, mode: str, few: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The strings to compare with all of their roster, and those to look for by keys: rosters of up to ``few`` strings ``t`` are small (``mode='auto'``); with 'small' all are, with 'large' none."""
    if mode == "auto" and right.count() <= few:
        mode = "small"
    if mode != "auto":
        return (left, None) if mode == "small" else (None, left)
    large = settle(right.groupBy("roster_id").agg(F.count_distinct("t").alias("n")).filter(F.col("n") > few).select("roster_id"))
    if large.isEmpty():
        return left, None
    return left.join(large, "roster_id", "left_anti"), left.join(large, "roster_id", "left_semi")


def _paired(left: DataFrame, right: DataFrame, on: list[str], threshold: float, mode: str, few: int) -> DataFrame:
    """Pairs that lengths and letters allow; ``left`` may have a column ``least``, a higher threshold of its own."""
    # Spread and written, so that letters are made bits once a string and pairs are compared in many tasks.
    left, right = spread(left.withColumn("bs", bag("s")), "roster_id", "s"), settle(right.withColumn("bt", bag("t")))
    least = F.greatest(F.lit(threshold), "least") if "least" in left.columns else F.lit(threshold)
    test = may_be_alike(F.col("s"), F.col("t"), F.col("bs"), F.col("bt"), least)
    small, large = by_size(left, right, mode, few)
    found = [] if small is None else [small.join(right, on).filter(test)]
    if large is not None:
        found.append(_by_keys(settle(large), right, on, threshold, least).filter(test))
    return (found[0] if len(found) == 1 else found[0].unionByName(found[1])).drop("bs", "bt")


def _measured(pairs: DataFrame, least: Column) -> DataFrame:
    """(roster_id, s, t, similarity) of the pairs that are ``least`` alike."""
    s, t = F.col("s"), F.col("t")
    longest = F.greatest(F.length(s), F.length(t))
    most = F.floor((1 - least) * longest + F.lit(1e-9)).cast("int")
    rows = pairs.withColumn("edits", F.when(s == t, 0).otherwise(F.call_function("levenshtein", s, t, most)))
    rows = rows.filter("edits >= 0").withColumn("similarity", F.when(F.col("edits") == 0, 1.0).otherwise(1 - F.col("edits") / longest))
    return rows.filter(F.col("similarity") >= least).select("roster_id", "s", "t", "similarity")


def alike_strings(left: DataFrame, right: DataFrame, threshold: float, mode: str = "auto", few: int = 2000) -> DataFrame:
    """(roster_id, s, t, similarity) of distinct lower-case strings (roster_id, s) and (roster_id, t) that are ``threshold`` alike, or as much as ``least`` of ``left`` asks, if it has that column."""
    least = F.greatest(F.lit(threshold), "least") if "least" in left.columns else F.lit(threshold)
    left, right = left.filter("s <> ''"), right.filter("t <> ''").distinct()
    left = left.groupBy("roster_id", "s").agg(F.min("least").alias("least")) if "least" in left.columns else left.distinct()
    return _measured(_paired(left, right, ["roster_id"], threshold, mode, few), least).distinct()


def _forms(strings: DataFrame, name: str, own: str, other: str) -> DataFrame:
    """Each string in lower case with its script, and where scripts meet: Latin spellings of a Cyrillic string beside the Latin strings of the other side."""
    x = F.col(name)
    form = lambda g, s: F.struct(F.lit(g).alias("g"), s.alias("s"))
    spelled = F.transform(latin_variants(x), lambda v: form(own, F.lower(v)))
    each = F.when(has_cyrillic(x), F.concat(F.array(form("cyrillic", F.lower(x))), spelled)).otherwise(F.array(form("latin", F.lower(x)), form(other, F.lower(x))))
    return strings.select("roster_id", name, F.explode(F.array_distinct(each)).alias("f")).select("roster_id", name, "f.g", "f.s").filter("s <> ''")


def similar_strings(left: DataFrame, right: DataFrame, threshold: float, mode: str = "auto", few: int = 2000) -> DataFrame:
    """(roster_id, a, b) of distinct strings (roster_id, a) and (roster_id, b) that match as :func:`translit_match` has it.

    In rosters of up to ``few`` strings (``mode='auto'``; in all with 'small', in none with 'large') all are compared, in others those with a common piece.
    """
    left, right = _forms(left.filter("a <> ''").distinct(), "a", "left", "right"), _forms(right.filter("b <> ''").distinct(), "b", "right", "left").withColumnRenamed("s", "t")
    pairs = _paired(left, right, ["roster_id", "g"], threshold, mode, few).filter(alike(F.col("s"), F.col("t"), threshold))
    return pairs.select("roster_id", "a", "b").distinct()


def matching_pairs(names: DataFrame, people: DataFrame, mode: str = "auto") -> DataFrame:
    """The pairs that any rule may accept: equal surnames are within the similar ones, so that three relations of strings and one of dictionary forms find all."""
    asked = {
        "surname": F.array("n.surname", "n.rev_surname", "n.word"),  # each rule on two parts wants similar surnames
        "firstname": F.array("n.word"),
        "full": F.array("n.full"),
    }
    found = []
    for part, parts in asked.items():
        own = names.select("roster_id", "k", F.explode(F.array_distinct(parts)).alias("a")).filter("a is not null")
        other = people.select("roster_id", "pos", F.col(f"d.{part}").alias("b")).filter("b is not null")
        same = settle(similar_strings(own.select("roster_id", "a"), other.select("roster_id", "b"), 0.70 if part == "full" else 0.75, mode))
        found.append(own.join(same, ["roster_id", "a"]).join(other, ["roster_id", "b"]).select("roster_id", "k", "pos"))
    forms = names.filter("n.word is not null").select("roster_id", "k", F.explode("forms").alias("f"))
    found.append(forms.join(people.select("roster_id", "pos", F.lower("d.firstname").alias("f")), ["roster_id", "f"]).select("roster_id", "k", "pos"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return spread(every.distinct(), "k", "pos").join(names, ["roster_id", "k"]).join(people, ["roster_id", "pos"])
