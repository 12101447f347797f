"""The dictionary of name variants (N10-N13), as a Python dictionary of some thousand names at most, or as a table (variant, standard_form) of any size.

A small dictionary becomes part of the expressions. A table is joined: words meet its entries by equality, by prefixes (of words, and of entries), and, where a word
has no entry, by similarity over 0.7, for which pieces of strings are the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import possible_forms, russian_to_ukrainian, standard_form
from ..storage import settle
from .candidates import alike_strings

Variants = dict[str, str] | DataFrame
NONE = "cast(array() as array<string>)"


def entries(table: DataFrame) -> DataFrame:
    """(k, v): each variant in lower case with its form, of repeated ones that with the largest ``pos`` (without that column, the largest form). Empty ones are left out."""
    order = F.struct("pos", "standard_form") if "pos" in table.columns else F.col("standard_form")
    rows = table.filter("standard_form is not null").withColumn("k", F.lower("variant")).filter("k <> ''")
    return rows.groupBy("k").agg(F.max_by("standard_form", order).alias("v"))


def _prefixes(c: str) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n)))


def meanings(word: Column, direct: Column, other: Column, other_form: Column) -> Column:
    """The words of which a lower-case word is a variant: itself, and its dictionary form, or that of its Ukrainian spelling."""
    own = F.coalesce(direct, word)
    more = F.when(own != word, F.array(own)).when(other != word, F.array(other_form)).otherwise(F.expr(NONE))
    return F.filter(F.array_distinct(F.concat(F.array(word), more)), lambda w: w != "")


def look_up(words: DataFrame, table: DataFrame, with_possible: bool = True) -> DataFrame:
    """(w, form, means, possible) of distinct lower-case words (w): the dictionary's form or the word, what it is a variant of, and the forms it may have."""
    known, words = settle(entries(table)), settle(words.filter("w <> ''").distinct())
    direct = words.join(known.select(F.col("k").alias("w"), F.col("v").alias("direct")), "w", "left").withColumn("other", russian_to_ukrainian("w"))
    both = settle(direct.join(known.select(F.col("k").alias("other"), F.col("v").alias("by_other")), "other", "left"))
    out = both.select("w", F.coalesce("direct", "w").alias("form"), meanings(F.col("w"), F.col("direct"), F.col("other"), F.coalesce("by_other", "other")).alias("means"), "direct")
    if not with_possible:
        return out.select("w", "form", "means", F.expr(NONE).alias("possible"))
    rest = both.filter("direct is null").select("w")
    longer = rest.select("w", _prefixes("w").alias("k")).join(known, "k").select("w", "v")
    shorter = rest.join(known.select(_prefixes("k").alias("w"), "v"), "w").select("w", "v")
    one = F.lit("").alias("roster_id")
    close = alike_strings(rest.select(one, F.col("w").alias("s")), known.select(one, F.col("k").alias("t")), 0.7).filter("similarity > 0.7")
    close = close.join(known.withColumnRenamed("k", "t"), "t").select(F.col("s").alias("w"), "v")
    forms = longer.unionByName(shorter).unionByName(close).groupBy("w").agg(F.collect_set("v").alias("forms"))
    possible = F.when(F.col("direct").isNotNull(), F.array("direct")).otherwise(F.coalesce("forms", F.expr(NONE)))
    return out.join(forms, "w", "left").select("w", "form", "means", possible.alias("possible"))


def with_forms(df: DataFrame, words: dict[str, Column], variants: Variants, with_possible: bool = True) -> DataFrame:
    """The table with a struct column (form, means, possible) for each of ``words`` (name of the column: word); of null and empty words they are '' and empty."""
    empty = F.expr(NONE)
    if isinstance(variants, dict):
        for name, word in words.items():
            x = F.lower(F.coalesce(word, F.lit("")))
            other = russian_to_ukrainian(x)
            form = standard_form(x, variants)
            possible = possible_forms(x, variants) if with_possible else empty
            df = df.withColumn(name, F.struct(form.alias("form"), meanings(x, form, other, standard_form(other, variants)).alias("means"), possible.alias("possible")))
        return df
    df = df.withColumns({f"{name}_w": F.lower(F.coalesce(word, F.lit(""))) for name, word in words.items()})
    asked = df.select(F.explode(F.array(*[F.col(f"{name}_w") for name in words])).alias("w"))
    found = settle(look_up(asked, variants, with_possible))
    for name in words:
        own = found.select(F.col("w").alias(f"{name}_w"), F.struct("form", "means", "possible").alias(name))
        none = F.struct(F.lit("").alias("form"), empty.alias("means"), empty.alias("possible"))
        df = df.join(own, f"{name}_w", "left").withColumn(name, F.coalesce(name, none)).drop(f"{name}_w")
    return df
