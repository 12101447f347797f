"""A dictionary of names as a table gives what the small one gives, at any size."""

import random

import pytest
from pyspark.sql import functions as F

from rollcall.functions.names import load_variants
from rollcall.operators import dictionary, match
from test_model import FIR, SUR, VARIANTS, likeness, names

COLUMNS = "variant string, standard_form string, pos int"
WORDS = ["саша", "саш", "сашко", "оля", "о", "olya", "ольга", "олья", "міша", "мишa", "мыша", "ваня", "ванька", "", None, "невідомий", "люда", "люд", "таня", "щось", "эля", "ёлка"]
MORE = {**VARIANTS, "еля": "елла", "йолка": "ялина", "люда": "людмила", "людка": "людмила", "таня": "Тетяна", "миша": "михайло"}


def table_of(spark, variants):
    return spark.createDataFrame([(k.title(), v, n) for n, (k, v) in enumerate(variants.items())], COLUMNS)


def forms_of(spark, variants, with_possible=True):
    df = spark.createDataFrame([(w,) for w in WORDS], "x string")
    rows = dictionary.with_forms(df, {"d": F.col("x")}, variants, with_possible).collect()
    return sorted(((r.x, r.d.form, r.d.means, sorted(r.d.possible)) for r in rows), key=repr)


@pytest.mark.parametrize("with_possible", [True, False])
def test_table_equals_dictionary(spark, with_possible):
    assert forms_of(spark, MORE, with_possible) == forms_of(spark, table_of(spark, MORE), with_possible)


def test_repeated_and_empty_entries(spark):
    rows = [("Женя", "євген", 1), ("женя", "євгенія", 2), ("", "x", 3), (None, "y", 4), ("z", None, 5)]
    table = spark.createDataFrame(rows, COLUMNS)
    assert {(r.k, r.v) for r in dictionary.entries(table).collect()} == {("женя", "євгенія")} and load_variants(table) == {"женя": "євгенія"}
    none = dictionary.look_up(spark.createDataFrame([("женя",)], "w string"), table.filter("false")).collect()
    assert [(r.w, r.form, r.means, r.possible) for r in none] == [("женя", "женя", ["женя"], [])]
    assert load_variants(table, 2) is table


def test_three_hundred_thousand_entries(spark):
    """Forms by a plain pass over the entries, for some words."""
    letters = "абвгдежзик"
    n = F.col("id")
    key = F.concat(*[F.get(F.array(*map(F.lit, letters)), (F.floor(n / 10**i) % 10).cast("int")) for i in range(6)], F.lit("ій"))
    table = spark.range(300_000).select(key.alias("variant"), F.concat(F.lit("f"), (n % 1000).cast("string")).alias("standard_form"))
    rng = random.Random(1)
    words = ["".join(rng.choice(letters) for _ in range(6)) + end for end in ("ій", "ой", "ійко", "") for _ in range(2)] + ["абвгд", "щщщ", "ааааааій"]
    entries = [("".join(letters[i // 10**j % 10] for j in range(6)) + "ій", f"f{i % 1000}") for i in range(300_000)]
    known, want = dict(entries), {}
    for w in words:
        near = lambda k: w[:2] == k[:2] or len({*w} & {*k}) >= 3  # noqa: B023, E731  # others can't be so similar
        want[w] = {known[w]} if w in known else {v for k, v in entries if w.startswith(k) or k.startswith(w) or near(k) and likeness(w, k) > 0.7}
    got = {r.w: set(r.possible) for r in dictionary.look_up(spark.createDataFrame([(w,) for w in words], "w string"), table).collect()}
    assert got == want and any(len(v) > 1 for v in want.values())


def test_matching_with_a_table(spark):
    rng = random.Random(5)
    people = [(str(i), p) for i, p in enumerate(sorted({f"{rng.choice(SUR)} {rng.choice(FIR)}" for _ in range(10)}))]
    roster = spark.createDataFrame([("r", k, i, *p.split(), []) for k, (i, p) in enumerate(people)], "roster_id string, pos int, id string, surname string, firstname string, nicknames array<string>")
    asked = names(rng, people)[:15] + ["Саша", "Оля", "olya", "Міша"]
    shown = spark.createDataFrame([("c", "r", n, k, 0, [""]) for k, n in enumerate(asked)], "chat_id string, roster_id string, name string, first_seq int, ord int, messages array<string>")
    aliases = spark.createDataFrame([], "chat_id string, name string, real_name string")
    got = [sorted(((r.name, r.id, r.match_type, r.quality) for r in match.match_names(shown, aliases, roster, v).collect()), key=repr) for v in (VARIANTS, table_of(spark, VARIANTS))]
    assert got[0] == got[1]
