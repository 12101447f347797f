"""Candidates by keys and choices in rounds, against plain Python: nothing is lost, and little else is looked at."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rollcall.operators import ambiguity, assign, candidates, recommend
from rollcall.storage import settle
from test_model import cyrillic, latin, likeness

ROSTER = "roster_id string, pos int, id string, surname string, firstname string, nicknames array<string>"
SYLLABLES = ["ко", "ва", "ле", "нко", "пе", "тре", "мель", "ник", "бо", "йчук", "щер", "бань", "рі", "зу", "гай", "дар"]


def place(form, part):
    g, p = (re.sub("[^a-zа-яіїєґ]", "", x.lower()) for x in (form, part))
    at = next((g.find(p[i:]) for i in range(len(p)) if p[i:] in g), None)
    return at, len(p)


def split(name, people, min_suffix=1):
    """M21 by trying every person: {id: (q, kind)}."""
    if " " in name or len(name) < 6:
        return {}
    forms = [cyrillic(name).lower(), name.lower()] if re.search("[a-zA-Z]", name) else [name.lower()]
    best = {}
    for pos, (i, s, f) in enumerate(people):
        s, f = s.lower(), f.lower()
        for n, form in enumerate(dict.fromkeys(forms)):
            if min_suffix > 1 and s[-min_suffix:] not in form:
                continue
            options = []
            if s in form and f in form:
                glued = f.replace(" ", "")
                options = [(q, -(n * 3 + o), k) for q, o, k in ((likeness(form, s + glued), 0, "standard"), (likeness(form, glued + s), 1, "reversed")) if q > 0.8]
            (ps, ns), (pf, nf) = place(form, s), place(form, f)
            if ps is not None and pf is not None:
                if ps < pf and ps + ns <= pf:
                    options.append((0.85, -(n * 3 + 2), "standard"))
                elif pf < ps and pf + nf <= ps:
                    options.append((0.80, -(n * 3 + 2), "reversed"))
            for q, o, k in options:
                best[i] = max(best.get(i, (0.0,)), (q, -pos, o, k))
    return {i: (round(b[0], 9), b[3]) for i, b in best.items()}


def rosters(spark, people):
    return spark.createDataFrame([("r", k, i, s, f, []) for k, (i, s, f) in enumerate(people)], ROSTER)


def keyed(spark, names):
    return settle(spark.createDataFrame([("r", k, n, None) for k, n in enumerate(names)], "roster_id string, k long, name string, real_name string"))


@pytest.mark.parametrize("min_suffix", [1, 3])
def test_glued_names_equal_model(spark, min_suffix):
    """With letters of other alphabets, apostrophes, hyphens and parts of one letter."""
    rng = random.Random(7)
    surname = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))).capitalize()
    people = [(str(i), surname(), rng.choice(["Іван", "Ольга", "Михайло", "Ян", "В'ячеслав", "Анна-Марія", "Ёла"])) for i in range(120)]
    people += [("x", "李", "明"), ("y", "ё", "Іван"), ("z", "О'Ніл", "Я"), ("w", "Łoś", "Ewa Anna")]
    unique = list({(s, f): (i, s, f) for i, s, f in people}.values())
    names = [f + s if k % 2 else s + f.lower() for k, (_, s, f) in enumerate(unique[:40])] + ["李明李明李明", "ёІванё", "о'нілянкаян", latin("Петренкоіван").lower(), "łośewaanna", "коротк", "бббббббб", "x" * 300 + "ко"]
    got = {}
    for r in ambiguity.split_glued(keyed(spark, names), rosters(spark, unique).repartition(3), min_suffix).collect():
        got.setdefault(names[r.k], {})[r.id] = (round(r.q, 9), r.combined)
    assert got == {n: w for n in names if (w := split(n, unique, min_suffix))}


def test_glued_names_of_a_large_roster(spark):
    """A hundred thousand people: as many rows as the rule gives, and those of some people are right."""
    people = spark.range(100_000).select(
        F.lit("r").alias("roster_id"), F.col("id").cast("int").alias("pos"), F.col("id").cast("string").alias("id"),
        F.concat(*[F.get(F.array(*map(F.lit, SYLLABLES)), (F.floor(F.col("id") / 16**n) % 16).cast("int")) for n in range(4)], F.col("id").cast("string")).alias("surname"), F.lit("Іван").alias("firstname"), F.array().cast("array<string>").alias("nicknames"),
    )
    some = [r for r in people.filter("pos % 9973 = 0").collect()]
    got = ambiguity.split_glued(keyed(spark, [r.surname + "іван" for r in some]), people, min_suffix=3)
    rows = {(r.k, r.id): (r.q, r.combined) for r in got.filter(F.col("id").isin([r.id for r in some])).collect()}
    people_ = [(r.id, r.surname, r.firstname) for r in some]
    want = {(k, i): w for k, r in enumerate(some) for i, w in split(r.surname + "іван", people_, 3).items()}
    assert {k: (round(q, 9), c) for k, (q, c) in rows.items()} == want and len(want) >= len(some)


def test_letters_never_lose_a_pair(spark):
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("абвaaa😀 'ї") for _ in range(rng.randint(1, 14)))
    strings = [[text() for _ in range(60)] for _ in range(2)]
    strings[1] += [x[:-1] + "й" for x in strings[0]] + ["а" * 40]
    strings[0] += ["а" * 30]
    left, right = (spark.createDataFrame([("r", x) for x in xs], f"roster_id string, {c} string") for xs, c in zip(strings, "st", strict=True))
    for t in (0.75, 0.55, 0.3):
        want = {(x, y, round(likeness(x, y), 9)) for x in strings[0] for y in strings[1] if likeness(x, y) >= t}
        for mode in ("small", "large"):
            got = [(r.s, r.t, round(r.similarity, 9)) for r in candidates.alike_strings(left, right, t, mode).collect()]
            assert len(got) == len(want) and set(got) == want and want


@pytest.mark.parametrize("mode", ["small", "large"])
def test_best_matches_of_both_ways(spark, mode):
    """Names near and far, an id in use, ties by position."""
    rng = random.Random(9)
    surname = lambda: "".join(rng.choice(SYLLABLES) for _ in range(3)).capitalize()
    unique = list({(s, f): (str(i), s, f) for i, s, f in ((i, surname(), rng.choice(["Іван", "Ольга", "Михайло"])) for i in range(150))}.values())
    names = [f"{f} {s}"[:-1] for _, s, f in unique[:20]] + [f"{s[:-2]} {f}" for _, s, f in unique[20:40]] + [latin(f"{s}а {f}") for _, s, f in unique[40:50]] + ["зовсім інше", "Qq Ww", "ін"]
    used = {("c", unique[k][0]) for k in range(10)}
    asked = spark.createDataFrame([(c, "r", n) for n in names for c in ("c", "d")], "chat_id string, roster_id string, name string")
    got = {(r.chat_id, r.name, r.rank, r.id, round(r.similarity, 9)) for r in recommend.best_matches(asked, spark.createDataFrame(sorted(used), "chat_id string, id string"), rosters(spark, unique), mode=mode).collect()}
    want = set()
    for c in ("c", "d"):
        for n in names:
            mine = (n, latin(n), cyrillic(n))
            scored = sorted((-max(likeness(a, b) for a in mine for b in (p, latin(p), cyrillic(p))), pos, i) for pos, (i, s, f) in enumerate(unique) for p in [f"{s} {f}"] if (c, i) not in used)
            want |= {(c, n, k, i, round(-q, 9)) for k, (q, _, i) in enumerate([x for x in scored if -x[0] > 0.3][:3], 1)}
    assert got == want


def test_best_matches_measure_few_pairs(spark, monkeypatch):
    """Names with three near people in a roster of 3,000: hardly any other pair is measured."""
    rng, measured = random.Random(10), []
    surname = lambda: "".join(rng.choice("абвгдежзиклмнопрстуфхцч") for _ in range(9)).capitalize()
    base = [surname() for _ in range(1000)]
    unique = [(f"{i}{n}", s, f) for i, s in enumerate(base) for n, f in enumerate(("Іван", "Івана", "Іванко"))]
    names = [f"{s} Івн" for s in base[::10]]
    real = candidates._measured

    def counted(pairs, least):
        measured.append(pairs.count())
        return real(pairs, least)

    monkeypatch.setattr(candidates, "_measured", counted)
    asked = spark.createDataFrame([("c", "r", n) for n in names], "chat_id string, roster_id string, name string")
    rows = recommend.best_matches(asked, spark.createDataFrame([], "chat_id string, id string"), rosters(spark, unique), mode="large").collect()
    assert len(rows) == 3 * len(names) and all(r.db_name.split()[0] == r.name.split()[0] for r in rows)
    assert sum(measured) < 0.12 * len(names) * len(unique)


def one_after_the_other(rows):
    """M22 as it is told: (chat, name) -> (kind, id)."""
    out, used = {}, set()
    for chat, place, name in sorted({(r[0], r[2], r[1]) for r in rows}):
        of = lambda kind: [(r[4], r[6]) for r in rows if (r[0], r[1], r[3]) == (chat, name, kind) and (chat, r[4]) not in used]  # noqa: B023, E731
        firsts, splits, possible = (of(k) for k in (assign.FIRSTNAME, assign.SPLIT, assign.POSSIBLE))
        hit = None
        if len(firsts) == 1:
            hit = (assign.FIRSTNAME, firsts[0][0])
        elif splits:
            hit = (assign.SPLIT, splits[0][0])
        elif len(possible) == 1 and possible[0][1] >= 90:
            hit = (assign.POSSIBLE, possible[0][0])
        if hit:
            out[chat, name] = hit
            used.add((chat, hit[1]))
    return out


CANDIDATES = "chat_id string, name string, place struct<first_seq: int, ord: int, name: string>, kind string, id string, db_name string, quality int, part string"


@pytest.mark.parametrize("ids", [3, 12, 60])
def test_rounds_choose_as_one_after_the_other(spark, ids):
    rng = random.Random(ids)
    rows = set()
    for chat in "abcd":
        for n in range(25):
            name, where = f"n{n:02d}", (rng.randint(0, 9), rng.randint(0, 1), f"n{n:02d}")
            pick = lambda k: rng.sample([str(i) for i in range(ids)], min(ids, rng.randint(0, k)))
            rows |= {(chat, name, where, assign.FIRSTNAME, i, "x", 95, "") for i in pick(3)}
            rows |= {(chat, name, where, assign.SPLIT, i, "x", 90, "standard") for i in pick(1)}
            rows |= {(chat, name, where, assign.POSSIBLE, i, "x", rng.choice([80, 90, 100]), "p") for i in pick(3)}
    log = []
    got = {(r.chat_id, r.name): (r.kind, r.id) for r in assign.choose(spark.createDataFrame(sorted(rows), CANDIDATES).repartition(4), log).collect()}
    want = one_after_the_other(rows)
    assert got == want and {k for k, _ in want.values()} == {assign.FIRSTNAME, assign.SPLIT, assign.POSSIBLE}
    assert len(log) < 25 and log == sorted(log, reverse=True)


def test_a_meeting_of_many_names_takes_few_rounds(spark):
    """A hundred thousand names of one meeting, each with two candidates that its neighbours have too."""
    n = F.col("id")
    base = spark.range(100_000).select(F.lit("c").alias("chat_id"), F.concat(F.lit("n"), n).alias("name"), n)
    place_ = F.struct(n.cast("int").alias("first_seq"), F.lit(0).alias("ord"), F.col("name"))
    rows = base.select("chat_id", "name", place_.alias("place"), F.explode(F.array(*[F.struct(F.lit(assign.FIRSTNAME).alias("kind"), (F.floor(n / 4) * 4 + k).cast("string").alias("id")) for k in (0, 1)], F.struct(F.lit(assign.SPLIT).alias("kind"), n.cast("string").alias("id")))).alias("c"))
    rows = rows.select("chat_id", "name", "place", "c.kind", "c.id", F.lit("x").alias("db_name"), F.lit(95).alias("quality"), F.lit("").alias("part"))
    log = []
    kinds = {r.kind: r.n for r in assign.choose(rows, log).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    # Of each four names the first takes its split, which leaves one of the firstname for the second; the others have their splits.
    assert kinds == {assign.SPLIT: 75_000, assign.FIRSTNAME: 25_000} and len(log) <= 5


def test_no_candidates(spark):
    assert assign.choose(spark.createDataFrame([], CANDIDATES)).collect() == []
