"""Matching against a slow model in plain Python: every name against every row, one after the other."""

import random

import pytest

from rollcall.functions.names import lcs_length
from rollcall.operators import assign, match
from rollcall.plans.match_sql import FIXES, GROUPS as GROUPED, LATIN, OTHERS, SINGLES
from rollcall.plans import fixtures
from rollcall.plans.queries import m25_best_matches

VARIANTS = {"саша": "олександр", "оля": "ольга", "olya": "ольга", "ваня": "іван", "міша": "михайло"}


# The tables of the SQL, which are written apart from those of the library.
GROUPS, CORRECTIONS, LETTERS, SPELLINGS = GROUPED, FIXES, SINGLES, OTHERS


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def likeness(a, b):
    a, b = a.lower(), b.lower()
    return 0.0 if not a or not b else 1.0 if a == b else 1 - distance(a, b) / max(len(a), len(b))


def latin(x):
    return "".join(LATIN.get(c) or (LATIN[c.lower()].capitalize() if c.lower() in LATIN else c) for c in x)


def cyrillic(x):
    for a, b in GROUPS.items():
        x = x.replace(a.capitalize(), b.upper()).replace(a, b)
    x = x.translate(str.maketrans(LETTERS[0] + LETTERS[0].upper(), LETTERS[1] + LETTERS[1].upper()))
    for a, b in CORRECTIONS.items():
        x = x.replace(a, b)
    for a, b in CORRECTIONS.items():
        x = x.replace(a.capitalize(), b.capitalize())
    return x


def spellings(x):
    out = [latin(x)]
    for i, c in enumerate(x):
        for a in SPELLINGS.get(c.lower(), ()):
            v = latin(x[:i] + a + x[i + 1 :])
            if v not in out:
                out.append(v)
    return out[:10]


def is_cyrillic(x):
    return any("а" <= c <= "я" or "А" <= c <= "Я" or c in "іІїЇєЄґҐ" for c in x)


def sounds(a, b, t):
    if not a or not b:
        return False
    if a.lower() == b.lower():
        return True
    if is_cyrillic(a) == is_cyrillic(b):
        return likeness(a, b) >= t
    mine, other = (a, b) if is_cyrillic(a) else (b, a)
    return any(likeness(v, other) >= t for v in spellings(mine))


def form(x):
    return VARIANTS.get(x.lower(), x.lower())


def variant(a, b):
    a, b = a.lower(), b.lower()
    return a == b or (form(a) == b if form(a) != a else False)


def forms(x):
    x = x.lower()
    if x in VARIANTS:
        return {VARIANTS[x]}
    return {v for k, v in VARIANTS.items() if x.startswith(k) or k.startswith(x) or likeness(x, k) > 0.7}


def rule(name, person):
    n, d = name.split(), person.split()
    if len(n) > 1 and len(d) > 1:
        ds, df = d[0], " ".join(d[1:])
        for s, f, numbers, back in ((n[0], " ".join(n[1:]), (98, 90, 85, 88), False), (n[-1], " ".join(n[:-1]), (92, 85, 80, 82), True)):
            equal = s.lower() == ds.lower()
            if equal and f.lower() == df.lower():
                return numbers[0], back
            if equal and likeness(f, df) >= 0.75:
                return numbers[1], back
            if sounds(s, ds, 0.75) and sounds(f, df, 0.75):
                return numbers[2], back
            if equal and variant(f, df):
                return numbers[3], back
    if len(n) == 1 and len(d) > 1:
        if sounds(n[0], d[0], 0.75):
            return 70, False
        if sounds(n[0], " ".join(d[1:]), 0.75):
            return 65, False
        if " ".join(d[1:]).lower() in forms(n[0]):
            return 75, False
    return (60, False) if sounds(name, person, 0.70) else None


def model(name, people):
    """(id, quality) of a name of at least two words, or of one that isn't ambiguous."""
    by_name = {p: i for i, p in people}
    if name in by_name:
        return by_name[name], 100
    found = sorted(((-r[0], k, i) for k, (i, p) in enumerate(people) if (r := rule(name, p))), key=lambda x: x[:2])
    if not found:
        return None, 0
    if len(found) > 1 and found[1][0] - found[0][0] < 5:
        return None, 0
    return found[0][2], -found[0][0]


SUR = ["Петренко", "Петрина", "Коваленко", "Ковальчук", "Мельник", "Шевченко", "Щербань", "Їжак"]
FIR = ["Іван", "Олександр", "Ольга", "Михайло", "Юлія"]


def names(rng, people):
    out = set()
    for _ in range(40):
        s, f = rng.choice(people)[1].split() if rng.random() < 0.8 else (rng.choice(SUR), rng.choice(FIR))
        f = rng.choice([f, f, "Саша", "Оля", f[:-1], f.lower()])
        s = rng.choice([s, s, s[:-1], s.replace("е", "и"), s + "а"])
        name = rng.choice([f"{s} {f}", f"{f} {s}", latin(f"{f} {s}"), latin(f"{s} {f}"), cyrillic(latin(f"{s} {f}"))])
        out.add(name)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_equal_model(spark, seed):
    rng = random.Random(seed)
    people = [(str(i), p) for i, p in enumerate(sorted({f"{rng.choice(SUR)} {rng.choice(FIR)}" for _ in range(14)}))]
    roster = spark.createDataFrame([("r", k, i, *p.split(), []) for k, (i, p) in enumerate(people)], "roster_id string, pos int, id string, surname string, firstname string, nicknames array<string>")
    asked = names(rng, people)
    shown = spark.createDataFrame([("c", "r", n, k, 0, [""]) for k, n in enumerate(asked)], "chat_id string, roster_id string, name string, first_seq int, ord int, messages array<string>")
    aliases = spark.createDataFrame([], "chat_id string, name string, real_name string")
    for mode, parts in (("small", 1), ("large", 5)):
        got = {r.name: (r.id, r.quality) for r in match.match_names(shown.repartition(parts), aliases, roster.repartition(parts), VARIANTS, mode=mode).collect()}
        assert got == {n: model(n, people) for n in asked}


def test_assignment_goes_in_order(spark):
    roster = spark.createDataFrame([("r", k, str(k), s, f, []) for k, (s, f) in enumerate([("Петренко", "Ольга"), ("Мельник", "Ольга"), ("Шевченко", "Ольга")])], "roster_id string, pos int, id string, surname string, firstname string, nicknames array<string>")
    rows = [("a", "Петренко Ольга", "0", 0), ("a", "Ольга", None, 1), ("b", "Петренко Ольга", "0", 0), ("b", "Мельник Ольга", "1", 1), ("b", "Ольга", None, 2), ("b", "ольга", None, 3)]
    kind = lambda i: "exact-match" if i else "ambiguous-name"
    df = spark.createDataFrame([(c, "r", n, s, 0, None, i, kind(i), 100 if i else 0, False, None, None, False) for c, n, i, s in rows], f"chat_id string, roster_id string, name string, first_seq int, ord int, real_name string, id string, match_type string, quality int, reversed boolean, db_name string, all_matches {match.MATCH}, auto_matched boolean")
    got = {(r.chat_id, r.name): (r.id, r.auto_matched) for r in assign.auto_match(df.repartition(3), roster, {}).collect()}
    assert got["a", "Ольга"] == (None, False)  # two are free
    assert got["b", "Ольга"] == ("2", True) and got["b", "ольга"] == (None, False)


def test_rematching_an_unchanged_roster_changes_nothing(spark):
    from rollcall.plans.attendance import attendance

    roster = spark.createDataFrame([("r", k, str(k), s, f, []) for k, (s, f) in enumerate([("Петренко", "Ольга"), ("Мельник", "Ольга"), ("Шевченко", "Тарас"), ("Бондар", "Іван")])], "roster_id string, pos int, id string, surname string, firstname string, nicknames array<string>")
    said = lambda *names: "\n".join(f"10:00:{i:02d} From {n} to Everyone: +" for i, n in enumerate(names))
    chats = spark.createDataFrame([("a", "r", said("Петренко Ольга", "Ольга", "tarasshevchenko")), ("b", "q", said("Бондар"))], "chat_id string, roster_id string, text string")
    a = attendance(chats, roster, VARIANTS)
    plain = lambda df: sorted(map(repr, df.collect()))
    again = match.rematch(a.matches, a.people, a.aliases, roster, roster.select("roster_id").distinct(), VARIANTS)
    assert plain(again) == plain(a.matches) and sum(r.auto_matched for r in a.matches.collect()) == 2
    fewer = roster.filter("id <> '1'")
    got = {r.name: r.match_type for r in match.rematch(a.matches, a.people, a.aliases, fewer, roster.select("roster_id").distinct(), VARIANTS).collect() if r.chat_id == "a"}
    assert got["Ольга"] == "single-word-firstname-match" and got["tarasshevchenko"] == "split-name-match"


def test_common_subsequences(spark):
    """Short sides as bits, long ones as arrays, against the usual table."""
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("абвгд😀e") for _ in range(n))
    pairs = [(text(rng.randint(0, 12)), text(rng.randint(0, 12))) for _ in range(150)] + [(text(n), text(m)) for n, m in ((60, 60), (59, 90), (61, 70), (80, 75), (0, 5), (5, 0))] + [(None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lcs_length("a", "b").alias("n")).collect()
    assert [(r.a, r.b, r.n) for r in got] == [(a, b, None if a is None else brute(a, b)) for a, b in pairs]


def test_best_matches_equal_model(spark, sf_dir):
    people, spoken = {}, fixtures.speakers(spark, sf_dir).collect()
    for r in sorted(fixtures.rosters(spark, sf_dir).collect(), key=lambda r: r.pos):
        of = people.setdefault(r.roster_id, {})
        name = f"{r.surname} {r.firstname}"
        of[name] = (of[name][0] if name in of else r.pos, r.id)
    used = {(r.conv_id, people[r.roster_id][r.shown][1]) for r in spoken if r.shown in people[r.roster_id]}
    want, without = set(), set()
    for conv, roster_id, name in {(r.conv_id, r.roster_id, r.shown[1:-1]) for r in spoken}:
        scored = [(-max(likeness(a, b) for a in (name, latin(name), cyrillic(name)) for b in (p, latin(p), cyrillic(p))), pos, i) for p, (pos, i) in people[roster_id].items()]
        near = sorted(x for x in scored if -x[0] > 0.3)
        without |= {(conv, i) for _, _, i in near[:3]}
        want |= {(str(conv), name, k, i, round(-s, 9)) for k, (s, _, i) in enumerate([x for x in near if (conv, x[2]) not in used][:3], 1)}
    assert max(r.turn for r in spoken) > 1 and used & without
    got = [(r.chat_id, r.name, r.rank, r.id, round(r.similarity, 9)) for r in m25_best_matches(spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want
