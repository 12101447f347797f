"""Re-matching what changed gives what matching everything anew gives, and leaves alone what no change can reach."""

import random

from pyspark.sql import functions as F

from rollcall.operators import match, rematch
from rollcall.plans.attendance import attendance

VARIANTS = {"саша": "олександр", "оля": "ольга", "ваня": "іван", "міша": "михайло"}
SURNAMES = ("Петренко", "Мельник", "Шевченко", "Бондаренко", "Ткачук", "Гончаренко", "Савчук", "Кравець", "Лисенко", "Руденко")
FIRSTNAMES = ("Ольга", "Іван", "Михайло", "Олександр", "Тарас", "Катерина")
ROSTER = "roster_id string, pos int, id string, surname string, firstname string, nicknames array<string>"
MEETING = "chat_id string, roster_id string, text string"

#: What becomes of a roster (a list of pos, id, surname, firstname, nicknames), by its name.
CHANGES = {
    "same": lambda rows: rows,
    "leaves": lambda rows: rows[:2] + rows[3:],
    "comes": lambda rows: [*rows, (90, "90", "Бондар", "Ольга", ["cat"])],
    "renamed": lambda rows: [*rows[:1], (1, "1", "Мельниченко", "Тарас", []), *rows[2:]],
    "other_id": lambda rows: [(0, "77", *rows[0][2:]), *rows[1:]],
    "nickname": lambda rows: [(*rows[0][:4], ["guest 1"]), *rows[1:]],
    "swapped": lambda rows: [(1, *rows[0][1:]), (0, *rows[1][1:]), *rows[2:]],
    "emptied": lambda rows: [],
    "twice": lambda rows: [*rows, (91, "91", *rows[3][2:])],
}


def plain(df):
    return sorted(map(repr, df.collect()))


def tables(spark, seed):
    """Rosters of ten people, three meetings of each with names in many forms, and the rosters after their changes."""
    rng = random.Random(seed)
    before, after, chats = [], [], []
    for roster in CHANGES:
        people = [(k, str(k), s, rng.choice(FIRSTNAMES), [f"user{k}"] if k % 4 == 0 else []) for k, s in enumerate(rng.sample(SURNAMES, 10))]
        before += [(roster, *p) for p in people]
        after += [(roster, *p) for p in CHANGES[roster](people)]
        for meeting in range(3):
            names = []
            for _, _, s, f, nick in rng.sample(people, 7):
                names.append(rng.choice([f"{s} {f}", f"{f} {s}", f, s, s + f, f"{s} {f[:-1]}", f"{s[:-1]}а {f}", *nick, f"{f} {s[:-2]}", "Оля", f"{s} Саша"]))
            lines = [f"10:00:{i:02d} From {n} to Everyone: +" for i, n in enumerate([*names, "Guest 1", "Бондар", "Ольга"])]
            chats.append((f"{roster}{meeting}", roster, "\n".join(lines)))
    return spark.createDataFrame(before, ROSTER), spark.createDataFrame(after, ROSTER), spark.createDataFrame(chats, MEETING)


def test_changes_give_what_a_new_run_gives(spark):
    before, after, chats = tables(spark, 4)
    a = attendance(chats, before, VARIANTS)
    log = {}
    got = rematch.rematch_changes(a.matches, before, after, VARIANTS, log=log)
    want = match.rematch(a.matches, a.people, a.aliases, after, before.select("roster_id").distinct(), VARIANTS)
    new, old = plain(want), plain(a.matches)
    assert plain(got) == new and got.columns == a.matches.columns
    # Every kind of change but none has done something, and not by matching everything.
    differ = {r.split("roster_id='")[1].split("'")[0] for r in set(new) ^ set(old)}
    assert "same" not in differ and len(differ) >= 6, differ
    assert 0 < log["again"] < 0.75 * log["names"], log
    # Overrides that come, and that go again; one for a name that no roster row is near.
    overrides = spark.createDataFrame([("same0", "Guest 1", "3"), (None, "Бондар", "5")], "chat_id string, name string, id string")
    by_hand = rematch.rematch_changes(a.matches, before, before, VARIANTS, overrides, log=log)
    assert plain(by_hand) == plain(attendance(chats, before, VARIANTS, overrides=overrides).matches)
    assert log["again"] == 2 * len(CHANGES) and by_hand.filter("match_type = 'manual-assignment'").count() > len(CHANGES)
    assert plain(rematch.rematch_changes(by_hand, before, before, VARIANTS)) == old


def test_few_names_are_touched(spark):
    """A person more among 200, asked by 120 names: those near are found, by keys too."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice(("ба", "ко", "ми", "рен", "шев", "ту", "лі", "го", "дзя", "пе")) for _ in range(n)).capitalize()
    people = [(f"{word(4)}{k}", word(3)) for k in range(200)]
    before = spark.createDataFrame([("r", k, str(k), s, f, []) for k, (s, f) in enumerate(people)], ROSTER)
    after = before.unionByName(spark.createDataFrame([("r", 200, "new", "Хмельницький", "Юхим", ["yu"])], ROSTER))
    near = ["Хмельницький Юхим", "Юхим Хмельницький", "Хмельницкий Юхим", "Юхим", "Хмельницький", "хмельницькийюхим", "yu", "Khmelnytskyi Yukhym"]
    names = [f"{s} {f}" for s, f in people[:120]] + near
    keys = spark.createDataFrame([("r", n, None, k, k % 50 == 0) for k, n in enumerate(names)], "roster_id string, name string, real_name string, k long, open boolean")
    changed, nicks = rematch.changes(before, after)
    assert [tuple(r) for r in changed.collect()] == [("r", "Хмельницький Юхим")] and [tuple(r) for r in nicks.collect()] == [("r", "yu")]
    found = {mode: {r.k for r in rematch.touched(keys, changed, nicks, VARIANTS, mode).collect()} for mode in ("small", "large")}
    assert found["small"] == found["large"] >= set(range(120, 128)) and len(found["small"]) < 20


def test_defined_results_of_odd_tables(spark):
    before, after, chats = tables(spark, 6)
    a = attendance(chats.filter("chat_id = 'leaves0'"), before, VARIANTS)
    none = a.matches.filter("false")
    assert rematch.rematch_changes(none, before, after, VARIANTS).count() == 0
    old = plain(a.matches)
    odd = before.unionByName(before.limit(20)).withColumn("extra", F.lit(1)).withColumn("k", F.lit(None).cast("string"))
    assert plain(rematch.rematch_changes(a.matches, before, odd, VARIANTS)) == old
    # A roster that wasn't there before, of another meeting: nothing is touched.
    other = before.unionByName(spark.createDataFrame([("zz", 0, "0", None, "Ольга", [None, ""])], ROSTER))
    assert plain(rematch.rematch_changes(a.matches, before, other, VARIANTS)) == old
