"""A small meeting worked out by hand, through all steps."""

import pytest

from rollcall.operators import chat, report
from rollcall.plans.attendance import attendance, review

ROSTER = [(1, "Петренко", "Іван", []), (2, "Коваленко", "Сергій", ["sk_gamer"]), (3, "Мельник", "Олександр", []), (4, "Шевченко", "Тарас", []), (5, "Іваненко", "Олександр", []), (6, "Бондар", "Ольга", []), (7, "Ткачук", "Людмила", [])]
VARIANTS = {"саша": "олександр", "olya": "ольга", "оля": "ольга", "nick": "микола", "людмила": "людмила"}
C1 = """09:00:01 From Іван Петренко to Everyone: Добрий день
09:00:05 From Serhiy Kovalenko to Everyone: +
09:00:09 From Саша Мельник to Everyone: присутній
09:00:15 From Bob (Роберт Коваль) to Everyone: hi
09:00:20 From Nick to Everyone: rnm: Шевченко Тарас
09:00:22 From Олександр to Everyone: +
09:00:24 From sk_gamer to Everyone: + with phone
09:00:30 From Іван Петренко to Everyone: Replying to "Добрий день": і вам
"""


def said(*names):
    return "".join(f"10:00:{i:02d} From {n} to Everyone: +\n" for i, n in enumerate(names))


CHATS = [
    ("c1", "r1", C1),
    ("c2", "r1", said("ivanpetrenko", "Людмила", "Olya", "Мельник Олексанр", "Олександр", "Guest 7", "Коваленка Сергій")),
    ("c3", "r1", said("ivanpetrenko", "Петренко Іван", "Бондар", "Шевченко")),
    ("c4", "r1", said("Олександр")),
    ("c5", "r1", "09:00:00 From Іван to Everyone: <script>x</script>"),
]
WANT = {
    ("c1", "Іван Петренко"): ("1", "reversed-order-exact", 92), ("c1", "Serhiy Kovalenko"): ("2", "reversed-order-translit", 80), ("c1", "Саша Мельник"): ("3", "reversed-order-name-variant", 82),
    ("c1", "Роберт Коваль"): (None, "not-found", 0), ("c1", "Bob (Роберт Коваль)"): (None, "not-found", 0), ("c1", "Nick"): ("4", "real-name-tag", 99), ("c1", "Олександр"): ("5", "auto-match-single-name", 95),
    ("c1", "sk_gamer"): ("2", "nickname-match", 97), ("c2", "ivanpetrenko"): ("1", "split-name-match", 100), ("c2", "Людмила"): ("7", "single-word-firstname-match", 65), ("c2", "Olya"): ("6", "single-word-variant-match", 75),
    ("c2", "Мельник Олексанр"): ("3", "surname-exact-firstname-fuzzy", 90), ("c2", "Олександр"): ("5", "auto-match-single-name", 95), ("c2", "Guest 7"): (None, "not-found", 0), ("c2", "Коваленка Сергій"): ("2", "standard-order-translit", 85),
    ("c3", "ivanpetrenko"): (None, "ambiguous-name", 0), ("c3", "Петренко Іван"): ("1", "exact-match", 100), ("c3", "Бондар"): ("6", "single-word-surname-match", 70), ("c3", "Шевченко"): ("4", "single-word-surname-match", 70),
    ("c4", "Олександр"): ("5", "manual-assignment", 100),
}


@pytest.fixture(scope="module")
def roster(spark):
    return spark.createDataFrame([("r1", i, str(i), s, f, n) for i, s, f, n in ROSTER], "roster_id string, pos int, id string, surname string, firstname string, nicknames array<string>")


@pytest.fixture(scope="module")
def tables(spark, roster):
    chats = spark.createDataFrame(CHATS, "chat_id string, roster_id string, text string")
    overrides = spark.createDataFrame([("c4", "Олександр", "5"), ("c4", "Олександр", "99")], "chat_id string, name string, id string")
    return attendance(chats, roster, VARIANTS, overrides=overrides)


def test_people(spark, tables):
    c1 = sorted(tables.people.filter("chat_id = 'c1'").collect(), key=lambda r: (r.first_seq, r.ord))
    assert [r.name for r in c1] == ["Іван Петренко", "Serhiy Kovalenko", "Саша Мельник", "Роберт Коваль", "Bob (Роберт Коваль)", "Nick", "Олександр", "sk_gamer"]
    assert {r.name: r.real_name for r in tables.aliases.collect() if r.chat_id == "c1"} == {"Bob (Роберт Коваль)": "Роберт Коваль", "Nick": "Шевченко Тарас"}
    assert {r.name for r in chat.keyword_filter(tables.people, "+").filter("chat_id = 'c1'").collect()} == {"Serhiy Kovalenko", "Олександр", "sk_gamer"}
    assert [r.reason for r in tables.rejected.collect()] == ["script"]


def test_matches(tables):
    got = {(r.chat_id, r.name): (r.id, r.match_type, r.quality) for r in tables.matches.collect()}
    assert got == WANT
    c3 = next(r for r in tables.matches.collect() if (r.chat_id, r.name) == ("c3", "ivanpetrenko"))
    assert [(m.id, m.quality) for m in c3.all_matches] == [("1", 100), ("6", 80), ("7", 80)]


def test_report(tables):
    rows = [r for r in tables.report.collect() if r.chat_id == "c1"]
    bob = next(r for r in rows if r.nickname.startswith("Bob"))
    assert (bob.id, bob.surname, bob.firstname, bob.match_type, bob.found) == ("?", "Роберт", "Коваль", "real-name-tag", False)
    counts = {r.chat_id: (r.parsed, r.unrecognised, r.unique_people) for r in report.counts(tables.report).collect()}
    assert counts["c1"] == (8, 2, 7)
    kept = report.dedup_report(tables.report).filter("chat_id = 'c1'")
    assert kept.count() == 7
    order = [r.id for r in sorted(report.sort_report(kept).collect(), key=lambda r: r.place)]
    assert order == ["1", "2", "3", "4", "5", "?", "?"]


def test_review(tables, roster):
    got = {(r.chat_id, r.name, r.rank): (r.id, r.quality) for r in review(tables, roster).collect()}
    assert got["c3", "ivanpetrenko", 1] == ("1", 100)


def test_large_mode_finds_the_same(spark, roster, tables):
    chats = spark.createDataFrame(CHATS[:4], "chat_id string, roster_id string, text string")
    overrides = spark.createDataFrame([("c4", "Олександр", "5")], "chat_id string, name string, id string")
    got = {(r.chat_id, r.name): (r.id, r.match_type, r.quality) for r in attendance(chats, roster, VARIANTS, overrides=overrides, mode="large").matches.collect()}
    assert got == WANT
