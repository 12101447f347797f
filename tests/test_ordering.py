"""Numbers over ranges, transcripts by lines and files by ranges, against plain Python and whole texts."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from rollcall.operators import chat, report, roster, thread
from rollcall.operators.ordering import RANGE, before, dealt, numbered, sums
from rollcall.sources import sinks
from rollcall.sources.chats import read_chat_lines, read_chats


@pytest.fixture
def ranges(spark):
    """Ranges that aren't put together again, however small they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sums_and_values_before(spark, ranges):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, "c"]), i, rng.randint(-3, 3), rng.choice([None, None, "x", "y"])) for i in range(2000)]
    df = dealt(spark.createDataFrame(rows, "g string, at int, v int, w string").repartition(5), ["g"], ["at"])
    assert df.filter("g = 'hot'").select(RANGE).distinct().count() > 2
    got = before(df, ["g"], ["at"], "prev", F.col("w"))
    got = sums(got, ["g"], ["at"], s=F.col("v"), n=F.lit(1)).collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine, have = sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), sorted((r for r in got if r.g == g), key=lambda r: r.at)
        assert [r.s for r in have] == list(accumulate(r[2] for r in mine)) and [r.n for r in have] == list(range(1, len(mine) + 1))
        last, want = None, []
        for r in mine:
            want.append(last)
            last = r[3] or last
        assert [r.prev for r in have] == want


def test_values_behind_ranges_without_any(spark, ranges):
    rows = spark.createDataFrame([("g", i, "first" if i == 0 else None) for i in range(500)], "g string, at int, w string")
    got = before(dealt(rows, ["g"], ["at"]), ["g"], ["at"], "prev", F.col("w")).collect()
    assert {r.prev for r in got if r.at} == {"first"} and [r.prev for r in got if not r.at] == [None]


def test_no_rows(spark):
    rows = spark.createDataFrame([], "g string, at int")
    assert numbered(rows, ["g"], ["at"], "n").count() == 0
    assert thread.sender_runs(thread.thread_messages(spark.createDataFrame([], "chat_id string, text string"))).count() == 0


def test_descending_and_ukrainian_order(spark, ranges):
    names = [f"{a}{b}" for a in "абвгґдеєжзиіїйя" for b in "аґіїє"]
    people = spark.createDataFrame([("r", i, str(i), n, "x", []) for i, n in enumerate(names)], "roster_id string, pos int, id string, surname string, firstname string, nicknames array<string>")
    got = sorted(roster.sort_roster(people.repartition(6), "surname", descending=True).collect(), key=lambda r: r.rank)
    alphabet = "абвгґдеєжзиіїйя"
    assert [r.surname for r in got] == sorted(names, key=lambda n: [alphabet.index(c) for c in n], reverse=True) and [r.rank for r in got] == list(range(1, len(names) + 1))


def test_one_large_chat(spark, ranges):
    rng = random.Random(9)
    said = [rng.choice(["Ann", "Bob"]) for _ in range(3000)]
    text = "\n".join(f"09:{i // 60 % 60:02}:{i % 60:02} From {s} to Everyone: m{i}\n\nmore" for i, s in enumerate(said))
    got = thread.sender_runs(thread.thread_messages(spark.createDataFrame([("c", text), ("d", text[:200])], "chat_id string, text string"))).filter("chat_id = 'c'").orderBy("msg_id").collect()
    runs = list(accumulate(int(i == 0 or s != said[i - 1]) for i, s in enumerate(said)))
    assert [(r.sender, r.content, r.run) for r in got] == [(s, f"m{i} more", runs[i]) for i, s in enumerate(said)]


def test_many_additions_to_one_roster(spark, ranges):
    old = spark.createDataFrame([("r", i, str(i + 1), "А", "Б", []) for i in range(3)], "roster_id string, pos int, id string, surname string, firstname string, nicknames array<string>")
    new = spark.createDataFrame([("r", i, f"x{i}" if i % 3 else None, "В", "Г" if i % 7 else " ", []) for i in range(800)], "roster_id string, ord int, id string, surname string, firstname string, nicknames array<string>")
    got = roster.add_entries(old, new.repartition(7)).filter("pos > 2").orderBy("pos").collect()
    kept, want, n = [i for i in range(800) if i % 7], [], 4
    for i in kept:
        want.append(f"x{i}" if i % 3 else str(n))
        n += not i % 3
    assert [r.id for r in got] == want and [r.pos for r in got] == list(range(3, 3 + len(kept)))


PIECES = [
    "09:00:01 From Ann to Everyone: hi\n", "09:00:02 From \n09:00:03 From Bob to Everyone: his\n", "09:00:04\nFrom Eve to Everyone: split\n", "09:00:05 From Ann to\nEveryone: late\n", "\n", "  \n", "a 09:00:06 From Cat to Everyone: inside\n",
    "09:00:07 Від Оля до Всі:\n\tдобрий день\n", "09:00:08 From Ann to Bob: private\n", "09:00:09 From\n\n \n09:00:10 From Dan to Everyone: far\n", "text\r\n", "09:00:11 От Иван кому Все: да\r\n", "From\n", "09:00:12 From 09:00:13 From Z to Everyone: z\n",
]


def test_lines_give_the_messages_of_whole_texts(spark, ranges, tmp_path):
    rng = random.Random(3)
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.txt").write_text("".join(rng.choice(PIECES) for _ in range(400 if i == 0 else 40)), encoding="utf-8", newline="")
    (tmp_path / "in" / "empty.txt").write_text("")
    (tmp_path / "in" / "no.csv").write_text(PIECES[0])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = read_chat_lines(spark, str(tmp_path / "in"), "r")
        assert lines.select("chat_id", "line_no.offset").distinct().groupBy("chat_id").count().agg(F.max("count")).first()[0] > 5
        got = {tuple(r) for r in chat.messages_of_lines(lines).collect()}
        threads = {(r.chat_id, r.msg_id, r.content) for r in thread.thread_of_lines(lines).collect()}
        assert chat.segments(lines).agg(F.max(F.length("text"))).first()[0] < 600
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = read_chats(spark, str(tmp_path / "in"), "r")
    want = {tuple(r) for r in chat.extract_messages(whole).collect()}
    assert got == want and len(want) > 200
    assert threads == {(r.chat_id, r.msg_id, r.content) for r in thread.thread_messages(whole).collect()} and threads


def test_files_by_ranges(spark, ranges, tmp_path):
    rows = [("hot" if i % 2 else f"c{i % 40}", i, 0, f"{i}", "С", 'І "м"', f"n{i}", i % 3 == 0) for i in range(400)]
    rep = spark.createDataFrame(rows, "chat_id string, first_seq int, ord int, id string, surname string, firstname string, nickname string, found boolean")
    path = str(tmp_path / "out")
    sinks.write_attendance_files(rep, path, 50)
    index = spark.read.parquet(f"{path}/index")
    assert index.agg(F.sum("n_rows")).first()[0] == 400 and index.filter("chat_id = 'hot'").count() > 2
    got = [r.ID for r in sinks.read_attendance_file(spark, path, "hot").collect()]
    assert sorted(got, key=int) == [str(i) for i in range(1, 400, 2)]
    assert {tuple(r) for r in sinks.read_attendance_file(spark, path, "c0").collect()} == {("c0", str(i), "С", 'І "м"', f"n{i}", "В базі" if i % 3 == 0 else "Не знайдено в базі") for i in range(0, 400, 40)}
    assert sinks.read_attendance_file(spark, path, "none").count() == 0


def test_report_places(spark, ranges):
    rows = [("c", i, 0, str(100 - i), "s", "f", f"n{i}", i % 2 == 0) for i in range(100)]
    rep = spark.createDataFrame(rows, "chat_id string, first_seq int, ord int, id string, surname string, firstname string, nickname string, found boolean")
    got = sorted(report.sort_report(rep.repartition(5)).collect(), key=lambda r: r.place)
    assert [r.id for r in got] == sorted((r[3] for r in rows), key=lambda x: (int(x) % 2, int(x))) and [r.place for r in got] == list(range(1, 101))
