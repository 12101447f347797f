"""What only larger tables show: rosters above the list format's limit, as many files as meetings, common pieces of words, and many display names of one person."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rollcall.operators import candidates, chat, match
from rollcall.plans.attendance import attendance
from rollcall.plans.queries import ORACLE_SQL, QUERIES
from rollcall.sources import bundles, sinks
from rollcall.storage import shared_dir


@pytest.fixture(scope="module")
def one_nation(spark, tmp_path_factory):
    """A table of customers of whom nearly all are of one nation."""
    path = tmp_path_factory.mktemp("one_nation")
    duckdb.sql(f"COPY (SELECT i AS c_custkey, 'c' || i AS c_name, CAST(CASE WHEN i % 1000 = 0 THEN 2 ELSE 1 END AS INT) AS c_nationkey, 0.0::DOUBLE AS c_acctbal, 'X' AS c_mktsegment FROM range(10500) t(i)) TO '{path}/customer.parquet'")
    return str(path)


def test_roster_list_reads_all_lines(spark, one_nation):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW customer AS FROM '{one_nation}/customer.parquet'")
    df = QUERIES["s11_roster_list"](spark, one_nation)
    want = db.sql(ORACLE_SQL["s11_roster_list"])
    got = sorted(tuple(r) for r in df.select(want.columns).collect())
    assert len(got) > 10_000 and got == sorted(want.fetchall())


def written(spark):
    """The folders and files below the folder of the application."""
    return sum(len(d) + len([f for f in files if f.endswith((".txt", ".csv"))]) for _, d, files in os.walk(shared_dir(spark).removeprefix("file:")))


@pytest.mark.parametrize("name", ["p1_transcript_lines", "s1_read_chats", "s16_attendance_csv"])
def test_files_go_by_tasks_not_by_meetings(spark, tmp_path, name):
    duckdb.sql(f"COPY (SELECT i AS c_custkey, 'c' || i AS c_name, CAST(i % 25 AS INT) AS c_nationkey, 0.0::DOUBLE AS c_acctbal, 'X' AS c_mktsegment FROM range(100) t(i)) TO '{tmp_path}/customer.parquet'")
    duckdb.sql(f"COPY (SELECT i AS conv_id, 0::BIGINT AS turn, 'user' AS role, 'hello ' || i AS text FROM range(300) t(i)) TO '{tmp_path}/conversations.parquet'")
    db = duckdb.connect()
    for t in ("customer", "conversations"):
        db.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    before = written(spark)
    df, want = QUERIES[name](spark, str(tmp_path)), db.sql(ORACLE_SQL[name])
    got = sorted(map(str, (tuple(r) for r in df.select(want.columns).collect())))
    assert len(got) >= 300 and got == sorted(map(str, want.fetchall()))
    assert written(spark) - before < 150


def test_bundles_give_what_files_give(spark, tmp_path):
    texts = [(f"ü {i}/%\t{i}.txt", "\n".join(f"09:00:{n:02d} From A\t{n} to Everyone: x{n}\r\nmore" for n in range(i * 7))) for i in range(9)] + [("no.csv", "x"), ("long.txt", "y" * 2000)]
    bundles.write_texts(spark.createDataFrame(texts, "name string, text string").repartition(3), str(tmp_path / "b"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # so that a file is read in several shares
    try:
        chats = bundles.read_bundled_chats(spark, str(tmp_path / "b"), F.substring("path", 1, 1))
        assert {tuple(r) for r in chats.collect()} == {(n, n[0], t + "\n") for n, t in texts if n.endswith(".txt")}
        assert bundles.read_bundled_chats(spark, str(tmp_path / "b"), max_size=1000).filter("chat_id = 'long.txt'").count() == 0
        lines = bundles.read_bundled_chat_lines(spark, str(tmp_path / "b"), "r")
        assert {tuple(r)[2:] for r in chat.messages_of_lines(lines).collect()} == {tuple(r)[2:] for r in chat.extract_messages(chats).collect()}
        assert lines.filter("chat_id = 'long.txt'").count() == 1
        assert bundles.read_bundled_chat_lines(spark, str(tmp_path / "b"), "r", max_size=1000).filter("chat_id = 'long.txt'").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_attendance_bundle_has_the_lines_of_files(spark, tmp_path):
    rows = [("hot" if i % 2 else f"c{i % 40}", i, 0, f"{i}", "С", 'І "м"', f"n,{i}", i % 3 == 0) for i in range(400)]
    rep = spark.createDataFrame(rows, "chat_id string, first_seq int, ord int, id string, surname string, firstname string, nickname string, found boolean")
    sinks.write_attendance_bundle(rep.repartition(5), str(tmp_path / "b"))
    sinks.write_attendance_csv(rep, str(tmp_path / "f"))
    lines = lambda df, *order: [r.line for r in df.orderBy(*order).collect()]
    got = bundles.read_lines(spark, str(tmp_path / "b"))
    for name in ("hot", "c0", "c4"):
        files = sorted((tmp_path / "f" / f"chat_id={name}").glob("*.csv"))
        assert lines(got.filter(F.col("name") == name), "line_no") == [x for f in files for x in f.read_text(encoding="utf-8").splitlines()]
    assert got.select("name").distinct().count() == 21


def test_pieces_meet_few_other_words(spark):
    """Words of common syllables: the keys find every similar pair, and bring few others together."""
    rng = random.Random(5)
    made = sorted({"".join(rng.choice(("th", "an", "er", "ing", "on", "re", "ha", "nd")) for _ in range(rng.randint(2, 6))) for _ in range(600)})
    left = spark.createDataFrame([("", w) for w in made[::2]], "roster_id string, s string")
    right = spark.createDataFrame([("", w) for w in made[1::2]], "roster_id string, t string")
    met = candidates._by_keys(left.withColumn("bs", candidates.bag("s")), right.withColumn("bt", candidates.bag("t")), ["roster_id"], 0.7, F.lit(0.7))
    got = {(r.s, r.t) for r in met.select("s", "t").collect()}
    longest = F.greatest(F.length("s"), F.length("t"))
    want = {(r.s, r.t) for r in left.crossJoin(right.select("t")).filter(1 - F.levenshtein("s", "t") / longest >= 0.7).collect()}
    assert want and want <= got and met.count() < 0.2 * left.count() * right.count()


def test_rules_look_at_a_real_name_once(spark, monkeypatch):
    roster = spark.createDataFrame([("r", i, str(i), s, "Іван", []) for i, s in enumerate(("Петренко", "Мельник"))], "roster_id string, pos int, id string, surname string, firstname string, nicknames array<string>")
    keys = spark.createDataFrame([("r", k, "Петренка Іван" if k % 2 else "Мельнак Іван") for k in range(100)], "roster_id string, k long, lookup string")
    seen, real = [], match.matching_pairs
    monkeypatch.setattr(match, "matching_pairs", lambda names, people, mode: seen.append(names.count()) or real(names, people, mode))
    pairs = {(r.k, r.id) for r in match.rule_pairs(keys, roster, {}).collect()}
    best = {(r.k, r.id) for r in match.best_by_rules(keys, roster, {}).collect()}
    assert seen == [2, 2] and pairs == best == {(k, "0" if k % 2 else "1") for k in range(100)}


def test_attendance_makes_the_roster_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def ident(x):
        made.add(1)
        return x

    people = [("r", i, str(i), s, "Іван", []) for i, s in enumerate(("Петренко", "Мельник"))]
    roster = spark.createDataFrame(people, "roster_id string, pos int, id string, surname string, firstname string, nicknames array<string>").withColumn("id", ident.asNondeterministic()("id"))
    chats = spark.createDataFrame([("c", "r", "09:00:01 From Петренко Іван to Everyone: x\n09:00:02 From Мельника Іван to Everyone: y")], "chat_id string, roster_id string, text string")
    a = attendance(chats, roster, {})
    assert {(r.nickname, r.id) for r in a.report.collect()} == {("Петренко Іван", "0"), ("Мельника Іван", "1")} and made.value == 2
