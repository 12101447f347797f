"""Values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from rollcall.functions import names as N
from rollcall.functions import text as X
from rollcall.operators import chat, roster, thread
from rollcall.sources import rosters as R
from rollcall.sources import screen

L = F.lit
VARIANTS = {"саша": "олександр", "сашко": "олександр", "оля": "ольга", "olya": "ольга", "ваня": "іван", "катя": "катерина"}


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: X.levenshtein(L("ольга"), L("олга")), 1), (lambda: X.similarity(L("ольга"), L("олга")), 0.8), (lambda: X.similarity(L(""), L("x")), 0.0), (lambda: X.similarity(L("Аб"), L("аБ")), 1.0), (lambda: X.similar(L("ольга"), L("олга")), True),
        (lambda: X.trim(L("  a ﻿")), "a"), (lambda: X.parse_int(L("12_1")), 12), (lambda: X.parse_int(L("?")), None), (lambda: X.format_date(L("2024-03-05 07:08:00"), True), "05.03.2024 07:08"), (lambda: X.format_date(L("x")), ""),
        (lambda: X.slug(L("--Іван Petrenko!! 2")), "іван-petrenko-2"), (lambda: X.slug(L("!!")), None), (lambda: X.escape_html(L("<a href=\"x\">'&'</a>")), "&lt;a href=&quot;x&quot;&gt;&#039;&amp;&#039;&lt;/a&gt;"), (lambda: X.truncate(L("abcdefgh"), 6), "abc..."),
        (lambda: N.to_latin(L("Ольга")), "Olьha"), (lambda: N.to_latin(L("Сергій")), "Serhiy"), (lambda: N.to_latin(L("ЩУКА Юля")), "ShchUKA Yulya"), (lambda: N.to_cyrillic(L("Shcherba")), "Щерба"), (lambda: N.to_cyrillic(L("olhabondar")), "олгабондар"),
        (lambda: N.latin_variants(L("сергій")), ["serhiy", "sierhiy", "sergiy", "serhyy", "serhyiy"]), (lambda: N.latin_variants(L("")), []), (lambda: N.russian_to_ukrainian(L("рыбьи")), "рибьі"), (lambda: N.lcs_length(L("abcbdab"), L("bdcaba")), 4),
        (lambda: N.order_similarity(L("шевченко"), L("шевчинко")), 0.875), (lambda: N.breakpoint_quality(L("іванпетренко"), L("петренко"), L("іван"))["quality"], 0.80), (lambda: N.breakpoint_quality(L("іванпетренко"), L("петренко"), L("іван"))["type"], "reversed"),
        (lambda: N.breakpoint_quality(L("xyz"), L("петренко"), L("іван"))["quality"], 0.0), (lambda: N.standard_form(L("Саша"), VARIANTS), "олександр"), (lambda: N.is_variant_of(L("Саша"), L("Олександр"), VARIANTS), True),
        (lambda: N.is_variant_of(L("олександр"), L("саша"), VARIANTS), False), (lambda: N.starts_with_prefix(L("Іван"), L("ів")), True), (lambda: N.starts_with_prefix(L("Іван"), L("")), False), (lambda: N.translit_match(L("Serhiy"), L("Сергій"), 0.75), True),
        (lambda: N.split_name(L(" Шевченко  Тарас Іванович "))["firstname"], "Тарас Іванович"), (lambda: N.split_name(L("Шевченко Тарас Іванович"))["rev_surname"], "Іванович"), (lambda: N.split_name(L("Тарас"))["word"], "Тарас"),
        (lambda: chat.split_display_name(L("Bob (Роберт Коваль)"))["name"], "Роберт Коваль"), (lambda: chat.split_display_name(L("Bob (Роберт Коваль)"))["extra"], "Bob"), (lambda: chat.split_display_name(L("Іван (ІТ)"))["name"], "Іван"),
        (lambda: chat.split_display_name(L("Іван [гр. 2]"))["extra"], "гр. 2"), (lambda: chat.split_display_name(L("Іван [гр. 2]"))["name"], "Іван"), (lambda: chat.real_name_tag(L("hi RNM: Шевченко Тарас\n")), "Шевченко Тарас"), (lambda: chat.real_name_tag(L("rnm:  ")), None),
        (lambda: chat.first_body_line(L('\n Replying to "q": x\n  body \n')), "body"), (lambda: chat.first_body_line(L("\n\tfirst\nsecond")), "first"), (lambda: chat.clean_message(L("Оля:👍")), ""), (lambda: chat.clean_message(L("Оля: +")), "Оля: +"),
        (lambda: screen.neutralise(L("<script>x</script>")), "&lt;script>x&lt;/script&gt;"), (lambda: screen.clean_name(L("<b>О'Коннор</b>")), "ОКоннор"), (lambda: screen.clean_id(L("id 12-34")), "1234"), (lambda: screen.unsafe_reason(L("a onclick = b")), "handler"),
        (lambda: R.csv_split(L('1,"a,""b""",c')), ["1", 'a,"b"', "c"]), (lambda: R.csv_split(L('"",x,')), ["", "x", ""]), (lambda: screen.detect_format(L('{"a": 1}'), L("")), "json"), (lambda: screen.detect_format(L("a,b\nc,d"), L("x.dat")), "csv"), (lambda: screen.detect_format(L("{a"), L("")), "txt"),
    ],
)
def test_values(spark, make, want):
    got = value(spark, make())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_messages(spark):
    text = "09:00:01 From A to Bob(privately): x\n09:00:02 Від Іван Петренко до Всі: так\n09:00:03 From B C to Everyone:\n\tbody\nmore\n09:00:04 От Оля кому Все: да"
    rows = chat.messages(spark.createDataFrame([("c", "r", text), ("d", "r", ""), ("e", "r", None)], "chat_id string, roster_id string, text string")).orderBy("seq").collect()
    assert [(r.time, r.sender, r.body) for r in rows] == [("09:00:02", "Іван Петренко", "так"), ("09:00:03", "B C", "body"), ("09:00:04", "Оля", "да")]


def test_aliases_in_order(spark):
    text = "09:00:01 From Nick (Іван Петренко) to Everyone: a\n09:00:02 From Nick (Іван Петренко) to Everyone: rnm: Шевченко Тарас\n09:00:03 From Іван Петренко to Everyone: b"
    people, aliases = chat.parse_chat(spark.createDataFrame([("c", "r", text)], "chat_id string, roster_id string, text string"))
    assert {r.name: r.messages for r in people.collect()} == {"Іван Петренко": ["a", "rnm: Шевченко Тарас", "b"], "Nick (Іван Петренко)": ["a"]}
    assert {r.name: r.real_name for r in aliases.collect()} == {"Nick (Іван Петренко)": "Іван Петренко", "Іван Петренко": "Шевченко Тарас"}


def test_thread(spark):
    text = 'lost\n09:00:01 From Ann to Everyone: hi\n\nOля: 👍👍\nTime: 10\n@Bob K, see\n09:00:02 From Ann to Everyone: x\nReplying to " q ": own\nmore\n09:00:03 From Bob to Everyone:y'
    rows = thread.sender_runs(thread.thread_messages(spark.createDataFrame([("c", text)], "chat_id string, text string"))).orderBy("msg_id").collect()
    assert [(r.sender, r.content, r.is_reply, r.reply_to, r.mentions, [tuple(x) for x in r.reactions], r.run) for r in rows] == [
        ("Ann", "hi Time: 10 @Bob K, see", False, None, ["Bob K"], [("Oля", "👍👍")], 1), ("Ann", "own more", True, "q", [], [], 1), ("Bob", "y", False, None, [], [], 2),
    ]


def test_roster_formats(spark):
    files = lambda *x: spark.createDataFrame([(f"r{i}", c) for i, c in enumerate(x)], "roster_id string, content string")
    got = {r.full_name: r.id for r in R.roster_list(files("А Б:2\nВ Г\nД Е:3\n\nЖ З:2\nИ К\n77")).collect()}
    assert got == {"А Б": "2", "В Г": "2_1", "Д Е": "3", "И К": "5"}
    got = R.roster_csv(files('﻿Id, Прізвище ,name,нікнейм1,Nickname2\n7,"Коваль, мол.",Іван,vanya,\n,Бондар,Ольга\nx', "a,b\n1,2")).orderBy("pos").collect()
    assert [(r.id, r.surname, r.firstname, r.nicknames) for r in got] == [("7", "Коваль, мол.", "Іван", ["vanya"]), ("2", "Бондар", "Ольга", [])]
    got = R.roster_json(files('{"version":"3.0","entries":[{"id":"1","surname":"A","firstname":"B","nicknames":["n"]}]}', '{"database":[{"id":2,"surname":"C","firstname":"D"}]}', '{"Петренко Іван Р":"9","Один":"3"}')).collect()
    assert sorted((r.id, r.surname, r.firstname, tuple(r.nicknames)) for r in got) == [("1", "A", "B", ("n",)), ("2", "C", "D", ()), ("3", "Один", "", ()), ("9", "Петренко", "Іван Р", ())]
    got = R.roster_txt(files("Петренко Іван\n\nОдин\nКоваль  Ольга Р")).orderBy("pos").collect()
    assert [(r.id, r.surname, r.firstname) for r in got] == [("1", "Петренко", "Іван"), ("3", "Коваль", "Ольга Р")]


def test_attach_nicknames(spark):
    r = spark.createDataFrame([("r", 0, "1", "A", "B", ["a", "b"]), ("r", 1, "1", "C", "D", [])], "roster_id string, pos int, id string, surname string, firstname string, nicknames array<string>")
    adds = spark.createDataFrame([("r", "1", 1, "b"), ("r", "1", 2, "c")], "roster_id string, id string, ord int, nickname string")
    assert [x.nicknames for x in roster.attach_nicknames(r, adds).orderBy("pos").collect()] == [["a", "c"], []]
    assert roster.delete_entries(r, adds.select("roster_id", "id")).select("surname").collect()[0].surname == "C"


def test_files(spark, tmp_path):
    from rollcall.sources import chats, sinks

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("09:00:01 From A B to Everyone: x", encoding="utf-8")
    (tmp_path / "in/b.doc").write_text("no")
    rows = chats.read_chats(spark, str(tmp_path / "in"), "r").collect()
    assert len(rows) == 1 and rows[0].chat_id.endswith("a.txt") and rows[0].roster_id == "r"
    r = spark.createDataFrame([("r", 0, "1", 'Ко"в', "B,C", ["a"])], "roster_id string, pos int, id string, surname string, firstname string, nicknames array<string>")
    sinks.write_roster_csv(r, str(tmp_path / "csv"))
    assert [tuple(x)[:5] for x in spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect()] == [("1", 'Ко"в', "B,C", "a", None)]
    sinks.write_roster_json(r, str(tmp_path / "json"))
    back = R.roster_json(spark.read.text(str(tmp_path / "json")).selectExpr("roster_id", "value content")).collect()
    assert [(x.id, x.surname) for x in back] == [("1", 'Ко"в')]
    rep = spark.createDataFrame([("c", 0, 0, "1", "A", "", "n\"k", True, "exact-match")], "chat_id string, first_seq int, ord int, id string, surname string, firstname string, nickname string, found boolean, match_type string")
    sinks.write_attendance_tsv(rep, str(tmp_path / "tsv"))
    sinks.write_attendance_csv(rep, str(tmp_path / "acsv"))
    sinks.write_attendance_json(rep, str(tmp_path / "ajson"), "2024")
    line = next((tmp_path / "tsv/chat_id=c").glob("*.csv")).read_text(encoding="utf-8").splitlines()[1]
    assert line == '1\tA\t-\tn"k\tВ базі'
    line = next((tmp_path / "acsv/chat_id=c").glob("*.csv")).read_text(encoding="utf-8").splitlines()[1]
    assert line == '"1","A","-","n""k","В базі"'
    assert '"totalParticipants":1' in next((tmp_path / "ajson/chat_id=c").glob("*.txt")).read_text(encoding="utf-8")


def test_stream(spark, tmp_path):
    from rollcall.streaming import stream_messages

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("09:00:01 From A B to Everyone: x", encoding="utf-8")
    q = stream_messages(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert [(r.sender, r.body) for r in spark.table("seen").collect()] == [("A B", "x")]


def test_limits_of_the_format_may_be_lifted(spark):
    files = spark.createDataFrame([("r", "\n".join(f"Name{chr(97 + i % 26)} X{i}" for i in range(30)))], "roster_id string, content string")
    assert R.roster_list(files, limit=10).count() == 10 and R.roster_list(files, limit=None).count() == 30
    some, every = value(spark, N.latin_variants(L("єжехцчєжехцч"))), value(spark, N.latin_variants(L("єжехцчєжехцч"), None))
    assert len(some) == 10 and every[:10] == some and len(every) == len(set(every)) > 15


def test_json_without_people_gives_none(spark):
    texts = ['{"version":"3.0","entries":null}', '{"entries":{}}', '{"database":"x"}', '{"version":"1"}', "not json", '{"Петренко Іван":"7"}']
    files = spark.createDataFrame(list(enumerate(texts)), "roster_id int, content string")
    assert [(r.roster_id, r.surname, r.firstname, r.id) for r in R.roster_json(files).collect()] == [(5, "Петренко", "Іван", "7")]
