import duckdb
from pyspark.sql import functions as F

from rollcall.llm import quotes
from rollcall.llm.queries import ORACLE_SQL, op2_quote_links


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_nested_quotes_and_order(spark):
    rows = [
        (1, 0, "a", "Shall we meet on Monday?\nOr on Tuesday?"),
        (1, 1, "b", "Anne wrote:\n> Shall  we meet on MONDAY?\n> Or on Tuesday?\n\nMonday is fine."),
        (1, 2, "c", "> Or on Tuesday?\nTuesday for me.\n"),
        (1, 3, "a", ">> Or on Tuesday?\n> Tuesday for me.\nI see.\n\n> unknown words\nBye."),
        (1, 4, "b", "No quote here."),
        (1, 5, "c", ">Monday is fine.\nGreat."),
        (2, 0, "a", "Monday is fine."),
        (2, 7, "b", "> something else\n"),
        (3, 4, "z", None),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(rows_of(spark, rows).repartition(5)).collect()}
    assert {k: r.text for k, r in got.items()} == {
        (1, 0): "Shall we meet on Monday?\nOr on Tuesday?", (1, 1): "Monday is fine.", (1, 2): "Tuesday for me.", (1, 3): "I see.\nBye.", (1, 4): "No quote here.", (1, 5): "Great.", (2, 0): "Monday is fine.", (2, 7): "", (3, 4): "",
    }
    assert {k: (r.link, r.parent_turn, r.root_turn, r.depth) for k, r in got.items()} == {
        (1, 0): ("root", None, 0, 0), (1, 1): ("quote", 0, 0, 1), (1, 2): ("quote", 0, 0, 1), (1, 3): ("quote", 2, 0, 2), (1, 4): ("previous", 3, 0, 3), (1, 5): ("quote", 1, 0, 2),
        (2, 0): ("root", None, 0, 0), (2, 7): ("previous", 0, 0, 1), (3, 4): ("root", None, 4, 0),
    }
    assert [t for _, t in sorted((got[1, t].reply_order, t) for t in range(6))] == [0, 1, 2, 3, 5, 4]
    levels = {(r.mid, r.level, tuple(r.lines)) for r in quotes.passages(quotes.messages_of(rows_of(spark, rows))).collect()}
    assert any(x[1:] == (2, ("Or on Tuesday?",)) for x in levels)


def test_edge_rows(spark):
    rows = [(None, 0, "a", "x"), (None, 0, "a", "x"), (1, None, "a", "> x"), (1, 0, None, "x"), (1, 0, "b", "y"), (1, 1, "a", "> x\n" * 3000 + "z"), (1, 1, "a", "> x\n" * 3000 + "z")]
    got = quotes.conversations(rows_of(spark, rows)).collect()
    assert len(got) == 5 and sum(r.copies for r in got) == 7
    by = {(r.conv_id, r.turn, r.role): r for r in got}
    assert by[None, 0, "a"].reply_order is None and by[1, None, "a"].link == "root"
    assert by[1, 1, "a"].text == "z" and by[1, 1, "a"].link == "quote" and by[1, 1, "a"].parent_turn == 0
    assert sorted(r.reply_order for r in got if r.reply_order is not None) == [0, 1, 2]
    assert quotes.conversations(rows_of(spark, rows).limit(0)).count() == 0


def test_long_conversation(spark):
    rows = [(9, t, "a", f"words of {t}") for t in range(0, 1300, 2)]
    got = sorted(quotes.conversations(rows_of(spark, rows)).collect(), key=lambda r: r.turn)
    assert [r.depth for r in got] == [r.reply_order for r in got] == list(range(650))
    assert [r.parent_turn for r in got] == [None, *range(0, 1298, 2)]


def test_many_replies_and_far_turns(spark):
    """Thousands of answers to one message, turns like timestamps, and equal turns: nothing is gathered by conversation, and the order is whole."""
    rows = [(1, 1_700_000_000_000, "a", "the question of all")] + [(1, 1_700_000_000_000 + 1000 * (t // 2), "b", f"> the question of all\nanswer {t}") for t in range(2, 3000)]
    df = rows_of(spark, rows).withColumns({"said": F.lit(1), "mid": F.lit(2), "conv": F.lit(3), "at": F.lit(4)}).repartition(9)
    got = sorted(quotes.conversations(df).collect(), key=lambda r: r.reply_order)
    assert [r.reply_order for r in got] == list(range(len(rows))) and {r.depth for r in got[1:]} == {1} and {r.link for r in got[1:]} == {"quote"}
    assert [r.turn for r in got] == sorted(r.turn for r in got)
    assert quotes.quoted(df).columns == ["conv_id", "turn", "role", "text"] and quotes.quoted(df).count() == len(rows)


def test_numbers(spark):
    rows = spark.range(1000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(7))).repartition(6)
    got = sorted((r.at, r.x, r.id) for r in quotes.numbered(rows, "x", "id").collect())
    assert [g[0] for g in got] == list(range(1000)) and [g[1:] for g in got] == sorted(g[1:] for g in got)


def test_query(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    rel = db.sql(ORACLE_SQL["op2_quote_links"])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    got = [r.asDict() for r in op2_quote_links(spark, sf_dir).collect()]
    key = lambda r: (r["conv_id"], r["turn"])
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) > 20
