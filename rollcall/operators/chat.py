"""Transcripts to messages, participants and real names.

``chats`` is (chat_id, roster_id, text), one transcript a row. Messages are found by one regular expression within the row, so that
parsing moves no data; only participants and real names group by (chat_id, name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PICTOGRAPH, col, trim
from ..storage import settle
from .ordering import RANGE, before, dealt, numbered, sums

# The words of a transcript in English, Ukrainian and Russian.
FROM = ("From", "Від", "От")
TO = ("to", "до", "кому")
EVERYONE = ("Everyone", "Всі", "Все")
REPLYING = ("Replying to", "Відповідь на", "Ответ на")

S = r"[\p{IsWhite_Space}]"
TIME = r"[0-9]{2}:[0-9]{2}:[0-9]{2}"
HEAD = rf"({TIME}){S}+(?:{'|'.join(FROM)}){S}+([^\r\n]*?){S}+(?:{'|'.join(TO)}){S}+(?:{'|'.join(EVERYONE)}):"
MESSAGE = rf"(?s){HEAD}(.*?)(?={TIME}{S}+(?:{'|'.join(FROM)})|\z)"


def extract_messages(chats: DataFrame) -> DataFrame:
    """(chat_id, roster_id, seq, time, sender_raw, block) of every public message; a sender never crosses a line end."""
    return _extracted(chats, "chat_id", "roster_id")


def _extracted(texts: DataFrame, *keep: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(MESSAGE), F.lit(0))
    rows = texts.select(*keep, F.posexplode(found).alias("seq", "m"))
    # One pass for all parts: neither time nor sender holds a line end.
    rows = rows.withColumn("v", F.split(F.regexp_replace("m", rf"(?s)\A{HEAD}(.*)\z", "$1\n$2\n$3"), "\n", 3))
    return rows.select(*keep, "seq", F.get("v", F.lit(0)).alias("time"), trim(F.get("v", F.lit(1))).alias("sender_raw"), F.get("v", F.lit(2)).alias("block"))


def segments(lines: DataFrame) -> DataFrame:
    """(chat_id, roster_id, segment, text) of lines (chat_id, roster_id, line_no, line): parts of a transcript that no message crosses.

    A part begins with a line that starts with a time and ``From``. The exception is a line behind one that ends in ``From`` (blank ones between
    them don't count): its time may be a sender.
    """
    key = ["chat_id"], ["line_no"]
    words = "|".join(FROM)
    rows = before(dealt(lines, *key), *key, "_previous", F.when(~F.col("line").rlike(rf"\A{S}*\z"), F.col("line")))
    begins = F.col("line").rlike(rf"\A{TIME}{S}+(?:{words})") & ~F.coalesce(F.col("_previous").rlike(rf"(?:{words}){S}*\z"), F.lit(False))
    rows = sums(rows, *key, segment=begins.cast("int")).drop("_previous", RANGE)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return rows.groupBy("chat_id", "roster_id", "segment").agg(text.alias("text"))


def messages_of_lines(lines: DataFrame) -> DataFrame:
    """P1 of lines (:func:`rollcall.sources.chats.read_chat_lines`): what :func:`extract_messages` gives of the whole text, whose last line ends in a line end, in as many tasks as the text needs."""
    rows = _extracted(segments(lines), "chat_id", "roster_id", "segment").withColumnRenamed("seq", "nth")
    rows = numbered(rows, ["chat_id"], ["segment", "nth"], "seq")
    return rows.select("chat_id", "roster_id", (F.col("seq") - 1).cast("int").alias("seq"), "time", "sender_raw", "block")


def first_body_line(block: Column | str) -> Column:
    """The first line that isn't blank; behind a line that announces a reply, the second."""
    lines = F.filter(F.transform(F.split(col(block), "\r?\n"), trim), lambda x: x != "")
    head = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    reply = F.lit(False)
    for prefix in REPLYING:
        reply = reply | F.startswith(head, F.lit(f'{prefix} "'))
    return F.when(reply, F.coalesce(F.get(lines, F.lit(1)), F.lit(""))).otherwise(head)


def clean_message(c: Column | str) -> Column:
    """Without reply lines and lines that are only a reaction; '' if nothing is left."""
    out = col(c)
    for prefix in REPLYING:
        out = F.regexp_replace(out, rf'(?m)^{prefix}{S}+"[^"]*":.*$', "")
    out = F.regexp_replace(out, rf"(?m)^[\p{{L}}\p{{M}}\p{{IsWhite_Space}},'\-]+:[{PICTOGRAPH}]+$", "")
    return trim(F.regexp_replace(out, rf"\n{S}*\n+", "\n"))


def real_name_tag(c: Column | str) -> Column:
    """What follows ``rnm:`` in a message, to its end; null without the tag or text behind it."""
    out = trim(F.regexp_extract(col(c), rf"(?is)rnm:{S}*(.*)\z", 1))
    return F.when(out != "", out)


def split_display_name(c: Column | str) -> Column:
    """P5: a struct of ``name`` and ``extra``: what of ``before (inside)`` is the name, and less a ``[remark]`` at the end."""
    x = trim(c)
    paren = rf"\A([^\r\n]*?){S}*\(([^\r\n]*?)\)\z"
    before, inside = trim(F.regexp_extract(x, paren, 1)), trim(F.regexp_extract(x, paren, 2))
    has = x.rlike(paren)
    remark = (F.length(inside) < 5) | inside.rlike(r"\A[A-ZА-ЯІЇЄҐ]+\z")
    full = F.contains(inside, F.lit(" ")) | (F.length(inside) > F.length(before))
    swap = has & ~remark & full
    name = F.when(swap, inside).when(has, before).otherwise(x)
    extra = F.when(swap, before).when(has, inside).otherwise("")
    square = rf"\A([^\r\n]*?){S}*\[([^\r\n]*?)\]\z"
    note = trim(F.regexp_extract(name, square, 2))
    noted = name.rlike(square)
    return F.struct(
        F.when(noted, trim(F.regexp_extract(name, square, 1))).otherwise(name).alias("name"),
        F.when(noted & (extra != ""), F.concat(extra, F.lit(", "), note)).when(noted, note).otherwise(extra).alias("extra"),
    )


def messages(chats: DataFrame) -> DataFrame:
    """(chat_id, roster_id, seq, time, sender_raw, sender, sender_extra, body), without messages that are empty once cleaned."""
    return cleaned(extract_messages(chats))


def cleaned(extracted: DataFrame) -> DataFrame:
    """P2-P5 of the rows of :func:`extract_messages` or :func:`messages_of_lines`."""
    rows = extracted.withColumn("body", clean_message(first_body_line("block"))).filter("body <> ''")
    rows = rows.withColumn("d", split_display_name("sender_raw"))
    return rows.select("chat_id", "roster_id", "seq", "time", "sender_raw", F.col("d.name").alias("sender"), F.col("d.extra").alias("sender_extra"), "body")


def _originals(rows: DataFrame) -> DataFrame:
    """Display names that differ from the name made of them, with their first message, where that comes before the name's own use."""
    shown = rows.filter("sender_raw <> sender").groupBy("chat_id", F.col("sender_raw").alias("name")).agg(F.min("seq").alias("first_seq"), F.min_by("body", "seq").alias("body"), F.min_by("sender", "seq").alias("sender"))
    used = rows.groupBy("chat_id", F.col("sender").alias("name")).agg(F.min("seq").alias("used"))
    return shown.join(used, ["chat_id", "name"], "left").filter("used is null or first_seq < used")


def participants(rows: DataFrame) -> DataFrame:
    """(chat_id, roster_id, name, first_seq, ord, messages) of every sender; a display name that differs also counts, with its first message.

    ``ord`` orders names of one message: the name, then the display name.
    """
    roster = rows.groupBy("chat_id").agg(F.first("roster_id").alias("roster_id"))
    named = rows.select("chat_id", F.col("sender").alias("name"), "seq", F.lit(0).alias("ord"), "body")
    extra = _originals(rows).select("chat_id", "name", F.col("first_seq").alias("seq"), F.lit(1).alias("ord"), "body")
    grouped = named.unionByName(extra).groupBy("chat_id", "name").agg(F.min(F.struct("seq", "ord")).alias("f"), F.sort_array(F.collect_list(F.struct("seq", "ord", "body"))).alias("m"))
    return grouped.join(roster, "chat_id").select("chat_id", "roster_id", "name", F.col("f.seq").alias("first_seq"), F.col("f.ord").alias("ord"), F.transform("m", lambda x: x["body"]).alias("messages"))


def aliases(rows: DataFrame) -> DataFrame:
    """(chat_id, name, real_name); of several the last in the transcript counts: display name, remark with a space, ``rnm:`` tag, in this order."""
    shown = _originals(rows).select("chat_id", "name", F.col("first_seq").alias("seq"), F.lit(1).alias("step"), F.col("sender").alias("value"))
    remark = rows.filter(F.contains("sender_extra", F.lit(" "))).select("chat_id", F.col("sender").alias("name"), "seq", F.lit(2).alias("step"), F.col("sender_extra").alias("value"))
    tag = rows.select("chat_id", F.col("sender").alias("name"), "seq", F.lit(3).alias("step"), real_name_tag("body").alias("value")).filter("value is not null")
    every = shown.unionByName(remark).unionByName(tag)
    return every.groupBy("chat_id", "name").agg(F.max_by("value", F.struct("seq", "step")).alias("real_name"))


def keyword_filter(people: DataFrame, keyword: str | None) -> DataFrame:
    """Those with a message that holds the keyword, without regard to case; a blank keyword keeps all."""
    if not keyword or not keyword.strip():
        return people
    return people.filter(F.exists("messages", lambda m: F.contains(F.lower(m), F.lit(keyword.lower()))))


def keywords_filter(people: DataFrame, keywords: DataFrame) -> DataFrame:
    """P8 for a table of keywords (chat_id, keyword): those with a message that holds one of their chat's keywords."""
    said = people.select("chat_id", "name", F.explode("messages").alias("m"))
    hits = said.join(keywords, "chat_id").filter(F.contains(F.lower("m"), F.lower("keyword"))).select("chat_id", "name").distinct()
    return people.join(hits, ["chat_id", "name"], "left_semi")


def parse_chat(chats: DataFrame, keyword: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Participants and aliases of every chat; messages are written once, as both read them several times."""
    rows = settle(messages(chats))
    return keyword_filter(participants(rows), keyword), aliases(rows)
