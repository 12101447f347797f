"""Transcripts as threads of messages with replies, reactions and mentions (P10-P15). Messages are numbered over ranges of lines, so that no chat is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PICTOGRAPH, trim
from .ordering import RANGE, before, dealt, sums

HEADER = r"([0-9]{2}:[0-9]{2}:[0-9]{2}) From ([^\r\n]*?) to Everyone:([^\r\n]*)\r?\z"
REPLY = r'\AReplying to "([^"]+)":(.*)\z'
REACTION = rf"\A([^:]+):[\p{{IsWhite_Space}}]*([{PICTOGRAPH}]+)"
MENTION = r"@([a-zA-Z0-9_\p{IsWhite_Space}]+)"


def lines_of(chats: DataFrame) -> DataFrame:
    """P10, first half: (chat_id, msg_id, line_no, is_header, line); lines before the first header and blank lines are dropped."""
    return numbered_lines(chats.select("chat_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """The same of lines (chat_id, line_no, line); a chat may hold any share of them."""
    key = ["chat_id"], ["line_no"]
    rows = lines.select("chat_id", "line_no", "line", F.col("line").rlike(HEADER).alias("is_header"))
    rows = sums(dealt(rows, *key), *key, msg_id=F.col("is_header").cast("int"))
    return rows.filter((F.col("msg_id") > 0) & (F.col("is_header") | (trim("line") != ""))).select("chat_id", "msg_id", "line_no", "is_header", "line")


def _joined(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def thread_messages(chats: DataFrame) -> DataFrame:
    """(chat_id, msg_id, time, sender, content, is_reply, reply_to, mentions, reactions).

    A reply line starts the content anew; a line ``user: pictographs`` is a reaction, not content; mentions are read from lines below the header.
    """
    return _threaded(lines_of(chats))


def thread_of_lines(lines: DataFrame) -> DataFrame:
    """P10-P14 of the lines of :func:`rollcall.sources.chats.read_chat_lines`, whose transcripts may be of any size."""
    return _threaded(numbered_lines(lines))


def _threaded(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("t", trim("line"))
    rows = rows.select(
        "chat_id", "msg_id", "line_no", "is_header", "t",
        (~F.col("is_header") & F.col("t").rlike(REPLY)).alias("reply"),
        (~F.col("is_header") & ~F.col("t").rlike(REPLY) & F.col("t").rlike(REACTION)).alias("reaction"),
    )
    head = F.when(F.col("is_header"), F.struct(F.regexp_extract("t", HEADER, 1).alias("time"), trim(F.regexp_extract("t", HEADER, 2)).alias("sender")))
    said = F.when(F.col("is_header"), trim(F.regexp_extract("t", HEADER, 3))).when(F.col("reply"), trim(F.regexp_extract("t", REPLY, 2))).when(~F.col("reaction"), F.col("t"))
    reaction = F.struct(trim(F.regexp_extract("t", REACTION, 1)).alias("user"), F.regexp_extract("t", REACTION, 2).alias("emoji"))
    mentions = F.when(~F.col("is_header"), F.transform(F.regexp_extract_all("t", F.lit(MENTION), F.lit(1)), trim))
    rows = rows.select("chat_id", "msg_id", "line_no", "reply", head.alias("head"), said.alias("said"), F.when(F.col("reaction"), reaction).alias("r"), F.when(F.col("reply"), trim(F.regexp_extract("t", REPLY, 1))).alias("quote"), mentions.alias("at"))
    kept = F.sort_array(F.collect_list(F.struct("line_no", "reply", "said", "quote", "r", "at")))
    m = rows.groupBy("chat_id", "msg_id").agg(F.first("head", ignorenulls=True).alias("h"), kept.alias("l"))
    last = F.array_max(F.transform(F.filter("l", lambda x: x["reply"]), lambda x: x["line_no"]))
    m = m.withColumn("last", last)
    content = F.transform(F.filter("l", lambda x: x["said"].isNotNull() & (F.col("last").isNull() | (x["line_no"] >= F.col("last")))), lambda x: x["said"])
    return m.select(
        "chat_id", "msg_id", F.col("h.time").alias("time"), F.col("h.sender").alias("sender"), _joined(content).alias("content"), F.col("last").isNotNull().alias("is_reply"),
        F.get(F.transform(F.filter("l", lambda x: x["line_no"] == F.col("last")), lambda x: x["quote"]), F.lit(0)).alias("reply_to"),
        F.array_distinct(F.flatten(F.transform("l", lambda x: F.coalesce(x["at"], F.array().cast("array<string>"))))).alias("mentions"),
        F.transform(F.filter("l", lambda x: x["r"].isNotNull()), lambda x: x["r"]).alias("reactions"),
    )


def sender_runs(thread: DataFrame) -> DataFrame:
    """With ``run``, the number (from 1) of the run of messages in a row by one sender; a chat may hold any share of the messages."""
    key = ["chat_id"], ["msg_id"]
    rows = before(dealt(thread, *key), *key, "_previous", F.struct("sender"))
    new = F.coalesce((F.col("sender") != F.col("_previous.sender")).cast("int"), F.lit(1))
    return sums(rows, *key, run=new).drop("_previous", RANGE)
