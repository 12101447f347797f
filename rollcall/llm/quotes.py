"""Quotation linking: messages with quoted passages become reply-ordered conversations without quotes.

Every line's quote level is the number of ``>`` in front of it. Lines of one level in a row are a passage. Passages are
normalised (lower case, white space folded) and hashed; equal hashes join quoted passages to the earliest message of the
same conversation that says them itself, as a whole or line by line. A message replies to the message that
most of its outermost quotation comes from, else to the one before it.

DataFrame functions only. No step gathers a conversation: order comes from numbers over the whole table, sorted by range, so that a
conversation, a turn or the replies to one message may hold any share of the rows; depths come from doubling pointers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

PREFIX = r"^[ \t]*((?:>[ \t]?)+)"


def norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def messages_of(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Distinct messages (conv, turn, role, text), how often each occurs, and an id ``mid``; null texts count as empty."""
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    once = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    return once.withColumn("mid", F.md5(F.to_json(F.struct("conv", "turn", "role", "text"))))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """With ``at``: each row's place in that order over the whole table, from 0. Rows are dealt by ranges of the order; only the
    partitions' sizes are summed in one place.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    dealt = saved(dealt.withColumn("part", F.shiftright(place, 33).cast("int")).withColumn("at", place.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before_ = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before_.alias("before"))  # one row a partition
    return dealt.join(F.broadcast(starts), "part").withColumn("at", F.col("at") + F.col("before")).drop("part", "before")


def passages(messages: DataFrame) -> DataFrame:
    """One row per passage: conv, turn, mid, block (from 0 in order), level (0: the message's own words), and its ``lines``."""
    line = F.posexplode(F.split("text", "\r\n|\n|\r")).alias("at", "line")
    rows = messages.select("conv", "turn", "mid", line)
    marks = F.regexp_extract("line", PREFIX, 1)
    rows = rows.withColumn("level", F.length(F.regexp_replace(marks, "[^>]", ""))).withColumn("line", F.rtrim(F.regexp_replace("line", PREFIX, "")))
    w = Window.partitionBy("mid").orderBy("at")
    # The line that announces a quotation belongs to neither.
    announces = (F.col("level") == 0) & F.col("line").rlike(r"(?i)\bwrote:$") & (F.lead("level").over(w) > 0)
    rows = rows.withColumn("announces", F.coalesce(announces, F.lit(False))).filter("not announces")
    new = F.when(F.col("level") != F.lag("level", 1, -1).over(w), 1).otherwise(0)
    rows = rows.withColumn("new", new).withColumn("block", F.sum("new").over(w) - 1)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return rows.groupBy("conv", "turn", "mid", "block", "level").agg(lines.alias("lines"))


def _hashed(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for the passage as a whole and one for each of its lines: ``h``, ``size`` and ``whole``."""
    whole = F.struct(norm(F.array_join("lines", "\n")).alias("t"), F.lit(True).alias("whole"))
    each = F.transform("lines", lambda x: F.struct(norm(x).alias("t"), F.lit(False).alias("whole")))
    parts = rows.select(*keep, F.explode(F.concat(F.array(whole), each)).alias("p")).filter("p.t <> ''")
    return parts.select(*keep, F.md5(F.col("p.t")).alias("h"), F.length("p.t").alias("size"), "p.whole")


def linked(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The messages' own words (mid, body), and the quoted passages' origins: mid, block, level, origin (a mid) and its turn."""
    parts = saved(passages(messages))
    trimmed = F.regexp_replace(F.regexp_replace(F.array_join("lines", "\n"), r"^(?:[ \t]*\n)+", ""), r"(?:\n[ \t]*)+$", "")
    own = parts.filter("level = 0").withColumn("t", trimmed).filter("t <> ''")
    bodies = own.groupBy("mid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "t"))), lambda x: x["t"]), "\n").alias("body"))
    says = _hashed(own.select("conv", "turn", "mid", "lines"), "conv", "turn", "mid").filter("conv is not null and turn is not null")
    first = says.groupBy("conv", "h").agg(F.min(F.struct("turn", "mid")).alias("origin"))
    asks = _hashed(parts.filter("level > 0 and conv is not null and turn is not null"), "conv", "turn", "mid", "block", "level")
    hits = asks.join(first, ["conv", "h"]).filter(F.col("origin") < F.struct("turn", "mid"))
    # A passage as a whole outweighs its lines; else the message that says most of it.
    votes = hits.groupBy("mid", "block", "level", "origin").agg(F.sum("size").alias("said"), F.max("whole").alias("whole"))
    best = votes.groupBy("mid", "block", "level").agg(F.max_by("origin", F.struct("whole", "said", "origin")).alias("origin"), F.max("said").alias("said"))
    return bodies, best.select("mid", "block", "level", F.col("origin.mid").alias("origin"), F.col("origin.turn").alias("origin_turn"), "said")


def before(messages: DataFrame) -> DataFrame:
    """mid and ``prev``: the message before it in its conversation, by turn and then mid; rows without conversation or turn have none."""
    rows = messages.filter("conv is not null and turn is not null").select("conv", "turn", "mid")
    placed = saved(numbered(rows, "conv", "turn", "mid"))
    earlier = placed.select((F.col("at") + 1).alias("at"), F.col("conv").alias("own"), F.col("mid").alias("prev"))
    return placed.join(earlier, "at", "left").select("mid", F.when(F.col("own") == F.col("conv"), F.col("prev")).alias("prev"))


def threads(parents: DataFrame) -> DataFrame:
    """mid, ``root`` and ``depth`` from (mid, parent); parents come earlier, so that there are no cycles.

    Pointers double each round, of messages alone that haven't reached their root: as many rounds as the logarithm of the depth.
    """
    state = saved(parents.select("mid", F.coalesce("parent", "mid").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    done, active = state.filter("depth = 0"), state.filter("depth > 0")
    while True:
        up = done.unionByName(active).select(F.col("mid").alias("root"), F.col("root").alias("far"), F.col("depth").alias("more"))
        step = active.join(up, "root").select("mid", F.col("far").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("far") != F.col("root")).alias("moved"))
        step = saved(step)
        done, active = done.unionByName(step.filter("not moved").drop("moved")), step.filter("moved").drop("moved")
        if active.isEmpty():
            return done


def conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct message: the four columns (``text`` without quotations), ``copies``, ``link`` ('quote', 'previous' or
    'root'), ``parent_turn``, ``root_turn``, ``depth`` and ``reply_order`` (from 0 in each conversation: by thread, then depth, then turn).

    Rows without a conversation or turn stand alone: link 'root', no ``root_turn`` and no ``reply_order``. Null texts become empty; texts may be of any
    length. Repeated rows count as ``copies``; of messages with the same turn the one with the smaller hash (128 bits of all its columns) comes first.
    Other columns aren't carried, whatever their names. An empty table gives no rows.
    """
    messages = saved(messages_of(df, conv_col, turn_col, role_col, text_col))
    bodies, origins = linked(messages)
    outermost = origins.groupBy("mid").agg(F.max_by("origin", F.struct(-F.col("level"), "said", "origin_turn", "origin")).alias("quoted"))
    parents = saved(
        messages.select("mid")
        .join(outermost, "mid", "left")
        .join(before(messages), "mid", "left")
        .select("mid", F.coalesce("quoted", "prev").alias("parent"), F.when(F.col("quoted").isNotNull(), "quote").when(F.col("prev").isNotNull(), "previous").otherwise("root").alias("link"))
    )
    tree = threads(parents)
    turns = messages.select("mid", "conv", "turn")
    rows = parents.join(tree, "mid").join(turns, "mid")
    rows = rows.join(turns.select(F.col("mid").alias("parent"), F.col("turn").alias("parent_turn")), "parent", "left")
    rows = saved(rows.join(turns.select(F.col("mid").alias("root"), F.col("turn").alias("root_turn")), "root"))
    placed = rows.filter("conv is not null and turn is not null").select("conv", "root_turn", "root", "depth", "turn", "mid")
    placed = saved(numbered(placed, "conv", "root_turn", "root", "depth", "turn", "mid"))
    starts = saved(placed.groupBy("conv").agg(F.min("at").alias("start")))
    order = placed.join(starts, "conv").select("mid", (F.col("at") - F.col("start")).alias("reply_order"))
    out = messages.select("mid", "conv", "turn", "role", "copies").join(bodies, "mid", "left").join(rows.select("mid", "link", "parent_turn", "root_turn", "depth"), "mid").join(order, "mid", "left")
    return out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.coalesce("body", F.lit("")).alias(text_col), "copies", "link", "parent_turn",
        F.when(F.col("conv").isNotNull(), F.col("root_turn")).alias("root_turn"), "depth", "reply_order",
    )


def quoted(df: DataFrame, levels: int = 2) -> DataFrame:
    """Mail made of a conversation table: every message quotes the turn before it, and that one's quotation of the turn before that."""
    df = df.select("conv_id", "turn", "role", "text")
    said = df.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("said"))
    out = df.withColumn("mail", F.coalesce("text", F.lit("")))
    for level in range(1, levels + 1):
        earlier = said.select("conv_id", (F.col("turn") + level).alias("turn"), F.col("said").alias("said"))
        marked = F.regexp_replace("said", r"(?m)^", "> " * level)
        out = out.join(earlier, ["conv_id", "turn"], "left").withColumn("mail", F.when(F.coalesce(norm(F.col("said")), F.lit("")) == "", F.col("mail")).otherwise(F.concat(marked, F.lit("\n"), F.col("mail")))).drop("said")
    return out.select("conv_id", "turn", "role", F.col("mail").alias("text"))


#: The same from the conversations themselves: each turn's parent is the first message with the words of the turn before it.
SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, count(*) AS copies, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM conversations GROUP BY ALL
), f AS (
  SELECT conv_id, t, min(turn) AS first_turn FROM m WHERE t <> '' GROUP BY ALL
), p AS (
  SELECT m.conv_id, m.turn, m.role, m.text, m.copies,
         CASE WHEN f.first_turn IS NOT NULL THEN f.first_turn ELSE lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn) END AS parent_turn,
         CASE WHEN f.first_turn IS NOT NULL THEN 'quote' WHEN lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn) IS NOT NULL THEN 'previous' ELSE 'root' END AS link
  FROM m LEFT JOIN m b ON b.conv_id = m.conv_id AND b.turn = m.turn - 1 LEFT JOIN f ON f.conv_id = b.conv_id AND f.t = b.t
), r AS (
  SELECT conv_id, turn, turn AS root_turn, CAST(0 AS BIGINT) AS depth FROM p WHERE parent_turn IS NULL
  UNION ALL
  SELECT p.conv_id, p.turn, r.root_turn, r.depth + 1 FROM p JOIN r ON r.conv_id = p.conv_id AND r.turn = p.parent_turn
)
SELECT p.conv_id, p.turn, p.role, p.text, p.copies, p.link, p.parent_turn, r.root_turn, r.depth,
       row_number() OVER (PARTITION BY p.conv_id ORDER BY r.root_turn, r.depth, p.turn) - 1 AS reply_order
FROM p JOIN r USING (conv_id, turn)
"""
