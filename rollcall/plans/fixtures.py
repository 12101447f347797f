"""Chats and rosters made of the given tables, by formulas that SQL can repeat.

A nation's customers are a roster; a conversation is a meeting whose speakers come from the roster ``conv_id % 25``. Names come from two short
lists, so that full names repeat within a roster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import spread

SURNAMES = ("Петренко", "Коваленко", "Мельник", "Шевченко", "Іваненко", "Бондар", "Ткачук", "Гончар", "Левченко", "Савчук", "Марченко", "Руденко", "Мороз", "Поліщук", "Кравець", "Лисенко")
FIRSTNAMES = ("Іван", "Сергій", "Олександр", "Тарас", "Ольга", "Людмила", "Микола", "Катерина", "Тетяна", "Михайло", "Євген", "Дмитро")
LATIN_SURNAMES = ("Petrenko", "Kovalenko", "Melnyk", "Shevchenko", "Ivanenko", "Bondar", "Tkachuk", "Honchar", "Levchenko", "Savchuk", "Marchenko", "Rudenko", "Moroz", "Polishchuk", "Kravets", "Lysenko")
LATIN_FIRSTNAMES = ("Ivan", "Serhiy", "Oleksandr", "Taras", "Olha", "Liudmyla", "Mykola", "Kateryna", "Tetiana", "Mykhailo", "Yevhen", "Dmytro")
SHORT = ("Ваня", "Сергій", "Саша", "Тарас", "Оля", "Люда", "Коля", "Катя", "Таня", "Міша", "Женя", "Дмитро")
ROSTERS = 25
#: The first person of each roster has a firstname of their own.
ALONE, LATIN_ALONE = "Устим", "Ustym"
#: A real name that is in no roster.
STRANGER = "Qwx Zvb"


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _name_numbers(key: Column) -> tuple[Column, Column]:
    return key % len(SURNAMES), F.floor(key / len(SURNAMES)) % len(FIRSTNAMES)


def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    s, f = _name_numbers(F.col("c_custkey"))
    pos = (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("int")
    nick = F.when(F.col("c_custkey") % 5 == 0, F.array(F.concat(F.lit("user"), F.col("c_custkey").cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = c.select(F.col("c_nationkey").cast("string").alias("roster_id"), pos.alias("pos"), F.col("c_custkey").cast("string").alias("id"), _pick(SURNAMES, s).alias("surname"), _pick(FIRSTNAMES, f).alias("firstname"), nick.alias("nicknames"))
    return rows.withColumn("firstname", F.when(F.col("pos") == 0, ALONE).otherwise(F.col("firstname")))


def small_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters of few people: a nation's suppliers."""
    c = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    s, f = _name_numbers(F.col("s_suppkey"))
    pos = (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).cast("int")
    return c.select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("roster_id"), pos.alias("pos"), F.col("s_suppkey").cast("string").alias("id"), _pick(SURNAMES, s).alias("surname"), _pick(FIRSTNAMES, f).alias("firstname"), F.array().cast("array<string>").alias("nicknames"))


def _given(values: tuple[str, ...], alone: str, f: Column) -> Column:
    """A firstname of turns as :func:`_placed` gives them."""
    return F.when(F.col("n") == 0, alone).otherwise(_pick(values, f))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the customer who says it."""
    m = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", "c_custkey")
    numbered = c.withColumn("n", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).withColumn("size", F.count("*").over(Window.partitionBy("c_nationkey")))
    sizes = numbered.groupBy("c_nationkey").agg(F.first("size").alias("size"))
    m = m.withColumn("c_nationkey", F.col("conv_id") % ROSTERS).join(sizes, "c_nationkey").withColumn("n", (F.col("conv_id") * 7 + F.col("turn") * 3) % F.col("size"))
    return spread(m.join(numbered.drop("size"), ["c_nationkey", "n"]), "conv_id")


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, roster_id, custkey, shown, text): who says each turn, and under which display name."""
    rows = _placed(spark, sf_dir)
    s, f = _name_numbers(F.col("c_custkey"))
    sur, first, short = _pick(SURNAMES, s), _given(FIRSTNAMES, ALONE, f), _given(SHORT, ALONE, f)
    form = (F.col("conv_id") + F.col("turn")) % 8
    join = lambda *p: F.concat_ws(" ", *p)
    shown = (
        F.when(form == 0, join(sur, first)).when(form == 1, join(first, sur)).when(form == 2, join(_given(LATIN_FIRSTNAMES, LATIN_ALONE, f), _pick(LATIN_SURNAMES, s))).when(form == 3, join(short, sur))
        .when(form == 4, join(sur, F.substring(first, F.lit(1), F.length(first) - 1))).when(form == 6, join(sur, short)).when(form == 7, join(F.substring(first, F.lit(1), F.length(first) - 1), sur)).otherwise(F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit(" ("), join(first, sur), F.lit(")")))
    )
    return rows.select("conv_id", "turn", F.col("c_nationkey").cast("string").alias("roster_id"), F.col("c_custkey").alias("custkey"), shown.alias("shown"), "text")


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chat_id, roster_id, text): transcripts in three languages, with one-word, glued, misspelt, cut, short, reversed and nicknames, ``rnm:`` tags (of people and of a stranger), continuation lines and private messages."""
    rows = _placed(spark, sf_dir)
    s, f = _name_numbers(F.col("c_custkey"))
    sur, first, short = _pick(SURNAMES, s), _given(FIRSTNAMES, ALONE, f), _given(SHORT, ALONE, f)
    form = (F.col("conv_id") * 3 + F.col("turn")) % 14
    full = F.concat_ws(" ", sur, first)
    shown = (
        F.when(form == 0, first).when(form == 1, sur).when(form == 2, F.lower(F.concat(_given(LATIN_FIRSTNAMES, LATIN_ALONE, f), _pick(LATIN_SURNAMES, s)))).when(form == 3, F.concat(F.lit("user"), F.col("c_custkey").cast("string")))
        .when(form == 4, F.concat(F.lit("Guest "), F.col("turn").cast("string"))).when(form == 5, F.concat(F.substring(sur, F.lit(1), F.length(sur) - 1), F.lit("а "), first)).when(form == 6, short)
        .when(form == 8, F.concat_ws(" ", first, sur)).when(form == 9, F.concat_ws(" ", sur, short)).when(form == 10, ALONE).when(form == 11, ALONE.lower()).when(form == 12, F.lower(full)).when(form == 13, F.concat_ws(" ", F.substring(first, F.lit(1), F.length(first) - 1), sur)).otherwise(full)
    )
    said = F.when(form == 4, F.concat(F.lit("rnm: "), full)).when(form.between(10, 12), F.lit(f"rnm: {STRANGER}")).otherwise(F.concat(F.lit("plus "), F.col("turn").cast("string")))
    word = lambda *w: _pick(w, F.col("conv_id") % 3)
    time = F.format_string("%02d:%02d:%02d", F.lit(9), F.col("turn").cast("int"), (F.col("conv_id") % 60).cast("int"))
    start, to = word("From", "Від", "От"), word("to", "до", "кому")
    line = F.concat_ws(" ", time, start, shown, to, F.concat(word("Everyone", "Всі", "Все"), F.lit(":")), said)
    private = F.concat_ws(" ", time, start, shown, to, F.lit("Bob (Direct Message): secret"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat(line, F.lit("\nmore of it\n"), private).alias("line")))), lambda x: x["line"])
    rows = rows.groupBy("conv_id", F.col("c_nationkey").cast("string").alias("roster_id")).agg(lines.alias("lines"))
    return rows.select(F.col("conv_id").cast("string").alias("chat_id"), "roster_id", F.array_join("lines", "\n").alias("text"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = speakers(spark, sf_dir)
    line = F.concat(F.format_string("%02d:%02d:%02d", F.lit(9), F.col("turn").cast("int"), (F.col("conv_id") % 60).cast("int")), F.lit(" From "), F.col("shown"), F.lit(" to Everyone: "), F.col("text"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("conv_id", "roster_id").agg(lines.alias("lines")).select(F.col("conv_id").cast("string").alias("chat_id"), "roster_id", F.array_join("lines", "\n").alias("text"))
