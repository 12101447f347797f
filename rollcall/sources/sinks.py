"""Writers (S13-S17): each has a function that makes the rows, and one that writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import settle
from .bundles import write_lines

# Column names and states of the written tables.
ROSTER_HEADER = ("ID", "Прізвище", "Ім'я", "Нікнейм1", "Нікнейм2")
ATTENDANCE_HEADER = ("ID", "Прізвище", "Ім'я", "Zoom nickname", "Статус")
FOUND, NOT_FOUND = "В базі", "Не знайдено в базі"
VERSION = "3.0"


def roster_rows(roster: DataFrame) -> DataFrame:
    """The roster's columns under their written names, with the first two nicknames; in order of ``pos`` within a roster."""
    nick = lambda i: F.coalesce(F.get("nicknames", F.lit(i)), F.lit(""))
    values = (F.col("id"), F.col("surname"), F.col("firstname"), nick(0), nick(1))
    return roster.select("roster_id", "pos", *[v.alias(n) for v, n in zip(values, ROSTER_HEADER, strict=True)])


def write_roster_csv(roster: DataFrame, path: str) -> None:
    """A folder of CSV files per roster, quotes only where needed."""
    rows = roster_rows(roster).repartition("roster_id").sortWithinPartitions("roster_id", "pos").drop("pos")
    rows.write.partitionBy("roster_id").csv(path, header=True, escape='"', emptyValue="")


def roster_documents(roster: DataFrame) -> DataFrame:
    """(roster_id, value): each roster as one JSON text {version, entries}."""
    person = F.struct("pos", "id", "surname", "firstname", "nicknames")
    people = F.transform(F.sort_array(F.collect_list(person)), lambda x: F.struct(x["id"].alias("id"), x["surname"].alias("surname"), x["firstname"].alias("firstname"), x["nicknames"].alias("nicknames")))
    return roster.groupBy("roster_id").agg(people.alias("entries")).select("roster_id", F.to_json(F.struct(F.lit(VERSION).alias("version"), "entries")).alias("value"))


def write_roster_json(roster: DataFrame, path: str) -> None:
    roster_documents(roster).write.partitionBy("roster_id").text(path)


def _dash(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(x, F.lit("")) == "", "-").otherwise(x)


def attendance_rows(report: DataFrame) -> DataFrame:
    """(chat_id, first_seq, ord) and the five written columns; blanks as '-'."""
    values = (_dash("id"), _dash("surname"), _dash("firstname"), _dash("nickname"), F.when(F.col("found"), FOUND).otherwise(NOT_FOUND))
    return report.select("chat_id", "first_seq", "ord", *[v.alias(n) for v, n in zip(values, ATTENDANCE_HEADER, strict=True)])


def _write(report: DataFrame, path: str, **options: object) -> None:
    rows = attendance_rows(report).repartition("chat_id").sortWithinPartitions("chat_id", "first_seq", "ord").drop("first_seq", "ord")
    rows.write.partitionBy("chat_id").csv(path, header=True, **options)


def write_attendance_tsv(report: DataFrame, path: str) -> None:
    """Values parted by tabs, without quotes."""
    _write(report, path, sep="\t", quote="", emptyValue="")


def write_attendance_csv(report: DataFrame, path: str) -> None:
    """Every value in quotes, the id too."""
    _write(report, path, quoteAll=True, escape='"')


def attendance_lines(report: DataFrame) -> DataFrame:
    """(name, first_seq, ord, text): the lines of each meeting's CSV file, its header first; ``name`` is the meeting."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    rows = attendance_rows(report)
    lines = rows.select(F.col("chat_id").alias("name"), "first_seq", "ord", F.concat_ws(",", *[quoted(F.col(f"`{c}`")) for c in ATTENDANCE_HEADER]).alias("text"))
    # Before every row, as nulls come first.
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("first_seq", "ord")]
    return lines.unionByName(rows.select(F.col("chat_id").alias("name")).distinct().select("name", *none, F.concat_ws(",", *[quoted(F.lit(c)) for c in ATTENDANCE_HEADER]).alias("text")))


def write_attendance_bundle(report: DataFrame, path: str) -> None:
    """S16 for many meetings: each meeting's CSV file, header included, in few files (:mod:`rollcall.sources.bundles`)."""
    lines = settle(attendance_lines(report))  # read twice: ranges are found before rows are dealt
    write_lines(lines, path, "first_seq", "ord")


def write_attendance_files(report: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """S16 for many meetings: ``path/rows`` holds CSV files by ranges of meetings, with the meeting's id as the first column, and ``path/index``
    which file has which meeting (chat_id, file, n_rows). The number of files goes by the rows, not by the meetings; a meeting may hold any
    share of the rows, and then lies in several files.
    """
    order = ["chat_id", "first_seq", "ord"]
    rows = attendance_rows(report).repartitionByRange(*order).sortWithinPartitions(*order).drop("first_seq", "ord")
    rows.write.option("maxRecordsPerFile", rows_per_file).csv(f"{path}/rows", header=True, quoteAll=True, escape='"')
    written = report.sparkSession.read.schema(rows.schema).csv(f"{path}/rows", header=True, escape='"')
    index = written.groupBy("chat_id", F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_rows"))
    index.repartitionByRange("chat_id").sortWithinPartitions("chat_id", "file").write.parquet(f"{path}/index")


def read_attendance_file(spark: SparkSession, path: str, chat_id: str) -> DataFrame:
    """One meeting of :func:`write_attendance_files`, read from the files that the index names."""
    files = spark.read.parquet(f"{path}/index").filter(F.col("chat_id") == chat_id).select("file").collect()  # the files of one meeting
    schema = ", ".join(f"`{c}` string" for c in ("chat_id", *ATTENDANCE_HEADER))
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv([f"{path}/rows/{r.file}" for r in files], header=True, escape='"').filter(F.col("chat_id") == chat_id)


def attendance_documents(report: DataFrame, date: str) -> DataFrame:
    """(chat_id, value): each chat's report as JSON text; ``date`` is the time of the run."""
    kind = F.coalesce("match_type", F.lit("none"))
    person = F.struct("first_seq", "ord", F.struct("id", "surname", "firstname", "nickname", F.col("found").alias("inDatabase"), kind.alias("matchType")).alias("p"))
    people = F.transform(F.sort_array(F.collect_list(person)), lambda x: x["p"])
    rows = report.groupBy("chat_id").agg(F.count("*").alias("totalParticipants"), people.alias("participants"))
    return rows.select("chat_id", F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(date).alias("date"), "totalParticipants", "participants")).alias("value"))


def write_attendance_json(report: DataFrame, path: str, date: str) -> None:
    attendance_documents(report, date).write.partitionBy("chat_id").text(path)
