"""Rosters from texts (S6-S11). Input: (roster_id, content), one file a row; output: (roster_id, pos, id, surname, firstname, nicknames).

``pos`` is a person's place in the file. Each function is a column pipeline within the row, but for the list format, whose ids
depend on other lines of the same file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import split_name
from ..functions.text import trim
from .screen import ROSTER_FILES, clean_id, clean_name, detect_format, gate_files, screen_documents

NO_NAMES = "cast(array() as array<string>)"
# The names a roster column may have, in lower case.
COLUMNS = {"id": ("id",), "surname": ("прізвище", "surname"), "firstname": ("ім'я", "firstname", "name"), "nick1": ("нікнейм1", "nickname1"), "nick2": ("нікнейм2", "nickname2")}


def read_roster_files(spark: SparkSession, path: str, endings: tuple[str, ...] = ROSTER_FILES, max_size: int | None = None) -> DataFrame:
    """(roster_id, content, name) of roster files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("content"))
    return gate_files(files, endings, max_size).select(F.col("path").alias("roster_id"), "content", F.col("path").alias("name"))


def _lines(content: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(content, "\\A\ufeff", ""), "\r?\n"), lambda x: trim(x) != "")


def roster_txt(files: DataFrame) -> DataFrame:
    """A person a line, surname first; one-word lines are left out but counted in the id."""
    rows = files.select("roster_id", F.posexplode(_lines(F.col("content"))).alias("i", "line")).withColumn("n", split_name("line"))
    return rows.filter("n.surname is not null").select("roster_id", F.col("i").alias("pos"), (F.col("i") + 1).cast("string").alias("id"), "n.surname", "n.firstname", F.expr(NO_NAMES).alias("nicknames"))


def csv_split(line: Column | str) -> Column:
    """The fields of a line, quotes undone; a doubled quote is a quote, an empty field ''."""
    x = F.col(line) if isinstance(line, str) else line
    fields = F.regexp_extract_all(F.concat(F.lit(","), x), F.lit(r',("(?:[^"]|"")*"[^,]*|[^,]*)'), F.lit(1))

    def plain(f: Column) -> Column:
        quoted = F.startswith(f, F.lit('"'))
        inner = F.regexp_replace(f, r'(?s)\A"((?:[^"]|"")*)"([^,]*)\z', "$1$2")
        return F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(f)

    return F.transform(fields, plain)


def roster_csv(files: DataFrame) -> DataFrame:
    """Columns found by their names in either language; files without surname and firstname give nothing, short rows are dropped, a missing id is the row number."""
    rows = files.select("roster_id", _lines(F.col("content")).alias("lines")).withColumn("h", F.transform(csv_split(F.get("lines", F.lit(0))), lambda x: F.lower(trim(x))))
    where = {k: F.array_max(F.array(*[F.array_position("h", n) for n in names])) for k, names in COLUMNS.items()}
    rows = rows.select("roster_id", "lines", *[v.alias(f"at_{k}") for k, v in where.items()]).filter("at_surname > 0 and at_firstname > 0")
    rows = rows.select("*", F.posexplode("lines").alias("i", "line")).filter("i > 0").withColumn("v", csv_split("line"))
    rows = rows.filter(F.size("v") >= F.greatest("at_surname", "at_firstname"))
    value = lambda k: F.coalesce(F.when(F.col(f"at_{k}") > 0, F.get("v", (F.col(f"at_{k}") - 1).cast("int"))), F.lit(""))
    return rows.select(
        "roster_id", (F.col("i") - 1).alias("pos"), F.when(value("id") != "", trim(value("id"))).otherwise(F.col("i").cast("string")).alias("id"), trim(value("surname")).alias("surname"), trim(value("firstname")).alias("firstname"),
        F.filter(F.array(trim(value("nick1")), trim(value("nick2"))), lambda x: x != "").alias("nicknames"),
    )


def roster_json(files: DataFrame) -> DataFrame:
    """{version, entries: [...]}, {database: [...]} or the old {"Surname Firstname": id}. A file that has one of these keys but no list of people gives nothing."""
    person = "array<struct<id:string,surname:string,firstname:string,nicknames:array<string>>>"
    rows = files.select("roster_id", "content", F.from_json("content", f"struct<version:string,entries:{person},database:{person}>").alias("j"))
    people = F.coalesce("j.entries", "j.database")
    new = rows.filter(people.isNotNull()).select("roster_id", F.posexplode(people).alias("pos", "e"))
    new = new.select("roster_id", "pos", "e.id", F.coalesce("e.surname", F.lit("")).alias("surname"), F.coalesce("e.firstname", F.lit("")).alias("firstname"), F.coalesce("e.nicknames", F.expr(NO_NAMES)).alias("nicknames"))
    old = rows.filter(people.isNull()).select("roster_id", F.from_json("content", "map<string,string>").alias("m"))
    old = old.filter(~F.arrays_overlap(F.map_keys("m"), F.array(*map(F.lit, ("version", "entries", "database")))))
    names = old.select("roster_id", F.posexplode(F.map_entries("m")).alias("pos", "e")).select("roster_id", "pos", F.col("e.key").alias("full_name"), F.col("e.value").alias("id"))
    return new.unionByName(convert_legacy(names))


def convert_legacy(names: DataFrame) -> DataFrame:
    """(roster_id, pos, full_name, id) as people: first word surname, rest firstname; a single word is a surname."""
    n = split_name("full_name")
    return names.select("roster_id", "pos", F.col("id").cast("string").alias("id"), F.coalesce(n["surname"], n["word"], F.lit("")).alias("surname"), F.coalesce(n["firstname"], F.lit("")).alias("firstname"), F.expr(NO_NAMES).alias("nicknames"))


def roster_list(files: DataFrame, limit: int | None = 10_000) -> DataFrame:
    """(roster_id, pos, full_name, id) from lines ``Name:ID``, ``Name ID`` or ``Name``; of each file the first ``limit`` lines that aren't blank (a rule of the format), or all with None.

    An id that an earlier line has drops its line. Names without one get their line's number, with ``_1`` behind it if that is taken. A repeated name keeps
    its place and gets the last id.
    """
    lines = files.select("roster_id", F.posexplode(_lines(F.col("content")) if limit is None else F.slice(_lines(F.col("content")), 1, limit)).alias("i", "line"))
    lines = lines.withColumn("t", trim("line")).filter(~F.col("t").rlike(r"\A[0-9]+\z"))
    form = r"\A([^:]+)(?::|[\p{IsWhite_Space}]+)([0-9]+)\z"
    given = F.col("line").rlike(form)
    rows = lines.select("roster_id", "i", given.alias("given"), F.when(given, clean_name(trim(F.regexp_extract("line", form, 1)))).otherwise(clean_name("t")).alias("full_name"), F.when(given, clean_id(F.regexp_extract("line", form, 2))).alias("e"))
    rows = rows.filter("full_name <> ''")
    # The number a line claims: its own id, or its place. The first to claim a number has it; explicit lines that come later go.
    rows = rows.withColumn("claim", F.coalesce("e", (F.col("i") + 1).cast("string")))
    w = Window.partitionBy("roster_id", "claim").orderBy("i")
    rows = rows.withColumn("first", F.row_number().over(w) == 1).filter("first or not given")
    rows = rows.withColumn("id", F.when(F.col("first"), F.col("claim")).otherwise(F.concat("claim", F.lit("_1"))))
    return rows.groupBy("roster_id", "full_name").agg(F.min("i").alias("pos"), F.max_by("id", "i").alias("id")).select("roster_id", "pos", "full_name", "id")


def read_rosters(files: DataFrame) -> DataFrame:
    """Unsafe files are left out, the others are read by their format."""
    safe, _ = screen_documents(files, "content")
    kind = safe.withColumn("kind", detect_format("content", "name"))
    return roster_txt(kind.filter("kind = 'txt'")).unionByName(roster_csv(kind.filter("kind = 'csv'"))).unionByName(roster_json(kind.filter("kind = 'json'")))
