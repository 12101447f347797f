"""Screening of input texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, trim

# Size limits in bytes and allowed file name endings.
MAX_CHAT, MAX_ROSTER = 5 * 1024 * 1024, 2 * 1024 * 1024
CHAT_FILES, ROSTER_FILES = (".txt",), (".txt", ".csv", ".json")

#: What makes a text unsafe, by name.
UNSAFE = {
    "script": r"(?i)<script\b[^<]*(?:(?!</script>)<[^<]*)*</script>",
    "javascript": r"(?i)javascript:",
    "handler": r"(?i)on[A-Za-z0-9_]+\s*=",
    "cookie": r"(?i)document\.cookie",
    "eval": r"(?i)eval\s*\(",
    "exec_script": r"(?i)execScript",
    "function": r"(?i)Function\s*\(",
    "timer": r"(?i)setInterval|setTimeout|setImmediate",
}


def gate_files(files: DataFrame, endings: tuple[str, ...] = CHAT_FILES, max_size: int | None = None, path_col: str = "path", size_col: str = "size") -> DataFrame:
    """Files with an allowed ending and, if asked, a size of at most ``max_size``."""
    ok = F.lit(False)
    for e in endings:
        ok = ok | F.endswith(F.lower(F.col(path_col)), F.lit(e))
    return files.filter(ok & (F.col(size_col) <= max_size) if max_size is not None else ok)


def unsafe_flags(c: Column | str) -> dict[str, Column]:
    """S3: one flag per pattern."""
    return {name: F.coalesce(col(c).rlike(p), F.lit(False)) for name, p in UNSAFE.items()}


def flag_unsafe(c: Column | str) -> Column:
    """S3: whether any pattern occurs."""
    out = F.lit(False)
    for flag in unsafe_flags(c).values():
        out = out | flag
    return out


def unsafe_reason(c: Column | str) -> Column:
    """The first pattern that occurs, by name; null for safe texts."""
    return F.coalesce(*[F.when(flag, F.lit(name)) for name, flag in unsafe_flags(c).items()])


def neutralise(c: Column | str) -> Column:
    """Script tags, ``javascript:`` and event handlers rewritten so that they do nothing."""
    out = F.regexp_replace(col(c), r"(?i)<script", "&lt;script")
    out = F.regexp_replace(out, r"(?i)</script>", "&lt;/script&gt;")
    out = F.regexp_replace(out, r"(?i)javascript:", "javascript_blocked:")
    return F.regexp_replace(out, r"(?i)on[A-Za-z0-9_]+\s*=", "data-blocked-event=")


def screen_documents(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The safe rows with their text neutralised, and the others with a ``reason``."""
    marked = docs.withColumn("reason", unsafe_reason(text_col))
    safe = marked.filter("reason is null").drop("reason").withColumn(text_col, neutralise(text_col))
    return safe, marked.filter("reason is not null")


def detect_format(content: Column | str, name: Column | str) -> Column:
    """Json, csv or txt, from the file's ending, else from its content."""
    c, n = trim(content), F.lower(col(name))
    braces = (F.startswith(c, F.lit("{")) & F.endswith(c, F.lit("}"))) | (F.startswith(c, F.lit("[")) & F.endswith(c, F.lit("]")))
    json = braces & F.try_parse_json(F.when(braces, c)).isNotNull()
    csv = F.contains(c, F.lit(",")) & F.contains(c, F.lit("\n")) & ~F.contains(c, F.lit("{")) & ~F.contains(c, F.lit("["))
    by_name = F.coalesce(*[F.when(F.endswith(n, F.lit(f".{e}")), F.lit(e)) for e in ("json", "csv", "txt")])
    return F.coalesce(by_name, F.when(json, "json"), F.when(csv, "csv"), F.lit("txt"))


def clean_name(c: Column | str, size: int = 100) -> Column:
    """Without tags, the characters < > " ' & and ``javascript:``; at most ``size`` characters."""
    out = F.regexp_replace(col(c), r"<[^>]*>", "")
    out = F.regexp_replace(out, "[<>\"'&]", "")
    return F.substring(F.regexp_replace(out, r"(?i)javascript:", ""), 1, size)


def clean_id(c: Column | str, size: int = 10) -> Column:
    """The digits of an id, at most ``size``."""
    return F.substring(F.regexp_replace(col(c), "[^0-9]", ""), 1, size)
