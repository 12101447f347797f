"""Text helpers (N1-N4, N17-N20) and the trimming and number rules that all operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space at the ends of a text: Unicode white space and the byte order mark.
SPACE = r"[\p{IsWhite_Space}\x{FEFF}]"
#: Pictographs: symbols, emoji blocks with skin tones, dingbats and single signs of the basic plane.
PICTOGRAPH = r"\p{So}\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{203C}\x{2049}\x{2139}\x{2194}-\x{21AA}\x{3030}\x{303D}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(col(c), rf"\A{SPACE}+|{SPACE}+\z", "")


def words(c: Column | str) -> Column:
    """The words of a trimmed text, split at runs of Unicode white space."""
    return F.split(trim(c), rf"{SPACE}+")


def parse_int(c: Column | str) -> Column:
    """The number at the start of a text, else null: '12_1' gives 12, '?' null."""
    return F.regexp_extract(col(c), r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def levenshtein(a: Column | str, b: Column | str) -> Column:
    """Edits between two texts, in code points."""
    return F.levenshtein(col(a), col(b))


def likeness(x: Column | str, y: Column | str) -> Column:
    """N2 of texts in lower case: 1 less the share of edits of the longer text; 0 if either is empty or null."""
    x, y = col(x), col(y)
    longest = F.greatest(F.length(x), F.length(y))
    value = F.when((F.length(x) == 0) | (F.length(y) == 0), 0.0).when(x == y, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)
    return F.coalesce(value, F.lit(0.0))


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 less the share of edits of the longer text, without regard to case; 0 if either is empty or null."""
    return likeness(F.lower(col(a)), F.lower(col(b)))


def near_lengths(a: Column, b: Column, threshold: float | Column) -> Column:
    """Whether the lengths allow a similarity of ``threshold``: cheaper than counting edits, and never wrong."""
    x, y = F.length(a), F.length(b)
    return F.least(x, y) >= (F.lit(threshold) - F.lit(1e-9)) * F.greatest(x, y)


def fuzzy_match(a: Column | str, b: Column | str, threshold: float = 0.3) -> Column:
    """Similar up to ``threshold``."""
    return similarity(a, b) >= F.lit(1.0) - F.lit(threshold)


def similar(a: Column | str, b: Column | str, threshold: float = 0.8) -> Column:
    """Similar from ``threshold`` on."""
    return near_lengths(col(a), col(b), threshold) & (similarity(a, b) >= threshold)


def format_date(c: Column | str, with_time: bool = False) -> Column:
    """Day.month.year, with hours and minutes if asked; '' for what is no date."""
    return F.coalesce(F.date_format(F.try_to_timestamp(col(c).cast("string")), "dd.MM.yyyy HH:mm" if with_time else "dd.MM.yyyy"), F.lit(""))


def slug(c: Column | str, size: int = 30) -> Column:
    """Lower case, runs of other characters than letters, digits, _ and Cyrillic as one dash; null if nothing is left."""
    dashed = F.regexp_replace(F.lower(col(c)), r"[^A-Za-z0-9_\x{0400}-\x{04FF}]+", "-")
    out = F.substring(F.regexp_replace(dashed, r"\A-+|-+\z", ""), 1, size)
    return F.when(out != "", out)


def escape_html(c: Column | str) -> Column:
    """The five characters that HTML gives a meaning."""
    out = col(c)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def truncate(c: Column | str, size: int = 100) -> Column:
    """Texts above ``size`` end in three dots."""
    x = col(c)
    return F.when(F.length(x) > size, F.concat(F.substring(x, 1, size - 3), F.lit("..."))).otherwise(x)
