"""Personal names: splitting, transliteration, diminutives (N5-N16). Column in, Column out, but for :func:`possible_forms`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, similar, similarity, trim, words

# Ukrainian letters in Latin script; the soft sign has no counterpart and stays.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "є": "ye", "ж": "zh", "з": "z", "и": "y", "і": "i", "ї": "yi", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya",
}
# Other spellings of single letters.
SPELLINGS = {
    "г": ["g", "h"], "и": ["y", "i"], "і": ["i", "y", "yi"], "е": ["e", "ie"], "є": ["ye", "ie", "je"], "ж": ["zh", "j"], "х": ["kh", "h", "x"],
    "ц": ["ts", "c"], "ч": ["ch", "tch"], "ш": ["sh"], "щ": ["shch", "sch"], "ю": ["yu", "iu", "ju"], "я": ["ya", "ia", "ja"],
}
# Latin letter groups in Cyrillic script, longer ones first, then single letters, then corrections.
GROUPS = {
    "shch": "щ", "sch": "щ", "zh": "ж", "ch": "ч", "kh": "х", "sh": "ш", "ts": "ц", "ya": "я", "ye": "є", "yu": "ю", "yi": "ї", "ia": "я", "ie": "є", "iu": "ю", "ja": "я", "je": "є", "ju": "ю",
}
LETTERS = ("abvhgdejzyiklmnoprstufxc", "абвгґдежзиіклмнопрстуфхц")
CORRECTIONS = {"йа": "я", "йе": "є", "йу": "ю", "йі": "ї", "зг": "зґ"}
# Russian letters in Ukrainian spelling, in this order.
RUSSIAN = {"ы": "и", "э": "е", "ё": "йо", "ъ": "", "ьи": "ьі"}

CYRILLIC = "[а-яА-ЯіІїЇєЄґҐ]"
ONE_WORD = r"\A[A-Za-zА-Яа-яІіЇїЄєҐґ']+\z"


def _title(x: str) -> str:
    return x[:1].upper() + x[1:]


def split_name(c: Column | str) -> Column:
    """A struct of ``word`` (one-word names) or ``surname``, ``firstname`` (first word first) and ``rev_surname``, ``rev_firstname`` (last word first)."""
    w = words(c)
    n = F.size(w)
    many = n > 1
    rest = lambda start, size: F.array_join(F.slice(w, start, size), " ")
    blank = F.coalesce(trim(c), F.lit("")) == ""
    return F.struct(
        F.when(~blank & ~many, F.get(w, F.lit(0))).alias("word"),
        F.when(many, F.get(w, F.lit(0))).alias("surname"),
        F.when(many, rest(2, F.greatest(n - 1, F.lit(0)))).alias("firstname"),
        F.when(many, F.get(w, n - 1)).alias("rev_surname"),
        F.when(many, rest(1, F.greatest(n - 1, F.lit(0)))).alias("rev_firstname"),
    )


def to_latin(c: Column | str) -> Column:
    """Cyrillic letters in Latin script, upper case as a capital; other characters stay."""
    table = {**LATIN, **{a.upper(): _title(b) for a, b in LATIN.items() if a.upper() != a}}
    letters = F.map_from_arrays(F.split(F.lit(",".join(table)), ","), F.split(F.lit(",".join(table.values())), ","))  # folded into one constant
    return F.array_join(F.transform(F.split(F.coalesce(col(c), F.lit("")), ""), lambda x: F.coalesce(F.try_element_at(letters, x), x)), "")


def to_cyrillic(c: Column | str) -> Column:
    """Latin letters and letter groups in Cyrillic script, longest groups first, then corrections."""
    out = F.coalesce(col(c), F.lit(""))
    for a, b in GROUPS.items():
        out = F.replace(F.replace(out, F.lit(_title(a)), F.lit(b.upper())), F.lit(a), F.lit(b))
    out = F.translate(out, LETTERS[0] + LETTERS[0].upper(), LETTERS[1] + LETTERS[1].upper())
    for a, b in CORRECTIONS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    for a, b in CORRECTIONS.items():
        out = F.replace(out, F.lit(_title(a)), F.lit(_title(b)))
    return out


def latin_variants(c: Column | str, limit: int | None = 10) -> Column:
    """N6 of the text, and of the text with one letter spelled otherwise; the first ``limit`` distinct ones (a rule of the matching), or all with None."""
    x = col(c)
    table = F.create_map(*[v for k, alts in SPELLINGS.items() for v in (F.lit(k), F.array(*map(F.lit, alts)))])
    size = F.length(x)
    # The text between is transliterated once, so that each variant is three joined parts.
    at = lambda i: F.coalesce(F.try_element_at(table, F.lower(F.substring(x, i, F.lit(1)))), F.array().cast("array<string>"))
    each = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(at(i), lambda a: F.concat(to_latin(F.substring(x, F.lit(1), i - 1)), a, to_latin(F.substring(x, i + 1, size)))))
    variants = F.concat(F.array(to_latin(x)), F.when(size > 0, F.flatten(each)).otherwise(F.array().cast("array<string>")))
    distinct = F.array_distinct(variants)
    return F.when(size > 0, distinct if limit is None else F.slice(distinct, 1, limit)).otherwise(F.array().cast("array<string>"))


def has_cyrillic(c: Column | str) -> Column:
    return col(c).rlike(CYRILLIC)


def translit_match(a: Column | str, b: Column | str, threshold: float = 0.8, a_variants: Column | str | None = None, b_variants: Column | str | None = None) -> Column:
    """Equal but for case; of one script: similar; else some Latin spelling of the Cyrillic side is similar to the other."""
    x, y = col(a), col(b)
    vx = col(a_variants) if a_variants is not None else latin_variants(x)
    vy = col(b_variants) if b_variants is not None else latin_variants(y)
    cx, cy = has_cyrillic(x), has_cyrillic(y)
    some = lambda variants, other: F.exists(variants, lambda v: similar(v, other, threshold))
    full = (F.length(x) > 0) & (F.length(y) > 0)
    return F.coalesce(full & F.when(F.lower(x) == F.lower(y), True).when(cx == cy, similar(x, y, threshold)).when(cx, some(vx, y)).otherwise(some(vy, x)), F.lit(False))


def variants_map(variants: dict[str, str]) -> Column:
    """A dictionary of at most some thousand names as a map."""
    if not variants:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for k, v in variants.items() for x in (k, v)])


def load_variants(df: DataFrame, limit: int = 5_000) -> dict[str, str] | DataFrame:
    """A (variant, standard_form) table as a dictionary if it has up to ``limit`` rows, else the table itself: operators take either.

    Of repeated variants that with the largest ``pos`` wins, without that column the largest form.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    rows = [r for r in rows if r.variant and r.standard_form is not None]
    order = sorted(rows, key=lambda r: (r.pos, r.standard_form)) if "pos" in df.columns else sorted(rows, key=lambda r: r.standard_form)
    return {r.variant.lower(): r.standard_form for r in order}


def _hit(c: Column | str, variants: dict[str, str]) -> Column:
    return F.try_element_at(variants_map(variants), F.lower(col(c)))


def standard_form(c: Column | str, variants: dict[str, str]) -> Column:
    """The dictionary's form of a name, else the name in lower case."""
    return F.coalesce(_hit(c, variants), F.lower(col(c)), F.lit(""))


def russian_to_ukrainian(c: Column | str) -> Column:
    """Russian letters in Ukrainian spelling (lower case only)."""
    out = col(c)
    for a, b in RUSSIAN.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def is_variant_of(c: Column | str, standard: Column | str, variants: dict[str, str]) -> Column:
    """The same name, or one whose dictionary form is ``standard``, also after N12. Not symmetrical."""
    x, y = F.lower(col(c)), F.lower(col(standard))
    form = standard_form(x, variants)
    other = russian_to_ukrainian(x)
    value = F.when(x == y, True).when(form != x, form == y).when(other != x, standard_form(other, variants) == y).otherwise(False)
    return F.coalesce((F.length(x) > 0) & (F.length(y) > 0) & value, F.lit(False))


def possible_forms(c: Column | str, variants: dict[str, str]) -> Column:
    """The dictionary's form; without one the forms of all names that begin like this one (or it like them), and of those with a similarity over 0.7."""
    x = F.lower(col(c))
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in variants.items()]) if variants else F.array().cast("array<struct<k:string,v:string>>")
    begins = F.transform(F.filter(entries, lambda e: F.startswith(x, e["k"]) | F.startswith(e["k"], x)), lambda e: e["v"])
    near = F.transform(F.filter(entries, lambda e: similarity(x, e["k"]) > 0.7), lambda e: e["v"])
    direct = _hit(x, variants)
    found = F.when(direct.isNotNull(), F.array(direct)).otherwise(F.array_distinct(F.concat(begins, near)))
    return F.when(F.length(x) > 0, found).otherwise(F.array().cast("array<string>"))


def starts_with_prefix(c: Column | str, prefix: Column | str) -> Column:
    """Begins with, without regard to case; empty sides never do."""
    x, y = F.lower(col(c)), F.lower(col(prefix))
    return F.coalesce((F.length(x) > 0) & (F.length(y) > 0) & F.startswith(x, y), F.lit(False))


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence.

    Row by row of the usual table: up to 60 characters on the shorter side its differences are the bits of a number, so that a character of the longer side
    is one step; beyond that rows are arrays.
    """
    a, b = col(a), col(b)
    x, y = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    m, zero = F.length(y), F.lit(0).cast("long")
    full = F.call_function("shiftleft", F.lit(1).cast("long"), m) - 1
    # Where each character stands on the shorter side, as bits.
    mask = lambda c: F.aggregate(F.sequence(F.lit(1), m), zero, lambda acc, i: F.when(F.substring(y, i, F.lit(1)) == c, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i - 1))).otherwise(acc))

    def step(v: Column, c: Column) -> Column:
        both = v.bitwiseAND(mask(c))
        return (v + both).bitwiseOR(v - both).bitwiseAND(full)

    short = m - F.bit_count(F.aggregate(chars(x), full, step))

    def row(acc: Column, c: Column) -> Column:
        grow = lambda r, i: F.concat(r, F.array(F.greatest(F.element_at(r, -1), F.get(acc, i), F.get(acc, i - 1) + F.when(F.substring(y, i, F.lit(1)) == c, 1).otherwise(0))))
        return F.aggregate(F.sequence(F.lit(1), m), F.array(F.lit(0)), grow)

    long = F.element_at(F.aggregate(chars(x), F.array_repeat(F.lit(0), m + 1), row), -1)
    return F.when(m == 0, 0).when(m <= 60, short).otherwise(long).cast("int")


def order_similarity(a: Column | str, b: Column | str) -> Column:
    """The common subsequence's share of the longer text, times the ratio of lengths; 1 if equal, 0 if empty."""
    x, y = col(a), col(b)
    return order_ratio(lcs_length(x, y), x, y)


def order_ratio(common: Column, x: Column, y: Column) -> Column:
    n, m = F.greatest(F.length(x), F.length(y)), F.least(F.length(x), F.length(y))
    return F.when((F.length(x) == 0) | (F.length(y) == 0), 0.0).when(x == y, 1.0).otherwise((common / n) * (m / n))


def letters_only(c: Column | str) -> Column:
    """The lower-case letters of both scripts that a text has."""
    return F.regexp_replace(F.lower(col(c)), "[^a-zа-яіїєґ]", "")


def place_in(glued: Column | str, part: Column | str) -> tuple[Column, Column]:
    """Where (from 1) the longest suffix of a part that occurs in the glued name begins, else null, and the part's length; of letters only."""
    g, p = letters_only(glued), letters_only(part)
    found = F.filter(F.transform(F.sequence(F.lit(1), F.length(p)), lambda i: F.instr(g, F.substring(p, i, F.length(p)))), lambda at: at > 0)
    return F.when(F.length(p) > 0, F.get(found, F.lit(0))), F.length(p)


def in_order(ps: Column, ns: Column, pf: Column, nf: Column) -> Column:
    """A struct of ``quality`` and ``type`` from where surname and firstname begin, and how long they are."""
    both = ps.isNotNull() & pf.isNotNull()
    return (
        F.when(both & (ps < pf) & (ps + ns <= pf), F.struct(F.lit(0.85).alias("quality"), F.lit("standard").alias("type")))
        .when(both & (pf < ps) & (pf + nf <= ps), F.struct(F.lit(0.80).alias("quality"), F.lit("reversed").alias("type")))
        .when(ps.isNotNull() | pf.isNotNull(), F.struct(F.lit(0.70).alias("quality"), F.lit("partial").alias("type")))
        .otherwise(F.struct(F.lit(0.0).alias("quality"), F.lit("none").alias("type")))
    )


def breakpoint_quality(glued: Column | str, surname: Column | str, firstname: Column | str) -> Column:
    """How well a glued name is a surname and a firstname run together: a struct of ``quality`` and ``type``.

    The longest suffix of each part that occurs in the glued name gives its place; letters only.
    """
    return in_order(*place_in(glued, surname), *place_in(glued, firstname))
