"""Matching in DuckDB's SQL, from the rules as they are written down; nothing of the DataFrame code is used.

Each part is a list of common table expressions over ``roster`` (the people), ``idx`` (their names) and ``asked`` (roster_id, name, real_name).
"""

from __future__ import annotations

# Letters of the two scripts and other spellings of single letters.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "є": "ye", "ж": "zh", "з": "z", "и": "y", "і": "i", "ї": "yi", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya",
}
OTHERS = {
    "г": ["g", "h"], "и": ["y", "i"], "і": ["i", "y", "yi"], "е": ["e", "ie"], "є": ["ye", "ie", "je"], "ж": ["zh", "j"], "х": ["kh", "h", "x"], "ц": ["ts", "c"], "ч": ["ch", "tch"], "ш": ["sh"], "щ": ["shch", "sch"],
    "ю": ["yu", "iu", "ju"], "я": ["ya", "ia", "ja"],
}
# Latin letter groups in Cyrillic script, then single letters, then corrections, each in the order in which they apply.
GROUPS = {
    "shch": "щ", "sch": "щ", "zh": "ж", "ch": "ч", "kh": "х", "sh": "ш", "ts": "ц", "ya": "я", "ye": "є", "yu": "ю", "yi": "ї", "ia": "я", "ie": "є", "iu": "ю", "ja": "я", "je": "є", "ju": "ю",
}
SINGLES = ("abvhgdejzyiklmnoprstufxc", "абвгґдежзиіклмнопрстуфхц")
FIXES = {"йа": "я", "йе": "є", "йу": "ю", "йі": "ї", "зг": "зґ"}
#: The dictionary of the registered queries.
VARIANTS = {"ваня": "іван", "саша": "олександр", "оля": "ольга", "люда": "людмила", "коля": "микола", "катя": "катерина", "таня": "тетяна", "міша": "михайло", "женя": "євген"}


def _title(x: str) -> str:
    return x[:1].upper() + x[1:]


def _map(items: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v}" for k, v in items.items()) + "}"


_LETTERS = _map({k: f"'{v}'" for a, b in LATIN.items() for k, v in ((a, b), (a.upper(), _title(b)))})
_OTHERS = _map({k: "[" + ", ".join(f"'{v}'" for v in spelt) + "]" for k, spelt in OTHERS.items()})
ONE_WORD = "^[A-Za-zА-Яа-яІіЇїЄєҐґ'']+$"
CYRILLIC = "[а-яА-ЯіІїЇєЄґҐ]"


def latin(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: coalesce({_LETTERS}[c], c)), '')"


def cyrillic(x: str) -> str:
    for a, b in GROUPS.items():
        x = f"replace(replace({x}, '{_title(a)}', '{b.upper()}'), '{a}', '{b}')"
    x = f"translate({x}, '{SINGLES[0] + SINGLES[0].upper()}', '{SINGLES[1] + SINGLES[1].upper()}')"
    for a, b in FIXES.items():
        x = f"replace({x}, '{a}', '{b}')"
    for a, b in FIXES.items():
        x = f"replace({x}, '{_title(a)}', '{_title(b)}')"
    return x


def one_byte(x: str) -> str:
    """Lower-case letters of both scripts and digits as one byte each, as DuckDB's levenshtein counts bytes."""
    return f"translate(lower({x}), 'абвгґдеєжзиіїйклмнопрстуфхцчшщьюя', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*+')"


def similarity(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE WHEN lower({a}) = lower({b}) THEN 1.0::DOUBLE ELSE 1 - CAST(levenshtein({one_byte(a)}, {one_byte(b)}) AS DOUBLE) / greatest(length({a}), length({b})) END"


def spellings(x: str) -> str:
    """The first ten distinct Latin spellings, in order."""
    chars = f"list_transform(string_split({x}, ''), lambda c: coalesce({_LETTERS}[c], c))"
    each = f"flatten(list_transform(range(1, length({x}) + 1), lambda i: list_transform(coalesce({_OTHERS}[lower({x}[i])], []), lambda a: array_to_string({chars}[:i - 1], '') || a || array_to_string({chars}[i + 1:], ''))))"
    every = f"([array_to_string({chars}, '')] || {each})"
    return f"list_filter({every}, lambda v, n: list_position({every}, v) = n)[:10]"


def russian(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, 'ы', 'и'), 'э', 'е'), 'ё', 'йо'), 'ъ', ''), 'ьи', 'ьі')"


def form(x: str) -> str:
    return f"CASE lower({x}) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in VARIANTS.items()) + f" ELSE lower({x}) END"


def is_variant(a: str, b: str) -> str:
    """B is a's standard form."""
    other = russian(f"lower({a})")
    return f"coalesce(length({a}) > 0 AND length({b}) > 0 AND CASE WHEN lower({a}) = lower({b}) THEN true WHEN ({form(a)}) <> lower({a}) THEN ({form(a)}) = lower({b}) WHEN {other} <> lower({a}) THEN ({form(other)}) = lower({b}) ELSE false END, false)"


_VT = "vt AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in VARIANTS.items()) + ") AS t(k, v))"


def possible(table: str, name: str, column: str) -> str:
    """``name`` as a table of (x, v): x from a column of a table, in lower case."""
    near = similarity("x", "k")
    return f"""{name} AS (
  SELECT DISTINCT x, v FROM (SELECT DISTINCT lower({column}) AS x FROM {table} WHERE length({column}) > 0) JOIN vt
    ON CASE WHEN EXISTS (SELECT 1 FROM vt d WHERE d.k = x) THEN k = x ELSE starts_with(x, k) OR starts_with(k, x) OR ({near}) > 0.7 END)"""


def _place(g: str, p: str) -> str:
    """Where the longest suffix of p begins in g; of letters only."""
    g, p = (f"regexp_replace({x}, '[^a-zа-яіїєґ]', '', 'g')" for x in (g, p))
    return f"list_filter(list_transform(range(1, length({p}) + 1), lambda i: strpos({g}, substring({p}, i))), lambda place: place > 0)[1]"


PEOPLE = "folk AS (SELECT roster_id, pos, id, full_name, lower(full_name) AS db_lower, lower(split_part(full_name, ' ', 1)) AS sur, lower(substring(full_name, length(split_part(full_name, ' ', 1)) + 2)) AS fir FROM idx)"

#: (roster_id, name, pos, id, full_name, q, combined).
SPLITS = f"""{PEOPLE}, glued AS (
  SELECT DISTINCT roster_id, name, unnest(range(len(fs))) AS f, unnest(fs) AS form FROM (
    SELECT roster_id, name, CASE WHEN regexp_matches(name, '[a-zA-Z]') AND lower({cyrillic("name")}) <> lower(name) THEN [lower({cyrillic("name")}), lower(name)] ELSE [lower(name)] END AS fs
    FROM asked WHERE NOT contains(name, ' ') AND length(name) >= 6)
), tried AS (
  SELECT roster_id, name, f, pos, id, full_name, contains(form, sur) AND contains(form, fir) AS inside, {similarity("form", "(sur || fir)")} AS ahead, {similarity("form", "(fir || sur)")} AS behind,
         {_place("form", "sur")} AS ps, {_place("form", "fir")} AS pf, length(sur) AS ls, length(fir) AS lf
  FROM glued JOIN folk USING (roster_id)
), options AS (
  SELECT roster_id, name, pos, id, full_name, ahead AS q, -f * 3 AS o, 'standard' AS combined FROM tried WHERE inside AND ahead > 0.8
  UNION ALL SELECT roster_id, name, pos, id, full_name, behind, -f * 3 - 1, 'reversed' FROM tried WHERE inside AND behind > 0.8
  UNION ALL SELECT roster_id, name, pos, id, full_name, CASE WHEN ps < pf THEN 0.85::DOUBLE ELSE 0.80::DOUBLE END, -f * 3 - 2, CASE WHEN ps < pf THEN 'standard' ELSE 'reversed' END FROM tried WHERE (ps < pf AND ps + ls <= pf) OR (pf < ps AND pf + lf <= ps)
), best_option AS (
  SELECT * FROM options QUALIFY row_number() OVER (PARTITION BY roster_id, name, pos ORDER BY q DESC, o DESC, combined DESC) = 1
), splits AS (
  SELECT * FROM best_option QUALIFY row_number() OVER (PARTITION BY roster_id, name, id ORDER BY q DESC, pos) = 1
)"""

_HAS_LATIN = "regexp_matches(name, '[a-zA-Z]')"
_NEAR = "least(length(v), length(p)) >= 3 AND least(length(v), length(p)) * least(length(v), length(p)) > 0.85 * greatest(length(v), length(p)) * greatest(length(v), length(p)) AND (left(v, 1) = left(p, 1) OR least(length(v), length(p)) < 4)"
_NAMES = "(SELECT DISTINCT roster_id, name FROM asked)"
#: (roster_id, name, rank, id, full_name, quality, part).
POSSIBLE = f"""{_VT}, {possible("asked", "forms_of_names", "name")}, spelled AS (
  SELECT roster_id, name, lower(name) AS v, false AS extra FROM {_NAMES}
  UNION SELECT roster_id, name, {form("name")}, false FROM {_NAMES}
  UNION SELECT roster_id, name, lower({cyrillic("name")}), false FROM {_NAMES} WHERE {_HAS_LATIN}
  UNION SELECT roster_id, name, f.v, true FROM {_NAMES} n JOIN forms_of_names f ON f.x = lower(n.name) WHERE {_HAS_LATIN}
), said_a AS (
  SELECT roster_id, name, 1 AS phase, -q AS o, pos, id, full_name, CAST(floor(q * 100 + 0.5) AS INTEGER) AS quality, 'split-name-' || combined AS part FROM splits WHERE regexp_matches(name, '{ONE_WORD}') AND length(name) >= 6
), sure AS (
  SELECT roster_id, name FROM said_a GROUP BY ALL HAVING max(quality) > 85
), open_spelled AS (
  SELECT DISTINCT roster_id, name, v FROM spelled ANTI JOIN sure USING (roster_id, name)
), said_b AS (
  SELECT o.roster_id, o.name, 2 AS phase, 0.0::DOUBLE AS o, pos, id, full_name, 100 AS quality, 'full-name-exact' AS part FROM open_spelled o JOIN folk ON folk.roster_id = o.roster_id AND db_lower = v
), only_first AS (
  SELECT roster_id, fir, any_value(pos) AS pos, any_value(id) AS id, any_value(full_name) AS full_name FROM (SELECT *, split_part(db_lower, ' ', 2) AS second FROM folk) GROUP BY roster_id, fir HAVING count(*) = 1
), said_c AS (
  SELECT o.roster_id, o.name, 3 AS phase, 0.0::DOUBLE AS o, pos, id, full_name, 95 AS quality, 'firstname-exact' AS part FROM open_spelled o JOIN only_first f ON f.roster_id = o.roster_id AND fir = v
  WHERE NOT EXISTS (SELECT 1 FROM said_b b WHERE b.roster_id = o.roster_id AND b.name = o.name AND b.full_name = f.full_name)
), exactly AS (
  SELECT * FROM said_a UNION ALL SELECT * FROM said_b UNION ALL SELECT * FROM said_c
), rest_words AS (
  SELECT roster_id, name, v FROM open_spelled ANTI JOIN exactly USING (roster_id, name)
), part_words AS (
  SELECT roster_id, pos, id, full_name, 'surname' AS side, sur AS p FROM folk UNION ALL SELECT roster_id, pos, id, full_name, 'firstname', fir FROM folk
), word_pairs AS (
  SELECT DISTINCT v, p, {is_variant("v", "p")} AS variant FROM rest_words JOIN part_words USING (roster_id) WHERE {is_variant("v", "p")} OR ({_NEAR})
), lcs AS (
  SELECT v, p, 0 AS i, list_transform(range(0, length(p) + 1), lambda j: 0) AS r FROM word_pairs WHERE NOT variant
  UNION ALL
  SELECT v, p, i + 1, [0] || list_transform(range(1, length(p) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda q: greatest(r[q + 1], r[q] + CASE WHEN substring(v, i + 1, 1) = substring(p, q, 1) THEN 1 ELSE 0 END))))
  FROM lcs WHERE i < length(v)
), scored_words AS (
  SELECT v, p, 90 AS quality, '-variant' AS kind FROM word_pairs WHERE variant
  UNION ALL SELECT v, p, CAST(floor(s * 90 + 0.5) AS INTEGER), '-similar' FROM (SELECT v, p, (CAST(r[-1] AS DOUBLE) / greatest(length(v), length(p))) * (CAST(least(length(v), length(p)) AS DOUBLE) / greatest(length(v), length(p))) AS s FROM lcs WHERE i = length(v)) WHERE s > 0.85
), late_all AS (
  SELECT roster_id, name, pos, id, full_name, quality, side || kind AS part FROM rest_words JOIN part_words USING (roster_id) JOIN scored_words USING (v, p)
), late_id AS (
  SELECT * FROM late_all QUALIFY row_number() OVER (PARTITION BY roster_id, name, id ORDER BY quality DESC, pos, part) = 1
), late AS (
  SELECT * FROM late_id QUALIFY row_number() OVER (PARTITION BY roster_id, name ORDER BY quality DESC, pos) <= 4
), possible AS (
  SELECT roster_id, name, id, full_name, quality, part, row_number() OVER (PARTITION BY roster_id, name ORDER BY phase, o, pos) AS rank FROM (
    SELECT * FROM exactly UNION ALL SELECT roster_id, name, 4, -CAST(quality AS DOUBLE), pos, id, full_name, quality, part FROM late)
)"""

#: (roster_id, name, candidates) of ambiguous one-word names.
AMBIGUOUS = f"""firsts AS (
  SELECT roster_id, fir, count(DISTINCT sur) AS surnames, count(*) AS n FROM folk GROUP BY ALL
), shared AS (
  SELECT DISTINCT s.roster_id, s.name FROM spelled s JOIN firsts USING (roster_id) WHERE NOT extra AND n > 1 AND surnames > 1 AND (fir = v OR {is_variant("v", "fir")} OR ({similarity("fir", "v")}) > 0.95)
), listed AS (
  SELECT roster_id, name, count(*) AS n, string_agg(id || ':' || quality, ',' ORDER BY rank) AS candidates FROM possible GROUP BY ALL
), split_count AS (
  SELECT roster_id, name, count(*) AS n, max(q) AS q FROM splits GROUP BY ALL
), ambiguous AS (
  SELECT roster_id, name, coalesce(l.candidates, '') AS candidates FROM (SELECT DISTINCT roster_id, name FROM asked WHERE regexp_matches(name, '{ONE_WORD}')) a
  LEFT JOIN listed l USING (roster_id, name) LEFT JOIN split_count c USING (roster_id, name) LEFT JOIN (SELECT *, true AS yes FROM shared) s USING (roster_id, name)
  WHERE CASE WHEN c.n = 1 AND c.q > 0.9 THEN false WHEN c.n > 1 THEN true WHEN s.yes THEN true ELSE coalesce(l.n > 1, false) END
)"""

_SIDES = (("sur", "dsur"), ("rsur", "dsur"), ("word", "dsur"), ("word", "dfir"), ("fir", "dfir"), ("rfir", "dfir"), ("lookup", "full_name"))
_JOINS = " ".join(f"LEFT JOIN sims s{i} ON s{i}.a = {a} AND s{i}.b = {b}" for i, (a, b) in enumerate(_SIDES))


def rules(asked: str) -> str:
    """``found`` (roster_id, lookup, pos, id, full_name, kind, quality, back) for a table with roster_id and lookup."""
    same = lambda a, b: f"lower({a}) = lower({b})"
    kinds = (
        (f"{same('sur', 'dsur')} AND {same('fir', 'dfir')}", "standard-order-exact", 98), (f"{same('sur', 'dsur')} AND s4.plain >= 0.75", "surname-exact-firstname-fuzzy", 90), ("s0.s >= 0.75 AND s4.s >= 0.75", "standard-order-translit", 85),
        (f"{same('sur', 'dsur')} AND {is_variant('fir', 'dfir')}", "standard-order-name-variant", 88), (f"{same('rsur', 'dsur')} AND {same('rfir', 'dfir')}", "reversed-order-exact", 92),
        (f"{same('rsur', 'dsur')} AND s5.plain >= 0.75", "reversed-surname-exact-firstname-fuzzy", 85), ("s1.s >= 0.75 AND s5.s >= 0.75", "reversed-order-translit", 80),
        (f"{same('rsur', 'dsur')} AND {is_variant('rfir', 'dfir')}", "reversed-order-name-variant", 82), ("s2.s >= 0.75", "single-word-surname-match", 70), ("s3.s >= 0.75", "single-word-firstname-match", 65),
        ("EXISTS (SELECT 1 FROM forms_of_words f WHERE f.x = lower(word) AND lower(f.v) = lower(dfir))", "single-word-variant-match", 75), ("s6.s >= 0.70", "full-name-translit", 60),
    )
    case = lambda value: "CASE " + " ".join(f"WHEN {test} THEN {value(k, q)}" for test, k, q in kinds) + " END"
    return f"""parts AS (
  SELECT roster_id, lookup, CASE WHEN len(w) = 1 THEN w[1] END AS word, CASE WHEN len(w) > 1 THEN w[1] END AS sur, CASE WHEN len(w) > 1 THEN array_to_string(w[2:], ' ') END AS fir,
         CASE WHEN len(w) > 1 THEN w[-1] END AS rsur, CASE WHEN len(w) > 1 THEN array_to_string(w[:-2], ' ') END AS rfir
  FROM (SELECT DISTINCT roster_id, lookup, string_split(lookup, ' ') AS w FROM {asked})
), {possible("parts", "forms_of_words", "word")}, tries AS (
  SELECT p.*, i.pos, i.id, i.full_name, split_part(full_name, ' ', 1) AS dsur, substring(full_name, length(split_part(full_name, ' ', 1)) + 2) AS dfir FROM parts p JOIN idx i USING (roster_id)
), strings AS (
  {" UNION ".join(f"SELECT DISTINCT {a} AS a, {b} AS b FROM tries WHERE {a} IS NOT NULL" for a, b in _SIDES)}
), spelled_out AS (
  SELECT x, {spellings("x")} AS spelt FROM (SELECT a AS x FROM strings UNION SELECT b FROM strings) WHERE regexp_matches(x, '{CYRILLIC}')
), sims AS (
  SELECT a, b, {similarity("a", "b")} AS plain, CASE WHEN lower(a) = lower(b) THEN 1.0::DOUBLE WHEN (ea.x IS NULL) = (eb.x IS NULL) THEN {similarity("a", "b")}
         WHEN ea.x IS NOT NULL THEN list_max(list_transform(ea.spelt, lambda v: {similarity("v", "b")})) ELSE list_max(list_transform(eb.spelt, lambda v: {similarity("v", "a")})) END AS s
  FROM strings LEFT JOIN spelled_out ea ON ea.x = a LEFT JOIN spelled_out eb ON eb.x = b
), found AS (
  SELECT * FROM (SELECT roster_id, lookup, pos, id, full_name, {case(lambda k, q: f"'{k}'")} AS kind, {case(lambda k, q: q)} AS quality, {case(lambda k, q: "true" if k.startswith("reversed") else "false")} AS back FROM tries {_JOINS}) WHERE kind IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY roster_id, lookup ORDER BY quality DESC, pos) AS rank FROM found
), best AS (
  SELECT roster_id, lookup, string_agg(id || ':' || quality, ',' ORDER BY rank) AS candidates, count(*) AS n, max(CASE WHEN rank = 1 THEN quality END) AS q1, max(CASE WHEN rank = 2 THEN quality END) AS q2,
         max(CASE WHEN rank = 1 THEN id END) AS id1, max(CASE WHEN rank = 1 THEN kind END) AS kind1, bool_or(CASE WHEN rank = 1 THEN back END) AS back1, max(CASE WHEN rank = 1 THEN full_name END) AS name1
  FROM ranked WHERE rank <= 3 GROUP BY ALL
), picked AS (
  SELECT *, coalesce(q1 - q2 < 5, false) AS open FROM best
)"""


#: ``resolved`` (roster_id, name, real_name, id, match_type, quality, reversed, db_name, candidates, n) of every asked name.
RESOLVED = f"""{SPLITS}, {POSSIBLE}, {AMBIGUOUS}, looked AS (
  SELECT *, coalesce(real_name, name) AS lookup FROM asked
), {rules("looked")}, nicks AS (
  SELECT roster_id, lower(nicknames[1]) AS nick, id AS nick_id FROM roster WHERE len(nicknames) > 0
), named AS (
  SELECT roster_id, id AS nick_id, arg_min(full_name, pos) AS nick_name FROM idx GROUP BY ALL
), kinds AS (
  SELECT l.*, a.candidates AS possible_ids, e.id AS exact_id, t.id AS tag_id, n.nick_id, named.nick_name, p.* EXCLUDE (roster_id, lookup),
         CASE WHEN a.name IS NOT NULL THEN 'ambiguous-name' WHEN e.id IS NOT NULL THEN 'exact-match' WHEN t.id IS NOT NULL THEN 'real-name-tag' WHEN n.nick_id IS NOT NULL THEN 'nickname-match' WHEN p.n IS NULL THEN 'not-found' WHEN p.open THEN 'multiple-matches' ELSE p.kind1 END AS match_type
  FROM looked l LEFT JOIN ambiguous a USING (roster_id, name) LEFT JOIN idx e ON e.roster_id = l.roster_id AND e.full_name = l.name LEFT JOIN idx t ON t.roster_id = l.roster_id AND t.full_name = l.real_name
  LEFT JOIN nicks n ON n.roster_id = l.roster_id AND n.nick = lower(l.lookup) LEFT JOIN named ON named.roster_id = l.roster_id AND named.nick_id = n.nick_id LEFT JOIN picked p ON p.roster_id = l.roster_id AND p.lookup = l.lookup
), resolved AS (
  SELECT roster_id, name, real_name, match_type, n AS n_rules,
         CASE match_type WHEN 'ambiguous-name' THEN NULL WHEN 'exact-match' THEN exact_id WHEN 'real-name-tag' THEN tag_id WHEN 'nickname-match' THEN nick_id WHEN 'multiple-matches' THEN NULL ELSE id1 END AS id,
         CASE match_type WHEN 'exact-match' THEN 100 WHEN 'real-name-tag' THEN 99 WHEN 'nickname-match' THEN 97 WHEN 'ambiguous-name' THEN 0 WHEN 'multiple-matches' THEN 0 ELSE coalesce(q1, 0) END AS quality,
         match_type NOT IN ('ambiguous-name', 'exact-match', 'real-name-tag', 'nickname-match', 'multiple-matches', 'not-found') AND back1 AS reversed,
         CASE match_type WHEN 'exact-match' THEN name WHEN 'real-name-tag' THEN real_name WHEN 'nickname-match' THEN nick_name WHEN 'ambiguous-name' THEN NULL WHEN 'multiple-matches' THEN NULL ELSE name1 END AS db_name,
         CASE match_type WHEN 'ambiguous-name' THEN possible_ids WHEN 'exact-match' THEN NULL WHEN 'real-name-tag' THEN NULL WHEN 'nickname-match' THEN NULL ELSE candidates END AS candidates
  FROM kinds
)"""
