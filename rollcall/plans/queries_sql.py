"""The registered queries in DuckDB's SQL, made independently of the DataFrame code from the same formulas."""

from __future__ import annotations

from . import match_sql as M
from .fixtures import ALONE, FIRSTNAMES, LATIN_ALONE, LATIN_FIRSTNAMES, LATIN_SURNAMES, ROSTERS, SHORT, STRANGER, SURNAMES

# What makes a text unsafe, by name, as DuckDB writes it.
UNSAFE = {
    "script": r"(?is)<script\b.*?</script>", "javascript": "(?i)javascript:", "handler": r"(?i)on[A-Za-z0-9_]+\s*=", "cookie": r"(?i)document\.cookie", "eval": r"(?i)eval\s*\(", "exec_script": "(?i)execScript",
    "function": r"(?i)Function\s*\(", "timer": "(?i)setInterval|setTimeout|setImmediate",
}


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _at(values: tuple[str, ...], index: str) -> str:
    return f"({_list(values)})[CAST({index} AS INTEGER) + 1]"


_S, _F = f"c_custkey % {len(SURNAMES)}", f"(c_custkey // {len(SURNAMES)}) % {len(FIRSTNAMES)}"
_ROSTER = f"""roster AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS roster_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, CAST(c_custkey AS VARCHAR) AS id, c_custkey AS custkey,
         {_at(SURNAMES, _S)} AS surname, CASE WHEN pos = 0 THEN '{ALONE}' ELSE {_at(FIRSTNAMES, _F)} END AS firstname, CASE WHEN c_custkey % 5 = 0 THEN ['user' || c_custkey] ELSE CAST([] AS VARCHAR[]) END AS nicknames
  FROM customer)"""
_SPEAKERS = f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer
), placed AS (
  SELECT conv_id, turn, text, (conv_id + turn) % 8 AS form, c.c_custkey, c.c_nationkey, {_at(SURNAMES, _S)} AS sur, {_at(LATIN_SURNAMES, _S)} AS lsur,
         CASE WHEN c.n = 0 THEN '{ALONE}' ELSE {_at(FIRSTNAMES, _F)} END AS fir, CASE WHEN c.n = 0 THEN '{LATIN_ALONE}' ELSE {_at(LATIN_FIRSTNAMES, _F)} END AS lfir, CASE WHEN c.n = 0 THEN '{ALONE}' ELSE {_at(SHORT, _F)} END AS sfir
  FROM conversations m JOIN numbered c ON c.c_nationkey = m.conv_id % {ROSTERS} AND c.n = (m.conv_id * 7 + m.turn * 3) % c.size
), speakers AS (
  SELECT conv_id, turn, text, CAST(c_nationkey AS VARCHAR) AS roster_id, c_custkey AS custkey,
         CASE form WHEN 0 THEN sur || ' ' || fir WHEN 1 THEN fir || ' ' || sur WHEN 2 THEN lfir || ' ' || lsur WHEN 3 THEN sfir || ' ' || sur WHEN 4 THEN sur || ' ' || left(fir, -1)
              WHEN 6 THEN sur || ' ' || sfir WHEN 7 THEN left(fir, -1) || ' ' || sur ELSE 'user' || c_custkey || ' (' || fir || ' ' || sur || ')' END AS shown
  FROM placed)"""
_W, _WS = f"WITH {_ROSTER} ", f"WITH {_SPEAKERS} "
_BOTH = f"WITH {_ROSTER}, {_SPEAKERS} "
_INDEX = "idx AS (SELECT roster_id, surname || ' ' || firstname AS full_name, arg_max(id, pos) AS id, min(pos) AS pos FROM roster GROUP BY ALL)"
#: Messages as parsed: the first line of each turn, under the name that the display form gives.
_SAID = r"""said AS (
  SELECT CAST(conv_id AS VARCHAR) AS chat_id, roster_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, turn, shown,
         CASE WHEN shown LIKE '%(%' THEN regexp_extract(shown, '\((.*)\)$', 1) ELSE shown END AS name, trim(split_part(text, chr(10), 1)) AS body
  FROM speakers)"""
_PEOPLE = """keyed AS (
  SELECT chat_id, roster_id, name, seq, 0 AS ord, body FROM said
  UNION ALL SELECT chat_id, roster_id, shown, min(seq), 1, arg_min(body, seq) FROM said WHERE shown <> name GROUP BY ALL
), people AS (
  SELECT chat_id, roster_id, name, min(seq) AS first_seq, count(*) AS n_messages, string_agg(body, '|' ORDER BY seq, ord) AS messages FROM keyed GROUP BY ALL
), real AS (
  SELECT chat_id, shown AS name, arg_min(name, seq) AS real_name FROM said WHERE shown <> name GROUP BY ALL
)"""
_CHAT = f"WITH {_ROSTER}, {_SPEAKERS}, {_SAID}, {_PEOPLE}, {_INDEX} "


_latin, _cyrillic, _similarity, _form = M.latin, M.cyrillic, M.similarity, M.form


def _edits(a: str, b: str) -> str:
    return f"levenshtein({M.one_byte(a)}, {M.one_byte(b)})"


_PAIRS = f"""{_W}, pairs AS (
  SELECT r.roster_id, r.id, b.surname AS b, CASE WHEN r.pos % 2 = 0 THEN substring(b.surname, 1, 3) || substring(b.surname, 5) ELSE upper(r.surname) END AS a
  FROM roster r JOIN roster b ON b.roster_id = r.roster_id AND b.pos = r.pos + 1)"""
_SIM = _similarity("a", "b")
_MAIL = f"""{_WS}, mail AS (
  SELECT CAST(conv_id AS VARCHAR) AS chat_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS msg_id, replace(text, chr(10), ' ') AS said, CASE WHEN turn % 4 < 2 THEN 'Ann' ELSE 'Bob' END AS sender FROM speakers)"""

SQL: dict[str, str] = {
    "s2_gate_files": "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages WHERE page_id % 2 = 0 AND octet_length(encode(html)) <= 4000",
    "s3_flag_unsafe": "SELECT page_id, " + " OR ".join(f"regexp_matches(html, '{v}')" for v in UNSAFE.values()) + f" AS unsafe, regexp_matches(html, '{UNSAFE['script']}') AS script, regexp_matches(html, '{UNSAFE['handler']}') AS handler FROM pages",
    "s5_screen_documents": "SELECT doc_id, CAST(length(CASE WHEN reason = '' THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<script', '&lt;script', 'gi'), '</script>', '&lt;/script&gt;', 'gi'), 'javascript:', 'javascript_blocked:', 'gi'), 'on[A-Za-z0-9_]+\\s*=', 'data-blocked-event=', 'gi') ELSE text END) AS BIGINT) AS n, reason FROM (SELECT doc_id, text, CASE "
    + " ".join(f"WHEN regexp_matches(text, '{v}') THEN '{k}'" for k, v in UNSAFE.items())
    + " ELSE '' END AS reason FROM documents)",
    "s4_neutralise": r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script', '&lt;script', 'gi'), '</script>', '&lt;/script&gt;', 'gi'), 'javascript:', 'javascript_blocked:', 'gi'), 'on[A-Za-z0-9_]+\s*=', 'data-blocked-event=', 'gi') AS html FROM pages",
    "s6_detect_format": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'csv' WHEN 2 THEN 'txt' ELSE CASE WHEN contains(html, ',') AND contains(trim(html), chr(10)) AND NOT contains(html, '{') AND NOT contains(html, '[') THEN 'csv' ELSE 'txt' END END AS format FROM pages",
    "s7_roster_txt": f"{_W} SELECT roster_id, pos, CAST(pos + 1 AS VARCHAR) AS id, surname, firstname FROM roster",
    "s8_roster_csv": f"{_W} SELECT roster_id, pos, id, surname, firstname, coalesce(nicknames[1], '') AS nicknames FROM roster",
    "s9_csv_split": "SELECT conv_id, turn, CAST(3 AS BIGINT) AS n, replace(text, chr(10), ' ') AS a, 'x' AS b, 'a,\"b\"' AS c FROM conversations",
    "s10_roster_json": f"{_W} SELECT roster_id, pos, id, surname, firstname, array_to_string(nicknames, ',') AS nicknames FROM roster",
    "s12_clean_name": "SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[<>\"''&]', '', 'g'), 'javascript:', '', 'gi'), 100) AS name, left(regexp_replace(url, '[^0-9]', '', 'g'), 10) AS id FROM pages",
    "s13_roster_rows": f"{_W} SELECT roster_id, pos, id, surname, coalesce(nicknames[1], '') AS nick1, '' AS nick2 FROM roster",
    "p1_messages": f"{_WS}, {_SAID} SELECT chat_id, seq, '09:' || lpad(CAST(turn AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(chat_id AS BIGINT) % 60 AS VARCHAR), 2, '0') AS time, shown AS sender_raw FROM said",
    "p2_first_body_line": f"{_WS}, {_SAID} SELECT chat_id, seq, body FROM said",
    "p3_clean_message": "SELECT conv_id, turn, trim(text) AS body FROM conversations",
    "p4_real_name_tag": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text) END AS real_name FROM conversations",
    "p6_participants": f"{_CHAT} SELECT chat_id, roster_id, name, first_seq, n_messages, messages FROM people",
    "p7_aliases": f"{_CHAT} SELECT chat_id, name, real_name FROM real",
    "p8_keyword": f"{_CHAT} SELECT DISTINCT chat_id, name FROM keyed WHERE contains(lower(body), 'ing')",
    "p10_thread": f"{_WS}, {_SAID}, m AS (SELECT CAST(conv_id AS VARCHAR) AS chat_id, turn, regexp_replace(text, '\\s*\\n\\s*', ' ', 'g') AS content FROM speakers) SELECT s.chat_id, s.seq + 1 AS msg_id, '09:' || lpad(CAST(s.turn AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(s.chat_id AS BIGINT) % 60 AS VARCHAR), 2, '0') AS time, s.shown AS sender, trim(m.content) AS content, false AS is_reply, CAST(0 AS BIGINT) AS n_reactions FROM said s JOIN m USING (chat_id, turn)",
    "p11_replies": f"{_MAIL} SELECT chat_id, msg_id, trim(said || ' Time: 10 @bob_1, @bob_1') AS content, true AS is_reply, 'q q' AS reply_to, 'bob_1' AS mentions, 'Оля=👍' AS reactions FROM mail",
    "p15_sender_runs": f"{_MAIL}, f AS (SELECT *, CASE WHEN sender = lag(sender) OVER (PARTITION BY chat_id ORDER BY msg_id) THEN 0 ELSE 1 END AS new FROM mail) SELECT chat_id, msg_id, sender, CAST(sum(new) OVER (PARTITION BY chat_id ORDER BY msg_id) AS BIGINT) AS run FROM f",
    "n1_similarity": f"{_PAIRS} SELECT roster_id, id, CAST({_edits('a', 'b')} AS BIGINT) AS edits, {_SIM} AS similarity, ({_SIM}) >= 1.0::DOUBLE - 0.3::DOUBLE AS fuzzy, ({_SIM}) >= 0.8::DOUBLE AS similar FROM pairs",
    "n5_split_name": f"{_WS}, w AS (SELECT conv_id, turn, string_split(shown, ' ') AS w FROM speakers) SELECT conv_id, turn, CASE WHEN len(w) = 1 THEN w[1] END AS word, CASE WHEN len(w) > 1 THEN w[1] END AS surname, CASE WHEN len(w) > 1 THEN array_to_string(w[2:], ' ') END AS firstname, CASE WHEN len(w) > 1 THEN w[-1] END AS rev_surname, CASE WHEN len(w) > 1 THEN array_to_string(w[:-2], ' ') END AS rev_firstname FROM w",
    "n6_to_latin": f"{_W} SELECT roster_id, id, {_latin('surname')} AS surname, {_latin('firstname')} AS firstname FROM roster",
    "n7_to_cyrillic": f"{_WS} SELECT conv_id, turn, {_cyrillic('shown')} AS shown FROM speakers",
    "n10_forms": f"{_WS} SELECT conv_id, turn, {_form('split_part(shown, chr(32), 1)')} AS form, replace(replace(replace(replace(replace(lower(split_part(shown, ' ', 1)), 'ы', 'и'), 'э', 'е'), 'ё', 'йо'), 'ъ', ''), 'ьи', 'ьі') AS ukrainian, starts_with(lower(shown), 'са') AS begins FROM speakers",
    "n16_breakpoints": f"{_W}, g AS (SELECT roster_id, id, length(surname) AS ls, length(firstname) AS lf, CASE WHEN pos % 2 = 0 THEN lower(firstname || surname) ELSE lower(surname || firstname) END AS g, lower(surname) AS s, lower(firstname) AS f FROM roster), p AS (SELECT *, strpos(g, s) AS ps, strpos(g, f) AS pf FROM g) SELECT roster_id, id, CASE WHEN ps < pf AND ps + ls <= pf THEN 0.85::DOUBLE WHEN pf < ps AND pf + lf <= ps THEN 0.80::DOUBLE ELSE 0.70::DOUBLE END AS quality, CASE WHEN ps < pf AND ps + ls <= pf THEN 'standard' WHEN pf < ps AND pf + lf <= ps THEN 'reversed' ELSE 'partial' END AS type FROM p",
    "n17_presentation": "WITH o AS (SELECT o_orderkey, o_orderdate AS d, '<b>O''' || o_orderpriority || '\"&</b>' AS t FROM orders) SELECT o_orderkey, strftime(d, '%d.%m.%Y') AS date, left(regexp_replace(regexp_replace(lower(t), '[^a-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g'), 30) AS slug, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS html, CASE WHEN length(t) > 12 THEN left(t, 9) || '...' ELSE t END AS short FROM o",
    "d1_name_index": f"{_W}, {_INDEX} SELECT roster_id, full_name, id, pos FROM idx",
    "d2_nickname_index": f"{_W} SELECT roster_id, lower(nicknames[1]) AS nick, id FROM roster WHERE len(nicknames) > 0",
    "d3_lookups": f"{_W}, {_INDEX} SELECT r.roster_id, r.id AS asked, idx.id AS by_name, CASE WHEN len(r.nicknames) > 0 THEN r.id END AS by_nickname FROM roster r JOIN idx ON idx.roster_id = r.roster_id AND idx.full_name = r.surname || ' ' || r.firstname",
    "d4_filter_entries": f"{_W} SELECT roster_id, id, surname FROM roster WHERE len(nicknames) > 0 AND starts_with(surname, 'М')",
    "d5_search": f"{_W} SELECT roster_id, id, surname FROM roster WHERE contains(lower(surname), 'енк') OR contains(lower(firstname), 'енк')",
    "d6_ranked_search": f"{_W}, {_INDEX}, q AS (SELECT DISTINCT roster_id, unnest(['ко', 'іван']) AS query FROM roster), f AS (SELECT q.roster_id, query, full_name, id, pos, {_similarity('full_name', 'query')} AS s FROM q JOIN idx USING (roster_id) WHERE contains(lower(full_name), query)) SELECT roster_id, query, full_name, id, row_number() OVER (PARTITION BY roster_id, query ORDER BY s DESC, pos) AS rank FROM f",
    "d7_next_id": f"{_W} SELECT roster_id, CAST(max(custkey) + 1 AS VARCHAR) AS next_id FROM roster GROUP BY 1",
    "d8_add_entries": f"{_W}, e AS (SELECT roster_id, max(pos) AS last, max(custkey) AS top FROM roster GROUP BY 1), n AS (SELECT r.roster_id, r.pos, r.id, r.surname, last, top, row_number() OVER w AS nth, count(*) FILTER (r.pos % 4 <> 1) OVER w AS missing FROM roster r JOIN e USING (roster_id) WHERE r.pos % 4 < 3 WINDOW w AS (PARTITION BY r.roster_id ORDER BY r.pos)) SELECT roster_id, pos, id, surname, array_to_string(nicknames, ',') AS nicknames FROM roster UNION ALL SELECT roster_id, last + nth, CASE WHEN pos % 4 = 1 THEN 'x' || id ELSE CAST(top + missing AS VARCHAR) END, 'Нова' || surname, 'n1' FROM n",
    "d9_update_entries": f"{_W} SELECT roster_id, id, CASE WHEN pos % 3 = 0 THEN 'А' || surname ELSE surname END AS surname, CASE WHEN pos % 3 = 0 THEN 'Нове' ELSE firstname END AS firstname FROM roster",
    "d10_delete_entries": f"{_W} SELECT roster_id, id FROM roster WHERE pos % 4 <> 1",
    "d11_attach_nicknames": f"{_W} SELECT roster_id, id, CASE WHEN len(nicknames) > 0 THEN nicknames[1] || ',n4' ELSE 'n2,n4' END AS nicknames FROM roster",
    "d12_convert_legacy": "SELECT CAST(c_nationkey AS VARCHAR) AS roster_id, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS surname, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' x' ELSE '' END AS firstname FROM customer",
    "d13_sort_roster": f"{_W}, o AS (SELECT roster_id, id, surname, pos, list_position({_list(tuple(sorted(SURNAMES, key=lambda x: [('абвгґдеєжзиіїйклмнопрстуфхцчшщьюя'.index(c)) for c in x.lower()])))}, surname) AS k FROM roster) SELECT roster_id, id, surname, row_number() OVER (PARTITION BY roster_id ORDER BY k DESC, pos) AS rank FROM o",
    "m1_manual": f"{_CHAT}, o AS (SELECT surname || ' ' || firstname AS name, CAST(max(custkey) AS VARCHAR) AS id FROM roster GROUP BY 1) SELECT p.chat_id, p.name, o.id AS manual_id FROM people p JOIN o USING (name) JOIN roster r ON r.roster_id = p.roster_id AND r.id = o.id",
    "r2_exact_report": f"{_CHAT}, j AS (SELECT p.*, idx.id, real.real_name FROM people p LEFT JOIN idx ON idx.roster_id = p.roster_id AND idx.full_name = p.name LEFT JOIN real ON real.chat_id = p.chat_id AND real.name = p.name), i AS (SELECT chat_id, coalesce(id, '?') AS id, CASE WHEN id IS NOT NULL THEN name ELSE real_name END AS n, name AS nickname, id IS NOT NULL AS found, CASE WHEN id IS NOT NULL THEN 'exact-match' WHEN real_name IS NOT NULL THEN 'real-name-tag' ELSE 'not-found' END AS match_type FROM j) SELECT chat_id, id, coalesce(split_part(n, ' ', 1), '') AS surname, coalesce(substring(n, length(split_part(n, ' ', 1)) + 2), '') AS firstname, nickname, found, match_type FROM i",
    "s15_attendance_rows": f"{_CHAT}, j AS (SELECT p.*, idx.id, real.real_name FROM people p LEFT JOIN idx ON idx.roster_id = p.roster_id AND idx.full_name = p.name LEFT JOIN real ON real.chat_id = p.chat_id AND real.name = p.name), i AS (SELECT chat_id, id, CASE WHEN id IS NOT NULL THEN name ELSE real_name END AS n, name AS nickname FROM j) SELECT chat_id, coalesce(id, '?') AS id, coalesce(split_part(n, ' ', 1), '-') AS surname, coalesce(substring(n, length(split_part(n, ' ', 1)) + 2), '-') AS firstname, nickname, CASE WHEN id IS NOT NULL THEN 'В базі' ELSE 'Не знайдено в базі' END AS status FROM i",
    "s16_attendance_csv": f"""{_CHAT}, j AS (SELECT p.*, idx.id, real.real_name FROM people p LEFT JOIN idx ON idx.roster_id = p.roster_id AND idx.full_name = p.name LEFT JOIN real ON real.chat_id = p.chat_id AND real.name = p.name), i AS (SELECT chat_id, id, CASE WHEN id IS NOT NULL THEN name ELSE real_name END AS n, name AS nickname FROM j), v AS (SELECT chat_id, coalesce(id, '?') AS id, coalesce(split_part(n, ' ', 1), '-') AS surname, coalesce(substring(n, length(split_part(n, ' ', 1)) + 2), '-') AS firstname, nickname, CASE WHEN id IS NOT NULL THEN 'В базі' ELSE 'Не знайдено в базі' END AS status FROM i) SELECT chat_id, '"' || id || '","' || surname || '","' || firstname || '","' || nickname || '","' || status || '"' AS line FROM v UNION ALL SELECT DISTINCT chat_id, '"ID","Прізвище","Ім''я","Zoom nickname","Статус"' FROM v""",
}

_RCHAT = _CHAT.replace("WITH ", "WITH RECURSIVE ", 1)
_ASKED = "asked AS (SELECT DISTINCT p.roster_id, p.name, real.real_name FROM people p LEFT JOIN real USING (chat_id, name))"
_RULES = f"{_RCHAT}, {_ASKED}, {M._VT}, looked AS (SELECT *, coalesce(real_name, name) AS lookup FROM asked), {M.rules('looked')}"
_RULE_ROWS = " SELECT roster_id, name, id, kind AS match_type, quality, back AS reversed FROM found JOIN looked USING (roster_id, lookup)"
_ONE = f"""WITH RECURSIVE {_ROSTER.replace("roster AS (", "large AS (", 1)}, roster AS (
  SELECT roster_id, pos, id, surname, firstname FROM large UNION ALL
  SELECT 's' || s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1, CAST(s_suppkey AS VARCHAR), {_at(SURNAMES, _S.replace("c_custkey", "s_suppkey"))}, {_at(FIRSTNAMES, _F.replace("c_custkey", "s_suppkey"))} FROM supplier
), {_INDEX}, asked AS (
  SELECT DISTINCT roster_id, CASE WHEN roster_id LIKE 's%' THEN left(surname, 3) || 'щ' || substring(surname, 5)
                                  ELSE CASE pos % 5 WHEN 0 THEN firstname WHEN 1 THEN surname WHEN 2 THEN lower({M.latin("(firstname || surname)")}) WHEN 3 THEN surname || lower(firstname) ELSE lower(surname || ' ' || firstname) END END AS name FROM roster)"""
#: Meetings with one-word, glued and nicknames, tags, other languages and private messages: people are the senders as they are shown.
_MEET = f"""WITH RECURSIVE {_ROSTER}, {_SPEAKERS}, {_INDEX}, mixed AS (
  SELECT CAST(conv_id AS VARCHAR) AS chat_id, conv_id, turn, CAST(c_nationkey AS VARCHAR) AS roster_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq,
         CASE (conv_id * 3 + turn) % 14 WHEN 0 THEN fir WHEN 1 THEN sur WHEN 2 THEN lower(lfir || lsur) WHEN 3 THEN 'user' || c_custkey WHEN 4 THEN 'Guest ' || turn WHEN 5 THEN left(sur, -1) || 'а ' || fir WHEN 6 THEN sfir
              WHEN 8 THEN fir || ' ' || sur WHEN 9 THEN sur || ' ' || sfir WHEN 10 THEN '{ALONE}' WHEN 11 THEN lower('{ALONE}') WHEN 12 THEN lower(sur || ' ' || fir) WHEN 13 THEN left(fir, -1) || ' ' || sur ELSE sur || ' ' || fir END AS name,
         CASE WHEN (conv_id * 3 + turn) % 14 = 4 THEN 'rnm: ' || sur || ' ' || fir WHEN (conv_id * 3 + turn) % 14 BETWEEN 10 AND 12 THEN 'rnm: {STRANGER}' ELSE 'plus ' || turn END AS body,
         CASE WHEN (conv_id * 3 + turn) % 14 = 4 THEN sur || ' ' || fir ELSE '{STRANGER}' END AS tagged
  FROM placed
), people AS (
  SELECT chat_id, roster_id, name, min(seq) AS first_seq, string_agg(body, '|' ORDER BY seq) AS messages FROM mixed GROUP BY ALL
), real AS (
  SELECT chat_id, name, arg_max(tagged, seq) AS real_name FROM mixed WHERE body LIKE 'rnm:%' GROUP BY ALL
), {_ASKED}"""
_MATCHED = f"""{_MEET}, {M.RESOLVED}, matched AS (
  SELECT p.chat_id, p.roster_id, p.name, p.first_seq, r.real_name, r.id, r.match_type, r.quality, r.reversed, r.db_name, r.candidates
  FROM people p LEFT JOIN real USING (chat_id, name) JOIN resolved r ON r.roster_id = p.roster_id AND r.name = p.name AND r.real_name IS NOT DISTINCT FROM real.real_name)"""
_AUTO = f"""{_MATCHED}, open_names AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY first_seq, name) AS i FROM matched WHERE id IS NULL
), by_first AS (
  SELECT a.roster_id, a.name, list(f.id ORDER BY f.pos) AS firsts, list(f.full_name ORDER BY f.pos) AS first_names FROM (SELECT DISTINCT roster_id, name FROM asked WHERE NOT contains(name, ' ')) a JOIN folk f ON f.roster_id = a.roster_id AND split_part(f.db_lower, ' ', 2) = lower(a.name) GROUP BY ALL
), by_split AS (
  SELECT roster_id, name, list({{'id': id, 'q': q, 'full_name': full_name}} ORDER BY -q, id) AS glue FROM splits WHERE NOT contains(name, ' ') GROUP BY ALL
), by_possible AS (
  SELECT roster_id, name, list({{'id': id, 'quality': quality, 'full_name': full_name}} ORDER BY -quality, id) AS maybe FROM possible GROUP BY ALL
), ready AS (
  SELECT o.chat_id, o.i, o.name, o.match_type, coalesce(firsts, []) AS firsts, first_names, coalesce(glue, []) AS glue, coalesce(maybe, []) AS maybe
  FROM open_names o LEFT JOIN by_first USING (roster_id, name) LEFT JOIN by_split USING (roster_id, name) LEFT JOIN by_possible USING (roster_id, name)
), steps AS (
  SELECT chat_id, CAST(0 AS BIGINT) AS i, coalesce(list(DISTINCT id) FILTER (id IS NOT NULL), []) AS used, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS new_id, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS INTEGER) AS new_quality, CAST(NULL AS VARCHAR) AS new_name, CAST(NULL AS VARCHAR) AS new_candidates
  FROM matched GROUP BY chat_id
  UNION ALL
  SELECT chat_id, i, CASE WHEN new_id IS NULL THEN used ELSE list_append(used, new_id) END, name, new_id, kind, new_quality, new_name, new_candidates FROM (
    SELECT *, CASE kind WHEN 'auto-match-single-name' THEN ff[1] WHEN 'split-name-match' THEN glue[1].id WHEN 'auto-match' THEN mm[1].id END AS new_id,
           CASE kind WHEN 'auto-match-single-name' THEN 95 WHEN 'split-name-match' THEN CAST(floor(glue[1].q * 100 + 0.5) AS INTEGER) WHEN 'auto-match' THEN mm[1].quality END AS new_quality,
           CASE kind WHEN 'auto-match-single-name' THEN first_names[list_position(firsts, ff[1])] WHEN 'split-name-match' THEN glue[1].full_name WHEN 'auto-match' THEN mm[1].full_name END AS new_name,
           CASE kind WHEN 'split-name-match' THEN array_to_string(list_transform(glue, lambda x: x.id || ':' || CAST(floor(x.q * 100 + 0.5) AS INTEGER)), ',') WHEN 'auto-match' THEN array_to_string(list_transform(mm, lambda x: x.id || ':' || x.quality), ',') END AS new_candidates
    FROM (SELECT *, CASE WHEN len(ff) = 1 THEN 'auto-match-single-name' WHEN len(glue) > 0 AND glue[1].q > 0.85 AND NOT list_contains(used, glue[1].id) THEN 'split-name-match'
                         WHEN match_type NOT IN ('multiple-matches', 'ambiguous-name') AND len(mm) = 1 AND mm[1].quality >= 90 THEN 'auto-match' END AS kind
          FROM (SELECT r.chat_id, r.i, s.used, r.name, r.match_type, r.firsts, r.first_names, r.glue, list_filter(r.firsts, lambda x: NOT list_contains(s.used, x)) AS ff, list_filter(r.maybe, lambda x: NOT list_contains(s.used, x.id)) AS mm FROM steps s JOIN ready r ON r.chat_id = s.chat_id AND r.i = s.i + 1)))
), assigned AS (
  SELECT m.chat_id, m.roster_id, m.name, m.first_seq, m.real_name, coalesce(new_id, id) AS id, coalesce(kind, match_type) AS match_type, coalesce(new_quality, quality) AS quality, reversed, CASE WHEN new_id IS NULL THEN db_name ELSE new_name END AS db_name,
         CASE WHEN new_id IS NULL THEN candidates ELSE new_candidates END AS candidates, new_id IS NOT NULL AS auto_matched
  FROM matched m LEFT JOIN (SELECT * FROM steps WHERE new_id IS NOT NULL) s USING (chat_id, name))"""
_INFO = f"""{_AUTO}, info AS (
  SELECT a.*, a.id IS NOT NULL AS found, CASE WHEN a.id IS NOT NULL THEN coalesce(db_name, nick_name) ELSE real_name END AS n FROM assigned a LEFT JOIN named ON named.roster_id = a.roster_id AND named.nick_id = a.id
), lines AS (
  SELECT chat_id, first_seq, coalesce(id, '?') AS id, coalesce(split_part(n, ' ', 1), '') AS surname, coalesce(substring(n, length(split_part(n, ' ', 1)) + 2), '') AS firstname, name AS nickname, found, auto_matched,
         CASE WHEN found AND real_name IS NOT NULL AND match_type <> 'real-name-tag' THEN match_type || ' real-name-tag' WHEN found THEN match_type WHEN real_name IS NOT NULL THEN 'real-name-tag' ELSE 'not-found' END AS match_type,
         CASE WHEN id IS NOT NULL THEN id ELSE '?_' || name END AS person
  FROM info
)"""
_ORDER = "found DESC, try_cast(id AS BIGINT) IS NULL, try_cast(id AS BIGINT), id, nickname COLLATE uk, first_seq"
_FIRST_WORD = "split_part(shown, ' ', 1)"

SQL |= {
    "p1_transcripts": f"{_MEET} SELECT chat_id, roster_id, seq, '09:' || lpad(CAST(turn AS VARCHAR), 2, '0') || ':' || lpad(CAST(conv_id % 60 AS VARCHAR), 2, '0') AS time, name AS sender, body FROM mixed",
    "p6_transcript_people": f"{_MEET} SELECT p.chat_id, p.roster_id, p.name, p.first_seq, p.messages, real.real_name FROM people p LEFT JOIN real USING (chat_id, name)",
    "p5_split_display_name": f"{_WS} SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN CASE WHEN shown LIKE '%(%' THEN regexp_extract(shown || ' [', '^(.*) \\[$', 1) ELSE shown END WHEN turn % 3 = 1 AND shown LIKE '%(%' THEN regexp_extract(shown, '\\((.*)$', 1) || ' (ІТ' WHEN shown LIKE '%(%' THEN regexp_extract(shown, '\\((.*)\\)$', 1) ELSE shown END AS name, CASE WHEN turn % 3 = 0 THEN 'гр. 2' WHEN turn % 3 = 1 AND shown NOT LIKE '%(%' THEN 'ІТ' WHEN shown LIKE '%(%' THEN {_FIRST_WORD} ELSE '' END AS extra FROM speakers",
    "n8_latin_variants": f"{_W} SELECT roster_id, id, array_to_string({M.spellings('firstname')}, ',') AS variants FROM roster",
    "n9_translit_match": f"{_PAIRS}, t AS (SELECT roster_id, id, {_latin('upper(left(a0, 1)) || substring(a0, 2)')} AS l, b, a, {M.spellings('b')} AS spelt FROM (SELECT p.*, r.surname AS a0 FROM pairs p JOIN roster r USING (roster_id, id))) SELECT roster_id, id, CASE WHEN lower(l) = lower(b) THEN true WHEN regexp_matches(l, '{M.CYRILLIC}') THEN ({_similarity('l', 'b')}) >= 0.75 ELSE list_max(list_transform(spelt, lambda v: {_similarity('v', 'l')})) >= 0.75 END AS across, ({_similarity('a', 'b')}) >= 0.75 AS within FROM t",
    "n11_is_variant": f"{_WS}, {M._VT}, w AS (SELECT conv_id, turn, {_FIRST_WORD} AS x FROM speakers), {M.possible('w', 'f', 'x')}, g AS (SELECT x, string_agg(v, ',' ORDER BY v) AS forms FROM f GROUP BY 1) SELECT conv_id, turn, {M.is_variant('w.x', chr(39) + 'олександр' + chr(39))} AS is_variant, coalesce(g.forms, '') AS forms FROM w LEFT JOIN g ON g.x = lower(w.x)",
    "m6_rules": _RULES + _RULE_ROWS,
    "m17_rules_by_keys": _RULES + _RULE_ROWS,
    "m14_one_word_rules": f"{_MEET}, {M._VT}, looked AS (SELECT *, coalesce(real_name, name) AS lookup FROM asked), {M.rules('looked')}{_RULE_ROWS}",
    "m18_pick_best": f"{_RULES} SELECT roster_id, name, CASE WHEN NOT open THEN id1 END AS id, CASE WHEN open THEN 'multiple-matches' ELSE kind1 END AS match_type, CASE WHEN open THEN 0 ELSE q1 END AS quality, candidates FROM picked JOIN looked USING (roster_id, lookup)",
    "m21_split_glued": f"{_ONE}, {M.SPLITS} SELECT roster_id, name, id, q, combined FROM splits",
    "m19_possible_matches": f"{_ONE}, {M.SPLITS}, {M.POSSIBLE} SELECT roster_id, name, rank, id, quality, part FROM possible",
    "m20_ambiguous": f"{_ONE}, {M.SPLITS}, {M.POSSIBLE}, {M.AMBIGUOUS} SELECT roster_id, name, candidates FROM ambiguous",
    "m23_matches": f"{_MATCHED} SELECT chat_id, name, id, match_type, quality, reversed, coalesce(candidates, '') AS candidates FROM matched",
    "m3_exact": f"{_MATCHED} SELECT chat_id, name, id, quality FROM matched WHERE match_type = 'exact-match'",
    "m4_tag": f"{_MATCHED} SELECT chat_id, name, real_name, id, quality FROM matched WHERE match_type = 'real-name-tag'",
    "m5_nickname": f"{_MATCHED} SELECT chat_id, name, id, db_name, quality FROM matched WHERE match_type = 'nickname-match'",
    "m22_attendance_matches": f"{_AUTO} SELECT chat_id, name, id, match_type, quality, reversed, auto_matched, coalesce(candidates, '') AS candidates FROM assigned",
    "m26_select_alternative": f"{_AUTO} SELECT chat_id, name, CASE WHEN c THEN split_part(split_part(candidates, ',', 1), ':', 1) ELSE id END AS id, c AS chosen, CASE WHEN c THEN CAST(split_part(split_part(candidates, ',', 1), ':', 2) AS INTEGER) ELSE quality END AS quality FROM (SELECT *, id IS NULL AND coalesce(candidates, '') <> '' AS c FROM assigned)",
    "r1_report": f"{_INFO} SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY {_ORDER}) AS place, id, surname, firstname, nickname, found, match_type, contains(match_type, 'translit') AS is_translit, contains(match_type, 'reversed') AS is_reversed, contains(match_type, 'variant') AS is_variant, auto_matched OR contains(match_type, 'auto-match') AS is_auto, contains(match_type, 'real-name-tag') AS is_tag, contains(match_type, 'nickname') AS is_nickname, contains(match_type, 'split-name') AS is_split FROM (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY chat_id, person ORDER BY {_ORDER}) = 1)",
    "r4_counts": f"{_INFO} SELECT chat_id, count(*) AS parsed, count(*) FILTER (NOT found) AS unrecognised, count(DISTINCT person) AS unique_people FROM lines GROUP BY 1",
}

_FORMS = lambda x: (x, _latin(x), _cyrillic(x))
_NEAREST = "greatest(" + ", ".join(_similarity(a, b) for a in ("n0", "n1", "n2") for b in ("f0", "f1", "f2")) + ")"


def _best(asked: str, used: str, name: str) -> str:
    """M25 of a table (chat_id, roster_id, name): (chat_id, name, rank, id, full_name, s); glued names have their splits if there are any."""
    n, f = _FORMS("name"), _FORMS("full_name")
    return f"""{name}_n AS (
  SELECT DISTINCT roster_id, name, {n[0]} AS n0, {n[1]} AS n1, {n[2]} AS n2, regexp_matches(name, '{M.ONE_WORD}') AND length(name) >= 6 AS glues FROM {asked}
), {name}_f AS (
  SELECT *, {f[0]} AS f0, {f[1]} AS f1, {f[2]} AS f2 FROM idx
), {name}_s AS (
  SELECT n.roster_id, n.name, s.id, s.full_name, s.pos, s.q AS s FROM {name}_n n JOIN splits s USING (roster_id, name) WHERE glues AND s.q >= 0.7
), {name}_p AS (
  SELECT * FROM {name}_s UNION ALL
  SELECT roster_id, name, id, full_name, pos, {_NEAREST} AS s FROM (SELECT * FROM {name}_n ANTI JOIN {name}_s USING (roster_id, name)) JOIN {name}_f USING (roster_id) WHERE {_NEAREST} > 0.3
), {name} AS (
  SELECT a.chat_id, a.name, p.id, p.full_name, p.s, row_number() OVER (PARTITION BY a.chat_id, a.name ORDER BY p.s DESC, p.pos) AS rank
  FROM {asked} a JOIN {name}_p p USING (roster_id, name) WHERE NOT EXISTS (SELECT 1 FROM {used} u WHERE u.chat_id = a.chat_id AND u.id = p.id) QUALIFY rank <= 3
)"""


_REVIEW = f"""{_INFO}, unmatched AS (
  SELECT * FROM assigned WHERE id IS NULL
), choices AS (
  SELECT chat_id, name, unnest(range(len(c))) AS o, split_part(unnest(c), ':', 1) AS id, CAST(split_part(unnest(c), ':', 2) AS INTEGER) AS quality FROM (SELECT chat_id, name, string_split(candidates, ',') AS c FROM unmatched WHERE candidates <> '')
), undecided AS (
  SELECT chat_id, name FROM unmatched WHERE match_type IN ('ambiguous-name', 'multiple-matches', 'split-name-match') AND candidates IS NOT NULL
), rest_names AS (
  SELECT * FROM unmatched ANTI JOIN undecided USING (chat_id, name)
), second_words AS (
  SELECT *, split_part(db_lower, ' ', 2) AS second, count(*) OVER (PARTITION BY roster_id, split_part(db_lower, ' ', 2)) AS n FROM folk
), by_firstname AS (
  SELECT r.chat_id, r.name, w.pos AS o, w.id, CASE WHEN n = 1 THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS s FROM rest_names r JOIN second_words w ON w.roster_id = r.roster_id AND w.second = lower(r.name) WHERE NOT contains(r.name, ' ')
), last_names AS (
  SELECT chat_id, roster_id, name FROM rest_names ANTI JOIN by_firstname USING (chat_id, name)
), {_best("last_names", "(SELECT chat_id, id FROM assigned WHERE id IS NOT NULL)", "closest")}, recommended AS (
  SELECT chat_id, name, id, s, row_number() OVER (PARTITION BY chat_id, name ORDER BY o, id) AS rank FROM (
    SELECT chat_id, name, o, id, quality / 100.0::DOUBLE AS s FROM choices SEMI JOIN undecided USING (chat_id, name) WHERE quality >= 50
    UNION ALL SELECT * FROM by_firstname UNION ALL SELECT chat_id, name, rank, id, s FROM closest WHERE s >= 0.6)
), reviewed AS (
  SELECT chat_id, name, id, quality, row_number() OVER (PARTITION BY chat_id, name ORDER BY quality DESC, step, o) AS rank FROM (
    SELECT * FROM (SELECT chat_id, name, 0 AS step, o, id, quality FROM choices UNION ALL SELECT chat_id, name, 1, rank, id, CAST(floor(s * 100 + 0.5) AS INTEGER) FROM recommended)
    QUALIFY row_number() OVER (PARTITION BY chat_id, name, id ORDER BY step, o) = 1)
)"""
_FEWER = _AUTO.replace("roster AS (", "roster_before AS (", 1).replace(f"{_SPEAKERS}", f"roster AS (SELECT * FROM roster_before WHERE NOT (CAST(roster_id AS INTEGER) % 5 = 0 AND pos % 2 = 0)), {_SPEAKERS}", 1)
_CHANGED = _AUTO.replace("roster AS (", "roster_before AS (", 1).replace(
    f"{_SPEAKERS}",
    f"roster AS (SELECT * REPLACE (CASE WHEN pos = 7 THEN 'Зоряна' ELSE firstname END AS firstname, CASE WHEN pos = 9 THEN id || 'x' ELSE id END AS id) FROM roster_before WHERE pos <> 4), {_SPEAKERS}",
    1,
)

SQL |= {
    "m24_recommend": f"{_REVIEW} SELECT chat_id, name, rank, id, s AS similarity FROM recommended",
    "m27_review": f"{_REVIEW} SELECT chat_id, name, rank, id, quality FROM reviewed",
    "r6_alternatives": f"{_REVIEW} SELECT l.chat_id, l.nickname, l.found, NOT l.found AND EXISTS (SELECT 1 FROM reviewed r WHERE r.chat_id = l.chat_id AND r.name = l.nickname) AS has_alternatives FROM lines l",
    "m28_rematch": f"{_FEWER} SELECT chat_id, name, id, match_type FROM assigned",
    "m28_rematch_changes": f"{_CHANGED} SELECT chat_id, name, id, match_type, quality FROM assigned",
    "m25_best_matches": f"WITH {_ROSTER}, {_SPEAKERS}, {_INDEX}, cut_names AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS chat_id, roster_id, substring(shown, 2, length(shown) - 2) AS name FROM speakers), splits AS (SELECT roster_id, '' AS name, id, full_name, pos, 0.0::DOUBLE AS q FROM idx WHERE false), {_best('cut_names', '(SELECT DISTINCT CAST(s.conv_id AS VARCHAR) AS chat_id, i.id FROM speakers s JOIN idx i ON i.roster_id = s.roster_id AND i.full_name = s.shown)', 'closest')} SELECT chat_id, name, rank, id, s AS similarity FROM closest",
    "s11_roster_list": f"{_W}, l AS (SELECT roster_id, pos, pos % 3 <> 0 AS given, CASE WHEN pos % 3 = 0 THEN pos + 1 ELSE pos + 2 END AS claim, surname || ' ' || firstname || CASE WHEN pos % 3 = 0 THEN ' №' ELSE ' x' END || id AS full_name FROM roster), o AS (SELECT *, row_number() OVER (PARTITION BY roster_id, claim ORDER BY pos) = 1 AS first FROM l) SELECT roster_id, pos, full_name, CAST(claim AS VARCHAR) || CASE WHEN first THEN '' ELSE '_1' END AS id FROM o WHERE first OR NOT given",
    "s17_attendance_json": f"{_CHAT}, j AS (SELECT p.*, idx.id AS found_id, real.real_name, CASE WHEN p.name LIKE '%(%' THEN 1 ELSE 0 END AS ord FROM people p LEFT JOIN idx ON idx.roster_id = p.roster_id AND idx.full_name = p.name LEFT JOIN real ON real.chat_id = p.chat_id AND real.name = p.name), i AS (SELECT chat_id, first_seq, ord, coalesce(found_id, '?') AS id, CASE WHEN found_id IS NOT NULL THEN name ELSE real_name END AS n, name, found_id IS NOT NULL AS found, CASE WHEN found_id IS NOT NULL THEN 'exact-match' WHEN real_name IS NOT NULL THEN 'real-name-tag' ELSE 'not-found' END AS kind FROM j) SELECT chat_id, count(*) AS total, CAST(to_json({{'version': '3.0', 'date': '2024-01-01', 'totalParticipants': count(*), 'participants': list({{'id': id, 'surname': coalesce(split_part(n, ' ', 1), ''), 'firstname': coalesce(substring(n, length(split_part(n, ' ', 1)) + 2), ''), 'nickname': name, 'inDatabase': found, 'matchType': kind}} ORDER BY first_seq, ord)}}) AS VARCHAR) AS value FROM i GROUP BY 1",
}

_WORDS = lambda table: f"(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM {table})"
_CLOSE = "w = k OR 1 - CAST(levenshtein(w, k) AS DOUBLE) / greatest(length(w), length(k)) > 0.7"

SQL |= {
    "n13_forms_by_table": f"""WITH d AS (SELECT w AS k, left(w, 5) AS v FROM {_WORDS("benchmark")} WHERE length(w) >= 6), x AS (
  SELECT w, v AS direct FROM {_WORDS("conversations")} LEFT JOIN d ON k = w
), f AS (
  SELECT w, string_agg(DISTINCT v, ',' ORDER BY v) AS forms FROM x JOIN d ON starts_with(w, k) OR starts_with(k, w) OR {_CLOSE} WHERE direct IS NULL GROUP BY w
) SELECT w, coalesce(direct, w) AS form, CASE WHEN direct <> w THEN w || ',' || direct ELSE w END AS means, coalesce(direct, forms, '') AS forms FROM x LEFT JOIN f USING (w)""",
    "s1_read_chats": f"{_WS} SELECT CAST(conv_id AS VARCHAR) AS chat_id, 'r' AS roster_id, string_agg('09:' || lpad(CAST(turn AS VARCHAR), 2, '0') || ':' || lpad(CAST(conv_id % 60 AS VARCHAR), 2, '0') || ' From ' || shown || ' to Everyone: ' || text, chr(10) ORDER BY turn) || chr(10) AS text FROM speakers GROUP BY conv_id",
    "d3_lookup_id": f"{_W} SELECT roster_id, CASE WHEN pos % 3 = 0 THEN 'x' || id ELSE id END AS id, CASE WHEN pos % 3 > 0 THEN pos END AS pos, CASE WHEN pos % 3 > 0 THEN surname END AS surname, CASE WHEN pos % 3 > 0 THEN firstname END AS firstname FROM roster",
    "m1_matched_by_hand": f"""{_MATCHED}, o AS (SELECT surname || ' ' || firstname AS name, CAST(max(custkey) AS VARCHAR) AS given FROM roster GROUP BY 1
), hand AS (
  SELECT m.*, r.id AS hand_id FROM matched m LEFT JOIN o ON o.name = m.name LEFT JOIN roster r ON r.roster_id = m.roster_id AND r.id = o.given
) SELECT chat_id, name, coalesce(hand_id, id) AS id, CASE WHEN hand_id IS NULL THEN match_type ELSE 'manual-assignment' END AS match_type, CASE WHEN hand_id IS NULL THEN quality ELSE 100 END AS quality FROM hand""",
    "n15_order_similarity": f"""{_PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)}, words AS (SELECT DISTINCT lower(a) AS v, lower(b) AS p FROM pairs), lcs AS (
  SELECT v, p, 0 AS i, list_transform(range(0, length(p) + 1), lambda j: 0) AS r FROM words UNION ALL
  SELECT v, p, i + 1, [0] || list_transform(range(1, length(p) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda q: greatest(r[q + 1], r[q] + CASE WHEN substring(v, i + 1, 1) = substring(p, q, 1) THEN 1 ELSE 0 END)))) FROM lcs WHERE i < length(v)
), done AS (
  SELECT v, p, CAST(r[-1] AS BIGINT) AS n FROM lcs WHERE i = length(v)
) SELECT roster_id, id, n AS lcs, CASE WHEN v = p THEN 1.0::DOUBLE ELSE (CAST(n AS DOUBLE) / greatest(length(v), length(p))) * (CAST(least(length(v), length(p)) AS DOUBLE) / greatest(length(v), length(p))) END AS similarity FROM pairs JOIN done ON v = lower(a) AND p = lower(b)""",
}
# The same rows, read from other files.
SQL |= {"p1_transcript_lines": SQL["p1_transcripts"], "s16_attendance_files": SQL["s15_attendance_rows"]}
