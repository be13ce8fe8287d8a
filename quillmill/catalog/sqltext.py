"""Pieces of SQL that the queries' SQL twins share."""

WS = r"[\t\n\x0b\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NWS = "[^" + WS[1:]
BOOKS = "b AS (SELECT DISTINCT book_id, text FROM books WHERE text IS NOT NULL)"
LINES = BOOKS + ", l AS (SELECT book_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_idx FROM b)"
LIST_MARKER = r"^([•·●○▪◦‣*–—-][ \t]+|\(?\d{1,3}[.)][ \t]+|\(?[a-z][.)][ \t]+)"
HEADING_WORD = r"(?i)^(chapter|part|book|section|prologue|epilogue|introduction|foreword|preface|afterword|conclusion)\b"


def q(s: str) -> str:
    """A string as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def collapse(x: str) -> str:
    return trim(f"regexp_replace({x}, {q(WS + '+')}, ' ', 'g')")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(WS + '+')}), lambda w: w <> '')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def heading_key(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({trim(x)}), '[^a-z0-9 ]+', '', 'g'), {q(WS + '+')}, ' ', 'g')"


def heading_like(t: str) -> str:
    caps = f"({t} = upper({t}) AND len(regexp_split_to_array({t}, {q(WS + '+')})) <= 12)"
    return f"(length({t}) BETWEEN 3 AND 80 AND NOT {has(t, '[.,;:]$')} AND {has(t, '[A-Za-z]')} AND ({has(t, HEADING_WORD)} OR {caps}))"


def line_kind(t: str) -> str:
    """The kind of a trimmed line."""
    return f"CASE WHEN {t} = '' THEN 'blank' WHEN {has(t, LIST_MARKER)} THEN 'list' WHEN {heading_like(t)} THEN 'heading' ELSE 'paragraph' END"


ABBREVIATIONS = "mr mrs ms dr prof rev hon st sr jr vs etc eg ie cf al fig no vol ch pp inc ltd co corp dept est approx min max jan feb mar apr jun jul aug sep sept oct nov dec"


def sentence_rows(source: str, keys: str) -> str:
    """CTEs that end in ``s(keys, sent_idx, sentence)`` for the table ``source(keys, t)``."""
    pattern = rf"(?s:.*?[.!?]+[\"'’)\]]*{WS}+)|(?s:.+\z)"
    end_run = r"([.!?]+)[\"'’)\]]*$"
    abbreviations = ", ".join(q(a) for a in ABBREVIATIONS.split())
    return f"""
g0 AS (SELECT {keys}, regexp_extract_all(t, {q(pattern)}) AS gs FROM {source}),
g1 AS (SELECT {keys}, unnest(gs) AS g, unnest(range(len(gs))) AS i FROM g0),
g2 AS (SELECT *, lead(g) OVER (PARTITION BY {keys} ORDER BY i) AS nxt, regexp_replace(g, {q(WS + '+$')}, '') AS body FROM g1),
g3 AS (SELECT *, regexp_extract(body, {q(end_run)}, 1) AS mark, regexp_replace(body, {q(end_run)}, '') AS core FROM g2),
g4 AS (SELECT *, lower(regexp_replace(regexp_extract(core, {q(NWS + '*$')}), '[^A-Za-z]', '', 'g')) AS bare FROM g3),
g5 AS (SELECT *, CASE WHEN nxt IS NOT NULL AND mark <> '' AND NOT (mark = '.' AND (({has('core', '[0-9]$')} AND {has('nxt', '^[0-9]')}) OR bare IN ({abbreviations}) OR length(bare) = 1))
  AND {has('nxt', "^[\"'“‘(\\[A-Z0-9]")} THEN 1 ELSE 0 END AS ends FROM g4),
g6 AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM g5),
g7 AS (SELECT {keys}, sid, {trim("string_agg(g, '' ORDER BY i)")} AS sentence FROM g6 GROUP BY {keys}, sid),
s AS (SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY sid) - 1 AS INTEGER) AS sent_idx, sentence FROM g7 WHERE sentence <> '')"""


PARAGRAPHS = BOOKS + f""",
p0 AS (SELECT book_id, list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda x: {trim('x')}), lambda x: x <> '') AS ps FROM b),
p AS (SELECT book_id, unnest(ps) AS t, CAST(unnest(range(len(ps))) AS INTEGER) AS para_idx FROM p0)"""
