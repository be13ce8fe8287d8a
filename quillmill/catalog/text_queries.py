"""Lines, words, headings, sentences and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.catalog import sqltext as Q
from quillmill.functions import text as T
from quillmill.operators import lines as L
from quillmill.operators import sentences as S
from quillmill.queries import register
from quillmill.session import table

KIND = Q.line_kind("t")
TRIMMED = Q.LINES + f", k AS (SELECT book_id, line_idx, line, {Q.trim('line')} AS t FROM l)"


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.texts(table(spark, sf_dir, "books"))


@register("word_count", f"WITH {Q.BOOKS} SELECT book_id, len({Q.words('text')}) AS words, CAST(floor(len({Q.words('text')}) / 150.0 + 0.5) AS BIGINT) AS minutes FROM b")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("book_id", T.count_words("text").cast("bigint").alias("words")).withColumn("minutes", F.floor(F.col("words") / 150 + 0.5))


@register("line_kinds", f"WITH {TRIMMED} SELECT book_id, {KIND} AS kind, count(*) AS lines FROM k GROUP BY ALL")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.line_table(table(spark, sf_dir, "books")).groupBy("book_id", "kind").agg(F.count("*").alias("lines"))


@register(
    "outline",
    f"""WITH {TRIMMED}, c AS (SELECT *, {KIND} AS kind, {Q.heading_key('line')} AS key FROM k WHERE t <> ''),
e AS (SELECT DISTINCT book_id, line_idx, level FROM outline_entries WHERE kind = 'heading' AND level BETWEEN 1 AND 3),
v AS (SELECT c.book_id, c.key, min(e.level) AS level FROM c JOIN e ON c.book_id = e.book_id AND c.line_idx = e.line_idx WHERE c.key <> '' GROUP BY ALL),
j AS (SELECT c.*, v.level, (c.kind = 'heading' OR (c.kind <> 'list' AND v.level IS NOT NULL)) AS head FROM c LEFT JOIN v ON c.book_id = v.book_id AND c.key = v.key),
m AS (SELECT *, CASE WHEN kind = 'list' THEN {Q.trim(f"regexp_extract(t, {Q.q(Q.LIST_MARKER)}, 1)")} END AS marker FROM j WHERE head OR kind = 'list')
SELECT book_id, CAST(line_idx AS INTEGER) AS line_idx, CASE WHEN head THEN 'heading' ELSE 'list' END AS kind, CASE WHEN head THEN coalesce(level, 2) END AS level, marker,
CASE WHEN marker IS NOT NULL THEN regexp_matches(marker, '(?i)[0-9a-z]') END AS ordered FROM m""",
)
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.outline(table(spark, sf_dir, "books"), table(spark, sf_dir, "outline_entries"))


@register("heading_keys", f"SELECT DISTINCT book_id, line_idx, {Q.heading_key('title')} AS heading_key FROM chapters WHERE title IS NOT NULL")
def heading_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters").where("title is not null").select("book_id", "line_idx", T.heading_key("title").alias("heading_key")).distinct()


FOLIO_SQL = T.FOLIO.replace(r"\z", "$")
NOT_THE_BOOK_SQL = T.NOT_THE_BOOK.replace(r"\z", "$")


@register(
    "line_tests",
    f"""WITH {TRIMMED}, u AS (SELECT DISTINCT line, t FROM k)
SELECT line, {Q.heading_like('t')} AS heading_like, (length(t) BETWEEN 3 AND 80 AND {Q.has('t', Q.HEADING_WORD)}) AS chapter_heading,
(length(t) BETWEEN 1 AND 80 AND {Q.has('t', '[A-Za-z0-9]')} AND NOT {Q.has('t', '[.!?,;:"”’]$')} AND NOT {Q.has('t', "^[\"“‘'(]")} AND NOT {Q.has('t', Q.LIST_MARKER)}) AS title_like,
(length(line) BETWEEN 1 AND 100 AND NOT ({Q.has('line', "^[\"“‘']")} OR {Q.has('line', '[.!]["”’]?$')} OR {Q.has('line', '[.!?]' + Q.WS + '+[A-Z]')} OR ({Q.has('line', '[0-9]')} AND contains(line, ','))
 OR {Q.has('line', f'^A{Q.WS}?B{Q.WS}?C{Q.WS}?D')})) AS real_heading,
{Q.has('t', NOT_THE_BOOK_SQL)} AS not_the_book, {Q.has('t', FOLIO_SQL)} AS folio, (len({Q.words('line')}) >= 12 OR {Q.has('t', '[.!?]["”’)]?$')}) AS prose FROM u""",
)
def line_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = L.line_table(table(spark, sf_dir, "books")).select("line").distinct()
    tests = {"heading_like": T.is_heading_like, "chapter_heading": T.is_chapter_heading, "title_like": T.title_like, "real_heading": T.is_real_heading, "not_the_book": T.is_not_the_book, "folio": T.is_folio, "prose": T.is_prose_line}
    return u.select("line", *(f("line").alias(n) for n, f in tests.items()))


@register("prose_share", f"""WITH {TRIMMED} SELECT book_id, count(*) AS lines, count(*) FILTER (len({Q.words('line')}) >= 12 OR {Q.has('t', '[.!?]["”’)]?$')}) AS prose_lines,
count(*) FILTER (len({Q.words('line')}) >= 12 OR {Q.has('t', '[.!?]["”’)]?$')}) >= 0.4 * count(*) AS is_prose FROM k WHERE t <> '' GROUP BY book_id""")  # fmt: skip
def prose_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.prose_share(table(spark, sf_dir, "books"))


HEADS = f"""WITH {TRIMMED}, y AS (SELECT book_id, t, {Q.heading_key('line')} AS key, line FROM k WHERE t <> ''),
h AS (SELECT book_id, key, count(*) AS repeats FROM y WHERE length(line) <= 80 AND key <> '' GROUP BY ALL HAVING count(*) >= 3)"""


@register("running_heads", HEADS + " SELECT * FROM h")
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.running_heads(table(spark, sf_dir, "books"))


@register("without_running_heads", HEADS + " SELECT book_id, count(*) AS kept FROM y WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.book_id = y.book_id AND h.key = y.key) GROUP BY book_id")
def without_running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.without_running_heads(table(spark, sf_dir, "books"))


@register(
    "drop_repeats",
    f"""WITH m AS (SELECT DISTINCT book_id, line_idx, title FROM chapters WHERE title IS NOT NULL),
r AS (SELECT *, {Q.heading_key('title')} AS key FROM m),
n AS (SELECT *, count(*) OVER (PARTITION BY book_id, key) AS n, row_number() OVER (PARTITION BY book_id, key ORDER BY line_idx) AS nth FROM r)
SELECT book_id, line_idx, title, key FROM n WHERE n < 3 AND nth = n""",
)
def drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.drop_repeats(table(spark, sf_dir, "chapters").where("title is not null").select("book_id", "line_idx", "title").distinct())


@register(
    "hard_wrapped",
    f"""WITH {TRIMMED}, n AS (SELECT book_id, list_sort(list(length(t))) AS v FROM k WHERE t <> '' GROUP BY book_id)
SELECT book_id, CAST(v[CAST(floor(len(v) / 2) AS BIGINT) + 1] AS INTEGER) AS median_length, (len(v) >= 20 AND v[CAST(floor(len(v) / 2) AS BIGINT) + 1] < 110) AS wrapped FROM n""",
)
def hard_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.hard_wrapped(table(spark, sf_dir, "books"))


@register(
    "reflow",
    f"""WITH {TRIMMED}, c AS (SELECT *, {KIND} AS kind, length(t) AS n FROM k),
w AS (SELECT book_id, greatest(50, list_sort(list(n))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] - 15) AS wrap_at FROM c WHERE n > 0 GROUP BY book_id),
f AS (SELECT c.*, CASE WHEN lag(kind) OVER o = 'paragraph' AND kind = 'paragraph' AND lag(n) OVER o >= wrap_at AND NOT ends_with(lag(t) OVER o, ':') THEN 0 ELSE 1 END AS new
  FROM c JOIN w USING (book_id) WINDOW o AS (PARTITION BY book_id ORDER BY line_idx)),
g AS (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY line_idx) AS block FROM f)
SELECT book_id, CAST(block AS BIGINT) AS block, string_agg(t, ' ' ORDER BY line_idx) AS text FROM g WHERE n > 0 GROUP BY ALL""",
)
def reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reflowed(table(spark, sf_dir, "books"))


@register(
    "blocks",
    f"""WITH {TRIMMED}, c AS (SELECT *, {KIND} AS kind, len({Q.words('line')}) AS words FROM k),
o AS (SELECT *, CASE WHEN kind = 'list' THEN regexp_matches({Q.trim(f"regexp_extract(t, {Q.q(Q.LIST_MARKER)}, 1)")}, '(?i)[0-9a-z]') END AS ordered FROM c),
f AS (SELECT *, CASE WHEN kind = 'list' AND lag(kind) OVER w = 'list' AND lag(ordered) OVER w = ordered THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY book_id ORDER BY line_idx)),
g AS (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY line_idx) AS block FROM f),
m AS (SELECT book_id, block, kind, ordered, min(line_idx) AS first_line, count(*) AS lines, sum(words) AS words FROM g WHERE kind <> 'blank' GROUP BY ALL)
SELECT book_id, CAST(block AS BIGINT) AS block, kind, ordered, CAST(first_line AS INTEGER) AS first_line, lines, CAST(words AS BIGINT) AS words,
CAST(coalesce(sum(words) OVER (PARTITION BY book_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS word_start FROM m""",
)
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.blocks(table(spark, sf_dir, "books"))


SENTENCES = f"WITH {Q.PARAGRAPHS}, {Q.sentence_rows('p', 'book_id, para_idx')}"


@register("split_sentences", SENTENCES + f" SELECT book_id, para_idx, sent_idx, sentence, CAST(len({Q.words('sentence')}) AS INTEGER) AS words FROM s")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_sentences(books(spark, sf_dir), "book_id", "text")


def _end_cleanly(x: str) -> str:
    t = Q.trim(x)
    return f"""CASE WHEN {t} = '' THEN '' WHEN {Q.has(t, "[.!?][\"'’”)\\]]?$")} THEN {t} ELSE regexp_replace({t}, '[,;:]+$', '') || '.' END"""


def chunk_sql(limit: int) -> str:
    """The greedy packing as a recursive query, one step per sentence."""
    return (
        "WITH RECURSIVE "
        + Q.PARAGRAPHS
        + ", "
        + Q.sentence_rows("p", "book_id, para_idx")
        + f""",
h AS (SELECT book_id, para_idx, sum(CASE WHEN para_idx > 0 AND length(t) BETWEEN 3 AND 80 AND {Q.has('t', Q.HEADING_WORD)} THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY para_idx) AS g FROM p),
o AS (SELECT s.book_id, CAST(h.g AS INTEGER) AS g, row_number() OVER (PARTITION BY s.book_id ORDER BY s.para_idx, s.sent_idx) AS n, CAST(len({Q.words('sentence')}) AS BIGINT) AS w,
  CASE WHEN {Q.has('sentence', '[.!?,;:]$')} THEN sentence ELSE sentence || '.' END AS x FROM s JOIN h ON s.book_id = h.book_id AND s.para_idx = h.para_idx),
r AS (SELECT book_id, n, g, 0 AS k, w AS acc FROM o WHERE n = 1
  UNION ALL SELECT o.book_id, o.n, o.g, CASE WHEN o.g <> r.g OR r.acc + o.w > {limit} THEN r.k + 1 ELSE r.k END, CASE WHEN o.g <> r.g OR r.acc + o.w > {limit} THEN o.w ELSE r.acc + o.w END
  FROM r JOIN o ON o.book_id = r.book_id AND o.n = r.n + 1),
c AS (SELECT r.book_id, r.k AS i, any_value(r.g) AS chapter_index, string_agg(o.x, ' ' ORDER BY r.n) AS x FROM r JOIN o ON o.book_id = r.book_id AND o.n = r.n GROUP BY r.book_id, r.k)
SELECT book_id, CAST(i AS INTEGER) AS i, {_end_cleanly('x')} AS text, chapter_index, coalesce(lead(chapter_index) OVER (PARTITION BY book_id ORDER BY i) > chapter_index, false) AS ends_chapter,
CAST(len({Q.words(_end_cleanly('x'))}) AS INTEGER) AS words FROM c"""
    )


@register("chunk_greedy", chunk_sql(300))
def chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunk_table(books(spark, sf_dir), "book_id", "text", 300)


@register("chunk_read", chunk_sql(60))
def chunk_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunk_table(books(spark, sf_dir), "book_id", "text", 60)


LEAD = f"""WITH c60 AS ({chunk_sql(60)}), f AS (SELECT * FROM c60 WHERE i = 0 AND words > 25),
s25 AS ({chunk_sql(25).replace(Q.BOOKS, "b AS (SELECT book_id, text FROM f)")}), m AS (SELECT book_id, max(i) AS more FROM s25 GROUP BY book_id)
SELECT s.book_id, s.i, s.text, f.chapter_index, f.ends_chapter AND s.i = m.more AS ends_chapter, s.words FROM s25 s JOIN f ON f.book_id = s.book_id JOIN m ON m.book_id = s.book_id UNION ALL
SELECT c.book_id, CASE WHEN c.i = 0 THEN 0 ELSE c.i + coalesce(m.more, 0) END, c.text, c.chapter_index, c.ends_chapter, c.words FROM c60 c LEFT JOIN m ON m.book_id = c.book_id WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.book_id = c.book_id AND c.i = 0)"""


@register("chunk_lead", LEAD)
def chunk_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunk_lead(books(spark, sf_dir), "book_id", "text", 60, 25)


CAPPED = f"""WITH RECURSIVE {Q.BOOKS}, t0 AS (SELECT book_id, md5(text) AS d, {Q.trim('text')} AS t FROM b), tt AS (SELECT * FROM t0 WHERE t <> ''), lo AS (SELECT * FROM tt WHERE length(t) > 400), {Q.sentence_rows('lo', 'book_id, d')},
cl AS (SELECT book_id, d, sent_idx, unnest(CASE WHEN length(sentence) <= 400 THEN [sentence] ELSE string_split(regexp_replace(sentence, {Q.q('([,;:])' + Q.WS + '+')}, '\\1' || chr(1), 'g'), chr(1)) END) AS c,
  unnest(range(CASE WHEN length(sentence) <= 400 THEN 1 ELSE len(string_split(regexp_replace(sentence, {Q.q('([,;:])' + Q.WS + '+')}, '\\1' || chr(1), 'g'), chr(1))) END)) AS m FROM s),
wd AS (SELECT book_id, d, sent_idx, m, unnest(CASE WHEN length(c) <= 400 THEN [c] ELSE {Q.words('c')} END) AS w, unnest(range(CASE WHEN length(c) <= 400 THEN 1 ELSE len({Q.words('c')}) END)) AS k FROM cl),
hc AS (SELECT book_id, d, sent_idx, m, k, w, unnest(range(greatest(1, CAST(ceil(length(w) / 400.0) AS BIGINT)))) AS h FROM wd),
o AS (SELECT book_id, d, substring(w, CAST(h * 400 + 1 AS BIGINT), 400) AS x, row_number() OVER (PARTITION BY book_id, d ORDER BY sent_idx, m, k, h) AS n FROM hc),
r AS (SELECT book_id, d, n, 0 AS k, length(x) AS acc FROM o WHERE n = 1 UNION ALL SELECT o.book_id, o.d, o.n, CASE WHEN r.acc + 1 + length(o.x) <= 400 THEN r.k ELSE r.k + 1 END, CASE WHEN r.acc + 1 + length(o.x) <= 400 THEN r.acc + 1 + length(o.x) ELSE length(o.x) END
 FROM r JOIN o ON o.book_id = r.book_id AND o.d = r.d AND o.n = r.n + 1)
SELECT r.book_id, CAST(k AS INTEGER) AS piece_no, string_agg(x, ' ' ORDER BY r.n) AS piece FROM r JOIN o ON o.book_id = r.book_id AND o.d = r.d AND o.n = r.n GROUP BY r.book_id, r.d, k UNION ALL SELECT book_id, 0, t FROM tt WHERE length(t) <= 400"""


@register("capped_pieces", CAPPED)
def capped_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.capped_pieces(books(spark, sf_dir), "book_id", "text", 400)


@register(
    "pack_chars",
    f"""WITH RECURSIVE d AS (SELECT DISTINCT job_key, i, pieces FROM chunks WHERE pieces IS NOT NULL), e AS (SELECT job_key, i, md5(to_json(pieces)) AS ps, unnest(pieces) AS x, unnest(range(len(pieces))) AS n FROM d),
o AS (SELECT job_key, i, ps, {Q.trim('x')} AS x, row_number() OVER (PARTITION BY job_key, i, ps ORDER BY n) AS n FROM e WHERE x IS NOT NULL AND {Q.trim('x')} <> ''),
r AS (SELECT job_key, i, ps, n, 0 AS k, length(x) AS acc, x AS packed FROM o WHERE n = 1
 UNION ALL SELECT o.job_key, o.i, o.ps, o.n, CASE WHEN r.acc + 1 + length(o.x) <= 500 THEN r.k ELSE r.k + 1 END, CASE WHEN r.acc + 1 + length(o.x) <= 500 THEN r.acc + 1 + length(o.x) ELSE length(o.x) END,
 CASE WHEN r.acc + 1 + length(o.x) <= 500 THEN r.packed || ' ' || o.x ELSE o.x END FROM r JOIN o ON o.job_key = r.job_key AND o.i = r.i AND o.ps = r.ps AND o.n = r.n + 1)
SELECT job_key, i, CAST(k AS INTEGER) AS pack, arg_max(packed, n) AS packed FROM r GROUP BY job_key, i, ps, k""",
)
def pack_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "chunks").where("pieces is not null").select("job_key", "i", "pieces").distinct()
    parts = F.filter(F.transform("pieces", T.trim), lambda x: x != "")
    return S.pack_parts(d.withColumn("parts", parts), ["job_key", "i"], "parts", 500)


@register("count_matches", f"WITH {Q.BOOKS} SELECT book_id, CAST((length(lower(text)) - length(replace(lower(text), 'the ', ''))) / 4 AS INTEGER) AS the_, CAST((length(lower(text)) - length(replace(lower(text), 'er', ''))) / 2 AS INTEGER) AS er, 0 AS one FROM b")
def count_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("book_id", ((F.length(F.lower("text")) - F.length(F.replace(F.lower("text"), F.lit("the "), F.lit("")))) / 4).cast("int").alias("the_"), T.count_matches("text", F.lit("er")).alias("er"), T.count_matches("text", F.lit("e")).alias("one"))


@register(
    "text_report",
    HEADS
    + f""", a AS (SELECT y.book_id, count(*) AS lines_before, sum(len({Q.words('line')})) AS words_before, count(*) FILTER (h.key IS NULL) AS lines_after, coalesce(sum(len({Q.words('line')})) FILTER (h.key IS NULL), 0) AS words_after
 FROM y LEFT JOIN h ON h.book_id = y.book_id AND h.key = y.key GROUP BY y.book_id)
SELECT a.book_id, lines_before, CAST(words_before AS BIGINT) AS words_before, lines_after, CAST(words_after AS BIGINT) AS words_after, CAST(greatest(0, words_before - words_after) AS BIGINT) AS removed,
array_to_string(list_slice({Q.words('text')}, 1, 120), ' ') AS opening FROM a JOIN b ON a.book_id = b.book_id""",
)
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and lines before and after running heads are removed, and the first 120 words."""
    src = table(spark, sf_dir, "books")
    rows = L.line_table(src).where(T.trim("line") != "").select("book_id", T.heading_key("line").alias("key"), T.count_words("line").alias("w"))
    heads = L.running_heads(src).select("book_id", "key", F.lit(True).alias("head"))
    kept = F.col("head").isNull()
    agg = rows.join(heads, ["book_id", "key"], "left").groupBy("book_id").agg(
        F.count("*").alias("lines_before"), F.sum("w").alias("words_before"), F.count_if(kept).alias("lines_after"), F.coalesce(F.sum(F.when(kept, F.col("w"))), F.lit(0)).alias("words_after")
    )
    opening = books(spark, sf_dir).select("book_id", T.head_words("text", 120).alias("opening"))
    return agg.join(opening, "book_id").withColumn("removed", F.greatest(F.lit(0), F.col("words_before") - F.col("words_after")))


@register("excerpts", f"""WITH {Q.BOOKS} SELECT book_id, substring(text, 1, 4000) AS opening, CASE WHEN length(text) > 6000 THEN regexp_replace(right(text, 2000), {Q.q('^' + Q.NWS + '*' + Q.WS + '+')}, '') END AS closing FROM b""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("book_id", T.excerpts("text").alias("e")).select("book_id", "e.opening", "e.closing")


@register("sample_text", f"WITH {Q.BOOKS} SELECT book_id, CASE WHEN length(text) <= 20000 THEN text ELSE substring(text, 1, 6666) || chr(10) || substring(text, CAST(floor(length(text) / 2 - 3333) AS INTEGER) + 1, 6666) || chr(10) || right(text, 6666) END AS sample FROM b")
def sample_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("book_id", T.sample_text("text").alias("sample"))


@register("first_words", f"WITH {Q.BOOKS} SELECT book_id, array_to_string(list_slice({Q.words('text')}, 1, 350), ' ') AS test_text FROM b")
def first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a test run of two minutes reads, at 175 words a minute."""
    return books(spark, sf_dir).select("book_id", T.head_words("text", 2 * 175).alias("test_text"))


NAME = Q.collapse("regexp_replace(regexp_replace(regexp_replace(regexp_replace(filename, '\\.[^.]+$', ''), '(?i)_[^_]*\\.(com|org|net)[^_]*_', ' ', 'g'), '\\[[^\\]]*\\]|\\([^)]*\\)', ' ', 'g'), '_', ' ', 'g')")
NAME_LIKE = "(len({w}) BETWEEN 2 AND 4 AND len(list_filter({w}, lambda x: regexp_matches(x, '^[A-Z][a-zA-Z''’.-]*$') AND NOT regexp_matches(x, '(?i)^(of|the|and|a|an|to|in|on|for|with)$'))) = len({w}))"


@register(
    "file_meta",
    f"""WITH f AS (SELECT DISTINCT filename FROM books WHERE filename IS NOT NULL), n AS (SELECT filename, {NAME} AS stem FROM f),
p AS (SELECT *, list_transform(regexp_split_to_array(stem, {Q.q(Q.WS + '+[-–—]' + Q.WS + '+')}), lambda x: {Q.trim('x')}) AS ps FROM n),
k AS (SELECT *, {NAME_LIKE.format(w=Q.words('ps[2]'))} AS second, {NAME_LIKE.format(w=Q.words('ps[1]'))} AS first, len(ps) = 2 AND ps[1] <> '' AND ps[2] <> '' AS two FROM p)
SELECT filename, CASE WHEN two AND second THEN ps[1] WHEN two AND first THEN ps[2] END AS title, CASE WHEN two AND second THEN ps[2] WHEN two AND first THEN ps[1] END AS author FROM k""",
)
def file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "books").select("filename").where("filename is not null").distinct()
    return f.withColumn("m", T.meta_from_filename("filename")).select("filename", "m.title", "m.author")


@register(
    "file_titles",
    f"""WITH f AS (SELECT DISTINCT filename FROM books WHERE filename IS NOT NULL),
n AS (SELECT filename, string_split({Q.collapse("regexp_replace(regexp_replace(filename, '\\.[^.]+$', ''), '[_-]+', ' ', 'g')")}, ' ') AS w FROM f)
SELECT filename, array_to_string(list_transform(w, lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '(?i)^(a|an|and|at|by|for|in|of|on|or|the|to|with)$') THEN lower(x) ELSE upper(x[1]) || x[2:] END), ' ') AS title,
coalesce(nullif(substring(regexp_replace({Q.trim("regexp_replace(regexp_replace(filename, '\\.[^.]+$', ''), '[^\\w\\s-]', '', 'g')")}, {Q.q(Q.WS + '+')}, '-', 'g'), 1, 80), ''), 'audiobook') AS download FROM n""",
)
def file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "books").select("filename").where("filename is not null").distinct()
    return f.select("filename", T.title_from_name("filename").alias("title"), T.download_name("filename").alias("download"))


@register("roman_values", f"""WITH {TRIMMED}, w AS (SELECT DISTINCT unnest({Q.words('line')}) AS word FROM l),
r AS (SELECT word FROM w WHERE regexp_matches(word, '(?i)^m{{0,3}}(cm|cd|d?c{{0,3}})(xc|xl|l?x{{0,3}})(ix|iv|v?i{{0,3}})$')),
c AS (SELECT word, unnest(string_split(lower(word), '')) AS ch, unnest(range(length(word))) AS i FROM r),
v AS (SELECT word, i, CASE ch WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 ELSE 1000 END AS v FROM c),
n AS (SELECT word, v, lead(v) OVER (PARTITION BY word ORDER BY i) AS nx FROM v)
SELECT word, CAST(sum(CASE WHEN nx > v THEN -v ELSE v END) AS INTEGER) AS value FROM n GROUP BY word""")  # fmt: skip
def roman_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = books(spark, sf_dir).select(F.explode(T.words("text")).alias("word")).distinct()
    return w.where(T.is_roman("word")).select("word", T.roman_value("word").alias("value"))


@register("numbers", f"""WITH {Q.BOOKS} SELECT DISTINCT book_id, regexp_replace(replace(unnest(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?')), ',', ''), '\\.$', '') AS number FROM b""")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("book_id", F.explode(T.numbers_in("text")).alias("number")).distinct()


@register("longest_line", f"WITH {Q.LINES} SELECT book_id, CAST(max(length(line)) AS INTEGER) AS longest, CAST(arg_min(line_idx, struct_pack(n := -length(line), i := line_idx)) AS INTEGER) AS at FROM l GROUP BY book_id")
def longest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.line_table(table(spark, sf_dir, "books"))
    return rows.groupBy("book_id").agg(F.max(F.length("line")).alias("longest"), F.min_by("line_idx", F.struct(-F.length("line"), "line_idx")).alias("at"))


@register("chapter_marks", """WITH c AS (SELECT DISTINCT book_id, idx, word_count FROM chapters WHERE word_count IS NOT NULL),
t AS (SELECT *, sum(word_count) OVER (PARTITION BY book_id) AS total, count(*) OVER (PARTITION BY book_id) AS n, sum(word_count) OVER (PARTITION BY book_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - word_count AS before FROM c)
SELECT book_id, idx, round(before / total, 6) AS start FROM t WHERE n >= 2 AND total > 0""")  # fmt: skip
def chapter_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each chapter starts as a share of the book's words; none for books of one chapter."""
    c = table(spark, sf_dir, "chapters").where("word_count is not null").select("book_id", "idx", "word_count").distinct()
    w = Window.partitionBy("book_id")
    t = c.withColumns({"total": F.sum("word_count").over(w), "n": F.count("*").over(w), "before": F.sum("word_count").over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)) - F.col("word_count")})
    return t.where("n >= 2 and total > 0").select("book_id", "idx", F.round(F.col("before") / F.col("total"), 6).alias("start"))
