"""Narration, sections, budgets of sentences, level maps, cache prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.catalog import sqltext as Q
from quillmill.catalog.text_queries import TRIMMED, books
from quillmill.functions import narration as N
from quillmill.functions import text as T
from quillmill.operators import lines as L
from quillmill.plans import sections as X
from quillmill.plans import summary as P
from quillmill.queries import register
from quillmill.session import table

META = N.META_NOISE
BY = N.BY_LINE.replace(r"\z", "$")


@register(
    "book_meta",
    f"""WITH b AS (SELECT DISTINCT book_id, text, filename FROM books WHERE text IS NOT NULL), l AS (SELECT book_id, unnest(list_slice(string_split(text, chr(10)), 1, 80)) AS line, unnest(range(least(80, len(string_split(text, chr(10)))))) AS n FROM b),
k AS (SELECT book_id, n, {Q.trim('line')} AS t FROM l), o AS (SELECT *, {Q.has('t', BY)} AS isby FROM k WHERE t <> '' AND length(t) <= 80 AND NOT {Q.has('t', META)}),
g AS (SELECT book_id, arg_min(t, n) FILTER (NOT isby AND NOT {Q.has('t', '[.!?]$')} AND {Q.has('t', '[A-Za-z]')}) AS title, arg_min(trim(regexp_extract(t, {Q.q(BY)}, 2)), n) FILTER (isby) AS author FROM o GROUP BY book_id),
f AS (SELECT book_id, max(filename) AS f FROM b GROUP BY book_id)
SELECT f.book_id, coalesce(title, nullif({Q.collapse("regexp_replace(regexp_replace(f.f, '\\.[^.]+$', ''), '[_-]+', ' ', 'g')")}, ''), 'this book') AS title, coalesce(author, '') AS author FROM f LEFT JOIN g ON g.book_id = f.book_id""",
)
def book_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.book_meta(table(spark, sf_dir, "books"))


@register("narrated", """WITH j AS (SELECT DISTINCT job_key, title FROM jobs WHERE title IS NOT NULL),
t AS (SELECT *, 'Welcome to ' || title || '.' AS o FROM j),
m AS (SELECT *, CASE WHEN regexp_matches(o, '(?is)^welcome to\\s+(.+?),\\s*written by\\s+(.+?)\\s*[.!]\\s*$') THEN regexp_extract(o, '(?is)^welcome to\\s+(.+?),\\s*written by\\s+(.+?)\\s*[.!]\\s*$', 1)
 WHEN regexp_matches(o, '(?is)^welcome to\\s+(.+?)\\s+by\\s+(.+?)\\s*[.!]') THEN regexp_extract(o, '(?is)^welcome to\\s+(.+?)\\s+by\\s+(.+?)\\s*[.!]', 1) ELSE regexp_extract(o, '(?is)^welcome to\\s+(.+?)\\s*[.!]', 1) END AS said FROM t)
SELECT job_key, title, regexp_replace(trim(said), '(?i)^this summary of\\s+', '') AS said, 'Welcome to this summary of ' || title || '.' AS summary, 'That brings us to the end of ' || title || ' by A. B.' || '.' AS closing, 'One.' || chr(10) || chr(10) || 'Two.' AS body FROM m""")  # fmt: skip
def narrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings and closings written for every job's title, read back and removed again."""
    j = table(spark, sf_dir, "jobs").where("title is not null").select("job_key", "title").distinct()
    author = F.lit("A. B.")
    j = j.withColumn("text", F.concat_ws("\n\n", N.opening(F.col("title"), F.lit("")), F.lit("Let us begin."), F.lit("One."), F.lit("Two."), N.closing(F.col("title"), author)))
    return j.select("job_key", "title", N.meta_of_opening("text")["title"].alias("said"), N.opening(F.col("title"), F.lit(None).cast("string"), True).alias("summary"), N.closing(F.col("title"), author).alias("closing"), N.without_narration("text").alias("body"))


@register("sections")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text between its chapters' headings, made whole."""
    return P.sections_of(books(spark, sf_dir), table(spark, sf_dir, "chapters").where("title is not null").select("book_id", "line_idx"))


@register("marked_sections")
def marked_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by windows over lines, with headings as they stand."""
    return X.sections(table(spark, sf_dir, "books"), table(spark, sf_dir, "chapters").where("title is not null").select("book_id", "line_idx", "title"))


@register(
    "split_lines",
    f"""WITH {TRIMMED}, w AS (SELECT book_id, line_idx, len({Q.words('line')}) AS words FROM k WHERE t <> ''),
r AS (SELECT *, sum(words) OVER (PARTITION BY book_id) AS total, coalesce(sum(words) OVER (PARTITION BY book_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT book_id, CAST(line_idx AS INTEGER) AS line_idx, CAST(least(3, floor(before * 4 / greatest(total, 1))) AS INTEGER) AS piece FROM r""",
)
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.line_table(table(spark, sf_dir, "books")).where(T.trim("line") != "").select("book_id", "line_idx", T.count_words("line").alias("words"))
    return X.split_lines(rows, "book_id", "line_idx", "words", 4).select("book_id", "line_idx", "piece")


@register(
    "trim_to_budget",
    f"""WITH {Q.PARAGRAPHS}, {Q.sentence_rows('p', 'book_id, para_idx')}, w AS (SELECT *, len({Q.words('sentence')}) AS words FROM s),
r AS (SELECT *, sum(words) OVER o AS upto, row_number() OVER o AS nth FROM w WINDOW o AS (PARTITION BY book_id ORDER BY para_idx, sent_idx))
SELECT book_id, CAST(sum(words) AS BIGINT) AS words, count(DISTINCT para_idx) AS paragraphs FROM r WHERE upto <= 200 OR nth = 1 GROUP BY book_id""",
)
def trim_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.trim_to_budget(books(spark, sf_dir), "book_id", "text", 200)
    return out.select("book_id", "words", F.size(F.split("trimmed", "\n\n")).cast("bigint").alias("paragraphs"))


_J = f"""(NOT contains(r.acc, chr(10)) AND NOT contains(o.t, chr(10)) AND NOT {Q.has('r.acc', Q.LIST_MARKER)} AND NOT {Q.has('o.t', Q.LIST_MARKER)} AND NOT {Q.heading_like(Q.trim('r.acc'))} AND NOT {Q.has('r.acc', "[.!?:;\"')\\]]$")} AND {Q.has('o.t', "^[a-z(“‘\"']")})"""


@register("wrapped_blocks", f"""WITH RECURSIVE {Q.BOOKS}, p0 AS (SELECT book_id, md5(text) AS d, list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda x: {Q.trim('x')}), lambda x: x <> '') AS ps FROM b),
o AS (SELECT book_id, d, unnest(ps) AS t, unnest(range(1, len(ps) + 1)) AS n FROM p0),
r AS (SELECT book_id, d, n, 0 AS k, t AS acc FROM o WHERE n = 1 UNION ALL SELECT o.book_id, o.d, o.n, CASE WHEN {_J} THEN r.k ELSE r.k + 1 END,
 CASE WHEN {_J} THEN CASE WHEN regexp_matches(r.acc, '[a-z]-$') THEN left(r.acc, length(r.acc) - 1) || o.t ELSE r.acc || ' ' || o.t END ELSE o.t END FROM r JOIN o ON o.book_id = r.book_id AND o.d = r.d AND o.n = r.n + 1),
k AS (SELECT book_id, d, k, arg_max(acc, n) AS x FROM r GROUP BY book_id, d, k), j AS (SELECT book_id, d, string_agg(x, chr(10) || chr(10) ORDER BY k) AS text FROM k GROUP BY book_id, d)
SELECT p0.book_id, coalesce(j.text, '') AS text FROM p0 LEFT JOIN j ON j.book_id = p0.book_id AND j.d = p0.d""")  # fmt: skip
def wrapped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("book_id", X.merge_wrapped("text").alias("text"))


@register("outer_json", """SELECT event_id, props AS body, TRY_CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events WHERE props LIKE '{%}'""")
def outer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON found inside a wordy answer."""
    e = table(spark, sf_dir, "events").where(F.col("props").startswith("{") & F.col("props").endswith("}"))
    body = X.outer_json(F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" Enjoy!")))
    return e.select("event_id", body.alias("body"), F.get_json_object(body, "$.k").alias("k"))


@register("level_map", f"""WITH p AS (SELECT c.title AS line, o.level, row_number() OVER (PARTITION BY c.book_id ORDER BY c.line_idx, o.level NULLS LAST, c.title) - 1 AS ord, c.book_id FROM (SELECT DISTINCT book_id, line_idx, title FROM chapters WHERE title IS NOT NULL) c JOIN (SELECT DISTINCT book_id, line_idx, level FROM outline_entries WHERE kind = 'heading') o USING (book_id, line_idx)),
k AS (SELECT book_id, {Q.heading_key('line')} AS key, level, ord FROM p WHERE ord < 5000 AND level BETWEEN 1 AND 3) SELECT book_id, key, arg_max(level, ord) AS level FROM k WHERE key <> '' GROUP BY book_id, key""")  # fmt: skip
def level_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level that the measured headings of each book, 5,000 at most, give each key."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "chapters").where("title is not null").select("book_id", "line_idx", "title").distinct()
    o = table(spark, sf_dir, "outline_entries").where("kind = 'heading'").select("book_id", "line_idx", "level").distinct()
    w = Window.partitionBy("book_id").orderBy("line_idx", F.col("level").asc_nulls_last(), "title")
    p = c.join(o, ["book_id", "line_idx"]).select("book_id", F.col("title").alias("line"), "level", (F.row_number().over(w) - 1).alias("ord"))
    return X.level_map(p, "book_id")


@register("cached_prefix", """WITH d AS (SELECT DISTINCT job_key, i, pieces IS NOT NULL AND len(pieces) > 0 AS hit FROM chunks), m AS (SELECT job_key, min(i) FILTER (NOT hit) AS miss, count(*) AS n, count(*) FILTER (hit) AS hits FROM (SELECT job_key, i, bool_or(hit) AS hit FROM d GROUP BY ALL) GROUP BY job_key)
SELECT job_key, n AS units, hits AS cached, coalesce(miss, n) AS prefix FROM m""")  # fmt: skip
def cached_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each job, those that need no work, and how many from the start."""
    d = table(spark, sf_dir, "chunks").groupBy("job_key", "i").agg(F.bool_or(F.coalesce(F.size("pieces") > 0, F.lit(False))).alias("hit"))
    m = d.groupBy("job_key").agg(F.count("*").alias("units"), F.count_if("hit").alias("cached"), F.min(F.when(~F.col("hit"), F.col("i"))).alias("miss"))
    return m.select("job_key", "units", "cached", F.coalesce("miss", "units").alias("prefix"))


def levels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_map(spark, sf_dir)


@register("book_plans")
def book_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of five minutes for every book, as it is shown."""
    return P.public(P.plan_summaries(table(spark, sf_dir, "books"), levels_of(spark, sf_dir), 5))


@register("plan_items")
def plan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests that make up each plan."""
    plans = P.plan_summaries(table(spark, sf_dir, "books"), levels_of(spark, sf_dir), 5, chapters=False)
    return plans.select("book_id", F.explode("items").alias("i")).select("book_id", "i.*")


@register("plan_codes", f"""WITH {Q.BOOKS}, o AS (SELECT book_id, max(text) AS text FROM b GROUP BY book_id), c AS (SELECT book_id, len({Q.words('text')}) AS n FROM o)
SELECT book_id, CAST(n AS INTEGER) AS book_words, 825 AS target, CASE WHEN n < 200 THEN 'NO_TEXT' WHEN 825 > n * 0.6::DOUBLE THEN 'SUMMARY_TOO_LONG' END AS code FROM c""")  # fmt: skip
def plan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which books have a plan of five minutes without headings, and why the others have none."""
    return P.plan_summaries(table(spark, sf_dir, "books"), levels_of(spark, sf_dir), 5, chapters=False).select("book_id", "book_words", "target", "code")


@register("plan_budgets", f"""WITH {Q.BOOKS}, o AS (SELECT book_id, max(text) AS text FROM b GROUP BY book_id), c AS (SELECT book_id, len({Q.words('text')}) AS n FROM o) SELECT book_id, true AS within, true AS ordered FROM c WHERE n >= 200 AND 825 <= n * 0.6::DOUBLE""")
def plan_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every plan: budgets within the target, units in order and within their limits."""
    plans = P.plan_summaries(table(spark, sf_dir, "books"), levels_of(spark, sf_dir), 5, chapters=False).where("code is null")
    total = F.aggregate("items", F.lit(0), lambda a, i: a + i["budget"])
    units = F.transform("items", lambda i: i["unit"])
    return plans.select("book_id", (total + F.col("reserve") <= F.col("target")).alias("within"), (units == F.array_sort(units)).alias("ordered"))


@register("reassembled", f"WITH {Q.PARAGRAPHS} SELECT book_id, 0 AS section, string_agg(t, chr(10) || chr(10) ORDER BY para_idx) FILTER (para_idx % 3 <> 1) AS text, count(*) FILTER (para_idx % 3 = 1) AS missing FROM p GROUP BY book_id".replace(Q.BOOKS, "b AS (SELECT DISTINCT book_id || ':' || left(md5(text), 8) AS book_id, text FROM books WHERE text IS NOT NULL)"))
def reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of every text put together again; every third has no answer."""
    from quillmill.operators import sentences as S

    b = books(spark, sf_dir).select(F.concat_ws(":", "book_id", F.substring(F.md5("text"), 1, 8)).alias("book_id"), "text")
    p = b.select("book_id", F.posexplode(S.paragraphs("text")).alias("part", "text")).withColumn("section", F.lit(0))
    items = p.select("book_id", "section", "part", F.lit(None).cast("array<string>").alias("titles"))
    out = P.reassembled(items, p.where("part % 3 <> 1")).select("book_id", "section", "text", "missing")
    return out.withColumn("text", F.nullif("text", F.lit("")))
