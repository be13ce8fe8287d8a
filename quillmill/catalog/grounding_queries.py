"""Claims checked against their own passages: chunks against the chunk before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.catalog import sqltext as Q
from quillmill.catalog.analysis_queries import NUM, claims, norm, norm_wide, sources
from quillmill.operators import grounding as G
from quillmill.queries import register
from quillmill.session import table

CHUNK_TEXT = "ct AS (SELECT job_key, i, max(array_to_string(list_filter(pieces, lambda p: p IS NOT NULL), ' ')) AS text FROM chunks WHERE pieces IS NOT NULL GROUP BY ALL)"
# claims: odd chunks; passages: the chunk before; books: all even chunks of the job; allowed: the job's title
PASSAGES = CHUNK_TEXT + """, cl AS (SELECT job_key || ':' || i AS id, job_key AS book, i, text FROM ct WHERE i % 2 = 1), ps AS (SELECT cl.id, ct.text FROM cl JOIN ct ON ct.job_key = cl.book AND ct.i = cl.i - 1),
bk AS (SELECT job_key AS book, text FROM ct WHERE i % 2 = 0), jt AS (SELECT job_key AS book, max(title) AS text FROM jobs WHERE title IS NOT NULL GROUP BY job_key), al AS (SELECT cl.id, jt.text FROM cl JOIN jt USING (book))"""
NUMS = "unnest(regexp_extract_all({x}, '[0-9][0-9,]*(?:\\.[0-9]+)?'))"
COLLAPSED = f"cc AS (SELECT id, {Q.collapse('text')} AS t FROM cl WHERE {Q.trim('text')} <> '')"
RAW = f"cr AS (SELECT id, text AS t FROM cl WHERE {Q.trim('text')} <> '')"
ANYWAY = ", ".join(Q.q(w) for w in G.CAPITALISED_ANYWAY)


def names_sql(source: str) -> str:
    """CTEs that end in ``nm(id, name, sentence, parts)`` for ``source(id, t)``."""
    word = "regexp_replace(regexp_replace(w[k], '^[^A-Za-z]+|[^A-Za-z''’-]+$', '', 'g'), '[''’]s$', '')"
    return f"""{Q.sentence_rows(source, 'id')},
tk AS (SELECT id, sent_idx, sentence, regexp_split_to_array(sentence, {Q.q(Q.WS + '+')}) AS w FROM s),
tw AS (SELECT id, sent_idx, sentence, w, unnest(range(2, len(w) + 1)) AS k FROM tk),
nw AS (SELECT id, sent_idx, sentence, {word} AS name FROM tw WHERE NOT regexp_matches(w[k - 1], '[:;—–-]$|^[“"(]') AND NOT regexp_matches(w[k], '^[“"(]')),
n1 AS (SELECT id, name, arg_min(sentence, sent_idx) AS sentence FROM nw WHERE regexp_matches(name, '^[A-Z][a-zA-Z''’-]{{2,}}$') GROUP BY id, name),
n2 AS (SELECT *, list_filter(string_split({norm('name')}, ' '), lambda p: p <> '') AS parts FROM n1),
nm AS (SELECT * FROM n2 WHERE len(parts) > 0 AND len(list_filter(parts, lambda p: p NOT IN ({ANYWAY}))) > 0)"""


ISSUES = f"""{PASSAGES}, {COLLAPSED}, {names_sql('cc')},
un AS (SELECT nm.id, cl.book, nm.name, nm.sentence, unnest(nm.parts) AS word FROM nm JOIN cl ON cl.id = nm.id),
bw AS (SELECT DISTINCT book, unnest(string_split({norm('text')}, ' ')) AS word FROM bk), aw AS (SELECT DISTINCT id, unnest(string_split({norm('text')}, ' ')) AS word FROM al),
names AS (SELECT DISTINCT id, 'name' AS kind, name AS detail, sentence FROM un WHERE NOT EXISTS (SELECT 1 FROM bw WHERE bw.book = un.book AND bw.word = un.word) AND NOT EXISTS (SELECT 1 FROM aw WHERE aw.id = un.id AND aw.word = un.word)),
pn AS (SELECT DISTINCT id, {NUM.format(x=NUMS.format(x='text'))} AS number FROM (SELECT * FROM ps UNION ALL SELECT * FROM al)),
sn AS (SELECT DISTINCT id, {NUM.format(x=NUMS.format(x='text'))} AS number FROM cl),
numbers AS (SELECT id, number FROM sn WHERE length(regexp_replace(number, '[^0-9]', '', 'g')) >= 2 AND NOT EXISTS (SELECT 1 FROM pn WHERE pn.id = sn.id AND pn.number = sn.number)),
pq AS (SELECT id, ' ' || {norm('text')} || ' ' AS n FROM ps),
sq AS (SELECT id, text, unnest(regexp_extract_all(text, {Q.q(G.QUOTE)}, 0)) AS whole, unnest(regexp_extract_all(text, {Q.q(G.QUOTE)}, 1)) AS quote FROM cl),
quotes AS (SELECT DISTINCT sq.id, whole, quote FROM sq JOIN pq ON pq.id = sq.id WHERE len(string_split({norm('quote')}, ' ')) >= 3 AND NOT contains(pq.n, ' ' || {norm('quote')} || ' '))"""


@register("passage_names", f"WITH {ISSUES} SELECT * FROM names")
def passage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).where("kind = 'name'")


@register("passage_numbers", f"WITH {ISSUES} SELECT id, 'number' AS kind, number AS detail FROM numbers")
def passage_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).where("kind = 'number'").select("id", "kind", "detail")


@register("passage_quotes", f"WITH {ISSUES} SELECT DISTINCT id, 'quote' AS kind, {Q.trim('quote')} AS detail FROM quotes")
def passage_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).where("kind = 'quote'").select("id", "kind", "detail").distinct()


SENTENCES_OF = f"WITH {PASSAGES}, {RAW}, {Q.sentence_rows('cr', 'id')}"


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c = table(spark, sf_dir, "chunks").where("pieces is not null").groupBy("job_key", "i").agg(F.max(F.array_join("pieces", " ")).alias("text"))
    name = lambda i: F.concat_ws(":", "job_key", i)
    claims = c.where("i % 2 = 1").select(name("i").alias("id"), F.col("job_key").alias("book"), "text")
    ahead = c.where("i % 2 = 0").select(name(F.col("i") + 1).alias("id"), "text")
    passages = ahead.join(claims.select("id"), "id", "left_semi")
    books = c.where("i % 2 = 0").select(F.col("job_key").alias("book"), "text")
    titles = table(spark, sf_dir, "jobs").where("title is not null").groupBy(F.col("job_key").alias("book")).agg(F.max("title").alias("text"))
    return claims, passages, books, claims.select("id", "book").join(titles, "book").select("id", "text")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.passage_issues(*parts(spark, sf_dir))


@register("passage_issues")
def passage_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir)


@register("issue_sentences", SENTENCES_OF + f""", sn AS (SELECT DISTINCT id, {NUM.format(x=NUMS.format(x='t'))} AS number, t FROM cr), h AS (SELECT sn.id, number, arg_min(sentence, sent_idx) AS sentence FROM sn JOIN s ON s.id = sn.id AND contains(s.sentence, number) GROUP BY ALL)
SELECT sn.id, sn.number AS detail, coalesce(h.sentence, sn.number) AS sentence FROM sn LEFT JOIN h ON h.id = sn.id AND h.number = sn.number""")  # fmt: skip
def issue_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence around each number of a claim."""
    claims = parts(spark, sf_dir)[0]
    n = claims.select("id", F.explode(G.T.numbers_in("text")).alias("detail"))
    return G.with_sentence(n, claims, "detail").select("id", "detail", "sentence")


@register("kept_issues", f"WITH {ISSUES}, kp AS (SELECT id, left(t, CAST(floor(length(t) / 2) AS INTEGER)) AS t FROM cc) SELECT names.* FROM names JOIN kp ON kp.id = names.id WHERE contains(kp.t, names.sentence)")
def kept_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names still in question when only the first half of each claim is kept."""
    claims, passages, books, allowed = parts(spark, sf_dir)
    text = G.T.collapse("text")
    kept = claims.where(G.T.trim("text") != "").select("id", F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")).alias("text"))
    return G.still_there(G.passage_issues(claims, passages, books, allowed).where("kind = 'name'"), kept)


@register("better_drafts", f"WITH {PASSAGES}, d AS (SELECT cl.id, cl.text AS a, length(cl.text) % 5 AS na, ps.text AS b, length(ps.text) % 5 AS nb FROM cl LEFT JOIN ps ON ps.id = cl.id) SELECT id, CASE WHEN trim(coalesce(b, '')) <> '' AND nb <= na THEN b ELSE a END AS text, CASE WHEN trim(coalesce(b, '')) <> '' AND nb <= na THEN nb ELSE na END AS issues FROM d")
def better_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two drafts the later where it has no more issues."""
    claims, passages, _, _ = parts(spark, sf_dir)
    n = (F.length("text") % 5).cast("bigint").alias("issues")
    return G.better_of(claims.select("id", "text", n), passages.select("id", "text", n))


ITEMS = f"it AS (SELECT DISTINCT item_id AS id, {Q.collapse('text')} AS t FROM eval_items WHERE text IS NOT NULL)"
UNKNOWN = f"""{ITEMS}, {names_sql('it')}, un AS (SELECT id, name, unnest(parts) AS word FROM nm), vo AS (SELECT DISTINCT unnest(string_split({norm_wide('text')}, ' ')) AS word FROM documents WHERE text IS NOT NULL),
na AS (SELECT DISTINCT id, name FROM un WHERE word NOT IN (SELECT word FROM vo))"""


@register("name_check", f"WITH {UNKNOWN} SELECT id, name FROM na")
def name_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.name_issues(claims(spark, sf_dir), sources(spark, sf_dir))


@register("claim_issues", f"""WITH {UNKNOWN}, sn AS (SELECT DISTINCT item_id AS id, {NUM.format(x=NUMS.format(x='text'))} AS number FROM eval_items), hn AS (SELECT DISTINCT {NUM.format(x=NUMS.format(x='text'))} AS number FROM documents),
nu AS (SELECT id, number FROM sn WHERE length(regexp_replace(number, '[^0-9]', '', 'g')) >= 2 AND number NOT IN (SELECT number FROM hn)),
q AS (SELECT DISTINCT item_id AS id, unnest(regexp_extract_all(text, {Q.q(G.QUOTE)}, 1)) AS quote FROM eval_items), dn AS (SELECT ' ' || {norm_wide('text')} || ' ' AS n FROM documents WHERE text IS NOT NULL),
qu AS (SELECT id, quote FROM q WHERE len(string_split({norm('quote')}, ' ')) >= 3 AND NOT EXISTS (SELECT 1 FROM dn WHERE contains(dn.n, ' ' || {norm('quote')} || ' ')))
SELECT id, 'quote' AS kind, quote AS detail, 'The quotation "' || quote || '" does not appear word for word in the passage.' AS message FROM qu UNION ALL
SELECT id, 'number', number, 'The number ' || number || ' does not appear in the passage.' FROM nu UNION ALL SELECT id, 'name', name, '"' || name || '" is not mentioned anywhere in the book.' FROM na""")  # fmt: skip
def claim_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.all_issues(claims(spark, sf_dir), sources(spark, sf_dir))
