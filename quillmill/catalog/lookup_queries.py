"""Time lookups: words, chunks, chapters and blocks at a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.catalog import sqltext as Q
from quillmill.catalog.catalogue_queries import CLOCK
from quillmill.catalog.text_queries import KIND, TRIMMED
from quillmill.functions import text as T
from quillmill.operators import catalogue as C
from quillmill.operators import lines as L
from quillmill.operators import lookups as K
from quillmill.queries import register
from quillmill.session import table


def points(top: str) -> F.Column:
    """Eight places from before the start to beyond the end."""
    return F.explode(F.transform(F.sequence(F.lit(-1), F.lit(6)), lambda f: F.round(F.col(top) * f / 5.0, 2)))


@register("word_at", f"""WITH c AS (SELECT job_key, i, max(array_to_string(list_filter(pieces, lambda p: p IS NOT NULL), ' ')) AS text FROM chunks WHERE pieces IS NOT NULL GROUP BY ALL),
s AS (SELECT job_key || ':' || i AS id, 1.0::DOUBLE AS s, 1.0::DOUBLE + 0.5::DOUBLE * len({Q.words('text')}) AS e, {Q.words('text')} AS words FROM c), n AS (SELECT * FROM s WHERE len(words) > 0),
p AS (SELECT *, round((1.0::DOUBLE + 0.5::DOUBLE * len(words)) * f / 5.0::DOUBLE, 2) AS pos FROM n, (SELECT unnest(range(-1, 7)) AS f)),
t AS (SELECT id, pos, s, e, words, list_sum(list_transform(words, lambda w: length(w) + 1)) AS total FROM p),
r AS (SELECT *, (pos - s) / (e - s) * total AS target, list_transform(range(1, len(words) + 1), lambda k: list_sum(list_transform(words[1:k], lambda w: length(w) + 1))) AS run FROM t)
SELECT id, pos AS "at", CAST(CASE WHEN pos < s THEN -1 WHEN pos >= e THEN len(words) - 1 ELSE least(len(words) - 1, len(list_filter(run, lambda x: x < target))) END AS INTEGER) AS word FROM r""")  # fmt: skip
def word_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight places of every chunk's time, each with the word spoken then; a chunk's speech starts after one second."""
    c = table(spark, sf_dir, "chunks").where("pieces is not null").groupBy("job_key", "i").agg(F.max(F.array_join("pieces", " ")).alias("text"))
    s = c.select(F.concat_ws(":", "job_key", "i").alias("id"), F.lit(1.0).alias("s"), T.words("text").alias("words"), F.lit(0).alias("a")).where(F.size("words") > 0).withColumn("e", 1.0 + 0.5 * F.size("words"))
    return K.word_at(s.select("id", points("e").alias("at")), s, "id")


@register("chapter_at", """WITH c AS (SELECT DISTINCT book_id, idx, word_count FROM chapters WHERE word_count IS NOT NULL),
t AS (SELECT *, sum(word_count) OVER (PARTITION BY book_id) AS total, sum(word_count) OVER (PARTITION BY book_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - word_count AS before FROM c),
m AS (SELECT book_id, idx, before * 1.0::DOUBLE / total AS start FROM t WHERE total > 0), p AS (SELECT book_id, f / 10.0::DOUBLE AS at FROM (SELECT DISTINCT book_id FROM m), (SELECT unnest(range(-1, 12)) AS f))
SELECT p.book_id, p.at, coalesce((SELECT arg_max(idx, struct_pack(s := start, i := idx)) FROM m WHERE m.book_id = p.book_id AND m.start <= p.at), (SELECT min(idx) FROM m WHERE m.book_id = p.book_id)) AS chapter FROM p""")  # fmt: skip
def chapter_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapter at every tenth of each book."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "chapters").where("word_count is not null").select("book_id", "idx", "word_count").distinct()
    w = Window.partitionBy("book_id")
    before = F.sum("word_count").over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)) - F.col("word_count")
    m = c.withColumns({"total": F.sum("word_count").over(w), "before": before}).where("total > 0").select("book_id", F.col("idx").alias("chapter"), (F.col("before") * 1.0 / F.col("total")).cast("double").alias("start"))
    p = m.select("book_id").distinct().select("book_id", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(11)), lambda f: f.cast("double") / 10.0)).alias("at"))
    return K.chapter_at(p, m, "book_id")


@register("seek", f"""WITH {CLOCK}, e AS (SELECT job_key, max(end_sec) AS total FROM clock GROUP BY job_key),
p AS (SELECT DISTINCT job_key, round(total * f / 5.0::DOUBLE, 2) AS at FROM e, (SELECT unnest(range(-1, 7)) AS f)),
n AS (SELECT p.job_key, p.at, min(c.i) FILTER (c.end_sec > greatest(0, p.at)) AS nx, max(c.i) AS la FROM p JOIN clock c USING (job_key) GROUP BY ALL)
SELECT n.job_key, n.at, c.i, round(greatest(0, n.at) - c.start_sec, 2) AS "into" FROM n JOIN clock c ON c.job_key = n.job_key AND c.i = coalesce(n.nx, n.la)""")  # fmt: skip
def seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where playing goes on for eight places of each job's time, those outside it among them."""
    clock = C.cumulative(table(spark, sf_dir, "chunks"))
    p = clock.groupBy("job_key").agg(F.max("end_sec").alias("total")).select("job_key", points("total").alias("at")).distinct()
    return K.seek(p, clock)


@register("block_at", f"""WITH {TRIMMED}, c AS (SELECT *, {KIND} AS kind, len({Q.words('line')}) AS words FROM k),
o AS (SELECT *, CASE WHEN kind = 'list' THEN regexp_matches({Q.trim(f"regexp_extract(t, {Q.q(Q.LIST_MARKER)}, 1)")}, '(?i)[0-9a-z]') END AS ordered FROM c),
f AS (SELECT *, CASE WHEN kind = 'list' AND lag(kind) OVER w = 'list' AND lag(ordered) OVER w = ordered THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY book_id ORDER BY line_idx)),
g AS (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY line_idx) AS block FROM f),
m AS (SELECT book_id, block, sum(words) AS words FROM g WHERE kind <> 'blank' GROUP BY book_id, block),
bl AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY book_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS word_start FROM m),
t AS (SELECT book_id, sum(words) AS total FROM m GROUP BY book_id), p AS (SELECT DISTINCT book_id, CAST(floor(total * f / 8) AS BIGINT) AS word FROM t, (SELECT unnest(range(0, 10)) AS f))
SELECT p.book_id, p.word, CAST((SELECT min(block) FROM bl WHERE bl.book_id = p.book_id AND p.word >= bl.word_start AND p.word < bl.word_start + bl.words) AS BIGINT) AS block FROM p""")  # fmt: skip
def block_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block at every eighth of each book's words, and beyond the end."""
    b = L.blocks(table(spark, sf_dir, "books"))
    p = b.groupBy("book_id").agg(F.sum("words").alias("total")).select("book_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda f: F.floor(F.col("total") * f / 8))).alias("word")).distinct()
    return K.block_at(p, b, "book_id")


@register("display_words")
def display_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each job with a book, found again in the words the book shows."""
    j = table(spark, sf_dir, "jobs").where("book_id is not null").select("job_key", "book_id").distinct()
    c = table(spark, sf_dir, "chunks").where("pieces is not null").groupBy("job_key", "i").agg(F.max(F.array_join("pieces", " ")).alias("text"))
    text = L.texts(table(spark, sf_dir, "books")).groupBy("book_id").agg(F.max("text").alias("text"))
    shown = j.join(text, "book_id").select("job_key", T.words("text").alias("words"))
    return K.display_words(c.join(j, "job_key", "left_semi").select("job_key", F.col("i").alias("n"), "text"), shown, "job_key")
